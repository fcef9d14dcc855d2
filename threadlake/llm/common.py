"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import io
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the executors' Python workers (once per application): a zip
    in the shared folder, added as ``--py-files`` would do. Their functions are then found by
    name, and what a worker has learnt (words, tables) outlives a task."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/py-{uuid.uuid4().hex}/{root.name}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


class Scratch:
    """Written tables of one operator call, in the folder that all executors share.

    A written table cuts the lineage: an executor that is lost takes nothing with it, and the
    shuffles behind the table are no longer needed. ``write`` therefore also lets Spark's own
    cleaner drop them; ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path, schema = f"{self.base}/{name}", df.schema
        df.write.option("compression", "zstd").options(**options).parquet(path)
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def release(self) -> None:
        """Spark removes shuffle files once the driver's garbage collector has found that
        nothing refers to them any more. The session holds on to the last query it ran, so a
        small one comes in between."""
        self.spark.range(1).count()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def passed_on(docs: DataFrame, id_col: str, text_col: str, results: list[str], with_text: bool) -> tuple[DataFrame, list[str], str, list]:
    """For operators that pass documents through Arrow: (doc, text, then the input columns under
    safe names), those names, their DDL, and the columns that give the input's names back. The
    text travels once."""
    keep = [c for c in with_results(docs, results) if c != text_col]
    names = [f"_{i}" for i in range(len(keep))]
    wide = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("binary").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)))
    ddl = [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names)]
    back = {c: F.col(n).alias(c) for c, n in zip(keep, names)}
    if with_text and text_col in with_results(docs, results):
        names, ddl = [*names, "text"], [*ddl, "text binary"]
        back[text_col] = F.col("text").cast("string").alias(text_col)
    return wide, names, ", ".join(ddl), [back[c] for c in docs.columns if c in back]


def with_results(df: DataFrame, results: list[str]) -> list[str]:
    """The input columns that an operator passes on: all but those named like its results."""
    taken = {c.lower() for c in results}
    return [c for c in df.columns if c.lower() not in taken]


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a binary Arrow column without a copy per row; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null row may still span bytes
        lens = np.diff(offs) * column.is_valid().to_numpy(zero_copy_only=False)
        kept = [buf[s:s + n] for s, n in zip(offs[:-1], lens)]
        return (np.concatenate(kept) if kept else buf[:0]), np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    return buf, offs
