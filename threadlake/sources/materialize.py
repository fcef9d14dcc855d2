"""Write-once derived tables in the shared checkpoint folder.

Derived views that many queries read (rendered thread pages) are written once as
Parquet under ``spark.checkpoint.dir`` and read back. This cuts their lineage (an
executor loss re-reads files instead of recomputing the derivation), gives later scans
column pruning and real statistics, and keeps optimizer work small. The folder comes
from the session; only a bare local session gets a scratch one (see ``session``).
"""

from __future__ import annotations

import hashlib

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import ensure_checkpoint_dir


def _fs_exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def input_signature(spark: SparkSession, paths: list[str]) -> str:
    """Length and modification time of the given inputs, for a folder those of all files
    below it: a derived table is rebuilt when one of them changes."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            st = fs.getFileStatus(p)
            if st.isDirectory():
                files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                n, sign = files.agg(F.count(F.lit(1)), F.sum(
                    F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
                parts.append(f"{path}:{n}:{sign}")
                continue
            parts.append(f"{path}:{st.getLen()}:{st.getModificationTime()}")
        else:
            parts.append(f"{path}:missing")
    return "|".join(parts)


def table_path(spark: SparkSession, name: str, key: str = "") -> str:
    """A folder for a derived table under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    tag = hashlib.sha1(key.encode()).hexdigest()[:12]
    return f"{base}/threadlake-tables/{name}-{tag}"


def materialize(spark: SparkSession, build: Callable[[], DataFrame], name: str, key: str = "") -> DataFrame:
    """Write ``build()`` once to ``<checkpoint dir>/threadlake-tables/<name>-<hash(key)>``
    and read it back; later calls only read (the plan is not even built)."""
    path = table_path(spark, name, key)
    if not _fs_exists(spark, f"{path}/_SUCCESS"):
        # Write aside, then rename into place: a reader never sees a half-written table,
        # and when two jobs race, the first complete table wins and the other is unused.
        import uuid

        tmp = f"{path}.tmp-{uuid.uuid4().hex}"
        build().write.parquet(tmp)
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        src, dst = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(path)
        fs = dst.getFileSystem(conf)
        if fs.exists(dst) and not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            fs.delete(dst, True)  # an interrupted earlier attempt
        if not fs.rename(src, dst):
            fs.delete(src, True)
    return spark.read.parquet(path)
