"""Media tree scan (S2): path, size and content digest of every allowed file below a root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import allowed_ext, hex_to_b64, md5_b64, pruned_dir, size_bucket
from threadlake.functions.urls import DIR_SUBSTR_EXCLUDE, VALID_FILE_EXT
from threadlake.session import cut_lineage
from threadlake.sources.paths import relative_to, root_uri

# The largest content that one binary value can hold.
MAX_CONTENT = 2**31 - 16


def scan_media(spark: SparkSession, root: str, exts: Sequence[str] = VALID_FILE_EXT,
               exclude: Sequence[str] = DIR_SUBSTR_EXCLUDE, listing: DataFrame | None = None) -> DataFrame:
    """``(path, ext, size_bytes, size_mb, md5_b64)`` for files below ``root``.

    The extension allow-list is a ``pathGlobFilter`` (case-sensitive, applied while
    listing) and pruned directories are filtered on ``_metadata.file_path``, so neither
    is ever read. Content is read once per kept file and only its digest leaves the
    scan task. Files over ``MAX_CONTENT`` bytes are left to ``oversize_media`` (the length
    filter is applied before content is read).

    Spark's file source hides names that start with ``_`` or ``.``. With ``listing``
    (``list_media``, or an inventory ``(path, size_bytes)`` relative to the root) every listed
    file is taken, whatever its name and size: it is digested in pieces in a task.
    """
    if listing is not None:
        return _digest_listing(spark, root, listing, exts, exclude)
    glob = "*.{" + ",".join(exts) + "}" if len(exts) > 1 else f"*.{exts[0]}"
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
           .option("pathGlobFilter", glob).load(root))
    rel = relative_to(spark, root)
    kept = raw.where(~pruned_dir(rel, exclude) & (F.col("length") <= MAX_CONTENT))
    return kept.select(
        rel.alias("path"),
        F.regexp_extract(rel, r"\.([^./]*)$", 1).alias("ext"),
        F.col("length").alias("size_bytes"),
        size_bucket(F.col("length")).alias("size_mb"),
        md5_b64(F.col("content")).alias("md5_b64"),
    )


def oversize_media(spark: SparkSession, root: str, exts: Sequence[str] = VALID_FILE_EXT,
                   exclude: Sequence[str] = DIR_SUBSTR_EXCLUDE, limit: int = MAX_CONTENT) -> DataFrame:
    """Reject rows ``(path, size_bytes, reason)``: files whose content does not fit one value.
    Only the listing is read."""
    glob = "*.{" + ",".join(exts) + "}" if len(exts) > 1 else f"*.{exts[0]}"
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
           .option("pathGlobFilter", glob).load(root))
    rel = relative_to(spark, root)
    return raw.where(~pruned_dir(rel, exclude) & (F.col("length") > limit)).select(
        rel.alias("path"), F.col("length").alias("size_bytes"), F.lit("too_large").alias("reason"))


LISTED_AT_ONCE = 10_000  # entries of a directory that a task holds at once


def _entries(store, base: str, path: str):
    """Entries (name, is_dir, size, modified in nanoseconds) of a directory. A link to a directory is
    none: what it leads to is listed where it lies, or lies outside the tree (and a loop would never
    end). A link to a file is a file."""
    import os

    from pyarrow import fs

    where = f"{base}/{path}" if path else base
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(where) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, 0, 0
                elif e.is_file():
                    info = e.stat()
                    yield e.name, False, info.st_size, info.st_mtime_ns
        return
    for e in store.get_file_info(fs.FileSelector(where)):
        if e.type in (fs.FileType.Directory, fs.FileType.File):
            yield e.base_name, e.type == fs.FileType.Directory, e.size or 0, e.mtime_ns or 0


def list_media(spark: SparkSession, root: str, exclude: Sequence[str] = DIR_SUBSTR_EXCLUDE) -> DataFrame:
    """``(path, size_bytes, modified)`` of every file below ``root``, hidden names included;
    ``modified`` in nanoseconds since 1970.

    One step per directory level: the directories of a level are spread over tasks, which
    list them in pieces; pruned directories are not entered, links to directories not followed.
    Each level is a written table, and the driver only asks whether another level exists.
    """
    uri, n = root_uri(spark, root), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entries(batches):
        from itertools import islice

        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        for pdf in batches:
            for d in pdf["path"]:
                found = _entries(store, base, d)
                while part := list(islice(found, LISTED_AT_ONCE)):
                    yield pd.DataFrame([(f"{d}/{name}" if d else name, *rest) for name, *rest in part],
                                       columns=["path", "is_dir", "size_bytes", "modified"])

    level = spark.sql("SELECT '' AS path")
    files = None
    while True:
        found = cut_lineage(level.mapInPandas(entries, "path STRING, is_dir BOOLEAN, size_bytes BIGINT, modified BIGINT"))
        here = found.where(~F.col("is_dir")).select("path", "size_bytes", "modified")
        files = here if files is None else files.unionByName(here)
        inner = F.concat("path", F.lit("/x"))
        dirs = found.where(F.col("is_dir") & ~pruned_dir(inner, exclude)).select("path")
        if dirs.isEmpty():
            return files
        level = dirs.repartition(n, "path")


SCAN_DDL = "path STRING, ext STRING, size_bytes BIGINT, size_mb DECIMAL(12,2), md5_b64 STRING, modified BIGINT"


def scan_changes(spark: SparkSession, root: str, before: DataFrame, exts: Sequence[str] = VALID_FILE_EXT,
                 exclude: Sequence[str] = DIR_SUBSTR_EXCLUDE) -> tuple[DataFrame, DataFrame]:
    """S2 again over a tree that was scanned before: ``(scan, changes)``.

    ``before`` and ``scan`` have the columns of ``SCAN_DDL`` (an empty ``before``: a first scan).
    A file whose path, size and modification time are those of the scan before keeps its digest;
    only new and changed files are read. ``changes(path, change)`` says what became of a path: ``new``,
    ``changed`` or ``gone``; paths without a row are as they were.
    """
    ext = F.regexp_extract("path", r"\.([^./]*)$", 1)
    now = cut_lineage(list_media(spark, root, exclude).where(allowed_ext(ext, exts) & ~pruned_dir(F.col("path"), exclude)))
    old = before.select("path", *[F.col(c).alias(f"_{c}") for c in ("ext", "size_bytes", "size_mb", "md5_b64", "modified")])
    x = now.join(old, "path", "full")
    same = (F.col("size_bytes") == F.col("_size_bytes")) & (F.col("modified") == F.col("_modified"))
    change = (F.when(F.col("size_bytes").isNull(), F.lit("gone")).when(F.col("_size_bytes").isNull(), F.lit("new"))
              .when(~F.coalesce(same, F.lit(False)), F.lit("changed")))
    x = cut_lineage(x.withColumn("change", change))
    kept = x.where(F.col("change").isNull()).select(
        "path", *[F.col(f"_{c}").alias(c) for c in ("ext", "size_bytes", "size_mb", "md5_b64", "modified")])
    todo = x.where(F.col("change").isin("new", "changed")).select("path", "size_bytes", "modified")
    fresh = _digest_listing(spark, root, todo.select("path", "size_bytes"), exts, exclude)
    scan = kept.unionByName(fresh.join(todo.select("path", "modified"), "path"))
    return scan, x.where(F.col("change").isNotNull()).select("path", "change")


def _digest_listing(spark: SparkSession, root: str, listing: DataFrame, exts: Sequence[str],
                    exclude: Sequence[str]) -> DataFrame:
    uri, n = root_uri(spark, root), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def digests(batches):
        import hashlib

        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                h = hashlib.md5()
                with store.open_input_stream(f"{base}/{path}") as f:
                    while piece := f.read(1 << 20):
                        h.update(piece)
                out.append(h.hexdigest())
            yield pd.DataFrame({"path": pdf["path"], "size_bytes": pdf["size_bytes"], "md5_hex": out})

    ext = F.regexp_extract("path", r"\.([^./]*)$", 1)
    kept = listing.where(allowed_ext(ext, exts) & ~pruned_dir(F.col("path"), exclude)).select("path", "size_bytes")
    return kept.repartition(n, "path").mapInPandas(digests, "path STRING, size_bytes BIGINT, md5_hex STRING").select(
        "path", ext.alias("ext"), "size_bytes", size_bucket(F.col("size_bytes")).alias("size_mb"),
        hex_to_b64(F.col("md5_hex")).alias("md5_b64"))
