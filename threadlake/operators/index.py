"""Media index: build, look up, upsert, statistics.

The index is kept *flat*: one row per stored file ``(ext, size_mb, md5_b64, path)``.
The archive tool keeps ``{ext: {size: {md5: [paths]}}}``; a path list per digest is a
group that can be arbitrarily large (blank or placeholder images copied everywhere), so
lists are never materialised. Lookups aggregate the index per key with algebraic
aggregates (count, min), which Spark combines map-side before the shuffle, and then
join one summary row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import (
    allowed_ext, basename, dirname, normalize_rel_path, pruned_dir, size_bucket, split_name_ext,
)
from threadlake.functions.urls import DIR_SUBSTR_EXCLUDE, VALID_FILE_EXT

INDEX_KEYS = ("ext", "size_mb", "md5_b64")
MATCH_KEYS = {"ext_size_md5": INDEX_KEYS, "md5": ("md5_b64",)}


def media_rows(listing: DataFrame) -> DataFrame:
    """``(path, size_bytes, md5_b64)`` -> adds normalised path, ``ext`` and ``size_mb``."""
    path = normalize_rel_path(F.col("path"))
    _, ext = split_name_ext(basename(path))
    return (listing
            .withColumn("path", path)
            .withColumn("ext", ext)
            .withColumn("size_mb", size_bucket(F.col("size_bytes"))))


def _parent_segment(path):
    """A ``..`` segment: the path would leave the archive root (rejected, never resolved)."""
    return F.coalesce(path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def media_filter(media: DataFrame, exts: Sequence[str] = VALID_FILE_EXT,
                 exclude: Sequence[str] = DIR_SUBSTR_EXCLUDE) -> DataFrame:
    """Keep allowed extensions (case-sensitive) outside pruned directories."""
    return media.where(allowed_ext(F.col("ext"), exts) & ~pruned_dir(F.col("path"), exclude)
                       & ~_parent_segment(F.col("path")))


def media_rejects(media: DataFrame, exts: Sequence[str] = VALID_FILE_EXT,
                  exclude: Sequence[str] = DIR_SUBSTR_EXCLUDE) -> DataFrame:
    reason = (F.when(_parent_segment(F.col("path")), F.lit("parent_segment"))
              .when(pruned_dir(F.col("path"), exclude), F.lit("pruned_dir"))
              .when(F.col("ext").isNull(), F.lit("no_ext"))
              .when(~allowed_ext(F.col("ext"), exts), F.lit("ext_not_allowed")))
    return media.withColumn("reason", reason).where(F.col("reason").isNotNull())


def build_index(media: DataFrame, exts: Sequence[str] = VALID_FILE_EXT,
                exclude: Sequence[str] = DIR_SUBSTR_EXCLUDE) -> DataFrame:
    """A1: the flat index ``(ext, size_mb, md5_b64, path)`` (no shuffle needed)."""
    return media_filter(media, exts, exclude).select(*INDEX_KEYS, "path")


def index_groups(index: DataFrame) -> DataFrame:
    """One row per key: number of stored copies and the first/last path (partial aggregates)."""
    return (index.groupBy(*INDEX_KEYS)
            .agg(F.count(F.lit(1)).alias("n_paths"),
                 F.min("path").alias("first_path"),
                 F.max("path").alias("last_path")))


def duplicate_groups(index: DataFrame) -> DataFrame:
    """A3: keys stored more than once."""
    return index_groups(index).where(F.col("n_paths") > 1)


def _unless_unknown(keys: list[str], verdict):
    """A candidate with an unknown key part (size unit, digest) is neither new nor a copy."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.when(known, verdict)


def _join_summary(cand: DataFrame, summary: DataFrame, keys: list[str], co_located: bool) -> DataFrame:
    """Left join of the candidates with one row per key.

    A join directly above the summary's own group-by reuses its partitioning, and then AQE
    does not split a hot key of the candidates. The join is therefore on a struct of the
    key parts: both sides get a shuffle of their own (the summary's is one row per key),
    which AQE's skew join can split. ``co_located``: the index is a table bucketed on the
    key; join on the columns, so that only the candidates are shuffled (hot keys unsplit).
    """
    if co_located:
        added = [c for c in summary.columns if c not in keys]
        return cand.join(summary, keys, "left").select(*cand.columns, *added)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    key = F.when(known, F.struct(*keys))
    return cand.withColumn("_key", key).join(summary.withColumn("_key", key).drop(*keys), "_key", "left").drop("_key")


def novel(cand: DataFrame, index: DataFrame, match_on: str = "ext_size_md5", co_located: bool = False) -> DataFrame:
    """Flag each candidate ``is_new`` iff its key is absent from the index.

    Candidates are not de-duplicated against each other (two copies in one batch both
    stay new). A NULL key part (unknown size unit) gives ``is_new = NULL``.
    """
    keys = list(MATCH_KEYS[match_on])
    seen = index.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return (_join_summary(cand, seen, keys, co_located).withColumn("is_new", _unless_unknown(keys, F.col("_seen").isNull()))
            .drop("_seen"))


def lookup_duplicates(cand: DataFrame, index: DataFrame, match_on: str = "ext_size_md5",
                      co_located: bool = False) -> DataFrame:
    """Per candidate, how many copies are stored and where the first one is.

    The full list of copies of a key is ``index.where(key = ...)``; it is never folded into
    one value, so a hot digest cannot blow up a row or a task.
    """
    keys = list(MATCH_KEYS[match_on])
    summary = (index.groupBy(*keys)
               .agg(F.count(F.lit(1)).alias("n_copies"), F.min("path").alias("first_path")))
    return (_join_summary(cand, summary, keys, co_located)
            .withColumn("n_copies", F.coalesce(F.col("n_copies"), F.lit(0)).cast("bigint"))
            .withColumn("is_new", _unless_unknown(keys, F.col("n_copies") == 0)))


def upsert_index(index: DataFrame, verified: DataFrame, exts: Sequence[str] = VALID_FILE_EXT) -> tuple[DataFrame, DataFrame]:
    """A2: append verified files ``(ext, size_bytes, md5_b64, path)``; duplicates are kept.

    Returns ``(new_index, rejects)``; an extension outside the allow-list is a reject.
    """
    rows = verified.select(
        "ext", size_bucket(F.col("size_bytes")).alias("size_mb"), "md5_b64",
        normalize_rel_path(F.col("path")).alias("path"))
    ok = allowed_ext(F.col("ext"), exts) & ~_parent_segment(F.col("path"))
    new_index = index.select(*INDEX_KEYS, "path").unionByName(rows.where(ok))
    rejects = rows.where(~ok).withColumn(
        "reason", F.when(_parent_segment(F.col("path")), F.lit("parent_segment")).otherwise(F.lit("ext_not_allowed")))
    return new_index, rejects


def bucket_stats(index: DataFrame) -> DataFrame:
    """A3: per extension and overall: files, size buckets, buckets holding more than one file."""
    buckets = index.groupBy("ext", "size_mb").agg(F.count(F.lit(1)).alias("n_files"))
    return (buckets.rollup("ext")
            .agg(F.sum("n_files").cast("bigint").alias("n_files"),
                 F.count(F.lit(1)).alias("n_buckets"),
                 F.count_if(F.col("n_files") > 1).alias("n_shared_buckets")))


def bucket_occupancy(index: DataFrame) -> DataFrame:
    """A3: per size bucket, files and distinct digests (a bucket holding more than one
    digest is one the size key alone cannot settle). The distinct count is planned as a
    two-phase aggregate, so a hot bucket is not counted in one task."""
    return index.groupBy("ext", "size_mb").agg(
        F.count(F.lit(1)).alias("n_files"), F.countDistinct("md5_b64").alias("n_digests"))


def index_directories(index: DataFrame) -> DataFrame:
    """A5: distinct parent directories of indexed paths."""
    return index.select(dirname(F.col("path")).alias("dir")).distinct()


def complete_dirs(dirs: DataFrame, prefix: str) -> DataFrame:
    """Directories starting with ``prefix`` (every one when the prefix is empty)."""
    return dirs.where(F.col("dir").startswith(prefix))
