"""Checksum manifests ``<md5 hex> *<relative path>``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import b64_to_hex
from threadlake.operators.sequence import prefix_sums
from threadlake.session import cut_lineage
from threadlake.sources.paths import relative_to

# Line layout and separator.
LINE_FORMAT = "%s *%s"
SEPARATOR = " *"


def parse_manifest(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """S3: split each line once on ``" *"`` -> ``(md5_hex, path)``; lines without it are rejects."""
    parts = F.split(F.col(value), r" \*", 2)
    ok = F.size(parts) == 2
    parsed = lines.where(ok).withColumn("md5_hex", parts[0]).withColumn("path", parts[1]).drop(value)
    rejects = lines.where(~ok & (F.col(value) != "")).withColumn("reason", F.lit("no_separator"))
    return parsed, rejects


def manifest_line(md5_hex, path):
    return F.format_string(LINE_FORMAT, md5_hex, path)


def fetched_lines(outcomes: DataFrame) -> DataFrame:
    """A line per fetched file, **even when its digest failed** (the declared digest is
    written). ``outcomes``: dl_success, file_md5_b64, folder_name, dl_filename, file_ext."""
    path = F.format_string("%s/%s.%s", "folder_name", "dl_filename", "file_ext")
    return outcomes.where(F.coalesce(F.col("dl_success"), F.lit(False))).select(
        "*", manifest_line(b64_to_hex(F.col("file_md5_b64")), path).alias("line"))


def merge_manifest_rows(rows: DataFrame) -> DataFrame:
    """Rows ``(rel_dir, value)`` of manifests found below a root -> merged lines with
    each path prefixed by its manifest's directory (bag union, nothing dropped)."""
    parsed, _ = parse_manifest(rows)
    return parsed.withColumn("line", manifest_line(F.col("md5_hex"), F.concat_ws("/", "rel_dir", "path")))


def read_manifest_lines(spark, path: str) -> DataFrame:
    """Every line of manifest file(s) as ``(file, seq, value, md5_hex, path)``; a line without
    the separator (comment, empty) has NULL ``md5_hex`` and ``path``.

    ``seq`` is the line's order: file, start of the block in it, then the running id of the
    scan, which ascends within a block. The rows are written once, so every branch sees
    the same ids.
    """
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                   F.monotonically_increasing_id().alias("n"))
    raw = cut_lineage(spark.read.text(path).select(seq.alias("seq"), "value"))
    parts = F.split(F.col("value"), r" \*", 2)
    ok = F.size(parts) == 2
    return raw.select(F.col("seq.file").alias("file"), "seq", "value",
                      F.when(ok, parts[0]).alias("md5_hex"), F.when(ok, parts[1]).alias("path"))


def read_manifest(spark, path: str) -> DataFrame:
    """The parsed lines of manifest file(s) as ``(file, seq, md5_hex, path)``."""
    return read_manifest_lines(spark, path).where(F.col("md5_hex").isNotNull()).drop("value")


def append_manifest(outcomes: DataFrame, path: str) -> None:
    """S4 sink: append the lines of fetched files (``fetched_lines``) to the manifest folder
    ``path``; earlier lines stay."""
    fetched_lines(outcomes).select(F.col("line").alias("value")).write.mode("append").text(path)


def read_manifest_tree(spark, root: str) -> DataFrame:
    """Every ``*.md5*`` file below ``root`` as ``(rel_dir, value)`` (``"."`` at the root)."""
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md5*")
           .text(root).select("value", relative_to(spark, root).alias("file")))
    rel = F.regexp_extract(F.col("file"), r"^(.*)/[^/]*$", 1)
    return raw.select(F.when(rel == "", F.lit(".")).otherwise(rel).alias("rel_dir"), "value") \
        .where(F.trim("value") != "")


def apply_quarantine(manifest: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply keep/drop decisions for files whose digest failed.

    ``manifest(seq, md5_hex, path)``; ``decisions(md5_hex, path, keep, actual_md5_hex)``. If both
    have a column ``file`` (several manifests), a decision holds in its own manifest only.
    Only the first matching row (lowest ``seq``) of each decided ``(md5_hex, path)`` is
    touched: kept -> its digest becomes the actual one; dropped -> removed. Rows with NULL
    ``md5_hex`` (lines that are no entries) match nothing and stay. Returns
    ``(patched_manifest, kept_lines, to_delete)``. The first row per key is a partial
    ``min`` aggregate and the patch joins on the unique ``seq``, so a line repeated many
    times is never gathered into one task.
    """
    entry = [*(["file"] if "file" in manifest.columns and "file" in decisions.columns else []), "md5_hex", "path"]
    first = manifest.groupBy(*entry).agg(F.min("seq").alias("seq"))
    hit = first.join(decisions, entry).select("seq", "keep", "actual_md5_hex")
    patched = (manifest.join(hit, "seq", "left")
               .where(F.coalesce(F.col("keep"), F.lit(True)))
               .withColumn("md5_hex", F.when(F.col("keep"), F.col("actual_md5_hex")).otherwise(F.col("md5_hex")))
               .drop("keep", "actual_md5_hex"))
    kept = decisions.where("keep").select("md5_hex", "path", manifest_line(F.col("md5_hex"), F.col("path")).alias("line"))
    to_delete = decisions.where(~F.col("keep")).select("md5_hex", "path")
    return patched, kept, to_delete


def write_manifests(manifest: DataFrame, out_dir: str) -> None:
    """Lines ``(file, seq, value, md5_hex, path)`` back as one manifest for each file: the text below
    ``manifest=<file>/`` (of a single file: below ``out_dir`` itself), part files in order of name,
    lines in order of ``seq``. An entry is written from its digest and path, any other line as it
    was."""
    entry = F.when(F.col("md5_hex").isNotNull(), manifest_line(F.col("md5_hex"), F.col("path")))
    lines = manifest.select(F.coalesce(entry, F.col("value")).alias("value"), F.col("file").alias("manifest"), "seq")
    lines = lines.repartitionByRange("manifest", "seq").sortWithinPartitions("manifest", "seq").select("value", "manifest")
    if manifest.select("file").distinct().limit(2).count() > 1:
        lines.write.mode("overwrite").partitionBy("manifest").text(out_dir)
    else:
        lines.select("value").write.mode("overwrite").text(out_dir)


def quarantine_listing(failed: DataFrame, key: str = "thread_nr", seq: str = "seq") -> DataFrame:
    """Number the failed files of each thread from 0 in ``seq`` order (blockwise
    running count, so a thread with very many failures is not sorted in one task)."""
    x = prefix_sums(failed, [key], seq, {"_rank": F.lit(1)})
    return x.withColumn("idx", (F.col("_rank") - 1).cast("bigint")).drop("_rank")
