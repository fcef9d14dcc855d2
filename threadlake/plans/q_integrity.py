"""Queries: fetch outcomes, integrity and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.functions import hex_to_b64
from threadlake.operators import integrity as ig
from threadlake.operators import manifest as mf
from threadlake.plans import bindings as b
from threadlake.plans.catalog import register


def _resolved(spark, sf):
    return ig.resolve_attempts(b.attempts(spark, sf), retries=ig.RETRIES)


def _with_thread(df):
    return df.withColumn("thread_nr", F.pmod(F.col("file_key").cast("bigint"), F.lit(b.ATTEMPT_THREADS)).cast("string"))


@register("resolve_attempts")
def q_resolve_attempts(spark, sf):
    return _resolved(spark, sf)


@register("short_reads")
def q_short_reads(spark, sf):
    return ig.mark_short_reads(b.attempts(spark, sf)).select(
        "file_key", "n", "bytes_received", "content_length", "short_read", "dl_success", "md5_match")


@register("route_outcomes")
def q_route_outcomes(spark, sf):
    return ig.route_outcomes(_resolved(spark, sf)).select(
        "file_key", "dl_success", "md5_match", "to_report", "to_index", "to_quarantine")


@register("progress")
def q_progress(spark, sf):
    return ig.progress(_with_thread(_resolved(spark, sf)))


@register("integrity_report")
def q_integrity_report(spark, sf):
    failed = _with_thread(_resolved(spark, sf)).where(F.col("dl_success") & ~F.col("md5_match"))
    return ig.integrity_report(failed)


@register("failure_text")
def q_failure_text(spark, sf):
    """The failure reports written as text, one folder per thread, and read back."""
    import uuid

    from threadlake.sources.materialize import table_path

    path = table_path(spark, f"failures-{uuid.uuid4().hex}", sf)
    ig.write_failures(q_integrity_report(spark, sf), path)
    return spark.read.schema("value STRING, thread STRING").text(path).select("thread", F.col("value").alias("line"))


def _declared(spark, sf):
    from threadlake.sources.tables import read_table

    # The digest is taken in the scan, so the join carries 32 characters and not the text.
    d = read_table(spark, sf, "documents").select("doc_id", F.md5(F.concat(F.col("text"), F.lit("#"))).alias("other_hex"))
    m = b.media(spark, sf).select("doc_id", "path", "md5_b64")
    bad = F.pmod(F.col("doc_id"), F.lit(7)) == 0
    return m.join(d, "doc_id").select(
        "doc_id", "path",
        F.when(bad, hex_to_b64(F.col("other_hex"))).otherwise(F.col("md5_b64")).alias("declared_b64"))


@register("integrity")
def q_integrity(spark, sf):
    actual = b.media(spark, sf).select("path", F.col("md5_hex").alias("actual_hex"))
    return ig.verify_integrity(_declared(spark, sf), actual).select(
        "doc_id", "path", "declared_b64", "actual_hex", "md5_match")


@register("skip_existing")
def q_skip_existing(spark, sf):
    req = b.media(spark, sf).where(F.pmod(F.col("doc_id"), F.lit(2)) == 0).select("doc_id", "path")
    existing = b.index_media(spark, sf).select("path")
    return ig.skip_existing(req, existing, overwrite=False)


def _manifest_text(spark, sf):
    m = b.manifest(spark, sf).select("seq", mf.manifest_line(F.col("md5_hex"), F.col("path")).alias("value"))
    bad = (b.media(spark, sf).where(F.pmod(F.col("doc_id"), F.lit(17)) == 0)
           .select((F.col("doc_id") + 2000000000).alias("seq"),
                   F.concat(F.col("md5_hex"), F.lit(" "), F.col("path")).alias("value")))
    return m.unionByName(bad)


@register("manifest_parse")
def q_manifest_parse(spark, sf):
    parsed, _ = mf.parse_manifest(_manifest_text(spark, sf))
    return parsed.select("seq", "md5_hex", "path")


def fetched_media(spark, sf):
    files = b.media(spark, sf).select(
        F.col("doc_id").cast("string").alias("file_key"), "doc_id",
        F.col("md5_b64").alias("file_md5_b64"), F.col("ext").alias("file_ext"),
        F.regexp_extract("path", "^([^/]*)/", 1).alias("folder_name"),
        (F.col("doc_id") + b.NAME_4CH_BASE).cast("string").alias("dl_filename"))
    return files.join(_resolved(spark, sf), "file_key")


@register("manifest_lines")
def q_manifest_lines(spark, sf):
    return mf.fetched_lines(fetched_media(spark, sf)).select("doc_id", "line")


@register("manifest_merge")
def q_manifest_merge(spark, sf):
    m = b.media(spark, sf)
    rows = m.select("doc_id", F.regexp_extract("path", "^([^/]*)/", 1).alias("rel_dir"),
                    mf.manifest_line(F.col("md5_hex"), F.regexp_extract("path", "/(.*)$", 1)).alias("value"))
    return mf.merge_manifest_rows(rows).select("doc_id", "rel_dir", "md5_hex", "path", "line")


def _quarantine(spark, sf):
    dec = b.decisions(spark, sf).select("md5_hex", "path", "keep", "actual_md5_hex")
    return mf.apply_quarantine(b.manifest(spark, sf), dec)


@register("quarantine_apply")
def q_quarantine_apply(spark, sf):
    return _quarantine(spark, sf)[0].select("seq", "md5_hex", "path")


@register("quarantine_kept")
def q_quarantine_kept(spark, sf):
    return _quarantine(spark, sf)[1]


@register("quarantine_listing")
def q_quarantine_listing(spark, sf):
    failed = b.decisions(spark, sf).select(
        F.regexp_extract("path", "^([^/]*)/", 1).alias("thread_nr"), F.col("doc_id").alias("seq"), "path")
    x = mf.quarantine_listing(failed)
    return x.select("thread_nr", "seq", "path", "idx",
                    F.format_string("(%d) %s", F.col("idx"), F.regexp_extract("path", "/([^/]*)$", 1)).alias("line"))
