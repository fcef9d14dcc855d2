"""Queries: scalar functions and predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake import functions as tf
from threadlake.operators import index as ix
from threadlake.plans import bindings as b
from threadlake.plans.catalog import register
from threadlake.sources.tables import read_table


@register("size_bucket")
def q_size_bucket(spark, sf):
    return b.media(spark, sf).select("doc_id", "size_bytes", "size_mb")


def _size_texts(spark, sf):
    m = b.media(spark, sf)
    byt = F.col("size_bytes")
    k = F.pmod(F.col("doc_id"), F.lit(4))
    frac_kb = F.concat(F.floor(byt / 1024).cast("string"), F.lit("."),
                       F.pmod(F.floor(byt * 10 / 1024).cast("bigint"), F.lit(10)).cast("string"), F.lit(" KB"))
    mb3 = F.concat(F.floor(byt / 1048576).cast("string"), F.lit("."),
                   F.lpad(F.pmod(F.floor(byt * 1000 / 1048576).cast("bigint"), F.lit(1000)).cast("string"), 3, "0"),
                   F.lit(" MB"))
    text = (F.when(k == 0, tf.format_size_text(byt))
            .when(k == 1, frac_kb)
            .when(k == 2, F.concat(byt.cast("string"), F.lit(" B")))
            .otherwise(mb3))
    return m.select("doc_id", text.alias("size_text"))


@register("size_text")
def q_size_text(spark, sf):
    return _size_texts(spark, sf).withColumn("size_mb", tf.size_text_mb(F.col("size_text")))


@register("size_rejects")
def q_size_rejects(spark, sf):
    """Size texts that have no bucket, and why."""
    return (_size_texts(spark, sf).withColumn("reason", tf.size_text_reject(F.col("size_text")))
            .where(F.col("reason").isNotNull()))


@register("digest_convert")
def q_digest_convert(spark, sf):
    m = b.media(spark, sf)
    loose = F.concat(F.substring("md5_b64", 1, 21), F.lit("f=="))
    return m.select("doc_id", "md5_hex", "md5_b64",
                    tf.b64_to_hex(F.col("md5_b64")).alias("hex_from_b64"),
                    loose.alias("loose_b64"),
                    tf.b64_to_hex(loose).alias("hex_from_loose"))


@register("sanitize_name")
def q_sanitize_name(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", tf.sanitize_name(F.col("text")).alias("sanitized"))


@register("stored_name")
def q_stored_name(spark, sf):
    """Server name, or server_orig when the toggle is on, then ``_<sanitised text>``."""
    n = b.file_names(spark, sf)
    use_orig = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    base = F.when(use_orig, F.concat_ws("_", "name_4ch", "orig_name")).otherwise(F.col("name_4ch"))
    suffix = tf.sanitize_name(F.concat(F.col("source"), F.lit(": "), F.col("lang"), F.lit("?")))
    return n.select("doc_id", F.concat_ws("_", base, suffix).alias("stored_name"))


@register("artist_names")
def q_artist_names(spark, sf):
    n = b.file_names(spark, sf).select("doc_id", "orig_name", tf.artist_names(F.col("orig_name")).alias("a"))
    return n.select("doc_id", "orig_name", F.array_join("a", "|").alias("artists"),
                    F.size("a").cast("bigint").alias("n_artists"))


def _raw_paths(spark, sf):
    m = b.media(spark, sf)
    k = F.pmod(F.col("doc_id"), F.lit(4))
    did = F.col("doc_id").cast("string")
    raw = (F.when(k == 0, F.col("path"))
           .when(k == 1, F.regexp_replace("path", "/", "\\\\"))
           .when(k == 2, F.concat(F.lit("./"), F.regexp_extract("path", "^([^/]*)/", 1), F.lit("//"), did,
                                  F.lit("."), F.col("ext")))
           .otherwise(F.concat(F.regexp_extract("path", "^([^/]*)/", 1), F.lit("/./"), did, F.lit(".tar."),
                               F.col("ext"))))
    return m.select("doc_id", raw.alias("raw_path"))


@register("path_parts")
def q_path_parts(spark, sf):
    p = _raw_paths(spark, sf).withColumn("path", tf.normalize_rel_path(F.col("raw_path")))
    name, ext = tf.split_name_ext(tf.basename(F.col("path")))
    return p.select("doc_id", "raw_path", "path", tf.dirname(F.col("path")).alias("dir"),
                    tf.basename(F.col("path")).alias("base"), tf.strip_ext(tf.basename(F.col("path"))).alias("name"),
                    ext.alias("ext"))


@register("indent_lines")
def q_indent_lines(spark, sf):
    c = read_table(spark, sf, "conversations")
    lvl = F.pmod(F.col("turn"), F.lit(4)).cast("int")
    x = c.select("conv_id", "turn", lvl.alias("lvl"), F.posexplode(tf.split_lines(F.col("text"))).alias("pos", "l"))
    return x.select("conv_id", "turn", (F.col("pos") + 1).cast("bigint").alias("line_no"),
                    tf.indent_line(F.col("l"), F.col("lvl")).alias("line"),
                    tf.rule_line(F.col("lvl")).alias("rule"))


@register("file_text_parts")
def q_file_text_parts(spark, sf):
    m = b.media(spark, sf)
    res = F.when(F.col("ext") == "pdf", F.lit("PDF")).otherwise(
        F.concat((F.pmod(F.col("doc_id"), F.lit(900)) + 100).cast("string"), F.lit("x"),
                 (F.pmod(F.col("size_bytes"), F.lit(700)) + 100).cast("string")))
    line = F.concat(F.lit("File: "), (F.col("doc_id") + b.NAME_4CH_BASE).cast("string"), F.lit("."), F.col("ext"),
                    F.lit(" ("), tf.format_size_text(F.col("size_bytes")), F.lit(", "), res, F.lit(")"))
    x = m.select("doc_id", line.alias("file_text"))
    size, r = tf.file_text_parts(F.col("file_text"))
    return x.select("doc_id", "file_text", size.alias("size_text"), r.alias("res"))


@register("url_classify")
def q_url_classify(spark, sf):
    u = b.urls(spark, sf)
    return u.select("page_id", "url", tf.is_thread_url(F.col("url")).alias("is_thread_url"),
                    tf.is_file_url(F.col("url")).alias("is_file_url"))


@register("url_key")
def q_url_key(spark, sf):
    u = b.urls(spark, sf).where(tf.is_file_url(F.col("url")))
    return u.select("page_id", "url", tf.file_key(F.col("url")).alias("file_key"),
                    tf.canonical_url(F.col("url")).alias("canonical_url"))


@register("valid_folder")
def q_valid_folder(spark, sf):
    d = read_table(spark, sf, "documents")
    k = F.pmod(F.col("doc_id"), F.lit(5))
    folder = (F.when(k == 0, F.col("source"))
              .when(k == 1, F.concat(F.col("source"), F.lit(":x")))
              .when(k == 2, F.concat(F.lit(" "), F.col("source"), F.lit(" ")))
              .when(k == 3, F.concat(F.col("source"), F.lit("/"), F.col("lang")))
              .otherwise(F.concat(F.col("lang"), F.lit("?"))))
    return d.select("doc_id", folder.alias("folder"), tf.valid_folder(folder).alias("valid"))


@register("source_requests")
def q_source_requests(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tf.is_source_request(F.col("text")).alias("is_request"))


@register("media_filter")
def q_media_filter(spark, sf):
    m = b.media(spark, sf)
    k = F.pmod(F.col("doc_id"), F.lit(6))
    path = (F.when(k == 0, F.concat(F.lit("site_files/"), F.col("path")))
            .when(k == 1, F.regexp_replace("path", r"\.([a-z]+)$", ".JPG"))
            .when(k == 2, F.concat(F.lit("x-Dateien/"), F.col("path")))
            .when(k == 3, F.concat(F.col("path"), F.lit("_files")))
            .otherwise(F.col("path")))
    listing = m.select("doc_id", path.alias("path"), "size_bytes", "md5_b64")
    return ix.media_filter(ix.media_rows(listing)).select("doc_id", "path", "ext", "size_mb")
