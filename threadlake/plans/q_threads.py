"""Queries: page scan, extraction, reply graph, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake import functions as tf
from threadlake.operators import extract as ex
from threadlake.operators import graph as g
from threadlake.operators import report as rp
from threadlake.plans import bindings as b
from threadlake.plans.catalog import register
from threadlake.sources.tables import read_table


@b.memo
def _pages(spark, sf):
    return b.thread_pages_table(spark, sf, "plain")


@b.memo
def _posts(spark, sf):
    return ex.extract_posts(_pages(spark, sf))


@b.memo
def _files(spark, sf):
    return ex.extract_files(_pages(spark, sf))


@b.memo
@b.derived("post-rows", ("conversations", "documents"))
def post_rows_table(spark, sf):
    """Posts with their file fields, parsed from the pages in one pass and written once:
    the graph, report and curation jobs read projections of it instead of parsing every
    page again for each of their branches."""
    return ex.extract_post_rows(_pages(spark, sf))


@b.memo
def posts_table(spark, sf):
    return ex.posts_of(post_rows_table(spark, sf))


@b.memo
def files_table(spark, sf):
    return ex.files_of(post_rows_table(spark, sf))


@b.memo
@b.derived("threads", ("conversations", "documents"))
def threads_table(spark, sf):
    return ex.extract_threads(_pages(spark, sf))


@register("scan_pages")
def q_scan_pages(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", "url", F.octet_length("html").cast("bigint").alias("n_bytes"),
                    tf.is_thread_url(F.col("url")).alias("is_thread_url"))


@register("extract_threads")
def q_extract_threads(spark, sf):
    return ex.extract_threads(_pages(spark, sf))


@register("extract_posts")
def q_extract_posts(spark, sf):
    return _posts(spark, sf).withColumn("quotes", F.array_join("quotes", ","))


@register("extract_files")
def q_extract_files(spark, sf):
    return _files(spark, sf).drop("page_id", "pos")


@register("extract_quotes")
def q_extract_quotes(spark, sf):
    return ex.quote_edges(_posts(spark, sf))


@register("html_text")
def q_html_text(spark, sf):
    return _posts(spark, sf).select("post_nr", "post_msg")


@register("posts_with_files")
def q_posts_with_files(spark, sf):
    return ex.files_of(post_rows_table(spark, sf)).select("thread_nr", "post_nr", "file_key")


@register("extract_requests")
def q_extract_requests(spark, sf):
    return ex.extract_requests(b.thread_pages_table(spark, sf, "decorated")).drop("page_id")


@register("backlinks")
def q_backlinks(spark, sf):
    p = posts_table(spark, sf)
    return g.backlinks(p, ex.quote_edges(p))


@register("dangling_quotes")
def q_dangling_quotes(spark, sf):
    p = posts_table(spark, sf)
    return g.dangling_quotes(p, ex.quote_edges(p))


def _graph(spark, sf):
    p = posts_table(spark, sf)
    f = files_table(spark, sf)
    return p, g.backlinks(p, ex.quote_edges(p)), f


@register("reply_tree")
def q_reply_tree(spark, sf):
    p, links, f = _graph(spark, sf)
    return g.reply_tree(p, links, f, f.select("thread_nr", "post_nr"), max_level=3)


@register("relevant_replies")
def q_relevant_replies(spark, sf):
    p, links, f = _graph(spark, sf)
    return g.relevant_replies(p, links, f.select("thread_nr", "post_nr"))


@register("thread_report")
def q_thread_report(spark, sf):
    p, links, f = _graph(spark, sf)
    t = (threads_table(spark, sf).drop("page_id")
         .join(b.threads(spark, sf).select("thread_nr", "folder_name"), "thread_nr")
         .join(f.select("thread_nr"), "thread_nr", "left_semi"))
    fetched = f.select("thread_nr", "post_nr", "pos", "file_ext", "file_size", "file_res", "file_md5_b64",
                       "file_name_orig",
                       F.concat_ws("_", "file_name_4ch", "file_name_orig").alias("dl_filename"))
    return rp.thread_report(t, fetched, p, links, f, max_level=3)


@register("report_text")
def q_report_text(spark, sf):
    """The reports appended as text below folder and date, and read back."""
    import uuid

    from threadlake.sources.materialize import table_path

    path = table_path(spark, f"reports-{uuid.uuid4().hex}", sf)
    rp.write_reports(q_thread_report(spark, sf), path, "2024-01-01", rp.ranges_for(threads_table(spark, sf)))
    return rp.read_reports(spark, path).select("folder", F.col("value").alias("line"))


@register("file_rejects")
def q_file_rejects(spark, sf):
    """Live file blocks that do not parse (the tool crashes on them)."""
    return ex.file_rejects(_pages(spark, sf)).drop("page_id")


@register("page_rejects")
def q_page_rejects(spark, sf):
    """The crawl table through the extractor: pages without thread markup are rejects."""
    return ex.page_rejects(read_table(spark, sf, "pages"))
