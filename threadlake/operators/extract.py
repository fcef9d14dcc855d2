"""Thread pages -> threads, posts, files, quote edges.

One pass over ``pages(page_id, url, html)``: the opening-post fields are read on the page
row, the thread block is split on post containers and ``posexplode``d (``pos`` keeps
document order), and every field is a native regex expression. Nothing is collected;
a page is one row and its posts become rows of the same task. Rows that cannot be
parsed go to a rejects DataFrame ``(page_id, post_nr, reason)`` instead of failing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import (
    basename, file_key, file_text_parts, html_text, strip_ext,
)
from threadlake.functions.text import PY_FLAGS, unescape

# Markup anchors of the site's thread page.
CONTAINER = '<div class="postContainer'
THREAD_BLOCK = r'(?s)<div class="thread"[^>]*>(.*)'
THREAD_ID = r'<div class="thread" id="t([^"]*)"'
OP_BLOCK = r'(?s)<div class="post op"[^>]*>(.*?)</blockquote>'
SUBJECT = r'<span class="subject">(.*?)</span>'
POST_NUM = r'<span class="postNum desktop"><a [^>]*>[^<]*</a><a [^>]*>([^<]*)</a>'
DATE_UTC = r'<span class="dateTime" data-utc="([^"]*)"'
MESSAGE = r'(?s)<blockquote class="postMessage"[^>]*>(.*?)</blockquote>'
QUOTE_LINK = r'<a (?=[^>]*class="quotelink")[^>]*href="#p([^"]*)"'
FILE_DIV = r'<div class="file"'
FILE_TEXT = r'(?s)<div class="fileText"([^>]*)>(.*?)</div>'
LINK = r'(?s)<a ([^>]*)>(.*?)</a>'
THUMB_IMG = r'<a class="fileThumb(?: [^"]*)?"[^>]*><img ([^>]*)>'
FILE_INFO = r'(?s)<span class="file-info">(.*?)</span>'
# Decorated page file line: "File: name.ext (Spoiler, 2.8 MB, 1280x720)".
REQUEST_LINE = PY_FLAGS + r"^(?:File: )?(.+) \((?:Spoiler, )?([\d\.]+ [KMB]+),"


def _attr(attrs, name: str):
    """Attribute value (unescaped) or NULL when absent."""
    pat = f'(?:^|\\s){name}="([^"]*)"'
    return F.when(attrs.rlike(pat), unescape(F.regexp_extract(attrs, pat, 1)))


def inner_text(fragment):
    """Text of a fragment with tags removed and nothing inserted (bs4 ``.text``)."""
    return unescape(F.regexp_replace(fragment, r"<[^>]*>", ""))


# Positions of a page's containers when a long thread is split over pages (``page_no``
# column): more than one page's text can hold, so pages never overlap.
PAGE_POSITIONS = 1 << 31


def parse_containers(pages: DataFrame) -> DataFrame:
    """One row per post container: page_id, thread_nr, pos, post_nr, utc, raw fragment.

    The thread number is the opening post's number, or the thread block's id on a
    continuation page; with a ``page_no`` column, ``pos`` orders posts over pages of any
    size (it has gaps between pages; the first page counts from 0).
    """
    op = F.regexp_extract(F.col("html"), OP_BLOCK, 0)
    thread_nr = F.coalesce(F.nullif(F.regexp_extract(op, POST_NUM, 1), F.lit("")),
                           F.regexp_extract(F.col("html"), THREAD_ID, 1))
    offset = (F.col("page_no").cast("bigint") * PAGE_POSITIONS) if "page_no" in pages.columns else F.lit(0)
    page = pages.select(
        "page_id", thread_nr.alias("thread_nr"), offset.alias("_off"),
        F.split(F.regexp_extract(F.col("html"), THREAD_BLOCK, 1), CONTAINER).alias("parts"),
    )
    x = page.select("page_id", "thread_nr", "_off", F.posexplode("parts").alias("idx", "frag")).where(F.col("idx") > 0)
    return x.select(
        "page_id", "thread_nr", (F.col("_off") + F.col("idx") - 1).cast("bigint").alias("pos"),
        F.regexp_extract("frag", POST_NUM, 1).alias("post_nr"),
        F.regexp_extract("frag", DATE_UTC, 1).alias("utc"),
        "frag",
    )


def extract_threads(pages: DataFrame) -> DataFrame:
    """``(page_id, thread_nr, subject, utc, op_post_msg)`` from the opening post."""
    op = F.regexp_extract(F.col("html"), OP_BLOCK, 0)
    msg = F.regexp_extract(F.concat(op, F.lit("</blockquote>")), MESSAGE, 1)
    return pages.select(
        "page_id",
        F.regexp_extract(op, POST_NUM, 1).alias("thread_nr"),
        inner_text(F.regexp_extract(op, SUBJECT, 1)).alias("subject"),
        F.regexp_extract(op, DATE_UTC, 1).alias("utc"),
        html_text(msg).alias("op_post_msg"),
    ).where(F.col("thread_nr") != "")


def extract_posts(pages: DataFrame) -> DataFrame:
    """Posts in document order with message text and in-thread quotes."""
    c = parse_containers(pages)
    msg_html = F.regexp_extract("frag", MESSAGE, 1)
    return c.select(
        "page_id", "thread_nr", "post_nr", "pos", "utc",
        html_text(msg_html).alias("post_msg"),
        F.regexp_extract_all(msg_html, F.lit(QUOTE_LINK), 1).alias("quotes"),
        F.col("frag").contains(FILE_DIV).alias("has_file_block"),
    )


def quote_edges(posts: DataFrame) -> DataFrame:
    """One row per quote ``(thread_nr, post_nr, pos, quote_pos, quoted_nr)``; order and
    duplicates kept."""
    return posts.select("thread_nr", "post_nr", "pos", F.posexplode("quotes").alias("quote_pos", "quoted_nr")) \
        .withColumn("quote_pos", F.col("quote_pos").cast("int"))


FILE_FIELDS = ("present", "file_url", "file_name_4ch", "file_ext", "one_dot", "file_name_orig", "file_size",
               "file_res", "file_thumb_url", "file_md5_b64", "file_key")


def _file_columns():
    """File-block fields of a container fragment ``frag`` (see ``FILE_FIELDS``)."""
    ft = F.regexp_extract("frag", FILE_TEXT, 0)
    div_attrs = F.regexp_extract("frag", FILE_TEXT, 1)
    inner = F.regexp_extract("frag", FILE_TEXT, 2)
    a_attrs = F.regexp_extract(inner, LINK, 1)
    a_text = inner_text(F.regexp_extract(inner, LINK, 2))
    href = _attr(a_attrs, "href")
    fname = basename(href)
    img = F.regexp_extract("frag", THUMB_IMG, 1)
    orig0 = strip_ext(F.coalesce(_attr(a_attrs, "title"), a_text))
    spoiler = ~orig0.contains(".") & orig0.contains("Spoiler")
    orig = F.when(spoiler, F.coalesce(_attr(div_attrs, "title"), orig0)).otherwise(orig0)
    size, res = file_text_parts(inner_text(inner))
    url = F.concat(F.lit("https:"), href)
    return [
        (ft != "").alias("present"),
        url.alias("file_url"),
        F.regexp_extract(fname, r"^([^.]*)\.([^.]*)$", 1).alias("file_name_4ch"),
        F.regexp_extract(fname, r"^([^.]*)\.([^.]*)$", 2).alias("file_ext"),
        fname.rlike(r"^[^.]*\.[^.]*$").alias("one_dot"),
        orig.alias("file_name_orig"),
        size.alias("file_size"),
        res.alias("file_res"),
        F.concat(F.lit("https:"), _attr(img, "src")).alias("file_thumb_url"),
        _attr(img, "data-md5").alias("file_md5_b64"),
        file_key(url).alias("file_key"),
    ]


def _file_fields(pages: DataFrame) -> DataFrame:
    c = parse_containers(pages).where(F.col("frag").contains(FILE_DIV))
    return c.select("page_id", "thread_nr", "post_nr", "pos", *_file_columns())


def extract_post_rows(pages: DataFrame) -> DataFrame:
    """One pass over the pages: every post with its message fields and, when it has a file
    block, the file fields (NULL otherwise). ``posts_of`` / ``files_of`` / ``rejects_of``
    project it, so a crawl is parsed once however many tables are derived from it."""
    c = parse_containers(pages)
    msg_html = F.regexp_extract("frag", MESSAGE, 1)
    has_block = F.col("frag").contains(FILE_DIV)
    return c.select(
        "page_id", "thread_nr", "post_nr", "pos", "utc",
        html_text(msg_html).alias("post_msg"),
        F.regexp_extract_all(msg_html, F.lit(QUOTE_LINK), 1).alias("quotes"),
        has_block.alias("has_file_block"),
        *[F.when(has_block, col).alias(name) for name, col in zip(FILE_FIELDS, _file_columns())],
    )


def posts_of(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "thread_nr", "post_nr", "pos", "utc", "post_msg", "quotes", "has_file_block")


def files_of(rows: DataFrame) -> DataFrame:
    """Live, parseable files (see ``extract_files``) from ``extract_post_rows`` output."""
    return _live_files(rows.where("has_file_block"))


def _live_files(f: DataFrame) -> DataFrame:
    ok = F.col("present") & F.col("one_dot") & F.col("file_size").isNotNull()
    return f.where(ok).select(
        "page_id", "thread_nr", "post_nr", "pos", "file_key", "file_url", "file_name_4ch", "file_ext",
        "file_name_orig", "file_size", "file_res", "file_thumb_url", "file_md5_b64",
        F.lit(False).alias("to_download"), F.lit(False).alias("downloaded"))


def extract_files(pages: DataFrame) -> DataFrame:
    """File rows of posts with a live file (deleted files have no row)."""
    f = _file_fields(pages)
    ok = F.col("present") & F.col("one_dot") & F.col("file_size").isNotNull()
    return f.where(ok).select(
        "page_id", "thread_nr", "post_nr", "pos", "file_key", "file_url", "file_name_4ch", "file_ext",
        "file_name_orig", "file_size", "file_res", "file_thumb_url", "file_md5_b64",
        F.lit(False).alias("to_download"), F.lit(False).alias("downloaded"))


def file_rejects(pages: DataFrame) -> DataFrame:
    """Live file blocks that do not parse (e.g. a PDF line without ``WxH``)."""
    f = _file_fields(pages).where(F.col("present"))
    reason = (F.when(~F.col("one_dot"), F.lit("file_name_not_one_dot"))
              .when(F.col("file_size").isNull(), F.lit("file_line_unparsed")))
    return f.select("page_id", "thread_nr", "post_nr", reason.alias("reason")).where(F.col("reason").isNotNull())


def page_rejects(pages: DataFrame) -> DataFrame:
    """Pages that hold no thread: no thread block, or neither an opening post nor a
    thread id to take the thread number from. ``(page_id, url, reason)``."""
    html = F.col("html")
    has_block = html.contains('<div class="thread"')
    has_nr = html.rlike(OP_BLOCK) | (F.regexp_extract(html, THREAD_ID, 1) != "")
    reason = (F.when(html.isNull() | ~has_block, F.lit("no_thread_block"))
              .when(~has_nr, F.lit("no_thread_number")))
    return pages.select("page_id", "url", reason.alias("reason")).where(F.col("reason").isNotNull())


def extract_requests(pages: DataFrame) -> DataFrame:
    """``(page_id, file_id, name, size_text, md5_b64)`` from decorated pages;
    deleted files (no ``file-info``) are skipped."""
    c = parse_containers(pages).where(F.col("frag").rlike(FILE_INFO))
    line = inner_text(F.regexp_extract("frag", FILE_INFO, 1))
    img = F.regexp_extract("frag", THUMB_IMG, 1)
    return c.where(line.rlike(REQUEST_LINE)).select(
        "page_id",
        F.concat(F.lit("f"), F.col("post_nr")).alias("file_id"),
        F.regexp_extract(line, REQUEST_LINE, 1).alias("name"),
        F.regexp_extract(line, REQUEST_LINE, 2).alias("size_text"),
        _attr(img, "data-md5").alias("md5_b64"),
    )
