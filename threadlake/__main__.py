"""Command-line jobs: the archive tool's verbs as batch/stream Spark jobs.

  python -m threadlake extract   --pages PAGES --out OUT              (pages -> tables)
  python -m threadlake report    --tables OUT --folders F --date D --out DIR   (report text)
  python -m threadlake resume    --prior P --new N --out OUT          (selection of a resumed run)
  python -m threadlake gen-info  --root MEDIA_DIR --index OUT        (scan -> index snapshot)
  python -m threadlake lookup    --index IDX --pages PAGES --out OUT (page files: new or where)
  python -m threadlake fold      --events EV --sessions S --files F --out OUT   (curation log)
  python -m threadlake watch     --events DIR --sessions S --files F --out OUT --checkpoint CK
  python -m threadlake quarantine --manifest M --decisions D --out OUT

Inputs and outputs are Parquet folders (the manifest is text). The session comes from
``spark-submit``; ``--master`` only matters for local runs.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _spark(master: str | None) -> SparkSession:
    from threadlake.session import DEFAULT_CONF, ensure_checkpoint_dir

    b = SparkSession.builder.appName("threadlake")
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def gen_info(spark, a) -> None:
    """``--scan``: a table of what the last run found; only new and changed files are digested."""
    from threadlake.operators.index import build_index
    from threadlake.sources.index_store import save_index
    from threadlake.sources.media import SCAN_DDL, list_media, scan_changes, scan_media
    from threadlake.sources.versions import VersionedTable

    if not getattr(a, "scan", None):
        save_index(build_index(scan_media(spark, a.root, listing=list_media(spark, a.root))), a.index)
        return
    table = VersionedTable(spark, a.scan, SCAN_DDL)
    since = table.latest()
    scan, _ = scan_changes(spark, a.root, table.read(since))
    now = table.replace(scan, since)
    save_index(build_index(table.read(now)), a.index)


def extract(spark, a) -> None:
    """Saved pages -> ``threads``, ``posts``, ``files`` and ``rejects`` below ``--out``."""
    from threadlake.operators import extract as ex
    from threadlake.sources.tables import read_pages

    pages = read_pages(spark, a.pages)
    ex.extract_threads(pages).write.mode("overwrite").parquet(f"{a.out}/threads")
    ex.extract_post_rows(pages).write.mode("overwrite").parquet(f"{a.out}/post_rows")
    rows = spark.read.parquet(f"{a.out}/post_rows")
    ex.posts_of(rows).write.mode("overwrite").parquet(f"{a.out}/posts")
    ex.files_of(rows).write.mode("overwrite").parquet(f"{a.out}/files")
    ex.page_rejects(pages).write.mode("overwrite").parquet(f"{a.out}/page_rejects")
    ex.file_rejects(pages).write.mode("overwrite").parquet(f"{a.out}/file_rejects")


def report(spark, a) -> None:
    """Extracted tables -> report text. ``--folders(thread_nr, folder_name)``; every file of a
    thread in it is reported under its stored name ``<server>_<original>``."""
    from threadlake.operators import graph as g
    from threadlake.operators import report as rp
    from threadlake.operators.extract import quote_edges

    posts, files = spark.read.parquet(f"{a.tables}/posts"), spark.read.parquet(f"{a.tables}/files")
    threads = spark.read.parquet(f"{a.tables}/threads").join(
        spark.read.parquet(a.folders).select("thread_nr", "folder_name"), "thread_nr")
    fetched = files.withColumn("dl_filename", F.concat_ws("_", "file_name_4ch", "file_name_orig"))
    lines = rp.thread_report(threads, fetched, posts, g.backlinks(posts, quote_edges(posts)), files)
    rp.write_reports(lines, a.out, a.date)


def resume(spark, a) -> None:
    """The prior selection united with the resumed session's (``--prior``, ``--new``: outputs of
    ``fold``)."""
    from threadlake.operators.curation import resume_selection

    resume_selection(spark.read.parquet(a.prior), spark.read.parquet(a.new)).write.mode("overwrite").parquet(a.out)


def lookup(spark, a) -> None:
    from threadlake import functions as tf
    from threadlake.operators.extract import extract_requests
    from threadlake.operators.index import lookup_duplicates
    from threadlake.sources.index_store import load_index
    from threadlake.sources.tables import read_pages

    req = extract_requests(read_pages(spark, a.pages))
    _, ext = tf.split_name_ext(F.trim(F.col("name")))
    cand = req.select("page_id", "file_id", ext.alias("ext"), tf.size_text_mb(F.col("size_text")).alias("size_mb"),
                      "md5_b64")
    lookup_duplicates(cand, load_index(spark, a.index)).write.mode("overwrite").parquet(a.out)


def fold(spark, a) -> None:
    from threadlake.operators.curation import fold_curation

    ev = spark.read.parquet(a.events)
    fold_curation(ev, spark.read.parquet(a.sessions), spark.read.parquet(a.files)) \
        .write.mode("overwrite").parquet(a.out)


def watch(spark, a) -> None:
    from threadlake.streaming.curation import run_curation_stream

    res = run_curation_stream(spark, a.events, spark.read.parquet(a.sessions), spark.read.parquet(a.files),
                              f"{a.out}/updates", a.checkpoint)
    res.write.mode("overwrite").parquet(f"{a.out}/selection")


def quarantine(spark, a) -> None:
    """``--manifest``: a manifest, a folder or a pattern of them; each comes back on its own. The
    decisions may name the manifest (``file``: its name or path below ``--manifest``)."""
    from threadlake.operators.manifest import apply_quarantine, read_manifest_lines, write_manifests
    from threadlake.sources.paths import root_path

    m, decisions = read_manifest_lines(spark, a.manifest), spark.read.parquet(a.decisions)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    root = root_path(spark, a.manifest).rstrip("/") + "/"
    m = m.withColumn("file", F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(F.regexp_extract(path, "[^/]*$", 0)))
    patched, kept, to_delete = apply_quarantine(m, decisions)
    write_manifests(patched, f"{a.out}/manifest")
    kept.select(F.col("line").alias("value")).write.mode("append").text(f"{a.out}/kept")
    to_delete.write.mode("overwrite").parquet(f"{a.out}/to_delete")


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="threadlake")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("gen-info"); s.add_argument("--root", required=True); s.add_argument("--index", required=True); s.add_argument("--scan")
    for cmd, opts in (("extract", ("--pages", "--out")), ("report", ("--tables", "--folders", "--date", "--out")),
                      ("resume", ("--prior", "--new", "--out"))):
        s = sub.add_parser(cmd)
        for opt in opts:
            s.add_argument(opt, required=True)
    s = sub.add_parser("lookup")
    for opt in ("--index", "--pages", "--out"):
        s.add_argument(opt, required=True)
    s = sub.add_parser("fold")
    for opt in ("--events", "--sessions", "--files", "--out"):
        s.add_argument(opt, required=True)
    s = sub.add_parser("watch")
    for opt in ("--events", "--sessions", "--files", "--out", "--checkpoint"):
        s.add_argument(opt, required=True)
    s = sub.add_parser("quarantine")
    for opt in ("--manifest", "--decisions", "--out"):
        s.add_argument(opt, required=True)
    a = p.parse_args(argv)
    spark = _spark(a.master)
    {"extract": extract, "report": report, "resume": resume, "gen-info": gen_info, "lookup": lookup, "fold": fold, "watch": watch, "quarantine": quarantine}[a.cmd](spark, a)


if __name__ == "__main__":
    main()
