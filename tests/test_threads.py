"""Thread pages: render -> extract round trip, reply trees vs a recursive walk, report layout, sinks."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from threadlake.operators import extract as ex
from threadlake.operators import graph as g
from threadlake.operators import report as rp
from threadlake.plans import bindings as b


def test_extract_round_trip(spark):
    pages = b.thread_pages(spark, SF_SMALL)
    posts = ex.extract_posts(pages).select("thread_nr", "post_nr", "pos", "utc", "post_msg", "quotes")
    src = b.posts(spark, SF_SMALL).select("thread_nr", "post_nr", "pos", "utc", "post_msg", "quotes")
    assert posts.exceptAll(src).count() == 0 and src.exceptAll(posts).count() == 0
    threads = ex.extract_threads(pages).select("thread_nr", "subject", "utc", "op_post_msg")
    want = b.threads(spark, SF_SMALL).select("thread_nr", "subject", "utc", "op_post_msg")
    assert threads.exceptAll(want).count() == 0 and want.exceptAll(threads).count() == 0
    # Live, parseable files only: deleted files have no row, PDFs are rejects.
    pf = b.post_files(spark, SF_SMALL)
    files = ex.extract_files(pages)
    assert files.count() == pf.where(~F.col("deleted") & (F.col("ext") != "pdf")).count()
    rej = ex.file_rejects(pages)
    assert rej.count() == pf.where(~F.col("deleted") & (F.col("ext") == "pdf")).count()


def _thread(spark):
    # p1 (file) <- p2 ">>p1 text", p3 (empty, file) quotes p1, p4 quotes p3 and p2, p5 (empty, no file)
    # quotes p2, p6 quotes p5, p7 quotes p6 (level 4, beyond the bound), p8 quotes a missing post.
    posts = [("t", "1", 0, "op text\nsecond line", ["9"]), ("t", "2", 1, ">>1\nreply", ["1"]),
             ("t", "3", 2, "", ["1"]), ("t", "4", 3, ">>3\n>>2\nboth", ["3", "2"]),
             ("t", "5", 4, "", ["2"]), ("t", "6", 5, "six", ["5"]), ("t", "7", 6, "seven", ["6"]),
             ("t", "8", 7, "missing", ["99"])]
    p = spark.createDataFrame(posts, "thread_nr STRING, post_nr STRING, pos INT, post_msg STRING, quotes ARRAY<STRING>")
    files = spark.createDataFrame([("t", "1"), ("t", "3")], "thread_nr STRING, post_nr STRING")
    return p, files


def test_reply_tree_and_report_layout(spark):
    p, files = _thread(spark)
    edges = ex.quote_edges(p)
    links = g.backlinks(p, edges)
    assert [r.quoted_nr for r in g.dangling_quotes(p, edges).collect()] == sorted(["9", "99"])
    # Reply 2 with its replies 4 and (through the empty 5) 6; the empty 3 has a file of its own.
    expected = [
        "       __________", ">      >>1", ">      reply",
        "            __________", ">           >>3", ">           >>2", ">           both",
        "                 __________", ">                six",
    ]
    threads = spark.createDataFrame([("t", "Subj", "123", "op text\nsecond line", "gif_x")],
                                    "thread_nr STRING, subject STRING, utc STRING, op_post_msg STRING, folder_name STRING")
    fetched = spark.createDataFrame([("t", "1", 0, "111_orig", "jpg", "100 KB", "620x465", "E2nKKDmi/IwbuxHgn4hWff==", "orig")],
                                    "thread_nr STRING, post_nr STRING, pos INT, dl_filename STRING, file_ext STRING, "
                                    "file_size STRING, file_res STRING, file_md5_b64 STRING, file_name_orig STRING")
    lines = rp.thread_report(threads, fetched, p, links, files)
    text = "\n".join(r.line for r in lines.orderBy("key").collect())
    want = "\n".join([
        'Thread No. t: "Subj", UTC_123\n\tSaved to: gif_x\nOP: "op text\nsecond line"\n',
        'File: "111_orig.jpg", 100 KB, 620x465, MD5_b64: "E2nKKDmi/IwbuxHgn4hWff==", Original filename: "orig"\n'
        "Messages and Backlinks (indented):",
        "\n".join(["op text\nsecond line"] + expected),
        "\n"])
    assert text == want
    # The bound: post 7 sits at level 4 below post 1 and is never shown.
    assert "seven" not in text and "six" in text


def test_write_reports_sink(spark, tmp_path):
    p, files = _thread(spark)
    links = g.backlinks(p, ex.quote_edges(p))
    threads = spark.createDataFrame([("t", "S", "1", "op", "gif_x")],
                                    "thread_nr STRING, subject STRING, utc STRING, op_post_msg STRING, folder_name STRING")
    fetched = spark.createDataFrame([("t", "1", 0, "n", "jpg", "1 KB", "1x1", "x", "o")],
                                    "thread_nr STRING, post_nr STRING, pos INT, dl_filename STRING, file_ext STRING, "
                                    "file_size STRING, file_res STRING, file_md5_b64 STRING, file_name_orig STRING")
    lines = rp.thread_report(threads, fetched, p, links, files)
    rp.write_reports(lines, str(tmp_path / "reports"), "2018-03-18", n_ranges=3)
    parts = sorted((tmp_path / "reports" / "folder=gif_x" / "run_date=2018-03-18").glob("part-*"))
    written = "".join(x.read_text() for x in parts)
    assert written == "".join(r.line + "\n" for r in lines.orderBy("key").collect())


def test_reports_are_dealt_by_their_number(spark, monkeypatch):
    from threadlake.plans import q_threads

    used, write = [], rp.write_reports

    def wrapped(lines, out_dir, run_date, n_ranges=None):
        used.append(n_ranges)
        write(lines, out_dir, run_date, n_ranges)
    monkeypatch.setattr(rp, "write_reports", wrapped)
    monkeypatch.setattr(rp, "REPORTS_PER_RANGE", 10)
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    got = q_threads.q_report_text(spark, SF_SMALL)
    assert used == [-(-q_threads.threads_table(spark, SF_SMALL).count() // 10)] and used[0] > 1
    assert spark.conf.get(listing) == before
    want = q_threads.q_thread_report(spark, SF_SMALL).selectExpr("folder_name AS folder", "explode(split(line, '\\n')) AS line")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_index_snapshots_round_trip(spark, tmp_path):
    from threadlake.operators import index as ix
    from threadlake.sources import index_store as st

    idx = ix.build_index(b.index_media(spark, SF_SMALL))
    st.save_index(idx, str(tmp_path / "pq"))
    back = st.load_index(spark, str(tmp_path / "pq"))
    assert back.exceptAll(idx).count() == 0 and idx.exceptAll(back).count() == 0
    st.save_index_json(idx, str(tmp_path / "js"))
    back = st.load_index_json(spark, str(tmp_path / "js"))
    assert back.exceptAll(idx).count() == 0 and idx.exceptAll(back).count() == 0


def test_scan_media_prunes_and_filters(spark, tmp_path):
    import base64
    import hashlib

    from threadlake.sources.media import scan_media

    (tmp_path / "a").mkdir()
    (tmp_path / "x_files").mkdir()
    (tmp_path / "a" / "1.jpg").write_bytes(b"one")
    (tmp_path / "a" / "2.JPG").write_bytes(b"two")
    (tmp_path / "a" / "noext").write_bytes(b"three")
    (tmp_path / "x_files" / "3.png").write_bytes(b"four")
    got = {r.path: (r.ext, r.size_bytes, r.md5_b64) for r in scan_media(spark, str(tmp_path)).collect()}
    assert got == {"a/1.jpg": ("jpg", 3, base64.b64encode(hashlib.md5(b"one").digest()).decode())}


def test_one_pass_rows_equal_separate_extraction(spark):
    pages = b.thread_pages(spark, SF_SMALL)
    rows = ex.extract_post_rows(pages)
    for a, c in ((ex.posts_of(rows), ex.extract_posts(pages)), (ex.files_of(rows), ex.extract_files(pages))):
        assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0
