"""Edge rows every suite should hold (cross-thread and self quotes, repeated quotes,
attribute order, trailing newlines, odd file names, size texts, copies in one batch)."""

from decimal import Decimal

from pyspark.sql import functions as F

from threadlake.operators import extract as ex
from threadlake.operators import graph as g
from threadlake.operators import index as ix


def _post(nr, msg_html, file_html="", op=False):
    kind = "opContainer" if op else "replyContainer"
    cls = "op" if op else "reply"
    subj = '<span class="subject">Edge &amp; cases</span> ' if op else ""
    return (f'<div class="postContainer {kind}" id="pc{nr}"><div class="post {cls}" id="p{nr}">'
            f'<div class="postInfo desktop" id="pi{nr}">{subj}<span class="dateTime" data-utc="17{nr}">x</span> '
            f'<span class="postNum desktop"><a href="#p{nr}" title="Link to this post">No.</a>'
            f'<a href="javascript:quote(\'{nr}\');" title="Reply to this post">{nr}</a></span></div>'
            f'{file_html}<blockquote class="postMessage" id="m{nr}">{msg_html}</blockquote></div></div>')


def _file(nr, href, link_text, size="128 KB", res="620x465", title=None, div_title=None):
    t = f' title="{title}"' if title else ""
    dt = f' title="{div_title}"' if div_title else ""
    thumb_cls = "fileThumb imgspoiler" if div_title else "fileThumb"
    return (f'<div class="file" id="f{nr}"><div class="fileText" id="fT{nr}"{dt}>File: '
            f'<a href="{href}" target="_blank"{t}>{link_text}</a> ({size}, {res})</div>'
            f'<a class="{thumb_cls}" href="{href}" target="_blank"><img src="//i.4cdn.org/g/{nr}s.jpg" '
            f'alt="{size}" data-md5="gUkUw0o1n7cI+w0x8LWj2w==" style="height: 1px;"></a></div>')


def test_page_edge_rows(spark):
    posts = [
        _post("1", "op line<br>", _file("1", "//i.4cdn.org/g/111.jpg", "a.b.c.jpg"), op=True),
        # cross-thread quote (dropped), quote of itself, the same quote twice, other attribute order
        _post("2", '<a href="/g/thread/9#p9" class="quotelink">&gt;&gt;9</a><br>'
                   '<a href="#p2" class="quotelink">&gt;&gt;2</a><br>'
                   '<a class="quotelink" href="#p1">&gt;&gt;1</a> <a href="#p1" class="quotelink">&gt;&gt;1</a>'),
        # spoilered file: the original name (with its extension) comes from the file line title
        _post("3", "", _file("3", "//i.4cdn.org/g/333.png", "Spoiler Image", div_title="secret.png")),
        # PDF: the file line has no WxH -> reject; a deleted file -> no row
        _post("4", "pdf", _file("4", "//i.4cdn.org/g/444.pdf", "doc.pdf", size="12 KB", res="PDF")),
        _post("5", "gone", '<div class="file" id="f5"><span class="fileThumb"><img alt="File deleted."></span></div>'),
        # server name with two dots -> reject; long name in the title
        _post("6", "x", _file("6", "//i.4cdn.org/g/6.6.jpg", "z.jpg")),
        _post("7", "long", _file("7", "//i.4cdn.org/g/777.webm", "long(...).webm", size="2.8 MB",
                                 title="a very long original name.webm")),
    ]
    html = '<html><body><div class="thread" id="t1">' + "".join(posts) + "</div></body></html>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id BIGINT, url STRING, html STRING")
    th = ex.extract_threads(pages).collect()[0]
    assert (th.thread_nr, th.subject, th.utc, th.op_post_msg) == ("1", "Edge & cases", "171", "op line")
    p = {r.post_nr: r for r in ex.extract_posts(pages).collect()}
    assert p["2"].quotes == ["2", "1", "1"] and p["2"].post_msg == ">>9\n>>2\n>>1\n \n>>1"
    assert p["3"].post_msg == "" and [p[k].pos for k in "1234567"] == list(range(7))
    f = {r.post_nr: r for r in ex.extract_files(pages).collect()}
    assert sorted(f) == ["1", "3", "7"]
    assert (f["1"].file_name_orig, f["1"].file_ext, f["1"].file_key) == ("a.b.c", "jpg", "g/111.jpg")
    assert f["3"].file_name_orig == "secret.png" and f["3"].file_md5_b64 == "gUkUw0o1n7cI+w0x8LWj2w=="
    assert (f["7"].file_name_orig, f["7"].file_size) == ("a very long original name", "2.8 MB")
    rej = {r.post_nr: r.reason for r in ex.file_rejects(pages).collect()}
    assert rej == {"4": "file_line_unparsed", "6": "file_name_not_one_dot"}
    edges = ex.quote_edges(ex.extract_posts(pages))
    posts_df = ex.extract_posts(pages)
    links = g.backlinks(posts_df, edges)
    assert sorted((r.post_nr, r.backlink_nr, r.quote_pos) for r in links.collect()) == \
        [("1", "2", 1), ("1", "2", 2), ("2", "2", 0)]
    # A post quoting itself: the walk stops at the depth bound.
    files = ex.extract_files(pages)
    tree = g.reply_tree(posts_df, links, files, posts_df.where("post_nr = '2'").select("thread_nr", "post_nr"))
    assert sorted(r.level for r in tree.collect()) == [1, 2, 3]


def test_copies_in_one_batch_both_stay(spark):
    idx = spark.createDataFrame([("jpg", Decimal("0.12"), "AAA", "a/1.jpg")],
                                "ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING, path STRING")
    cand = spark.createDataFrame([(1, "jpg", Decimal("0.12"), "BBB"), (2, "jpg", Decimal("0.12"), "BBB"),
                                  (3, "JPG", Decimal("0.12"), "AAA"), (4, "jpg", Decimal("0.12"), "AAA")],
                                 "cand_id INT, ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING")
    got = {r.cand_id: (r.is_new, r.n_copies, r.first_path) for r in ix.lookup_duplicates(cand, idx).collect()}
    assert got == {1: (True, 0, None), 2: (True, 0, None), 3: (True, 0, None), 4: (False, 1, "a/1.jpg")}
    by_md5 = {r.cand_id: r.is_new for r in ix.novel(cand, idx, match_on="md5").collect()}
    assert by_md5 == {1: True, 2: True, 3: False, 4: False}


def test_index_upsert_rejects_unknown_ext(spark):
    idx = spark.createDataFrame([], "ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING, path STRING")
    ver = spark.createDataFrame([("jpg", 134217, "A", "x\\y.jpg"), ("pdf", 5, "B", "x/z.pdf"),
                                 ("jpg", 134217, "A", "x/./y.jpg")],
                                "ext STRING, size_bytes BIGINT, md5_b64 STRING, path STRING")
    new, rej = ix.upsert_index(idx, ver)
    assert sorted((r.path, str(r.size_mb)) for r in new.collect()) == [("x/y.jpg", "0.13"), ("x/y.jpg", "0.13")]
    assert [r.reason for r in rej.collect()] == ["ext_not_allowed"]
    assert ix.bucket_stats(new).where(F.col("ext").isNull()).collect()[0].n_shared_buckets == 1


def test_cli_gen_info_and_quarantine(spark, tmp_path):
    from threadlake.__main__ import gen_info, quarantine
    from threadlake.sources.index_store import load_index

    (tmp_path / "m" / "d").mkdir(parents=True)
    (tmp_path / "m" / "d" / "1.jpg").write_bytes(b"x" * 10)
    (tmp_path / "m" / "d" / "2.gif").write_bytes(b"x" * 10)

    class A:
        root, index = str(tmp_path / "m"), str(tmp_path / "idx")
    gen_info(spark, A)
    assert sorted(r.path for r in load_index(spark, A.index).collect()) == ["d/1.jpg", "d/2.gif"]

    (tmp_path / "man.md5").write_text("aa *x/1.jpg\nbb *x/2.jpg\n")
    spark.createDataFrame([("aa", "x/1.jpg", True, "cc"), ("bb", "x/2.jpg", False, "dd")],
                          "md5_hex STRING, path STRING, keep BOOLEAN, actual_md5_hex STRING") \
        .write.parquet(str(tmp_path / "dec"))

    class Q:
        manifest, decisions, out = str(tmp_path / "man.md5"), str(tmp_path / "dec"), str(tmp_path / "q")
    quarantine(spark, Q)
    assert [r.value for r in spark.read.text(f"{Q.out}/manifest").collect()] == ["cc *x/1.jpg"]
    assert [r.value for r in spark.read.text(f"{Q.out}/kept").collect()] == ["aa *x/1.jpg"]


def test_read_pages_from_saved_files(spark, tmp_path):
    from threadlake.sources.tables import read_pages

    (tmp_path / "a.html").write_text('<div class="thread" id="t5"><div class="postContainer">x</div></div>')
    (tmp_path / "b.html").write_text("<html>no thread here</html>")
    pages = read_pages(spark, str(tmp_path), fmt="text")
    assert pages.count() == 2
    rej = [r.reason for r in ex.page_rejects(pages).collect()]
    assert rej == ["no_thread_block"]


def test_media_rows_rejects(spark):
    listing = spark.createDataFrame([("a\\\\b.jpg", 1, "A"), ("../up.jpg", 1, "B"), ("x_files/c.png", 1, "C"),
                                     ("d/e.JPG", 1, "D"), ("d/noext", 1, "E"), ("d/./f.gif", 1, "F")],
                                    "path STRING, size_bytes BIGINT, md5_b64 STRING")
    rows = ix.media_rows(listing)
    kept = sorted(r.path for r in ix.media_filter(rows).collect())
    assert kept == ["a/b.jpg", "d/f.gif"]
    rej = {r.path: r.reason for r in ix.media_rejects(rows).collect()}
    assert rej == {"../up.jpg": "parent_segment", "x_files/c.png": "pruned_dir", "d/e.JPG": "ext_not_allowed",
                   "d/noext": "no_ext"}


def test_cli_lookup_and_fold(spark, tmp_path):
    from conftest import SF_SMALL
    from threadlake.__main__ import fold, lookup
    from threadlake.operators.index import build_index
    from threadlake.plans import bindings as b
    from threadlake.plans.catalog import load_all
    from threadlake.sources.index_store import save_index

    qs = load_all()
    save_index(build_index(b.index_media(spark, SF_SMALL)), str(tmp_path / "idx"))
    b.thread_pages(spark, SF_SMALL, "decorated").write.parquet(str(tmp_path / "pages"))

    class L:
        index, pages, out = str(tmp_path / "idx"), str(tmp_path / "pages"), str(tmp_path / "lk")
    lookup(spark, L)
    got = spark.read.parquet(L.out).select("file_id", "n_copies", "is_new")
    want = qs["request_lookup"](spark, SF_SMALL).select("file_id", "n_copies", "is_new")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

    from threadlake.plans.q_curation import _thread_files
    b.curation_events(spark, SF_SMALL).write.parquet(str(tmp_path / "ev"))
    b.sessions(spark, SF_SMALL).write.parquet(str(tmp_path / "s"))
    _thread_files(spark, SF_SMALL).write.parquet(str(tmp_path / "f"))

    class Fo:
        events, sessions, files, out = (str(tmp_path / "ev"), str(tmp_path / "s"), str(tmp_path / "f"),
                                        str(tmp_path / "fold"))
    fold(spark, Fo)
    got = spark.read.parquet(Fo.out)
    want = qs["curation_fold"](spark, SF_SMALL)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_bucketed_index_lookup_skips_index_shuffle(spark, tmp_path):
    from conftest import SF_SMALL
    from threadlake.operators.index import build_index, lookup_duplicates
    from threadlake.plans import bindings as b
    from threadlake.sources.index_store import save_index_table

    idx = build_index(b.index_media(spark, SF_SMALL))
    save_index_table(idx, "tl_index_bucketed", buckets=8, path=str(tmp_path / "bucketed"))
    table = spark.table("tl_index_bucketed")
    cand = b.candidates(spark, SF_SMALL)
    res = lookup_duplicates(cand, table, co_located=True)
    want = lookup_duplicates(cand, idx)
    assert res.exceptAll(want).count() == 0 and want.exceptAll(res).count() == 0
    plan = res._jdf.queryExecution().executedPlan().toString()
    # Only the candidate side is shuffled.
    assert plan.count("Exchange hashpartitioning") == 1
    spark.sql("DROP TABLE tl_index_bucketed")


def test_cli_watch(spark, tmp_path):
    from threadlake.__main__ import watch

    spark.createDataFrame([(1, "t", False)], "session_id BIGINT, thread_nr STRING, unique_only BOOLEAN") \
        .write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([("t", "b/1.jpg", "1", "orig", None)],
                          "thread_nr STRING, file_key STRING, file_name_4ch STRING, file_name_orig STRING, "
                          "is_new BOOLEAN").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([(1, 1, "//is2.4chan.org/b/1.jpg"), (1, 2, "toggle_use_orig_fn"), (1, 3, "reset_filename")],
                          "session_id BIGINT, seq BIGINT, value STRING").coalesce(1).write.parquet(str(tmp_path / "ev"))

    class W:
        events, sessions, files = str(tmp_path / "ev"), str(tmp_path / "s"), str(tmp_path / "f")
        out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    watch(spark, W)
    row = spark.read.parquet(f"{W.out}/selection").collect()[0]
    assert (row.file_key, row.dl_filename, row.to_download) == ("b/1.jpg", "1_orig", True)


def test_markup_as_it_comes(spark):
    """Very long tag runs, all kinds of character references, odd line terminators in names."""
    from threadlake.functions import file_text_parts, html_text

    cases = {"a" + "<br>" * 100_000 + "b": "a\nb", "&nbsp;x&#39;&#8217;&apos;&#x1F600;": "\u00a0x'\u2019'\U0001F600",
             "&amp;lt; &lt;b&gt; &quot;&#039;": "&lt; <b> \"'", "&bogus; &#0; &#xD800; &": "&bogus; &#0; &#xD800; &",
             "x\ue000y<i>z</i>": "xy\nz", "": "", "no markup": "no markup"}
    df = spark.createDataFrame([(k,) for k in cases], "h STRING")
    got = {r.h: r.t for r in df.select("h", html_text(F.col("h")).alias("t")).collect()}
    assert got == cases
    lines = [f"File: na{c}me.jpg (128 KB, 620x465)" for c in ("\u0085", "\u2028", " ")]
    df = spark.createDataFrame([(x,) for x in lines], "t STRING")
    size, res = file_text_parts(F.col("t"))
    assert [tuple(r) for r in df.select(size, res).collect()] == [("128 KB", "620x465")] * 3


def test_paths_as_users_know_them(spark, tmp_path, monkeypatch):
    from threadlake.operators.manifest import read_manifest_tree
    from threadlake.sources.media import oversize_media, scan_media

    root = tmp_path / "x_files" / "me dia+%41"
    names = ["sub dir/sp ace.png", "a+b%20c.jpg", "\u00e9\u6f22.gif", "deep/er/1.webm"]
    for i, n in enumerate(names):
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(b"x" * (i + 1))
    (root / "sub dir" / "all.md5").write_text("aa *1.jpg\n\n")
    (root / "top.md5").write_text("bb *2.jpg\n")
    monkeypatch.chdir(tmp_path)
    for given in (str(root), f"file:{root}", str(root) + "/"):
        assert sorted(r.path for r in scan_media(spark, given).collect()) == sorted(names)
        assert sorted((r.rel_dir, r.value) for r in read_manifest_tree(spark, given).collect()) == [(".", "bb *2.jpg"), ("sub dir", "aa *1.jpg")]
    big = oversize_media(spark, str(root), limit=2).collect()
    assert sorted((r.path, r.size_bytes, r.reason) for r in big) == sorted((n, i + 1, "too_large") for i, n in enumerate(names) if i > 1)


def test_positions_of_any_size_sort(spark):
    from threadlake.operators.graph import path_segment

    rows = [(0, 0), (9, 5), (10, 3), (10, 123456), (10, 1234567), (99_999_999_999, 1), (100_000_000_000, 0)]
    df = spark.createDataFrame(rows, "p BIGINT, q BIGINT").select("*", path_segment(F.col("p"), F.col("q")).alias("k"))
    assert [(r.p, r.q) for r in sorted(df.collect(), key=lambda r: r.k)] == rows


def test_unknown_numbers_and_keys(spark):
    from threadlake.operators import index as ix
    from threadlake.operators.integrity import mark_short_reads

    log = spark.createDataFrame([(True, True, 5, None), (True, True, 4, 5), (True, True, 5, 5)], "dl_success BOOLEAN, md5_match BOOLEAN, bytes_received BIGINT, content_length BIGINT")
    assert [(r.dl_success, r.md5_match, r.short_read) for r in mark_short_reads(log).collect()] == [(True, True, False), (False, None, True), (True, True, False)]
    ddl = "ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING"
    cand = spark.createDataFrame([("jpg", None, "A")], ddl)
    index = spark.createDataFrame([("jpg", None, "A", "p")], ddl + ", path STRING")
    assert ix.novel(cand, index).first().is_new is None and ix.lookup_duplicates(cand, index).first().is_new is None


def test_hot_digest_is_split(spark):
    """A third of the candidates share one digest: the join's partition of it is split."""
    from threadlake.operators import index as ix

    cand = spark.range(300_000).selectExpr(
        "id AS cand_id", "'jpg' AS ext", "CAST(1 AS DECIMAL(12,2)) AS size_mb",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS md5_b64",
        "sha2(CAST(id AS STRING), 256) AS name")
    idx = spark.createDataFrame([("jpg", 1, "hot", "a/1.jpg"), ("jpg", 1, "hot", "b/1.jpg")],
                                "ext STRING, size_mb INT, md5_b64 STRING, path STRING") \
        .selectExpr("ext", "CAST(size_mb AS DECIMAL(12,2)) AS size_mb", "md5_b64", "path")
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for res in (ix.lookup_duplicates(cand, idx), ix.novel(cand, idx)):
            assert res.where("NOT is_new").count() == 100_000
            rows = res.collect()
            assert len(rows) == 300_000
            assert "skew=true" in res._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_quarantine_keeps_other_lines_in_place(spark, tmp_path):
    """A manifest with a comment, an empty and an unparsed line: they stay where they are."""
    from threadlake.__main__ import quarantine
    from threadlake.operators.manifest import append_manifest, read_manifest

    man = tmp_path / "m.md5"
    man.write_text("# files of a thread\naa *x/1.jpg\n\nbb x/2.jpg\naa *x/1.jpg\ncc *x/3.jpg\n")
    spark.createDataFrame([("aa", "x/1.jpg", True, "dd"), ("cc", "x/3.jpg", False, "ee")],
                          "md5_hex STRING, path STRING, keep BOOLEAN, actual_md5_hex STRING").write.parquet(str(tmp_path / "d"))

    class A:
        manifest, decisions, out = str(man), str(tmp_path / "d"), str(tmp_path / "q")
    quarantine(spark, A)
    parts = sorted((tmp_path / "q" / "manifest").glob("part-*"))
    assert "".join(x.read_text() for x in parts) == "# files of a thread\ndd *x/1.jpg\n\nbb x/2.jpg\naa *x/1.jpg\n"
    outcomes = spark.createDataFrame([(True, "qqo=", "f", "n", "jpg"), (False, "qqo=", "f", "m", "jpg")],
                                     "dl_success BOOLEAN, file_md5_b64 STRING, folder_name STRING, dl_filename STRING, file_ext STRING")
    for _ in range(2):
        append_manifest(outcomes, str(tmp_path / "out"))
    assert [(r.md5_hex, r.path) for r in read_manifest(spark, str(tmp_path / "out")).collect()] == [("aaaa", "f/n.jpg")] * 2


def test_listed_media_holds_hidden_names(spark, tmp_path):
    import base64
    import hashlib

    from threadlake.sources.media import list_media, scan_media

    root = tmp_path / "a b%"
    names = ["1.jpg", "_x.jpg", ".y.png", "sub dir/_d/é+1.gif", "page_files/z.jpg", "n.txt", "_e.webm"]
    for i, name in enumerate(names):
        f = root / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"" if name == "_e.webm" else name.encode() * (i + 1))
    for given in (str(root), root.as_uri().replace("%20", " ").replace("%25", "%")):
        got = {r.path: (r.ext, r.size_bytes, r.md5_b64) for r in scan_media(
            spark, given, listing=list_media(spark, given)).collect()}
        assert sorted(got) == sorted(n for n in names if n not in ("page_files/z.jpg", "n.txt"))
        for name, (ext, size, digest) in got.items():
            data = (root / name).read_bytes()
            assert (ext, size) == (name.rsplit(".", 1)[1], len(data))
            assert digest == base64.b64encode(hashlib.md5(data).digest()).decode()
        plain = scan_media(spark, str(root))
        listed = scan_media(spark, str(root), listing=list_media(spark, str(root)))
        assert plain.exceptAll(listed.select(*plain.columns)).count() == 0


def test_cli_extract_and_report(spark, tmp_path):
    from conftest import SF_SMALL
    from threadlake.__main__ import extract, report, resume
    from threadlake.plans import bindings as b

    b.thread_pages_table(spark, SF_SMALL, "plain").write.parquet(str(tmp_path / "pages"))
    b.threads(spark, SF_SMALL).select("thread_nr", "folder_name").write.parquet(str(tmp_path / "folders"))

    class A:
        pages, out = str(tmp_path / "pages"), str(tmp_path / "tables")
    extract(spark, A)
    files = spark.read.parquet(f"{A.out}/files")
    assert files.count() > 0

    class R:
        tables, folders, date, out = A.out, str(tmp_path / "folders"), "2024-01-01", str(tmp_path / "report")
    report(spark, R)
    text = spark.read.text(R.out)
    assert text.where(text.value.startswith("File: ")).count() == files.count()
    rows = "session_id BIGINT, file_key STRING, to_download BOOLEAN"
    spark.createDataFrame([(1, "a", True), (1, "b", True)], rows).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(1, "b", False)], rows).write.parquet(str(tmp_path / "n"))

    class S:
        prior, new, out = str(tmp_path / "p"), str(tmp_path / "n"), str(tmp_path / "sel")
    resume(spark, S)
    assert sorted(map(tuple, spark.read.parquet(S.out).collect())) == [(1, "a", True), (1, "b", False)]
