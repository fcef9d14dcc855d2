"""Scalar helpers against Python's own behaviour and the golden vectors."""

import base64
import html
import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from threadlake import functions as tf
from threadlake.functions.text import ARTIST_NAME_PATTERNS


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_digest_golden(spark):
    out = one_col(spark, ["gUkUw0o1n7cI+w0x8LWj2w==", "E2nKKDmi/IwbuxHgn4hWff=="], tf.b64_to_hex)
    assert out == ["814914c34a359fb708fb0d31f0b5a3db", "1369ca2839a2fc8c1bbb11e09f88567d"]
    assert one_col(spark, ["814914c34a359fb708fb0d31f0b5a3db"], tf.hex_to_b64) == ["gUkUw0o1n7cI+w0x8LWj2w=="]


def test_size_text_edges(spark):
    out = one_col(spark, ["128 KB", "2.8 MB", "500 B", "12.5 KB", "2.835 MB", "x KB"], tf.size_text_mb)
    assert [None if v is None else str(v) for v in out] == ["0.12", "2.80", None, "0.01", None, None]


def test_size_text_matches_python_round(spark):
    kbs = list(range(0, 4097))
    out = one_col(spark, [f"{k} KB" for k in kbs], tf.size_text_mb)
    assert [float(v) for v in out] == [round(k / 1024, 2) for k in kbs]


def test_size_bucket_matches_python_round(spark):
    rnd = random.Random(7)
    sizes = [rnd.randrange(0, 8 << 30) for _ in range(3000)] + [k * 5243 for k in range(2000)] + [0, 1, 5242, 5243]
    out = one_col(spark, sizes, tf.size_bucket, "bigint")
    assert [float(v) for v in out] == [round(b / 1048576, 2) for b in sizes]


def test_sanitize(spark):
    texts = ["plain name", " a/b\\c ", "x?!.,;:", "(1) - _", "éüßçÆ漢字٣²½", "tab\tstar ★ dash —", "", "  ", "!"]
    want = ["plain name", "a_b_c", "x______", "(1) - _", "éüßçÆ漢字٣²½", "tab_star _ dash _", "", "", "_"]
    assert one_col(spark, texts, tf.sanitize_name) == want


def test_split_lines_matches_python(spark):
    texts = ["", "a", "a\n", "a\nb", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h ", "\n\n", "x\n\ny\n"]
    out = one_col(spark, texts, tf.split_lines)
    assert [list(o) for o in out] == [t.splitlines() for t in texts]


def test_indent_and_rule_layout(spark):
    df = spark.createDataFrame([("text", 1), ("deep", 3)], "l STRING, lvl INT")
    rows = df.select(tf.indent_line(F.col("l"), F.col("lvl")), tf.rule_line(F.col("lvl"))).collect()
    assert rows[0][0] == "> {:>{p}}".format("text", p=4 + 5) and rows[0][1] == "  {:>{p}}".format("__________", p=15)
    assert rows[1][0] == "> " + " " * 15 + "deep" and rows[1][1] == "  " + " " * 15 + "__________"


class _Texts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, d):
        self.parts.append(d)


def test_html_text_matches_parser(spark):
    rnd = random.Random(11)
    frags = []
    for _ in range(300):
        bits = []
        for _ in range(rnd.randrange(1, 6)):
            k = rnd.randrange(4)
            if k == 0:
                bits.append("<br>")
            elif k == 1:
                q = rnd.randrange(10**6)
                bits.append(f'<a href="#p{q}" class="quotelink">&gt;&gt;{q}</a>')
            else:
                bits.append(html.escape(rnd.choice(["plain text", "a < b & c", "it's \"q\"", "x"]), quote=True)
                            .replace("&#x27;", "&#039;"))
        frags.append("".join(bits))

    def py(frag):
        p = _Texts()
        p.feed(frag)
        p.close()
        return "\n".join(p.parts)

    assert one_col(spark, frags, tf.html_text) == [py(f) for f in frags]


def test_artist_names(spark):
    want = {"by_some_artist": ["some_", "some"], "artist_1234567_rest": ["artist"], "1234_abc_rest": ["abc"],
            "1234-abc-def-": ["abc-def"], "x1234.name_more": ["name"], "none here": []}
    got = dict(zip(want, map(list, one_col(spark, list(want), tf.artist_names))))
    assert got == want


def test_url_predicates_and_key(spark):
    urls = ["https://boards.4chan.org/gif/thread/123", "http://boards.4channel.org/v/thread/9#p1",
            "https://boards.4chan.org/3/thread/1", "https://i.4cdn.org/gif/1511722035452.webm",
            "//is2.4chan.org/wsg/123.jpg", "https://example.com/a.jpg", "ftp://i.4cdn.org/a/1.jpg"]
    assert one_col(spark, urls, tf.is_thread_url) == [True, True, False, False, False, False, False]
    assert one_col(spark, urls, tf.is_file_url) == [False, False, False, True, True, False, False]
    assert one_col(spark, ["https://is2.4chan.org/gif/1.webm"], tf.file_key) == ["gif/1.webm"]
    assert one_col(spark, ["//is2.4chan.org/gif/1.webm"], tf.canonical_url) == ["https://i.4cdn.org/gif/1.webm"]


def test_valid_folder_and_source_request(spark):
    assert one_col(spark, ["gif_cute", "a:b", " ok ", 'q"'], tf.valid_folder) == [True, False, True, False]
    assert one_col(spark, ["Sauce?", "nice", "LINK pls"], tf.is_source_request) == [True, False, True]


def test_md5_b64_of_content(spark):
    import hashlib

    data = [b"", b"abc", bytes(range(256))]
    out = one_col(spark, data, tf.md5_b64, "binary")
    assert out == [base64.b64encode(hashlib.md5(d).digest()).decode() for d in data]


def test_sql_functions_equal_column_helpers(spark):
    from threadlake.functions.sql import SQL_FUNCTIONS, register_sql_functions

    register_sql_functions(spark)
    samples = {
        "BIGINT": [0, 1, 5242, 5243, 134217, 1048575, 1048576, 3 << 30],
        "STRING": ["128 KB", "2.8 MB", "12.5 KB", "500 B", "2.835 MB", "gUkUw0o1n7cI+w0x8LWj2w==",
                   "a\\b//./c.tar.gz", "https://is2.4chan.org/gif/1.webm", "//i.4cdn.org/v/2.jpg",
                   "https://boards.4chan.org/gif/thread/1", "x:y?", " é (ok)_-! ", "a<br>b &amp; &lt;c&gt;",
                   "", "name.with.dots", "814914c34a359fb708fb0d31f0b5a3db", "1x1.", "3.", "file.JPG"],
        "INT": [0, 1, 3],
        "TIMESTAMP": [__import__("datetime").datetime(2018, 3, 18, 23, 59, 59),
                      __import__("datetime").datetime(2024, 1, 1, 0, 0, 0)],
    }
    for name, (helper, args, _ret) in SQL_FUNCTIONS.items():
        cols = [a for a, _ in args]
        import itertools
        rows = list(itertools.product(*[samples[t] for _, t in args]))
        df = spark.createDataFrame(rows, ", ".join(f"{a} {t}" for a, t in args))
        via_col = df.select(*cols, helper(*[F.col(c) for c in cols]).alias("r"))
        via_sql = df.selectExpr(*cols, f"{name}({', '.join(cols)}) AS r")
        assert sorted(map(tuple, via_col.collect()), key=repr) == sorted(map(tuple, via_sql.collect()), key=repr), name


def test_report_layout_golden(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "lvl INT")
    rows = df.orderBy("lvl").select(tf.rule_line(F.col("lvl")).alias("r"),
                                    tf.indent_line(F.lit(">>410169605"), F.col("lvl")).alias("l")).collect()
    assert [r.r for r in rows] == ["       __________", "            __________", "                 __________"]
    assert [r.l for r in rows] == [">      >>410169605", ">           >>410169605", ">                >>410169605"]
