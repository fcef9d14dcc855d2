"""Text sinks, nested index, repeated scans; sizes with any decimals; plan sizes of the reports."""

import json
import os
from decimal import Decimal

from pyspark.sql import functions as F

from threadlake import functions as tf
from threadlake.operators import integrity as ig
from threadlake.sources import index_store as st
from threadlake.sources import media as md

INDEX = [("gif", "0.12", "B==", "a/1.gif"), ("gif", "0.12", "B==", 'q"u\\o/ü.gif'), ("gif", "0.12", "A==", "x.gif"), ("gif", "10.50", "C==", "y.gif"),
         ("jpg", "2.00", "D==", "z.jpg"), ("jpg", "2.00", "E==", "a [1]: {.jpg"), ("png", "0.00", "F==", "],")]


def nested(rows):
    out = {}
    for ext, size, md5, path in rows:
        out.setdefault(ext, {}).setdefault(float(size), {}).setdefault(md5, []).append(path)
    return out


def index_of(spark, rows):
    return spark.createDataFrame([(e, Decimal(s), m, p) for e, s, m, p in rows], st.INDEX_DDL)


def test_nested_index_is_the_archives_layout(spark, tmp_path):
    path = str(tmp_path / "out")
    st.save_index_nested(index_of(spark, INDEX).repartition(3), path)
    text = "".join(open(f"{path}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    want = nested(sorted(INDEX, key=lambda r: (r[0], float(r[1]), r[2], r[3].encode())))
    assert text.rstrip("\n") == json.dumps(want, indent=4, sort_keys=True, ensure_ascii=False)
    back = st.load_index_nested(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted((e, Decimal(s), m, p) for e, s, m, p in INDEX)


def test_nested_index_of_the_archive_is_read_by_splits(spark, tmp_path):
    rows = [(e, f"{k}.25", f"{d:04}==", f"dir/{e}{k}/{d}-{i}.{e}") for e in ("gif", "png") for k in range(3) for d in range(20) for i in range(1 + d % 7)]
    (tmp_path / "i.json").write_text(json.dumps(nested(rows), indent=4, sort_keys=True))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        back = st.load_index_nested(spark, str(tmp_path / "i.json"))
        got = sorted(map(tuple, back.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((e, Decimal(s), m, p) for e, s, m, p in rows)
    sets = {"gif": {"0.5": {"_set_object": ["X==", "Y=="]}, "0.7": {}}, "jpg": {}}
    (tmp_path / "s.json").write_text(json.dumps(sets, indent=4, sort_keys=True))
    assert sorted(map(tuple, st.load_index_nested(spark, str(tmp_path / "s.json")).collect())) == [("gif", Decimal("0.50"), d, None) for d in ("X==", "Y==")]


def test_links_are_not_followed(spark, tmp_path):
    root = tmp_path / "m"
    (root / "a").mkdir(parents=True)
    (root / "a" / "1.jpg").write_bytes(b"one")
    os.symlink(root, root / "a" / "loop")
    os.symlink(root / "a", root / "b")
    os.symlink(root / "a" / "1.jpg", root / "2.jpg")
    os.symlink(root / "nowhere", root / "3.jpg")
    assert sorted(r.path for r in md.list_media(spark, str(root)).collect()) == ["2.jpg", "a/1.jpg"]


def test_a_second_scan_reads_only_what_changed(spark, tmp_path, monkeypatch):
    root = tmp_path / "m"
    root.mkdir()
    for i in range(4):
        (root / f"{i}.jpg").write_bytes(b"x" * i)
    one, changes = md.scan_changes(spark, str(root), spark.createDataFrame([], md.SCAN_DDL))
    one = spark.createDataFrame(one.collect(), one.schema)
    assert one.count() == 4 and {r.change for r in changes.collect()} == {"new"}
    read = []
    plain = md._digest_listing
    monkeypatch.setattr(md, "_digest_listing", lambda spark, root, listing, *rest: (read.extend(r.path for r in listing.collect()), plain(spark, root, listing, *rest))[1])
    two, changes = md.scan_changes(spark, str(root), one)
    assert read == [] and changes.count() == 0 and sorted(two.collect()) == sorted(one.collect())
    (root / "0.jpg").unlink()
    (root / "1.jpg").write_bytes(b"y")
    os.utime(root / "1.jpg", (1, 1))
    (root / "_9.jpg").write_bytes(b"new")
    three, changes = md.scan_changes(spark, str(root), one)
    assert sorted(map(tuple, changes.collect())) == [("0.jpg", "gone"), ("1.jpg", "changed"), ("_9.jpg", "new")]
    assert sorted(read) == ["1.jpg", "_9.jpg"] and sorted(r.path for r in three.collect()) == ["1.jpg", "2.jpg", "3.jpg", "_9.jpg"]
    digests = {r.path: r.md5_b64 for r in three.collect()}
    whole = {r.path: r.md5_b64 for r in md.scan_media(spark, str(root), listing=md.list_media(spark, str(root))).collect()}
    assert digests == whole


def test_verify_stored_sees_hidden_names(spark, tmp_path):
    (tmp_path / "_1.jpg").write_bytes(b"abc")
    declared = spark.createDataFrame([("_1.jpg", "kAFQmDzST7DWlj99KOF/cg=="), ("2.jpg", "x")], "path STRING, declared_b64 STRING")
    got = {r.path: r.md5_match for r in ig.verify_stored(spark, str(tmp_path), declared).collect()}
    assert got == {"_1.jpg": True, "2.jpg": None}


def test_sizes_with_any_decimals(spark):
    texts = {"5.12 KB": "0.00", "5.1200001 KB": "0.01", "15.36 KB": "0.02", "15.3600 KB": "0.02", "15.36000000001 KB": "0.02", "25.6 KB": "0.02", "25.60001 KB": "0.03",
             "1.23456789 KB": "0.00", "2.50 MB": "2.50", "2.5000 MB": "2.50", "2.505 MB": None, "3 MB": "3.00", "1 GB": None, "": None, None: None, "KB": None, "7. KB": None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = df.select("i", tf.size_text_mb(F.col("t")).alias("mb"), tf.size_text_reject(F.col("t")).alias("why")).orderBy("i").collect()
    assert [None if r.mb is None else str(r.mb) for r in got] == list(texts.values())
    reasons = dict(zip(texts, (r.why for r in got)))
    assert [reasons[t] for t in ("1 GB", "", None, "KB", "2.505 MB", "3 MB")] == ["unknown_unit", "no_size", "no_size", "odd_size", "odd_size", None]


def test_quarantine_over_several_manifests(spark, tmp_path):
    from threadlake.__main__ import gen_info, quarantine
    from threadlake.sources.index_store import load_index

    (tmp_path / "man").mkdir()
    (tmp_path / "man" / "a.md5").write_text("aa *x/1.jpg\n# note\nbb *x/2.jpg\n")
    (tmp_path / "man" / "b.md5").write_text("aa *x/1.jpg\naa *x/1.jpg\n")
    spark.createDataFrame([("b.md5", "aa", "x/1.jpg", False, "cc"), ("a.md5", "bb", "x/2.jpg", True, "dd")],
                          "file STRING, md5_hex STRING, path STRING, keep BOOLEAN, actual_md5_hex STRING").write.parquet(str(tmp_path / "dec"))

    class Q:
        manifest, decisions, out = str(tmp_path / "man"), str(tmp_path / "dec"), str(tmp_path / "q")
    quarantine(spark, Q)
    got = {}
    for r in spark.read.text(f"{Q.out}/manifest").collect():
        got.setdefault(r["manifest"], []).append(r["value"])
    assert got == {"a.md5": ["aa *x/1.jpg", "# note", "dd *x/2.jpg"], "b.md5": ["aa *x/1.jpg"]}

    class A:
        root, index, scan = str(tmp_path / "m"), str(tmp_path / "idx"), str(tmp_path / "scan")
    (tmp_path / "m").mkdir()
    for names in (["1.jpg"], ["1.jpg", "2.gif"]):
        for n in names:
            (tmp_path / "m" / n).write_bytes(b"x")
        gen_info(spark, A)
        assert sorted(r.path for r in load_index(spark, A.index).collect()) == names


def test_failure_text(spark, tmp_path):
    failed = spark.createDataFrame([("t1", "k2"), ("t1", "k1"), ("t2", "k3")], "thread_nr STRING, file_key STRING")
    ig.write_failures(ig.integrity_report(failed), str(tmp_path / "f"))
    text = lambda t: "".join(open(f"{tmp_path}/f/thread={t}/{f}").read() for f in sorted(os.listdir(tmp_path / "f" / f"thread={t}")) if f.startswith("part-"))
    assert text("t1") == "Failed MD5s of Thread No. t1:\nk1\nk2\n" and text("t2") == "Failed MD5s of Thread No. t2:\nk3\n"


def test_reports_plan_few_exchanges(spark):
    import __spark_entry__ as E

    for name in ("thread_report", "relevant_replies"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 8, name
