"""Streaming novelty, de-dup and index upkeep (T2-T5); text and run-state sinks."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from threadlake.sources import index_store as st
from threadlake.streaming import index as si

IDX_DDL = "ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING, path STRING"


def test_novelty_stream(spark, tmp_path):
    index = spark.createDataFrame([("jpg", Decimal("0.12"), "AAA", "a/1.jpg")], IDX_DDL)
    src = tmp_path / "files"
    spark.createDataFrame([(1, "jpg", Decimal("0.12"), "AAA"), (2, "jpg", Decimal("0.12"), "BBB"),
                           (3, "jpg", None, "AAA")],
                          "file_id INT, ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING").write.parquet(str(src))
    stream = spark.readStream.schema("file_id INT, ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING").parquet(str(src))
    q = (si.novelty_stream(stream, index).writeStream.format("memory").queryName("novelty_out")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.file_id: r.is_new for r in spark.sql("SELECT * FROM novelty_out").collect()}
    assert got == {1: False, 2: True, 3: None}


def test_index_upkeep_restart(spark, tmp_path):
    src = tmp_path / "verified"
    ddl = "ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING, path STRING, ts TIMESTAMP"
    t0 = dt.datetime(2024, 1, 1)
    first = [("jpg", Decimal("0.12"), "AAA", "a/1.jpg", t0), ("jpg", Decimal("0.12"), "AAA", "b/1.jpg", t0),
             ("png", Decimal("1.00"), "CCC", "a/2.png", t0)]
    spark.createDataFrame(first, ddl).coalesce(1).write.mode("append").parquet(str(src))
    index_path, ck = str(tmp_path / "index"), str(tmp_path / "ck")

    def run():
        stream = spark.readStream.schema(ddl).parquet(str(src))
        si.maintain_index(stream, index_path, ck).awaitTermination()

    run()
    got = sorted((r.ext, r.md5_b64) for r in si.current_index(spark, index_path).collect())
    assert got == [("jpg", "AAA"), ("jpg", "AAA"), ("png", "CCC")]  # every stored path is kept
    # Restart from the checkpoint: only the new file is processed.
    spark.createDataFrame([("gif", Decimal("0.50"), "DDD", "c/3.gif", t0),
                           ("jpg", Decimal("0.12"), "AAA", "c/1.jpg", t0)], ddl) \
        .coalesce(1).write.mode("append").parquet(str(src))
    run()
    got = sorted((r.ext, r.md5_b64) for r in si.current_index(spark, index_path).collect())
    assert got == [("gif", "DDD"), ("jpg", "AAA"), ("jpg", "AAA"), ("jpg", "AAA"), ("png", "CCC")]
    # Novelty is a separate output: one row for each digest.
    stream = spark.readStream.schema(ddl).parquet(str(src))
    q = (si.dedupe_verified(stream).writeStream.format("memory").queryName("novel_out")
         .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.md5_b64 for r in spark.sql("SELECT * FROM novel_out").collect()) == ["AAA", "CCC", "DDD"]
    # The base snapshot and the additions together form the current index.
    base = str(tmp_path / "base")
    st.save_index(spark.createDataFrame([("webm", Decimal("2.80"), "EEE", "z/9.webm")],
                                        "ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING, path STRING"), base)
    assert si.current_index(spark, index_path, base).count() == 6


def test_text_and_run_state_sinks(spark, tmp_path):
    df = spark.createDataFrame([("line one",), ("line two",)], "value STRING")
    st.write_text(df, str(tmp_path / "t"))
    st.write_text(df.limit(1), str(tmp_path / "t"), mode="append")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["line one", "line one", "line two"]
    st.write_text(df.limit(1), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["line one"]
    state = spark.createDataFrame([("gif", "1", "fetch", True), ("v", "1", "curate", False)], st.RUN_STATE_DDL)
    st.save_run_state(state, str(tmp_path / "state"))
    back = st.load_run_state(spark, str(tmp_path / "state"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, state.collect()))
    assert back.where(F.col("done")).count() == 1


def test_live_novelty_follows_the_index(spark, tmp_path):
    ddl = "file_id INT, ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING"
    src, idx, out, ck = (str(tmp_path / x) for x in ("files", "index", "out", "ck"))
    st.save_index(spark.createDataFrame([("jpg", Decimal("0.12"), "AAA", "a/1.jpg")], IDX_DDL), idx)

    def arrive(rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        si.live_novelty(spark.readStream.schema(ddl).parquet(src), lambda: st.load_index(spark, idx), out, ck).awaitTermination()

    arrive([(1, "jpg", Decimal("0.12"), "AAA"), (2, "jpg", Decimal("0.12"), "BBB"), (3, "jpg", None, "AAA")])
    st.save_index(spark.createDataFrame([("jpg", Decimal("0.12"), "BBB", "a/2.jpg")], IDX_DDL), idx, mode="append")
    arrive([(4, "jpg", Decimal("0.12"), "BBB")])
    got = {r.file_id: r.is_new for r in spark.read.parquet(out).collect()}
    assert got == {1: False, 2: True, 3: None, 4: False}
