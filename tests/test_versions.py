"""Versioned tables, and the folds, indexes and states kept in them."""

import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from test_curation import COLUMNS, EV_DDL, FILE_DDL, SESS_DDL, random_case
from threadlake.operators import curation as cu
from threadlake.sources import index_store as st
from threadlake.sources.versions import StaleVersion, VersionedTable
from threadlake.streaming import curation as sc
from threadlake.streaming import index as si

DDL = "k INT, p STRING"


def rows(spark, *ks):
    return spark.createDataFrame([(k, "ab"[k % 2]) for k in ks], DDL)


def keys(df):
    return sorted(r["k"] for r in df.collect())


def test_many_batches_leave_few_folders(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), DDL, partition_by=["p"], fan=3)
    for i in range(20):
        t.append(rows(spark, i), ("w", i))
        assert len(t.latest().commits) <= 2 * 3
        assert len(os.listdir(tmp_path / "t" / "data")) <= 2 * 3 + 3 * t.keep
    t.append(rows(spark, 99), ("w", 7))  # replayed
    t.append(rows(spark, 50), ("other", 0))
    assert keys(t.read()) == [*range(20), 50]
    assert t.read().columns == ["k", "p"]


def test_a_reader_keeps_its_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), DDL)
    assert t.read().count() == 0
    one = t.append(rows(spark, 1))
    seen = t.read(one)
    t.replace(rows(spark, 2))
    assert keys(seen) == [1] and keys(t.read()) == [2]


def test_a_writer_that_dies_before_publishing_loses_nothing(spark, tmp_path, monkeypatch):
    state = spark.createDataFrame([("gif", "1", "done", True)], st.RUN_STATE_DDL)
    path = str(tmp_path / "s")
    st.save_run_state(state, path)

    def killed(self, version):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            st.save_run_state(state.where("false"), path)
    assert st.load_run_state(spark, path).collect() == state.collect()


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), DDL)
    read = t.append(rows(spark, 1))
    t.append(rows(spark, 2))
    with pytest.raises(StaleVersion):
        t.replace(rows(spark, 3), since=read)
    # An append that finds its number taken is published as the next one.
    first, late = t.latest(), t.latest
    t.append(rows(spark, 4))
    given = iter([first])
    monkeypatch.setattr(t, "latest", lambda: next(given, None) or late())
    t.append(rows(spark, 5))
    assert keys(t.read()) == [1, 2, 4, 5]


@pytest.mark.parametrize("seed,cuts", [(3, 1), (4, 6)])
def test_any_stretches_fold_to_the_whole(spark, tmp_path, seed, cuts):
    sessions, files, events = random_case(seed, n_sessions=15)
    s, f = spark.createDataFrame(sessions, SESS_DDL), spark.createDataFrame(files, FILE_DDL)
    events.sort(key=lambda r: r[1])
    random.Random(seed).shuffle(sessions)
    at = sorted(random.Random(seed).sample(range(1, len(events)), cuts))
    parts = [events[a:b] for a, b in zip([0, *at], [*at, len(events)])]
    for i, part in enumerate(parts):
        for _ in range(1 + i % 2):  # some batches arrive twice
            sc.continue_fold(str(tmp_path / "f"), spark.createDataFrame(part[::-1], EV_DDL), s, f, ("w", i), blocks=3)
    want = cu.fold_curation(spark.createDataFrame(events, EV_DDL), s, f).select(*COLUMNS)
    got = sc.current_selection(spark, str(tmp_path / "f")).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_set_aside(spark, tmp_path):
    s = spark.createDataFrame([(1, "t", False)], SESS_DDL)
    f = spark.createDataFrame([("t", "b/1.jpg", "1", "orig1", True)], FILE_DDL)
    path = str(tmp_path / "f")
    sc.continue_fold(path, spark.createDataFrame([(1, 5, "https://i.4cdn.org/b/1.jpg")], EV_DDL), s, f, ("w", 0))
    sc.continue_fold(path, spark.createDataFrame([(1, 4, "remove_file"), (1, 6, "x")], EV_DDL), s, f, ("w", 1))
    assert [r["dl_filename"] for r in sc.current_selection(spark, path).collect()] == ["1_x"]
    assert [tuple(r) for r in sc.late_table(spark, path).read().collect()] == [(1, 4, "remove_file")]


def test_a_hot_session_is_folded_in_blocks(spark):
    """A third of the rows in one session: no plan of the live fold has a Python state or a window
    over a whole session."""
    url = "https://i.4cdn.org/b/1.jpg"
    ev = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).cast("bigint").alias("session_id"), F.col("id").alias("seq"),
                                  F.when(F.col("id") % 100 < 3, F.lit(url)).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("value"))
    s = spark.range(50).select(F.col("id").alias("session_id"), F.lit("t").alias("thread_nr"), F.lit(False).alias("unique_only"))
    f = spark.createDataFrame([("t", "b/1.jpg", "1", "orig", True)], FILE_DDL)
    decisions, states = cu.fold_stretch(ev, s, f, blocks=12, cut=False)
    for df in (decisions, states):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Python" not in plan
        windows = [line for line in plan.splitlines() if "Window [" in line or "Window(" in line]
        assert windows


def test_a_digest_is_new_once_whatever_the_delay(spark, tmp_path):
    ddl = "ext STRING, size_mb DECIMAL(12,2), md5_b64 STRING, path STRING"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    days = [[("A", "1"), ("A", "2"), ("B", "3")], [("C", "4"), ("A", "5")], [(None, "6"), ("B", "7")], [("C", "8"), (None, "9"), ("D", "0")]]
    for day in days:
        spark.createDataFrame([("jpg", Decimal("0.12"), d, p) for d, p in day], ddl).coalesce(1).write.mode("append").parquet(src)
        si.distinct_digests(spark.readStream.schema(ddl).parquet(src), out, ck).awaitTermination()
    got = sorted((r["md5_b64"] or "", r["path"]) for r in si.digest_table(spark, out).read().collect())
    assert got == [("", "6"), ("", "9"), ("A", "1"), ("B", "3"), ("C", "4"), ("D", "0")]
