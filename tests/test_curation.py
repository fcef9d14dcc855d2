"""The curation fold: written-out cases, block sizes against each other and the stateful stream
against the batch on random logs (repeated values, unknown URLs, removals followed by text,
add_anyway on known files, toggles in mid-file). The SQL cross-check is in test_oracle."""

import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import curation as cu
from threadlake.operators.sequence import prefix_sums, previous_value

SESS_DDL = "session_id BIGINT, thread_nr STRING, unique_only BOOLEAN"
FILE_DDL = "thread_nr STRING, file_key STRING, file_name_4ch STRING, file_name_orig STRING, is_new BOOLEAN"
EV_DDL = "session_id BIGINT, seq BIGINT, value STRING"


def random_case(seed, n_sessions=25):
    rnd = random.Random(seed)
    sessions, files, events = [], [], []
    seq = 0
    for s in range(n_sessions):
        thread = f"t{s}"
        uo = rnd.random() < 0.5
        sessions.append((s, thread, uo))
        fmap = {}
        for j in range(5):
            key = f"b/{1000 + s * 10 + j}.jpg"
            isnew = rnd.choice([True, False, None])
            fmap[key] = (str(1000 + s * 10 + j), f"orig{j}", isnew)
            files.append((thread, key, fmap[key][0], fmap[key][1], isnew))
        vals = []
        for _ in range(rnd.randrange(0, 40)):
            r = rnd.random()
            if r < 0.35:
                j = rnd.randrange(6)  # 5 = not in the thread
                host = rnd.choice(["https://i.4cdn.org/", "//is2.4chan.org/"])
                vals.append(f"{host}b/{1000 + s * 10 + j}.jpg")
            elif r < 0.45 and vals:
                vals.append(vals[-1])  # repeated copy
            else:
                vals.append(rnd.choice(["remove_file", "add_anyway", " toggle_use_orig_fn", "reset_filename",
                                        "reset_to_4ch_fn", "rename_thread", " some text! ", "x/y", "é ok", "  "]))
        for v in vals:
            seq += rnd.randrange(1, 4)
            events.append((s, seq, v))
    return sessions, files, events


COLUMNS = ["session_id", "thread_nr", "file_key", "dl_filename", "is_unique", "to_download", "removed"]


def multiset(df):
    return sorted(tuple(r) for r in df.collect())


def folded(spark, sessions, files, events, **options):
    s, f, e = (spark.createDataFrame(r, d) for r, d in ((sessions, SESS_DDL), (files, FILE_DDL), (events, EV_DDL)))
    return sorted(tuple(r) for r in cu.fold_curation(e, s, f, **options).select(*COLUMNS).collect())


@pytest.mark.parametrize("seed,block", [(1, 4), (2, 1)])
def test_fold_does_not_depend_on_blocks(spark, seed, block):
    case = random_case(seed)
    whole = folded(spark, *case)
    assert whole and folded(spark, *case, blocks=block) == whole


def test_fold_cases(spark):
    url = "https://i.4cdn.org/b/%d.jpg"
    files = [("t", "b/1.jpg", "1", "orig1", True), ("t", "b/2.jpg", "2", "orig2", False), ("t", "b/3.jpg", "3", "orig3", True)]
    values = [url % 1, "some text!", "some text!", url % 9, url % 3, "remove_file", url % 1]
    events = [(1, 10 * i, v) for i, v in enumerate(values)]
    got = {r[2]: r for r in folded(spark, [(1, "t", False)], files, events)}
    assert got["b/1.jpg"][3:] == ("1", None, True, False)  # taken up again: named anew
    assert got["b/3.jpg"][5:] == (False, True) and set(got) == {"b/1.jpg", "b/3.jpg"}
    got = {r[2]: r for r in folded(spark, [(1, "t", False)], files, events[:3])}
    assert got["b/1.jpg"][3:] == ("1_some text_", None, True, False)  # the repeat is dropped


def test_stream_equals_batch(spark, tmp_path):
    from threadlake.streaming.curation import run_curation_stream

    sessions, files, events = random_case(9, n_sessions=12)
    s = spark.createDataFrame(sessions, SESS_DDL)
    f = spark.createDataFrame(files, FILE_DDL)
    src = tmp_path / "events"
    # Three files in seq order, written one after another so the source reads them in order.
    events.sort(key=lambda r: r[1])
    third = len(events) // 3 + 1
    for i in range(3):
        chunk = events[i * third:(i + 1) * third]
        if chunk:
            spark.createDataFrame(chunk, EV_DDL).coalesce(1).write.mode("append").parquet(str(src))
    out = run_curation_stream(spark, str(src), s, f, str(tmp_path / "sink"), str(tmp_path / "ckpt"),
                              max_files_per_trigger=1)
    got = sorted(tuple(r) for r in out.collect())
    batch = cu.fold_curation(cu.drop_repeats(spark.createDataFrame(events, EV_DDL)), s, f)
    want = sorted(tuple(r) for r in batch.select("session_id", "thread_nr", "file_key", "dl_filename", "is_unique",
                                                  "to_download", "removed").collect())
    assert got == want


def test_prefix_sums_blockwise_equal_window(spark):
    from pyspark.sql import Window

    rnd = random.Random(4)
    rows = [(rnd.randrange(4), i * rnd.randrange(1, 5), rnd.randrange(3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k INT, seq BIGINT, v INT").dropDuplicates(["k", "seq"])
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = sorted((r.k, r.seq, r.s) for r in df.select("k", "seq", F.sum("v").over(w).alias("s")).collect())
    for n in (1, 7, 40):
        got = prefix_sums(df, ["k"], "seq", {"s": F.col("v")}, blocks=n)
        assert sorted((r.k, r.seq, r.s) for r in got.collect()) == want
        lag = previous_value(df, ["k"], "seq", "v", "p", blocks=n)
        wl = Window.partitionBy("k").orderBy("seq")
        want_lag = sorted((r.k, r.seq, r.p) for r in df.select("k", "seq", F.lag("v").over(wl).alias("p")).collect())
        assert sorted((r.k, r.seq, r.p) for r in lag.collect()) == want_lag


def test_dedup_prefix_sums_equal_window(spark):
    from pyspark.sql import Window

    from threadlake.operators.sequence import dedup_prefix_sums

    rnd = random.Random(8)
    rows, seq = [], 0
    for _ in range(3000):
        seq += rnd.randrange(1, 4)
        rows.append((rnd.randrange(5), seq, rnd.choice("aab"), rnd.randrange(3)))
    df = spark.createDataFrame(rows, "k INT, seq BIGINT, val STRING, v INT")
    w = Window.partitionBy("k").orderBy("seq")
    kept = df.withColumn("p", F.lag("val").over(w)).where(F.col("p").isNull() | (F.col("p") != F.col("val"))).drop("p")
    want = sorted((r.k, r.seq, r.s) for r in kept.select(
        "k", "seq", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).collect())
    for n in (1, 3, 17, 64):
        got = dedup_prefix_sums(df, ["k"], "seq", "val", {"s": F.col("v")}, blocks=n)
        assert sorted((r.k, r.seq, r.s) for r in got.collect()) == want, n


def test_stored_name_golden(spark):
    # A copied file URL, then free text: the text is sanitised and appended to the server name.
    s = spark.createDataFrame([(1, "t", False)], SESS_DDL)
    f = spark.createDataFrame([("t", "p/1579558670830.jpg", "1579558670830", "DSC_001", None)], FILE_DDL)
    e = spark.createDataFrame([(1, 1, "https://i.4cdn.org/p/1579558670830.jpg"),
                               (1, 2, "Fomapan 200, shot on a Pentax K1000 ")], EV_DDL)
    row = cu.fold_curation(e, s, f).collect()[0]
    assert row.dl_filename == "1579558670830_Fomapan 200_ shot on a Pentax K1000"
    assert row.to_download and not row.removed


def test_stream_restart_keeps_state(spark, tmp_path):
    from threadlake.streaming.curation import run_curation_stream

    sessions, files, events = random_case(21, n_sessions=10)
    s = spark.createDataFrame(sessions, SESS_DDL)
    f = spark.createDataFrame(files, FILE_DDL)
    events.sort(key=lambda r: r[1])
    half = len(events) // 2
    src, sink, ck = str(tmp_path / "ev"), str(tmp_path / "sink"), str(tmp_path / "ck")
    spark.createDataFrame(events[:half], EV_DDL).coalesce(1).write.mode("append").parquet(src)
    run_curation_stream(spark, src, s, f, sink, ck)
    # Restart from the same checkpoint after more of the log has arrived.
    spark.createDataFrame(events[half:], EV_DDL).coalesce(1).write.mode("append").parquet(src)
    out = run_curation_stream(spark, src, s, f, sink, ck)
    batch = cu.fold_curation(cu.drop_repeats(spark.createDataFrame(events, EV_DDL)), s, f)
    assert multiset(out) == multiset(batch.select(*COLUMNS))


def test_hot_session_blockwise(spark):
    """One session holds a third of 150k log rows, numbered by microseconds with long gaps:
    the blockwise pass equals a plain per-session window, and no block holds more than
    about its share of all rows."""
    from pyspark.sql import Window

    from threadlake.operators.sequence import dedup_prefix_sums, with_blocks

    n = 150_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("k"),
        F.when(F.col("id") == 0, F.lit(0)).otherwise(1_700_000_000_000_000 + F.col("id") * 1_000_003
                                                     + F.floor(F.col("id") / 50_000) * 10**13).alias("seq"),
        (F.col("id") * 7 % 5 < 2).cast("string").alias("val"),
        (F.col("id") % 4).cast("int").alias("v"))
    w = Window.partitionBy("k").orderBy("seq")
    kept = df.withColumn("p", F.lag("val").over(w)).where(F.col("p").isNull() | (F.col("p") != F.col("val")))
    want = kept.select("k", "seq", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    got = dedup_prefix_sums(df, ["k"], "seq", "val", {"s": F.col("v")}, blocks=40).select("k", "seq", "s")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    sizes = with_blocks(df, ["k"], "seq", 40).groupBy("k", "_blk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * n / 40
    hot = sizes.where("k = 0").count()
    assert 10 <= hot <= 20  # a third of 40 blocks, not one block a row


def test_hot_epoch_is_aggregated_before_its_shuffle(spark):
    """One URL followed by a third of the log: a row per task and name base is shuffled."""
    url = "https://i.4cdn.org/b/1.jpg"
    ev = spark.range(9000).select(
        F.when(F.col("id") < 3000, F.lit(1)).otherwise(F.col("id") % 50 + 2).cast("bigint").alias("session_id"),
        F.col("id").alias("seq"),
        F.when((F.col("id") == 0) | (F.col("id").between(3000, 3049)), F.lit(url))
        .otherwise(F.when(F.col("id") % 2 == 0, F.lit("add_anyway")).otherwise(F.lit("toggle_use_orig_fn"))).alias("value"))
    s = spark.range(1, 52).select(F.col("id").alias("session_id"), F.lit("t").alias("thread_nr"), F.lit(True).alias("unique_only"))
    f = spark.createDataFrame([("t", "b/1.jpg", "1", "orig", False)], FILE_DDL)
    out = cu.fold_curation(ev, s, f, blocks=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Exchange hashpartitioning") <= 3
    got = {r.session_id: (r.dl_filename, r.to_download) for r in out.collect()}
    # Sessions of even numbers hold one add_anyway (the rest are repeats), those of odd ones one toggle.
    assert got == {1: ("1", True)} | {k + 2: ("1", True) if k % 2 == 0 else (None, False) for k in range(50)}
