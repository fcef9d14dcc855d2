"""Vector search against brute force, the registered queries, and the pipeline."""

import math
import re

import numpy as np
import pytest
from samples import SF, multiset
from pyspark.sql import functions as F
from test_copies import fingerprint, groups

import __spark_entry__ as E
import corpus_pipeline
from threadlake.llm import ann, quality, queries
from threadlake.llm.common import Scratch

VECTORS = "vec_id bigint, embedding array<float>, label int, cell int, query int"


def test_search_edge_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0, 0, 0) for i in range(60)]
    same = rows[20][1]
    rows += [(i, same, 0, 0, 0) for i in range(100, 160)] + [rows[40], (200, None, 0, 0, 0), (220, [0.0] * 6, 0, 0, 0), (240, [1.0, None] * 3, 0, 0, 0), (260, [math.nan] * 6, 0, 0, 0), (280, [1.0], 0, 0, 0), (None, same, 0, 0, 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    vec = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and i < 200}
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [i for i in sorted(vec) if i % 20 == 0]
    for q, own in got.items():
        want = sorted(((-float((vec[i] * vec[q]).sum()), i) for i in vec if i != q))[:5]
        assert [(r, i) for r, i, _ in sorted(own)] == [(k + 1, i) for k, (_, i) in enumerate(want)]
        assert np.allclose([s for _, _, s in sorted(own)], [-s for s, _ in want])
    few = ann.search(df.where("vec_id < 3"), F.col("vec_id") == 0, k=20)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def few_vectors(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)], "vec_id bigint, embedding array<float>")


def test_chunks_of_queries_do_not_follow_the_partitions(spark, monkeypatch):
    kind = type(spark.range(1))
    for name in ("repartition", "repartitionByRange"):
        plain = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda df, n, *cols, plain=plain: plain(df, max(n, 30), *cols))
    written, plain_write = {}, Scratch.write

    def write(self, df, name, **options):
        written[name] = plain_write(self, df, name, **options)
        return written[name]
    monkeypatch.setattr(Scratch, "write", write)
    assert ann.search(few_vectors(spark), F.col("vec_id") % 2 == 0, k=3).count() == 600
    assert written["meet"].count() == 1  # 400 entries are one part, 200 queries one chunk


def test_search_of_many_parts_and_chunks(spark, monkeypatch):
    df = few_vectors(spark)
    found = lambda: multiset(ann.search(df, F.col("vec_id") % 2 == 0, k=3).collect())
    whole = found()
    monkeypatch.setattr(ann, "BLOCK", 4)
    assert found() == whole


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {(r["query_id"], r["vec_id"]) for r in queries.op5_neighbours(spark, SF).collect()}
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -np.inf
        want |= {(int(ids[q]), int(i)) for i in ids[np.lexsort((ids, -s))[:20]]}
    assert len(got & want) >= 0.9 * len(want)


def test_queries_are_registered():
    names = set(E.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(queries.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", ["op1_secret_scans", "op4_token_counts", "op7_language_id"])
def test_query_runs(spark, name):
    assert E.queries()[name](spark, SF).count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
        if name != "packing":
            assert rows.columns == docs.columns
            rows = rows.cache()
            kept.append({r["doc_id"]: r["text"] for r in rows.collect()})
    good = {r["doc_id"] for r in quality.rated(docs).where("kept").collect()}
    assert set(kept[0]) == good and all(kept[0][i] == before[i] for i in good)
    label = groups({i: fingerprint(t) for i, t in kept[0].items()})
    assert set(kept[1]) == set(label.values())
    first = {}
    for i in sorted(kept[1]):
        words = kept[1][i].encode().split()
        for k in range(len(words) - 12):
            first.setdefault(tuple(words[k:k + 13]), i)
    for i, text in kept[1].items():
        words = text.encode().split()
        cut = [False] * len(words)
        for k in range(len(words) - 12):
            if first[tuple(words[k:k + 13])] < i:
                cut[k:k + 13] = [True] * 13
        assert kept[2][i] == (b" ".join(w for w, c in zip(words, cut) if not c).decode() if any(cut) else text)
    assert set(kept[3]) == set(kept[2])
    assert not any(re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) for t in kept[3].values())
    pieces = rows.collect()
    assert {r["doc_id"] for r in pieces} == set(kept[3])
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == rows.columns and run.agg(F.sum("length")).first()[0] == sum(r["length"] for r in pieces)
