"""Whitening and hard negatives against numpy over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.llm import hard_negatives as hn
from threadlake.llm import vectors, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, cell int, part int, key string, n int, rank int"
EXTRA = (0, 0, "k", 0, 0)


def odd_rows(same):
    return [(900, None, 1, *EXTRA), (901, [1.0, None] * 3, 1, *EXTRA), (902, [math.nan] * 6, 1, *EXTRA), (903, [math.inf] * 6, 1, *EXTRA), (904, [1.0], 1, *EXTRA),
            (905, [], 1, *EXTRA), (906, [0.0, -0.0] * 3, 1, *EXTRA), (None, same, 1, *EXTRA), (907, same, None, *EXTRA)]


def rows_of(seed, n, copies):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) * [1, 1, 2, 1, .5, 1])], int(rng.integers(4)), *EXTRA) for i in range(n)]
    same = rows[7][1]
    return rows + [(n + i, same, i % 3, *EXTRA) for i in range(copies)] + [rows[3], rows[3]] + odd_rows(same)


def fine(v):
    return v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)


def integers(v):
    return np.floor(256 * np.array(v, np.float64)).astype(np.int64)


def check_whitening(spark, rows, most=4):
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    mine = [(r[0], integers(r[1])) for r in rows if fine(r[1])]
    fit = np.unique([x for _, x in mine], axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    kept = int((e[:most] > 1e-9 * e[0]).sum())
    assert len(got) == len(mine) * kept
    by = {}
    for r in got:
        by.setdefault((str(r["vec_id"]), int(r["deviation"])), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["n"] == n and r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
    sign = {}
    for i, x in mine:
        own = by[(str(i), int(((n * x - s) ** 2).sum()))]
        z = (n * x - s) / n @ u[:, :kept] / np.sqrt(e[:kept])
        for k in range(kept):
            value = own[k + 1][0]
            if abs(z[k]) > 1e-3:
                assert sign.setdefault(k, np.sign(value * z[k])) == np.sign(value * z[k])
            assert abs(value) == pytest.approx(abs(z[k]), abs=1e-8)
    return kept


def test_whitening(spark):
    assert check_whitening(spark, rows_of(1, 80, 40)) == 4


def test_whitening_of_dependent_dimensions(spark):
    rows = [(i, [a, 3.0, a, 2 * a, b, 0.0], 1, *EXTRA) for i, (a, b) in enumerate(np.random.default_rng(2).integers(-9, 9, (60, 2)).astype(float).tolist())]
    assert check_whitening(spark, rows) == 2
    assert check_whitening(spark, rows_of(3, 9, 0)[:3], 2) == 2  # fewer vectors than dimensions


def test_whitening_without_variance(spark):
    same = [(i, [1.0] * 6, 1, *EXTRA) for i in range(5)]
    for rows in (same, same[:1], odd_rows(None)[:4], []):
        out = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_badly_conditioned_rows_are_orthonormal_after_the_passes():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(500, 6)) * 10.0 ** np.arange(0, -12, -2)
    first = whitening.factor(rows.T @ rows, 500, shifted=True)
    y = whitening.solved(rows, first)
    for _ in range(3):
        y = whitening.solved(y, whitening.factor(y.T @ y, 500, shifted=False))
    assert np.abs(y.T @ y - np.eye(6)).max() < 1e-12


def test_large_components_are_exact(spark):
    rows = [(i, [c, -c, 1.0], 1) for i, c in enumerate([1e30, 3e12, 2.0**40, 5.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).where("component = 1").collect()
    clip = lambda c: max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * c)))
    x = [[clip(c) for c in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 10**38 else None for i, d in want.items()}
    assert vectors.products(np.array([[1 << 62, 1 << 62]]), np.array([8, 8]), 1 << 70).tolist() == [(1 << 63) - 1]


def expected_negatives(rows, asks, positives=5, negatives=10):
    mine = sorted({(r[0], r[2], tuple(integers(r[1]).tolist())) for r in rows if r[0] is not None and r[2] is not None and fine(r[1])})
    out = []
    for a, label, x in mine:
        if not asks(a):
            continue
        score = lambda v: sum(p * q for p, q in zip(v, x))
        ranked = sorted((-score(v), i, own) for i, own, v in mine)
        for s, p, _ in [r for r in ranked if r[2] == label and r[1] != a][:positives]:
            chosen = [r for r in ranked if r[2] != label and -30 * s <= -100 * r[0] <= -90 * s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(chosen)]
    return sorted(out)


@pytest.mark.parametrize("entries,anchors", [(8192, 2048), (16, 5)])
def test_hard_negatives(spark, monkeypatch, entries, anchors):
    monkeypatch.setattr(hn, "ENTRIES", entries)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    rows = rows_of(4, 150, 60)
    got = hn.mined(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 7 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = expected_negatives(rows, lambda i: i % 7 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_hard_negatives_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert hn.mined(make([]), F.lit(True)).count() == 0
    rows = [(i, v, i % 2, *EXTRA) for i, v in enumerate([[2.0] + [0.0] * 5, [1.0] + [0.0] * 5, [2.0, 1.0] + [0.0] * 4, [-1.0] + [0.0] * 5, [0.0] * 6, [1.0, 1.0] + [0.0] * 4])]
    assert sorted(map(tuple, hn.mined(make(rows), F.lit(True)).collect())) == expected_negatives(rows, lambda i: True)
    assert hn.mined(make(rows), F.lit(False)).count() == 0


def test_bounds_hold_every_score():
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (400, 8)) * (rng.random((400, 1)) < 0.95)
    x[:50] = x[50:100] * 3  # angles of zero
    x[100:120] = -x[50:70]
    norm = np.linalg.norm(x.astype(float), axis=1)
    angles = hn.angles_of(x.astype(float), norm, hn.directions_of(x.astype(float)))
    for i in range(0, 400, 7):
        down, up = hn.score_bounds(norm[i], angles[i], angles, angles, norm, norm)
        s = x @ x[i]
        assert (down <= s).all() and (s <= up).all()
        assert (up - down < 2 * norm[i] * norm + 4).all()
