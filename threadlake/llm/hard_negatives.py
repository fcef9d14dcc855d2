"""Hard negatives by angular triangle filtering.

Vectors are integers (``vectors``). Each has its norm and its angles to ``DIRECTIONS`` reference
directions stored with it. For an anchor a and a row v, the triangle inequality on the sphere
bounds their angle from each direction's two angles: |ta - tv| <= angle <= min(ta + tv,
2 pi - ta - tv); the tightest of all directions, as cosines times norms, widened by what rounding
can do, is an interval that holds the integer inner product. Two searches use it:

1. positives: an anchor's best rows of its own label. A row whose interval ends below the interval
   starts of enough others is not scored;
2. negatives: rows of other labels. Only those whose interval overlaps the score window of one of
   the anchor's positives are scored, in integers.

How it is spread: rows of equal label and vector are one entry with its smallest ids (so many as
any answer can need), so a vector that a third of all rows share is one entry. Entries are sorted
into cells by nearest direction and angle to it; a part is about ``ENTRIES`` entries of neighbouring
cells, a chunk about ``ANCHORS`` anchors. A task compares one part with one chunk. For each cell the
driver has the ranges of its norms and angles (at most ``DIRECTIONS`` times ``BANDS`` rows), so an
anchor goes only to parts where its windows can overlap, and a part is copied only for chunks with
such an anchor. The first search has no window yet, and compares all blocks; the tasks return the
few best of each. Vectors without direction structure give wide intervals; then nearly all is
scored, and results are the same.

The directions are fitted on at most ``SAMPLE`` vectors, drawn by hash; any choice of directions
gives the same result.

Edge cases: rows with a null id or label, or a vector that is null, empty, holds a null or
non-finite component or is of another length than the most frequent one, take no part. Rows that
repeat id, label and vector count once; a row is never its own positive, by id. A positive score
of zero allows only negative scores of zero, one below zero none. Anchors without a positive
or without any negative in the window have no rows. Scores beyond a long are its ends. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import Scratch
from threadlake.llm.vectors import largest, matrix, products, scaled, usual_size

DIRECTIONS, BANDS, SAMPLE = 8, 16, 20_000
ENTRIES, ANCHORS = 8192, 2048
ROUNDING = 1e-7  # of angles: arccos near its ends loses half the digits
LIST = pa.list_(pa.int64())
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def directions_of(sample: np.ndarray, most: int = DIRECTIONS, rounds: int = 8) -> np.ndarray:
    """Unit vectors: spherical k-means from a farthest-first start."""
    norm = np.linalg.norm(sample, axis=1)
    v = sample[norm > 0] / norm[norm > 0, None]
    if not len(v):
        return np.eye(1, sample.shape[1])
    picked = [0]
    near = v @ v[0]
    while len(picked) < most and near.min() < 1 - 1e-9:
        picked.append(int(near.argmin()))
        near = np.maximum(near, v @ v[picked[-1]])
    out = v[picked]
    for _ in range(rounds):
        own = (v @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), out)
    return out


def angles_of(x: np.ndarray, norm: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles to each direction; a zero vector has none, any value is right."""
    return np.arccos(np.clip(x @ directions.T / np.where(norm > 0, norm, 1)[:, None], -1, 1))


def _stored(size: int, directions: np.ndarray):
    def emit(batches):
        for batch in batches:
            x = matrix(batch.column("x"), size).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            angles = angles_of(x, norm, directions)
            near = angles.argmin(axis=1)
            band = np.minimum(angles[np.arange(len(x)), near] * (BANDS / math.pi), BANDS - 1).astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, angles.size + 1, angles.shape[1], dtype=np.int32)), pa.array(angles.ravel()))
            yield pa.record_batch([*batch.columns, pa.array(norm), flat, pa.array(near * BANDS + band)], [*batch.schema.names, "norm", "angles", "cell"])
    return emit


def score_bounds(norm: float, angles: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of one vector with others whose angles lie in [low, high] and
    norms in [least, most] (rows of others, columns of directions)."""
    closest = np.maximum(low - angles, angles - high).max(axis=1, initial=0.0) - ROUNDING
    sums = np.minimum(angles + high, 2 * math.pi - (angles + low))
    farthest = np.minimum(sums.min(axis=1, initial=math.pi), math.pi) + ROUNDING
    up, down = np.cos(np.clip(closest, 0, math.pi)), np.cos(np.clip(farthest, 0, math.pi))
    up, down = norm * np.where(up > 0, up * most, up * least), norm * np.where(down < 0, down * most, down * least)
    slack = 1 + 1e-9 * norm * most
    return np.floor(down - slack), np.ceil(up + slack)


def best_entries(scores: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((first[near], -scores[near]))[:k]]
    return np.lexsort((first, -scores))


class Part:
    """Entries in order of their label."""

    def __init__(self, table: pa.Table, size: int):
        label = table.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        column = lambda name: table.column(name).combine_chunks()
        self.label, self.size = label[order], size
        self.x = matrix(column("x"), size)[order]
        self.norm = table.column("norm").to_numpy()[order]
        angles = column("angles")
        self.angles = matrix(angles, len(angles[0]))[order]
        ids = column("ids")
        self.ids = [ids[i].as_py() for i in order.tolist()]
        self.first = np.array([i[0] for i in self.ids], np.int64)
        self.most = largest(self.x)

    def same(self, label: int) -> np.ndarray:
        return np.arange(np.searchsorted(self.label, label), np.searchsorted(self.label, label, "right"))

    def other(self, label: int) -> np.ndarray:
        return np.concatenate([np.arange(np.searchsorted(self.label, label)), np.arange(np.searchsorted(self.label, label, "right"), len(self.label))])

    def bounds(self, at: np.ndarray, norm: float, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return score_bounds(norm, angles, self.angles[at], self.angles[at], self.norm[at], self.norm[at])

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return products(self.x[at], x, self.size * self.most * largest(x))


def _answers(rows: list[tuple]) -> pa.Table:
    query, window, score, ids = zip(*rows) if rows else ((),) * 4
    return pa.table([pa.array(query, pa.int64()), pa.array(window, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, LIST)], ["query", "positive_score", "score", "ids"])


ANSWER = "query bigint, positive_score bigint, score bigint, ids array<bigint>"


def _compare(size: int, k: int, windows: tuple[int, int] | None):
    """Best entries of a part for a chunk's anchors: of the own label, or, with ``windows`` (percent
    of the positive score, least and most), of other labels in each window."""
    def compare(entries: pa.Table, anchors: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if entries.num_rows and anchors.num_rows:
            part = Part(entries, size)
            xs, angles = (anchors.column(c).combine_chunks() for c in ("x", "angles"))
            xs, angles = matrix(xs, size), matrix(angles, len(angles[0]))
            keys, labels, norms = (anchors.column(c).to_pylist() for c in ("key", "label", "norm"))
            wanted = anchors.column("scores").to_pylist() if windows else None
            for i, key in enumerate(keys):
                at = part.other(labels[i]) if windows else part.same(labels[i])
                if not len(at):
                    continue
                down, up = part.bounds(at, norms[i], angles[i])
                if not windows:
                    if len(at) > k:  # k entries surely score this much
                        at = at[up >= np.partition(down, len(down) - k)[len(down) - k]]
                    score = part.scores(at, xs[i])
                    rows += [(key, None, int(score[b]), part.ids[at[b]]) for b in best_entries(score, part.first[at], k).tolist()]
                    continue
                spans = [(s, -(-windows[0] * s // 100), windows[1] * s // 100) for s in wanted[i]]
                open_ = np.zeros(len(at), bool)
                for _, least, most in spans:
                    if least <= most:
                        open_ |= (up >= least) & (down <= most)
                at = at[open_]
                score = part.scores(at, xs[i])
                for positive, least, most in spans:
                    inside = np.flatnonzero((score >= least) & (score <= most))
                    best = inside[best_entries(score[inside], part.first[at[inside]], k)]
                    rows += [(key, positive, int(score[b]), part.ids[at[b]]) for b in best.tolist()]
        return _answers(rows)
    return compare


class Cells:
    """How cells are dealt into parts or chunks, and what is known of their entries."""

    def __init__(self, counts: dict[int, int], most: int):
        self.first, self.blocks, number, held = {}, {}, 0, 0
        for cell in sorted(counts):
            n = counts[cell]
            if held and held + n > most:
                number, held = number + 1, 0
            self.first[cell], self.blocks[cell] = number, max(1, math.ceil(n / most))
            held += n
            if self.blocks[cell] > 1:
                number, held = number + self.blocks[cell], 0
        self.number = 1 + max((self.first[c] + self.blocks[c] - 1 for c in counts), default=0)

    def column(self) -> Column:
        """The number of a row's part or chunk, by its cell and key."""
        at = F.create_map(*(F.lit(v) for c in self.first for v in (c, F.struct(F.lit(self.first[c]).alias("first"), F.lit(self.blocks[c]).alias("blocks")))))[F.col("cell").cast("int")]
        return (at["first"] + F.pmod(F.xxhash64("key"), at["blocks"])).cast("int")


def _visits(ranges: dict[str, np.ndarray], parts: Cells, windows: tuple[int, int]):
    """(part, chunk) pairs in which an anchor's windows can overlap a cell's scores."""
    def emit(batches):
        for batch in batches:
            pairs = set()
            angles = batch.column("angles")
            angles = matrix(angles, len(angles[0])) if len(angles) else None
            for i, (chunk, norm, scores) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk", "norm", "scores")))):
                down, up = score_bounds(norm, angles[i], ranges["low"], ranges["high"], ranges["least"], ranges["most"])
                open_ = np.zeros(len(up), bool)
                for s in scores:
                    least, most = -(-windows[0] * s // 100), windows[1] * s // 100
                    if least <= most:
                        open_ |= (up >= least) & (down <= most)
                for cell in ranges["cell"][open_].tolist():
                    pairs |= {(parts.first[cell] + b, chunk) for b in range(parts.blocks[cell])}
            part, chunk = zip(*sorted(pairs)) if pairs else ((), ())
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(chunk, pa.int32())], ["part", "chunk"])
    return emit


def _few(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """The k best ids of each group; Spark limits the groups before it shuffles them."""
    best = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def mined(vectors: DataFrame, is_anchor: Column, *, label: Column | str = "label", id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, windows: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row
    with ``is_anchor`` and each of its best ``positives`` rows of the same label, the best
    ``negatives`` rows of other labels that score between ``windows`` percent of the positive's score."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), scaled(F.col(vector_col), scale).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = scratch.write(rows.where("id is not null and label is not null and x is not null").groupBy("id", "label", "x").agg(F.max("asks").alias("asks")), "rows")
    size = usual_size(rows, "x")
    if size is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("x") == size)
    k = max(positives + 1, negatives)
    place = F.row_number().over(Window.partitionBy("label", "x").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k)
    entries = few.groupBy("label", "x").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("key", F.monotonically_increasing_id())
    entries = scratch.write(entries, "entries")
    sample = np.array([r["x"] for r in entries.orderBy(F.xxhash64("x"), "key").limit(SAMPLE).select("x").collect()], np.float64)
    stored = _stored(size, directions_of(sample))
    entries = scratch.write(entries.mapInArrow(stored, "label bigint, x array<bigint>, ids array<bigint>, key bigint, norm double, angles array<double>, cell bigint"), "stored")
    width = len(entries.select("angles").first()["angles"])
    ranges = entries.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"),
        F.array(*(F.min(F.col("angles")[i]) for i in range(width))).alias("low"), F.array(*(F.max(F.col("angles")[i]) for i in range(width))).alias("high")).orderBy("cell").collect()
    parts = Cells({r["cell"]: r["n"] for r in ranges}, ENTRIES)
    ranges = {c: np.array([r[c] for r in ranges]) for c in ("cell", "least", "most", "low", "high")}
    anchors = scratch.write(rows.where("asks").join(entries.select("label", "x", "key"), ["label", "x"]).select("id", "key"), "anchors")
    asked = scratch.write(entries.join(anchors.select("key").distinct(), "key", "left_semi").select("key", "label", "x", "norm", "angles", "cell"), "asked")
    chunks = Cells({r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}, ANCHORS)
    if not chunks.first:
        return spark.createDataFrame([], RESULT)
    entries, asked = entries.withColumn("part", parts.column()), asked.withColumn("chunk", chunks.column())

    def compared(pairs: DataFrame, queries: DataFrame, k: int, windows: tuple[int, int] | None) -> DataFrame:
        one = entries.select("part", "label", "x", "ids", "norm", "angles").join(pairs, "part")
        two = queries.join(pairs, "chunk")
        return one.groupBy("part", "chunk").cogroup(two.groupBy("part", "chunk")).applyInArrow(_compare(size, k, windows), ANSWER)

    numbers = lambda n, name: spark.range(n).select(F.col("id").cast("int").alias(name))
    # All numbers of parts and chunks, not rows: blocks of the stated anchors against all entries.
    every = numbers(parts.number, "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks.number - 1))))
    found = compared(every, asked, positives + 1, None).select("query", "score", F.explode("ids").alias("id"))
    near = _few(found, ["query"], positives + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("near"))
    near = scratch.write(near, "near")
    wanted = near.select(F.col("query").alias("key"), F.array_distinct(F.transform("near", lambda e: e["score"])).alias("scores"))
    queries = scratch.write(asked.join(wanted, "key"), "queries")
    pairs = scratch.write(queries.mapInArrow(_visits(ranges, parts, windows), "part int, chunk int").distinct(), "pairs")
    found = compared(pairs, queries, negatives, windows).select("query", "positive_score", "score", F.explode("ids").alias("id"))
    found = scratch.write(_few(found, ["query", "positive_score"], negatives).select("query", "positive_score", "place", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "found")
    own = anchors.join(near.withColumnRenamed("query", "key"), "key")
    best = F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, positives)
    own = own.select(F.col("id").alias("anchor_id"), "key", F.explode(best).alias("p"))
    own = own.select("anchor_id", F.col("key").alias("query"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return own.join(found, ["query", "positive_score"]).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
