"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves; each half is quantised with its own codebook, so K + K centroids
make K * K cells. A query visits cells
in order of the summed nearness of their two centroids (largest inner product; a heap walks the
pairs of the two sorted lists) until the cells hold ``share`` of the different vectors. Their
entries are ranked by the exact inner product in double precision.

* The share is a parameter. The default suits vectors without any cluster structure, where a
  smaller share loses recall whatever the codebooks are; clustered vectors need far less.
* The codebooks are fitted on a sample of at most ``SAMPLE`` vectors, drawn by hash; every vector
  is indexed.
* Equal vectors are one entry with its k + 1 smallest ids: with ties going to the smaller id no
  other id of the group can be among a query's k nearest. So a vector that a third of all rows
  share is one entry, and one search answers all queries that share a vector.
* Cells are dealt into parts of about ``BLOCK`` entries; a cell with more is split into blocks
  over several parts. Queries are dealt by their nearest cell into chunks of about ``BLOCK`` in the
  same way, so those of a chunk visit much the same cells, and there are as many chunks as the
  queries fill, however many partitions Spark makes. They go, with the cells they visit, to the
  parts; a part goes to the chunks that visit one of its cells, and to no other. A task ranks one
  part for one chunk. No entry is left out.
* Only the codebooks and the cell counts (``MOST_CENTROIDS`` squared at most) reach the driver.

Edge cases: vectors that are null, all zero or hold a null or non-finite component take no part,
nor do vectors of another length than the most frequent one, nor rows with a null id. Rows that
repeat an id with the same vector count once; a query is never its own neighbour, by id. Fewer
candidates than k: all of them. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import Scratch

SAMPLE = 20_000
MOST_CENTROIDS = 64
ENTRIES_PER_CELL = 2.5  # at least, on average
BLOCK = 4096  # entries of a part, queries of a chunk
WALKS = 256  # queries whose cells one task finds
SHARE = 0.45
LEAST = 1000  # entries that a query visits at least


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def fit(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Codebook of one half by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    book = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = nearest(points, book)
        sums = np.zeros_like(book)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(book))[:, None]
        book = np.where(n > 0, sums / np.maximum(n, 1), book)
    return book


def nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), 4096):
        p = points[at:at + 4096]
        out[at:at + 4096] = np.argmin((book**2).sum(1) - 2 * p @ book.T, axis=1)
    return out


def visited(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, candidates: int) -> list[int]:
    """Cells in order of the summed inner products of query halves and centroids, until they hold
    enough entries."""
    half, k = len(books[0][0]), len(books[1])
    scores = (books[0] @ query[:half], books[1] @ query[half:])
    order = [np.argsort(-s, kind="stable") for s in scores]
    a, b = (s[o] for s, o in zip(scores, order))
    heap, seen, out, found = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}, [], 0
    while heap and found < candidates:
        _, i, j = heapq.heappop(heap)
        cell = int(order[0][i]) * k + int(order[1][j])
        if counts[cell]:
            out.append(cell)
            found += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[x] + b[y]), x, y))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _assign(books):
    half = len(books[0][0])

    def assign(frames):
        for pdf in frames:
            if len(pdf):
                v = _matrix(pdf["vector"])
                yield pdf.assign(cell=nearest(v[:, :half], books[0]) * len(books[1]) + nearest(v[:, half:], books[1]))
    return assign


def deal(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """By cell its first part and its number of parts, and the number of all: neighbouring cells
    share a part of about ``BLOCK`` entries, a larger cell has parts of its own. Queries are dealt
    into chunks alike."""
    first, blocks = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // BLOCK))
    part, held = 0, 0
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if held and held + n > BLOCK:
            part, held = part + 1, 0
        first[cell], held = part, held + n
        if blocks[cell] > 1:
            part, held = part + int(blocks[cell]), 0
    return first, blocks, part + 1


def _nearest_cell(books):
    half = len(books[0][0])

    def find(frames):
        for pdf in frames:
            if len(pdf):
                v = _matrix(pdf["vector"])
                yield pdf.assign(first=(v[:, :half] @ books[0].T).argmax(axis=1) * len(books[1]) + (v[:, half:] @ books[1].T).argmax(axis=1))
    return find


def _counts(rows: DataFrame, cell: str, cells: int) -> np.ndarray:
    counts = np.zeros(cells, np.int64)
    for r in rows.groupBy(cell).count().collect():
        counts[r[cell]] = r["count"]
    return counts


def _visit(books, counts, asked, wanted):
    first, blocks, _ = deal(counts)
    lead, shares, _ = deal(asked)

    def visit(frames):
        for pdf in frames:
            rows, own = [], pdf["first"].to_numpy()
            chunks = lead[own] + pdf["key"].to_numpy() % shares[own]
            for key, vector, chunk in zip(pdf["key"].tolist(), pdf["vector"].tolist(), chunks.tolist()):
                cells = np.array(visited(np.array(vector, np.float64), books, counts, wanted), np.int64)
                cell = np.repeat(cells, blocks[cells])
                block = np.arange(len(cell)) - np.repeat(np.cumsum(blocks[cells]) - blocks[cells], blocks[cells])
                part = first[cell] + block
                order = np.argsort(part, kind="stable")
                for p in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    if len(p):
                        rows.append((key, vector, int(part[p[0]]), chunk, np.unique(cell[p]).tolist()))
            yield pd.DataFrame(rows, columns=["query", "asked", "part", "chunk", "cells"])
    return visit


def _rank(k: int):
    def rank(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        query, score, ids = [], [], []
        if len(entries):
            e, cell = _matrix(entries["vector"]), entries["cell"].to_numpy()
            own, first = entries["ids"].to_numpy(), entries["ids"].str[0].to_numpy()
            for key, asked, cells in zip(queries["query"].tolist(), queries["asked"], queries["cells"]):
                at = np.flatnonzero(np.isin(cell, cells))
                # Summed per pair in one fixed order: equal vectors get equal scores.
                s = (e[at] * np.asarray(asked, np.float64)).sum(axis=1)
                if len(s) > k + 1:
                    near = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1])
                    at, s = at[near], s[near]
                top = np.lexsort((first[at], -s))[:k + 1]
                query += [key] * len(top)
                score += s[top].tolist()
                ids += own[at[top]].tolist()
        return pd.DataFrame({"query": query, "score": score, "ids": ids})
    return rank


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, share: float = SHARE) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest found of each row with ``is_query``
    among all rows but its own."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return spark.createDataFrame([], empty)
    rows = scratch.write(rows.where(F.size("vector") == size["size"]).groupBy("id", "vector").agg(F.max("asks").alias("asks")), "rows")
    # The k + 1 smallest ids of each vector; Spark limits the groups before it shuffles them.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    entries = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("key", F.monotonically_increasing_id())
    entries = scratch.write(entries, "entries")
    n, half = entries.count(), size["size"] // 2
    sample = np.array([r["vector"] for r in entries.orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").collect()], np.float64)
    centroids = min(MOST_CENTROIDS, max(1, round(math.sqrt(n / ENTRIES_PER_CELL))), len(sample))
    books = (fit(sample[:, :half], centroids), fit(sample[:, half:], centroids))
    entries = scratch.write(entries.mapInPandas(_assign(books), "vector array<double>, ids array<bigint>, key bigint, cell bigint"), "assigned")
    counts = _counts(entries, "cell", centroids**2)
    askers = scratch.write(rows.where("asks").join(entries.select("vector", "key"), "vector").select("id", "key"), "askers")
    asked = scratch.write(entries.join(askers.select("key").distinct(), "key", "left_semi").select("key", "vector"), "asked")
    tasks = max(1, math.ceil(asked.count() / WALKS))
    asked = scratch.write(asked.mapInPandas(_nearest_cell(books), "key bigint, vector array<double>, first bigint"), "near")
    wanted = max(LEAST, math.ceil(share * n))
    walk = _visit(books, counts, _counts(asked, "first", len(counts)), wanted)
    visits = asked.repartition(tasks, "key").mapInPandas(walk, "query bigint, asked array<double>, part bigint, chunk bigint, cells array<bigint>")
    visits = scratch.write(visits, "visits")
    meet = scratch.write(visits.select("part", "chunk").distinct(), "meet")
    first, blocks, _ = deal(counts)
    split = spark.createDataFrame([(c, int(first[c]), int(blocks[c])) for c in np.flatnonzero(counts).tolist()], "cell bigint, first bigint, blocks bigint")
    part = F.col("first") + F.pmod(F.xxhash64("key"), F.col("blocks"))
    dealt = entries.join(split, "cell").select("cell", "vector", "ids", part.alias("part")).join(meet, "part")
    ranked = dealt.groupBy("part", "chunk").cogroup(visits.groupBy("part", "chunk")).applyInPandas(_rank(k), "query bigint, score double, ids array<bigint>")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = ranked.select("query", "score", F.explode("ids").alias("id")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    top = scratch.write(top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("top")), "top")
    own = askers.join(top, askers["key"] == top["query"]).select("id", "top")
    others = own.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("top", lambda x: x["id"] != F.col("id")), 1, k)).alias("at", "x"))
    return others.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
