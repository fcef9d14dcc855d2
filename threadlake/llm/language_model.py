"""Language-model scores from a probabilistic suffix tree over words.

The tree's nodes are contexts of up to ``depth`` words. The root is the smoothed distribution of
words. A context is retained if it occurs ``LEAST`` times or more, its suffix (itself without its
first word) is retained, and its next-word distribution diverges from the suffix's: the gain in log
probability, each occurrence predicted with itself left out, is over ``MARGIN`` a token. A
retained context gives a next word seen twice or more its discounted share, and all other mass
to the suffix's distribution, so each distribution sums to one:

    P(w | c) = (n(c, w) - DISCOUNT)+ / N(c) + a(c) P(w | suffix of c)

A token is scored in the longest retained context that ends before it. By the recursion the
logarithm is a sum over the lengths of its contexts: log a(c) for each retained one, and for a word
seen there also the difference to log a(c) + log P(w | suffix). So a text's score is a sum over its
n-grams of one number each, and scoring is two group-bys for each length: positions meet the
tree's n-grams by parts of the keys, then sums by document. No task holds the tree.

How it is spread: words are 64-bit hashes (``words``), an n-gram's key is made of those of its two
shorter n-grams; texts are hashed once and written. N-grams are counted in the tasks, then in
Spark by parts of the keys, whose number follows the training tokens (``PART``). A task sends each
part sorted blocks of n-grams, not a row for each: sorted keys share most of their bits, and those
of the most frequent words and contexts are numbers, so an n-gram takes a few bytes of shuffle.
What occurs once is summed up as mass and not stored. For the scores, positions and the tree's
n-grams meet in the same way. Bounded things are sent to all tasks: bitmaps of 2**27 bits, which
keep n-grams that the tree cannot have from being shuffled (false hits are only extra work), the
hashes of the words and contexts that go by number (``NUMBERS`` at most), and the most frequent
n-grams of a length with what they add (``HOT`` at most), so a hot n-gram never meets one task.
Everything else is shuffled, whatever its size. All training texts are counted, so the tree grows
with the corpus.

Edge cases: a null or empty text has one token, its end. Rows with equal or null ids are separate
documents; null ids are learnt from. With nothing to learn each token is the one unknown word and
has probability 1. Contexts do not reach over the start of a text. Extra columns are ignored.
N-grams are told apart by 64-bit keys alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import Scratch, binary_parts
from threadlake.llm.words import U, mix, word_hashes, word_spans

DEPTH, LEAST, DISCOUNT, MARGIN = 2, 16, 0.5, 0.005  # MARGIN: in log10
HOT = 1 << 18
SLOTS = 1 << 21  # 64-bit words of a bitmap
BLOCK = 1 << 22  # bytes of text, or of hashed text, that are worked on together
TOGETHER = 3 << 19  # n-grams that are counted together
NUMBERS = 1 << 20  # words, and contexts of two words, that go by number
PART = 1 << 21  # training tokens whose pairs one part of a shuffle has, about
END = U(0x27BB2EE687B0B0FD)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def joined_key(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of an n-gram from those of its first and its last n - 1 words."""
    return mix(prefix * U(0x9E3779B97F4A7C15) + suffix)


def _stretches(offsets: np.ndarray):
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1))
        yield at, to
        at = to


def _hashed(batches):
    """Documents as lists of word hashes with the end's."""
    for batch in batches:
        buf, offsets = binary_parts(batch.column("text"))
        for at, to in _stretches(offsets):
            part, bounds = LOWER[buf[offsets[at]:offsets[to]]], offsets[at:to + 1] - offsets[at]
            starts, ends, words = word_spans(part, bounds)
            w = np.insert(word_hashes(part, starts, ends), words[1:], END)
            cuts = words + np.arange(to - at + 1)
            tokens = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), _signed(w))
            rows = batch.slice(at, to - at)
            yield pa.record_batch([*(rows.column(c) for c in ("row", "doc", "held_out")), pa.array(np.diff(cuts)), tokens], ["row", "doc", "held_out", "n_tokens", "tokens"])


class Bitmap:
    """Which keys may be among some keys: those whose last 27 bits are."""

    def __init__(self, keys: DataFrame, scratch: Scratch):
        slot, bit = F.expr(f"shiftright(key & {64 * SLOTS - 1}, 6)").alias("slot"), F.expr("shiftleft(1L, cast(key & 63 as int))")
        found = keys.groupBy(slot).agg(F.bit_or(bit).alias("bits")).toArrow()
        self.bits = np.zeros(SLOTS, U)
        self.bits[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(U)
        scratch.release()

    def __or__(self, other: Bitmap) -> Bitmap:
        both = Bitmap.__new__(Bitmap)
        both.bits = self.bits | other.bits
        return both

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        return (self.bits[((keys & U(64 * SLOTS - 1)) >> U(6)).astype(np.int64)] >> (keys & U(63))) & U(1) == 1


def _grams(batch: pa.RecordBatch, length: int):
    """For stretches of documents: first row, its number of rows, keys of n-grams, their
    document's place and their last word."""
    lists = batch.column("tokens")
    flat, offsets = lists.flatten().to_numpy().view(U), lists.offsets.to_numpy().astype(np.int64)
    offsets = 8 * (offsets - offsets[0])
    for at, to in _stretches(offsets):
        keys = words = flat[offsets[at] // 8:offsets[to] // 8]
        doc = np.repeat(np.arange(to - at), np.diff(offsets[at:to + 1]) // 8)
        for _ in range(length - 1):
            keys = joined_key(keys[:-1], keys[1:])
        inside = doc[:len(keys)] == doc[len(doc) - len(keys):]
        yield at, to - at, keys[inside], doc[:len(keys)][inside], words[len(words) - len(keys):][inside]


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, the low ones first, so that what they share costs nothing."""
    planes = np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(U).ravel()


BLOCKS = "part bigint, chunk bigint, kind int, n int, keys binary, numbers array<binary>"
BLOCK_SCHEMA = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("numbers", pa.list_(pa.binary()))])


def _blocks(kind: int, part: np.ndarray, keys: np.ndarray, *numbers: np.ndarray, chunk: int = 0) -> pa.RecordBatch:
    """One row for each part of some rows that are sorted by part and, in a part, by key. The keys
    are kept as differences: sorted 64-bit keys share most of what their high bits say."""
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        steps = keys[a:b].copy()
        steps[1:] -= keys[a:b - 1]
        rows.append({"part": int(part[a]), "chunk": chunk, "kind": kind, "n": b - a, "keys": _packed(steps), "numbers": [_packed(x[a:b]) for x in numbers]})
    return pa.RecordBatch.from_pylist(rows, BLOCK_SCHEMA)


def _of_kind(table: pa.Table, kind: int) -> list[dict]:
    return table.filter(pc.equal(table.column("kind"), kind)).to_pylist()


def _rows(table: pa.Table, kind: int, columns: int) -> list[np.ndarray]:
    """Keys and numbers of the blocks of a kind, one block after the other."""
    found = [[np.zeros(0, U)] for _ in range(columns + 1)]
    for r in _of_kind(table, kind):
        found[0].append(np.cumsum(_unpacked(r["keys"], r["n"]), dtype=U))
        for mine, x in zip(found[1:], r["numbers"], strict=True):
            mine.append(_unpacked(x, r["n"]))
    return [np.concatenate(x) for x in found]


def _word_counts(batches):
    """Counts of words. Some millions of them are counted together."""
    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(found)
        found.clear()
        key, n = np.unique(keys, return_counts=True)
        return pa.record_batch([_signed(key), pa.array(n)], ["key", "n"])

    found, size = [], 0
    for batch in batches:
        for _, _, keys, _, _ in _grams(batch, 1):
            found.append(keys)
            size += len(keys)
            if size > TOGETHER:
                yield counted(found)
                size = 0
    if size:
        yield counted(found)


def _places(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are among some sorted ones, and which are there."""
    if not len(among):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return place, among[place] == keys


def _summed(keys: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, the first place of each, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], order[first], *(np.add.reduceat(x[order], first) if len(first) else x[:0] for x in numbers)


def _pairs(length: int, parts: int, candidates: Bitmap, ends: Bitmap | None, contexts: np.ndarray, words: np.ndarray):
    """Counts of contexts of ``length`` words with the n-grams of the same length that end one word
    later, in blocks. Some millions of n-grams are counted together. One of the frequent
    ``contexts`` with one of the frequent ``words`` goes by their two numbers (kind 0), which are
    far fewer bytes to shuffle than two hashes (kind 1)."""
    def counted(found: list[tuple[np.ndarray, ...]]):
        columns = [np.concatenate(x) for x in zip(*found)]
        found.clear()  # its memory is for the sort
        first, n = np.unique(joined_key(*columns[:2]), return_index=True, return_counts=True)[1:]
        for i in range(len(columns)):
            columns[i] = columns[i][first]
        context, low, word = columns[0], columns[1], columns[-1]
        (one, a), (two, b) = _places(contexts, context), _places(words, word)
        short = a & b
        pair, its = (one * NUMBERS + two)[short].astype(U), n[short]
        order = np.argsort(pair)
        pair, its = pair[order], its[order]
        part = mix(pair) & U(parts - 1)
        order = np.argsort(part.astype(np.uint16), kind="stable")
        yield _blocks(0, part[order], pair[order], its[order])
        context, low, its = context[~short], low[~short], n[~short]
        part = mix(context + low) & U(parts - 1)
        order = np.lexsort((context, part))
        yield _blocks(1, part[order], context[order], low[order], its[order])

    def emit(batches):
        found, size = [], 0
        for batch in batches:
            for _, _, keys, doc, word in _grams(batch, length):
                if len(keys):
                    inside = (doc[1:] == doc[:-1]) & candidates.may_have(keys[:-1])
                    inside = np.flatnonzero(inside & ends.may_have(keys[1:]) if ends else inside)
                    # Of words, the second n-gram is the word.
                    found.append((keys[inside], keys[inside + 1], *([word[inside + 1]] if length > 1 else [])))
                    size += len(inside)
                if size > TOGETHER:
                    yield from counted(found)
                    size = 0
        if size:
            yield from counted(found)
    return emit


def _repeated(contexts: np.ndarray, suffixes: np.ndarray | None, words: np.ndarray):
    """The pairs of a part that occur twice or more, with the hashes that their numbers stand for.
    ``suffixes`` are the contexts without their first word, if they have more."""
    def emit(table: pa.Table) -> pa.Table:
        pair, _, its = _summed(*_rows(table, 0, 1))
        twice = its > 1
        pair, its = pair[twice].astype(np.int64), its[twice]
        context, low = contexts[pair // NUMBERS], words[pair % NUMBERS]
        if suffixes is not None:
            low = joined_key(suffixes[pair // NUMBERS], low)
        context1, low1, n1 = _rows(table, 1, 2)
        _, first, n1 = _summed(joined_key(context1, low1), n1)
        first, n1 = first[n1 > 1], n1[n1 > 1]
        columns = [np.concatenate(x) for x in ((context, context1[first]), (low, low1[first]), (its, n1))]
        return pa.table([_signed(x) for x in columns], ["context", "low", "n"])
    return emit


def _longer(batches):
    """The key of each (context, low), and low, which is that without its first word."""
    for batch in batches:
        context, low = (batch.column(c).to_numpy().view(U) for c in ("context", "low"))
        yield pa.record_batch([_signed(joined_key(context, low)), batch.column("low"), batch.column("n")], ["key", "suffix", "n"])


def _seen(batches):
    """N-grams with a retained context: what they add to the score beyond log a of the context,
    and their log probability."""
    for batch in batches:
        context, low = (batch.column(c).to_numpy().view(U) for c in ("context", "low"))
        n, total, share, below = (batch.column(c).to_numpy().astype(float) for c in ("n", "total", "share", "lp"))
        lp = np.log10((n - DISCOUNT) / total + share * 10.0**below)
        yield pa.record_batch([_signed(joined_key(context, low)), batch.column("n"), pa.array(lp - below - np.log10(share)), pa.array(lp)], ["key", "n", "v", "lp"])


def most_frequent(rows: DataFrame, most: int) -> pa.Table:
    """Rows of the largest ``n``: as many whole classes of about equal n as have ``most`` rows together."""
    size = F.floor(F.log2(F.col("n")) * 8)
    left, least = most, None
    for r in sorted(rows.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["size"]
    return rows.where(size >= least if least is not None else F.lit(False)).toArrow()


class Tree:
    """Number of training tokens and, by length of n-gram, the rows (key, n, v) of written tables:
    what each occurrence of the n-gram adds to the score. Those of words also have what it adds to
    n_known and the base score (known, base). ``members`` are the keys of each length but one's,
    ``tables`` the names of the tables behind each."""

    def __init__(self, tokens: DataFrame, scratch: Scratch, depth: int = DEPTH):
        train = tokens.where("not held_out").select("tokens")
        words = train.mapInArrow(_word_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        words = scratch.write(words, "words")
        total = words.agg(F.sum("n"), F.count("*")).first()
        self.tokens, self.depth = total[0] or 0, depth
        self.scale = math.log10(self.tokens + 0.5 * (total[1] + 1))
        parts = _parts(self.tokens, PART)
        frequent = numbered = np.sort(most_frequent(words, NUMBERS).column("key").to_numpy().view(U))
        one = words.select("key", "n", F.lit(1).alias("known"), F.log10(F.col("n") + 0.5).alias("base"), F.lit(0.0).alias("v"))
        below = words.select("key", (F.log10(F.col("n") + 0.5) - self.scale).alias("lp"))
        contexts, levels, members, tables = words.where(F.col("n") >= LEAST), [one], [None], [["words"]]
        for length in range(1, depth + 1):
            # An n-gram of the tree ends in one of the tree. (Of words, nearly all are.)
            ends = Bitmap(below, scratch) if length > 1 else None
            suffixes = None
            if length > 1:
                # A longer context's suffix and a word do not name the pair's second n-gram.
                top = most_frequent(contexts, NUMBERS if length == 2 else 0)
                frequent, order = np.unique(top.column("key").to_numpy().view(U), return_index=True)
                suffixes = top.column("suffix").to_numpy().view(U)[order]
            pairs = train.mapInArrow(_pairs(length, parts, Bitmap(contexts, scratch), ends, frequent, numbered), BLOCKS)
            pairs = pairs.groupBy("part").applyInArrow(_repeated(frequent, suffixes, numbered), "context bigint, low bigint, n bigint")
            pairs = scratch.write(pairs, f"pairs{length}")
            judged = scratch.write(pairs.join(below.withColumnRenamed("key", "low"), "low"), f"judged{length}")
            kept = scratch.write(self._retained(judged, contexts), f"kept{length}")
            seen = judged.join(kept.hint("shuffle_hash"), "context").mapInArrow(_seen, "key bigint, n bigint, v double, lp double")
            seen = scratch.write(seen, f"seen{length}")
            contexts = scratch.write(judged.where(F.col("n") >= LEAST).select("context", "low", "n").mapInArrow(_longer, "key bigint, suffix bigint, n bigint"), f"contexts{length + 1}")
            scratch.drop(f"pairs{length}", f"judged{length}")
            shares = kept.select(F.col("context").alias("key"), F.col("total").alias("n"), F.log10("share").alias("v"))
            if length == 1:
                shares = shares.withColumns({"known": F.lit(0), "base": F.lit(0.0)})
            else:
                members.append(ends | Bitmap(shares, scratch))
            levels[-1] = levels[-1].unionByName(shares)
            levels.append(seen.select("key", "n", "v"))
            tables[-1].append(f"kept{length}")
            tables.append([f"seen{length}"])
            below = seen.select("key", "lp")
            scratch.drop(f"contexts{length}")
        scratch.drop(f"contexts{depth + 1}")
        if depth:
            members.append(Bitmap(below, scratch))
        self.levels, self.members, self.tables = levels, members, tables

    @staticmethod
    def _retained(judged: DataFrame, contexts: DataFrame) -> DataFrame:
        """(context, total, share): the contexts that pass the divergence test."""
        n = F.col("n")
        own = judged.groupBy("context").agg(F.sum("n").alias("often"), F.count("*").alias("words"), F.sum(n * (F.log10(n - 1 - DISCOUNT) - F.col("lp"))).alias("gain"))
        own = own.join(contexts.select(F.col("key").alias("context"), F.col("n").alias("total")), "context")
        own = own.withColumn("share", (DISCOUNT * F.col("words") + F.col("total") - F.col("often")) / F.col("total"))
        gain = F.col("gain") - F.col("often") * F.log10(F.col("total") - 1) + (F.col("total") - F.col("often")) * F.log10("share")
        return own.where(gain > MARGIN * F.col("total")).select("context", "total", "share")


def _positions(length: int, parts: int, hot: dict[str, np.ndarray], members: Bitmap | None):
    """The n-grams of all documents, in blocks: keys with their rows (kind 1), but hot ones as one
    row of sums for each document (kind 2)."""
    of = [c for c in hot if c != "key"]

    def dealt(found: list[tuple[np.ndarray, ...]]):
        keys, rows, own, *sums = map(np.concatenate, zip(*found))
        found.clear()
        order = np.argsort(keys)
        keys, chunk = keys[order], int(own.view(np.int64)[0])
        yield _blocks(1, _part(keys, parts), keys, rows[order], chunk=chunk)
        # Sums go to any part; no n-gram is looked up for them.
        yield _blocks(2, np.full(len(own), int(mix(own[:1])[0] & U(parts - 1))), own, *sums, chunk=chunk)

    def emit(batches):
        found, size = [], 0
        for batch in batches:
            row = batch.column("row").to_numpy().view(U)
            for at, n, keys, doc, _ in _grams(batch, length):
                if members:
                    inside = members.may_have(keys)
                    keys, doc = keys[inside], doc[inside]
                place, is_hot = _places(hot["key"], keys)
                some, value = doc[is_hot], place[is_hot]
                sums = [np.bincount(some, hot[c][value], n).astype(float).view(U) for c in of]
                own = row[at:at + n]
                found.append((keys[~is_hot], own[doc[~is_hot]], own, *sums))
                size += n + len(found[-1][0])
                if size > TOGETHER:
                    yield from dealt(found)
                    size = 0
        if size:
            yield from dealt(found)
    return emit


def _parts(tokens: int, size: int) -> int:
    return 1 << min(16, (tokens // size).bit_length())


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of sorted keys, which are hashes: their first bits."""
    return keys >> U(65 - parts.bit_length()) if parts > 1 else np.zeros(len(keys), U)


def _entries(parts: int, of: list[str]):
    """The tree's n-grams of a length in blocks (kind 0)."""
    def dealt(found: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(found)
        found.clear()
        keys = table.column("key").to_numpy().view(U)
        order = np.argsort(keys)
        keys = keys[order]
        return _blocks(0, _part(keys, parts), keys, *(table.column(c).to_numpy().astype(float)[order].view(U) for c in of))

    def emit(batches):
        found, size = [], 0
        for batch in batches:
            found.append(batch)
            size += len(batch)
            if size > TOGETHER // 2:
                yield dealt(found)
                size = 0
        if size:
            yield dealt(found)
    return emit


def _looked_up(of: list[str]):
    """Over a part: the sums by row of what the tree says of each position, in blocks for each chunk
    of documents. One block is worked on at a time."""
    def emit(table: pa.Table) -> pa.Table:
        own, *values = _rows(table, 0, len(of))
        # An n-gram that is both seen and a context has a row for each; their numbers add up.
        own, _, *values = _summed(own, *(x.view(float) for x in values))
        found = [pa.RecordBatch.from_pylist([{**r, "part": r["chunk"], "kind": 1} for r in _of_kind(table, 2)], BLOCK_SCHEMA)]
        for r in _of_kind(table, 1):
            place, there = _places(own, np.cumsum(_unpacked(r["keys"], r["n"]), dtype=U))
            place, rows = place[there], _unpacked(r["numbers"][0], r["n"])[there]
            rows, _, *sums = _summed(rows, *(x[place] for x in values))
            found.append(_blocks(1, np.full(len(rows), r["chunk"]), rows, *(x.view(U) for x in sums)))
        return pa.Table.from_batches(found)
    return emit


def _added(of: list[str]):
    """Sums by row over a chunk of documents."""
    def emit(table: pa.Table) -> pa.Table:
        rows, *sums = _rows(table, 1, len(of))
        rows, _, *sums = _summed(rows, *(x.view(float) for x in sums))
        return pa.table([_signed(rows), *(pa.array(x) for x in sums)], ["row", *of])
    return emit


def scored(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.
    The model learns from the rows without ``held_out``. Scores are log10 probabilities."""
    scratch = Scratch(docs.sparkSession, "lm")
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    tokens = scratch.write(plain.mapInArrow(_hashed, "row bigint, doc bigint, held_out boolean, n_tokens bigint, tokens array<bigint>"), "tokens", **{"parquet.dictionary.page.size": str(1 << 24)})
    tree = Tree(tokens, scratch, depth)
    parts = _parts(tokens.agg(F.sum("n_tokens")).first()[0] or 0, 4 * PART)
    sums = []
    for length, (level, members, tables) in enumerate(zip(tree.levels, tree.members, tree.tables), 1):
        of = [c for c in ("known", "base", "v") if c in level.columns]
        top = most_frequent(level, HOT)
        key, place = np.unique(top.column("key").to_numpy().view(U), return_inverse=True)
        hot = {"key": key} | {c: np.bincount(place, top.column(c).to_numpy().astype(float), len(key)) for c in of}
        found = tokens.select("row", "tokens").mapInArrow(_positions(length, parts, hot, members), BLOCKS)
        found = found.unionByName(level.select("key", *of).mapInArrow(_entries(parts, of), BLOCKS))
        found = found.groupBy("part").applyInArrow(_looked_up(of), BLOCKS)
        found = found.groupBy("part").applyInArrow(_added(of), ", ".join(["row bigint", *(f"{c} double" for c in of)]))
        sums.append(scratch.write(found, f"sums{length}"))
        scratch.drop(*tables)
    every = sums[0]
    for more in sums[1:]:
        every = every.unionByName(more.withColumns({"known": F.lit(0.0), "base": F.lit(0.0)}))
    every = every.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("known", "base", "v")))
    out = tokens.select("row", "doc", "held_out", "n_tokens").join(every, "row")
    base = F.col("base") + (F.col("n_tokens") - F.col("known")) * math.log10(0.5) - F.col("n_tokens") * tree.scale
    return out.select(F.col("doc").alias(id_col), "held_out", "n_tokens", F.col("known").cast("bigint").alias("n_known"), F.lit(tree.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), (base + F.col("v")).alias("score"))
