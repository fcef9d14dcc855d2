"""Repeated fixed-length token windows across documents, without a row per window.

A window is ``width`` consecutive tokens of one document (words, or UTF-8 bytes). Each window
is represented by its anchor: the ``gram``-token piece inside it with the smallest hash (the
leftmost one on a tie). Equal windows have equal anchors at equal places, so windows can only
repeat where anchors do. Consecutive windows with the same anchor form a run; its context is
the text that the run's windows span. The steps, each a Spark job over all documents:

1. count anchors: per anchor hash the smallest and largest document that has it; those with
   more than one document go on (a sieve that loses nothing);
2. runs with such an anchor, as (anchor, context hash, document);
3. per (anchor, context) the owner, the smallest document that has it. Every window of that
   context is a repeat in all other documents that have it;
4. only where one anchor has several contexts can single windows repeat between different
   contexts. The owners' windows there are resolved one by one by the operator's own method;
5. per document the list of its contexts with a bit for each repeated window.

Hot anchors, contexts and windows are minima over partial aggregates, and the joins back read
written tables with a plain exchange on each side, which AQE splits when a key is skewed. The
only lists built are per document and no longer than its text.

Hashes are Rabin-Karp polynomials modulo 2**64 over hashes of the tokens (bytes: a random table;
words: ``words.word_hashes``, which is no polynomial, so that no words collide by construction),
taken from prefix sums, then mixed. Each document's tokens are hashed by two such families that
share neither base nor token hashes. A context (and a single window) is told by its anchor's hash, a hash
of both families and the second family's own hash, the ``check``: where a place is found to repeat,
the check of its text equals that of the owner's text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import Scratch, binary_parts
from threadlake.llm.words import word_hashes, word_spans

U = np.uint64
BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SECOND_SEED = 0x2545F4914F6CDD1D
SEGMENT = 1 << 18  # tokens that are hashed at once; bounds the memory for very long texts
POSITION = U((1 << 20) - 1)
SYMBOLS, SECOND_SYMBOLS = np.random.default_rng(20240607).integers(0, 2**64, (2, 256), dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 2 * SEGMENT)
        p = np.empty((2, size), U)
        p[:, 1:] = np.array([[base], [pow(base, -1, 2**64)]], U)
        p[:, 0] = 1
        _POWERS[base] = np.multiply.accumulate(p, axis=1)
    return _POWERS[base][0], _POWERS[base][1]


def prefix_hashes(tokens: np.ndarray, base: int = BASE) -> np.ndarray:
    out = np.zeros(len(tokens) + 1, U)
    np.cumsum(tokens * powers(len(tokens) + 1, base)[0][:len(tokens)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix), base)[1][start]


def all_spans(prefix: np.ndarray, length: int, n: int, base: int = BASE) -> np.ndarray:
    """``span_hash`` of the first n spans of that length."""
    return (prefix[length:length + n] - prefix[:n]) * powers(len(prefix), base)[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - size:width - size + n])


def byte_tokens(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both families' hashes of each byte, and the documents' bounds."""
    return np.stack([SYMBOLS[buf], SECOND_SYMBOLS[buf]]), bounds


def word_tokens(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both families' hashes of each word, and the documents' bounds counted in words."""
    starts, ends, words = word_spans(buf, bounds)
    return np.stack([word_hashes(buf, starts, ends), word_hashes(buf, starts, ends, SECOND_SEED)]), words


TOKENS = {"bytes": byte_tokens, "words": word_tokens}


def both(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of both families' hashes, the check) of some spans, as bigints."""
    return mix(first + second * U(0xA0761D6478BD642F)).view(np.int64), mix(second).view(np.int64)


class Runs:
    """The runs of some documents: arrays gram, context, check, doc, first (token), count, offset
    (of the anchor from the first token)."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, width: int, gram: int):
        lens, w, size = np.diff(bounds), width - gram + 1, tokens.shape[1]
        doc, end = np.repeat(np.arange(len(lens)), lens), np.repeat(bounds[1:], lens)
        parts = []
        for lo in range(0, size - width + 1, SEGMENT):
            n = min(SEGMENT, size - width + 1 - lo)
            p, q = (prefix_hashes(t[lo:lo + n + width - 1], b) for t, b in zip(tokens, (BASE, SECOND_BASE)))
            grams = mix(all_spans(p, gram, n + w - 1))
            order = (grams & ~POSITION) | np.arange(n + w - 1, dtype=U)
            whole = np.flatnonzero(np.arange(lo + width, lo + n + width) <= end[lo:lo + n])
            if not len(whole):
                continue
            anchor = (sliding_min(order, w)[whole] & POSITION).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            first, count = whole[new], np.diff(np.append(new, len(whole)))
            last = first + count - 1 + width
            context, check = both(span_hash(p, first, last) + count.astype(U), span_hash(q, first, last, SECOND_BASE))
            parts.append((grams[anchor[new]].view(np.int64), context, check, doc[lo + first], lo + first, count, anchor[new] - first))
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 7
        self.gram, self.context, self.check, self.doc, self.first, self.count, self.offset = cols


def blocks(batch: pa.RecordBatch, text: str, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of documents of about a segment: first row, bytes, byte bounds, tokens, token bounds."""
    buf, offs = binary_parts(batch.column(text))
    at, n = 0, len(offs) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offs, offs[at] + SEGMENT, "right")) - 1))
        part, bounds = buf[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
        yield at, part, bounds, *TOKENS[kind](part, bounds)
        at = to


def anchors_of(kind: str, width: int, gram: int, contexts: bool) -> Callable:
    def emit(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for at, _, _, tokens, bounds in blocks(batch, "text", kind):
                r = Runs(tokens, bounds, width, gram)
                if not contexts:
                    yield pa.record_batch([pa.array(r.gram), pa.array(ids[at + r.doc])], ["gram", "doc"])
                    continue
                once = np.unique(mix(r.context.view(U) + r.doc.astype(U) * U(BASE)), return_index=True)[1]
                yield pa.record_batch([pa.array(x) for x in (r.gram[once], r.context[once], r.check[once], ids[at + r.doc[once]])], ["gram", "context", "check", "doc"])
    return emit


def per_document(marks: DataFrame, fields: list[str]) -> DataFrame:
    return marks.groupBy("doc").agg(F.collect_list(F.struct(*fields)).alias("marks"))


def mark_arrays(marks: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The two fields of one document's marks, sorted by the first."""
    got = marks[row].values
    if got is None or not len(got):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (got.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted keys, and their values."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def repeated_windows(docs: DataFrame, scratch: Scratch, kind: str, width: int, gram: int, resolve: Callable) -> DataFrame:
    """(doc, marks array<struct<context, mask>>) for documents with a window that also starts in
    a document with a smaller id. ``docs``: doc bigint, text binary, neither null. Mask -1: all
    windows of the context. ``resolve(docs, owned, scratch)`` gets the owners' ambiguous
    contexts per document (marks: context, number of contexts of its anchor) and returns
    (doc, context, mask)."""
    grams = docs.mapInArrow(anchors_of(kind, width, gram, False), "gram bigint, doc bigint")
    grams = grams.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    grams = scratch.write(grams.where("low < high").select("gram"), "grams")
    place = ["gram", "context", "check"]
    found = docs.mapInArrow(anchors_of(kind, width, gram, True), "gram bigint, context bigint, check bigint, doc bigint")
    # One row for each gram: the smaller side by far, a hash table of which needs no sort.
    found = scratch.write(found.join(grams.hint("shuffle_hash"), "gram"), "found")
    scratch.drop("grams")
    owners = scratch.write(found.groupBy(*place).agg(F.min("doc").alias("owner")), "owners")
    covered = found.join(owners, place).where("doc > owner").select("doc", "context", F.lit(-1).cast("bigint").alias("mask"))
    covered = scratch.write(covered, "covered")
    scratch.drop("found")
    several = scratch.write(owners.groupBy("gram").agg(F.min("context").alias("low"), F.max("context").alias("high"), F.count("*").alias("n")).where("low < high").select("gram", "n"), "several")
    owned = owners.join(several, "gram").select(F.col("owner").alias("doc"), "context", "n")
    owned = scratch.write(per_document(owned, ["context", "n"]), "owned")
    scratch.drop("owners", "several")
    partial = scratch.write(resolve(docs, owned, scratch), "partial")
    return scratch.write(per_document(covered.unionByName(partial), ["context", "mask"]), "marks")


def removed_tokens(tokens: np.ndarray, bounds: np.ndarray, marks: list[tuple[np.ndarray, np.ndarray]], width: int, gram: int) -> np.ndarray:
    """Which tokens of a block of documents lie in a repeated window. marks: per document."""
    step = np.zeros(tokens.shape[1] + 1, np.int32)
    r = Runs(tokens, bounds, width, gram)
    mask = np.zeros(len(r.doc), np.int64)
    cuts = np.searchsorted(r.doc, np.arange(len(bounds)))
    for d, (keys, values) in enumerate(marks):
        if len(keys):
            own = slice(cuts[d], cuts[d + 1])
            hit, got = looked_up(keys, values, r.context[own])
            mask[own] = np.where(hit, got, 0)
    full = mask == -1
    np.add.at(step, r.first[full], 1)
    np.add.at(step, r.first[full] + r.count[full] - 1 + width, -1)
    some = np.flatnonzero((mask != 0) & ~full)
    for o in range(int(r.count[some].max(initial=0))):
        at = r.first[some[(mask[some] >> o) & 1 == 1]] + o
        np.add.at(step, at, 1)
        np.add.at(step, at + width, -1)
    return np.cumsum(step[:-1]) > 0


def joined(docs: DataFrame, marks: DataFrame, how: str = "left") -> DataFrame:
    """Documents beside their marks. The lists are small, but grow with the input: no broadcast."""
    return docs.join(marks.withColumnRenamed("doc", "_owner"), docs["doc"] == F.col("_owner"), how).drop("_owner")
