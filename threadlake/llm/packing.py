"""Lexical retrieval packing: sequences of a fixed number of tokens, filled with related texts.

Each document becomes its token ids and an end id. Whole windows are cut off from its start; what
is left over (less than a window) is packed. Documents are sorted by a lexical key, made of terms of
their whole text (term: token id), and cut into shards of ``SHARD`` documents, so that those which
share such terms are in one shard wherever they came from. The key: of the ``CANDIDATES`` terms
with the highest tf-idf the ``KEY_TERMS`` most frequent ones that are no more frequent than a
shard is long (or one document in ``COMMON``), the most frequent first; then the others, the
rarest first. Document frequencies are those of the whole input. A key with more documents than a
shard goes on by its later terms, then by row, so a hot key is split evenly.

Each shard has a BM25 inverted index of its documents, whole windows included. The longest unused
leftover seeds a sequence; the index scores the others against it, and the unused neighbours fill the window greedily, best first. The last
one is cut where the window ends, and its rest goes back to the unused ones. All windows are
full but for the last of a shard, which is cut into pieces of powers of two, which need no
padding.

The work of a shard is bounded; the number of shards grows with the documents. The driver holds a
count for each term of the vocabulary. Related documents on both sides of a cut, or with other key
terms, do not meet. Results depend on the input's partitions and the order in them (which order
equal keys) and on the ranges that Spark samples, not on which executor runs what: a task that
runs again gives the same pieces.

Edge cases: a null or empty text still has the end id. Rows with equal or null ids are separate
documents. Texts of any length: whole windows never leave their task but as length and checksum.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import Scratch
from threadlake.llm.words import same_words, word_hashes, word_spans

SHARD = 512
CANDIDATES, KEY_TERMS, COMMON = 32, 8, 16
KNOWN_WORDS = 700_000  # most words that a worker remembers, but for the last stretch's
KNOWN_ENDS = 50_000  # endings that a worker remembers
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"
LONGEST_END = 8
IS_PUNCTUATION = np.isin(np.arange(256), list(PUNCTUATION))
IS_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
K1, B = 1.2, 0.75  # the usual constants of BM25


LATIN = 0xC5  # bytes up to this one spell code points below U+0180, for which the steps of the
# tokenizer before its merges do no more than lower case does
DOTTED_I = "\u0130".encode()  # but for this one: in lower case it is a letter and a mark


def stem_of(word: bytes) -> bytes | None:
    """The letters of a word that is letters and then punctuation, if any; None for others."""
    stem = word.rstrip(PUNCTUATION)
    if stem.isascii():
        return stem if stem.isalpha() else None
    return stem if DOTTED_I not in stem and stem.decode().isalpha() else None


def without_endings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with punctuation after an ASCII letter or digit as two words: the punctuation is a
    piece of its own there. Endings of up to ``LONGEST_END`` bytes."""
    cut, own = ends.copy(), np.arange(len(ends))
    for _ in range(LONGEST_END):
        own = own[(cut[own] > starts[own] + 1) & IS_PUNCTUATION[buf[cut[own] - 1]]]
        if not len(own):
            break
        cut[own] -= 1
    cut = cut[(cut < ends) & IS_ALNUM[buf[cut - 1]]] if len(cut) else cut
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([cut, ends]))


class WordIds:
    """Ids of whole texts by way of their words. The tokenizer's normaliser and splitter treat
    white space as a boundary, so the ids of a text are those of its words in turn. Punctuation at
    the end of a word of letters is a piece of its own. New stems of letters are encoded together:
    each is one piece, and the tokenizer marks the last token of a piece. Stems of Latin letters
    are lower-cased here and go through a copy of the tokenizer that splits at white space only."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words come once: remembering them is done here
        vocab = self.tokenizer.get_vocab()
        self.ends_piece = np.zeros(1 + max(vocab.values()), bool)
        self.ends_piece[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(spec))
        if hasattr(self.plain.model, "_resize_cache"):
            self.plain.model._resize_cache(0)
        self.marked_ends: dict[bytes, bytes] = {}  # punctuation that ends words

    def ids(self, text: str, latin: bool) -> np.ndarray:
        coded = (self.plain if latin else self.tokenizer).encode_batch_fast([text.lower() if latin else text], add_special_tokens=False)
        return np.array(coded[0].ids, "<u4")

    def of_any(self, words: list[bytes]) -> dict[bytes, bytes]:
        coded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, coded)}

    def of_stems(self, stems: list[bytes], latin: bool) -> dict[bytes, bytes]:
        out = {}
        for at in range(0, len(stems), 5000):
            part = stems[at:at + 5000]
            ids = self.ids(b" ".join(part).decode(), latin)
            ends = np.flatnonzero(self.ends_piece[ids])
            if len(ends) != len(part):  # a word is not made up as it seems
                out |= self.of_any(part)
                continue
            cuts = (4 * (1 + ends)).tolist()
            raw = ids.tobytes()
            out.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))
        return out

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        found = list(map(stem_of, new))
        stems = set(found)
        out = {}
        if None in stems:
            stems.discard(None)
            out = self.of_any([w for w, stem in zip(new, found) if stem is None])
        latin = [s for s in stems if s.isascii() or max(s) <= LATIN]
        out |= self.of_stems(latin, True)
        if len(latin) < len(stems):
            out |= self.of_stems(list(stems.difference(latin)), False)
        ended = [(w, stem, w[len(stem):]) for w, stem in zip(new, found) if stem is not w and stem is not None]
        tail = self.marked_ends
        if more := {e for _, _, e in ended}.difference(tail):
            if len(tail) > KNOWN_ENDS:
                tail.clear()
                more = {e for _, _, e in ended}
            tail |= self.of_any(list(more))
        out |= {w: out[stem] + tail[e] for w, stem, e in ended}
        return out

    def coded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the bounds of each text's."""
        # Lower case is what the tokenizer makes of a text; done at once it leaves fewer words.
        parts = []
        for text in texts:
            low = text.lower()
            parts.append(text if b"<|" in low and any(low.count(m) > text.count(m) for m in self.marks) else low)
        raw = b" ".join(parts) + b" "
        buf, bounds = np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(p) + 1 for p in parts)])
        # Each different word is looked up once. Words are told apart by their hashes, then compared.
        starts, ends = without_endings(buf, *word_spans(buf, bounds)[:2])
        words = np.searchsorted(starts, bounds)
        _, first, which = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if not same_words(buf, (starts, ends), (starts[first][which], ends[first][which])):
            place: dict[bytes, int] = {}
            which = np.array([place.setdefault(raw[s:e], len(place)) for s, e in zip(starts.tolist(), ends.tolist())], np.int64)
            different = list(place)
        else:
            different = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        known = self.known
        new = [w for w in different if w not in known]
        extra = self.learn(new) if new else {}
        coded = [extra[w] if w in extra else known[w] for w in different]
        if len(known) < KNOWN_WORDS:  # words met first are the frequent ones
            known |= extra
        flat, size = np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        begin = np.cumsum(size) - size
        count = size[which]
        done = np.concatenate([[0], np.cumsum(count)])
        return flat[np.repeat(begin[which] - done[:-1], count) + np.arange(int(done[-1]))], done[words]

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, cuts = self.coded(texts)
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def stretches(sizes: np.ndarray, most: int = 1 << 23):
    """Ranges of rows with about ``most`` bytes together."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at = to


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different tokens and how often each occurs."""
    terms, counts = np.unique(ids, return_counts=True)
    return terms.astype("<u4"), counts.astype("<u4")


TOKENS = "doc bigint, doc_tokens bigint, crcs array<bigint>, rest binary, terms binary, counts binary"
DF = pa.list_(pa.struct([("term", pa.int64()), ("n", pa.int64())]))


def binaries(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of 32-bit numbers as a binary column."""
    data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((4 * cuts).astype(np.int64)), data]).cast(pa.binary())


def terms_by_row(ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids of each row (between cuts) in order, how often each occurs, and the cuts."""
    n = len(cuts) - 1
    size = 1 + int(ids.max(initial=0))
    key = np.repeat(np.arange(n), np.diff(cuts)) * size + ids
    key.sort()
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    row, term = np.divmod(key[head], size)
    return term, np.diff(np.append(head, len(key))), np.searchsorted(row, np.arange(n + 1))


def _tokens(path: str, end_id: int, window: int):
    """Rows of documents with their terms and counts, then one row with the task's document
    frequencies."""
    names = ["doc", "doc_tokens", "crcs", "rest", "terms", "counts", "df"]

    def emit(batches):
        tokens = word_ids(path)
        seen = np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            docs = batch.column("doc")
            for at, to in stretches(np.array([len(t or b"") for t in texts])):
                ids, cuts = tokens.coded([t or b"" for t in texts[at:to]])
                ids = np.insert(ids, cuts[1:], end_id)
                cuts = cuts + np.arange(len(cuts))
                count = np.diff(cuts)
                whole = count // window * window
                crcs: list[list[int]] = [[] for _ in range(to - at)]
                for i in np.flatnonzero(whole).tolist():
                    crcs[i] = [zlib.crc32(ids[p:p + window].tobytes()) for p in range(int(cuts[i]), int(cuts[i] + whole[i]), window)]
                left = ids[np.arange(len(ids)) >= np.repeat(cuts[:-1] + whole, count)]
                terms, often, bounds = terms_by_row(ids, cuts)
                found = np.bincount(terms, minlength=len(seen))
                found[:len(seen)] += seen
                seen = found
                columns = [docs.slice(at, to - at), pa.array(count, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                           binaries(left, np.concatenate([[0], np.cumsum(count - whole)])), binaries(terms, bounds), binaries(often, bounds)]
                yield pa.record_batch([*columns, pa.nulls(to - at, DF)], names)
        own = [{"term": t, "n": int(seen[t])} for t in np.flatnonzero(seen).tolist()]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        yield pa.record_batch([*(pa.nulls(1, t) for t in types), pa.array([own], DF)], names)
    return emit


def lexical_key(terms: np.ndarray, counts: np.ndarray, rank: np.ndarray, idf: np.ndarray) -> bytes:
    """Key terms in order, as bytes that sort like it."""
    if len(terms) > CANDIDATES:
        weight = idf[terms] * (1 + np.log(counts))
        terms = terms[np.argpartition(-weight, CANDIDATES - 1)[:CANDIDATES]]
    return np.sort(rank[terms])[:KEY_TERMS].astype(">u4").tobytes()


def key_order(df: np.ndarray, n: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each term in keys, and its idf. A term of one document tells nothing of others."""
    most = max(shard, n // COMMON)
    shared = (df > 1) & (df <= most)
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.where(shared, -df, df), df < 2, ~shared))] = np.arange(len(df))
    return rank, np.where(df > 1, np.log(1 + n / np.maximum(df, 1)), 0.0)


def _keys(rank: np.ndarray, idf: np.ndarray):
    def emit(batches):
        for batch in batches:
            own = (batch.column(c).to_pylist() for c in ("terms", "counts"))
            keys = [lexical_key(*(np.frombuffer(x, "<u4") for x in pair), rank, idf) for pair in zip(*own)]
            yield pa.record_batch([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "key"])
    return emit


class _NoTask:
    @staticmethod
    def partitionId() -> int:  # noqa: N802
        return 0


class Index:
    """BM25 inverted index of texts, given as (terms, counts): postings (document, weight) by
    term."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        n = len(texts)
        size = np.array([c.sum() for _, c in texts], np.int64)
        doc = np.repeat(np.arange(n), [len(t) for t, _ in texts])
        flat, tf = (np.concatenate(x).astype(np.int64) for x in zip(*texts)) if n else (np.zeros(0, np.int64),) * 2
        key = flat * n + doc
        by_term = np.argsort(key)
        key, tf = key[by_term], tf[by_term]
        self.doc = key % max(n, 1)
        term = key // max(n, 1)
        head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        df = np.diff(np.append(head, len(term)))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(1.0, size.mean() if n else 1.0))
        self.weight = (np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.head, self.df, self.n = head, df, n
        # Each document's terms, as places in the list of terms.
        of_term = np.repeat(np.arange(len(head)), df)
        by_doc = np.argsort(self.doc, kind="stable")
        self.terms = np.split(of_term[by_doc], np.searchsorted(self.doc[by_doc], np.arange(1, n)))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each document for the terms of the seed."""
        terms = self.terms[seed]
        df = self.df[terms]
        at = np.repeat(self.head[terms] - (np.cumsum(df) - df), df) + np.arange(int(df.sum()))
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def packed(texts: list[np.ndarray], window: int, whole: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (text, first token, length) that hold each token of the texts once.
    Each sequence has ``window`` tokens or a power of two. Texts are scored by ``whole``, the
    (terms, counts) of the documents they are left of, if given."""
    index = Index([terms_of(t) for t in texts] if whole is None else whole)
    used = np.zeros(len(texts), np.int64)  # tokens already placed, by text
    left = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-left, kind="stable").tolist()
    total, out = int(left.sum()), []
    for seed in order:
        while left[seed] and total >= window:
            pieces, room = [], window
            ranked = None
            at, text = 0, seed
            while room:
                take = int(min(room, left[text]))
                if take:
                    pieces.append((text, int(used[text]), take))
                    used[text] += take
                    left[text] -= take
                    room -= take
                    total -= take
                if room:
                    if ranked is None:
                        score = index.scores(seed)
                        open_ = np.flatnonzero(left)
                        ranked = open_[np.argsort(-score[open_], kind="stable")].tolist()
                    text = ranked[at]
                    at += 1
            out.append(pieces)
    # Less than a window is left: cut it into powers of two, largest first.
    rest = [(t, int(used[t]), int(left[t])) for t in np.flatnonzero(left).tolist()]
    while total:
        room = 1 << (total.bit_length() - 1)
        total, pieces = total - room, []
        while room:
            text, first, length = rest.pop(0)
            take = min(room, length)
            pieces.append((text, first, take))
            room -= take
            if take < length:
                rest.insert(0, (text, first + take, length - take))
        out.append(pieces)
    return out


COLUMNS = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(window: int, most: int):
    """Packs each ``most`` rows of a sorted partition as a shard."""

    def pack(own: pa.Table, sequence: int) -> tuple[pa.RecordBatch, int]:
        doc, count, crc_lists, rests, terms, counts = (own.column(c).to_pylist() for c in ("doc", "doc_tokens", "crcs", "rest", "terms", "counts"))
        rows = []
        for i, crcs in enumerate(crc_lists):
            for k, crc in enumerate(crcs):
                rows.append((doc[i], k * window, window, crc, count[i], sequence, 0))
                sequence += 1
        texts = [np.frombuffer(r, "<u4") for r in rests]
        for pieces in packed(texts, window, [tuple(np.frombuffer(x, "<u4") for x in pair) for pair in zip(terms, counts)]):
            offset = 0
            for text, first, length in pieces:
                crc = zlib.crc32(texts[text][first:first + length].tobytes())
                rows.append((doc[text], len(crc_lists[text]) * window + first, length, crc, count[text], sequence, offset))
                offset += length
            sequence += 1
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], COLUMNS), sequence

    def emit(batches):
        import pyspark

        sequence, waiting, n = (pyspark.TaskContext.get() or _NoTask).partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                n += part.num_rows
                if n == most:
                    out, sequence = pack(pa.Table.from_batches(waiting), sequence)
                    waiting, n = [], 0
                    yield out
        if n:
            yield pack(pa.Table.from_batches(waiting), sequence)[0]
    return emit


def packs(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, shard: int = SHARD) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of sequences of at
    most ``window`` tokens."""
    scratch = Scratch(docs.sparkSession, "packing")
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    rows = plain.mapInArrow(_tokens(tokenizer, end_id, window), f"{TOKENS}, df array<struct<term: bigint, n: bigint>>")
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "tokens", compression="snappy")
    found = rows.where("df is not null").select(F.explode("df").alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n")).collect()
    df = np.zeros(1 + max([r["term"] for r in found], default=0), np.int64)
    df[[r["term"] for r in found]] = [r["n"] for r in found]
    rows = rows.where("df is null").drop("df")
    n = rows.count()
    keyed = scratch.write(rows.mapInArrow(_keys(*key_order(df, n, shard)), f"{TOKENS}, row bigint, key binary"), "keyed", compression="snappy")
    scratch.drop("tokens")
    # Some shards a partition: ranges are even but for what the sampling misses.
    parts = min(10_000, max(1, math.ceil(n / shard / 8)))
    out = keyed.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    out = out.drop("key", "row").mapInArrow(_pack(window, shard), ", ".join(f"{c} bigint" for c in COLUMNS))
    return out.select(F.col("doc").alias(id_col), *COLUMNS[1:])
