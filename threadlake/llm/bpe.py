"""Byte-level BPE encoding and decoding by speculation and verification.

For each distinct pre-token the greedy longest match over the vocabulary proposes tokens. The
proposal is what BPE makes, if each token is what BPE makes of the token's own bytes and no merge
crosses a boundary between neighbours. A crossing merge of rank m would join a node a of the left
token's right edge (the token, its right part, that part's right part, ...) to a node b of the
right token's left edge, at a time when both stand free: m must come before a is merged into its
parent, and not after b is (at equal ranks the leftmost pair goes first). All adjacent pairs of
a batch are tested at once, edge node against edge node, in numpy; only words with a failing pair
are merged exactly, step by step.

The unit of work is a partition of documents: words are looked up in a dictionary of bounded size
for each worker, new ones are proposed and verified together. No shuffle is needed.

Edge cases: a null or empty text has no tokens. Special tokens written out in a text are taken as
such, as the public library does by default; decoding gives their text. Rows are independent, so
repeated rows and null ids do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from threadlake.llm.common import passed_on, ship

#: How byte-level BPE splits a text into words (fixed value of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_WORDS = 400_000  # most words that a worker remembers, but for the last stretch's
RESULTS = ["ids", "decoded"]
NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The format's printable stand-in for each byte: printable Latin-1 bytes stand for
    themselves, the others in order for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        vocab = data["model"]["vocab"]
        self.bytes_of = {i: spell(t) for t, i in vocab.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.splitter = regex.compile(PATTERN)
        self.special_splitter = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        n = 1 + max(self.bytes_of)
        self.left, self.right, self.rank = (np.full(n, -1, np.int64) for _ in range(3))
        self.rank_of: dict[int, int] = {}
        self.made: list[int] = []
        codes, ranks = [], []
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            ab = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.rank_of.setdefault(a * n + b, rank)
            self.made.append(ab)
            codes.append(a * n + b)
            ranks.append(rank)
            if self.rank[ab] < 0:
                self.left[ab], self.right[ab], self.rank[ab] = a, b, rank
        order = np.argsort(codes, kind="stable")
        self.n, self.codes, self.code_ranks = n, np.array(codes, np.int64)[order], np.array(ranks, np.int64)[order]
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.longest: dict[bytes, int] = {}  # of the tokens by their first three bytes
        for b in self.id_of:
            if len(b) > 2:
                self.longest[b[:3]] = max(len(b), self.longest.get(b[:3], 0))
        self.sound: dict[int, bool] = {}  # by token: BPE makes it of its own bytes
        own = {t: i for t, i in self.special.items()}
        self.known: tuple[dict[str, str], dict[str, bytes]] = ({t: str(i) for t, i in own.items()}, {t: t.encode() for t in own})

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the pair of the lowest rank, leftmost first, until none is left. The pairs are
        in a heap and the tokens in a linked list: n log n steps for a word of n bytes."""
        n, get = self.n, self.rank_of.get
        ids = [self.byte_ids[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := get(a * n + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j == len(ids) or ids[j] != b:
                continue  # one of the two is part of another token by now
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (r := get(ids[i] * n + ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (r := get(ids[before[i]] * n + ids[i])) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], ids[i]))
        return [t for t in ids if t >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, id_of, longest, size = [], 0, self.id_of, self.longest, len(word)
        while at < size:
            end = min(size, at + longest.get(word[at:at + 3], 2))
            while (token := id_of.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.n + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_ranks[at], NEVER) if len(self.codes) else np.full(len(a), NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: no merge crosses the boundary between them."""
        fine = np.ones(len(left), bool)
        row, a, a_until = np.arange(len(left)), left, np.full(len(left), NEVER)
        while len(row):
            inner, b, b_until, own = row, right[row], np.full(len(row), NEVER), np.arange(len(row))
            while len(inner):
                m = self.pair_ranks(a[own], b)
                fine[inner[(m < a_until[own]) & (m <= b_until) & (m != NEVER)]] = False
                down = (self.rank[b] >= 0) & fine[inner]
                inner, own, b_until, b = inner[down], own[down], self.rank[b[down]], self.left[b[down]]
            down = (self.rank[a] >= 0) & fine[row]
            row, a_until, a = row[down], self.rank[a[down]], self.right[a[down]]
        return fine

    def is_sound(self, token: int) -> bool:
        if token not in self.sound:
            self.sound[token] = self.merge(self.bytes_of[token]) == [token]
        return self.sound[token]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        proposed = [self.propose(w) for w in words]
        size = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(size.sum()))
        word = np.repeat(np.arange(len(words)), size)
        bad = np.zeros(len(words), bool)
        unsound = [t for t in np.unique(flat).tolist() if not self.is_sound(t)]
        bad[word[np.isin(flat, unsound)]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        code, back = np.unique(flat[inside] * self.n + flat[inside + 1], return_inverse=True)
        fine = self.compatible(code // self.n, code % self.n)
        bad[word[inside[~fine[back.reshape(-1)]]]] = True
        for i in np.flatnonzero(bad).tolist():
            proposed[i] = self.merge(words[i])
        return proposed

    def learn(self, words: list[str]) -> tuple[dict[str, str], dict[str, bytes]]:
        """For each word: its ids joined by commas, and the bytes that they decode to."""
        coded = self.encode_words([w.encode() for w in words])
        return {w: ",".join(map(str, ids)) for w, ids in zip(words, coded)}, {w: self.decode_bytes(ids) for w, ids in zip(words, coded)}

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """Words of the text; special tokens are words of their own."""
        if self.special_splitter is None or not any(s in text for s in self.special):
            return self.splitter.findall(text)
        out = []
        for part in self.special_splitter.split(text):
            out += [part] if part in self.special else self.splitter.findall(part)
        return out

    def code(self, texts: list[str]) -> tuple[list[str], list[bytes]]:
        """Each text's ids joined by commas, and the bytes that they decode to."""
        words = [self.split(t) for t in texts]
        new = list(set().union(*words).difference(self.known[0]))
        ids, back = (old | more for old, more in zip(self.known, self.learn(new))) if new else self.known
        if len(self.known[0]) < KNOWN_WORDS:  # words met first are the frequent ones
            self.known = ids, back
        return [",".join(map(ids.__getitem__, own)) for own in words], [b"".join(map(back.__getitem__, own)) for own in words]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _stretches(texts: list[str], most: int = 1 << 23):
    """Indexes of texts of some millions of characters at a time."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= most:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _code(path: str, names: list[str], digests: bool):
    def emit(batches):
        c = codec(path)
        for batch in batches:
            texts = [(t or b"").decode() for t in batch.column("text").to_pylist()]
            for at, to in _stretches(texts):
                ids, raw = c.code(texts[at:to])
                count = pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64())
                decoded = [x.decode(errors="replace") for x in raw]
                rows = batch.slice(at, to - at)
                columns = [*(rows.column(n) for n in names), count]
                if digests:
                    columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in part]) for part in (ids, decoded)]
                else:
                    columns += [pa.array([np.fromstring(x, np.int32, sep=",") if x else [] for x in ids], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.record_batch(columns, [*names, "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else RESULTS)])
    return emit


def encoded(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, digests: bool = False) -> DataFrame:
    """The input columns with n_tokens, ids (array<int>) and decoded (the text that the ids give
    back); or, with ``digests``, ids_sha256 (of the decimal ids, joined by commas) and
    decoded_sha256 in place of the two."""
    ship(docs.sparkSession)
    results = ["n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else RESULTS)]
    wide, names, ddl, back = passed_on(docs, id_col, text_col, results, with_text)
    kinds = ("string", "string") if digests else ("array<int>", "string")
    fields = ", ".join([*filter(None, [ddl]), "n_tokens bigint", *(f"{r} {k}" for r, k in zip(results[1:], kinds))])
    return wide.mapInArrow(_code(vocabulary, names, digests), fields).select(*back, *results)
