"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a seed and its code point. An n-gram of
letters is bound into one vector: the letters' vectors, each rotated by its distance from the end,
multiplied. A text's profile is the bundle (sum) of its n-grams' vectors, a language's prototype
the bundle of all its training texts. A text is given the language whose prototype has the largest
cosine with its profile.

Prototypes are partial sums per task, added up in Spark: one row per language and dimension. Only
the prototypes (languages times ``DIMENSIONS``) are brought together and sent out.

Letters are compared in lower case; all other characters are one boundary symbol. Edge cases: a
null text or one without letters is ``und`` with score 0, and so is any text if there was nothing
to learn from. A negative cosine counts as 0. Ties go to the first language by name. Null
languages are not learned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import ship, with_results

DIMENSIONS = 1024
LETTERS = 3  # per n-gram
KNOWN_GRAMS = 24_000  # vectors that a worker remembers
TOGETHER = 64  # texts whose profiles are computed together
CODE = 21  # bits of a code point
_LOWER: list[np.ndarray] = []
_LETTER: dict[int, np.ndarray] = {}
_GRAMS: dict[int, int] = {}
_VECTORS: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """By code point, the lower case letter's code point, or 0 if it is no letter."""
    if not _LOWER:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                table[c] = ord(s.lower()[0])
        _LOWER.append(table)
    return _LOWER[0]


def symbols(text: str) -> np.ndarray:
    """Letters in lower case with one 0 for each stretch of other characters, and at both ends;
    empty if there is no letter."""
    s = _lower_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not s.any():
        return s[:0]
    s = np.concatenate([[0], s, [0]]).astype(np.uint64)
    return s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]


def grams(text: str) -> np.ndarray:
    s = symbols(text)
    n = len(s) - LETTERS + 1
    if n <= 0:
        return s[:0]
    code = s[:n]
    for i in range(1, LETTERS):
        code = (code << np.uint64(CODE)) | s[i:n + i]
    return code


def _letter(code: int) -> np.ndarray:
    if code not in _LETTER:
        _LETTER[code] = np.random.default_rng([20240607, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
    return _LETTER[code]


def _bind(code: int) -> np.ndarray:
    out = np.ones(DIMENSIONS, np.int8)
    for i in range(LETTERS):
        out = out * np.roll(_letter((code >> (CODE * i)) & ((1 << CODE) - 1)), i)
    return out


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """One row for each n-gram. The most used ones are remembered, so many at most."""
    if not _VECTORS:
        _VECTORS.append(np.empty((KNOWN_GRAMS, DIMENSIONS), np.int8))
    out = np.empty((len(codes), DIMENSIONS), np.float32)
    place = np.array([_GRAMS.get(c, -1) for c in codes.tolist()], np.int64)
    out[place >= 0] = _VECTORS[0][place[place >= 0]]
    for i in np.flatnonzero(place < 0).tolist():
        c = int(codes[i])
        v = _bind(c)
        out[i] = v
        if len(_GRAMS) < KNOWN_GRAMS:
            _VECTORS[0][len(_GRAMS)] = v
            _GRAMS[c] = len(_GRAMS)
    return out


def profiles(texts: list[str]) -> np.ndarray:
    """The bundle of each text, one row each. N-grams are counted first and bound once."""
    own = [np.unique(grams(t), return_counts=True) for t in texts]
    codes = np.unique(np.concatenate([c for c, _ in own])) if own else np.zeros(0, np.uint64)
    out = np.zeros((len(texts), DIMENSIONS), np.float64)
    for at in range(0, len(codes), 8192):  # bounds the memory for texts with very many n-grams
        part = codes[at:at + 8192]
        counts = np.zeros((len(texts), len(part)), np.float32)
        for row, (c, n) in enumerate(own):
            lo, hi = np.searchsorted(c, part[0]), np.searchsorted(c, part[-1], "right")
            counts[row, np.searchsorted(part, c[lo:hi])] = n[lo:hi]
        out += counts @ gram_vectors(part)
    return out


def _stretches(texts: list, most: int = 1 << 20):
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at] or "")
        while to < len(texts) and to - at < TOGETHER and size + len(texts[to] or "") <= most:
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def _bundles(frames):
    sums: dict[str, np.ndarray] = {}
    frame = lambda: pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})
    for batch in frames:
        texts, langs = batch["text"].tolist(), batch["lang"].tolist()
        for at, to in _stretches(texts, 1 << 22):
            by: dict[str, list[str]] = {}
            for text, lang in zip(texts[at:to], langs[at:to]):
                by.setdefault(lang, []).append(text or "")
            for lang, own in by.items():
                # One bundle for all: a boundary between texts is a boundary symbol.
                sums[lang] = sums.get(lang, 0) + profiles(["\n".join(own)])[0]
        if len(sums) > 500:
            yield frame()
            sums.clear()
    if sums:
        yield frame()


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and their prototypes of unit length."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = rows.mapInPandas(_bundles, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("at", "x"))
    got = sums.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", F.transform("v", lambda e: e["x"]).alias("v")).orderBy("lang").collect()
    book = np.array([r["v"] for r in got], np.float64).reshape(len(got), DIMENSIONS)
    size = np.linalg.norm(book, axis=1, keepdims=True)
    return [r["lang"] for r in got], book / np.where(size > 0, size, 1)


def _predict(names: list[str], langs: list[str], book: np.ndarray):
    def emit(batches):
        for batch in batches:
            texts, pred, score = batch.column("text").to_pylist(), [], []
            for at, to in _stretches(texts):
                p = profiles([t or "" for t in texts[at:to]])
                size = np.linalg.norm(p, axis=1)
                cos = p @ book.T / np.where(size > 0, size, 1)[:, None] if langs else np.zeros((len(p), 1))
                best = cos.argmax(axis=1)
                known = (size > 0) & bool(langs)
                pred += [langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist())]
                score += np.where(known, np.clip(cos[np.arange(len(p)), best], 0, 1), 0.0).tolist()
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])
    return emit


def predicted(docs: DataFrame, langs: list[str], book: np.ndarray, *, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """The input columns with lang_pred and score."""
    ship(docs.sparkSession)
    keep = [c for c in with_results(docs, ["lang_pred", "score"]) if with_text or c != text_col]
    names = ["text" if c == text_col else f"_{i}" for i, c in enumerate(keep)]
    wide = docs.select(F.col(text_col).alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names) if c != text_col))
    ddl = [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names)]
    out = wide.mapInArrow(_predict(names, langs, book), ", ".join([*ddl, "lang_pred string", "score double"]))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "lang_pred", "score")


def held_out(id_: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning: CRC-32 of the id's decimal digits, by folds."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == 0, F.lit(False))
