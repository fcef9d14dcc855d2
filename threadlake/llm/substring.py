"""Substring de-duplication over word windows.

Rabin-Karp hashes of every window of ``width`` words are compared in Spark (``windows``); the
repeated ones merge into maximal intervals of words to remove.

Edge cases: a null or empty text has no words and loses none. A document shorter than the
window loses nothing. Windows repeated only inside one document, or only among rows with the
same ``doc_id``, are no repeats. Null ids: the row is kept as it is.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import Scratch, passed_on
from threadlake.llm.windows import BASE, SECOND_BASE, all_spans, blocks, both, joined, looked_up, mark_arrays, prefix_hashes, removed_tokens, repeated_windows, Runs

RESULTS = ["n_words", "removed", "kept_text"]


def _single_windows(width: int, gram: int):
    def emit(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            marks = batch.column("marks")
            for at, _, _, tokens, bounds in blocks(batch, "text", "words"):
                r = Runs(tokens, bounds, width, gram)
                cuts, picked = np.searchsorted(r.doc, np.arange(len(bounds))), []
                for d in range(len(bounds) - 1):
                    keys, values = mark_arrays(marks, at + d)
                    hit, _ = looked_up(keys, values, r.context[cuts[d]:cuts[d + 1]])
                    picked.append(cuts[d] + np.flatnonzero(hit))
                runs = np.concatenate(picked) if picked else np.zeros(0, np.int64)
                if not len(runs):
                    continue
                n = r.count[runs]
                run = np.repeat(runs, n)
                bit = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                window, check = both(*(_window_hashes(t, r.first[run] + bit, width, b) for t, b in zip(tokens, (BASE, SECOND_BASE))))
                yield pa.record_batch([pa.array(x) for x in (r.gram[run], window, check, ids[at + r.doc[run]], r.context[run], bit)], ["gram", "window", "check", "doc", "context", "bit"])
    return emit


def _window_hashes(tokens: np.ndarray, starts: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of the windows at these tokens, over stretches that bound the memory."""
    out, step = np.empty(len(starts), np.uint64), 1 << 18
    for lo in range(0, len(tokens), step):
        own = np.flatnonzero((starts >= lo) & (starts < lo + step))
        if len(own):
            p = prefix_hashes(tokens[lo:lo + step + width - 1], base)
            out[own] = all_spans(p, width, len(p) - width, base)[starts[own] - lo]
    return out


def _resolve(width: int, gram: int):
    def resolve(docs: DataFrame, owned: DataFrame, scratch: Scratch) -> DataFrame:
        single = joined(docs, owned, "inner").mapInArrow(_single_windows(width, gram), "gram bigint, window bigint, check bigint, doc bigint, context bigint, bit bigint")
        single = scratch.write(single, "single")
        first = single.groupBy("gram", "window", "check").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
        first = scratch.write(first.select("gram", "window", "check", "low"), "first")
        again = single.join(first, ["gram", "window", "check"]).where("doc > low")
        return again.groupBy("doc", "context").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("mask"))
    return resolve


def _cut(width: int, gram: int, extra: list[str]):
    intervals = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def emit(batches):
        for batch in batches:
            marks = batch.column("marks")
            has = marks.is_valid().to_numpy(zero_copy_only=False)
            texts = batch.column("text").to_pylist()
            counts, spans, kept = [], [], []
            gone: dict[int, np.ndarray] = {}
            if has.any():
                rows = np.flatnonzero(has)
                own = pa.record_batch([batch.column("text").take(pa.array(rows))], ["text"])
                for at, _, _, tokens, bounds in blocks(own, "text", "words"):
                    some = [mark_arrays(marks, int(rows[at + d])) for d in range(len(bounds) - 1)]
                    cut = removed_tokens(tokens, bounds, some, width, gram)
                    for d in range(len(bounds) - 1):
                        gone[int(rows[at + d])] = cut[bounds[d]:bounds[d + 1]]
            for i, text in enumerate(texts):
                words = (text or b"").split()
                counts.append(len(words))
                cut = gone.get(i)
                if cut is None:
                    spans.append([])
                    kept.append(b" ".join(words))
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
                spans.append([{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                kept.append(b" ".join(compress(words, ~cut)))
            columns = [batch.column(c) for c in extra]
            columns += [pa.array(counts, pa.int64()), pa.array(spans, intervals), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.record_batch(columns, [*extra, *RESULTS])
    return emit


def remove_repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13, gram: int = 5, with_text: bool = True) -> DataFrame:
    """The input columns with n_words, removed (word intervals, maximal, in order) and kept_text
    (the words that stay, joined by one space).

    A word goes if a window of ``width`` words over it also starts in a document with a smaller
    id. Judged on the input, not on what is left. See the module for edge cases.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    marks = repeated_windows(plain.where("doc is not null and text is not null"), scratch, "words", width, gram, _resolve(width, gram))
    wide, names, ddl, back = passed_on(docs, id_col, text_col, RESULTS, with_text)
    fields = f"{ddl + ', ' if ddl else ''}n_words bigint, removed array<struct<first: bigint, `end`: bigint>>, kept_text string"
    return joined(wide, marks).mapInArrow(_cut(width, gram, names), fields).select(*back, *RESULTS)
