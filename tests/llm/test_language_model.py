"""The suffix tree's scores against one built word by word."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from samples import DOCS, SF, docs, empty, texts  # noqa: F401

from threadlake.llm import language_model as lm
from threadlake.llm import queries
from threadlake.llm.words import word_hashes, word_spans

import numpy as np
import pyarrow as pa


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*lowered.encode().split(), None]


def scores(train, every, depth, least):
    """(n_tokens, n_known, train_tokens, base, score) of each text."""
    sequences = [tokens(t) for t in train]
    count = Counter(w for s in sequences for w in s)
    total, words = sum(count.values()), len(count)
    base = lambda w: (count[w] + 0.5) / (total + 0.5 * (words + 1))
    after = {}  # context -> Counter of next words
    for s in sequences:
        for i, w in enumerate(s):
            for k in range(1, depth + 1):
                if i >= k:
                    after.setdefault(tuple(s[i - k:i]), Counter())[w] += 1
    kept = {}

    def prob(w, context):
        if not context:
            return base(w)
        n, share, of = kept[context]
        return (max(0, of[w] - lm.DISCOUNT) / n if of[w] > 1 else 0) + share * prob(w, context[1:])

    for k in range(1, depth + 1):
        for context, of in after.items():
            n = sum(of.values())
            if len(context) != k or n < least or (k > 1 and context[1:] not in kept):
                continue
            often = {w: c for w, c in of.items() if c > 1}
            if not often:
                continue
            single = n - sum(often.values())
            share = (lm.DISCOUNT * len(often) + single) / n
            gain = sum(c * (math.log10((c - 1 - lm.DISCOUNT) / (n - 1)) - math.log10(prob(w, context[1:]))) for w, c in often.items())
            if gain + single * math.log10(share) > lm.MARGIN * n:
                kept[context] = (n, share, of)
    out = []
    for text in every:
        s, score = tokens(text), 0.0
        for i, w in enumerate(s):
            state = ()
            for k in range(1, depth + 1):
                if i >= k and tuple(s[i - k:i]) in kept:
                    state = tuple(s[i - k:i])
                else:
                    break
            score += math.log10(prob(w, state))
        out.append((len(s), sum(count[w] > 0 for w in s), total, sum(math.log10(base(w)) for w in s), score))
    return out, kept


@pytest.mark.parametrize("depth,least,hot", [(2, 4, 1 << 18), (2, 4, 3), (1, 16, 0), (0, 2, 5)])
def test_scores_equal_a_tree_built_word_by_word(spark, docs, monkeypatch, depth, least, hot):
    monkeypatch.setattr(lm, "LEAST", least)
    monkeypatch.setattr(lm, "HOT", hot)
    rng = random.Random(2)
    nouns = ["cat", "dog", "sun", "tree", "house"]
    more = [(100 + i, " ".join(f"the {rng.choice(nouns)} {rng.choice(['sees', 'likes'])} a {rng.choice(nouns)} ." for _ in range(rng.randrange(30)))) for i in range(30)]
    rows = [(r[0], r[1]) for r in texts()] + more
    df = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0, "g", "f", "r", "k") for i, t in more], DOCS))
    held = lambda i: i is not None and i % 3 == 1
    want, kept = scores([t for i, t in rows if not held(i)], [t for _, t in rows], depth, least)
    got = lm.scored(df, F.col("doc_id") % 3 == 1, depth=depth).collect()
    assert {len(c) for c in kept} >= set(range(1, depth + 1))
    key = lambda r: (str(r[0]), r[2], round(r[6], 5))
    expected = sorted(((i, held(i), *w) for (i, _), w in zip(rows, want)), key=key)
    for mine, theirs in zip(sorted(map(tuple, got), key=key), expected, strict=True):
        assert mine[:5] == theirs[:5]
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-9, abs=1e-9)


def test_distributions_sum_to_one():
    train = ["a b a b a c a b", "a b c a b a a b"] * 4
    _, kept = scores(train, [], 2, 4)
    count = Counter(w for t in train for w in tokens(t))
    total, words = sum(count.values()), len(count)

    def prob(w, context):
        if not context:
            return (count[w] + 0.5) / (total + 0.5 * (words + 1))
        n, share, of = kept[context]
        return (max(0, of[w] - lm.DISCOUNT) / n if of[w] > 1 else 0) + share * prob(w, context[1:])

    assert kept
    for context in kept:
        assert sum(prob(w, context) for w in [*count, b"unknown"]) == pytest.approx(1)


def test_positions_of_longer_ngrams_carry_one_number(spark, docs, monkeypatch):
    """Only words have something to add to n_known and the base score, and a level's tables go
    once it is scored."""
    schemas, dropped = [], []
    monkeypatch.setattr(lm, "LEAST", 4)
    write, drop = lm.Scratch.write, lm.Scratch.drop
    monkeypatch.setattr(lm.Scratch, "write", lambda self, df, name, **o: (schemas.append((name, df.columns)), write(self, df, name, **o))[1])
    monkeypatch.setattr(lm.Scratch, "drop", lambda self, *names: (dropped.extend(names), drop(self, *names))[1])
    assert lm.scored(docs, F.lit(False)).count() == len(texts())
    columns = dict(schemas)
    assert columns["sums1"] == ["row", "known", "base", "v"]
    assert columns["sums2"] == columns["sums3"] == ["row", "v"]
    assert set(columns) - set(dropped) == {"tokens", "sums1", "sums2", "sums3"}


def test_ngrams_go_in_blocks_by_parts(spark, docs, monkeypatch):
    """Pairs and positions are shuffled in blocks, a few bytes each, whatever goes by number, and
    the scores are the same with many parts, small blocks and few numbers."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    more = [(100 + i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=rng.randrange(200)))) for i in range(60)]
    df = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0, "g", "f", "r", "k") for i, t in more], DOCS))
    rows = [(r[0], r[1]) for r in texts()] + more
    want, kept = scores([t for i, t in rows if i is None or i % 3 != 1], [t for _, t in rows], 2, 4)
    key = lambda r: (str(r[0]), r[1], round(r[5], 5))
    expected = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    monkeypatch.setattr(lm, "LEAST", 4)
    monkeypatch.setattr(lm, "HOT", 5)
    monkeypatch.setattr(lm, "PART", 64)
    monkeypatch.setattr(lm, "TOGETHER", 500)
    for numbers in (1 << 20, 20):
        monkeypatch.setattr(lm, "NUMBERS", numbers)
        got = sorted(((r[0], *r[2:]) for r in lm.scored(df, F.col("doc_id") % 3 == 1, depth=2).collect()), key=key)
        for mine, theirs in zip(got, expected, strict=True):
            assert mine[:4] == theirs[:4]
            assert mine[4:] == pytest.approx(theirs[4:], rel=1e-9, abs=1e-9)
    # A block of 100,000 random positions: under 9 bytes each, where a row took 11.7.
    draw = np.random.default_rng(1)
    keys, at = np.sort(draw.integers(0, 1 << 64, 100_000, np.uint64)), draw.integers(0, 8000, 100_000, np.uint64)
    block = lm._blocks(1, lm._part(keys, 8), keys, at)
    assert block.num_rows == 8 and block.nbytes < 9 * len(keys)
    back = lm._rows(pa.Table.from_batches([block]), 1, 1)
    assert np.array_equal(back[0], keys) and np.array_equal(back[1], at)


def test_nothing_to_learn(spark, docs, empty):
    got = lm.scored(docs, F.lit(True)).collect()
    assert len(got) == len(texts()) and all(r["n_known"] == r["train_tokens"] == 0 and r["score"] == pytest.approx(0) for r in got)
    assert lm.scored(empty, F.lit(False)).count() == 0


def test_the_tree_predicts_held_out_text(spark):
    got = [r for r in queries.op12_lm_scores(spark, SF).collect() if r["held_out"]]
    per_token = lambda c: sum(r[c] for r in got) / sum(r["n_tokens"] for r in got)
    assert per_token("score") > per_token("base_score") + 0.05


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    thue, other = "a", "b"
    for _ in range(11):  # equal under any polynomial modulo 2**64
        thue, other = thue + other, other + thue
    words = sorted({*("".join(rng.choice("abAB\0é") for _ in range(rng.randrange(1, 40))) for _ in range(20000)), thue, other, thue[:1024], other[:1024], thue[:1000], other[:1000]})
    data = " ".join(words).encode()
    starts, ends, bounds = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert bounds.tolist() == [0, len(words)]
    h = word_hashes(np.frombuffer(data, np.uint8), starts, ends)
    assert len(set(h.tolist())) == len(words)
    alone = [int(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) for w in words[:200]]
    assert alone == h[:200].tolist()
