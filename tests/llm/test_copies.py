"""SimHash, word windows and byte strings against brute force."""

import random

import numpy as np
import xxhash
from samples import docs, empty, multiset, texts  # noqa: F401

from threadlake.llm import components, simhash, substring, suffix
from threadlake.llm.common import Scratch


def expected_cut(units_of, width):
    rows = [(r[0], units_of(r[1])) for r in texts()]
    first = {}
    for i, u in rows:
        for k in range(len(u) - width + 1):
            if i is not None:
                first[u[k:k + width]] = min(i, first.get(u[k:k + width], i))
    out = []
    for i, u in rows:
        cut = [False] * len(u)
        for k in range(len(u) - width + 1):
            if i is not None and first[u[k:k + width]] < i:
                cut[k:k + width] = [True] * width
        out.append((i, len(u), sum(cut), [x for x, c in zip(u, cut) if not c]))
    return out


def test_word_windows(docs, empty):
    want = [(i, n, c, b" ".join(k).decode()) for i, n, c, k in expected_cut(lambda t: tuple((t or "").encode().split()), 13)]
    got = substring.remove_repeated_windows(docs)
    assert got.columns == [*docs.columns, "n_words", "removed", "kept_text"]
    rows = [(r["doc_id"], r["n_words"], sum(x["end"] - x["first"] for x in r["removed"]), r["kept_text"]) for r in got.collect()]
    assert multiset(rows) == multiset(want) and any(r[2] for r in rows)
    assert substring.remove_repeated_windows(empty).count() == 0


def test_byte_strings(docs, empty):
    want = [(i, n, c, bytes(k)) for i, n, c, k in expected_cut(lambda t: (t or "").encode(), 50)]
    for hot in (suffix.HOT, 0):  # 0: every ambiguous place goes by rows of windows
        old, suffix.HOT = suffix.HOT, hot
        try:
            got = suffix.remove_repeated_strings(docs).collect()
        finally:
            suffix.HOT = old
        rows = [(r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), bytes(r["kept"])) for r in got]
        assert multiset(rows) == multiset(want)
        assert [r[1] for r in sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] in (4, 7))] == [t[1] for t in texts() if t[0] in (4, 7)]
    assert suffix.remove_repeated_strings(empty).count() == 0


def test_suffix_sort_and_collisions():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    group = np.array([rng.randrange(4) for _ in strings])
    end = np.cumsum([len(s) for s in strings])
    start = end - np.array([len(s) for s in strings])
    s = suffix.Suffixes(np.frombuffer(b"".join(strings), np.uint8), start, end)
    order, common = s.ordered(group)
    assert [(group[i], strings[i]) for i in order] == sorted((g, t) for g, t in zip(group, strings))
    s.common = lambda a, b: np.minimum(s.size[a], s.size[b])  # every hash collides
    order, common = s.ordered(group)
    assert [(group[i], strings[i]) for i in order] == sorted((g, t) for g, t in zip(group, strings))


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    pieces = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints: dict, distance=2) -> dict:
    """Smallest key reachable, by repeated relaxation."""
    label = {k: k for k in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= distance and label[b] < label[a]:
                    label[a], moved = label[b], True
    return label


def test_simhash(docs, empty):
    rows = [(r[0], fingerprint(r[1])) for r in texts()]
    label = groups({i: f for i, f in rows if i is not None})
    by_print = {f: label[i] for i, f in rows if i is not None}
    got = simhash.with_components(docs)
    want = [(i, f"{f:016x}", by_print[f]) for i, f in rows]
    assert multiset(tuple(r) for r in got.collect()) == multiset(want)
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label.values()))
    assert simhash.with_components(empty).count() == 0 and simhash.keep_one_each(empty).count() == 0


def test_rows_without_ids(spark):
    rows = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "x y z w v")], "doc_id bigint, text string")
    assert all(r["component_id"] is None for r in simhash.with_components(rows).collect())
    assert simhash.keep_one_each(rows).count() == 3


def test_golay_keys_meet():
    rng = np.random.default_rng(3)
    for word in rng.integers(0, 1 << 23, 300):
        keys = set(simhash.golay_keys(np.array([word]))[1].tolist())
        assert len(keys) in (1, 6)
        for bit in range(23):
            assert keys & set(simhash.golay_keys(np.array([word ^ (1 << bit)]))[1].tolist())


def test_links_lose_nothing(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for p in base for _ in range(25)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    want = {tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    for hot in (simhash.HOT, 1):  # 1: every shared key is refined
        old, simhash.HOT = simhash.HOT, hot
        try:
            got = {tuple(r) for r in simhash.links(df, Scratch(spark, "test")).collect()}
        finally:
            simhash.HOT = old
        assert got == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components.components(edges, Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200}
    assert components.components(edges.limit(0), Scratch(spark, "test")).count() == 0
