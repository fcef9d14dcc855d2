"""Long words, many spans, words made to collide, repeated ids; rollups against a recount;
prototypes against a plain bundle."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import docs, texts  # noqa: F401

from threadlake.llm import bpe, langid, packing, quality, secret_scan, simhash, substring, token_counts
from threadlake.llm.queries import tokenizer_file
from threadlake.llm.sql import QUALITY_SQL


def test_bpe_of_a_very_long_word():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    rng = random.Random(1)
    word = "".join(rng.choice("ACGT") for _ in range(300_000))
    begun = time.process_time()
    ids, back = bpe.codec(path).code([word, "a" * 100_000, word[:777]])
    assert time.process_time() - begun < 60
    theirs = Tokenizer.from_file(path)
    for text, own in zip([word, "a" * 100_000, word[:777]], ids):
        assert own == ",".join(map(str, theirs.encode(text, add_special_tokens=False).ids))
    assert back[0].decode() == word


def test_bpe_merges_equal_step_by_step_ones():
    codec = bpe.codec(tokenizer_file("byte_bpe_50k.json"))
    rng = random.Random(2)

    def slow(word):
        ids = [codec.byte_ids[b] for b in word]
        while True:
            ranks = [codec.rank_of.get(a * codec.n + b, bpe.NEVER) for a, b in zip(ids, ids[1:])]
            if not ranks or min(ranks) == bpe.NEVER:
                return ids
            i = ranks.index(min(ranks))
            ids[i:i + 2] = [codec.made[ranks[i]]]

    for _ in range(500):
        word = "".join(rng.choice("aeinorst hé") for _ in range(rng.randrange(30))).encode()
        assert codec.merge(word) == slow(word)


def test_masking_many_spans():
    text = "ab" * 200_000
    spans = [(i, i + 1) for i in range(0, len(text), 4)]
    begun = time.process_time()
    out = secret_scan.masked(text, spans)
    assert time.process_time() - begun < 5
    assert out == (secret_scan.REDACTED + "bab") * 100_000
    assert secret_scan.masked("0123456789", [(1, 3), (2, 4), (4, 5), (7, 9)]) == f"0{secret_scan.REDACTED}56{secret_scan.REDACTED}9"
    assert secret_scan.masked("é1", [(0, 1)]) == secret_scan.REDACTED + "1"


def test_words_made_to_collide_are_no_repeat(spark):
    one, two = "a", "b"
    for _ in range(11):  # equal under a polynomial modulo 2**64, whatever its letters' table
        one, two = one + two, two + one
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*words[:6], one, *words[6:]])), (2, " ".join([*words[:6], two, *words[6:]])), (3, " ".join([*words[:6], two, *words[6:]]))]
    got = {r["doc_id"]: sum(x["end"] - x["first"] for x in r["removed"]) for r in substring.remove_repeated_windows(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_one_row_for_each_component_whatever_the_ids(spark):
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five six " * 9, "red green blue white black " * 9)
    rows = [(1, a, 0), (1, b, 1), (2, b, 2), (3, a, 3), (4, c, 4), (5, c, 5), (1, a, 6)]
    kept = simhash.keep_one_each(spark.createDataFrame(rows, "doc_id bigint, text string, __no int")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (1, b), (4, c)])


def test_quality_sql_equals_the_rules(spark):
    english = "table " * 299 + "the"
    rows = [(1, english, "en"), (2, english, None), (3, english, "ru-RU"), (4, "слово дом " * 150, None), (5, "слово дом " * 150, "en"), (6, "the table " * 150, "de"),
            (7, None, None), (8, "a\n" * 300, "und"), (9, " ".join(f"w{i}" for i in range(300)), "fr"), (10, " ".join(f"w{i}" for i in range(199)), "fr"), (11, "x#y " * 80, "")]
    rows = [(i, t if t is None or i in (8, 11) else " ".join(f"{w}{k % 97}" if w not in ("the",) else w for k, w in enumerate(t.split())), lang) for i, t, lang in rows]
    got = quality.rated(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).select("doc_id", *quality.BASE_COLUMNS, "kept")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    res = con.execute(QUALITY_SQL)
    names = [d[0] for d in res.description]
    theirs = sorted(tuple(r[names.index(c)] for c in got.columns) for r in res.fetchall())
    assert sorted(map(tuple, got.collect())) == theirs
    assert {r[-1] for r in theirs} == {True, False}


def test_rollup_equals_a_recount(spark, tmp_path):
    rng = random.Random(3)
    book, held = token_counts.Rollup(spark, str(tmp_path / "r")), {}
    nameless = 0
    for batch in range(4):
        changes = []
        for seq in range(40):
            doc, op = rng.choice([*range(12), None]), rng.choice(["insert", "revise", "delete"])
            row = (doc, rng.choice("xy"), rng.choice(["en", None]), rng.randrange(9), "tok", op, seq, "extra")
            changes.append(row)
        for doc, source, lang, n, tok, op, *_ in changes:
            if doc is None:
                nameless += op != "delete"
            else:
                held.pop(doc, None)
                if op != "delete":
                    held[doc] = (source, lang, n)
        df = spark.createDataFrame(changes, "doc_id bigint, source string, lang string, n_tokens bigint, tokenizer string, op string, seq bigint, sign string")
        assert book.commit(f"b{batch}", df) and not book.commit(f"b{batch}", df)
        want = {}
        for source, lang, n in held.values():
            docs_, tokens = want.get((source, lang), (0, 0))
            want[source, lang] = (docs_ + 1, tokens + n)
        state = {}
        for r in book.state().collect():
            docs_, tokens = state.get((r["source"], r["lang"]), (0, 0))
            state[r["source"], r["lang"]] = (docs_ + 1, tokens + r["n_tokens"])
        assert state == want
        assert sum(r["n_docs"] for r in book.totals().collect()) == len(held) + nameless


def test_counted_tokens(docs):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    theirs = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = token_counts.counted(docs, tokenizer_file("byte_bpe_50k.tiktoken"), PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(r[0]), len(theirs.encode_ordinary(r[1] or ""))) for r in texts())


def test_prototypes_equal_plain_bundles(spark):
    rows = [("en", "The cat"), ("en", "a dog, Ärger"), ("de", "Der Hund"), (None, "x"), ("fr", None), ("de", "12")]
    langs, book = langid.learn(spark.createDataFrame(rows, "lang string, text string"))
    def bundle(sample):
        out = np.zeros(langid.DIMENSIONS)
        for text in sample:
            s, last = [0], True
            for ch in text or "":
                if ch.isalpha():
                    s.append(ord(ch.lower()))
                elif s[-1] != 0:
                    s.append(0)
            s = s if s[-1] == 0 else [*s, 0]
            if len(s) > 1:
                for i in range(len(s) - langid.LETTERS + 1):
                    v = np.ones(langid.DIMENSIONS)
                    for k, code in enumerate(reversed(s[i:i + langid.LETTERS])):
                        v = v * np.roll(langid._letter(code), k)
                    out += v
        n = np.linalg.norm(out)
        return out / n if n else out
    want = {lang: bundle([t for k, t in rows if k == lang]) for lang in ("de", "en", "fr")}
    for lang, own in zip(langs, book):
        assert own @ want[lang] == pytest.approx(1.0 if want[lang].any() else 0.0, abs=1e-9)
    assert langs == sorted(want)


def test_word_ids_equal_the_tokenizer():
    words = packing.WordIds(tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(4)
    letters = "abcdeXYZéÉßñİıŉſσΣжЖ中ªº'.,!-_|<>0129µ"
    sample = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(200)) for _ in range(200)]
    for text, got in zip(sample, words.of([t.encode() for t in sample])):
        assert np.frombuffer(got, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_ids_when_hashes_collide(monkeypatch):
    words = packing.WordIds(tokenizer_file("word_bpe_49k.json"))
    sample = ["one two three two", "", " \t", "two onefold " + "x" * 3000 + " " + "y" * 3000, "ONE <|ENDOFTEXT|> é"]
    want = words.of([t.encode() for t in sample])
    assert [np.frombuffer(w, "<u4").tolist() for w in want] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in sample]
    monkeypatch.setattr(packing, "word_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    assert words.of([t.encode() for t in sample]) == want and words.of([]) == []
