"""Collocations against plain counting in Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from notewright.llm import collocations as C
from notewright.llm.perfect_hash import PerfectHash


def brute(rows, least, longest, best):
    """rows (lang, text): the list of (lang, rank, phrase, a, l, r, n, score)."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        frequent = [g for g, c in counts.items() if len(g) > 1 and c >= least]
        inner = defaultdict(int)
        for q in frequent:
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    inner[q[i : i + m]] = max(inner[q[i : i + m]], counts[q])
        rows = []
        for g in frequent:
            a = counts[g]
            if 100 * inner[g] >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best])]
    return sorted(out)


def rows_of(seed, n, words):
    r = random.Random(seed)
    pool = [f"W{i}" for i in range(words)] + ["é", "the", "x y", " "]
    fixed = [[r.choice(pool) for _ in range(r.randint(2, 6))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(r.randint(0, 12)):
            w += r.choice(fixed) if r.random() < 0.5 else [r.choice(pool)]
            if r.random() < 0.2:
                w[-1] += r.choice(".,;:!?\n\r")
        out.append((r.choice(["en", "en", "de", None, "und"]), r.choice([" ", "  ", "\t"]).join(w)))
    return out + [("en", None), ("fr", ""), ("fr", "a b"), (None, "...")]


def found(spark, rows, *given):
    docs = spark.createDataFrame([(i, t, lang, "s", 1, 2) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, slot long, n int").repartition(3)
    return sorted(tuple(r) for r in C.collocations(docs, *given).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("seed", "words", "least", "best"), [(1, 8, 5, 2000), (2, 60, 4, 7)])
def test_against_plain_counting(spark, seed, words, least, best):
    rows = rows_of(seed, 250, words)
    assert found(spark, rows, least, 5, best) == brute(rows, least, 5, best)


def test_blocks_pieces_and_mappers(spark, monkeypatch):
    """The same in blocks of few candidates, pieces of few counts, a deep tree and mappers that hold little."""
    for name, value in (("BLOCK", 15), ("SLICE", 4), ("FAN", 2), ("KEYS_HELD", 50), ("WORDS_HELD", 5)):
        monkeypatch.setattr(C, name, value)
    rows = rows_of(3, 80, 20)
    assert found(spark, rows, 6, 4, 2000) == brute(rows, 6, 4, 2000)


def test_odd_tables(spark):
    assert found(spark, []) == [] and found(spark, [("en", "a b c"), (None, None)]) == []
    rows = [("en", "Same text of words again and again " * 30)] * 4
    assert found(spark, rows, 100, 5, 2000) == brute(rows, 100, 5, 2000)
    long = [("en", " ".join(random.Random(5).choice(["a", "b", "c,", "dd"]) for _ in range(150_000)))]
    assert found(spark, long, 100, 5, 2000) == brute(long, 100, 5, 2000)


def test_exact_scores_past_64_bits(spark):
    """1000 a n and l r are beyond a long here."""
    a, n, l, r = 4 * 10**12, 9 * 10**13, 5 * 10**12, 6 * 10**12
    level1 = spark.createDataFrame([(0, "en", "p", "p", l, [l], [r], None, None)], "slot long, lang string, phrase string, last_word string, f long, firsts array<long>, lasts array<long>, prefix long, suffix long")
    level2 = spark.createDataFrame([(0, "en", "p q", "q", a, [l, a], [r, a], 0, 0)], level1.schema)
    languages = spark.createDataFrame([("en", n)], "lang string, n long")
    kept = C.frequent_phrases
    try:
        C.frequent_phrases = lambda *_: (languages, [level1, level2])
        row = C.collocations(languages).first()
    finally:
        C.frequent_phrases = kept
    assert row.score == 1000 * a * n // (l * r)


def test_perfect_hash():
    r = np.random.RandomState(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(r.randint(0, 2**63 - 1, n)).astype(np.uint64)
        table = PerfectHash(keys)
        assert sorted(table.find(keys)) == list(range(len(keys)))
        strange = np.setdiff1d(r.randint(0, 2**63 - 1, 5000).astype(np.uint64), keys)
        assert (table.find(strange) == -1).all()
        assert (table.keys[table.find(keys)] == keys).all()
