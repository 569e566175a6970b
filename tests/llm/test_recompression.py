"""Repeated passages against all windows in plain Python."""

import random

import numpy as np

from notewright.llm import recompression as R
from notewright.llm.recompression import without_repeats


def brute(rows, width):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - width + 1) if i is not None else ():
            g = tuple(w[p : p + width])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {p + k for p in range(len(w) - width + 1) if i is not None and first[tuple(w[p : p + width])] < i for k in range(width)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=repr)


def texts_of(seed, n, words):
    """Texts of few words, runs of one word and copied passages of all lengths about that of a window."""
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(words)]
    passages = [[r.choice(pool) for _ in range(r.choice([4, 12, 13, 14, 15, 20, 40, 150]))] for _ in range(20)]
    out = []
    for _ in range(n):
        t = []
        for _ in range(r.randint(0, 6)):
            kind = r.random()
            t += r.choice(passages) if kind < 0.4 else [r.choice(pool)] * r.randint(1, 30) if kind < 0.6 else [r.choice(pool) for _ in range(r.randint(1, 25))]
        out.append(r.choice([" ", "\n", " \t"]).join(t))
    return out + out[: n // 8]


def found(docs, width=13):
    return sorted((tuple(r) for r in without_repeats(docs, width).collect()), key=repr)


def test_against_all_windows(make):
    for seed, words, width in ((1, 3, 13), (2, 40, 13), (3, 5000, 13), (4, 6, 4), (5, 2, 1)):
        texts = texts_of(seed, 60, words)
        ids = random.Random(seed).sample(range(10_000), len(texts))
        assert found(make(texts, ids), width) == brute(list(zip(ids, texts)), width)


def test_odd_rows(make):
    long = " ".join(f"w{i}" for i in range(30))
    other = "x " + " ".join(f"w{i}" for i in range(3, 19)) + " y"
    texts = [long, long, other, other, None, "", " \n", long, "É b " + long, long]
    ids = [5, 5, 5, 7, 8, 9, 10, None, 3, None]
    assert found(make(texts, ids)) == brute(list(zip(ids, texts)), 13)
    assert found(make([])) == []
    only = make(["a b"], [1]).select("doc_id", "text")
    assert found(only) == [(1, 2, 0, "a b")]


def test_a_very_long_text(make):
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    texts = [" ".join(words[1000:1040]), " ".join(words), "a " * 100_000, "b " + "a " * 13]
    assert found(make(texts)) == brute(list(enumerate(texts)), 13)


def test_equal_windows_have_one_symbol():
    """Whatever stands around a window, the symbol is the same; and most symbols say more than a word."""
    r = random.Random(3)
    for words in (2, 5, 1000):
        pool = [f"w{i}".encode() for i in range(words)]
        window = [r.choice(pool) for _ in range(13)]
        texts = [b" ".join([r.choice(pool) for _ in range(r.randint(0, 40))] + window + [r.choice(pool) for _ in range(r.randint(0, 40))]) for _ in range(200)]
        w = R.Windows(texts, 13)
        a, b = w.keys(np.arange(len(w.start)))
        of = {}
        for key, symbol in zip(zip(a, b), w.symbol):
            assert of.setdefault(key, symbol) == symbol
        if words == 1000:
            assert np.isin(w.symbol, w.word).mean() < 0.1
