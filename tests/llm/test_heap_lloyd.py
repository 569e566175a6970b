"""Codes of vectors against plain Lloyd rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from notewright.llm import heap_lloyd as H
from notewright.llm.heap_lloyd import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, heaps int"


def brute(rows):
    """rows (vec_id, vector, label) in plain Python."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return []
    whole = lambda x: math.floor(np.float32(x).astype(float) * 1024) if abs(x) < 1e15 else int(np.float32(x)) * 1024
    width = -(-max(len(r[1]) for r in rows) // 4) * 4
    full = [[whole(x) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [float(np.float32(x)) for x in rows[i][1]]))
    w = width // 4
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    for p in range(4):
        part = [v[p * w : (p + 1) * w] for v in full]
        book = [list(part[i]) for i in order[:256]]
        near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))  # noqa: B023, E731
        for _ in range(4):
            of = [near(x)[1] for x in part]
            for k in range(len(book)):
                mine = [x for x, o in zip(part, of) if o == k]
                if mine:
                    book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        for i, x in enumerate(part):
            d, k = near(x)
            codes[i].append(f"{k:02x}")
            errors[i] += d
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = {}
    for r, e in zip(rows, errors):
        by[r[2]] = by.get(r[2], 0) + e
    fits = lambda x: x if x < 2**63 else None
    return sorted(((r[0], "".join(c), fits(e), fits(by[r[2]]) if fits(e) is not None else None, digest) for r, c, e in zip(rows, codes, errors)), key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vectors(seed, n, d, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, spread) for _ in range(d)] for _ in range(6)]
    return [(i * 3, [x + r.gauss(0, 0.2) for x in r.choice(centres)], r.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize(("block", "d", "spread"), [(16384, 8, 1.0), (50, 4, 1.0), (7, 8, 0.01)])
def test_against_plain_rounds(spark, monkeypatch, block, d, spread):
    rows = vectors(1, 700, d, spread)
    monkeypatch.setattr(H, "BLOCK", block)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(2, 60, 8)
    rows += [(1, None, 1), (2, [1.0, None] * 4, 2), (3, [float("nan")] * 8, 1), (4, [float("inf")] * 8, 1), (5, [], None)]
    rows += [(None, rows[0][1], 1), (0, rows[3][1], None), (0, rows[3][1], None), rows[5], (7, [0.5] * 5, 1), (8, [-0.25], 9), (9, [0.0, -0.0] * 4, 9)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, rows[60:65]) == []
    assert found(spark, rows[:1]) == brute(rows[:1])


def test_large_components(spark):
    """Whole numbers of any size: beyond floats' exactness, and beyond 64 bits."""
    r = random.Random(3)
    for size in (3e5, 2e9, 1e25):
        rows = [(i, [r.gauss(0, 1) * size for _ in range(4)], i % 2) for i in range(300)]
        got, want = found(spark, rows), brute(rows)
        assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]


def test_ties_and_margins():
    """Equal distances go to the lower entry, round after round; a heap leaves most of settled vectors alone."""
    r = np.random.RandomState(4)
    rows = r.randint(-4, 5, (500, 3))
    book = H.Book(np.concatenate([rows[:40], rows[:10]]))
    heaps, of = H.Heaps.first(rows, book)
    scans = []
    for _ in range(6):
        sums = [rows[of == k].sum(0).tolist() for k in range(50)]
        book = book.moved(sums, [int((of == k).sum()) for k in range(50)])
        which, _, _ = heaps.rescan(rows, book)
        heaps = H.Heaps.unpacked(heaps.packed(), 50)
        of = heaps.entry_of(len(rows))
        d = ((rows[:, None] - book.entries[None]) ** 2).sum(2)
        assert (of == d.argmin(1)).all()
        scans.append(len(which))
    far = np.concatenate([r.randint(0, 50, (300, 3)), r.randint(9000, 9050, (300, 3))])
    book = H.Book(far[[0, 300]])
    heaps, of = H.Heaps.first(far, book)
    book = book.moved([far[of == k].sum(0).tolist() for k in range(2)], [300, 300])
    assert len(heaps.rescan(far, book)[0]) == 0
