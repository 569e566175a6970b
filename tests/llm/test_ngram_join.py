"""Links and components against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from notewright.llm import ngram_join
from notewright.llm.components import components
from notewright.llm.ngram_join import _size_classes, jaccard_components
from notewright.llm.trie_join import TrieJoin


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def linked(a, b, num, den):
    return bool(a) and bool(b) and den * len(a & b) >= num * len(a | b)


def brute(texts, ids, width, num, den):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(texts)):
        for j in range(i):
            if linked(sets[i], sets[j], num, den):
                a, b = find(i), find(j)
                root[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    return sorted((ids[i], len(sets[i]), ids[find(i)]) for i in range(len(texts)))


def texts_of(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = ["", None, " \n", "one", "One", "one two", "a b c", "A b  c", "a b c d"]
    bases = [[r.choice(words) for _ in range(r.choice([3, 5, 11, 12, 20, 40, 90, 300]))] for _ in range(12)]
    while len(out) < n:
        w = list(r.choice(bases))
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.3:
            w = w[: len(w) - r.randint(0, max(1, len(w) // 12))]
        out.append(r.choice([" ", "\n"]).join(w))
    return out


@pytest.mark.parametrize(("width", "num", "den", "seed"), [(3, 90, 100, 1), (5, 8, 10, 2), (3, 9, 10, 3)])
def test_against_all_pairs(make, width, num, den, seed):
    texts = texts_of(seed)
    ids = [1000 - 3 * i for i in range(len(texts))]
    got = jaccard_components(make(texts, ids), width, num, den).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, ids, width, num, den)


@pytest.mark.parametrize(("num", "den", "common", "own"), [(3, 10, 310, 340), (1, 10, 110, 480), (5, 10, 340, 160)])
def test_sketches_lose_no_links_at_low_thresholds(make, num, den, common, own):
    texts = []
    for i in range(12):
        shared = [f"c{i}x{j}" for j in range(common)]
        texts += [" ".join(shared + [f"{side}{i}x{j}" for j in range(own)]) for side in "ab"]
    ids = list(range(len(texts)))
    got = jaccard_components(make(texts), 1, num, den).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, ids, 1, num, den) and all(r.component_id == r.doc_id // 2 * 2 for r in got)


def test_least_alike():
    for num, den in ((8, 10), (90, 100), (99, 100)):
        assert ngram_join._least_alike(num, den) == ngram_join.ALIKE
    assert ngram_join._least_alike(3, 10) == 0 and 0 < ngram_join._least_alike(7, 10) < ngram_join.ALIKE


def test_chunks_of_a_large_group(make, monkeypatch):
    """The same, when groups are dealt into many chunks of two sets."""
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 2)
    texts = texts_of(5, 80)
    ids = list(range(len(texts)))
    got = jaccard_components(make(texts), 3, 9, 10).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, ids, 3, 9, 10)


def test_hot_parts(make, monkeypatch):
    """The same, when parts of two sets say little already: long passages stand in all texts."""
    monkeypatch.setattr(ngram_join, "HOT", 1)
    texts = texts_of(9, 100)
    passage = " ".join(f"p{i}" for i in range(25))
    texts = [t if not t or i % 3 else f"{t} {passage}" for i, t in enumerate(texts)]
    ids = list(range(len(texts)))
    for width, num, den in ((5, 8, 10), (3, 9, 10)):
        got = jaccard_components(make(texts), width, num, den).collect()
        assert sorted(tuple(r) for r in got) == brute(texts, ids, width, num, den)


def test_odd_rows(make):
    text = " ".join(f"w{i}" for i in range(30))
    rows = jaccard_components(make([text, text, text, None, "", "x y"], [5, 5, None, 7, 8, None]), 3, 9, 10).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(5, 28, 5), (5, 28, 5), (None, 28, 5), (7, 0, 7), (8, 0, 8), (None, 1, None)], key=repr)
    assert jaccard_components(make([]), 3, 9, 10).count() == 0


def test_a_very_long_text(make):
    r = random.Random(4)
    long = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    near = list(long)
    for i in range(0, 60_000, 100):
        near[i] = "other"
    rows = {x.doc_id: x for x in jaccard_components(make([" ".join(long), " ".join(near), "short text"]), 3, 9, 10).collect()}
    assert rows[1].component_id == 0 and rows[2].component_id == 2


def test_size_classes_cover_linked_sizes():
    low, differ, parts, telling = _size_classes(9, 10, 3000)
    assert (parts > differ).all() and telling.min() == 1 < telling.max()
    for a in range(1, 3000):
        b = a * 10 // 9
        c = np.searchsorted(low, [a, b], "right") - 1
        assert c[1] - c[0] in (0, 1) and (a + b) // 19 <= differ[c[0]]


def test_trie_finds_every_link():
    r = np.random.RandomState(0)
    for _ in range(20):
        base = r.randint(0, 400, 60)
        sets = [np.unique(np.where(r.rand(60) < r.choice([0.02, 0.06, 0.3]), r.randint(0, 400, 60), base)).astype(np.uint64) for _ in range(40)]
        t = TrieJoin(sets, 9, 10)
        found = t.links()
        root = list(range(40))

        def find(x):
            return x if root[x] == x else find(root[x])

        for i in range(40):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if linked(a, b, 9, 10):
                    root[max(find(i), find(j))] = min(find(i), find(j))
        assert [t.find(i) for i in range(40)] == [find(i) for i in range(40)]
        assert all(linked(set(sets[i].tolist()), set(sets[j].tolist()), 9, 10) for i, j in found)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 90, 90: 90, 95: 90, 200: 200, 201: 200}


def test_neighbours_of_a_hub_are_split(spark):
    """Its rows of a join are dealt to several tasks by the adaptive rule, since both sides are plain shuffles."""
    from notewright.llm.components import _star

    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.range(1, 20_001, numPartitions=8).selectExpr("id as u", "if(id % 50 = 0, id - 1, 0) as v").where("u <> v")
        star = _star(edges, large=True)
        assert star.count() == 20_000
        assert "skew=true" in star._jdf.queryExecution().executedPlan().toString() or "skew=true" in _final_plan(star)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("salts", [1, 3])
def test_leaves_of_crowded_parts(salts):
    """Pairs, common rows and open rows of two rounds are those of all rows of a part together, however batches are cut."""
    import pyarrow as pa

    r = np.random.RandomState(salts)
    rows = set()  # (part, salt, key, of), in several tasks
    for part in range(60):
        many = r.choice([1, 2, 5, ngram_join.HOT, ngram_join.HOT + 1, 60])
        crowded = r.rand() < 0.5
        for key in r.permutation(500)[:many].tolist():
            for _ in range(r.randint(1, 3)):
                alone = r.rand() < 0.4
                rows.add((part, 0 if alone or not crowded else 1 + key % salts, key, 7))
                if not alone and crowded:
                    rows.add((part, 0, ngram_join.LEAST_KEY, ngram_join.MARK))

    def batches(rows, names):
        rows = sorted(rows)
        for i in range(0, len(rows), 7):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows[i : i + 7]], pa.int64()) for k in range(4)], names)

    names = ["part", "salt", "key", "of"]
    first = [x for b in ngram_join._leaves(False)(batches(rows, names)) for x in b.to_pylist()]
    still = [(x["part"], 0, x["a"], x["of"]) for x in first if x["state"] == ngram_join.OPEN]
    found = [x for x in first if x["state"] != ngram_join.OPEN] + [x for b in ngram_join._leaves(True)(batches(still, names)) for x in b.to_pylist()]
    of_part = {}
    for part, _, key, of in rows:
        if of != ngram_join.MARK:
            of_part.setdefault(part, set()).add(key)
    common = {(p, k) for p, keys in of_part.items() if len(keys) > ngram_join.HOT for k in keys}
    pairs = {(a, b) for keys in of_part.values() if len(keys) <= ngram_join.HOT for a in keys for b in keys if a < b}
    assert {(x["part"], x["a"]) for x in found if x["state"] == ngram_join.COMMON} == common
    assert {(min(x["a"], x["b"]), max(x["a"], x["b"])) for x in found if x["state"] == ngram_join.PAIR} == pairs
    in_a_part = {}
    for x in still:
        in_a_part[x[0]] = in_a_part.get(x[0], 0) + 1
    assert max(in_a_part.values(), default=0) <= (salts + 1) * ngram_join.HOT + salts + 1


def test_sketches_keep_linked_pairs():
    """Recall of the filter by sketches, which is not exact: 20,000 pairs at the threshold, none lost."""
    import pyarrow as pa

    r = np.random.RandomState(1)
    for num, den in ((9, 10), (8, 10)):
        own = 100 * (den - num) // (den + num) * 2  # of 200 shingles in all, such that num / den are common
        sets = []
        for _ in range(10_000):
            x = r.randint(1, 2**62, 200 + own).astype(np.uint64)
            sets += [np.sort(x[: 200 + own // 2]), np.sort(np.concatenate([x[:200], x[200 + own // 2 :]]))]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        sketches = [x.tobytes() for x in ngram_join._sketches(bounds, np.concatenate(sets))]
        n = [len(x) for x in sets]
        batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(range(10_000)), pa.array(n[::2]), pa.array(n[1::2]), pa.array(sketches[::2]), pa.array(sketches[1::2])], ["a", "b", "n_a", "n_b", "sketch_a", "sketch_b"])
        assert all(den * 200 >= num * (x + y - 200) for x, y in zip(n[::2], n[1::2]))
        assert sum(b.num_rows for b in ngram_join._alike(num, den)([batch])) == 10_000


def test_near_copies_that_are_not_linked_take_one_walk_each(monkeypatch):
    """A walk is a few array operations; node by node, each pair of such sets was a step of its own."""
    r = np.random.RandomState(5)
    base = r.randint(0, 1 << 40, 120)
    sets = [np.unique(np.where(r.rand(120) < r.choice([0.02, 0.1]), r.randint(0, 1 << 40, 120), base)).astype(np.uint64) for _ in range(150)]
    walks, walk = [], TrieJoin._overlaps
    monkeypatch.setattr(TrieJoin, "_overlaps", lambda self: walks.append(walk(self)) or walks[-1])
    t = TrieJoin(sets, 9, 10)
    t.has[t.sets[7]] = 1
    assert t._overlaps().tolist() == [len(np.intersect1d(s, sets[7])) for s in sets]
    t.has[:] = 0
    found = t.links()
    assert 1 < len(walks) <= 1 + len(sets)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if linked(set(sets[i].tolist()), set(sets[j].tolist()), 9, 10):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert [t.find(i) for i in range(len(sets))] == root and len(found) == len(sets) - len(set(root))


def test_checks_give_stars():
    """Of the smallest that a task has joined: chains of links would take rounds to come together."""
    import pyarrow as pa

    sets = [np.arange(i, i + 40, dtype=np.uint64).tobytes() for i in (3, 1, 0, 2)] + [np.arange(90, 99, dtype=np.uint64).tobytes()]
    got = ngram_join._check(9, 10)(pa.table({"joined": pa.array([40, 10, 30, 20, 5]), "grams": pa.array(sets, pa.binary())}))
    assert got.to_pydict() == {"a": [20, 30, 40], "b": [10, 10, 10]}
    got = ngram_join._check(9, 10)(pa.table({"joined": pa.array([40, 7, 7, 20, 7]), "grams": pa.array(sets, pa.binary())}))
    assert got.to_pydict() == {"a": [20, 40], "b": [7, 7]}


def test_stars_take_no_round(spark, monkeypatch):
    from notewright.llm import components as module

    names, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, name: names.append(name) or cut(df, name))
    got = components(spark.createDataFrame([(5, 1), (1, 7), (9, 8)], "a long, b long"), "a", "b")
    assert {r.node: r.component for r in got.collect()} == {1: 1, 5: 1, 7: 1, 8: 8, 9: 8} and names == ["edges"]


def test_tasks_of_little_data_look_for_no_garbage(spark, monkeypatch):
    """211 tasks of a few rows took longer over that than over their rows."""
    import pyarrow as pa

    from notewright.functions import batches

    done, held = [], {}
    monkeypatch.setattr(batches, "give_back", lambda: done.append(1))

    class Frame:
        sparkSession = spark

        def mapInArrow(self, task, schema):
            held["task"] = task

    batches.arrow(Frame(), lambda some: some, "a binary")
    few = pa.RecordBatch.from_pydict({"a": [b"x"]})
    assert len(list(held["task"](iter([few])))) == 1 and not done
    assert len(list(held["task"](iter([few, pa.RecordBatch.from_pydict({"a": [b"x" * batches.LITTLE]})])))) == 2 and done
