"""N-gram Jaccard join by prefix trees, with connected components of its links.

How all links are found without comparing all documents:

1. Each text becomes its set of distinct word shingles, as 64-bit hashes.
2. Sets of linked sizes a and b differ in at most (a + b) * (1 - t) / (1 + t) shingles. Sizes fall in
   classes of ratio 1 / t, so linked sets are in one class or in two neighbouring ones. For each class
   the shingles are dealt into K parts, more than the largest difference D: linked sets then have K - D
   equal parts at least. The hash of a part is the path of a trie over that part; sets at the same leaf
   are candidates. Two kinds of leaves say little: parts of few shingles (fewer than `telling`, which the
   size class fixes so that they are well under K - D in nearly all sets), and parts that more than HOT
   sets have (a passage that many documents share). They only count for sets that have K - D of them or
   more: if two linked sets have no other equal part, that is true of both. So what is common joins those
   documents alone that are little else: they are chained by as many edges as there are rows.
   No task gets all rows of a common part. A part that a task meets more than CROWD times in a slice of texts is
   crowded: its rows go from then on, by set, to
   one of many salted leaves, which either see more than HOT sets and know, or pass their few sets on; a second
   shuffle decides those. Copies of a set meet in one leaf and count once.
3. The sets at any other leaf, HOT at most, are candidates in pairs. A sketch of a set has the smallest hash
   of each of BINS classes of shingles. A shingle that differs changes one bin, so linked sets differ in no
   more bins than shingles; and they have as many bins equal as a binomial distribution of num / den gives, but
   for a chance below 1e-17 (ALIKE at most, none at low thresholds). Other pairs go. Connected candidates form groups.
   Each group's whole sets go into a trie (trie_join), which checks every pair exactly unless the two are joined already. A large
   group is dealt into chunks. Each chunk meets the group's first chunk in a task of its own, which links nearly all of a true group and gives what it joins as stars. Then sets
   outside the largest component of their group meet all sets of the group, again chunk by chunk: two sets that
   are not linked through others yet are compared in any case, and a task holds two chunks at most.
4. Components of the exact links.

Results in odd cases: a null or empty text has no shingles and is linked with nothing (its component is
its own doc_id); repeated rows each give a row; equal texts are linked; a null doc_id gets the component
of its exact copies or else null; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.components import apart, components
from notewright.llm.shared import arrow, cut, parts, text_bytes, with_texts
from notewright.llm.trie_join import TrieJoin
from notewright.llm.vectext import mix, segment_sums, shingle_sets, slices

HOT = 16  #: sets that may have a part in common before it says little
CROWD = 3  #: rows of a part in a slice of texts before it is crowded
CROWDS = 1_000_000  #: crowded parts that a task remembers; meeting one anew costs another mark
LEAST_SALTS = 16  #: leaves of a crowded part; an eighth of the shuffle's partitions if that is more
MARK, LEAST_KEY = -1, -(2**63)  #: of a mark: its `of`, and a key that sorts before others
PAIR, COMMON, OPEN = 0, 1, 2  #: rows of leaves: a pair of sets, a set with a common part, one whose part isn't decided
BINS, ALIKE = 64, 20  #: of a sketch: bins, and those that candidates have equal where the threshold is high
CHUNK_SETS, CHUNK_SHINGLES = 1000, 1_000_000  #: bounds of half of what a checking task holds


def _size_classes(num: int, den: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower bounds of the size classes; then for class c with c or c + 1: largest difference of linked sets, parts, telling size of a part)."""
    low = [1]
    while low[-1] <= most:
        low.append(max(low[-1] + 1, -(-low[-1] * den // num)))
    low += [-(-low[-1] * den // num) + 1]
    low += [-(-low[-1] * den // num) + 1]
    a = np.array(low[1:-1]) - 1  # the largest set of each class
    b = np.minimum(a * den // num, np.array(low[2:]) - 1)
    differ = (a + b) * (den - num) // (den + num)
    parts = differ + 1 + differ // 3
    telling = np.ones(len(parts), np.int64)
    for c, (n, k, d) in enumerate(zip(low, parts.tolist(), differ.tolist())):
        p = below = math.exp(-n / k)  # that a part of the smallest set of the class has fewer shingles
        while telling[c] < 8:
            p *= n / k / int(telling[c])
            if k * (below + p) + 2 * math.sqrt(k * (below + p)) > 0.9 * (k - d):
                break
            below += p
            telling[c] += 1
    return np.array(low), differ, parts, telling


def _set_ids(bounds: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(bounds).astype(np.uint64)
    return mix(segment_sums(mix(shingles), bounds) + n), mix(segment_sums(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), bounds) ^ n)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sketches(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A row of BINS bytes for each set: of the smallest shingle of each bin, 0 where there is none."""
    out = np.zeros((len(bounds) - 1) * BINS, np.uint8)
    h = mix(shingles ^ np.uint64(0x9E6C63D0876A9A35))
    place = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * BINS + (h % np.uint64(BINS)).astype(np.int64)
    out[place[::-1]] = (h[::-1] >> np.uint64(32)).astype(np.uint8) % np.uint8(255) + np.uint8(1)  # shingles ascend: the smallest is written last
    return out.reshape(-1, BINS)


def _summaries(width: int):
    def run(batches):
        for batch in parts(batches):
            texts, ids = text_bytes(batch.column("text")), batch.column("doc_id")
            for i, j in slices(texts):
                bounds, shingles = shingle_sets(texts[i:j], width)
                high, low = _set_ids(bounds, shingles)
                sketches = pa.array([x.tobytes() for x in _sketches(bounds, shingles)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.diff(bounds)), _long(high), _long(low), sketches], ["doc_id", "n", "high", "low", "sketch"])

    return run


def _least_alike(num: int, den: int) -> int:
    """Bins that linked sets have equal at least, but for a chance below 1e-17; ALIKE at most.

    A bin is equal with a chance of num / den at least. The binomial sum is exact: its tail is wider than that of a
    normal distribution at high thresholds."""
    below, most = 0, den**BINS // 10**17  # chances times den ** BINS
    for k in range(ALIKE):
        below += math.comb(BINS, k) * num**k * (den - num) ** (BINS - k)
        if below > most:
            return k
    return ALIKE


def _alike(num: int, den: int):
    """Pairs (a, b) with sizes and sketches: those that may be linked."""
    apart = BINS - _least_alike(num, den)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch_a", "sketch_b"))
            differ = np.count_nonzero(x != y, axis=1)
            most = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (den - num) // (den + num)
            keep = pa.array(differ <= np.minimum(most, apart))
            yield batch.select(["a", "b"]).filter(keep)

    return run


class _Crowds:
    """Parts that a task has met more than CROWD times at once: CROWDS of them at most are remembered, and met anew beyond that."""

    def __init__(self):
        self.known = np.zeros(0, np.uint64)

    def meet(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each part is crowded, parts that became so just now)."""
        names, at, count = np.unique(out, return_inverse=True, return_counts=True)
        old = np.zeros(len(names), bool)
        if len(self.known) and len(names):
            place = np.minimum(np.searchsorted(self.known, names), len(self.known) - 1)
            old = self.known[place] == names
        now = (count > CROWD) & ~old
        if now.any():
            kept = self.known if len(self.known) < CROWDS else self.known[:0]
            self.known = np.sort(np.concatenate([kept, names[now]]))
        return (old | now)[at], names[now]


def _part_keys(width: int, num: int, den: int, salts: int):
    """Rows (part key, salt, set key, of): for each set its parts in the trees of its class and of the class below.

    of holds the class and how many of the equal parts with a linked set are of a telling size at least. The others
    are left out unless that may be none. Crowded parts have a salt by their set and, once a task, a mark under salt 0."""

    def run(batches):
        seen: set[int] = set()
        crowds = _Crowds()
        low, differ, n_parts, telling = _size_classes(num, den, 1 << 12)
        for batch in parts(batches):
            texts = text_bytes(batch.column("text"))
            for i, j in slices(texts, 1 << 20):
                bounds, shingles = shingle_sets(texts[i:j], width)
                n, key = np.diff(bounds), _set_ids(bounds, shingles)[0]
                if len(n) and n.max() >= low[-4]:
                    low, differ, n_parts, telling = _size_classes(num, den, 2 * int(n.max()))
                new = np.zeros(len(n), bool)
                for k, x in enumerate(key.tolist()):  # copies within a task count once
                    if n[k] and x not in seen:
                        seen.add(x)
                        new[k] = True
                shingles, n, key = shingles[np.repeat(new, n)], n[new], key[new]
                sets = np.repeat(np.arange(len(n)), n)
                for down in (0, 1):
                    c = np.searchsorted(low, n, "right") - 1 - down
                    use = c >= 0
                    count = np.where(use, n_parts[np.maximum(c, 0)], 0)
                    first = np.concatenate([[0], np.cumsum(count)])
                    inside = use[sets]
                    owner, h = sets[inside], mix(shingles[inside] ^ np.uint64(0x2545F4914F6CDD1D))
                    part = (((h >> np.uint64(32)) * count[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
                    sums = np.zeros(first[-1], np.uint64)
                    at = first[owner] + part
                    np.add.at(sums, at, h)
                    of = np.repeat(np.arange(len(n)), count)
                    full = np.bincount(at, minlength=first[-1]) >= telling[np.maximum(c, 0)][of]
                    small = np.bincount(of[~full], minlength=len(n))
                    least = np.maximum(count - np.where(use, differ[np.maximum(c, 0)], 0) - small, 0)
                    number = np.arange(first[-1]) - first[of]
                    emit = full | (least[of] == 0)
                    out = mix(sums + mix((c[of].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64)))[emit]
                    of = of[emit]
                    crowded, new_crowds = crowds.meet(out)
                    salt = np.where(crowded, 1 + (key[of] % np.uint64(salts)).astype(np.int64), 0)
                    marks = len(new_crowds)
                    columns = [np.concatenate(x) for x in ((out.view(np.int64), new_crowds.view(np.int64)), (salt, np.zeros(marks, np.int64)), (key[of].view(np.int64), np.full(marks, LEAST_KEY)), ((c.astype(np.int64) << 32 | least)[of], np.full(marks, MARK)))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["part", "salt", "key", "of"])

    return run


def _pairs(p: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of keys with the same part, once each; rows are sorted by both."""
    found = []
    for d in range(1, HOT):
        same = p[d:] == p[:-d]
        if not same.any():
            break
        found.append(np.stack([k[:-d][same], k[d:][same]]))
    if not found:
        return k[:0], k[:0]
    a, b = np.concatenate(found, axis=1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[once], b[once]


def _leaves(last: bool):
    """Rows sorted by part, salt and key: pairs (a, b) of the sets of a small leaf, or its rows (a, part, of) otherwise.

    A leaf with a salt or a mark is one of several of its part: unless it has more than HOT sets, its rows stay open,
    and if it has, an open mark says so. In the last round a leaf is all of its part, and a mark makes it common."""
    names, none = ["state", "a", "b", "part", "of"], np.zeros(0, np.int64)

    def rows(state, a, part, of):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), state, np.int32)), pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(part), pa.array(of)], names)

    def run(batches):
        held, known = (none,) * 4, None  # rows of a leaf that isn't over; a leaf that is known to be common
        for batch in _and_end(batches):
            p, s, k, o = held if batch is None else (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("part", "salt", "key", "of")))
            if not len(p):
                continue
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
            once = new | np.concatenate([[True], k[1:] != k[:-1]])
            p, s, k, o, new = p[once], s[once], k[once], o[once], new[once]
            starts, leaf = np.flatnonzero(new), np.cumsum(new) - 1
            mark = o == MARK
            size = np.bincount(leaf[~mark], minlength=len(starts))
            marked, going_on = mark[starts], known == (int(p[0]), int(s[0]))
            common = size > HOT
            if last:
                common |= marked
            common[0] |= going_on
            over = np.ones(len(p), bool)
            if batch is None or common[-1]:
                held = (none,) * 4
                known = (int(p[-1]), int(s[-1])) if common[-1] else None
            else:
                over[starts[-1] :] = False
                held, known = tuple(x[starts[-1] :] for x in (p, s, k, o)), None
            several = np.zeros(len(starts), bool) if last else (s[starts] != 0) | marked
            for state, of_leaf in ((PAIR, ~common & ~several), (COMMON, common), (OPEN, ~common & several)):
                of = of_leaf[leaf] & over & ~mark
                if state == PAIR and of.any():
                    a, b = _pairs(p[of], k[of])
                    gone = pa.nulls(len(b), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), PAIR, np.int32)), pa.array(a), pa.array(b), gone, gone], names)
                elif of.any():
                    yield rows(state, k[of], p[of], o[of])
            said = common & several
            said[0] &= not going_on
            if said.any():
                at = starts[said]
                yield rows(OPEN, np.full(len(at), LEAST_KEY), p[at], np.full(len(at), MARK))

    return run


def _and_end(batches):
    """The batches, then None."""
    yield from batches
    yield None


def _sets_of(width: int):
    """Rows of texts that stand for a set, with that set; a text under the same doc_id with another set is left out."""

    def run(batches):
        for batch in parts(batches):
            texts = text_bytes(batch.column("text"))
            for i, j in slices(texts):
                bounds, shingles = shingle_sets(texts[i:j], width)
                high, low = _set_ids(bounds, shingles)
                part = batch.slice(i, j - i)
                right = (part.column("high").to_numpy() == high.view(np.int64)) & (part.column("low").to_numpy() == low.view(np.int64))
                sets = pa.array([shingles[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())
                names = [c for c in part.schema.names if c not in ("text", "high", "low")]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), sets], [*names, "grams"]).filter(pa.array(right))

    return run


def _check(num: int, den: int):
    """Components of the exact links of a task, as stars: edges from what is known to be joined to the smallest that it is linked with."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        joined = table.column("joined").to_pylist()
        join = TrieJoin([np.frombuffer(x.as_py(), np.uint64) for x in table.column("grams")], num, den, joined)
        join.links()
        roots, least = [join.find(i) for i in range(len(joined))], {}
        for r, x in zip(roots, joined):
            least[r] = min(x, least.get(r, x))
        edges = sorted({(x, least[r]) for r, x in zip(roots, joined) if x != least[r]})
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return run


def _candidates(rows: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b): edges between keys of sets whose components hold all linked sets."""
    salts = max(LEAST_SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    keys = arrow(rows, _part_keys(width, num, den, salts), "part long, salt long, key long, of long")
    leaf = "state int, a long, b long, part long, of long"
    first = cut(arrow(keys.repartition("part", "salt").sortWithinPartitions("part", "salt", "key"), _leaves(last=False), leaf), "leaves")
    # A part has HOT open rows for each salt and a mark for each task at most.
    still = first.where(F.col("state") == OPEN).select("part", F.lit(0).cast("long").alias("salt"), F.col("a").alias("key"), "of")
    second = cut(arrow(still.repartition("part").sortWithinPartitions("part", "key"), _leaves(last=True), leaf), "open-leaves")
    found = first.where(F.col("state") != OPEN).unionByName(second)

    common = found.where(F.col("state") == COMMON).select("part", F.col("a").alias("key"), "of")
    little_else = common.groupBy("key", "of").agg(F.count_distinct("part").alias("n")).where("n >= (of & 4294967295)").select("key", "of")
    chained = cut(common.join(little_else, ["key", "of"], "left_semi").select("part", "key"), "common")
    heads = chained.groupBy("part").agg(F.min("key").alias("head"))
    chained = chained.join(apart(heads, "part"), "part").where("head <> key").select(F.col("head").alias("a"), F.col("key").alias("b"))

    pairs = found.where(F.col("state") == PAIR).select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("high").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")).hint("merge"), side)
    return chained.unionByName(arrow(pairs, _alike(num, den), "a long, b long"))


def _dealt(rows: DataFrame, members: DataFrame, width: int, schema: str) -> DataFrame:
    """members (doc_id, high, low, ...) with the sets of their texts: the rows that tasks check."""
    return arrow(rows.join(members.hint("merge"), "doc_id"), _sets_of(width), f"doc_id long, {schema}, grams binary")


def _links(rows: DataFrame, members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b): edges that have the same components as all exact links between members (doc_id, n, high, low, group)."""
    sizes = members.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / F.lit(CHUNK_SETS), F.sum("n") / F.lit(CHUNK_SHINGLES))).cast("int").alias("chunks"), F.count("*").alias("size")).where("size > 1")
    members = members.join(apart(sizes.drop("size"), "group"), "group")
    chunk = lambda of: F.pmod(F.xxhash64("doc_id"), of).cast("int")
    check = _check(num, den)

    # The first chunk of each group meets all chunks.
    ready = _dealt(rows, members.select("doc_id", "high", "low", "group", "chunks"), width, "group long, chunks int")
    ready = ready.withColumn("mine", chunk(F.col("chunks"))).withColumn("i", F.explode(F.expr("if(mine = 0, sequence(0, chunks - 1), array(mine))")))
    first = cut(ready.select("group", "i", F.col("doc_id").alias("joined"), "grams").groupBy("group", "i").applyInArrow(check, "a long, b long"), "links")

    # What is outside the largest component of its group meets all of it.
    many = cut(members.where("chunks > 1"), "many")
    if many.isEmpty():
        return first
    joined = components(first, "a", "b")
    known = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    many = cut(many.join(joined, many.doc_id == joined.node, "left").select("doc_id", "n", "high", "low", "group", F.coalesce("component", "doc_id").alias("joined")), "many-joined")
    parts_of = cut(many.groupBy("group", "joined").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")), "joined-sizes")
    largest = parts_of.groupBy("group").agg(F.max(F.struct("sets", "joined")).alias("top"), F.count("*").alias("several"), F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles")).where("several > 1")
    if largest.isEmpty():
        return known
    top = parts_of.select("group", "joined", F.col("shingles").alias("top_shingles"))
    largest = largest.select("group", F.col("top.joined").alias("joined"), F.col("top.sets").alias("top_sets"), "sets", "shingles").join(top, ["group", "joined"])
    pieces = lambda sets, shingles: F.ceil(F.greatest(sets / F.lit(CHUNK_SETS), shingles / F.lit(CHUNK_SHINGLES), F.lit(1))).cast("int")
    largest = largest.select("group", F.col("joined").alias("top"), pieces(F.col("sets") - F.col("top_sets"), F.col("shingles") - F.col("top_shingles")).alias("others"), pieces(F.col("top_sets"), F.col("top_shingles")).alias("tops"))
    rest = many.join(apart(largest, "group"), "group").select("doc_id", "high", "low", "group", "joined", (F.col("joined") == F.col("top")).alias("in_top"), "others", "tops")
    ready = _dealt(rows, rest, width, "group long, joined long, in_top boolean, others int, tops int")
    ready = ready.withColumn("mine", F.when(F.col("in_top"), chunk(F.col("tops"))).otherwise(chunk(F.col("others"))))
    # Tasks (i, j): chunk i of the others with chunk j of them (j >= i), or with chunk -1 - j of the largest component.
    tasks = "if(in_top, transform(sequence(0, others - 1), i -> struct(i as i, -1 - mine as j)), concat(transform(sequence(0, others - 1), x -> struct(least(x, mine) as i, greatest(x, mine) as j)), transform(sequence(0, tops - 1), x -> struct(mine as i, -1 - x as j))))"
    ready = ready.withColumn("task", F.explode(F.expr(tasks))).select("group", "task.i", "task.j", "joined", "grams")
    return known.unionByName(cut(ready.groupBy("group", "i", "j").applyInArrow(check, "a long, b long"), "more-links"))


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Texts link when den * |intersection| >= num * |union| of their shingle sets; see the module for odd cases."""
    rows = with_texts(docs)
    summary = cut(arrow(rows, _summaries(width), "doc_id long, n long, high long, low long, sketch binary"), "set-ids")
    sets = summary.where("n > 0").groupBy("high", "low", "n").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch"))
    groups = components(cut(_candidates(rows, sets, width, num, den), "candidates"), "a", "b")
    members = sets.join(groups, sets.high == groups.node).select(F.col("rep").alias("doc_id"), "n", "high", "low", F.col("component").alias("group")).where("doc_id is not null")
    linked = components(_links(rows, cut(members, "members"), width, num, den), "a", "b")
    of_set = sets.join(linked, sets.rep == linked.node, "left").select("high", "low", F.coalesce("component", "rep").alias("component"))
    return summary.join(of_set, ["high", "low"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
