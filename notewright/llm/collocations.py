"""Collocations: phrases of each language whose words stand together more often than chance has them.

Level by level. Words are counted by Spark. A phrase of m words can only be frequent if its first and its last m - 1 words
are (Apriori), so mappers look at no others. From three words on they first bincount these by a hash of the phrase, the counts
cut off at the threshold; the sum of all mappers' arrays says which buckets hold enough for a frequent phrase. (The buckets
lose nothing. Pairs of frequent words are nearly as many as words and would fill them all.) Of the phrases in those, each
mapper sends its own with their counts, cut off too: enough to tell a safe candidate and nothing else. The candidates get a minimal perfect hash in which their keys are
stored: a key is the slot of the phrase without its last word, and that word's slot, so equal keys are equal phrases and
a foreign key is told apart. Mappers replace each occurrence by its slot, bincount the slots in numpy arrays, and these are
summed over a tree of tasks. The slots are what the next level starts from, and what cuts are read by: for each phrase the
counts of its first and last 1, 2, ... words.

A hash is sent to all tasks only for BLOCK candidates at most; more are done block after block over the rows of slots.
The driver holds one block. Words are told apart by 128 bits of hash in the tasks, and by themselves where they are counted.

Odd rows: a null language is `und`, a null or empty text has no words, equal rows count each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.perfect_hash import PerfectHash
from notewright.llm.shared import arrow, cut, drop, text_bytes
from notewright.llm.vectext import mix, ranges_hash, slices, word_ranges

LEAST, LONGEST, BEST = 100, 5, 2000
BLOCK = 4 << 20  #: candidates of a hash that goes to all tasks: about 25 bytes each
SLICE = 8192  #: counts of a piece of an array that tasks add up
FAN = 16  #: arrays that a task of the tree adds up for each piece
BUCKETS, BUCKETS_SENT = 1 << 25, 1 << 16  #: of safe phrases at most, a byte each in a mapper; and in a piece of an array
WORDS_HELD, KEYS_HELD = 200_000, 1 << 20  #: that a mapper counts before it sends them on

_BREAK = np.zeros(256, bool)
_BREAK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_OTHER = np.random.RandomState(77).permutation(256).astype(np.uint8)


def _words(texts: list[bytes]):
    """(bytes, starts, ends, two hashes, new: whether a piece begins with it) of all words."""
    data, _, _, start, end = word_ranges(texts, _APART)
    pieces = np.cumsum(_BREAK[data])[start]
    new = np.concatenate([[True], pieces[1:] != pieces[:-1]])[: len(start)]
    return data, start, end, ranges_hash(data, start, end), ranges_hash(_OTHER[data], end - (end - start), end), new


def _by_language(batches):
    """(language, texts of about 2 MB) of the rows of batches."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        order = np.asarray(langs.indices)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = text_bytes(batch.column("text").take(pa.array(np.flatnonzero(order == k))))
            for i, j in slices(texts):
                yield lang, texts[i:j]


def _count_words(most: int):
    """(lang, word, n), each word once for `most` words or so; a row without a word has what all words amount to."""

    def run(batches):
        held: dict[str, dict[bytes, int]] = {}
        for lang, texts in _by_language(batches):
            counts = held.setdefault(lang, {})
            for word, n in _distinct_words(texts):
                counts[word] = counts.get(word, 0) + n
            if sum(map(len, held.values())) > most:
                yield from _sums(held)
        yield from _sums(held)

    return run


def _distinct_words(texts: list[bytes]):
    data, start, end, a, b, _ = _words(texts)
    _, first, of, n = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
    if (b[first][of] != b).any():  # two words of one hash
        _, first, n = np.unique(np.stack([a, b], 1), axis=0, return_index=True, return_counts=True)
    whole = data.tobytes()
    return ((whole[s:e], k) for s, e, k in zip(start[first].tolist(), end[first].tolist(), n.tolist()))


def _sums(held: dict[str, dict[bytes, int]]):
    for lang, counts in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(counts) + 1), pa.string()), pa.array([*counts, None], pa.binary()), pa.array([*counts.values(), sum(counts.values())], pa.int64())], ["lang", "word", "n"])
    held.clear()


def _salt(lang: str) -> np.uint64:
    return mix(np.array([zlib.crc32(lang.encode())], np.uint64))[0]


class _Vocabulary:
    """Slots of a block of words of all languages."""

    def __init__(self, table: pa.Table, base: int):
        words = table.column("word").to_pylist()
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        start = np.concatenate([[0], end])[:-1][: len(end)]
        langs = table.column("lang").combine_chunks().dictionary_encode()
        salts = np.array([_salt(x) for x in langs.dictionary.to_pylist()], np.uint64)[np.asarray(langs.indices)]
        a, b = ranges_hash(data, start, end) + salts, ranges_hash(_OTHER[data], start, end)
        self.base, self.odd = base, np.uint64(1)
        while len(np.unique(keys := self._key(a, b))) < len(keys):
            self.odd += np.uint64(2)
        self.hash = PerfectHash(keys)
        self.second = np.empty(len(keys), np.uint64)
        self.second[self.hash.find(keys)] = b

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * self.odd + (b >> np.uint64(7)))

    def find(self, a: np.ndarray, b: np.ndarray, lang: str) -> np.ndarray:
        out = self.hash.find(self._key(a + _salt(lang), b))
        at = np.flatnonzero(out >= 0)
        out[at[self.second[out[at]] != b[at]]] = -1
        return np.where(out >= 0, out + self.base, -1)


def _bytes_of(x: np.ndarray, kind: str) -> pa.Array:
    """An array as a value of a table, its length in front."""
    data = x.astype(kind).tobytes()
    return pa.array([len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)], pa.binary())


def _array_of(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def _hashes(batches):
    """(lang, a, b, new): hashes of words, for vocabularies of more than a block."""
    for lang, texts in _by_language(batches):
        _, _, _, a, b, new = _words(texts)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), _bytes_of(a, "<u8"), _bytes_of(b, "<u8"), _bytes_of(new, "u1"), _bytes_of(np.full(len(a), -1), "<i4")], ["lang", "a", "b", "new", "ids"])


def _packed(ids: np.ndarray, slots: np.ndarray, m: int) -> pa.RecordBatch:
    """A row of words and of slots of the phrases of m words that begin at them; of words in no such phrase a -1 is left."""
    alive = slots >= 0
    for k in range(1, m):
        alive[k:] |= slots[:-k] >= 0
    keep = alive.copy()
    keep[1:] |= alive[:-1]
    ids = np.where(alive, ids, -1)[keep]
    return pa.RecordBatch.from_arrays([_bytes_of(ids, "<i4"), _bytes_of(slots[keep], "<i4")], ["ids", "slots"])


def _with_breaks(ids: np.ndarray, new: np.ndarray) -> np.ndarray:
    """ids with a -1 in front of each piece."""
    return np.insert(ids, np.flatnonzero(new), -1)


def _encode(vocabulary):
    """Texts to rows of word slots."""

    def run(batches):
        for lang, texts in _by_language(batches):
            _, _, _, a, b, new = _words(texts)
            distinct, first, of = np.unique(a, return_index=True, return_inverse=True)
            found = vocabulary.value.find(distinct, b[first], lang)[of]
            found = found if (b[first][of] == b).all() else vocabulary.value.find(a, b, lang)
            ids = _with_breaks(found, new)
            yield _packed(ids, ids, 1)

    return run


def _encode_block(vocabulary, last: bool):
    """Rows of hashes to the same with the slots of a block; the last block leaves the slots alone."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                a, b, ids = _array_of(row["a"], "<u8"), _array_of(row["b"], "<u8"), _array_of(row["ids"], "<i4")
                found = vocabulary.value.find(a, b, row["lang"])
                ids = np.where(found >= 0, found, ids)
                if last:
                    ids = _with_breaks(ids, _array_of(row["new"], "u1").astype(bool))
                    yield _packed(ids, ids, 1)
                else:
                    yield pa.RecordBatch.from_pylist([row | {"ids": _bytes_of(ids, "<i4")[0].as_py()}], batch.schema)

    return run


def _rows_of(batches, *columns):
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(_array_of(batch.column(c)[i].as_py(), "<i4").astype(np.int64) for c in columns)


def _keys_of(ids: np.ndarray, slots: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(where, key) of the phrases of m words that are safe: the first and the last m - 1 words have slots."""
    n = max(len(ids) - m + 1, 0)
    at = np.flatnonzero((slots[:n] >= 0) & (slots[1 : n + 1] >= 0)) if n else np.zeros(0, np.int64)
    return at, slots[at] << 32 | ids[at + m - 1]


def _candidates(m: int, least: int, most: int, full):
    """(key, n, suffix): phrases of a mapper that are safe and in full buckets, with counts up to `least`; the suffix of two words is in the key."""

    def run(batches):
        held, n = [], 0

        def rows():
            key, suffix = (np.concatenate(x) for x in zip(*held))
            key, first, count = np.unique(key, return_index=True, return_counts=True)
            columns = [pa.array(key), pa.array(np.minimum(count, least).astype(np.int16 if least < 1 << 15 else np.int64))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(suffix[first])], ["key", "n", "suffix"]) if m > 2 else pa.RecordBatch.from_arrays(columns, ["key", "n"])

        bits = full.value
        for ids, slots in _rows_of(batches, "ids", "slots"):
            at, key = _keys_of(ids, slots, m)
            bucket = _bucket_of(key, 8 * len(bits))
            may = bits[bucket >> 3] >> (7 - (bucket & 7)) & 1 == 1
            at, key = at[may], key[may]
            held.append((key, slots[at + 1]))
            n += len(key)
            if n > most:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    return run


class _Phrases:
    """Slots of a block of phrases."""

    def __init__(self, keys: np.ndarray, base: int):
        self.hash, self.base = PerfectHash(keys.astype(np.uint64)), base

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = self.hash.find(keys.astype(np.uint64))
        return np.where(out >= 0, out + self.base, -1)


def _fill(phrases, m: int, first: bool, last: bool):
    """Rows with the slots of a block of phrases of m words; `before` keeps the slots that all blocks start from."""

    def run(batches):
        for row in _rows_of(batches, "ids", "slots", *([] if first else ["before"])):
            ids, slots, before = row[0], row[1] if not first else np.full(len(row[0]), -1), row[1] if first else row[2]
            at, key = _keys_of(ids, before, m)
            found = phrases.value.find(key)
            slots[at[found >= 0]] = found[found >= 0]
            if last:
                yield _packed(ids, slots, m)
            else:
                yield pa.RecordBatch.from_arrays([_bytes_of(ids, "<i4"), _bytes_of(slots, "<i4"), _bytes_of(before, "<i4")], ["ids", "slots", "before"])

    return run


def _pieces(counts: np.ndarray, node: int, base: int, size: int):
    """(piece, node, counts) of the pieces of an array that aren't zero."""
    for i in range(0, len(counts), size):
        if counts[i : i + size].any():
            yield pa.RecordBatch.from_arrays([pa.array([(base + i) // size], pa.int32()), pa.array([node], pa.int32()), _bytes_of(counts[i : i + size], counts.dtype.str)], ["piece", "node", "counts"])


def _full_buckets(m: int, buckets: int, least: int):
    """Counts up to `least` of a task's safe phrases, by a hash of their keys."""

    def run(batches):
        total = np.zeros(buckets, "u1" if least < 128 else "<u4")
        for ids, slots in _rows_of(batches, "ids", "slots"):
            which, n = np.unique(_bucket_of(_keys_of(ids, slots, m)[1], buckets), return_counts=True)
            total[which] = np.minimum(total[which] + n, least)
        yield from _pieces(total, TaskContext.get().partitionId(), 0, BUCKETS_SENT)

    return run


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)


def _bincounts(low: int, high: int, size: int):
    """Counts of the slots from low to high in a task's rows."""

    def run(batches):
        total = np.zeros(high - low, np.int64)
        for (slots,) in _rows_of(batches, "slots"):
            here = slots[(slots >= low) & (slots < high)] - low
            if len(here):
                total += np.bincount(here, minlength=high - low)
        yield from _pieces(total, TaskContext.get().partitionId(), low, size)

    return run


def _add(kind: str, most: int | None, finish=None):
    """Sums (up to `most`) of the arrays of a piece and node; at the root, what `finish` makes of a piece and its array."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for piece, node, counts in zip(batch.column("piece").to_pylist(), batch.column("node").to_pylist(), batch.column("counts").to_pylist()):
                x, at = _array_of(counts, kind), (piece, node)
                x = sums[at] + x if at in sums else x
                sums[at] = x if most is None else np.minimum(x, most)
        for (piece, node), x in sums.items():
            yield finish(piece, x) if finish else pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([node], pa.int32()), _bytes_of(x, kind)], ["piece", "node", "counts"])

    return run


def tree_sum(arrays: DataFrame, nodes: int, finish, schema: str, kind: str = "<i8", most: int | None = None) -> DataFrame:
    """Arrays (piece, node, counts) added up over a tree of tasks, FAN nodes of a piece at a time, until one node is left."""
    while True:
        nodes = -(-nodes // FAN)
        arrays = arrays.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).repartition("piece", "node")
        if nodes == 1:
            return arrow(arrays, _add(kind, most, finish), schema)
        arrays = arrow(arrays, _add(kind, most), _ARRAYS)


def _by_slot(size: int):
    return lambda piece, x: pa.RecordBatch.from_arrays([pa.array(np.arange(piece * size, piece * size + len(x))), pa.array(x)], ["slot", "f"])


def _full(least: int):
    return lambda piece, x: pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.packbits(x >= least).tobytes()], pa.binary())], ["piece", "bits"])


def _full_of(rows: DataFrame, m: int, least: int, occurrences: int) -> np.ndarray:
    """Which buckets of safe phrases of m words are full: a phrase of another one can't be frequent. BUCKETS at most, a bit each."""
    n = min(BUCKETS, max(1 << 16, 1 << max(occurrences // 16, 1).bit_length()))
    arrays = arrow(rows, _full_buckets(m, n, least), _ARRAYS)
    pieces = tree_sum(arrays, rows.rdd.getNumPartitions(), _full(least), "piece int, bits binary", "u1" if least < 128 else "<u4", least)
    bits, size = np.zeros(n // 8, np.uint8), BUCKETS_SENT // 8
    for r in pieces.collect():
        bits[r.piece * size : r.piece * size + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return bits


_ROWS, _ARRAYS = "ids binary, slots binary", "piece int, node int, counts binary"


def _blocks(candidates: DataFrame, *key: str):
    """The candidates, in parts of about BLOCK rows."""
    n = -(-candidates.count() // BLOCK)
    return [candidates.where(F.pmod(F.xxhash64(*key), F.lit(n)) == b) for b in range(n)]


def _slotted(find):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(find(batch))], [*batch.schema.names, "slot"])

    return run


def _word_slots(texts: DataFrame, words: DataFrame):
    """(rows of word slots, words with their slots)."""
    spark, blocks, base, slotted = texts.sparkSession, _blocks(words, "lang", "word"), 0, None
    rows = None if len(blocks) == 1 else cut(arrow(texts, _hashes, "lang string, a binary, b binary, new binary, ids binary"), "hashes")
    for i, block in enumerate(blocks):
        found = block.select("lang", "word").toArrow()  # BLOCK rows or so
        vocabulary = spark.sparkContext.broadcast(_Vocabulary(found, base))
        base += found.num_rows

        def find(batch, vocabulary=vocabulary):
            data, a, b = b"", [], []
            out = np.empty(batch.num_rows, np.int64)
            for k, (lang, word) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist())):
                data = np.frombuffer(word, np.uint8)
                at, end = np.zeros(1, np.int64), np.full(1, len(word))
                a, b = ranges_hash(data, at, end), ranges_hash(_OTHER[data], at, end)
                out[k] = vocabulary.value.find(a, b, lang)[0]
            return out

        named = arrow(block, _slotted(find), "lang string, word binary, f long, slot long")
        slotted = named if slotted is None else slotted.unionByName(named)
        if rows is None:
            rows = cut(arrow(texts, _encode(vocabulary), _ROWS), "words")
        else:
            last = i + 1 == len(blocks)
            before, rows = rows, cut(arrow(rows, _encode_block(vocabulary, last), _ROWS if last else rows.schema), "words")
            drop(before)
    return rows, cut(slotted, "vocabulary")


def _phrase_slots(rows: DataFrame, candidates: DataFrame, m: int):
    """(rows of slots of phrases of m words, candidates with slot and count)."""
    spark, blocks, base, known = rows.sparkSession, _blocks(candidates, "key"), 0, None
    edges = []
    for i, block in enumerate(blocks):
        keys = block.select("key").toArrow().column("key").to_numpy()  # BLOCK rows or so
        phrases, last = spark.sparkContext.broadcast(_Phrases(keys, base)), i + 1 == len(blocks)
        edges.append((base, base + len(keys)))
        base = -(-(base + len(keys)) // SLICE) * SLICE  # blocks begin with a piece of their own
        named = arrow(block, _slotted(lambda batch, p=phrases: p.value.find(batch.column("key").to_numpy())), "key long, suffix long, slot long")
        known = named if known is None else known.unionByName(named)
        before, rows = rows, cut(arrow(rows, _fill(phrases, m, i == 0, last), _ROWS + ("" if last else ", before binary")), f"phrases{m}")
        drop(before)
    nodes, counts = rows.rdd.getNumPartitions(), None
    for low, high in edges:
        part = tree_sum(arrow(rows.select("slots"), _bincounts(low, high, SLICE), _ARRAYS), nodes, _by_slot(SLICE), "slot long, f long").where("f > 0")
        counts = part if counts is None else counts.unionByName(part)
    return rows, known.join(counts, "slot")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST):
    """(languages, levels): (lang, n), and for each length (slot, lang, phrase, last_word, f, firsts, lasts, prefix, suffix) of frequent phrases.

    firsts and lasts: counts of a phrase's first and last 1, 2, ... words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = cut(arrow(texts, _count_words(WORDS_HELD), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("f")).where(f"word is null or f >= {int(least)}"), "words")
    languages = words.where("word is null").select("lang", F.col("f").alias("n"))
    vocabulary = words.where("word is not null")
    if vocabulary.isEmpty():
        return languages, []
    rows, vocabulary = _word_slots(texts, vocabulary)
    word, one = F.col("word").cast("string"), F.array("f")
    levels = [vocabulary.select("slot", "lang", word.alias("phrase"), word.alias("last_word"), "f", one.alias("firsts"), one.alias("lasts"), F.lit(None).cast("long").alias("prefix"), F.lit(None).cast("long").alias("suffix"))]
    for m in range(2, longest + 1):
        bits = _full_of(rows, m, least, levels[-1].agg(F.sum("f")).first()[0]) if m > 2 else np.full(1, 255, np.uint8)
        full = docs.sparkSession.sparkContext.broadcast(bits)
        found = arrow(rows, _candidates(m, least, KEYS_HELD, full), f"key long, n {'short' if least < 1 << 15 else 'long'}" + (", suffix long" if m > 2 else ""))
        suffix = F.first("suffix") if m > 2 else F.expr("key & 4294967295")
        safe = found.groupBy("key").agg(suffix.alias("suffix"), F.sum("n").alias("n"))
        candidates = cut(safe.where(f"n >= {int(least)}").drop("n"), f"candidates{m}")
        if candidates.isEmpty():
            break
        rows, found = _phrase_slots(rows, candidates, m)
        found = found.select("slot", "f", F.shiftright("key", 32).alias("prefix"), "suffix")
        head = levels[-1].select(F.col("slot").alias("prefix"), "lang", F.col("phrase").alias("head"), "firsts")
        tail = levels[-1].select(F.col("slot").alias("suffix"), "last_word", "lasts")
        both = found.join(head, "prefix").join(tail, "suffix")
        levels.append(cut(both.select("slot", "lang", F.concat_ws(" ", "head", "last_word").alias("phrase"), "last_word", "f", F.concat("firsts", F.array("f")).alias("firsts"), F.concat("lasts", F.array("f")).alias("lasts"), "prefix", "suffix"), f"level{m}"))
    return languages, levels


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases by the score of their worst cut."""
    languages, levels = frequent_phrases(docs, least, longest)
    found = None
    for m, level in enumerate(levels[1:], 2):
        if m < len(levels):
            longer = levels[m]
            within = longer.where(f"f >= firsts[{m - 1}]").select(F.col("prefix").alias("slot")).unionByName(longer.where(f"f >= lasts[{m - 1}]").select(F.col("suffix").alias("slot")))
            level = level.join(within.distinct(), "slot", "left_anti")
        cuts = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"firsts[{k - 1}]").alias("l"), F.expr(f"lasts[{m - k - 1}]").alias("r")) for k in range(1, m)])
        level = level.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("cuts"))
        found = level if found is None else found.unionByName(level)
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    wide = "decimal(19,0)"
    score = f"(cast(1000 as decimal(4,0)) * cast(a as {wide}) * cast(n as {wide})) div (cast(c.l as {wide}) * cast(c.r as {wide}))"
    scored = found.join(languages, "lang").withColumn("cut", F.array_min(F.expr(f"transform(cuts, c -> struct({score} as score, c.k as k, c.l as l, c.r as r))")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(f"rank <= {int(best)}")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
