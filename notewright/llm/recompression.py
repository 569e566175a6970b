"""Repeated passages of a corpus, by recompression of its word sequences.

Words are the first symbols. A round names every run of one symbol, then every pair of a left and a right symbol; a bit
of a symbol's name says which it is. Names are hashes of what they stand for, so all tasks of a round give equal
runs and pairs equal names without a table of names. What a symbol is depends on the words around it, a stretch that is
kept with it: wherever that stretch stands, it has that symbol inside. So equal windows of words share all symbols whose
stretch they hold. One of these, of the highest round and then of the smallest hash of its stretch, stands for the window.

Spark gathers (name, document): a window whose symbol no other document has repeats nowhere and is left there. A whole text
is one symbol too, of all its words: texts that an earlier document has whole are done. The windows of the shared
symbols, as a rule those of real repeats, are then verified by 128-bit hashes of all their words (the only place that
isn't exact: two different windows are taken for one with a chance below 1e-12 among 1e13 windows).

Odd rows: without a doc_id a row has no place in the order, loses no words and takes none from others; rows of one doc_id
are one document to the others, each judged by itself; a null or empty text has no words; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.shared import arrow, cut, drop, parts, text_bytes, with_texts
from notewright.llm.vectext import mix, segment_sums, slices, space_words, sums_hash

WIDTH = 13  #: words of a window
ROUNDS = 2  #: of naming; stretches of later rounds seldom fit into a window
_RUN, _PAIR, _SIDE = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Symbols:
    """Symbols of some texts in a row: name, text, and the words [low, high) that make each what it is.

    Both bounds ascend. low is a word before the text, high a word behind it, where the symbol depends on the text's end."""

    def __init__(self, name, owner, low, high):
        self.name, self.owner, self.low, self.high = name, owner, low, high

    def low_before(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """low of the symbol in front of each, or the word in front of its text."""
        there = at > 0
        there[there] = self.owner[at[there] - 1] == self.owner[at[there]]
        return np.where(there, self.low[at - 1], bounds[self.owner[at]] - 1)

    def high_behind(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """high of the symbol behind each, or that of the word behind its text."""
        there, behind = at + 1 < len(self.name), np.minimum(at + 1, len(self.name) - 1)
        there &= self.owner[behind] == self.owner[at]
        return np.where(there, self.high[behind], bounds[self.owner[at] + 1] + 1)


def _runs(s: Symbols, bounds: np.ndarray) -> Symbols:
    """Each longest run of one symbol as a symbol; a single one keeps its name."""
    new = np.concatenate([[True], (s.name[1:] != s.name[:-1]) | (s.owner[1:] != s.owner[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    length = (last - first + 1).astype(np.uint64)
    name = np.where(length == 1, s.name[first], mix(s.name[first] * _RUN + length))
    return Symbols(name, s.owner[first], s.low_before(first, bounds), s.high_behind(last, bounds))


def _pairs(s: Symbols, bounds: np.ndarray, number: int) -> Symbols:
    """Each left symbol and the right one behind it as a symbol."""
    at = np.arange(len(s.name))
    left = mix(s.name + _SIDE) >> np.uint64(number) & np.uint64(1) == 0
    joined = np.zeros(len(at), bool)
    joined[:-1] = left[:-1] & ~left[1:] & (s.owner[1:] == s.owner[:-1])
    low = np.where(left, s.low, s.low_before(at, bounds))
    high = np.where(left, s.high_behind(at, bounds), s.high)
    name = s.name.copy()
    pair = np.flatnonzero(joined)
    name[pair] = mix(s.name[pair] * _PAIR + mix(s.name[pair + 1] + _PAIR))
    kept = ~np.concatenate([[False], joined[:-1]])
    return Symbols(name[kept], s.owner[kept], low[kept], high[kept])


class Windows:
    """All windows of some texts: first word, text, and the symbol that stands for each."""

    def __init__(self, texts: list[bytes], width: int):
        owner, self.word = space_words(texts, lower=False)
        self.width, self.bounds = width, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
        self.start = np.flatnonzero(owner[: max(len(owner) - width + 1, 0)] == owner[width - 1 :]) if len(owner) >= width else np.zeros(0, np.int64)
        self.owner = owner[self.start]
        self.symbol = self._symbols(owner)

    def _symbols(self, owner: np.ndarray) -> np.ndarray:
        at = np.arange(len(owner))
        rounds = [Symbols(self.word, owner, at, at + 1)]
        for i in range(ROUNDS if len(self.start) else 0):
            rounds.append(_pairs(_runs(rounds[-1], self.bounds), self.bounds, i))
        least = np.full(len(self.start), np.uint64(2**64 - 1))
        todo = np.arange(len(self.start))
        for s in reversed(rounds):
            name = sums_hash(self.word, np.maximum(s.low, 0), np.minimum(s.high, len(owner)))  # of the stretch: it says more than the symbol
            first = np.searchsorted(s.low, self.start[todo], "left")
            n = np.searchsorted(s.high, self.start[todo] + self.width, "right") - first
            own = np.full(len(todo), np.uint64(2**64 - 1))
            for k in range(max(n.max(initial=0), 0)):
                more = np.flatnonzero(n > k)
                own[more] = np.minimum(own[more], name[first[more] + k])
            least[todo] = own
            todo = todo[n <= 0]
        return least

    def keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of all words of windows."""
        a, b = np.zeros(len(which), np.uint64), np.full(len(which), np.uint64(self.width))
        for k in range(self.width):
            word = self.word[self.start[which] + k]
            a, b = mix(a * _RUN + word), mix((b ^ word) * _PAIR + np.uint64(k))
        return a, b

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of all words of each text."""
        at = np.arange(len(self.word)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        salt = mix(at.astype(np.uint64) * _PAIR + _RUN)
        n = np.diff(self.bounds).astype(np.uint64)
        return mix(segment_sums(mix(self.word + salt), self.bounds) + n), mix(segment_sums(mix(self.word ^ salt), self.bounds) * _RUN + n)


def _symbols_of(width: int):
    """(name, check, doc_id, text_hash): each symbol that stands for a window of a text, with check 0, and the whole text's, with another."""

    def run(batches):
        for batch in parts(batches, 2000):
            texts, ids = text_bytes(batch.column("text")), batch.column("doc_id").to_numpy()
            for i, j in slices(texts):
                w = Windows(texts[i:j], width)
                order = np.lexsort((w.symbol, w.owner))
                name, owner = w.symbol[order], w.owner[order]
                new = np.concatenate([[True], (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])])[: len(name)]
                a, b = w.whole()
                full = np.flatnonzero(np.diff(w.bounds) >= width)
                names, checks = np.concatenate([name[new], a[full]]), np.concatenate([np.zeros(new.sum(), np.uint64), b[full] | np.uint64(1)])
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(checks.view(np.int64)), pa.array(ids[i:j][np.concatenate([owner[new], full])]), pa.concat_arrays([pa.nulls(int(new.sum()), pa.int64()), batch.column("text_hash")[i:j].take(pa.array(full))])], ["name", "check", "doc_id", "text_hash"])

    return run


def _windows_of(width: int):
    """(a, b, doc_id, text_hash, start) of the windows for which one of a row's names stands."""

    def run(batches):
        for batch in parts(batches, 500):
            texts, ids, hashes = text_bytes(batch.column("text")), batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            for i, j in slices(texts):
                w = Windows(texts[i:j], width)
                edge = np.searchsorted(w.owner, np.arange(j - i + 1))
                shared = [np.asarray(batch.column("names")[i + k].values).view(np.uint64) for k in range(j - i)]
                which = np.concatenate([np.flatnonzero(np.isin(w.symbol[edge[k] : edge[k + 1]], shared[k])) + edge[k] for k in range(j - i)])
                a, b = w.keys(which)
                of = w.owner[which]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids[i:j][of]), pa.array(hashes[i:j][of]), pa.array((w.start[which] - w.bounds[of]).astype(np.int32))], ["a", "b", "doc_id", "text_hash", "start"])

    return run


def _without(width: int):
    """Texts without the words of their repeated windows."""

    def run(batches):
        for batch in parts(batches, 500):
            counts, removed, kept = [], [], []
            for text, own, found in zip(text_bytes(batch.column("text")), batch.column("text_hash").to_pylist(), batch.column("found")):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                for row in found if found.is_valid else ():
                    if row["text_hash"].as_py() == own:
                        at = np.unique(np.asarray(row["starts"].values)) if row["starts"].is_valid else np.arange(max(len(words) - width + 1, 0))
                        edge[at] += 1
                        edge[at + width] -= 1
                stays = np.cumsum(edge[:-1]) == 0
                counts.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(words if not removed[-1] else [words[i] for i in np.flatnonzero(stays)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return run


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of each row: text without the words of windows that a document of a smaller doc_id has too."""
    texts = with_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    symbols = cut(arrow(texts.where("doc_id is not null"), _symbols_of(width), "name long, check long, doc_id long, text_hash long"), "symbols")
    both = symbols.groupBy("name", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("name", "check", "least")
    both = cut(both, "shared")
    shared = symbols.join(both, ["name", "check"])
    names, copies = F.when(F.col("check") == 0, F.col("name")), F.when(F.expr("check <> 0 and doc_id > least"), F.col("text_hash"))
    found = cut(shared.groupBy("doc_id").agg(F.collect_set(names).alias("names"), F.collect_set(copies).alias("copies")), "documents")
    drop(symbols)
    drop(both)

    looked = texts.join(found, "doc_id").where("size(names) > 0 and not array_contains(copies, text_hash)")
    windows = cut(arrow(looked.select("doc_id", "text", "text_hash", "names"), _windows_of(width), "a long, b long, doc_id long, text_hash long, start int"), "windows")
    first = windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most")).where("first < most").select("a", "b", "first")
    first = cut(first, "first")
    again = windows.join(first, ["a", "b"]).where("doc_id > first")
    starts = again.groupBy("doc_id", "text_hash").agg(F.collect_set("start").alias("starts"))
    whole = found.select("doc_id", F.explode("copies").alias("text_hash"), F.lit(None).cast("array<int>").alias("starts"))
    found = cut(starts.unionByName(whole).groupBy("doc_id").agg(F.collect_list(F.struct("text_hash", "starts")).alias("found")), "found")
    drop(windows)
    drop(first)
    return arrow(texts.join(found, "doc_id", "left"), _without(width), "doc_id long, n_words long, n_removed long, text string")
