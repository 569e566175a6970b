"""Codes of vectors by one codebook for each part of a vector, learned by heap-ordered Lloyd rounds in exact integers.

A block of vectors keeps, for each part position and entry, a heap of the vectors whose part the entry serves. The key is
the slack, lower minus upper bound: the distance to the second nearest entry less that to the nearest one, at the
last scan. When entries move, no slack shrinks by more than the entry's own drift plus the largest drift of the others;
their total over rounds is kept for each entry, and keys are set off against it. So a round pops, from each heap, the parts
whose slack the drift since their scan has used up, and scans these alone; all others keep their entry, and nothing is
computed for them. Rounding of the bounds is covered by a margin: it leads to a needless scan, never to a wrong entry.

Blocks are rows of a table in the shared folder: components, vec_ids, labels, heaps, and what the round has changed in the
sums of entries. Each round reads the last one's table and writes its own; only the changed sums, a row for each part and
entry, are added up over all blocks, so neither vectors nor heaps are shuffled.

Components become floor(1024 x). Vectors of unequal lengths, or of one that 4 doesn't divide, count as followed by zeros.
A null vec_id counts as larger than all others, equal ones are ordered by components. An empty table, or one with unusable
vectors only, gives no rows; other columns are ignored. Sums of errors that no long holds are null.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.shared import arrow, cut, drop

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 16384  #: vectors of a block, whose heaps a task holds at once
_EXACT = 2.0**53  #: floats hold integers below exactly


def _integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * component), a row for each vector, with zeros up to width."""
    flat, n = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(vectors.offsets.to_numpy())
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    if np.abs(scaled).max(initial=0) < 2.0**62:
        out = np.zeros((len(n), width), np.int64)
        scaled = scaled.astype(np.int64)
    else:  # whole numbers of any size
        out = np.zeros((len(n), width), object)
        scaled = np.array([math.floor(x * SCALE) if abs(x) < _EXACT else int(x) * SCALE for x in flat.tolist()], object)
    out[np.arange(width) < n[:, None]] = scaled
    return out


def _pack(x: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold them all; decimal digits beyond 64 bits."""
    if x.dtype == object:
        return b"s" + ",".join(map(str, x.ravel())).encode()
    most = int(np.abs(x).max(initial=0))
    kind = next(k for k in "bhiq" if most < 2 ** (8 * np.dtype(k).itemsize - 1))
    return kind.encode() + x.astype(kind).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    x = np.array(list(map(int, data[1:].split(b","))) if len(data) > 1 else [], object) if data[:1] == b"s" else np.frombuffer(data, data[:1].decode(), offset=1).astype(np.int64)
    return x.reshape(-1, width)


class Book:
    """The entries of one part position, and how far their drift has used up slacks."""

    def __init__(self, entries: np.ndarray, used: np.ndarray | None = None):
        self.entries, self.used = entries, np.zeros(len(entries)) if used is None else used

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, ties to the lower index, and the slack: distance to the second nearest less that to it."""
        of, slack = np.empty(len(rows), np.int64), np.empty(len(rows))
        for i in range(0, len(rows), 1024):
            d = self._squares(rows[i : i + 1024])
            at, first = np.arange(len(d)), np.argmin(d, 1)
            least = d[at, first].astype(float)
            d[at, first] = d.max() + 1
            second = d.min(1).astype(float) if d.shape[1] > 1 else np.full(len(d), np.inf)
            of[i : i + 1024], slack[i : i + 1024] = first, np.sqrt(second) - np.sqrt(least)
        return of, slack

    def _squares(self, rows: np.ndarray) -> np.ndarray:
        most = max(int(np.abs(rows).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        if 4 * rows.shape[1] * most * most < _EXACT:  # so that no float below is rounded
            a, b = rows.astype(float), self.entries.astype(float)
            return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        a, b = rows.astype(object), self.entries.astype(object)
        return np.stack([((a - e) ** 2).sum(1) for e in b], 1)

    def errors(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        most = max(int(np.abs(rows).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.int64 if 4 * rows.shape[1] * most * most < 2**62 else object
        return ((rows.astype(kind) - self.entries.astype(kind)[of]) ** 2).sum(1)

    def moved(self, sums: list[list[int]], counts: list[int]) -> "Book":
        """The book after a round: entries at the floor of their parts' means, drifts added to what is used up."""
        after = [[s // n for s in row] if n else [int(x) for x in e] for row, n, e in zip(sums, counts, self.entries)]
        drift = np.array([math.sqrt(sum((int(x) - y) ** 2 for x, y in zip(e, new))) for e, new in zip(self.entries, after)])
        order = np.argsort(drift)
        others = np.full(len(drift), drift[order[-1]])
        others[order[-1]] = drift[order[-2]] if len(drift) > 1 else 0.0
        big = any(abs(x) >= 2**62 for row in after for x in row)
        return Book(np.array(after, object if big else np.int64), self.used + drift + others)

    def violated(self, key: float, entry: int) -> bool:
        """Whether drift may have used up a slack, with a margin for rounding."""
        used = self.used[entry]
        return key <= used + 1e-9 * (1.0 + abs(key) + used)


class Heaps:
    """Of a part position in a block: for each entry a heap of (slack against drift, vector)."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    def rescan(self, rows: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pop the vectors that are violated, scan them and push them anew: (vectors, entry before, entry now) of those."""
        out, before = [], []
        for entry, heap in enumerate(self.heaps):
            while heap and book.violated(heap[0][0], entry):
                out.append(heapq.heappop(heap)[1])
                before.append(entry)
        out = np.array(out, np.int64)
        now, slack = book.nearest(rows[out])
        for row, entry, key in zip(out.tolist(), now.tolist(), (slack + book.used[now]).tolist()):
            heapq.heappush(self.heaps[entry], (key, row))
        return out, np.array(before, np.int64), now

    @classmethod
    def first(cls, rows: np.ndarray, book: Book) -> tuple["Heaps", np.ndarray]:
        of, slack = book.nearest(rows)
        heaps: list[list[tuple[float, int]]] = [[] for _ in book.entries]
        for row, entry, key in zip(range(len(rows)), of.tolist(), (slack + book.used[of]).tolist()):
            heaps[entry].append((key, row))
        for heap in heaps:
            heapq.heapify(heap)
        return cls(heaps), of

    def entry_of(self, n: int) -> np.ndarray:
        of = np.empty(n, np.int64)
        for entry, heap in enumerate(self.heaps):
            of[[row for _, row in heap]] = entry
        return of

    def packed(self) -> bytes:
        """The heaps one behind the other, each in its own order: sizes, vectors, keys."""
        flat = [x for heap in self.heaps for x in heap]
        sizes = np.array([len(h) for h in self.heaps], "<i4")
        return sizes.tobytes() + np.array([r for _, r in flat], "<i4").tobytes() + np.array([k for k, _ in flat], "<f8").tobytes()

    @classmethod
    def unpacked(cls, data: bytes, entries: int) -> "Heaps":
        sizes = np.frombuffer(data, "<i4", entries)
        n, at = int(sizes.sum()), 4 * entries
        flat = list(zip(np.frombuffer(data, "<f8", n, at + 4 * n).tolist(), np.frombuffer(data, "<i4", n, at).tolist()))
        ends = np.cumsum(sizes).tolist()
        return cls([flat[e - s : e] for s, e in zip(sizes.tolist(), ends)])


def _changes(rows: np.ndarray, which: np.ndarray, before: np.ndarray | None, now: np.ndarray, position: int, entries: int) -> list[tuple]:
    """(position, entry, count, sums) that a round adds to entries, those that change alone."""
    count, sums = np.zeros(entries, np.int64), np.zeros((entries, rows.shape[1]), rows.dtype)
    moved = rows[which]
    np.add.at(count, now, 1)
    np.add.at(sums, now, moved)
    if before is not None:
        np.subtract.at(count, before, 1)
        np.subtract.at(sums, before, moved)
    return [(position, e, int(count[e]), [str(x) for x in sums[e]]) for e in np.flatnonzero((count != 0) | (sums != 0).any(1)).tolist()]


_CHANGE = "array<struct<position:int,entry:int,count:long,sums:array<string>>>"
_CHANGE_ARROW = pa.list_(pa.struct([("position", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.string()))]))


def _block(ids, labels, rows: np.ndarray, heaps: list[Heaps], changes: list[tuple]) -> pa.RecordBatch:
    changed = [{"position": p, "entry": e, "count": c, "sums": s} for p, e, c, s in changes]
    of = [pa.array([0, len(x)], pa.int32()) for x in (ids, labels)]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(of[0], ids), pa.ListArray.from_arrays(of[1], labels), pa.array([_pack(rows)], pa.binary()), pa.array([[h.packed() for h in heaps]], pa.list_(pa.binary())), pa.array([changed], _CHANGE_ARROW)], ["vec_ids", "labels", "components", "heaps", "changes"])


def _parts_of(rows: np.ndarray) -> list[np.ndarray]:
    w = rows.shape[1] // PARTS
    return [rows[:, p * w : (p + 1) * w] for p in range(PARTS)]


def _first_round(width: int, broadcast, size: int):
    def run(batches):
        held, n = [], 0

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            books = broadcast.value
            rows = _integers(table.column("vector").combine_chunks(), width)
            heaps, changes = [], []
            for p, part in enumerate(_parts_of(rows)):
                made, of = Heaps.first(part, books[p])
                heaps.append(made)
                changes += _changes(part, np.arange(len(part)), None, of, p, len(books[p].entries))
            return _block(table.column("vec_id").combine_chunks(), table.column("label").combine_chunks(), rows, heaps, changes)

        for batch in batches:
            while batch.num_rows:
                now = batch.slice(0, size - n)
                batch, n = batch.slice(now.num_rows), n + now.num_rows
                held.append(now)
                if n == size:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return run


def _loaded(batch: pa.RecordBatch, i: int, width: int, entries: int):
    ids, labels = (batch.column(c).slice(i, 1).flatten() for c in ("vec_ids", "labels"))
    rows = _unpack(batch.column("components")[i].as_py(), width)
    return ids, labels, rows, [Heaps.unpacked(h, entries) for h in batch.column("heaps")[i].as_py()]


def _next_round(width: int, broadcast):
    def run(batches):
        books = broadcast.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, rows, heaps = _loaded(batch, i, width, len(books[0].entries))
                changes = []
                for p, part in enumerate(_parts_of(rows)):
                    which, before, now = heaps[p].rescan(part, books[p])
                    changes += _changes(part, which, before, now, p, len(books[p].entries))
                yield _block(ids, labels, rows, heaps, changes)

    return run


def _codes(width: int, broadcast):
    """The last assignment: code and error of each vector."""

    def run(batches):
        books = broadcast.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, rows, heaps = _loaded(batch, i, width, len(books[0].entries))
                code, error = np.empty((len(rows), PARTS), np.uint8), 0
                for p, part in enumerate(_parts_of(rows)):
                    heaps[p].rescan(part, books[p])
                    code[:, p] = of = heaps[p].entry_of(len(rows))
                    error = error + books[p].errors(part, of).astype(object)
                digits = code.tobytes().hex()
                codes = [digits[2 * PARTS * k : 2 * PARTS * (k + 1)] for k in range(len(rows))]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array([int(e) if e < 2**63 else None for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each row of vectors (vec_id, embedding, label) with a usable vector.

    ENTRIES * PARTS is what the driver holds: codebooks, and a row of changed sums for each entry and round."""
    spark = vectors.sparkSession
    whole = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label", "embedding").where(whole).drop("embedding")
    label = rows.schema["label"].dataType
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label)])).selectExpr("*", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    width = -(-longest // PARTS) * PARTS
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow().column("vector").combine_chunks()
    books = [Book(part) for part in _parts_of(_integers(start, width))]
    w, n = width // PARTS, len(start)
    sums, counts = np.zeros((PARTS, n, w), object), np.zeros((PARTS, n), object)

    blocks = None
    schema = T.StructType([T.StructField("vec_ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), *T._parse_datatype_string(f"components binary, heaps array<binary>, changes {_CHANGE}").fields])
    for _ in range(ROUNDS):
        given = spark.sparkContext.broadcast(books)  # entries, a bounded number
        last = blocks
        blocks = cut(arrow(rows, _first_round(width, given, BLOCK), schema) if last is None else arrow(last, _next_round(width, given), schema), "blocks")
        if last is not None:
            drop(last)
        changed = blocks.select(F.explode("changes").alias("c")).select("c.*").groupBy("position", "entry")
        for r in changed.agg(F.sum("count").alias("count"), *[F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(w)]).collect():
            counts[r.position, r.entry] += r["count"]
            sums[r.position, r.entry] += np.array([int(r[f"s{j}"]) for j in range(w)], object)
        books = [b.moved(sums[p].tolist(), counts[p].tolist()) for p, b in enumerate(books)]

    digest = hashlib.sha256(",".join(str(x) for b in books for e in b.entries for x in e).encode()).hexdigest()
    out = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = cut(arrow(blocks.drop("changes"), _codes(width, spark.sparkContext.broadcast(books)), out), "codes")
    drop(blocks)
    totals = cut(coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_sum(error)").alias("label_error")), "label-errors")
    both = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
