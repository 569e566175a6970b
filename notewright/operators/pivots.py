"""Vectors in cells around pivots, and bounds by which an exact search leaves cells unread.

A cell holds the vectors that a pivot is nearest to. For each cell the smallest and largest distance of its vectors to every
pivot are known. By the triangle inequality no vector of the cell is nearer to a query than the query's distance to a pivot
leaves room for, so a cell whose bound is beyond the k-th best distance found so far can't hold a hit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.functions.batches import arrow, parts
from notewright.operators.search import nearest

PIVOTS = 32  #: of a set of vectors; bounds have as many numbers, twice, for each cell
MARGIN = 1e-6  #: of rounding: bounds are that much wider


@dataclass(frozen=True)
class Cell:
    """What is known of a set of vectors: distances to each pivot and lengths, from low to high."""

    name: str
    rows: int
    low: tuple[float, ...]
    high: tuple[float, ...]
    shortest: float
    longest: float

    def as_list(self) -> list:
        return [self.name, self.rows, list(self.low), list(self.high), self.shortest, self.longest]

    @classmethod
    def of(cls, x: list) -> "Cell":
        return cls(x[0], x[1], tuple(x[2]), tuple(x[3]), x[4], x[5])


def choose_pivots(rows: DataFrame, vector: str = "vector", most: int = PIVOTS) -> list[list[float]]:
    """A few different vectors, by a hash: a stated number, whatever the table's size."""
    found = rows.where(F.size(vector) > 0).select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64("v")).limit(4 * most).collect()
    return [list(v) for v in dict.fromkeys(tuple(r.v) for r in found)][:most]


def _measured(column: pa.Array, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to pivots, and lengths."""
    from notewright.functions.vectors import matrix

    x = matrix(column, pivots.shape[1])
    d = np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1) if len(x) else np.zeros((0, len(pivots)))
    return d, np.sqrt((x * x).sum(1))


def with_cell(rows: DataFrame, pivots: list[list[float]], vector: str = "vector") -> DataFrame:
    """rows with the number of the nearest pivot as `cell`."""
    p = np.array(pivots, float)

    def run(batches):
        for batch in parts(batches):
            d, _ = _measured(batch.column(vector), p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32))], [*batch.schema.names, "cell"])

    return arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def cells_of(rows: DataFrame, pivots: list[list[float]], vector: str = "vector") -> list[Cell]:
    """The cells of rows (cell, vector): a row for each pivot, whatever the table's size."""
    p = np.array(pivots, float)

    def run(batches):
        held: dict[int, list] = {}
        for batch in parts(batches):
            d, length = _measured(batch.column(vector), p)
            cell = batch.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                own = cell == c
                new = [int(own.sum()), d[own].min(0), d[own].max(0), length[own].min(), length[own].max()]
                old = held.get(c)
                held[c] = new if old is None else [old[0] + new[0], np.minimum(old[1], new[1]), np.maximum(old[2], new[2]), min(old[3], new[3]), max(old[4], new[4])]
        for c, (n, low, high, short, long) in held.items():
            yield pa.RecordBatch.from_pylist([{"cell": c, "n": n, "low": low.tolist(), "high": high.tolist(), "short": short, "long": long}], schema)

    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("short", pa.float64()), ("long", pa.float64())])
    each = arrow(rows.select("cell", vector), run, "cell int, n long, low array<double>, high array<double>, short double, long double")
    lows = [F.min(F.get("low", F.lit(i))).alias(f"l{i}") for i in range(len(pivots))]
    highs = [F.max(F.get("high", F.lit(i))).alias(f"h{i}") for i in range(len(pivots))]
    found = each.groupBy("cell").agg(F.sum("n").alias("n"), F.min("short").alias("short"), F.max("long").alias("long"), *lows, *highs).collect()
    return [Cell(str(r.cell), r.n, tuple(r[f"l{i}"] for i in range(len(pivots))), tuple(r[f"h{i}"] for i in range(len(pivots))), r.short, r.long) for r in found]


def least_distance(cell: Cell, pivots: np.ndarray, query: np.ndarray, metric: str) -> float:
    """A distance (in the terms of `metric`) that no vector of the cell is nearer than.

    For cosine the query is brought to a length as the cell's vectors have: among those its nearest are the most alike."""
    length, middle = float(np.sqrt(query @ query)), (cell.shortest + cell.longest) / 2
    if metric == "cosine":
        if cell.shortest <= 0.0 or length == 0.0:  # a vector without a direction
            return -math.inf
        query = query * (middle / length)
    to_pivots = np.sqrt(((pivots - query) ** 2).sum(1))
    gap = max(float(np.maximum(to_pivots - np.array(cell.high), np.array(cell.low) - to_pivots).max(initial=0.0)), 0.0)
    gap = max(gap - MARGIN * (1.0 + gap + float(to_pivots.max(initial=0.0))), 0.0)
    if metric == "l2":
        return gap * gap
    if metric == "dot":
        return 1.0 - (length**2 + cell.longest**2 - gap * gap) / 2 - MARGIN * (1.0 + length**2 + cell.longest**2)
    return 1.0 - max((n + (middle**2 - gap * gap) / n) / (2 * middle) for n in (cell.shortest, cell.longest)) - MARGIN


def search_cells(cells: list[Cell], read: Callable[[list[Cell]], DataFrame], pivots: list[list[float]], query: list[float], k: int, metric: str, key: list[str]) -> tuple[list, int]:
    """(hits of the query, nearest first, number of cells read). read gives the rows of cells; the hits are those of all cells.

    The nearest cells that hold k rows are searched first; of the others only those that may hold something as near."""
    q = np.array(query, float)
    p = np.array(pivots, float)
    order = sorted(((least_distance(c, p, q, metric), i) for i, c in enumerate(cells)), key=lambda x: x)
    first, rows = 0, 0
    while first < len(order) and rows < k:
        rows += cells[order[first][1]].rows
        first += 1

    def best(some) -> list:
        return nearest(read([cells[i] for _, i in some]), [(0, list(query))], k, metric, key).collect() if some else []  # k rows

    hits = best(order[:first])
    limit = hits[k - 1].distance if len(hits) >= k else math.inf
    more = [x for x in order[first:] if x[0] <= limit + MARGIN * (1.0 + abs(limit))]
    hits = sorted([*hits, *best(more)], key=lambda r: (r.distance, *(r[c] for c in key)))[:k]
    return hits, first + len(more)
