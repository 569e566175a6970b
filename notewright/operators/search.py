"""Exact nearest-neighbour search. Each task keeps the best k of its rows; only those are sorted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.functions.vectors import distances, matrix

MOST, DEFAULT = 20, 5


def clamp(k: int) -> int:
    """Between 1 and MOST hits."""
    return min(max(int(k), 1), MOST)


def _best(vector: str, key: list[str], queries: np.ndarray, ids: list[int], metric: str, k: int):
    """The best k rows of each query in a task; ties go to the smaller key, so that the result is one whatever the tasks."""

    def run(batches):
        held = None  # (distances by query, rows): a bounded table
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(matrix(batch.column(vector), queries.shape[1]), queries, metric)
            rows = pa.Table.from_batches([batch.select([n for n in batch.schema.names if n != vector])])
            best = []
            for q in range(len(queries)):
                near = np.flatnonzero(d[:, q] <= np.partition(d[:, q], min(k, len(d)) - 1)[min(k, len(d)) - 1])
                best.append(rows.take(pa.array(near)).append_column("query_id", pa.array(np.full(len(near), ids[q]), pa.int64())).append_column("distance", pa.array(d[near, q])))
            found = pa.concat_tables([*best, held] if held is not None else best)
            order = found.sort_by([("query_id", "ascending"), ("distance", "ascending"), *((c, "ascending") for c in key)])
            of = order.column("query_id").to_numpy()
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            held = order.filter(pa.array(rank < k)).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return run


def nearest(chunks: DataFrame, queries: list[tuple[int, list[float]]], k: int, metric: str, key: list[str], vector: str = "vector") -> DataFrame:
    """The k nearest rows of chunks to each query (query_id, vector), with rank, distance and similarity.

    The queries, a stated few, go with the tasks. Equal distances are ordered by `key`. Rows without a vector are no hits."""
    if not queries or k < 1:
        raise ValueError("at least one query and one hit are needed")
    return _ranked(chunks, [i for i, _ in queries], np.array([v for _, v in queries], float), k, metric, key, vector)


def _ranked(chunks: DataFrame, ids: list[int], q: np.ndarray, k: int, metric: str, key: list[str], vector: str) -> DataFrame:
    rows = chunks.where(F.col(vector).isNotNull())
    schema = T.StructType([*rows.drop(vector).schema.fields, T.StructField("query_id", T.LongType()), T.StructField("distance", T.DoubleType())])
    local = rows.mapInArrow(_best(vector, key, q, ids, metric, k), schema)
    near = 1 - F.col("distance") / 2 if metric == "l2" else 1 - F.col("distance")  # for l2 that of unit vectors
    if len(ids) == 1:
        top = local.orderBy("distance", *key).limit(k)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("distance", *key)))  # k rows
    else:
        ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", *key))).where(F.col("rank") <= k)
    return ranked.withColumn("similarity", near)


QUERIES_AT_ONCE = 256  #: of a table of queries that go with the tasks of one scan


def nearest_to_table(chunks: DataFrame, queries: DataFrame, k: int, metric: str, key: list[str], vector: str = "vector") -> DataFrame:
    """The k nearest rows of chunks to each query of a table (query_id, vector); query_id is a number of its own for each.

    The queries are taken in blocks of QUERIES_AT_ONCE or so, each of which meets all rows in one scan: what is held and
    sent at once is bounded, however many they are. Queries without a vector have no hits."""
    given = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = -(-given.count() // QUERIES_AT_ONCE)
    found = None
    for b in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()  # a block
        if rows:
            ids, q = [r.query_id for r in rows], np.array([r.v for r in rows], float)
            hits = _ranked(chunks, ids, q, k, metric, key, vector)
            found = hits if found is None else found.unionByName(hits)
    return _ranked(chunks.limit(0), [0], np.zeros((1, 1)), k, metric, key, vector) if found is None else found


def relevant(hits: DataFrame, least: float = 0.5) -> DataFrame:
    """Hits that are similar enough."""
    return hits.where(F.col("similarity") >= least)


def snippets(hits: DataFrame, most: int = 300) -> DataFrame:
    return hits.withColumn("text", F.substring("text", 1, most))


def chunks_of(chunks: DataFrame, source: str, most: int = 50) -> DataFrame:
    """The first chunks of one source, in order; the comparison is on a column, so nothing in `source` can be code."""
    return chunks.where(F.col("source") == F.lit(source)).orderBy("section", "window").limit(most)


def whole_files(hits: DataFrame, files: DataFrame) -> DataFrame:
    """hits with the content of their files."""
    return hits.join(files.select("source", "content"), "source", "left")
