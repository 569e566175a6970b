"""Token ids of documents in ORC files, in ascending doc_id order.

The rows go to range partitions of doc_id, so file k holds smaller ids than file k + 1 and each file is
sorted: stripe and row-group statistics of doc_id are narrow and prune scans, and a Bloom filter on doc_id
decides the rest. ORC stores integers by run-length encoding (version 2). Stripes are read in parallel.

Columns of the files: part (number of the file), doc_id, before (ids of earlier documents of the file),
n_tokens, ids. Odd cases: a null or empty text has the end id only; null doc_ids come first; rows with equal
doc_ids follow each other in the order of their texts' hashes; an empty table gives files without rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm.shared import arrow, with_texts
from notewright.llm.tokens import encoded, tokenizer_path

SCHEMA = "part int, doc_id long, before long, n_tokens long, ids array<int>"
STRIPE_BYTES, INDEX_ROWS = 16 << 20, 1000


def _ids(path: str):
    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch, ids in encoded(batches, path):
            n = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)])
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), pa.array(before + offsets[:-1]), pa.array(n), lists], ["part", "doc_id", "before", "n_tokens", "ids"])
            before += int(offsets[-1])

    return run


def write_token_orc(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode docs (doc_id, text) and write their ids to ORC files under path."""
    rows = with_texts(docs)
    ordered = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": INDEX_ROWS, "orc.stripe.size": STRIPE_BYTES, "orc.compress": "ZSTD"}
    arrow(ordered, _ids(tokenizer or tokenizer_path()), SCHEMA).write.options(**options).orc(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def _digests(batches):
    for batch in batches:
        lists = batch.column("ids")
        values, at = np.asarray(lists.values.to_numpy(zero_copy_only=False), "<i4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("before"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "doc_id", "before", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    tokens = read_token_orc(spark, path)
    ends = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("ids"))
    firsts, total = [], 0
    for part, ids in sorted(tuple(r) for r in ends.collect()):  # a row for each file
        firsts.append((part, total))
        total += ids
    first = F.broadcast(spark.createDataFrame(firsts, "part int, first long"))
    read = arrow(tokens, _digests, "part int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return read.join(first, "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
