"""Batches of chunks and vectors: Python holds a few rows at a time, however many a batch of Spark has."""

import pyarrow as pa

from notewright.functions import chunking
from notewright.operators import embedding


def test_chunks_come_out_in_small_batches():
    n = 2_300
    batch = pa.RecordBatch.from_pydict({"source": [str(i) for i in range(n)], "section": pa.array([0] * n, pa.int32()), "text": ["some words"] * n})
    out = list(chunking._chunk_batches(512, 16)(iter([batch])))
    assert max(b.num_rows for b in out) <= 500 and [s for b in out for s in b.column("source").to_pylist()] == [str(i) for i in range(n)]


def test_vectors_come_out_in_small_batches_and_the_embedder_gets_full_ones():
    asked = []

    class Counting:
        dimension = 2

        def embed(self, texts):
            asked.append(len(texts))
            return [[float(len(t)), 0.0] for t in texts]

    batch = pa.RecordBatch.from_pydict({"text": ["x" * (i % 7) for i in range(1_210)]})
    out = list(embedding._embed_batches(Counting(), 60)(iter([batch])))
    assert max(b.num_rows for b in out) <= 500 and asked == [60] * 20 + [10]
    assert [v[0] for b in out for v in b.column("vector").to_pylist()] == [float(i % 7) for i in range(1_210)]


def test_spark_gives_bounded_batches(spark):
    from notewright.functions.batches import BATCH_BYTES

    files = spark.createDataFrame([("a", "one two"), ("b", "x")], "source string, content string")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 256 << 20)
    chunks = embedding.embed_chunks(chunking.chunks(files), embedding.HashedWords(4))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == BATCH_BYTES
    assert sorted(r.source for r in chunks.collect()) == ["a", "b"]
