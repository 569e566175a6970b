"""Fixed schemas; what is read is checked against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "source string, content string, content_hash string, modified_at timestamp"
CHUNKS = "source string, section int, window int, chunk_id string, text string"
STORED = "source string, section int, window int, chunk_id string, text string, vector array<float>, indexed_at timestamp"
KEY = ["source", "section", "window"]
HASHES = "source string, hash string"
CHANGES = "source string, kind string, ts timestamp"


def check_dimension(chunks: DataFrame, dimension: int) -> DataFrame:
    """chunks; a row whose vector has another length makes the job fail. There is no fixed-size vector type."""
    right = F.col("vector").isNotNull() & (F.size("vector") == dimension)
    text = F.concat(F.lit(f"a vector of {dimension} values is needed, not of "), F.size("vector").cast("string"))
    return chunks.withColumn("vector", F.when(right, F.col("vector")).otherwise(F.raise_error(text).cast("array<float>")))
