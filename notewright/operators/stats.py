"""Statistics of the chunk table and of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(chunks: DataFrame) -> DataFrame:
    """One row: total_chunks, unique_files (nulls are none)."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("source").alias("unique_files"))


def top_files(chunks: DataFrame, most: int = 15) -> DataFrame:
    """(source, chunks) of the files with the most chunks; ties by source."""
    counts = chunks.where("source is not null").groupBy("source").agg(F.count("*").alias("chunks"))
    return counts.orderBy(F.desc("chunks"), "source").limit(most)


def statistics(chunks: DataFrame, store_path: str, model: str, url: str, most: int = 15) -> DataFrame:
    """One row: totals, where the store is, the model, and top_files as an array of (file, chunks)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("chunks")).alias("less"), F.col("source").alias("file"), "chunks"))), lambda x: F.struct(x["file"].alias("file"), x["chunks"].alias("chunks")))
    top = top_files(chunks, most).agg(listed.alias("top_files"))  # `most` rows
    return totals(chunks).crossJoin(top).withColumns({"db_path": F.lit(store_path), "embed_model": F.lit(model), "embed_url": F.lit(url)})  # one row with one row


def index_statistics(hashes: DataFrame, files: DataFrame) -> DataFrame:
    """One row: indexed_files, total_md_files (excluded ones too)."""
    indexed = hashes.select(F.lit(1).alias("indexed"), F.lit(0).alias("found"))
    found = files.where(F.col("source").endswith(".md")).select(F.lit(0).alias("indexed"), F.lit(1).alias("found"))
    return indexed.unionAll(found).agg(F.coalesce(F.sum("indexed"), F.lit(0)).alias("indexed_files"), F.coalesce(F.sum("found"), F.lit(0)).alias("total_md_files"))


def kept_backups(backups: DataFrame, most: int) -> DataFrame:
    """backups (kind, name) with keep: whether a name is among the newest `most` of its kind. There are few backups."""
    newest = Window.partitionBy("kind").orderBy(F.desc("name"))
    return backups.withColumn("keep", F.row_number().over(newest) <= most)
