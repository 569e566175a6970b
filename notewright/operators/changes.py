"""Change detection and replacement by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.text import is_blank


def is_markdown(source: Column) -> Column:
    """Ends with .md, in that case only."""
    return source.endswith(".md")


def is_excluded(source: Column, exclude: tuple[str, ...], components: bool = False) -> Column:
    """Whether an entry is part of the path; with components, whether one of its folders or its name is one."""
    if not exclude:
        return F.lit(False)
    if components:
        return F.arrays_overlap(F.split(source, "/"), F.array(*map(F.lit, exclude)))
    found = F.lit(False)
    for entry in exclude:
        found = found | source.contains(entry)
    return found


def scannable(files: DataFrame, exclude: tuple[str, ...], components: bool = False) -> DataFrame:
    """Markdown files outside of what is excluded, with readable text."""
    return files.where(is_markdown(F.col("source")) & ~is_excluded(F.col("source"), exclude, components) & F.col("content").isNotNull())


def with_hash(files: DataFrame) -> DataFrame:
    """The MD5 of the text as content_hash."""
    return files.withColumn("content_hash", F.md5(F.col("content").cast("binary")))


def changed_keys(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(source, content_hash, change: new or changed) of files that are not in hashes (source, hash) or differ there."""
    known = hashes.select("source", F.col("hash").alias("known_hash"))
    joined = files.select("source", "content_hash").join(known, "source", "left").where(~F.col("content_hash").eqNullSafe(F.col("known_hash")))
    return joined.select("source", "content_hash", F.when(F.col("known_hash").isNull(), "new").otherwise("changed").alias("change")).distinct()


def with_keys(files: DataFrame, keys: DataFrame) -> DataFrame:
    """files that changed_keys names, with their change. A file whose text is another by now has another hash and is left out."""
    keys = keys.select(F.col("source").alias("key_source"), F.col("content_hash").alias("key_hash"), "change")
    return files.join(keys, (F.col("source") == F.col("key_source")) & F.col("content_hash").eqNullSafe(F.col("key_hash"))).drop("key_source", "key_hash")


def changed_files(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """files (source, content_hash, ...) that are new or differ from hashes (source, hash), with change: new or changed.

    Names and hashes alone are compared; whole rows meet the names of those that differ, which are few as a rule."""
    return with_keys(files, changed_keys(files, hashes))


def deleted_sources(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Sources of hashes that are no files any more."""
    return hashes.select("source").join(files.select("source"), "source", "left_anti")


def without_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows whose source is not among sources."""
    return rows.join(sources.select("source").distinct(), "source", "left_anti")


def replace_sources(rows: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """rows without those of sources, and the new ones."""
    return without_sources(rows, sources).unionByName(new, allowMissingColumns=True)


def indexed_hashes(hashes: DataFrame, files: DataFrame, failed: DataFrame) -> DataFrame:
    """hashes after a run: those of files that are not blank and not failed are new, those of lost files are gone.

    A failed file keeps no hash, so that the next run takes it again."""
    touched = files.select("source")
    recorded = files.where(~is_blank(F.col("content"))).select("source", F.col("content_hash").alias("hash"))
    return without_sources(hashes, touched).unionByName(without_sources(recorded, failed))
