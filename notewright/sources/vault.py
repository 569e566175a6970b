"""Note files of a folder tree."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from notewright.functions.text import decoded
from notewright.operators.changes import with_hash
from notewright.sources.files import Tree, is_local, local_path
from notewright.sources.work import new_path

ENTRIES = 20_000  #: of folders that a task looks at before it leaves the rest to others
BATCH_BYTES, TASK_BYTES = 8 << 20, 64 << 20  #: of texts in a batch, and in a task, about
LISTED = "source string, folder boolean, size long, micros long"


def read_vault(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """files (source, content, content_hash, modified_at): all *.md under root; content is null where it is no UTF-8.

    Spark's file source skips names that begin with a dot or underscore. With hidden they are read too: tasks list the
    folders (list_vault) and read the files."""
    if hidden:
        return read_listed(spark, root, list_vault(spark, root, True))
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    source = F.regexp_replace("path", "^file:(?://)?", "")
    return with_hash(binary.select(source.alias("source"), decoded(F.col("content")).alias("content"), F.col("modificationTime").alias("modified_at"))).select("source", "content", "content_hash", "modified_at")


def list_vault(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """(source, size, micros) of the Markdown files under root, in rounds.

    Tasks walk the folders that a round begins with. One that has looked at ENTRIES leaves what it hasn't seen to the next
    round, where all tasks share it, so neither a deep nor a broad tree hangs on one. Paths go to tables in the shared
    folder, never through the driver, and a lost executor costs its part of a round."""
    most = ENTRIES

    def walk(batches):
        tree = Tree(root)
        for batch in batches:
            rows = []
            for row in tree.markdown(batch.column("source").to_pylist(), hidden, most):
                rows.append(row)
                if len(rows) == 5000:
                    yield _listed_batch(rows)
                    rows = []
            if rows:
                yield _listed_batch(rows)

    found = []
    left = spark.createDataFrame([(Tree(root).root,)], "source string")
    while True:
        path, watched = new_path(spark, "listing"), Observation()
        left.mapInArrow(walk, LISTED).observe(watched, F.count(F.when(F.col("folder"), 1)).alias("left")).write.parquet(path)
        found.append(path)
        if not watched.get["left"]:
            break
        left = spark.read.schema(LISTED).parquet(path).where("folder").select("source").repartition(2 * spark.sparkContext.defaultParallelism)
    return spark.read.schema(LISTED).parquet(*found).where("not folder").select("source", "size", "micros")


def _listed_batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = (("source", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("micros", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


def read_listed(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """files like those of read_vault, by a table of their sources (and sizes); a file that is lost meanwhile gives no row.

    Tasks get about TASK_BYTES of texts each and read them in batches of about BATCH_BYTES."""
    if "size" in listed.columns:
        total = listed.agg(F.sum("size")).first()[0] or 0
        listed = listed.repartition(max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))

    def load(batches):
        import datetime

        import pyarrow as pa

        tree = Tree(root)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.timestamp("us", "UTC"))], ["source", "bytes", "modified_at"])

        for batch in batches:
            rows, size = [], 0
            for source, micros in zip(batch.column("source").to_pylist(), batch.column("micros").to_pylist()):
                try:
                    content = tree.read(source)
                except FileNotFoundError:
                    continue
                rows.append((source, content, datetime.datetime.fromtimestamp((micros or 0) / 1e6, datetime.timezone.utc)))
                size += len(content)
                if size > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    raw = listed.select("source", "micros").mapInArrow(load, "source string, bytes binary, modified_at timestamp")
    return with_hash(raw.select("source", decoded(F.col("bytes")).alias("content"), "modified_at")).select("source", "content", "content_hash", "modified_at")


def read_paths(spark: SparkSession, root: str, sources: DataFrame | list[str]) -> DataFrame:
    """files of some sources under root."""
    rows = spark.createDataFrame([(s,) for s in sources], "source string") if isinstance(sources, list) else sources.select("source")
    return read_listed(spark, root, rows.distinct().withColumn("micros", F.unix_micros(F.current_timestamp())))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it comes in fewer: a file of one row group is one task otherwise.

    A table with splits enough, as any large one has, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def without_globs(path: str) -> str:
    """A path that Spark takes for itself, whatever signs are in it."""
    return re.sub(r"([\\[\]{}*?])", r"\\\1", path)


def inside(root: str, path: str) -> str:
    """The file that path (absolute, or relative to root) names, root a local path or a URI; an error if it is outside of root."""
    if is_local(root):
        base = Path(local_path(root)).resolve()
        found = (base / path).resolve()
        if not found.is_relative_to(base):
            raise PermissionError(f"{path} is outside of the vault")
        return str(found)
    base = root.rstrip("/")
    found = path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else f"{base}/{path}"
    if not found.startswith(f"{base}/") or ".." in found.removeprefix(base).split("/"):
        raise PermissionError(f"{path} is outside of the vault")
    return found
