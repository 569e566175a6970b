"""Places and small frames that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.batches import arrow, give_back, parts  # noqa: F401
from notewright.sources.work import new_path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends here and lost executors cost no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the folder of a frame that cut() has made, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column) -> list[bytes]:
    """The texts of an Arrow column as bytes; a null is an empty text."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text under fixed types, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_kept: dict[str, dict] = {}


def kept(operation: str) -> dict:
    """What an operation keeps in a Python worker from task to task. What others kept goes: a worker holds the tables of one."""
    for other in [k for k in _kept if k != operation]:
        del _kept[other]
    return _kept.setdefault(operation, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

