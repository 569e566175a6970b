"""Arrow batches of a bounded size, and what a Python worker gives back when it has read them."""

from __future__ import annotations

from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20  #: of an Arrow batch, about: 10,000 texts may be long
LITTLE = 1 << 20  #: bytes of batches that a task may read and write without looking for garbage: that takes longer than they do


def parts(batches, most: int = 500):
    """Slices of Arrow batches: Python objects are made for a few rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of a bounded size; a Python worker gives its free memory back after each task."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, BATCH_BYTES)

    def task(batches):
        passed = 0

        def counted(some):
            nonlocal passed
            for batch in some:
                passed += batch.nbytes
                yield batch

        yield from counted(run(counted(batches)))
        if passed > LITTLE:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Workers stay for the tasks of later stages, and so would the pages that they no longer use."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
