"""Folds over events in order of time, by key: debouncing and the circuit breaker.

Rows are dealt by key, sorted by key and time, and folded as a stream: a task holds the state of one key, never
its rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _ordered(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    return events.repartition(key).sortWithinPartitions(key, *order)


def _debounce(key: str, micros: str, gap: int):
    def run(batches):
        now, last = None, None
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(micros).to_pylist()):
                accepted = k != now or last is None or t - last >= gap
                if accepted:
                    now, last = k, t
                keep.append(accepted)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def debounced(events: DataFrame, key: str, micros: str, gap_seconds: float, tie: str) -> DataFrame:
    """Leading edge: an event counts if it is gap_seconds or more after the last one of its key that counted."""
    rows = _ordered(events.where(f"{key} is not null and {micros} is not null"), key, [micros, tie])
    return rows.mapInArrow(_debounce(key, micros, int(gap_seconds * 1_000_000)), rows.schema)


def _breaker(key: str, micros: str, failed: str, most: int, rest: int):
    def run(batches):
        now, failures, until = None, 0, None
        for batch in batches:
            state, count = [], []
            for k, t, bad in zip(batch.column(key).to_pylist(), batch.column(micros).to_pylist(), batch.column(failed).to_pylist()):
                if k != now:
                    now, failures, until = k, 0, None
                if until is not None and t >= until:
                    failures, until = 0, None
                if until is not None:
                    state.append("rejected")
                else:
                    failures = failures + 1 if bad else 0
                    if failures >= most:
                        until = t + rest
                    state.append("opened" if until is not None else "passed")
                count.append(failures)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state, pa.string()), pa.array(count, pa.int64())], [*batch.schema.names, "state", "failures"])

    return run


def breaker_log(events: DataFrame, key: str, micros: str, failed: str, most: int, rest_seconds: float, tie: str) -> DataFrame:
    """events with the breaker's state (passed, opened, rejected) and its failures in a row behind each."""
    rows = _ordered(events.where(f"{key} is not null and {micros} is not null"), key, [micros, tie])
    schema = T.StructType([*rows.schema.fields, T.StructField("state", T.StringType()), T.StructField("failures", T.LongType())])
    return rows.mapInArrow(_breaker(key, micros, failed, most, int(rest_seconds * 1_000_000)), schema)
