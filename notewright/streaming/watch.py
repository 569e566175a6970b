"""Watching a vault: change events, debounced per path with state, indexed batch by batch."""

from __future__ import annotations

import json
import tempfile
import time
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from notewright.config import Config
from notewright.operators.changes import is_excluded, is_markdown
from notewright.sources.files import Tree

BINARY = "path string, modificationTime timestamp, length long, content binary"
EVENTS = "source string, kind string, micros long"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LeadingEdge(StatefulProcessor):
    """Lets an event through if it is `gap` microseconds or more after the last one of its path that was let through.

    The state of a path is one number. Events of a batch are taken in order of time, batch after batch. With `keep`, after so many
    milliseconds without an event that counts the state of a path goes: with events as they happen, an event after the gap
    counts whether or not there is a state."""

    def __init__(self, gap: int, keep: int | None):
        self.gap, self.keep = gap, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "micros long", *([] if self.keep is None else [self.keep]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["micros", "kind"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for t in events["micros"]:
            accepted = last is None or t - last >= self.gap
            last = t if accepted else last
            keep.append(accepted)
        if any(keep):
            self.last.update((int(last),))
        yield events[keep][["source", "kind", "micros"]]

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame, gap_seconds: float, late_seconds: float | None = None) -> DataFrame:
    """A stream (source, kind, micros) without the events that follow one of their path too soon.

    With late_seconds states go the gap and so long after they were set; events that come in later than that behind their
    time may be let through once too often. Such a stream runs on for its clock's sake and never ends by itself: one that takes
    what is there and ends (availableNow) keeps its states."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    processor = LeadingEdge(int(gap_seconds * 1_000_000), None if late_seconds is None else int((gap_seconds + late_seconds) * 1000))
    return events.groupBy("source").transformWithStateInPandas(processor, EVENTS, "Append", "None" if late_seconds is None else "ProcessingTime")


def watch_files(spark: SparkSession, root: str, config: Config = Config()) -> DataFrame:
    """A stream of files (source, content as bytes, micros) that come up under root: new Markdown files outside of what is excluded.

    The file source sees each path once and a changed file never again: watch_events has the changes too."""
    files = spark.readStream.schema(BINARY).format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    source = F.regexp_replace("path", "^file:(?://)?", "")
    rows = files.select(source.alias("source"), "content", F.unix_micros("modificationTime").alias("micros"))
    return rows.where(is_markdown(F.col("source")) & ~is_excluded(F.col("source"), config.exclude))


PARTITIONS = 16  #: of a listing; one of them is in memory at a time


class Part(InputPartition):
    def __init__(self, number: int, start: str, end: str):
        self.number, self.start, self.end = number, start, end


class Changes(DataSourceStreamReader):
    """Events of the files of a vault, by comparing listings that are stored: an offset is the name of one.

    At each trigger the vault is listed; where anything differs from the last listing, a new one is stored, in PARTITIONS
    files by a hash of the source, and tasks read the differences between two listings file by file. Spark keeps the offset,
    so after a restart only what has changed since is told of, and a batch that is run again is the same batch.

    A change that comes less than `gap` microseconds after the last event of its source is held until then (the listing keeps
    the old state), so that debouncing loses no last edit. The first listing of all tells of every file as created."""

    def __init__(self, options: dict):
        self.root, self.hidden, self.gap, self.exclude = options["path"], options["hidden"] == "true", int(options["gap"]), json.loads(options["exclude"])
        self.state = options["state"].rstrip("/")
        self.last: str | None = None

    def _folder(self) -> Tree:
        return Tree(self.state)

    def _load(self, name: str, number: int) -> dict[str, list]:
        """source: [time, size, when told] of a part of a listing."""
        if not name:
            return {}
        folder = self._folder()
        lines = folder.read(f"{folder.root}/{name}/{number:03d}").decode().split("\n")
        return {x[0]: x[1:] for x in map(json.loads, filter(None, lines))}

    def _names(self) -> list[str]:
        """Complete listings, oldest first."""
        folder = self._folder()
        return sorted(name for path, is_folder, _, _ in folder.listed(folder.root) if is_folder and (name := path.rsplit("/", 1)[-1]).startswith("l") and any(p.endswith("/DONE") for p, *_ in folder.listed(path)))

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        if self.last is None:
            self.last = (self._names() or [""])[-1]
        now, folder, tree = time.time_ns() // 1000, self._folder(), Tree(self.root)
        with tempfile.TemporaryDirectory() as own:  # of this process: parts of the new listing as they are found
            parts = [open(f"{own}/{i}", "w", encoding="utf-8") for i in range(PARTITIONS)]
            for source, _, size, micros in tree.markdown([tree.root], self.hidden):
                if not any(x in source for x in self.exclude):
                    parts[zlib.crc32(source.encode()) % PARTITIONS].write(json.dumps([source, micros, size]) + "\n")
            name, changed = f"l{now:020d}", False
            for i, part in enumerate(parts):
                part.close()
                old, out = self._load(self.last, i), []
                gone = len(old)
                with open(part.name, encoding="utf-8") as lines:
                    for source, *at in map(json.loads, lines):
                        was = old.get(source)
                        gone -= was is not None
                        if was is None or was[:2] != at and now - was[2] >= self.gap:
                            was, changed = [*at, now], True
                        out.append(json.dumps([source, *was]))
                changed = changed or gone > 0
                folder.write(f"{folder.root}/{name}/{i:03d}", "\n".join(out).encode())
        if not changed:
            folder.drop(f"{folder.root}/{name}")
            return {"listing": self.last}
        folder.write(f"{folder.root}/{name}/DONE", b"")
        self.last = name
        return {"listing": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Part(i, start["listing"], end["listing"]) for i in range(PARTITIONS)]

    def read(self, partition: Part) -> Iterator[tuple]:
        """(source, kind, micros) of what has been told of since the first listing."""
        before = self._load(partition.start, partition.number)
        for source, (_, _, told) in self._load(partition.end, partition.number).items():
            was = before.get(source)
            if was is None or was[2] != told:
                yield source, "created" if was is None else "modified", told

    def commit(self, end: dict) -> None:
        """Listings before the one that has been indexed go."""
        folder = self._folder()
        for name in self._names():
            if name < end["listing"]:
                folder.drop(f"{folder.root}/{name}")


class VaultChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault_changes"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> Changes:
        return Changes(dict(self.options))


def watch_events(spark: SparkSession, root: str, state: str, config: Config = Config()) -> DataFrame:
    """A stream of events (source, kind, micros): Markdown files under root that are created or modified. state: the folder of its listings."""
    spark.dataSource.register(VaultChanges)
    options = {"hidden": str(config.hidden).lower(), "gap": str(config.debounce_seconds * 1_000_000), "exclude": json.dumps(config.exclude), "state": state}
    return spark.readStream.format("vault_changes").options(**options).load(root)


def ticks(spark: SparkSession) -> DataFrame:
    """A stream with a row a second, for what is to be done at each trigger."""
    return spark.readStream.format("rate").load()


def index_stream(events: DataFrame, index_batch, checkpoint: str, available_now: bool = True, seconds: int = 5) -> StreamingQuery:
    """Calls index_batch(batch of events) for each micro-batch; offsets replace the events that a busy indexer would drop."""
    writer = events.writeStream.foreachBatch(lambda batch, _: index_batch(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()
