"""A versioned store of chunks, vectors and file hashes on Parquet, in layers that are merged when they are read.

A run writes a layer: the chunks of the files it has indexed, their hashes, and the names of the sources whose older rows are
void. It rewrites nothing, so what is written is what has changed. Then a pointer file moves to the new version, whose
manifest names its layers, the cells of each layer's vectors with bounds, and totals. Readers see one state or the other, a
run that dies leaves nothing behind but an unused folder, and earlier versions are the backups. When layers have
become many, or their rows many beside those of the first, they are compacted into one.

Texts and hashes of a layer are in buckets by a hash of the source, a bucket for BUCKET_ROWS rows or so, sorted by source, with
Bloom filters on it: the chunks of one source are a file of each layer. Vectors are in the cells of pivots, for searches
that leave cells unread. Pointer, manifests and locks are written through Hadoop's file system, wherever the store is.
"""

from __future__ import annotations

import json
import os
import time
import zlib
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators.pivots import Cell, cells_of, choose_pivots, search_cells, with_cell
from notewright.schema import KEY, STORED

TEXTS, VECTORS = "source string, section int, window int, chunk_id string, text string, indexed_at timestamp", "source string, section int, window int, vector array<float>"
COUNTED, REMOVED = "source string, hash string, chunks long", "source string, chunks boolean"
KINDS = {"texts": TEXTS, "vectors": VECTORS, "hashes": COUNTED, "removed": REMOVED}
BUCKET_ROWS = 50_000
LAYERS, SHARE = 12, 0.25  #: layers, and rows of the later ones by those of the first, before they are compacted
LISTED, LEAST_LISTED = 60, 15  #: files with the most chunks that a manifest names; if it names fewer of them than the second, they are listed anew
NOTHING = {"chunks": 0, "files": 0, "hashes": 0, "top": [], "floor": 0}  #: totals of an empty store; no file that `top` lacks has more chunks than `floor`


class Locked(RuntimeError):
    """Another process holds a lock of the store."""


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 1024):
        """buckets: of a layer at most."""
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Files

    def _at(self, *parts: str):
        return self._path("/".join((self.path, *parts)))

    def _text(self, *parts: str) -> str | None:
        if not self._fs.exists(self._at(*parts)):
            return None
        stream = self._fs.open(self._at(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, text: str, *parts: str) -> None:
        stream = self._fs.create(self._at(*parts), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _move(self, old, new) -> None:
        """Rename a file to a name that may be taken: whoever looks finds the old file or the new one."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        where = self._fs.makeQualified(new)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(old), where, options)

    def _names(self, *parts: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(*parts))] if self._fs.exists(self._at(*parts)) else []

    def bytes_of(self, path: str) -> bytes:
        """The content of one file, wherever Hadoop's file systems reach."""
        at = self._path(path) if ":" in path.split("/")[0] else self._path("file", None, path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at) or fs.getFileStatus(at).isDirectory():
            raise FileNotFoundError(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        at = self._path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def remove(self, path: str) -> None:
        """Delete a folder of unfinished work."""
        self._fs.delete(self._path(path), True)

    # Versions

    def versions(self) -> list[str]:
        """Names of complete versions, oldest first."""
        return sorted(n for n in self._names() if n.startswith("v") and self._fs.exists(self._at(n, "MANIFEST")))

    def current(self) -> str | None:
        """The version that the pointer names; the newest complete one if the pointer is lost."""
        name = self._text("CURRENT")
        if name and self._fs.exists(self._at(name, "MANIFEST")):
            return name
        complete = self.versions()
        return complete[-1] if complete else None

    def manifest(self, name: str | None = None) -> dict:
        """layers (at, buckets, cells, rows, removed), pivots and totals of a version, or of the current one."""
        name = name or self.current()
        return json.loads(self._text(name, "MANIFEST")) if name else {"layers": [], "pivots": [], "totals": NOTHING}

    def totals(self) -> dict:
        """chunks, files (that have some), hashes, and the files with the most chunks, from the manifest alone."""
        return self.manifest()["totals"]

    # Reading

    def _layer(self, layer: dict, kind: str, only: list[str] | None = None) -> DataFrame | None:
        """Rows that a layer holds of a kind; only: folders of it."""
        if not layer["rows"]["texts" if kind == "vectors" else kind]:
            return None
        folder = f"{self.path}/{layer['at']}/{kind}"
        read = self.spark.read.schema(KINDS[kind])
        return read.parquet(folder) if only is None else read.option("basePath", folder).parquet(*(f"{folder}/{x}" for x in only))

    def _live(self, layers: list[dict], kind: str, parts: list[DataFrame | None]) -> DataFrame:
        """The rows of all layers that no later layer makes void."""
        numbered = [p.withColumn("layer", F.lit(i)) for i, p in enumerate(parts) if p is not None]
        if not numbered:
            return self.spark.createDataFrame([], KINDS[kind])
        rows = reduce(DataFrame.unionByName, numbered)
        void = [self._layer(layer, "removed").withColumn("till", F.lit(i)) for i, layer in enumerate(layers) if i and layer["rows"].get("removed")]
        if void:
            gone = reduce(DataFrame.unionByName, void).where(F.lit(True) if kind == "hashes" else F.col("chunks")).groupBy(F.col("source").alias("void")).agg(F.max("till").alias("till"))
            rows = rows.join(gone, F.col("source") == F.col("void"), "left").where("till is null or layer >= till")
        return rows.select(*self.spark.createDataFrame([], KINDS[kind]).columns)

    def _all(self, kind: str, manifest: dict | None = None) -> DataFrame:
        layers = (manifest or self.manifest())["layers"]
        return self._live(layers, kind, [self._layer(x, kind) for x in layers])

    def texts(self) -> DataFrame:
        """All chunks without their vectors."""
        return self._all("texts")

    def vectors(self) -> DataFrame:
        """Keys and vectors of all chunks."""
        return self._all("vectors")

    def chunks(self) -> DataFrame:
        """All chunks with their vectors."""
        manifest = self.manifest()
        both = self._all("texts", manifest).join(self._all("vectors", manifest), KEY)
        return both.select(*self.spark.createDataFrame([], STORED).columns)

    def hashes(self) -> DataFrame:
        """(source, hash) of the files that have been indexed; a file that failed has no hash."""
        return self.counted().where("hash is not null").select("source", "hash")

    def counted(self) -> DataFrame:
        """(source, hash, chunks) of every file that is known; hash is null after a failure."""
        return self._all("hashes")

    def chunks_of(self, source: str) -> DataFrame:
        """Chunks of one source without vectors: of each layer one bucket is read, where rows are sorted by source."""
        layers = self.manifest()["layers"]
        parts = [self._layer(x, "texts", [f"bucket={bucket_of(source, x['buckets']['texts'])}"]) if self._holds(x, source) else None for x in layers]
        mine = F.col("source") == F.lit(source)
        return self._live(layers, "texts", [p if p is None else p.where(mine) for p in parts]).where(mine)

    def chunks_at(self, keys: list) -> DataFrame:
        """Chunks of a few keys (source, section, window)."""
        of = {r.source for r in keys}
        layers = self.manifest()["layers"]
        parts = []
        for x in layers:
            only = sorted({f"bucket={bucket_of(s, x['buckets']['texts'])}" for s in of if self._holds(x, s)})
            parts.append(self._layer(x, "texts", only).where(F.col("source").isin(sorted(of))) if only else None)
        few = F.broadcast(self.spark.createDataFrame([(r.source, r.section, r.window) for r in keys], "source string, section int, window int"))
        return self._live(layers, "texts", parts).join(few, KEY)

    def _holds(self, layer: dict, source: str) -> bool:
        """Whether a layer has the bucket that a source falls into."""
        return bool(layer["rows"].get("texts")) and bucket_of(source, layer["buckets"]["texts"]) in layer["filled"]

    def nearest(self, query: list[float], k: int, metric: str) -> tuple[list, int, int]:
        """(the k nearest keys with their distances, cells read, cells there are)."""
        manifest = self.manifest()
        layers, pivots = manifest["layers"], manifest["pivots"]
        cells = [Cell.of([f"{i}/{c[0]}", *c[1:]]) for i, layer in enumerate(layers) for c in layer["cells"]]

        def read(some: list[Cell]) -> DataFrame:
            of: dict[int, list[str]] = {}
            for c in some:
                i, _, cell = c.name.partition("/")
                of.setdefault(int(i), []).append(f"cell={cell}")
            return self._live(layers, "vectors", [self._layer(x, "vectors", of[i]) if i in of else None for i, x in enumerate(layers)])

        if not cells:
            return [], 0, 0
        hits, seen = search_cells(cells, read, pivots, query, k, metric, KEY)
        return hits, seen, len(cells)

    # Writing

    def _buckets_for(self, rows: int) -> int:
        return max(1, min(self._buckets, -(-rows // BUCKET_ROWS)))

    def _write(self, rows: DataFrame, at: str, kind: str, buckets: int, count: int) -> None:
        # Small buckets share a task, the rows of a large one go to several.
        order = [c for c in ("source", "section", "window") if c in rows.columns]
        dealt = rows.withColumn("bucket", _bucket(F.col("source"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
        bloom = {"parquet.bloom.filter.enabled#source": "true", "parquet.bloom.filter.expected.ndv#source": str(-(-count // buckets))}
        dealt.write.options(**bloom).partitionBy("bucket").parquet(f"{self.path}/{at}/{kind}")

    def _write_layer(self, at: str, texts: DataFrame, vectors: DataFrame, hashes: DataFrame, removed: DataFrame | None, pivots: list, rows: dict) -> dict:
        """Writes the rows of a layer, of which there are `rows` by kind, and says what a manifest has of it."""
        buckets = {kind: self._buckets_for(rows[kind]) for kind in ("texts", "hashes")}
        if rows["texts"]:
            self._write(texts.select(*_names(TEXTS)), at, "texts", buckets["texts"], rows["texts"])
            placed = with_cell(vectors.select(*_names(VECTORS)), pivots)
            placed.hint("rebalance", "cell").sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{self.path}/{at}/vectors")
        if rows["hashes"]:
            self._write(hashes.select(*_names(COUNTED)), at, "hashes", buckets["hashes"], rows["hashes"])
        if rows.get("removed"):
            removed.select(*_names(REMOVED)).hint("rebalance").write.parquet(f"{self.path}/{at}/removed")
        layer = {"at": at, "buckets": buckets, "rows": rows, "cells": [], "filled": [int(n.removeprefix("bucket=")) for n in self._names(at, "texts") if n.startswith("bucket=")]}
        if rows["texts"]:
            written = self.spark.read.schema(f"{VECTORS}, cell int").parquet(f"{self.path}/{at}/vectors")
            layer["cells"] = [c.as_list() for c in cells_of(written, pivots)]
        return layer

    def commit(self, chunks: DataFrame, hashes: DataFrame, removed: DataFrame | None = None, rows: int | None = None) -> str:
        """The next version: chunks and hashes (source, hash, chunks) are new, older rows of removed (source, chunks) are void.

        Where `chunks` of removed is false, the hash alone is. All three are read more than once, so they are tables or cheap;
        rows is the number of chunks, counted where it isn't given."""
        before, name = self.manifest(), f"v{time.time_ns():020d}"
        n = {"texts": chunks.count() if rows is None else rows}
        removed = removed if removed is not None and before["layers"] else None
        n["hashes"], totals, n["removed"] = self._new_totals(before, hashes, removed)
        pivots = before["pivots"] or (choose_pivots(chunks) if n["texts"] else [])
        layer = self._write_layer(f"{name}/delta", chunks, chunks, hashes, removed, pivots, n)
        after = {"layers": [*before["layers"], layer], "pivots": pivots, "totals": totals}
        if len(totals["top"]) < min(LEAST_LISTED, totals["files"]):
            totals |= self._listed(self._all("hashes", after))
        if before["layers"] and (len(after["layers"]) > LAYERS or sum(x["rows"]["texts"] + x["rows"]["removed"] for x in after["layers"][1:]) > SHARE * after["layers"][0]["rows"]["texts"]):
            after = self._compacted(after, name)
        self._put(json.dumps(after), name, "MANIFEST")
        self._point(name)
        return name

    def _compacted(self, manifest: dict, name: str) -> dict:
        """A manifest of one layer, with new pivots."""
        texts, vectors, hashes = (self._all(kind, manifest) for kind in ("texts", "vectors", "hashes"))
        totals = manifest["totals"]
        pivots = choose_pivots(vectors) if totals["chunks"] else []
        layer = self._write_layer(f"{name}/base", texts, vectors, hashes, None, pivots, {"texts": totals["chunks"], "hashes": hashes.count(), "removed": 0})
        return {"layers": [layer], "pivots": pivots, "totals": totals}

    def compact(self) -> str | None:
        """A version of one layer with the rows of the current one."""
        manifest, name = self.manifest(), f"v{time.time_ns():020d}"
        if len(manifest["layers"]) < 2:
            return self.current()
        self._put(json.dumps(self._compacted(manifest, name)), name, "MANIFEST")
        self._point(name)
        return name

    def _new_totals(self, before: dict, hashes: DataFrame, removed: DataFrame | None) -> tuple[int, dict, int]:
        """(rows of hashes, totals, rows of removed) after a run, from what it changes alone: sources, not chunks."""
        new, changed = F.lit(1).alias("sign"), []
        changed.append(hashes.select("source", "hash", "chunks", new))
        if removed is not None:
            gone = removed.select("source", "chunks").withColumnRenamed("chunks", "whole")
            old = self._all("hashes", before).join(gone, "source")
            changed.append(old.select("source", "hash", "chunks", F.lit(-1).alias("sign")))
        both = reduce(DataFrame.unionByName, changed)
        found = both.agg(F.coalesce(F.sum(F.expr("sign * chunks")), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.expr("sign * int(chunks > 0)")), F.lit(0)).alias("files"), F.coalesce(F.sum(F.expr("sign * int(hash is not null)")), F.lit(0)).alias("hashes"), F.count(F.when(F.col("sign") > 0, 1)).alias("new")).first()
        old = before["totals"]
        totals = {k: old[k] + found[k] for k in ("chunks", "files", "hashes")}
        first = hashes.where("chunks > 0").orderBy(F.desc("chunks"), "source").limit(LISTED).select("source", "chunks").collect()
        lost = set()
        if removed is not None and old["top"]:
            lost = {r.source for r in removed.where(F.col("source").isin([s for s, _ in old["top"]])).select("source").collect()}
        top = sorted([*((s, c) for s, c in old["top"] if s not in lost), *((r.source, r.chunks) for r in first)], key=lambda x: (-x[1], x[0]))
        floor = max([old["floor"], *([first[-1].chunks] if len(first) == LISTED else []), *([top[LISTED][1]] if len(top) > LISTED else [])])
        totals |= {"top": [x for x in top if x[1] > floor], "floor": floor}
        return found.new, totals, removed.count() if removed is not None else 0

    def _listed(self, hashes: DataFrame) -> dict:
        """top and floor anew, from a row for each file."""
        rows = hashes.where("chunks > 0").orderBy(F.desc("chunks"), "source").limit(LISTED + 1).select("source", "chunks").collect()
        floor = rows[LISTED].chunks if len(rows) > LISTED else 0
        if sum(r.chunks > floor for r in rows) < LEAST_LISTED <= len(rows):  # too many of one number to tell them by it
            return {"top": [], "floor": rows[0].chunks}
        return {"top": [(r.source, r.chunks) for r in rows if r.chunks > floor], "floor": floor}

    def top(self, most: int = 15) -> list[tuple[str, int]]:
        """The files with the most chunks; from the manifest where it names enough, else from the hashes, a row for each file."""
        totals = self.totals()
        if len(totals["top"]) >= min(most, totals["files"]):
            return [tuple(x) for x in totals["top"][:most]]
        rows = self.counted().where("chunks > 0").orderBy(F.desc("chunks"), "source").limit(most).collect()
        return [(r.source, r.chunks) for r in rows]

    def _point(self, name: str) -> None:
        self._put(name, f"CURRENT.{name}")
        self._move(self._at(f"CURRENT.{name}"), self._at("CURRENT"))

    def restore(self, name: str) -> None:
        """Go back to an earlier version."""
        if name not in self.versions():
            raise KeyError(name)
        self._point(name)

    def clear(self) -> str:
        """An empty version."""
        name = f"v{time.time_ns():020d}"
        self._put(json.dumps({"layers": [], "pivots": [], "totals": NOTHING}), name, "MANIFEST")
        self._point(name)
        return name

    def prune(self, backups: int) -> list[str]:
        """Delete versions but the current one and the newest `backups` others; the names deleted.

        Layers of theirs that a kept version still reads stay."""
        now, all_ = self.current(), self.versions()
        old = [v for v in all_ if v != now]
        gone = old[: len(old) - backups] if backups else old
        if not gone:
            return gone
        read = {layer["at"] for v in all_ if v not in gone for layer in self.manifest(v)["layers"]}
        for name in [n for n in self._names() if n.startswith("v") and n not in all_ or n in gone]:
            if name not in gone and name > (now or ""):
                continue  # of a run that is not over
            self._fs.delete(self._at(name, "MANIFEST"), False)
            for layer in self._names(name):
                if f"{name}/{layer}" not in read:
                    self._fs.delete(self._at(name, layer), True)
            if not self._names(name):
                self._fs.delete(self._at(name), True)
        return gone

    # Locks

    @contextmanager
    def lock(self, name: str = "LOCK", wait: float = 600.0):
        """Hold a lock of the store, or raise Locked when another holder keeps it for `wait` seconds.

        A lock in a local store ends with its process. Elsewhere it is a file, which stays if its process dies."""
        end = time.monotonic() + wait
        while (give_back := self._try_lock(name)) is None:
            if time.monotonic() >= end:
                raise Locked(f"{self.path}/{name} is held by {self._text(name) or 'another process'}; remove it if that process is gone")
            time.sleep(min(0.2, max(wait, 0.0)))
        try:
            yield
        finally:
            give_back()

    def _try_lock(self, name: str):
        owner = f"process {os.getpid()}"
        self._fs.mkdirs(self._at())
        uri = self._fs.makeQualified(self._at(name)).toUri()
        if uri.getScheme() == "file":
            import fcntl

            file = open(uri.getPath(), "a+")
            try:
                fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                file.close()
                return None
            file.seek(0)
            file.truncate()
            file.write(owner)
            file.flush()
            return file.close
        try:
            stream = self._fs.create(self._at(name), False)
        except Exception:  # the gateway's error for a file that is there
            if self._fs.exists(self._at(name)):
                return None
            raise
        stream.write(bytearray(owner.encode()))
        stream.close()
        return lambda: self._fs.delete(self._at(name), False)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _bucket(source: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(source.cast("binary")), F.lit(buckets)).cast("int")


def bucket_of(source: str, buckets: int) -> int:
    """The bucket of one source, without a job."""
    return zlib.crc32(source.encode()) % buckets
