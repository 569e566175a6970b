"""Indexing: from files to a new version of the store, which holds what has changed."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from notewright.config import Config
from notewright.functions.chunking import chunks as chunk_files
from notewright.functions.chunking import stored_text
from notewright.functions.text import decoded, is_blank
from notewright.operators.changes import changed_keys, deleted_sources, scannable, with_hash, with_keys, without_sources
from notewright.operators.embedding import Embedder, HashedWords, RemoteEmbedder, embed_chunks
from notewright.operators.search import clamp
from notewright.schema import KEY
from notewright.sources.store import Store
from notewright.sources.files import can_list
from notewright.sources.vault import read_paths, read_vault, without_globs


@dataclass(frozen=True)
class Run:
    """What an indexing run did."""

    chunks: int
    failed: int
    version: str | None


class Indexer:
    """Indexes a vault into a store and searches it."""

    def __init__(self, spark: SparkSession, config: Config = Config(), embedder: Embedder | None = None):
        self.spark, self.config, self.store = spark, config, Store(spark, config.store_path, config.buckets)
        remote = RemoteEmbedder(config.embed_url, config.embed_model, config.dimension) if config.embed_url else None
        self.embedder = embedder or remote or HashedWords(config.dimension)

    def check_embedder(self) -> str | None:
        """What is wrong with the embedding service, if there is one: it can't be reached or lacks the model."""
        if not isinstance(self.embedder, RemoteEmbedder):
            return None
        try:
            return None if self.embedder.has_model() else f"the embedding service has no model {self.config.embed_model}"
        except (OSError, ValueError, KeyError, TypeError) as e:
            return f"the embedding service at {self.config.embed_url} can't be asked: {e}"

    def files(self) -> DataFrame:
        return read_vault(self.spark, self.config.vault_root, self.config.hidden and can_list(self.config.vault_root))

    def index_vault(self) -> int:
        """Index what is new or changed, drop what is gone; the number of new chunks."""
        root = self.config.vault_root
        again = (lambda sources: read_paths(self.spark, root, sources)) if can_list(root) else None
        return self._apply(scannable(self.files(), self.config.exclude), whole=True, again=again).chunks

    def index_file(self, source: str) -> int:
        """Index one file, which alone is read, if it has changed; the number of new chunks. A lost file has none."""
        if not self.store.exists(source):
            return 0
        root = self.config.vault_root
        files = read_paths(self.spark, root, [source]) if self.config.hidden and can_list(root) else read_vault(self.spark, without_globs(source))
        return self._apply(scannable(files, self.config.exclude)).chunks

    def index_batch(self, events: DataFrame) -> int:
        """Index the files (source, content as bytes) of a batch of the watch that have changed."""
        files = with_hash(events.select("source", decoded(F.col("content")).alias("content")))
        return self._apply(scannable(files, self.config.exclude).dropDuplicates(["source"])).chunks

    def index_events(self, events: DataFrame) -> int:
        """Index the files, which alone are read, of a batch of events (source, ...) that have changed."""
        if events.isEmpty():
            return 0
        return self._apply(scannable(read_paths(self.spark, self.config.vault_root, events), self.config.exclude)).chunks

    def index_frame(self, files: DataFrame) -> Run:
        """Index files (source, content) that come from elsewhere."""
        return self._apply(scannable(with_hash(files), self.config.exclude))

    def index_all(self, files: DataFrame) -> Run:
        """Index files (source, content) that come from elsewhere and are all there are: what else the store knows goes."""
        return self._apply(scannable(with_hash(files), self.config.exclude), whole=True)

    def rebuild(self) -> int:
        """Forget everything and index anew: the vectors may then have another length."""
        self.store.clear()
        return self.index_vault()

    def _apply(self, files: DataFrame, whole: bool = False, again=None) -> Run:
        """One run at a time: a second one would start from a state that the first is about to replace.

        whole: the files are all there are, so that what else the store knows is gone. again: reads files by a table of sources."""
        with self.store.lock():
            staging = f"{self.store.path}/staging/{uuid.uuid4().hex}"
            try:
                return self._run(files, whole, staging, again)
            finally:
                self.store.remove(staging)

    def _run(self, files: DataFrame, whole: bool, staging: str, again) -> Run:
        known, gone = self.store.counted(), None
        if self.store.totals()["hashes"] == 0 and not self.store.manifest()["layers"]:
            changed = files.select("source", "content", "content_hash")
        else:
            # Names and hashes of all files are read once; what is changed and what is gone comes from them.
            names, _ = self._stage(files.select("source", "content_hash"), f"{staging}/names")
            keys, _ = self._stage(changed_keys(names, known.select("source", "hash")), f"{staging}/keys")
            if again is not None:  # the changed files alone are read again
                files = again(keys)
            changed = with_keys(files, keys).select("source", "content", "content_hash")
            gone = deleted_sources(names, known).distinct() if whole else None
        # Texts are staged with their hashes: a file that is edited meanwhile would else get the hash of one text and the
        # chunks of another. A blank file keeps its old chunks and its hash.
        written, n = self._stage(changed.where(~is_blank(F.col("content"))).dropDuplicates(["source"]), f"{staging}/files", F.count(F.lit(1)).alias("n"))
        lost = 0
        if gone is not None:
            gone, seen = self._stage(gone, f"{staging}/gone", F.count(F.lit(1)).alias("n"))
            lost = seen["n"]
        if not n["n"] and not lost:
            return Run(0, 0, self.store.current())
        embedded = embed_chunks(chunk_files(written, self.config), self.embedder, self.config.batch_size).withColumn("text", stored_text()).withColumn("indexed_at", F.current_timestamp())
        without = F.size("vector") == 0
        staged, n = self._stage(embedded.drop("content_hash"), f"{staging}/chunks", F.count(F.lit(1)).alias("n"), F.count(F.when(without, 1)).alias("bad"))
        done, bad, new, failed, count = written, None, staged, 0, n["n"]
        if n["bad"]:
            bad, seen = self._stage(staged.where(without).select("source").distinct(), f"{staging}/bad", F.count(F.lit(1)).alias("n"))
            failed, done = seen["n"], without_sources(written, bad)
            new, seen = self._stage(without_sources(staged, bad), f"{staging}/good", F.count(F.lit(1)).alias("n"))
            count = seen["n"]
        sizes = new.groupBy("source").agg(F.count("*").alias("chunks"))
        hashes = done.select("source", F.col("content_hash").alias("hash")).join(sizes, "source", "left").select("source", "hash", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
        removed = done.select("source", F.lit(True).alias("chunks"))
        if gone is not None:
            removed = removed.unionByName(gone.select("source", F.lit(True).alias("chunks")))
        if bad is not None:  # a failed file keeps its chunks and loses its hash, so that the next run takes it again
            old = known.join(bad, "source").select("source", F.lit(None).cast("string").alias("hash"), "chunks")
            hashes, removed = hashes.unionByName(old), removed.unionByName(bad.select("source", F.lit(False).alias("chunks")))
        hashes, removed = self._stage(hashes, f"{staging}/hashes")[0], self._stage(removed, f"{staging}/removed")[0]
        version = self.store.commit(new, hashes, removed, count)
        self.store.prune(self.config.max_backups)
        return Run(count, failed, version)

    def _stage(self, rows: DataFrame, path: str, *counts) -> tuple[DataFrame, dict]:
        """rows, written before what reads them more than once (what comes from files or a service may be another the next
        time), and what was observed while they were written."""
        watched = Observation() if counts else None
        (rows.observe(watched, *counts) if watched else rows).write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), watched.get if watched else {}

    def search_frame(self, query: str, k: int = 5) -> DataFrame:
        """Hits of a query. Keys and vectors alone are compared, in the cells that may hold a hit; the texts of the k nearest are read after that."""
        hits, _, _ = self.store.nearest(self.embedder.embed([query])[0], clamp(k), self.config.metric)
        rows = [(r.source, r.section, r.window, 0, r.distance, i + 1, 1 - r.distance / 2 if self.config.metric == "l2" else 1 - r.distance) for i, r in enumerate(hits)]
        few = self.spark.createDataFrame(rows, "source string, section int, window int, query_id long, distance double, rank int, similarity double")
        return self.store.chunks_at(hits).select(*KEY, "chunk_id", "text").join(F.broadcast(few), KEY)

    def search(self, query: str, top_k: int = 5) -> list[dict]:
        """Hits with source, text (300 characters) and score (the distance: smaller is nearer)."""
        rows = sorted(self.search_frame(query, top_k).collect(), key=lambda r: r.rank)  # 20 at most
        return [{"source": r.source, "text": r.text[:300], "score": r.distance} for r in rows]

    def stats(self) -> dict:
        """total_chunks and unique_files, without reading a chunk."""
        totals = self.store.totals()
        return {"total_chunks": totals["chunks"], "unique_files": totals["files"]}
