"""Embedding of chunks: a pluggable embedder, batches of texts, retries, splitting, and a circuit breaker.

The breaker is state of a task; executors do not share it, so each stops asking a dead service by itself.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.functions.batches import arrow, parts


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text. TimeoutError makes the batch smaller; any other error is tried again."""


class HashedWords:
    """Deterministic and offline: each word adds 1 or -1 at a place taken from its MD5; the sum has length 1."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.places = dimension, {}

    def _place(self, word: str) -> tuple[int, int]:
        found = self.places.get(word)
        if found is None:
            digest = hashlib.md5(word.encode()).hexdigest()
            found = int(digest[:7], 16) % self.dimension, 1 if int(digest[7], 16) < 8 else -1
            if len(self.places) < 200_000:
                self.places[word] = found
        return found

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for word in text.split(" "):
                place, sign = self._place(word)
                v[place] += sign
            norm = np.sqrt(v @ v)
            out.append((v / norm if norm else v).tolist())
        return out


class RemoteEmbedder:
    """A service with POST /api/embed {model, input} that answers {embeddings}."""

    def __init__(self, url: str, model: str, dimension: int, timeout: float = 120.0):
        self.url, self.model, self.dimension, self.timeout = url.rstrip("/"), model, dimension, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)["embeddings"]
        except OSError as e:
            if isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError):
                raise TimeoutError from e
            raise

    def has_model(self) -> bool:
        """Whether the service lists the model, by its name or as its latest version."""
        with urllib.request.urlopen(f"{self.url}/api/tags", timeout=5) as answer:
            names = {m["name"] for m in json.load(answer).get("models", [])}
        return self.model in names or f"{self.model}:latest" in names


class Breaker:
    """Opens after `most` failures in a row, for `rest` seconds; a success or the end of the rest starts anew."""

    def __init__(self, most: int = 5, rest: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.rest, self.clock, self.failures, self.until = most, rest, clock, 0, None

    def is_open(self) -> bool:
        if self.until is not None and self.clock() >= self.until:
            self.until, self.failures = None, 0
        return self.until is not None

    def record(self, good: bool) -> None:
        self.failures = 0 if good else self.failures + 1
        if self.failures >= self.most:
            self.until = self.clock() + self.rest


def embed_all(texts: list[str], embedder: Embedder, batch_size: int, breaker: Breaker, tries: int = 3, sleep=time.sleep) -> list[list[float]]:
    """A vector for each text, in order; an empty one where it failed. A batch that times out is embedded in halves."""
    out: list[list[float]] = [[] for _ in texts]
    todo = [(i, min(i + batch_size, len(texts))) for i in range(0, len(texts), batch_size)][::-1]
    while todo and not breaker.is_open():
        start, end = todo.pop()
        for attempt in range(tries):
            try:
                out[start:end] = embedder.embed(texts[start:end])
                breaker.record(True)
                break
            except TimeoutError:
                if end - start > 1:
                    middle = (start + end) // 2
                    todo += [(middle, end), (start, middle)]
                    break
                breaker.record(False)
            except Exception:  # whatever a service does: it counts as a failure
                breaker.record(False)
                if attempt + 1 < tries:
                    sleep(3 * (attempt + 1))
            if breaker.is_open():
                break
    return out


def _embed_batches(embedder: Embedder, batch_size: int):
    def run(batches):
        breaker = Breaker()
        for batch in parts(batches, max(1, 500 // batch_size) * batch_size):  # whole batches of the embedder
            vectors = embed_all([t or "" for t in batch.column("text").to_pylist()], embedder, batch_size, breaker)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], [*batch.schema.names, "vector"])

    return run


def embed_chunks(chunks: DataFrame, embedder: Embedder, batch_size: int = 50) -> DataFrame:
    """chunks with the vector of each text; a failed one is empty."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
    return arrow(chunks, _embed_batches(embedder, batch_size), schema)


def batches_of(chunks: DataFrame, batch_size: int = 50) -> DataFrame:
    """The batch of each chunk within its source, in order of section and window."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("source").orderBy("section", "window")) - 1
    return chunks.withColumn("batch", F.floor(number / batch_size).cast("int"))
