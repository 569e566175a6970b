"""Sections and overlapping word windows of Markdown texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.config import Config
from notewright.functions.batches import arrow, parts
from notewright.functions.text import SPACES, strip, without_front_matter
from notewright.schema import CHUNKS

HEADING = "\n## "


def sections(files: DataFrame) -> DataFrame:
    """(source, section, text): parts between second-level headings; the first may have none, the others keep theirs. Blank ones go."""
    parts = files.select("source", F.posexplode(F.split(without_front_matter(F.col("content")), HEADING, -1)).alias("section", "part"))
    text = F.when(F.col("section") == 0, strip(F.col("part"))).otherwise(F.concat(F.lit("## "), strip(F.col("part"))))
    return parts.select("source", "section", text.alias("text")).where("text <> ''")


def windows(lengths: np.ndarray, size: int, keep: int) -> list[tuple[int, int]]:
    """Word ranges of the windows of a text with words of these lengths.

    With running totals of length + 1, a window that begins at word a ends behind the first word whose total is
    `size` or more above a's, and one new word at least; the next begins `keep` words before that end (or at a, if
    there are fewer). What is left, be it overlap alone, is the last window."""
    total = np.concatenate([[0], np.cumsum(lengths + 1)])
    out, start, end, n = [], 0, 0, len(lengths)
    while True:
        stop = max(end + 1, int(np.searchsorted(total, total[start] + size)))
        if stop > n:
            break
        out.append((start, stop))
        start, end = max(start, stop - keep), stop
    if start < n:
        out.append((start, n))
    return out


def chunk_text(text: str, size: int, keep: int) -> list[str]:
    """Chunks of one section: the text itself up to twice the size, else its windows with single spaces."""
    if len(text) <= 2 * size:
        return [text]
    words = text.split()
    return [" ".join(words[a:b]) for a, b in windows(np.fromiter(map(len, words), np.int64, len(words)), size, keep)]


def _chunk_batches(size: int, keep: int):
    def run(batches):
        for batch in parts(batches):
            sources, numbers = batch.column("source").to_pylist(), batch.column("section").to_pylist()
            rows = [(s, n, w, hashlib.md5(c.encode()).hexdigest(), c) for s, n, t in zip(sources, numbers, batch.column("text").to_pylist()) for w, c in enumerate(chunk_text(t, size, keep))]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["source", "section", "window", "chunk_id", "text"])

    return run


def chunks(files: DataFrame, config: Config = Config()) -> DataFrame:
    """(source, section, window, chunk_id, text) of files (source, content). The key is the first three: chunk_id, the MD5 of the text, repeats where texts do."""
    return arrow(sections(files), _chunk_batches(config.chunk_size, config.overlap_words), CHUNKS)


def chunks_of_text(content: str | None, size: int, keep: int) -> list[tuple[int, int, str, str]]:
    """(section, window, chunk_id, text) of one text, as `chunks` has them."""
    if not content:
        return []
    parts = content.split("---", 2)
    body = parts[2] if content.startswith("---") and len(parts) == 3 else content
    out = []
    for i, part in enumerate(body.split(HEADING)):
        text = part.strip(SPACES) if i == 0 else "## " + part.strip(SPACES)
        if text:
            out += [(i, w, hashlib.md5(c.encode()).hexdigest(), c) for w, c in enumerate(chunk_text(text, size, keep))]
    return out


def register_chunker(spark: SparkSession, config: Config = Config(), name: str = "chunks_of") -> None:
    """A table function for SQL: SELECT source, c.* FROM files, LATERAL chunks_of(content) c."""
    size, keep = config.chunk_size, config.overlap_words

    class Chunks:
        def eval(self, content: str) -> Iterator[tuple]:
            yield from chunks_of_text(content, size, keep)

    # One that takes Arrow arrays can't stand behind LATERAL.
    spark.udtf.register(name, F.udtf(Chunks, returnType="section int, window int, chunk_id string, text string"))


def stored_text(text: str | F.Column = "text", most: int = 1024) -> F.Column:
    """What the store keeps of a chunk's text; its chunk_id is of the whole."""
    return F.substring(text, 1, most)
