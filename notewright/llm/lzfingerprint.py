"""Lempel-Ziv phrase fingerprints: likeness of documents as a compressor sees it.

A text is parsed from left to right into phrases (LZ78): each is the shortest string that is not in the
dictionary yet, and goes in. Similar texts share many phrases. The dictionary is closed under prefixes, so the
longest known phrase at a place is found by growing or shrinking a first guess. The fingerprint is the SKETCH
smallest hashes of the phrases; the likeness of two fingerprints is the share of common hashes among the
SKETCH smallest of both together, an estimate of the Jaccard similarity of the phrase sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.shared import arrow, parts, with_texts
from notewright.llm.vectext import mix, sums_hash

SAMPLED = 60  #: keys for each block, of which bounds are quantiles
COARSE = 64  #: bounds of blocks that are looked through at once
SKETCH = 64  #: hashes of a fingerprint, 8 hexadecimal digits each


class Parser:
    """An LZ78 parse that can be copied part-way."""

    def __init__(self):
        self.phrases: set[str] = set()
        self.new: list[str] = []  # those since the start or the copy, in order
        self.at = 0

    def copy(self) -> "Parser":
        other = Parser()
        other.phrases, other.at = set(self.phrases), self.at
        return other

    def run(self, text: str, end: int, last: bool) -> None:
        """Parse text from where the parse stands, as long as phrases end at `end` at most; last: take the rest as a phrase too."""
        known, new, at, guess = self.phrases, self.new, self.at, 4
        while at < end:
            n = guess
            if text[at : at + n] in known and at + n <= end:
                n += 1
                while at + n <= end and text[at : at + n] in known:
                    n += 1
            else:
                while n > 1 and text[at : at + n - 1] not in known:
                    n -= 1
            if at + n > end:
                if last:
                    known.add(text[at:end])
                    new.append(text[at:end])
                    at = end
                break
            phrase = text[at : at + n]
            known.add(phrase)
            new.append(phrase)
            at += n
            guess = n
        self.at = at


def fingerprint(phrases) -> np.ndarray:
    """The smallest hashes of phrases (repeats count once), ascending."""
    phrases = list(phrases)
    if not phrases:
        return np.zeros(0, np.uint32)
    signs = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
    hashes = sums_hash(mix(signs.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), ends - np.diff(ends, prepend=0), ends)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    if len(short) > 8 * SKETCH:
        least = np.unique(np.partition(short, 4 * SKETCH)[: 4 * SKETCH])
        if len(least) >= SKETCH:
            return least[:SKETCH]
    return np.unique(short)[:SKETCH]


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of the phrases of both."""
    return np.union1d(a, b)[:SKETCH]


def to_text(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the smallest of both; two empty fingerprints are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:SKETCH]
    return float(np.count_nonzero(np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)) / len(both))


def edit(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many (or all) of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _parsed(text: str) -> tuple[np.ndarray, np.ndarray, Parser]:
    """The fingerprint of a text, and fingerprint and parse up to where its edited form may differ."""
    parser = Parser()
    parser.run(text, len(text) - len(text) // 4, last=False)
    early, begun = fingerprint(parser.new), parser.copy()
    parser.new.clear()
    parser.run(text, len(text), last=True)
    return joined(early, fingerprint(parser.new)), early, begun


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(batches):
    """Rows (doc_id, text, copy) of one block in order: each row that is no copy is finished by the row behind it."""
    held, out = None, []
    for batch in parts(batches):
        for doc_id, text, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copy"))):
            if held is None or held[1] != text:
                own, early, begun = _parsed(text)
            else:  # repeated rows are parsed once; the parse up to the edit is copied before it goes on
                own, early, begun = held[3], held[4], held[5] if held[2] else held[5].copy()
            if held is not None and not held[2]:
                edited = edit(held[1], text)
                held[5].run(edited, len(edited), last=True)
                other = joined(held[4], fingerprint(held[5].new))
                out.append((held[0], len(held[1]), hashlib.sha256(edited.encode()).hexdigest(), to_text(held[3]), to_text(other), likeness(held[3], other), likeness(held[3], own)))
            held = (doc_id, text, copy, own, early, begun)
            if len(out) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(_KINDS)], _NAMES)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(_KINDS)], _NAMES)


def lz_fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each of docs (doc_id, text) with the fingerprints of its text and its edited text; see edit().

    The rows go to blocks of consecutive keys (doc_id, hash of text) whose bounds are quantiles, and the first rows of
    each block also go, as copies, to the end of the block before it; so each block knows every next document, the
    texts are shuffled once, and rows without a doc_id, or with one that many have, are spread by their texts. The next document is the one behind in ascending (doc_id, hash of text); after the last comes
    the first, which may be the same. A null text is empty; rows with equal doc_ids follow each other by their
    texts' hashes; null doc_ids come first; other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    lowest = F.lit(-(2**63))
    key = F.struct(F.coalesce(F.col("doc_id"), lowest).alias("id"), F.xxhash64("text").alias("hash"))
    rows = with_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key)
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.min("key").alias("first"), F.count("*").alias("rows")).first()
    if not found["rows"]:
        return arrow(rows.select("doc_id"), lambda batches: iter(()), _SCHEMA)
    # As range partitioning does: bounds are quantiles of a sample, SAMPLED keys a block. They decide where rows go, not what comes out.
    share = min(1.0, SAMPLED * blocks / found["rows"])
    chosen = rows.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select("key.id", "key.hash")
    sample = sorted(map(tuple, chosen.collect()))
    bounds = sorted({tuple(found["first"]), *(sample[i * len(sample) // blocks] for i in range(blocks) if sample)})  # one for each block at most
    pair = lambda b: F.struct(F.lit(b[0]).cast("long").alias("id"), F.lit(b[1]).cast("long").alias("hash"))
    starts, coarse = F.array(*map(pair, bounds)), F.array(*map(pair, bounds[::COARSE]))
    count = "aggregate({}, 0, (n, b) -> n + if(b <= key, 1, 0))"  # bounds up to the key: first the coarse ones, then between two of them
    at = F.expr(f"(group - 1) * {COARSE} + {count.format(f'slice(starts, (group - 1) * {COARSE} + 1, {COARSE})')} - 1")
    # A row is in its own block; the first ones of a block are at the end of the one before too, those of all at the end of the last.
    before = F.when(F.col("key") == pair(bounds[0]), len(bounds) - 1).when(F.array_contains("starts", F.col("key")), F.col("own") - 1)
    placed = rows.withColumn("starts", starts).withColumn("coarse", coarse).withColumn("group", F.expr(count.format("coarse"))).withColumn("own", at).withColumn("before", before)
    both = F.explode(F.expr("if(before is null, array(struct(own as block, false as copy)), array(struct(own as block, false as copy), struct(before as block, true as copy)))"))
    placed = placed.select("doc_id", "key", "text", both.alias("to")).select("doc_id", "key", "text", "to.block", "to.copy")
    ordered = placed.repartitionById(len(bounds), "block").sortWithinPartitions("copy", "key")
    return arrow(ordered.select("doc_id", "text", "copy"), _compare, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
