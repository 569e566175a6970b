"""Benchmark decontamination: short test items inside long documents, by MinHash containment search and exact containment.

Words are runs of letters and digits (ASCII punctuation, signs and white space separate), lower-cased; an item
is in a document if the document has `num / den` of the item's distinct word shingles or more. Everything runs in
DataFrame functions.

Items are partitioned by size. Of an item of q shingles a document must have c = ceil(q * num / den), so of any
q - c + 1 of them it has one at least. The signature of the item are the q - c + 1 smallest hashes: a bottom-k
MinHash whose k is that of the item's size class, so that no contained item is missed, whatever order or
fragments its shingles stand in. A document's shingles are looked up among the signatures of all items, and every
document and item that meet are verified against the whole shingle sets.

Signatures are broadcast where they and the items' sets take BROADCAST bytes at most. Beyond that, documents and
signatures meet by one shuffle of shingles, and the sets of those that met by another.

Odd cases: null or empty texts and items match nothing; an item of fewer than `width` words is searched as one
shingle of its own length; repeated documents or items give one row for each pair of ids; null ids are left out;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.components import apart
from notewright.llm.shared import cut

BROADCAST = 64 << 20  #: bytes of signatures and shingle sets of all items in a broadcast
ROW = 48  #: bytes of a broadcast row besides its arrays, about
#: A fixed pattern: one or more ASCII characters that are neither digit nor letter (after lower-casing).
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str) -> str:
    """SQL for the words of a text column."""
    pattern = APART.replace("\\", "\\\\")
    return f"array_remove(split(lower(coalesce({text}, '')), '{pattern}'), '')"


def _shingles(words: str, width: int) -> str:
    return f"if(size({words}) >= {width}, transform(sequence(1, size({words}) - {width - 1}), i -> xxhash64(slice({words}, i, {width}))), cast(array() as array<bigint>))"


def _signatures(items: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """A row for each item: item_id, width, hashes (distinct), minima (its signature)."""
    split = items.select(F.col("item_id").cast("long").alias("item_id"), F.expr(f"transform(array({words('cast(text as string)')}), w -> named_struct('w', w, 'k', least(size(w), {width})))[0]").alias("s"))
    split = split.where("item_id is not null and s.k > 0").select("item_id", F.col("s.w").alias("w"), F.col("s.k").alias("width"))
    hashed = split.select("item_id", "width", F.expr("array_sort(array_distinct(transform(sequence(1, size(w) - width + 1), i -> xxhash64(slice(w, i, width)))))").alias("hashes"))
    least = f"cast(size(hashes) - (size(hashes) * {num} + {den - 1}) div {den} + 1 as int)"
    return hashed.withColumn("minima", F.expr(f"slice(hashes, 1, {least})"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each item (item_id, text) contained in a document (doc_id, text)."""
    signatures = cut(_signatures(items, width, num, den), "signatures")
    of_all = signatures.agg(F.sum(F.size("minima") * F.lit(ROW) + F.size("hashes") * F.lit(8) + F.lit(ROW)).alias("bytes"), F.sort_array(F.collect_set("width")).alias("widths")).first()  # `width` widths at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # A transform over an array of one element keeps a value that is used many times.
    shingles = ", ".join(_shingles("w", k) for k in of_all["widths"] or [width])
    hashed = rows.select("doc_id", F.expr(f"transform(array({words('text')}), w -> array_distinct(concat({shingles})))[0]").alias("of_doc"))
    # explode_outer: the filter that the optimizer puts under a plain explode would hash every document twice more.
    looked_up, sets = signatures.select(F.explode("minima").alias("hash"), "item_id"), signatures.select("item_id", "hashes")
    if (of_all["bytes"] or 0) <= BROADCAST:
        met = hashed.select("doc_id", "of_doc", F.explode_outer("of_doc").alias("hash")).join(F.broadcast(looked_up), "hash").join(F.broadcast(sets), "item_id")
    else:
        met = hashed.select("doc_id", F.explode_outer("of_doc").alias("hash")).join(looked_up.hint("merge"), "hash").select("doc_id", "item_id").distinct()
        met = hashed.join(apart(cut(met, "met"), "doc_id").hint("merge"), "doc_id").join(sets.hint("merge"), "item_id")
    pairs = met.select("doc_id", "item_id", F.size(F.array_intersect("of_doc", "hashes")).cast("long").alias("n_shared"), F.size("hashes").cast("long").alias("n_item")).where(F.col("n_shared") * den >= F.col("n_item") * num)
    best = pairs.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return best.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))
