"""Corpus pipeline: toxicity, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.llm.decontaminate import contained_items
from notewright.llm.ngram_join import jaccard_components
from notewright.llm.packing import pack_documents
from notewright.llm.personal import redact_documents
from notewright.llm.shared import cut, table
from notewright.llm.toxicity import drop_toxic


def _free(docs, name):
    """A column name like `name` that docs don't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs):
    """(docs with a key made of doc_id and text, the key's name): stages decide by it, as doc_id may be null, or that of several texts.

    It has 64 bits: among 10^10 different rows a few share a key by chance, and with it their fate."""
    key = _free(docs, "row_key")
    return docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))), key


def _by_key(keyed, key):
    return keyed.select(F.col(key).alias("doc_id"), "text")


def reject_toxic(spark, docs, sf_dir):
    """Documents predicted to be toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark, docs, sf_dir):
    """Of each group of documents that links of their five-word shingles join (Jaccard 0.8 or more), the smallest doc_id stays.

    A null doc_id counts as the largest. Of repeated rows (the same doc_id, null too, and text) one stays."""
    keyed, key = _keyed(docs)
    groups = jaccard_components(_by_key(keyed, key), width=5, num=8, den=10).where("doc_id is not null")
    groups = cut(groups.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("component_id"), F.count("*").alias("rows")), "groups")
    many = groups.groupBy("component_id").agg(F.count("*").alias("size")).where("size > 1").select("component_id")
    members = groups.select("key", "component_id").join(many, "component_id")
    ids = keyed.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id")).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    members = cut(members.join(ids.hint("merge"), "key").select("component_id", order.alias("order")), "members")
    first = members.groupBy("component_id").agg(F.min("order").alias("first"))
    copies = members.join(first, "component_id").where("order.key <> first.key").select("order.key", F.lit(True).alias("copy"))
    repeats = groups.where("rows > 1").select("key", F.lit(False).alias("copy"))
    fate = cut(copies.unionByName(repeats).groupBy("key").agg(F.max("copy").alias("copy")), "fates")
    names = [_free(docs, n) for n in ("fate_key", "fate_copy")]
    judged = keyed.join(fate.toDF(*names).hint("merge"), F.col(key) == F.col(names[0]), "left")
    # Of repeated rows the one of the smallest other columns stays: an aggregation, as all of them may be one key.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least, one = F.min(F.struct(*others)) if others else F.lit(None), _free(docs, "least_row")
    again = judged.where(~F.col(names[1])).groupBy(key, "doc_id").agg(F.first("text").alias("text"), least.alias(one))
    again = again.select(*[F.col(c) if c in ("doc_id", "text") else F.col(one)[c].alias(c) for c in docs.columns])
    return judged.where(F.col(names[1]).isNull()).select(*docs.columns).unionByName(again)


def decontaminate(spark, docs, sf_dir):
    """Documents that contain 0.8 or more of a benchmark item's five-word shingles go."""
    keyed, key = _keyed(docs)
    found = contained_items(_by_key(keyed, key), table(spark, sf_dir, "benchmark"))
    found = cut(found.select(F.col("doc_id").alias(key)), "contaminated").distinct()
    return keyed.join(found.hint("merge"), key, "left_anti").select(*docs.columns)


def redact_personal_data(spark, docs, sf_dir):
    """Personal data becomes the name of its kind; n_chars is counted anew."""
    return redact_documents(docs)


def pack(spark, docs, sf_dir):
    """Token pieces of the remaining documents in sequences of 1024."""
    return pack_documents(docs, capacity=1024)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminate),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack),
]
#: A conditional random field, boosted trees and a tokenizer are beyond SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
