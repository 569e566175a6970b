"""One query for each operation, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.llm import sql
from notewright.llm.collocations import collocations
from notewright.llm.decontaminate import contained_items
from notewright.llm.heap_lloyd import vector_codes
from notewright.llm.licences import licence_labels
from notewright.llm.lzfingerprint import lz_fingerprints
from notewright.llm.ngram_join import jaccard_components
from notewright.llm.packing import pack_documents
from notewright.llm.personal import BASE, personal_spans
from notewright.llm.recompression import without_repeats
from notewright.llm.shared import new_path, table
from notewright.llm.token_orc import token_digests, write_token_orc
from notewright.llm.toolcalls import calls_of_conversations, link_tool_calls
from notewright.llm.toxicity import toxicity
from notewright.llm.wrappers import main_texts


def op1_tool_call_linking(spark, sf_dir):
    linked = link_tool_calls(*calls_of_conversations(table(spark, sf_dir, "conversations")))
    return linked.select("conv_id", F.col("call_id").alias("call_turn"), "status", "name", "level", "n_missing", "valid", "problems", F.sha2("canonical", 256).alias("canonical_sha256"), F.length("output").cast("long").alias("output_chars"))


def op2_token_orc(spark, sf_dir):
    path = new_path(spark, "token-orc")
    write_token_orc(table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)


def op3_benchmark_decontamination(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), capacity=1024)


def op5_license_scans(spark, sf_dir):
    return licence_labels(table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark, sf_dir):
    return lz_fingerprints(table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    found = personal_spans(table(spark, sf_dir, "documents"))

    def listed(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op8_toxicity(spark, sf_dir):
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"))


def op9_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op10_html_extraction(spark, sf_dir):
    return main_texts(table(spark, sf_dir, "pages"))


def op11_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark, sf_dir):
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {f.__name__: f for f in (op1_tool_call_linking, op2_token_orc, op3_benchmark_decontamination, op4_best_fit_packing, op5_license_scans, op6_document_fingerprints, op7_pii, op8_toxicity, op9_ngram_jaccard_join, op10_html_extraction, op11_phrase_collocations, op12_substring_dedup, op13_vector_codes)}
ORACLE_SQL = sql.ORACLES
