"""The registered queries opN_<name> and their SQL, each over whole tables."""

from __future__ import annotations

from media_forecast.llm import (
    bpe, conversations, decontamination, fingerprints, graph_search, html_text, packing, secrets, shingle_join, suffix_dedup, token_counts, toxicity, vector_codes,
)
from media_forecast.llm.common import table


def op1_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_bpe_codec(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark, sf_dir):
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op5_secret_ledger(spark, sf_dir):
    return secrets.digests(table(spark, sf_dir, "documents"))


def op6_graph_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return graph_search.search(rows, rows.where("vec_id % 100 = 0"))


def op7_shingle_join(spark, sf_dir):
    return shingle_join.components_of(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark, sf_dir):
    return decontamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_html_text, op3_bpe_codec, op4_fingerprints, op5_secret_ledger, op6_graph_search, op7_shingle_join, op8_token_counts, op9_best_fit_packing, op10_suffix_dedup,
    op11_conversation_repair, op12_vector_codes, op13_decontamination,
)}
ORACLE: dict[str, str] = {"op12_vector_codes": vector_codes.sql(), "op13_decontamination": decontamination.SQL}
