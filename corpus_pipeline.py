"""A training-data pipeline over ``documents``: five stages, each one of the operators in ``media_forecast.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one
before kept; all but the last return the columns of documents. ``run`` writes
each stage as Parquet in the shared checkpoint folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from media_forecast.llm import packing, secrets, shingle_join, suffix_dedup, toxicity
from media_forecast.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest doc_id stays."""
    return shingle_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that an earlier place has are cut from the text; the rows stay."""
    return suffix_dedup.without_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the rows stay."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids as pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # scoring, suffix order and tokens have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
