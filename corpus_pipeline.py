"""A training-corpus pipeline: each stage's result is written and read again as the next one's input.

Toxic documents go; of near duplicates one stays; documents that hold a benchmark item go; secrets
are masked; what is left is encoded to token ids and decoded again. The stages keep null and
empty texts (as documents without n-grams, shingles, passages, secrets and tokens) and extra
columns; of repeated rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import bpe, decontaminate, minhash, secret_scan, toxicity
from papyra.llm.queries import TOXIC_FOLD, splitting_pattern, table, vocabulary
from papyra.session import materialize

RANKS = "byte_bpe_multi_50k.tiktoken"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic by a classifier learnt from the labelled ones."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), TOXIC_FOLD)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and the number of characters brought up to date."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and the text decoded from them."""
    coded = bpe.round_trip(docs, vocabulary(RANKS), splitting_pattern(), carry=["doc_id", "source", "lang"])
    return coded.select("doc_id", "source", "lang", F.size("ids").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("byte_bpe", as_tokens),
]
#: Sampling by hashes, a fitted classifier, edit distances and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
