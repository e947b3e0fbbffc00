"""The training-data pipeline over documents: each stage calls one operator of mapfold.llm.

A stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but
the last return the columns of docs; clean documents pass every stage unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapfold.llm.bpe import default_tokenizer, tokenizer_digests
from mapfold.llm.decontaminate import without_contaminated
from mapfold.llm.near_dup import near_duplicates
from mapfold.llm.quality import measured
from mapfold.llm.secrets import redact
from mapfold.session import table, written


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of doc_id and text under a name that docs doesn't use."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the agreed rules or lie far from their language go."""
    keyed, key = _keyed(docs)
    verdicts = measured(keyed.select(key, "text", "lang"), [key]).filter("kept").select(key).distinct()
    return keyed.join(verdicts, key, "left_semi").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, once if its row is repeated."""
    keyed, key = _keyed(docs)
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept").select(F.col("uid").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mask; n_chars is counted anew where there is a text."""
    return redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return tokenizer_digests(docs, default_tokenizer())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("encode", encode)]
ORACLE_SQL = None  # near duplicates, edit distances and token ids are beyond SQL at this size; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs)
    return docs
