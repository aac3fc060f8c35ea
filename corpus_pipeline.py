"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; `run` writes
it as Parquet in the shared folder and reads it again for the next one, so that a lost executor costs no stage. All but
the last return the columns of `documents`, whatever they are. Empty and null texts go with the first stage (they have
no words); repeated rows leave one in the second; empty tables stay empty in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeperil.llm import exact_dedup, near_dup, packing, pii, quality
from codeperil.llm.common import made, remove, written
from codeperil.llm.queries import SURROGATE_KEY, TEST_KEY, table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the base and the learned rules."""
    rules = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return quality.judge_quality(rows, rules).where("kept").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of equal texts, the one with the largest identifier."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates."""
    return near_dup.drop_near_copies(docs, near_dup.NearDup())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates; n_chars follows the text."""
    out = pii.replace_entities(docs, key=spark.conf.get(SURROGATE_KEY, TEST_KEY)).select(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences."""
    return packing.pack_documents(docs, vocabulary(), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("PII surrogates", personal_data),
    ("best-fit packing", best_fit),
]

#: The learned rules, the sampled bands, the surrogates and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage has written for itself, and its predecessor's result, go once its own result is written."""
    docs, mine = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = made(spark)
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
            after = made(spark)
            remove(spark, [p for p in after[:-1] if p not in before or p in mine])  # the last is this stage's result
            mine = [after[-1]]
    return docs
