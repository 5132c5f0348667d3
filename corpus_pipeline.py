"""The corpus pipeline: stages that take ``documents`` one after another, each by one operator of ``clauselake.llm``.

Toxic documents go; repeated lines go from the texts (the documents stay); of each group of near-duplicates one document
stays; documents that hold a benchmark item go; what is left is packed into training sequences. Every stage but the last
returns the columns it was given, is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import decontaminate, line_dedup, packing, simhash, toxicity
from clauselake.llm.common import quoted, staged


def remove_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.filter(toxicity.predicted(scored.columns[-2]) == 0).select(*quoted(docs.columns))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the lines that repeat earlier ones; ``n_chars`` follows the text."""
    cleaned = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(cleaned.columns[-1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return cleaned.select(*quoted(docs.columns))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents and their places in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("simhash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("packing", pack),
]
#: tokenising and the trained models are beyond SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; every stage is written and read again before the next."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name.replace(' ', '-')}")
    return docs
