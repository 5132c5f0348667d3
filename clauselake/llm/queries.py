"""The registered queries of the numbered operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import (
    decontaminate, hard_negatives, language_model, licences, line_dedup, mixing, packing, ranked_search, simhash, token_counts, token_files, toxicity, vector_dedup,
)
from clauselake.llm.common import fresh_path, in_fold


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(_table(spark, folder, "documents"), path)
    return token_files.read_token_files(spark, path)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    rows = toxicity.score(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id", in_fold(F.col("doc_id"), 3).alias("held_out"), F.col("toxicity").alias("score"),
        toxicity.predicted().alias("predicted"), F.size("toxic_spans").alias("n_spans"), "toxic_spans",
    )


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Three edits a document, made from its own columns: words are taken out, its source is named inside the text,
    and a stretch gives way to its language. Each place is in the text as the edit before left it."""
    docs = _table(spark, folder, "documents")
    n, source, lang = F.coalesce(F.length("text"), F.lit(0)), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    made = [
        (1, F.floor(n / 3), F.lit(12), F.lit("")),
        (2, F.floor(n / 2), F.lit(0), F.concat(F.lit(" "), source, F.lit(" "))),
        (3, F.floor(3 * n / 4), F.lit(8), F.upper(lang)),
    ]
    log = F.array(*[F.struct(F.lit(i).cast("long").alias("edit_no"), p.cast("long").alias("place"), k.cast("long").alias("length"), r.alias("replacement")) for i, p, k, r in made])
    return token_counts.count_with_log(docs.withColumn("log", log), "log")


def op5_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, folder, "embeddings"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_dedup.dedup_lines(_table(spark, folder, "documents"))
    return rows.select("doc_id", "text", "n_lines", "n_removed")


def op7_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(_table(spark, folder, "documents"), held=False)


def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents")).drop("cluster")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("uid")


def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, moved)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_model": op7_language_model,
    "op8_licences": op8_licences,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
    "op11_mixing": op11_mixing,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op8_licences": licences.oracle(), "op11_mixing": mixing.oracle(), "op12_ranked_search": ranked_search.oracle(),
    "op13_hard_negatives": hard_negatives.oracle(),
}
