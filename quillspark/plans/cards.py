"""The tables as the pipeline's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.runtime import table


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Evidence without repeated rows."""
    return table(spark, d, "evidence").where("evidence_id is not null").drop("extracted_at", "loaded_at").distinct()


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Parsed documents, one row each."""
    return table(spark, d, "parsed_documents").where("document_id is not null").drop("loaded_at").distinct()


def queries(spark: SparkSession, d: str) -> DataFrame:
    """The search query of every requirement whose id, read as a number, is divisible by 20."""
    r = table(spark, d, "requirements").select(F.col("requirement_id").alias("query_id"), F.coalesce("search_query", "text").alias("text")).distinct()
    return r.where("cast(conv(substring(query_id, 5), 16, 10) as bigint) % 20 = 0 and text is not null")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, doc_id, bm25_score, semantic_score, rerank_score): the best score of each kind of every scored card; NaN is no score."""
    c = table(spark, d, "candidates").where("requirement_id is not null and evidence_id is not null")
    return c.groupBy(F.col("requirement_id").alias("query_id"), F.col("evidence_id").alias("doc_id")).agg(*[F.max(F.when(~F.isnan(s), F.col(s))).alias(s) for s in ("bm25_score", "semantic_score", "rerank_score")])


def matches(spark: SparkSession, d: str) -> DataFrame:
    """(requirement_id, match_strength, evidence_ids) by rerank score: the five best cards, strong from 4, partial from 0."""
    top = scored(spark, d).where("rerank_score is not null").groupBy("query_id", "doc_id").agg(F.max("rerank_score").alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "doc_id")
    best = top.withColumn("pos", F.row_number().over(w)).where("pos <= 5")
    return best.groupBy(F.col("query_id").alias("requirement_id")).agg(
        F.when(F.max("s") >= 4, "strong").when(F.max("s") >= 0, "partial").otherwise("none").alias("match_strength"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("evidence_ids"),
    )
