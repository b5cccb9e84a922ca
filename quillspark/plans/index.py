"""The stored vector index of the cards, and whether it still fits them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.sinks import write_atomic


def corpus_hash(docs: DataFrame) -> tuple[int, str]:
    """(rows, hash) of (doc_id, text), whatever their order: the sum of the rows' hashes, combined before the shuffle."""
    h = F.xxhash64("doc_id", F.coalesce("text", F.lit("\0"))).cast("decimal(38,0)")
    r = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("h")).first()
    return r.n, r.h


def build(docs: DataFrame, path: str, model: str, encode: Callable[[Column], Column]) -> None:
    """Writes (doc_id, vector) and one row of what it was made from; vectors are of length one, so products are cosines."""
    n, h = corpus_hash(docs)
    write_atomic(docs.select("doc_id", encode(F.col("text")).alias("vector")), f"{path}/vectors", "parquet")
    meta = docs.sparkSession.createDataFrame([(model, h, n)], "model string, corpus_hash string, count bigint")
    write_atomic(meta, f"{path}/meta", "json")


def load(spark: SparkSession, docs: DataFrame, path: str, model: str) -> DataFrame | None:
    """The stored vectors if they were made by this model from exactly these rows, else None."""
    try:
        meta = spark.read.schema("model string, corpus_hash string, count bigint").json(f"{path}/meta").first()
        vectors = spark.read.parquet(f"{path}/vectors")
    except Exception:  # nothing there, or nothing that can be read
        return None
    n, h = corpus_hash(docs)
    return vectors if meta and (meta.model, meta.corpus_hash, meta["count"]) == (model, h, n) and vectors.count() == n else None
