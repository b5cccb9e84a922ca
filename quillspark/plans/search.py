"""Retrieval from query text to the few cards that are worth a model's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import card_text
from quillspark.operators import retrieval as R
from quillspark.operators.scorers import embed, overlap_score
from quillspark.plans import cards as C
from quillspark.runtime import Scratch


def indexed(cards: DataFrame) -> DataFrame:
    """(doc_id, text) as cards are searched: claim, category, skills and metrics."""
    return cards.select(F.col("evidence_id").alias("doc_id"), card_text(F.col("claim"), F.col("category"), F.col("skills"), F.col("metrics")).alias("text"))


def lexical(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    return R.bm25_top(indexed(C.cards(spark, d)), C.queries(spark, d), k)


def stored(spark: SparkSession, d: str, each: int = 30, k: int = 20) -> DataFrame:
    """The cascade over scores that are stored already, for all requirements at once: the best ``each`` of both lists, fused to ``k``; rerank_score comes along."""
    s = Scratch(spark).write(C.scored(spark, d), "scored")
    lex = R.top_ranked(s.where("bm25_score > 0").select("query_id", "doc_id", "bm25_score", "rerank_score"), "query_id", [F.desc(F.round("bm25_score", 9)), F.asc("doc_id")], each, "bm25_rank")
    sem = R.top_ranked(s.where("semantic_score is not null").select("query_id", "doc_id", "semantic_score", "rerank_score"), "query_id", [F.desc(F.round("semantic_score", 9)), F.asc("doc_id")], each, "semantic_rank")
    return R.fuse(lex, sem, k, carry=("rerank_score",))


def match_stored(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """stored, then the k best by the cards' rerank scores."""
    return R.rerank(stored(spark, d), lambda df: df, k)


def match(docs: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, each: int = 30, fused: int = 20, k: int = 5, encode=embed, scorer=overlap_score) -> DataFrame:
    """(query_id, doc_id, scores and ranks of every stage): the k best documents of every query, through the whole cascade.

    ``docs``: doc_id string, text; ``queries``: query_id string, text; ``vectors``: a stored index (doc_id, vector), else the texts are encoded here.
    Lexical and vector retrieval give ``each`` a query, reciprocal rank fusion keeps ``fused``, and only those meet their texts and the reranker
    ``scorer(query column, text column)``. Documents and queries are read once and written; what is shuffled is some rows a query.
    """
    scratch = Scratch(docs.sparkSession)
    docs, queries = scratch.write(docs.select("doc_id", "text"), "docs"), scratch.write(queries.select("query_id", "text"), "queries")
    lexical = R.bm25_top(docs, queries, each)
    have = vectors if vectors is not None else docs.select("doc_id", encode(F.col("text")).alias("vector"))
    semantic = R.vector_top(have, queries.where("text is not null").select("query_id", encode(F.col("text")).alias("vector")), each)
    top = scratch.write(R.fuse(lexical, semantic, fused), "fused")
    met = top.join(docs, "doc_id").join(queries.withColumnRenamed("text", "query"), "query_id")
    return R.rerank(met, scorer("query", "text"), k)


def match_all(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """match, of the requirements whose id is divisible by 20 against all cards."""
    return match(indexed(C.cards(spark, d)), C.queries(spark, d), k=k)


def search(cards: DataFrame, text: str, k: int = 5, vectors: DataFrame | None = None) -> DataFrame:
    """The k best cards for one query, through the whole cascade; a blank query has no rows."""
    q = cards.sparkSession.createDataFrame([("q", text)], "query_id string, text string").where(F.trim("text") != "")
    return match(indexed(cards), q, vectors, k=k).drop("query_id", "query")


def results(matched: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards as they are handed out: the card's columns and how it was found as one struct ``retrieval``."""
    found = [c for c in ("bm25_score", "bm25_rank", "semantic_score", "semantic_rank", "fusion_score", "rerank_score") if c in matched.columns]
    return matched.select("query_id", F.col("doc_id").alias("evidence_id"), F.struct(*found).alias("retrieval")).join(cards, "evidence_id").select("query_id", *cards.columns, "retrieval")
