"""Lexical, vector and fused retrieval for whole batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.runtime import Scratch

K1, B = 1.5, 0.75
RRF = 60
#: Queries are broadcast in parts of at most so many terms, or so many numbers of their vectors; each part is one pass over the documents.
BROADCAST_TERMS = 400_000
BROADCAST_NUMBERS = 4_000_000
#: Documents that are scored together, and scores that are held at a time.
TOGETHER, SCORES = 16_384, 4_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of (doc_id, text)."""
    return docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))


def doc_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n documents (those without tokens included), their tokens, and the mean length."""
    sizes = docs.select(F.size(tokens(F.col("text"))).cast("long").alias("dl"))
    return sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def top_ranked(scored: DataFrame, group: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts every partition to k a group before the shuffle, so no group is too large."""
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("int")).where(F.col(name) <= k)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches in tables of TOGETHER rows or a little more."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _places(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each id among all when they are sorted."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def _best(scores: np.ndarray, places: np.ndarray, k: int, positive: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest scores, to nine places, of every row; equal ones go to the smaller place."""
    r = np.round(scores, 9)
    keep = r >= np.partition(r, r.shape[1] - k, axis=1)[:, r.shape[1] - k, None] if r.shape[1] > k else np.ones(r.shape, bool)
    if positive:
        keep &= scores > 0
    i, j = np.nonzero(keep)
    order = np.lexsort((places[j], -r[i, j], i))
    i, j = i[order], j[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k]


def bm25_top(docs: DataFrame, queries: DataFrame, k: int = 30, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, bm25_score, bm25_rank): the k best documents of each query.

    ``docs``: doc_id, text; ``queries``: query_id string, text. The documents are cut into tokens once. The queries' terms and weights
    are broadcast, in parts of BROADCAST_TERMS; every task scores its documents against them as sparse products and keeps k a query
    of every TOGETHER documents, so a term that stands in all documents and all queries costs arithmetic, never rows. Equal
    scores (to nine places) go to the smaller doc_id. Documents without a query term, null texts and empty queries have no
    rows; document and query ids must be unique.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cut = scratch.write(docs.select(F.col("doc_id").cast("string").alias("doc_id"), tokens(F.col("text")).alias("toks")), "tokens")
    stats = cut.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("toks").cast("long")), F.lit(0)).alias("tokens")).first()
    mean = max(stats.tokens / max(stats.n, 1), 1e-9)
    asked = scratch.write(queries.select(F.col("query_id").cast("string").alias("query_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).where("query_id is not null"), "asked")
    parts = max(1, -(-asked.count() // BROADCAST_TERMS))
    out = None
    for part in range(parts):
        own = asked.where(F.expr(f"pmod(xxhash64(query_id), {parts}) = {part}")).toArrow()  # BROADCAST_TERMS or so
        ids, terms = own["query_id"].combine_chunks().dictionary_encode(), own["term"].combine_chunks().dictionary_encode()
        if not len(own):
            ids, terms = pa.array([], pa.string()).dictionary_encode(), pa.array([], pa.string()).dictionary_encode()
        order = np.argsort(terms.indices.to_numpy(zero_copy_only=False), kind="stable")
        per_term = np.bincount(terms.indices.to_numpy(zero_copy_only=False), minlength=len(terms.dictionary))
        shared = spark.sparkContext.broadcast((ids.dictionary, terms.dictionary, ids.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64), per_term.astype(np.int64)))

        def entries(t: pa.Table, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(tokens of each document, and of every known term in a document: the document, the term, how often)."""
            toks = t["toks"].combine_chunks()
            toks = toks.chunk(0) if isinstance(toks, pa.ChunkedArray) else toks
            sizes = pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.index_in(toks.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pair, tf = np.unique((row * max(1, len(known)) + term)[term >= 0], return_counts=True)
            return sizes, pair // max(1, len(known)), pair % max(1, len(known)), tf

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value[1]), np.int64)
            for t in _gathered(batches):
                total += np.bincount(entries(t, shared.value[1])[2], minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

        seen = cut.select("toks").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # asked terms
        df = np.zeros(len(terms.dictionary))
        df[seen["term"].to_numpy()] = seen["df"].to_numpy()
        idf = spark.sparkContext.broadcast(np.log(1.0 + (stats.n - df + 0.5) / (df + 0.5)))

        def score(batches: Iterator[pa.RecordBatch], shared=shared, idf=idf) -> Iterator[pa.RecordBatch]:
            names, known, of_term, per_term = shared.value
            first = np.cumsum(per_term) - per_term
            for t in _gathered(batches):
                doc = t["doc_id"].combine_chunks()
                sizes, row, term, tf = entries(t, known)
                weight = idf.value[term] * tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * sizes[row] / mean))
                places = _places(t["doc_id"])
                for lo in range(0, len(names), width := max(1, SCORES // t.num_rows)):
                    hi = min(len(names), lo + width)
                    mine = (of_term >= lo) & (of_term < hi)
                    n_here = np.add.reduceat(np.r_[mine, False], first) * (per_term > 0) if len(per_term) else per_term
                    q_here, start = of_term[mine] - lo, np.cumsum(n_here) - n_here
                    scores = np.zeros((hi - lo) * t.num_rows)
                    times = n_here[term]
                    ends = np.cumsum(times)
                    for a, z in _stretches(ends, SCORES):
                        reps = times[a:z]
                        at = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(start[term[a:z]], reps)
                        scores += np.bincount(q_here[at] * t.num_rows + np.repeat(row[a:z], reps), np.repeat(weight[a:z], reps), len(scores))
                    scores = scores.reshape(hi - lo, t.num_rows)
                    i, j = _best(scores, places, k, True)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i + lo)), doc.take(pa.array(j)).cast(pa.string()), pa.array(scores[i, j])], ["query_id", "doc_id", "bm25_score"])

        found = cut.mapInArrow(score, "query_id string, doc_id string, bm25_score double")
        out = found if out is None else out.unionByName(found)
    return top_ranked(out, "query_id", [F.desc(F.round("bm25_score", 9)), F.asc("doc_id")], k, "bm25_rank")


def _stretches(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of positions that together have about ``most`` of what ``ends`` sums up, one position at least."""
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, z
        a = z


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, semantic_score, semantic_rank): the k largest dot products of each query, exactly.

    ``vectors``: doc_id, vector array<float>; ``queries``: query_id, vector. Queries are broadcast, in parts of BROADCAST_NUMBERS
    numbers, each one pass over the vectors; every task multiplies TOGETHER vectors by blocks of queries and keeps k a query, so
    what is shuffled is k rows a query and TOGETHER vectors. Ties (to nine places) go to the smaller doc_id. Null vectors and ids have
    no rows; all others need one length.
    """
    spark = vectors.sparkSession
    id_type, query_type = vectors.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    rows = vectors.where("vector is not null and doc_id is not null").select("doc_id", "vector")
    some = queries.where("vector is not null and query_id is not null").select("query_id", "vector")
    size = some.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("d")).first()
    parts = max(1, -(-size.n * size.d // BROADCAST_NUMBERS))
    out = None
    for part in range(parts):
        own = some.where(F.expr(f"pmod(xxhash64(query_id), {parts}) = {part}")).toArrow()
        flat = own["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64) if len(own) else np.zeros(0)
        shared = spark.sparkContext.broadcast((own["query_id"].combine_chunks(), flat.reshape(len(own), -1) if len(own) else np.zeros((0, 1))))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
            for t in _gathered(batches):
                if not len(q):
                    continue
                doc = t["doc_id"].combine_chunks()
                doc = pa.concat_arrays(doc.chunks) if isinstance(doc, pa.ChunkedArray) else doc
                m = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float64).T
                places = _places(t["doc_id"])
                for lo in range(0, len(q), width := max(1, SCORES // t.num_rows)):
                    s = q[lo : lo + width] @ m
                    i, j = _best(s, places, k, False)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i + lo)), doc.take(pa.array(j)), pa.array(s[i, j])], ["query_id", "doc_id", "semantic_score"])

        found = rows.mapInArrow(score, f"query_id {query_type}, doc_id {id_type}, semantic_score double")
        out = found if out is None else out.unionByName(found)
    return top_ranked(out, "query_id", [F.desc(F.round("semantic_score", 9)), F.asc("doc_id")], k, "semantic_rank")


def fuse(lexical: DataFrame, semantic: DataFrame, k: int = 15, weights: tuple[float, float] = (1.0, 1.0), carry: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, doc_id, score, rank): one aggregation, no full outer join.

    A document in one list only keeps null for the other's score and rank; duplicates in a list add up. Ties (to twelve
    places): the lexical order first, then the semantic one. ``carry``: further columns of both lists that come along.
    """
    a = lexical.select("query_id", "doc_id", "bm25_score", "bm25_rank", F.lit(None).cast("double").alias("semantic_score"), F.lit(None).cast("int").alias("semantic_rank"), (F.lit(weights[0]) / (RRF + F.col("bm25_rank"))).alias("w"), *carry)
    b = semantic.select("query_id", "doc_id", F.lit(None).cast("double").alias("bm25_score"), F.lit(None).cast("int").alias("bm25_rank"), "semantic_score", "semantic_rank", (F.lit(weights[1]) / (RRF + F.col("semantic_rank"))).alias("w"), *carry)
    both = a.unionByName(b).groupBy("query_id", "doc_id").agg(
        F.max("bm25_score").alias("bm25_score"), F.max("bm25_rank").alias("bm25_rank"), F.max("semantic_score").alias("semantic_score"), F.max("semantic_rank").alias("semantic_rank"), F.sum("w").alias("fusion_score"), *[F.max(c).alias(c) for c in carry]
    )
    order = [F.desc(F.round("fusion_score", 12)), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("semantic_rank"), F.asc("doc_id")]
    return top_ranked(both, "query_id", order, k, "fusion_rank")


def rerank(fused: DataFrame, scorer: Callable[[DataFrame], DataFrame], k: int = 5) -> DataFrame:
    """The k best of each query by a model's score (null last), ties in the order of the fused list.

    ``scorer`` adds a column rerank_score; see scorers for vectorised ones.
    """
    return top_ranked(scorer(fused), "query_id", [F.desc_nulls_last("rerank_score"), F.asc("fusion_rank")], k, "rerank_rank")
