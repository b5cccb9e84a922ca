"""Overlapping chunks of whole documents, as folds over arrays: a document never leaves its row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import SPACE, strip

MOST, LEAST, OVERLAP = 500, 200, 150
_STRINGS = "array<string>"


def _pack(pieces: Column, seed_next) -> Column:
    """Greedy packing: pieces join the current one while ``seed_next`` says so; its second result starts the next."""
    start = F.struct(F.array().cast(_STRINGS).alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, piece: Column) -> Column:
        joined, fresh = seed_next(acc["cur"], piece)
        fits = F.length(joined) <= MOST
        return F.struct(
            F.when(fits | (acc["cur"] == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))).alias("out"),
            F.when(fits, joined).when(acc["cur"] == "", piece).otherwise(fresh).alias("cur"),
        )

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))


def paragraphs(text: Column) -> Column:
    """Stripped non-empty parts between blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), rf"\n{SPACE}*\n"), strip), lambda p: p != "")


def packed_sentences(paragraph: Column) -> Column:
    """A paragraph's sentences packed into pieces of up to MOST characters; one longer sentence is a piece by itself."""
    sentences = F.filter(F.transform(F.split(paragraph, rf"(?<=[.!?]){SPACE}+"), strip), lambda s: s != "")
    return _pack(sentences, lambda cur, s: (F.when(cur == "", s).otherwise(F.concat(cur, F.lit(" "), s)), s))


def normal_paragraphs(text: Column) -> Column:
    """Paragraphs of up to MOST characters as they are, longer ones as packed sentences."""
    return F.flatten(F.transform(paragraphs(text), lambda p: F.when(F.length(p) <= MOST, F.array(p)).otherwise(packed_sentences(p))))


def overlap_tail(chunk: Column) -> Column:
    """The last OVERLAP characters after the first space in them; short chunks whole."""
    tail = F.right(chunk, F.lit(OVERLAP))
    cut = F.instr(tail, " ")
    return F.when(F.length(chunk) <= OVERLAP, chunk).otherwise(strip(F.when(cut > 0, tail.substr(cut + 1, F.lit(OVERLAP))).otherwise(tail)))


def chunks(text: Column) -> Column:
    """Paragraphs packed into chunks, each but the first led by the tail of the one before; tiny ones are merged back."""

    def grow(cur: Column, p: Column) -> tuple[Column, Column]:
        tail = overlap_tail(cur)
        return F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p)), F.when(tail == "", p).otherwise(F.concat(tail, F.lit("\n\n"), p))

    def merge(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        tiny = (F.size(acc) > 0) & (F.length(c) < LEAST) & (F.length(last) + F.length(c) <= MOST)
        return F.when(tiny, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n\n"), c)))).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(_pack(normal_paragraphs(text), grow), F.array().cast(_STRINGS), merge)


def chunk_documents(documents: DataFrame) -> DataFrame:
    """One row per chunk of every document, with chunk_id, chunk_index and the document's other columns.

    Null and blank texts give no rows. Chunks never cross documents. A chunk may exceed MOST: a long sentence isn't cut,
    and the overlap is added to a full piece.
    """
    rest = [c for c in documents.columns if c not in ("text", "chunk_index", "chunk_id")]
    cut = documents.select(*rest, F.posexplode(chunks(F.col("text"))).alias("chunk_index", "text"))
    return cut.withColumn("chunk_id", F.format_string("%s_chunk_%03d", "document_id", "chunk_index"))
