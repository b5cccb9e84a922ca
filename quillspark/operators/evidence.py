"""Evidence cards: from facts, by chunk, against an earlier extraction, and joined to what cites them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import distinct_folded, hash_id, jaccard, metrics_complete, strip, word_set
from quillspark.runtime import Scratch, join_spread

STATE_VERSION = 3


def cards_from_facts(chunks: DataFrame) -> DataFrame:
    """One card per fact of (chunk columns, facts array<struct<claim, category, skills, metrics>>); equal claims stay apart."""
    f = chunks.select(*[c for c in chunks.columns if c != "facts"], F.explode("facts").alias("f"))
    claim = strip(F.col("f.claim"))
    return f.select(
        hash_id("ev", 16, F.col("chunk_id"), F.lower(claim)).alias("evidence_id"), claim.alias("claim"), F.col("f.category").alias("category"), distinct_folded(F.col("f.skills")).alias("skills"),
        metrics_complete(F.col("f.metrics")).alias("metrics"), "entity_id", "entity_type", F.col("chunk_id").alias("source_chunk_id"), "document_id", "source_file", "source_type", "page",
    )


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key, the one with the largest ``by``: the last of duplicates wins."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("r")).select(key, "r.*")


def fingerprint(model: str, *columns: str) -> Column:
    """SHA-256 of the columns and the model's version, as a JSON object: no two rows that differ in a column share their text, null apart from empty."""
    fields = F.struct(F.lit(f"{STATE_VERSION}/{model}").alias("made_by"), *[F.col(c).alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def cards_by_chunk(cards: DataFrame) -> DataFrame:
    """(chunk_id, n_cards, evidence_ids sorted) of every chunk that has cards."""
    return cards.where("source_chunk_id is not null").groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(F.count("*").alias("n_cards"), F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"))


def cache_diff(chunks: DataFrame, state: DataFrame, cards: DataFrame) -> DataFrame:
    """(chunk_id, status): reuse, changed, new or damaged, of every chunk against the state of an earlier extraction.

    ``chunks``: chunk_id, fingerprint; ``state``: chunk_id, fingerprint, evidence_ids. A chunk is reused when its fingerprint is
    unchanged and exactly the cards that the state names are there; chunks without facts are reused too.
    """
    have = cards_by_chunk(cards).select("chunk_id", F.col("evidence_ids").alias("have"))
    old = state.select("chunk_id", F.col("fingerprint").alias("old"), F.sort_array(F.array_distinct("evidence_ids")).alias("said"))
    none = F.array().cast("array<string>")
    same = F.coalesce("said", none) == F.coalesce("have", none)
    status = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("fingerprint"), "changed").when(~same, "damaged").otherwise("reuse")
    return chunks.join(old, "chunk_id", "left").join(have, "chunk_id", "left").select("chunk_id", status.alias("status"))


def vanished(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks that the state knows and that are no longer there."""
    return state.join(chunks, "chunk_id", "left_anti").select("chunk_id")


def cited(citing: DataFrame, key: str, ids: str, cards: DataFrame) -> DataFrame:
    """(key, pos, evidence_id, claim, entity_id, entity_type) of every id in the array that a card has; others are dropped."""
    e = citing.select(key, F.posexplode(ids).alias("pos", "evidence_id"))
    return e.join(cards.select("evidence_id", "claim", "entity_id", "entity_type"), "evidence_id").select(key, "pos", "evidence_id", "claim", "entity_id", "entity_type")


def owned(bullets: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bullets all of whose cards belong to their entry, those with a foreign or unknown card); ones without ids are in neither."""
    e = bullets.where("size(evidence_ids) > 0").select("bullet_id", "entry_id", F.explode("evidence_ids").alias("evidence_id"))
    j = e.join(cards.select("evidence_id", "entity_id"), "evidence_id", "left")
    wrong = j.where("entity_id is null or entry_id is null or entity_id <> entry_id").select("bullet_id").distinct()
    have = bullets.where("size(evidence_ids) > 0")
    return have.join(wrong, "bullet_id", "left_anti"), have.join(wrong, "bullet_id", "left_semi")


def greedy_first(rows: DataFrame, group: str, ident: str, text: str, k: int = 3, threshold: float = 0.72) -> DataFrame:
    """(group, place, ident, text): the first k rows of each group, by ident, that resemble none before them by shared words.

    One pass a place: the smallest ident of each group is taken (combined before the shuffle), and what resembles it drops
    out. So a group of any size is never gathered, and the result is that of a loop over its rows which stops at k; every pass
    is written, and groups that fill much of the rows meet their one taken row by broadcast. Null groups, idents and texts have no
    rows; equal rows count once.
    """
    scratch = Scratch(rows.sparkSession)
    left = rows.select(F.col(group).alias("g"), F.col(ident).alias("i"), F.col(text).alias("t")).where("g is not null and i is not null and t is not null").distinct().withColumn("w", word_set(F.col("t")))
    left = scratch.write(left, "left0")
    out = None
    for place in range(1, k + 1):
        first = scratch.write(left.groupBy("g").agg(F.min(F.struct("i", "t", "w")).alias("f")), f"first{place}")
        taken = first.select(F.col("g").alias(group), F.lit(place).alias("place"), F.col("f.i").alias(ident), F.col("f.t").alias(text))
        out = taken if out is None else out.unionByName(taken)
        if place < k:
            rest = join_spread(left, first, "g").where((F.struct("i", "t") > F.struct("f.i", "f.t")) & (jaccard(F.col("w"), F.col("f.w")) < threshold)).drop("f")
            left = scratch.write(rest, f"left{place}")
    return out


def merged_entries(docs: DataFrame, keys: list[str], pos: str, canonical: str | None = None, union: str | None = None) -> DataFrame:
    """One row per natural key: its values, the place of its first row, and its distinct source files in order.

    The values are those of its last row; where ``canonical`` names a boolean column and a row of the key has it, of its last canonical row,
    else of its first. ``union`` names an array column whose distinct elements are taken from all rows, in their order.
    """
    rest = [c for c in docs.columns if c not in (*keys, "source_file", canonical)]
    value = F.struct(pos, *[c for c in rest if c != pos])
    last = F.max(value)
    if canonical:
        last = F.coalesce(F.max(F.when(F.col(canonical), value)), F.min(value))
    rows = docs.groupBy(*keys).agg(F.min(pos).alias("first_pos"), last.alias("last"))
    files = docs.groupBy(*keys, "source_file").agg(F.min(pos).alias("p")).groupBy(*keys)
    named = files.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "source_file"))), lambda x: x["source_file"]).alias("source_files"))
    out = rows.join(named, keys)
    kept = [F.col(f"last.{c}").alias(c) for c in rest if c not in (pos, union)]
    if union:
        once = docs.select(*keys, pos, F.posexplode(union).alias("at", "item")).where("item is not null").groupBy(*keys, "item").agg(F.min(F.struct(pos, "at")).alias("p"))
        lists = once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "item"))), lambda x: x["item"]).alias(union))
        out = out.join(lists, keys, "left")
        kept.append(F.coalesce(union, F.array().cast(docs.schema[union].dataType)).alias(union))
    return out.select(*keys, "first_pos", *kept, "source_files")


def with_system_first(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with all system texts led into the first other message: its text if that is the user's, else a
    new user message before it; a conversation of system messages alone becomes one user message."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    system = messages.where("role = 'system'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("lead"))
    rest = messages.where("role <> 'system'").withColumn("n", F.row_number().over(w))
    j = rest.join(system, "conv_id", "left")
    merged = j.withColumn("text", F.when((F.col("n") == 1) & (F.col("role") == "user") & F.col("lead").isNotNull(), F.concat_ws("\n\n", "lead", "text")).otherwise(F.col("text")))
    heads = rest.where("n = 1")
    lone = system.join(heads.select("conv_id", "role"), "conv_id", "left").where("role is null or role <> 'user'").select("conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.col("lead").alias("text"))
    return merged.select("conv_id", F.col("turn").cast("bigint"), "role", "text").unionByName(lone)


def first_filled(rows: DataFrame, key: str, pos: str, columns: list[str]) -> DataFrame:
    """Per key and column the first value, by ``pos``, that is neither null nor blank."""
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    return rows.groupBy(key).agg(*[F.min_by(F.when(filled(c), F.col(c)), F.when(filled(c), F.col(pos))).alias(c) for c in columns])


def with_required(entries: Column, *names: str) -> Column:
    """The structs of an array whose named fields are all filled; a null array is empty."""

    def ok(e: Column) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & (F.coalesce(F.trim(e[n]), F.lit("")) != "")
        return out

    return F.filter(entries, ok)
