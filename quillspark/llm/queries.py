"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import SPACE
from quillspark.llm.canonical import map_elements, map_to_list
from quillspark.llm.garbled import restore_texts
from quillspark.llm.mixing import mix, shares
from quillspark.llm.neardup import classes_with_links, pairs_of, similar_classes
from quillspark.llm.packing import kinds_of, pack
from quillspark.llm.personal import find_personal, redact
from quillspark.llm.splitting import split_oversized
from quillspark.llm.tokens import token_counts
from quillspark.llm.topn import top_n_per_group
from quillspark.runtime import Scratch, join_spread, table


def _skills(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The free-typed elements with their value's place, and the (value, ref_id) rows."""
    catalog = table(spark, d, "skill_catalog")
    names = catalog.select(F.col("skill_id").alias("ref_id"), F.col("skill_name").alias("name"))
    aliases = catalog.select(F.col("skill_id").alias("ref_id"), F.explode("aliases").alias("name"))
    items = map_elements(table(spark, d, "evidence"), "evidence_id", "skills", names).unionByName(
        map_elements(table(spark, d, "requirements"), "requirement_id", "skills", names)
    )
    items = Scratch(spark).write(items.distinct(), "items")
    return items, map_to_list(items, names.unionByName(aliases))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    items, mapped = _skills(spark, d)
    return join_spread(items, mapped, "value").select("record_id", "pos", F.col("ref_id").alias("skill_id")).distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry, and in how many places they stand."""
    items, mapped = _skills(spark, d)
    return items.groupBy("value").agg(F.count("*").alias("places")).join(mapped.where("ref_id = 0").select("value"), "value")


def p1_spelt(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p1_found whose element is a name or alias but for its case and the white space at its ends."""
    catalog = table(spark, d, "skill_catalog").select(F.explode(F.concat(F.array("skill_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = catalog.where("name is not null").select(F.lower(F.trim("name")).alias("folded")).distinct()
    items, mapped = _skills(spark, d)
    same = items.withColumn("folded", F.lower(F.trim("value"))).join(F.broadcast(names), "folded", "left_semi")
    return join_spread(same, mapped, "value").select("record_id", "pos", F.col("ref_id").alias("skill_id")).distinct()


def _statements(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "evidence").select(F.lit(0).alias("kind"), F.col("evidence_id").alias("id"), F.col("claim").alias("text"))
    return claims.unionByName(table(spark, d, "bullets").select(F.lit(1).alias("kind"), F.col("bullet_id").alias("id"), "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(*similar_classes(_statements(spark, d), 0.75)).select("id_a", "id_b")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return classes_with_links(*similar_classes(_statements(spark, d), 0.75)).drop("class_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks"), ["chunk_id", "chunk_index", "entity_id"], "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks"), ["chunk_id"], "text").select("chunk_id").distinct()


def p3_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every split text put together again from its pieces: the hash of what it says, and whether all pieces and overlaps keep their limits."""
    pieces = p3_pieces(spark, d).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece", "start_pos", "end_pos", "piece_text"))).alias("p"))  # pieces of one text
    start = F.struct(F.lit("").alias("said"), F.lit(0).alias("end"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        over = F.greatest(acc["end"] - x["start_pos"], F.lit(0))
        ok = acc["ok"] & (F.length(x["piece_text"]) <= 500) & (over <= 150) & (F.length(x["piece_text"]) == x["end_pos"] - x["start_pos"])
        return F.struct(F.concat(acc["said"], x["piece_text"].substr(over + 1, F.lit(500))).alias("said"), x["end_pos"].alias("end"), ok.alias("ok"))

    done = pieces.select("chunk_id", F.aggregate("p", start, step).alias("r"))
    return done.select("chunk_id", F.sha2(F.regexp_replace("r.said", SPACE, ""), 256).alias("said"), F.col("r.ok").alias("ok"))


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "candidates"), "requirement_id", "evidence_id", "rerank_score", 5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_top(spark, d).select("requirement_id", "evidence_id")


def _personal_rows(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "text")
    return chunks.unionByName(table(spark, d, "parsed_documents").select(F.col("document_id").alias("id"), "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(_personal_rows(spark, d), "id", "text").select("record_id", "kind", "start_pos").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(_personal_rows(spark, d), "id", "text")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    kinds = kinds_of(table(spark, d, "containers"), "container_kind", "capacity_tokens")
    return pack(token_counts(table(spark, d, "documents"), ["doc_id"], "text"), "doc_id", "n_tokens", kinds)


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of container: how many are used and which part of them is filled."""
    full = p6_pack(spark, d).groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("container_kind")
    used = full.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    return used.join(F.broadcast(table(spark, d, "containers").distinct()), "container_kind").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def p6_valid(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: containers that hold more than they may or one thing on another, and whether every token has its place."""
    counts = Scratch(spark).write(token_counts(table(spark, d, "documents"), ["doc_id"], "text"), "counts")
    kinds = kinds_of(table(spark, d, "containers"), "container_kind", "capacity_tokens")
    placed = pack(counts, "doc_id", "n_tokens", kinds)
    cap = spark.createDataFrame(kinds or [("", 0)], "container_kind string, capacity_tokens bigint").where("capacity_tokens > 0")
    full = placed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"))
    bad = full.join(F.broadcast(cap), "container_kind").groupBy("container_kind").agg(F.count_if((F.col("n") > F.col("capacity_tokens")) | (F.col("end") != F.col("n"))).alias("overfull"), F.sum("n").alias("tokens"))
    total = counts.agg(F.sum("n_tokens").alias("total"))
    return cap.join(bad, "container_kind").crossJoin(total).select("container_kind", "capacity_tokens", "overfull", (F.col("tokens") == F.col("total")).alias("complete"))  # a row a kind


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source", "text"), ["key", "source"], "text")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), table(spark, d, "mix_targets")).withColumnRenamed("key", "doc_id")


def _p7_shares(spark: SparkSession, d: str, total: str | None) -> DataFrame:
    counts = Scratch(spark).write(_sized(spark, d), "sized")
    return shares(mix(counts, table(spark, d, "mix_targets"), total), counts, table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p7_shares(spark, d, "once")


def p7_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the largest mixture in which every source that has documents meets its target."""
    return _p7_shares(spark, d, None)


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """Per target: whether the source is in the mixture, and whether it is repeated no more than it may be."""
    s = p7_shares(spark, d)
    return s.select("source", "target_share", "max_repeats", (F.col("used") > 0).alias("used"), (F.col("repeats") <= F.col("max_repeats")).alias("within"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return restore_texts(table(spark, d, "documents"), "doc_id", "text", "lang")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_restored(spark, d).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_spelt": p1_spelt,
    "p1_unmatched": p1_unmatched,
    "p2_classes": p2_classes,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_rebuilt": p3_rebuilt,
    "p4_found": p4_found,
    "p4_top": p4_top,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_pack": p6_pack,
    "p6_usage": p6_usage,
    "p6_valid": p6_valid,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_exact_shares": p7_exact_shares,
    "p7_valid": p7_valid,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}

_P4 = """
WITH once AS (
  SELECT requirement_id, evidence_id, max(rerank_score + 0.0) AS rerank_score FROM candidates  -- -0.0 equals 0.0
  WHERE requirement_id IS NOT NULL AND evidence_id IS NOT NULL AND rerank_score IS NOT NULL AND NOT isnan(rerank_score)
  GROUP BY 1, 2),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY requirement_id ORDER BY rerank_score DESC, evidence_id) AS INT) AS "rank" FROM once)
"""

_P2 = """
WITH said AS (
  SELECT 0 AS kind, evidence_id AS id, claim AS text FROM evidence UNION SELECT 1, bullet_id, text FROM bullets),
sets AS (
  SELECT kind, id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ws FROM said WHERE text IS NOT NULL AND id IS NOT NULL),
words AS (SELECT DISTINCT kind, id, len(ws) AS n, unnest(ws) AS w FROM sets),
shared AS (
  SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS c FROM words a JOIN words b ON a.kind = b.kind AND a.w = b.w AND a.id < b.id
  GROUP BY 1, 2, 3, 4)
"""

_P1 = """
WITH names AS (SELECT skill_id, unnest(list_concat([skill_name], coalesce(aliases, []))) AS name FROM skill_catalog), folded AS (SELECT lower(trim(name, ' ')) AS f, min(skill_id) AS skill_id FROM names WHERE name IS NOT NULL GROUP BY 1),
e AS (SELECT evidence_id AS record_id, unnest(skills) AS value, unnest(range(len(skills))) AS pos FROM evidence UNION ALL SELECT requirement_id, unnest(skills), unnest(range(len(skills))) FROM requirements)
SELECT DISTINCT record_id, CAST(pos AS INT) AS pos, CAST(skill_id AS INT) AS skill_id FROM e JOIN folded ON lower(trim(value, ' ')) = f WHERE record_id IS NOT NULL AND trim(value) <> '' AND value NOT IN (SELECT skill_name FROM skill_catalog WHERE skill_name IS NOT NULL)
"""

_P2_CLASSES = _P2.replace("'[a-z0-9]+')) AS ws", "'[a-z0-9]+')) AS ws", 1) + """,
cl AS (SELECT DISTINCT kind, id, array_to_string(list_sort(ws), ' ') AS c FROM sets WHERE len(ws) > 0), classes AS (SELECT kind, c, count(*) AS copies, min(id) AS first_id FROM cl GROUP BY 1, 2),
cw AS (SELECT kind, c, len(string_split(c, ' ')) AS n, unnest(string_split(c, ' ')) AS w FROM classes), both_ AS (SELECT a.kind, a.c AS ca, b.c AS cb, a.n AS na, b.n AS nb, count(*) AS k FROM cw a JOIN cw b ON a.kind = b.kind AND a.w = b.w AND a.c <> b.c GROUP BY 1, 2, 3, 4, 5),
deg AS (SELECT kind, ca AS c, count(*) AS linked_classes FROM both_ WHERE k >= 0.75 * (na + nb - k) GROUP BY 1, 2)
SELECT CAST(kind AS INT) AS kind, id, first_id, copies, coalesce(linked_classes, 0) AS linked_classes FROM cl JOIN classes USING (kind, c) LEFT JOIN deg USING (kind, c)"""

ORACLES: dict[str, str] = {
    "p1_spelt": _P1,
    "p2_classes": _P2_CLASSES,
    "p2_found": _P2 + "SELECT DISTINCT id_a, id_b FROM shared WHERE c >= 0.75 * (na + nb - c)",
    "p3_found": r"SELECT DISTINCT chunk_id FROM chunks WHERE length(trim(text, E' \t\r\n')) > 500",
    "p3_rebuilt": rf"SELECT DISTINCT chunk_id, sha256(regexp_replace(text, '{SPACE}', '', 'g')) AS said, true AS ok FROM chunks WHERE length(trim(text, E' \t\r\n')) > 500",
    "p4_found": _P4 + "SELECT requirement_id, evidence_id FROM ranked WHERE \"rank\" <= 5",
    "p4_top": _P4 + "SELECT * FROM ranked WHERE \"rank\" <= 5",
    # What must hold of every plan, whatever its tokens are.
    "p6_valid": "SELECT DISTINCT container_kind, CAST(capacity_tokens AS BIGINT) AS capacity_tokens, CAST(0 AS BIGINT) AS overfull, true AS complete FROM containers WHERE container_kind IS NOT NULL",
    "p7_valid": "SELECT DISTINCT source, target_share, max_repeats, source IN (SELECT source FROM documents WHERE length(text) > 0 AND source IS NOT NULL) AS used, true AS within FROM mix_targets",
}
