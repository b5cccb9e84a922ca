"""Ranking and selecting cards, skills and layout items in one pass for any number of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import ACTION, FILLER, fold_case, strip
from quillspark.operators.markdown import CANONICAL

# Weights of match strengths, and of categories in the two rankings.
PLAN_WEIGHTS = {"strong": 100, "partial": 70}
COMPOSE_WEIGHTS = {"strong": 8, "partial": 4}
PLAN_CATEGORY = {"achievement": 5, "experience": 4, "project": 4, "responsibility": 3, "certification": 2, "education": 2, "skill": 1}
COMPOSE_CATEGORY = {"achievement": 4, "experience": 3, "project": 3, "responsibility": 2, "skill": -2, "other": -3}
# The groups that skills are shown in.
SKILL_GROUPS = {
    "Languages": ("python", "sql", "c++", "c", "c#", "java", "javascript", "typescript", "bash", "powershell", "html", "css"),
    "Frameworks & Data": ("fastapi", "react", "node.js", "next.js", "pandas", "pydantic", "postgresql", "mysql", "sql server", "mongodb", "bm25", "rag", "sentence-transformers", "llama.cpp", "rest apis", "rest api"),
    "Cloud, DevOps & Testing": ("docker", "github actions", "git", "linux", "google cloud run", "gcp", "aws", "azure", "pytest", "selenium", "playwright", "junit", "cloudwatch", "splunk", "la tex", "latex"),
}


def _lookup(c: Column, values: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def downgraded(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches (requirement_id, match_strength, evidence_ids) with only ids among the requirement's candidates; none left, or a
    strength that is neither strong nor partial, makes it a none without ids."""
    known = matches.select("requirement_id", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(candidates.select("requirement_id", "evidence_id").distinct(), ["requirement_id", "evidence_id"])
    kept = known.groupBy("requirement_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_id"))), lambda x: x["evidence_id"]).alias("kept"))
    ok = F.col("kept").isNotNull() & F.col("match_strength").isin("strong", "partial")
    return matches.join(kept, "requirement_id", "left").select(
        "requirement_id", F.when(ok, F.col("match_strength")).otherwise("none").alias("match_strength"), F.when(ok, F.col("kept")).otherwise(F.array().cast("array<string>")).alias("evidence_ids")
    )


def priorities(matches: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(evidence_id, priority, requirement_ids): the largest weight of any match, and the requirements of those that count."""
    e = matches.select("requirement_id", _lookup(F.lower("match_strength"), weights).alias("w"), F.explode("evidence_ids").alias("evidence_id"))
    return e.groupBy("evidence_id").agg(F.max("w").alias("priority"), F.sort_array(F.collect_set(F.when(F.col("w") > 0, F.col("requirement_id")))).alias("requirement_ids"))


def plan_order(cards: DataFrame) -> DataFrame:
    """Cards (with priority) with the columns that rank them for planning, best first: r1 to r5, then the larger id."""
    name = F.lower(F.element_at(F.split(F.coalesce("source_file", F.lit("")), "/"), -1))
    return cards.withColumns({
        "r1": F.coalesce("priority", F.lit(0)), "r2": F.when(name.isin(*CANONICAL), 2).otherwise(0), "r3": _lookup(F.col("category"), PLAN_CATEGORY),
        "r4": F.when(F.size(F.coalesce("metrics", F.array())) > 0, 2).otherwise(0), "r5": F.least(F.size(F.coalesce("skills", F.array())), F.lit(3)),
    })


def plan_selection(cards: DataFrame, plan: str, most: int = 28, each: int = 3) -> DataFrame:
    """The cards that a plan is made from, at most ``most`` each ``plan``, numbered by ``pick``.

    Matched cards come first, then up to ``each`` of every entry (experience before project), then the rest, always in
    plan_order. Of equal claims of one entity only the best counts; blank claims don't.
    """
    best = [F.desc(f"r{k}") for k in range(1, 6)] + [F.desc("evidence_id")]
    said = plan_order(cards).withColumn("said", fold_case(strip(F.coalesce("claim", F.lit(""))))).where("said <> ''")
    once = said.withColumn("n", F.row_number().over(Window.partitionBy(plan, "entity_id", "said").orderBy(*best))).where("n = 1")
    # The better rows of an entity all come before a row of it, so no entity gives more than ``most``.
    nth = once.withColumn("k", F.row_number().over(Window.partitionBy(plan, "entity_id").orderBy(*best))).where(F.col("k") <= most)
    entry = F.when(F.col("entity_type") == "experience", 0).when(F.col("entity_type") == "project", 1)
    quota = entry.isNotNull() & (F.col("k") <= each)
    phase = F.when(F.col("r1") > 0, 0).when(quota, 1).otherwise(2)
    order = [F.asc("phase"), F.asc_nulls_last("turn"), *best]
    staged = nth.withColumns({"phase": phase, "turn": F.when((phase == 1), entry)})
    return staged.withColumn("pick", F.row_number().over(Window.partitionBy(plan).orderBy(*order)).cast("int")).where(F.col("pick") <= most)


def compose_score(cards: DataFrame) -> DataFrame:
    """Cards (with priority) with the score and length that rank them for composition; ties go to the larger id."""
    claim = F.coalesce("claim", F.lit(""))
    score = (
        F.coalesce("priority", F.lit(0)) + F.when(F.size(F.coalesce("metrics", F.array())) > 0, 4).otherwise(0) + _lookup(F.lower(F.coalesce("category", F.lit(""))), COMPOSE_CATEGORY)
        + F.when(claim.rlike(ACTION), 2).otherwise(0) - F.when(claim.rlike(FILLER), 5).otherwise(0)
    )
    return cards.withColumns({"score": score.cast("int"), "weight": F.least(F.length(claim), F.lit(180)).cast("int")})


def compose_best(scored: DataFrame, entry: str, n: int) -> DataFrame:
    """The n best cards of every entry."""
    w = Window.partitionBy(entry).orderBy(F.desc("score"), F.desc("weight"), F.desc("evidence_id"))
    return scored.withColumn("place", F.row_number().over(w).cast("int")).where(F.col("place") <= n)


def skill_inventory(own: DataFrame, projects: DataFrame, cards: DataFrame) -> DataFrame:
    """(owner, pos, skill) of three sources in order: the owner's own skills of at most 40 characters, technologies of its projects, skills of its cards.

    Each source: owner, pos, skill; the first spelling in this order is the one that best_skills shows.
    """
    part = lambda df, n: df.select("owner", (F.lit(n) * F.lit(1 << 40) + F.col("pos").cast("long")).alias("pos"), "skill")
    return part(own.where(F.length(strip(F.col("skill"))).between(1, 40)), 0).unionByName(part(projects, 1)).unionByName(part(cards, 2))


def best_skills(skills: DataFrame, job_text: DataFrame, n: int = 16, chosen: DataFrame | None = None) -> DataFrame:
    """The n best of (owner, pos, skill): those a job text of the owner names as a whole word first (6), ``chosen`` ones (owner, skill) next (2), then by folded spelling.

    The first spelling of each counts; blank ones, and ones over 42 characters, with a colon or a line break don't. ``job_text``: one row an
    owner. An owner's skills may be any number: they are scored row by row and cut to n before the shuffle.
    """
    s = skills.withColumn("skill", strip(F.col("skill"))).where("skill <> '' and length(skill) <= 42 and instr(skill, ':') = 0 and instr(skill, '\\n') = 0").withColumn("folded", fold_case(F.col("skill")))
    once = s.groupBy("owner", "folded").agg(F.min_by("skill", "pos").alias("skill"))
    j = once.join(job_text.select("owner", fold_case(F.col("text")).alias("job")), "owner", "left")
    # A word on its own: what stands around each place where it occurs is no word character.
    parts = F.split(F.col("job"), F.concat(F.lit(r"\Q"), F.col("folded"), F.lit(r"\E")), -1)
    free = F.exists(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: (i < F.size(parts)) & ~F.element_at(parts, i).rlike(r"\w$") & ~F.try_element_at(parts, i + 1).rlike(r"^\w"))
    named = F.coalesce(free & (F.size(parts) > 1), F.lit(False))
    score = F.when(named, 6).otherwise(0)
    if chosen is not None:
        j = j.join(chosen.select("owner", fold_case(F.col("skill")).alias("folded"), F.lit(2).alias("had")).distinct(), ["owner", "folded"], "left")
        score = score + F.coalesce("had", F.lit(0))
    scored = j.withColumn("score", score)
    w = Window.partitionBy("owner").orderBy(F.desc("score"), "folded")
    return scored.withColumn("place", F.row_number().over(w).cast("int")).where(F.col("place") <= n).select("owner", "place", "skill", "score")


def skill_group(skill: Column) -> Column:
    out = F.lit("Other")
    for group, members in reversed(SKILL_GROUPS.items()):
        out = F.when(fold_case(skill).isin(*members), group).otherwise(out)
    return out


def trim_order(bullets: DataFrame, steps: int | None = 32) -> DataFrame:
    """(owner, section, entry_pos, bullet) with ``step``: the bullets that a layout which is too long drops, in order; the first ``steps``, as many as fitting tries.

    Projects before experience, the last entry first, its last bullet first; the first bullet of an entry is never dropped.
    """
    b = bullets.where("section in ('projects', 'experience')")
    first = b.groupBy("owner", "section", "entry_pos").agg(F.min("bullet").alias("first"))
    w = Window.partitionBy("owner").orderBy(F.when(F.col("section") == "projects", 0).otherwise(1), F.desc("entry_pos"), F.desc("bullet"))
    rest = b.join(first, ["owner", "section", "entry_pos"]).where("bullet > first").drop("first")
    ordered = rest.withColumn("step", F.row_number().over(w).cast("int"))
    return ordered if steps is None else ordered.where(F.col("step") <= steps)
