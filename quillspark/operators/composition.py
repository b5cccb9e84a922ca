"""Deciding which statements a document holds: eligibility, ownership, plan guards, and topping entries up in rounds for all entries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import FILLER, fold_case, hash_id, jaccard, strip, word_count, word_set
from quillspark.operators.evidence import greedy_first
from quillspark.runtime import Scratch, join_spread

# What makes a card fit to be written up, and the limits of a document.
LEAST_CLAIM, MOST_KEPT_WORDS, MOST_NEW_WORDS, SIMILAR = 26, 43, 38, 0.72
UNFIT = ("education", "certification", "skill")
TARGETS = {"experience": 3, "project": 2}
ENTRIES = {"experience": 3, "project": 2}
SECTIONS = {"experience": "experience", "projects": "project"}
ATTEMPTS, TRIES, TECHNOLOGIES = 5, 2, 7


def eligible(claim: Column, category: Column) -> Column:
    """Whether a card's claim can become a statement: long enough, says something, and of a category that is written up. Never null."""
    said = strip(F.coalesce(claim, F.lit("")))
    return (F.length(said) >= LEAST_CLAIM) & ~said.rlike(FILLER) & ~F.coalesce(category, F.lit("")).isin(*UNFIT)


def kind_of(section: Column) -> Column:
    """The entity type that a section's entries have."""
    out = F.lit(None).cast("string")
    for s, k in SECTIONS.items():
        out = F.when(section == s, k).otherwise(out)
    return out


def kept_existing(bullets: DataFrame, cards: DataFrame) -> DataFrame:
    """(entry_id, kind, place, bullet_id, text): what an entry keeps of its statements, at most its target, in order of bullet_id.

    Kept are statements of at most MOST_KEPT_WORDS words without filler, with one card or more, all of which are known and
    belong to the entry and its kind, and which resemble none kept before them. Only as many as the target are looked
    for, as more would not be used. ``bullets``: bullet_id, section, entry_id, text, evidence_ids; ``cards``: evidence_id, entity_id,
    entity_type. Null entries, texts and id arrays are never kept; groups of any size are reduced place by place.
    """
    b = bullets.withColumn("kind", kind_of(F.col("section"))).where("kind is not null and entry_id is not null and text is not null and size(evidence_ids) > 0")
    b = b.where((word_count(F.col("text")) <= MOST_KEPT_WORDS) & ~F.col("text").rlike(FILLER))
    cites = b.select("bullet_id", "entry_id", "kind", F.explode("evidence_ids").alias("evidence_id")).join(cards.select("evidence_id", "entity_id", "entity_type"), "evidence_id", "left")
    foreign = cites.where(~F.coalesce((F.col("entity_id") == F.col("entry_id")) & (F.col("entity_type") == F.col("kind")), F.lit(False))).select("bullet_id").distinct()
    own = b.join(foreign, "bullet_id", "left_anti").withColumn("entry", F.struct("kind", "entry_id"))
    first = greedy_first(own, "entry", "bullet_id", "text", max(TARGETS.values()), SIMILAR)
    most = F.when(F.col("entry.kind") == "experience", TARGETS["experience"]).otherwise(TARGETS["project"])
    return first.where(F.col("place") <= most).select("entry.entry_id", "entry.kind", "place", "bullet_id", "text")


Maker = Callable[[DataFrame], DataFrame]


def top_up(kept: DataFrame, candidates: DataFrame, make: Maker) -> DataFrame:
    """(entry_id, kind, place, text, evidence_ids, made): every entry's statements up to its target, kept ones first.

    ``kept``: entry_id, kind, place, text, evidence_ids (of what the entry has already). ``candidates``: entry_id, kind, evidence_id,
    claim, score, weight, unique by entry and card. Candidates are taken best first (score, weight, then the larger id); those
    that the entry uses already, and those that resemble a statement it has, are passed over at no cost; every other one is
    an attempt, of which there are ATTEMPTS an entry. ``make`` turns (key, entry_id, kind, evidence_id, claim, avoid) into (key, text): the
    statement that passed all its checks, or null; ``avoid`` has the word sets of the entry's statements.

    A round takes one attempt for all open entries: their next candidates are found by a maximum that is combined before the
    shuffle, so no entry's candidates are ever gathered; what a round leaves over is written, so that models are asked once.
    Entries without candidates keep what they have; entries with nothing at all have no rows.
    """
    scratch = Scratch(candidates.sparkSession)
    target = F.when(F.col("kind") == "experience", TARGETS["experience"]).otherwise(TARGETS["project"])
    key = F.concat_ws("\u0001", "kind", "entry_id")
    none = F.array().cast("array<string>")
    rows = kept.select(key.alias("key"), "entry_id", "kind", "place", "text", F.coalesce("evidence_ids", none).alias("evidence_ids"), F.lit(False).alias("made"))
    rows = scratch.write(rows, "kept")
    left = candidates.where("entry_id is not null and evidence_id is not null").select(
        key.alias("key"), "entry_id", "kind", F.struct("score", "weight", "evidence_id").alias("order"), "evidence_id", "claim", word_set(F.col("claim")).alias("words")
    )
    left = scratch.write(left, "left0")
    for attempt in range(1, ATTEMPTS + 1):
        # What an entry has: at most its target of statements, so the lists are short.
        state = rows.groupBy("key").agg(F.count("*").alias("n"), F.collect_list(word_set(F.col("text"))).alias("avoid"), F.flatten(F.collect_list("evidence_ids")).alias("used"))
        state = scratch.write(left.groupBy("key", "kind").agg(F.lit(1).alias("open")).join(state, "key", "left").where(F.coalesce("n", F.lit(0)) < target), f"state{attempt}")
        had = join_spread(left, state.select("key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("avoid", F.array().cast("array<array<string>>")).alias("avoid"), F.coalesce("used", none).alias("used")), "key")
        free = had.where(~F.array_contains("used", F.col("evidence_id")) & ~F.exists("avoid", lambda a: jaccard(F.col("words"), a) >= SIMILAR))
        free = scratch.write(free, f"free{attempt}")
        best = free.groupBy("key", "entry_id", "kind").agg(F.max(F.struct("order", "evidence_id", "claim", "n", "avoid")).alias("b")).select("key", "entry_id", "kind", "b.*")
        best = scratch.write(best, f"best{attempt}")
        if best.isEmpty():
            break
        made = make(best.select("key", "entry_id", "kind", "evidence_id", "claim", "avoid")).select("key", "text").where("text is not null")
        new = best.join(made, "key").select("key", "entry_id", "kind", (F.col("n") + 1).cast("int").alias("place"), "text", F.array("evidence_id").alias("evidence_ids"), F.lit(True).alias("made"))
        rows = rows.unionByName(scratch.write(new, f"new{attempt}"))
        tried = best.select("key", F.col("order").alias("last"))
        left = join_spread(free.drop("n", "avoid", "used"), tried, "key").where(F.col("order") < F.col("last")).drop("last")
        left = scratch.write(left, f"left{attempt}")
    return rows.drop("key")


def limited_entries(entries: DataFrame, owner: str) -> DataFrame:
    """The first ENTRIES of each kind of every owner, by pos; technologies are cut to the first TECHNOLOGIES."""
    from quillspark.operators.retrieval import top_ranked

    out = None
    for kind, most in ENTRIES.items():
        part = top_ranked(entries.where(F.col("kind") == kind), owner, [F.asc("pos"), F.asc("entry_id")], most, "place")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("technologies", F.slice(F.coalesce("technologies", F.array().cast("array<string>")), 1, TECHNOLOGIES))


def guarded_plan(bullets: DataFrame, entries: DataFrame, cards: DataFrame, requirements: DataFrame) -> DataFrame:
    """(bullet_id, section, entry_id, evidence_ids, requirement_ids): planned statements that keep to what is known.

    ``bullets``: bullet_id, section, entry_id, evidence_ids, requirement_ids; ``entries``: kind, entry_id; ``cards``: evidence_id, entity_id,
    entity_type (those the planner was given); ``requirements``: requirement_id. Unknown cards and requirements are taken out;
    a summary has no entry; statements of other sections need a known entry of their kind and keep its cards only; one without cards is dropped.
    Ids keep their order; null arrays count as empty; unknown sections are dropped.
    """
    b = bullets.withColumn("kind", kind_of(F.col("section"))).where("section = 'summary' or kind is not null")
    known = entries.select("kind", "entry_id").distinct()
    b = b.where("section = 'summary'").withColumn("entry_id", F.lit(None).cast("string")).unionByName(b.where("section <> 'summary'").join(known, ["kind", "entry_id"], "left_semi").select(b.columns))
    e = b.select("bullet_id", "kind", "entry_id", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(cards.select("evidence_id", "entity_id", "entity_type").distinct(), "evidence_id")
    fit = e.where(F.col("kind").isNull() | ((F.col("entity_id") == F.col("entry_id")) & (F.col("entity_type") == F.col("kind"))))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])  # noqa: E731  (ids of one statement)
    kept = fit.groupBy("bullet_id").agg(in_order("evidence_id").alias("kept"))
    asked = b.select("bullet_id", F.posexplode("requirement_ids").alias("pos", "requirement_id")).join(requirements.select("requirement_id").distinct(), "requirement_id")
    asked = asked.groupBy("bullet_id").agg(in_order("requirement_id").alias("asked"))
    return b.join(kept, "bullet_id").join(asked, "bullet_id", "left").select(
        "bullet_id", "section", "entry_id", F.col("kept").alias("evidence_ids"), F.coalesce("asked", F.array().cast("array<string>")).alias("requirement_ids")
    )


def plan_id(section: Column, entry_id: Column, objective: Column, evidence_ids: Column) -> Column:
    return hash_id("plan", 12, section, F.coalesce(entry_id, F.lit("")), objective, F.array_join(evidence_ids, ","), by="|")


def emphasised(wanted: DataFrame, own: DataFrame, supported: DataFrame) -> DataFrame:
    """(owner, place, skill): the supported spelling of each wanted skill, once, in order; the owner's own skills where none is supported.

    ``wanted`` and ``own``: owner, pos, skill; ``supported``: skill, and owner unless it holds for all. Skills meet whatever their case; the last supported spelling counts.
    """
    on = ["owner", "folded"] if "owner" in supported.columns else ["folded"]
    s = supported.where("skill is not null").withColumn("folded", fold_case(F.col("skill"))).groupBy(*on).agg(F.max("skill").alias("shown"))

    def met(rows: DataFrame) -> DataFrame:
        j = rows.where("skill is not null").select("owner", "pos", fold_case(F.col("skill")).alias("folded")).join(s, on)
        return j.groupBy("owner", "shown").agg(F.min("pos").alias("pos"))

    first = met(wanted)
    rest = met(own).join(first.select("owner").distinct(), "owner", "left_anti")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("owner").orderBy("pos", "shown")).cast("int")  # skills of one plan
    return first.unionByName(rest).select("owner", place.alias("place"), F.col("shown").alias("skill"))


def fresh_summary(summary: DataFrame, statements: DataFrame) -> DataFrame:
    """(owner, text): the first summary line of each owner by pos, unless it repeats one of its statements in other words."""
    first = summary.where("text is not null").groupBy("owner").agg(F.min(F.struct("pos", "text")).alias("f")).select("owner", "f.text")
    near = join_spread(statements.select("owner", F.col("text").alias("said")), first, "owner").where(jaccard(word_set(F.col("text")), word_set(F.col("said"))) >= SIMILAR)
    return first.join(near.select("owner").distinct(), "owner", "left_anti")
