"""From requirements, cards and profiles to finished documents, for any number of owners at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import jsontext as J
from quillspark.functions.text import fold_case, hash_id, strip
from quillspark.operators import composition as K
from quillspark.operators import evidence as E
from quillspark.operators import render as R
from quillspark.operators import selection as S
from quillspark.operators.scorers import TextModel
from quillspark.plans import models
from quillspark.plans.rounds import generate_checked
from quillspark.runtime import Scratch

JUDGED = "match_strength string, evidence_ids array<string>, reason string"


def evidence_map(requirements: DataFrame, candidates: DataFrame, cards: DataFrame, model: TextModel) -> DataFrame:
    """(requirement_id, match_strength, evidence_ids, reason) of every requirement: what a model makes of its candidates.

    ``requirements``: requirement_id, text, importance; ``candidates``: requirement_id, evidence_id, place. Each requirement that has known candidates is
    asked for once; without candidates, with an answer that can't be read, with a strength that is neither strong nor partial, or with no id among
    the candidates it is a none without ids. The ids of an answer keep their order.
    """
    scratch = Scratch(requirements.sparkSession)
    r = requirements.where("requirement_id is not null").select("requirement_id", "text", "importance").distinct()
    c = candidates.join(cards.select("evidence_id", "claim", "category", "skills", "metrics", "entity_id"), "evidence_id")
    one = F.struct("place", "evidence_id", "claim", "category", "skills", "metrics", "entity_id")
    given = c.groupBy("requirement_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("place")).alias("candidates"))  # a few a requirement
    asked = r.join(given, "requirement_id").select(F.col("requirement_id").alias("id"), F.to_json(F.struct("requirement_id", "text", "importance", "candidates")).alias("prompt"))
    said = scratch.write(generate_checked(asked, model, models.readable(JUDGED), 1), "said").select(F.col("id").alias("requirement_id"), J.parsed(F.col("response"), JUDGED).alias("j"))
    judged = said.where("j is not null").select("requirement_id", F.lower("j.match_strength").alias("match_strength"), F.coalesce("j.evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), "j.reason")
    kept = S.downgraded(judged, c.select("requirement_id", "evidence_id"))
    none = F.array().cast("array<string>")
    return r.select("requirement_id").join(kept, "requirement_id", "left").join(judged.select("requirement_id", "reason"), "requirement_id", "left").select(
        "requirement_id", F.coalesce("match_strength", F.lit("none")).alias("match_strength"), F.coalesce("evidence_ids", none).alias("evidence_ids"), F.coalesce("reason", F.lit("nothing to judge")).alias("reason")
    )


#: Of each kind of entry: its columns, and those that make two entries one.
ENTRIES = {
    "experience": (("company", "title", "location", "start_date", "end_date"), ("company", "title", "start_date", "end_date")),
    "project": (("name", "technologies", "date"), ("name",)),
    "education": (("institution", "degree", "field", "location", "graduation_date"), ("institution", "degree", "graduation_date")),
    "certification": (("name", "issuer", "date"), ("name", "issuer")),
}
_PARTS = {"experience": "experience", "project": "projects", "education": "education", "certification": "certifications"}


def profile_entries(documents: DataFrame, kind: str, drafts: DataFrame | None = None) -> DataFrame:
    """(entry_id, kind, pos, the kind's columns, source_files): entries by their natural key, whatever its case and outer white space.

    ``documents``: pos, source_file, entity_id, entity_type, metadata. The last structured entry of a key gives the values and id, the first
    its place; entries that only ``drafts`` (source_file, draft; see models.profile_drafts) have come after them, the first of a key counts, with an id made of
    its key. Source files and a project's technologies are those of all.
    """
    columns, natural = ENTRIES[kind]
    own = documents.where((F.col("entity_type") == kind) & F.col("entity_id").isNotNull() & F.col("metadata").isNotNull())
    shape = [F.col(f"metadata.{c}").alias(c) for c in columns]
    rows = own.select(F.struct(F.lit(0).alias("drafted"), F.col("pos").cast("string").alias("at")).alias("pos"), "source_file", "entity_id", F.lit(True).alias("canonical"), *shape)
    if drafts is not None:
        said = drafts.select("source_file", F.posexplode(f"draft.{_PARTS[kind]}").alias("n", "e"))
        have = said.schema["e"].dataType.fieldNames()
        at = F.concat_ws("/", "source_file", F.lpad(F.col("n").cast("string"), 6, "0"))
        rows = rows.unionByName(said.select(F.struct(F.lit(1).alias("drafted"), at.alias("at")).alias("pos"), "source_file", F.lit(None).cast("string").alias("entity_id"), F.lit(False).alias("canonical"), *[(F.col(f"e.{c}") if c in have else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in columns]))
    keys = [f"k_{c}" for c in natural]
    keyed = rows.withColumns({f"k_{c}": fold_case(strip(F.coalesce(c, F.lit("")))) for c in natural})
    merged = E.merged_entries(keyed, keys, "pos", "canonical", "technologies" if "technologies" in columns else None)
    made = hash_id({"experience": "exp", "project": "proj", "education": "edu", "certification": "cert"}[kind], 12, *[F.col(k) for k in keys], by="|")
    return merged.select(F.coalesce("entity_id", made).alias("entry_id"), F.lit(kind).alias("kind"), F.col("first_pos").alias("pos"), *columns, "source_files")


def composed(entries: DataFrame, bullets: DataFrame, cards: DataFrame, matches: DataFrame, job: DataFrame, own_skills: DataFrame, summary: DataFrame, writer: TextModel, checker: TextModel) -> DataFrame:
    """(owner, experience, projects, skills, summary): every owner's document, with statements kept and topped up.

    ``entries``: owner, kind, pos, entry_id and the columns of ENTRIES for experiences and projects (an entry has one owner); ``bullets``: statements there are already (see
    composition.kept_existing); ``cards``: evidence; ``matches``: requirement_id, match_strength, evidence_ids; ``job``: owner, text; ``own_skills``: owner, pos, skill; ``summary``: owner,
    pos, text. Of an owner's entries the first count (composition.ENTRIES); those without any statement are left out; the skills are its own, its projects' and its cards'
    best; a summary that a statement repeats is dropped.
    """
    scratch = Scratch(cards.sparkSession)
    first = scratch.write(K.limited_entries(entries, "owner"), "entries")
    ours = first.select("owner", "kind", "entry_id")
    scored = S.compose_score(cards.drop("priority").join(S.priorities(matches, S.COMPOSE_WEIGHTS).select("evidence_id", "priority"), "evidence_id", "left"))
    fit = scored.where(K.eligible(F.col("claim"), F.col("category"))).select(F.col("entity_id").alias("entry_id"), F.col("entity_type").alias("kind"), "evidence_id", "claim", "score", "weight")
    kept = K.kept_existing(bullets, cards).join(bullets.select("bullet_id", "evidence_ids"), "bullet_id").join(ours.select("kind", "entry_id"), ["kind", "entry_id"], "left_semi")
    said = K.top_up(kept, fit.join(ours.select("kind", "entry_id"), ["kind", "entry_id"], "left_semi"), models.composer(cards, writer, checker))
    said = scratch.write(said.join(ours, ["kind", "entry_id"]).withColumn("validated", F.lit(True)), "said")
    experience = R.with_statements(first.where("kind = 'experience'"), said.where("kind = 'experience'"), list(ENTRIES["experience"][0])).withColumnRenamed("entries", "experience")
    projects = R.with_statements(first.where("kind = 'project'"), said.where("kind = 'project'"), list(ENTRIES["project"][0])).withColumnRenamed("entries", "projects")
    of_projects = first.where("kind = 'project'").select("owner", F.posexplode("technologies").alias("pos", "skill"))
    of_cards = cards.join(ours.withColumnsRenamed({"entry_id": "entity_id", "kind": "entity_type"}), ["entity_id", "entity_type"]).select("owner", F.posexplode("skills").alias("pos", "skill"))
    best = S.best_skills(S.skill_inventory(own_skills, of_projects, of_cards), job)
    skills = best.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "skill"))), lambda x: x["skill"]).alias("skills"))  # 16 an owner
    lead = K.fresh_summary(summary, said).select("owner", F.array(F.struct("text", F.array().cast("array<string>").alias("evidence_ids"), F.lit(True).alias("validated"))).alias("summary"))
    owners = first.select("owner").distinct()
    return owners.join(experience, "owner", "left").join(projects, "owner", "left").join(skills, "owner", "left").join(lead, "owner", "left")
