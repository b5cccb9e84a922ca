"""The stages that ask a model, for whole tables in batched rounds: facts, requirements, plans, statements and their validation, profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import jsontext as J
from quillspark.functions.text import FILLER, bullet_text, distinct_folded, hash_id, jaccard, search_query, strip, word_count, word_set
from quillspark.operators import composition as K
from quillspark.operators import evidence as E
from quillspark.operators.scorers import TextModel
from quillspark.plans.rounds import generate_checked
from quillspark.runtime import Scratch

FACTS = "facts array<struct<claim:string,category:string,skills:array<string>,metrics:array<struct<name:string,value:string,context:string>>>>"
REQUIREMENTS = "role_title string, company string, requirements array<struct<text:string,category:string,importance:string,skills:array<string>,years_experience:string>>"
PLAN = "summary_focus string, skills_to_emphasize array<string>, bullets array<struct<section:string,entry_id:string,objective:string,evidence_ids:array<string>,requirement_ids:array<string>>>"
VERDICT = "supported boolean, unsupported_claims array<string>, reason string"
CATEGORIES = ("achievement", "experience", "project", "responsibility", "certification", "education", "skill", "other")
Problem = Callable[[Column], Column]


def readable(schema: str, wrong: Callable[[Column], Column] | None = None) -> Problem:
    """A check of responses: null where they can be read by the schema (and ``wrong`` of the struct is null), else the reason."""

    def problem(c: Column) -> Column:
        got = J.parsed(c, schema)
        bad = F.when(got.isNull(), "the answer is no JSON object of the asked form")
        return F.coalesce(bad, wrong(got)) if wrong else bad

    return problem


def evidence_payload(plans: DataFrame, cards: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, evidence array<struct>): the known cards of each plan in the order of its ids, as they go into a prompt; plans without any have no row."""
    e = plans.select("id", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(cards.select("evidence_id", *fields), "evidence_id")
    one = F.struct("pos", "evidence_id", *fields)
    return e.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("pos")).alias("evidence"))  # ids of one plan


def written(plans: DataFrame, cards: DataFrame, writer: TextModel, checker: TextModel, tries: int, wrong: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, text, tries, reason): for each plan the first statement that reads, passes ``wrong`` and is supported by its cards; text null if none did.

    ``plans``: id, section, entry_id, objective, evidence_ids. A round asks the writer once a pending plan (up to twice more where its
    answer can't be read), then the checker; what it objects to is told the writer in the next round. ``wrong`` makes of
    columns (text and the plan's) a reason or null, before the checker is asked. Plans without known cards, and answers that stay unreadable, fail.
    """
    scratch = Scratch(plans.sparkSession)
    with_cards = plans.join(evidence_payload(plans, cards, ("claim", "skills", "metrics", "entity_id", "entity_type")), "id")
    pending = scratch.write(with_cards.withColumn("feedback", F.lit(None).cast("string")), "pending")
    done = scratch.write(plans.join(with_cards.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("text"), F.lit(0).alias("tries"), F.lit("no known evidence").alias("reason")), "bare")
    filled = lambda g: F.when(F.coalesce(strip(g["text"]), F.lit("")) == "", "the text is empty")
    for r in range(1, tries + 1):
        prompt = F.to_json(F.struct("section", "entry_id", "objective", "evidence", F.col("feedback").alias("previous_validation_feedback")))
        said = generate_checked(pending.select("id", prompt.alias("prompt")), writer, readable("text string", filled))
        text = bullet_text(J.parsed(F.col("response"), "text string")["text"])
        new = pending.join(said.select("id", F.when(F.col("problem").isNull(), text).alias("text"), "problem"), "id")
        new = scratch.write(new.withColumn("wrong", wrong(F.col("text")) if wrong else F.lit(None).cast("string")), f"new{r}")
        ask = new.where("text is not null and wrong is null")
        claims = F.transform("evidence", lambda x: x.dropFields("entity_id", "entity_type"))
        verdicts = generate_checked(ask.select("id", F.to_json(F.struct(F.col("text").alias("generated_statement"), claims.alias("evidence"))).alias("prompt")), checker, readable(VERDICT), 1)
        v = verdicts.select("id", J.parsed(F.col("response"), VERDICT).alias("v"))
        judged = new.join(v, "id", "left")
        reason = F.coalesce(F.col("problem"), F.col("wrong"), F.concat_ws("; ", "v.reason", F.array_join("v.unsupported_claims", "; ")))
        ok = F.col("wrong").isNull() & F.coalesce(F.col("v.supported"), F.lit(False))
        over = ok | F.col("problem").isNotNull() | (F.col("wrong").isNull() & F.col("v").isNull())  # supported, or nothing that can be read
        judged = scratch.write(judged.select(*pending.drop("feedback").columns, "text", ok.alias("ok"), (over | F.lit(r == tries)).alias("over"), reason.alias("reason")), f"judged{r}")
        done = done.unionByName(judged.where("over").select("id", F.when(F.col("ok"), F.col("text")).alias("text"), F.lit(r).alias("tries"), F.when(~F.col("ok"), F.col("reason")).alias("reason")))
        pending = judged.where("not over").drop("text", "ok", "over").withColumnRenamed("reason", "feedback").select(pending.columns)
        if r < tries and pending.isEmpty():
            break
    return done


def composer(cards: DataFrame, writer: TextModel, checker: TextModel) -> K.Maker:
    """What K.top_up makes statements with: TRIES tries each, short, without filler, supported, and unlike what the entry has."""

    def make(best: DataFrame) -> DataFrame:
        plans = best.select(
            F.col("key").alias("id"), F.when(F.col("kind") == "project", "projects").otherwise("experience").alias("section"), "entry_id",
            F.lit("One action and its result from this claim, 28 words at most, no list of skills, no new facts.").alias("objective"), F.array("evidence_id").alias("evidence_ids"), "avoid",
        )

        def wrong(text: Column) -> Column:
            long = (word_count(text) > K.MOST_NEW_WORDS) | text.rlike(FILLER)
            near = F.exists("avoid", lambda a: jaccard(word_set(text), a) >= K.SIMILAR)
            return F.when(long, "at most 28 words, one action, no list of skills").when(near, "the document says so already")

        return written(plans, cards, writer, checker, K.TRIES, wrong).select(F.col("id").alias("key"), "text")

    return make


def resume_statements(plans: DataFrame, cards: DataFrame, writer: TextModel, checker: TextModel) -> DataFrame:
    """(id, section, entry_id, text, evidence_ids, requirement_ids, source_labels, validated) of the plans whose statement was supported within three rounds."""
    from quillspark.functions.text import source_label

    out = written(plans.select("id", "section", "entry_id", "objective", "evidence_ids"), cards, writer, checker, 3).where("text is not null")
    cites = plans.select("id", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(cards.select("evidence_id", source_label(F.col("entity_id"), F.col("source_file")).alias("label")), "evidence_id")
    labels = cites.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"])).alias("source_labels"))  # ids of one plan
    return plans.join(out.select("id", "text"), "id").join(labels, "id", "left").select("id", "section", "entry_id", "text", "evidence_ids", "requirement_ids", "source_labels", F.lit(True).alias("validated"))


def parsed_plans(plans: DataFrame, model: TextModel) -> DataFrame:
    """(id, summary_focus, skills, bullet_pos, section, entry_id, objective, evidence_ids, requirement_ids) of (id, prompt); answers that can't be read after two repairs are an error."""
    said = generate_checked(plans, model, readable(PLAN))
    said = said.withColumn("p", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("no plan for "), "id"))).otherwise(J.parsed(F.col("response"), PLAN)))
    return said.select("id", "p.summary_focus", F.col("p.skills_to_emphasize").alias("skills"), F.posexplode_outer("p.bullets").alias("bullet_pos", "b")).select("id", "summary_focus", "skills", "bullet_pos", "b.*")


def extracted_requirements(postings: DataFrame, model: TextModel) -> DataFrame:
    """Requirement records of (id, prompt): enums repaired, years read, skills once each, ids by text; unreadable answers are an error."""
    from quillspark.functions.text import years

    said = generate_checked(postings, model, readable(REQUIREMENTS))
    got = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("no requirements in "), "id"))).otherwise(J.parsed(F.col("response"), REQUIREMENTS))
    r = said.select("id", got.alias("g")).select("id", "g.role_title", "g.company", F.posexplode("g.requirements").alias("pos", "r")).where(F.coalesce(strip(F.col("r.text")), F.lit("")) != "")
    r = r.select("id", "role_title", "company", "pos", "r.text", "r.category", "r.importance", distinct_folded(F.col("r.skills")).alias("skills"), years(F.col("r.years_experience")).alias("years_experience"))
    r = J.repair_enums(r)
    return r.withColumns({"requirement_id": hash_id("req", 12, F.lower(strip(F.col("text")))), "search_query": search_query(F.col("text"), F.col("skills"))})


def _facts_wrong(got: Column) -> Column:
    bad = lambda f: (F.coalesce(strip(f["claim"]), F.lit("")) == "") | ~F.coalesce(f["category"].isin(*CATEGORIES), F.lit(False))
    return F.when(got["facts"].isNull(), "there is no list of facts").when(F.exists(got["facts"], bad), "a fact has no claim or an unknown category")


def extract_incrementally(chunks: DataFrame, state: DataFrame, cards: DataFrame, model: TextModel, columns: tuple[str, ...] = ("document_id", "source_file", "source_type", "text", "page", "entity_id", "entity_type")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards, state, counters): facts of the chunks that are new, changed or damaged; everything else is taken over.

    ``chunks``: chunk records; ``state``: chunk_id, fingerprint, evidence_ids; ``cards``: the cards of the earlier extraction. The model is asked
    in batches, three times at most a chunk; a chunk it gives no usable answer for keeps out of cards and state, so that it is
    tried again, and counts as failed. Chunks that are gone are dropped with their cards. counters: one row of processed, skipped, failed, dropped and cards.
    """
    scratch = Scratch(chunks.sparkSession)
    now = scratch.write(chunks.withColumn("fingerprint", E.fingerprint(model.version, *columns)), "chunks")
    status = scratch.write(E.cache_diff(now.select("chunk_id", "fingerprint"), state, cards), "status")
    todo = now.join(status.where("status <> 'reuse'"), "chunk_id", "left_semi")
    prompts = todo.select(F.col("chunk_id").alias("id"), F.to_json(F.struct("document_id", "source_file", "page", "entity_id", "entity_type", "text")).alias("prompt"))
    said = scratch.write(generate_checked(prompts, model, readable(FACTS, _facts_wrong)).select(F.col("id").alias("chunk_id"), "problem", J.parsed(F.col("response"), FACTS)["facts"].alias("facts")), "facts")
    read = todo.join(said.where("problem is null").select("chunk_id", "facts"), "chunk_id")
    new = E.cards_from_facts(read.drop("fingerprint", "text", "chunk_index"))
    reused = status.where("status = 'reuse'").select("chunk_id")
    old = cards.join(reused.withColumnRenamed("chunk_id", "source_chunk_id"), "source_chunk_id", "left_semi").select(new.columns)
    out = scratch.write(old.unionByName(new), "cards")
    have = E.cards_by_chunk(out).select("chunk_id", "evidence_ids")
    ready = reused.unionByName(said.where("problem is null").select("chunk_id"))
    entries = now.select("chunk_id", "fingerprint").join(ready, "chunk_id", "left_semi").join(have, "chunk_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))
    counts = cache_counters(status).crossJoin(said.agg(F.count_if(F.col("problem").isNotNull()).alias("failed"))).crossJoin(E.vanished(now, state).agg(F.count("*").alias("dropped"))).crossJoin(out.agg(F.count("*").alias("cards")))  # rows of one
    return out, scratch.write(entries, "state"), counts


def cache_counters(status: DataFrame) -> DataFrame:
    """One row: chunks to be processed and chunks that are skipped."""
    return status.agg(F.count_if(F.col("status") != "reuse").alias("processed"), F.count_if(F.col("status") == "reuse").alias("skipped"))


PROFILE = (
    "experience array<struct<company:string,title:string,location:string,start_date:string,end_date:string>>, projects array<struct<name:string,technologies:array<string>,date:string>>, "
    "education array<struct<institution:string,degree:string,field:string,graduation_date:string>>, certifications array<struct<name:string,issuer:string,date:string>>, skills array<string>, name string, email string, phone string, location string, linkedin string, github string"
)
REQUIRED = {"experience": ("company", "title"), "projects": ("name",), "education": ("institution", "degree"), "certifications": ("name",)}


def profile_drafts(sources: DataFrame, model: TextModel) -> DataFrame:
    """(source_file, draft struct) of (source_file, prompt): what a model reads out of unstructured files, without entries that lack a required field; unreadable answers are an error."""
    said = generate_checked(sources.select(F.col("source_file").alias("id"), "prompt"), model, readable(PROFILE))
    got = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("no profile in "), "id"))).otherwise(J.parsed(F.col("response"), PROFILE))
    d = said.select(F.col("id").alias("source_file"), got.alias("d"))
    for part, names in REQUIRED.items():
        d = d.withColumn("d", F.col("d").withField(part, E.with_required(F.coalesce(F.col(f"d.{part}"), F.array()), *names)))
    return d.select("source_file", F.col("d").alias("draft"))
