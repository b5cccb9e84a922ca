import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark import schemas
from quillspark.functions import text as T
from quillspark.operators import composition as K
from quillspark.operators import evidence as E
from quillspark.operators import render as R
from quillspark.operators import selection as S
from quillspark.operators.scorers import ClaimWriter, WordChecker
from quillspark.plans import models, resume, search
from quillspark.sources import sinks

CARD = "evidence_id string, claim string, category string, skills array<string>, metrics array<struct<name:string,value:string,context:string>>, entity_id string, entity_type string, source_file string, priority int"


def card(i, claim, entity, kind, category="achievement", priority=0):
    return (i, claim, category, ["Go"], None, entity, kind, "a/notes_file.md", priority)


def claims(n, seed):
    r = random.Random(seed)
    return ["Built " + " ".join(r.choices([f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ata", "ole", "irk", "unt")], k=9)) for _ in range(n)]


def test_every_oracle_is_sql():
    assert all(isinstance(sql, str) and "SELECT" in sql for sql in entry.oracle_sql().values())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_document_of_two_and_two_entries(spark):
    """Two experiences with three cards each and two projects with two or three: 6 + 4 statements, a foreign one dropped, all owned."""
    c = claims(11, 3)
    owners = [("exp_a", "experience")] * 3 + [("exp_b", "experience")] * 3 + [("proj_a", "project")] * 3 + [("proj_b", "project")] * 2
    cards = spark.createDataFrame([card(f"e{k:02d}", t, *o) for k, (t, o) in enumerate(zip(c, owners, strict=True))], CARD)
    ddl = "bullet_id string, section string, entry_id string, text string, evidence_ids array<string>"
    given = spark.createDataFrame([("b1", "experience", "exp_a", "Led the whole move of " + c[0][6:], ["e00"]), ("b2", "projects", "proj_a", c[3], ["e03"])], ddl)
    kept = K.kept_existing(given, cards)
    assert [(r.entry_id, r.bullet_id) for r in kept.collect()] == [("exp_a", "b1")]
    cand = S.compose_score(cards).where(K.eligible(F.col("claim"), F.col("category"))).select(F.col("entity_id").alias("entry_id"), F.col("entity_type").alias("kind"), "evidence_id", "claim", "score", "weight")
    out = K.top_up(kept.join(given.select("bullet_id", "evidence_ids"), "bullet_id"), cand, models.composer(cards, ClaimWriter(), WordChecker()))
    rows = out.collect()
    count = {k: sum(r.entry_id == k for r in rows) for k in ("exp_a", "exp_b", "proj_a", "proj_b")}
    assert count == {"exp_a": 3, "exp_b": 3, "proj_a": 2, "proj_b": 2}
    own = {f"e{k:02d}": o[0] for k, o in enumerate(owners)}
    assert all(own[i] == r.entry_id for r in rows for i in r.evidence_ids)
    entries = spark.createDataFrame([("d", k, e, kind, "2020-01", None) for k, (e, kind) in enumerate([("exp_a", "experience"), ("exp_b", "experience"), ("proj_a", "project"), ("proj_b", "project")])], "owner string, pos int, entry_id string, kind string, start_date string, technologies array<string>")
    said = out.select(F.lit("d").alias("owner"), "entry_id", "place", "text", "evidence_ids", F.lit(True).alias("validated"))
    ex = R.with_statements(entries.where("kind = 'experience'").selectExpr("*", "'T_x' as title", "'C & D' as company", "null as location", "null as end_date"), said, ["title", "company", "location", "start_date", "end_date"])
    pr = R.with_statements(entries.where("kind = 'project'").selectExpr("*", "entry_id as name", "'2021' as date"), said, ["name", "date", "technologies"])
    doc = ex.withColumnRenamed("entries", "experience").join(pr.withColumnRenamed("entries", "projects"), "owner").selectExpr(
        "named_struct('name', '**A B**', 'email', 'a_b@x.test', 'phone', cast(null as string), 'location', '', 'linkedin', cast(null as string), 'github', cast(null as string)) as header", "experience", "projects",
        "array(named_struct('text', 'Short.', 'evidence_ids', array('e00'), 'validated', true)) as summary", "array('Python', 'Zig') as skills", "array(named_struct('degree', 'BSc', 'field', cast(null as string), 'graduation_date', '2019-05', 'institution', 'U', 'location', cast(null as string))) as education",
        "array(named_struct('name', 'C1', 'issuer', cast(null as string), 'date', cast(null as string))) as certifications",
    )
    tex = doc.select(R.latex_document().alias("t")).first().t
    assert tex.count(r"\item ") == 10 and tex.count("% Evidence: ") == 10 and tex.endswith("\\end{document}\n")
    assert r"\bfseries A B}" in tex and r"a\_b@x.test" in tex and r"\textit{C \& D}" in tex and r"\hfill May 2019" in tex and r"\textbf{Languages:} Python\par" in tex and r"\textbf{Other:} Zig\par" in tex
    assert tex.index("{Summary}") < tex.index("{Technical Skills}") < tex.index("{Professional Experience}") < tex.index("{Projects}") < tex.index("{Education}") < tex.index("{Certifications}")
    rep = R.layout_report(doc, "normal", 1, 0.5, ["thin"]).first()
    assert (rep.experience_entries, rep.project_entries, rep.experience_bullets, rep.project_bullets, rep.warnings) == (2, 2, 6, 4, ["thin"])
    assert R.layout_report(doc.withColumn("projects", F.array().cast("array<struct<bullets:array<string>>>")), "normal", 1, None, []).first().warnings == ["No project entry contains a verified bullet"]


def fussy():
    class Here:
        version = "f"

        def generate(self, prompts):
            import json as j

            out = []
            for p in prompts:
                p = j.loads(p.split("\n\nThe last", 1)[0])
                claim = p["evidence"][0]["claim"]
                out.append(j.dumps({"text": "word " * 50 if "x" in claim or not p.get("previous_validation_feedback") else claim}))
            return out

    return Here()


def test_attempts_and_tries(spark):
    """Five attempts an entry, two tries each; cards in use or alike cost none."""
    c = claims(9, 5)
    rows = [card("e9", c[0] + " x", "a", "experience"), card("e8", c[1] + " x", "a", "experience"), card("e7", c[2] + " x", "a", "experience"), card("e6", c[3] + " x", "a", "experience"), card("e5", c[3] + " x more", "a", "experience"), card("e4", c[4], "a", "experience"), card("e3", c[4], "a", "experience"), card("e2", c[5], "a", "experience"), card("u", c[6], "b", "project", priority=8)]
    cards = spark.createDataFrame(rows, CARD)
    cand = cards.selectExpr("entity_id as entry_id", "entity_type as kind", "evidence_id", "claim", "0 as score", "1 as weight")
    kept = spark.createDataFrame([("b", "project", 1, "Something else altogether was done", ["u"])], "entry_id string, kind string, place int, text string, evidence_ids array<string>")
    got = K.top_up(kept, cand, models.composer(cards, fussy(), WordChecker())).collect()
    # e9 to e5 are the five attempts (e5 resembles e6, but nothing was accepted for e6).
    assert {(r.entry_id, r.text, r.made) for r in got} == {("b", "Something else altogether was done", False)}
    more = cand.where("evidence_id not in ('e9', 'e8')")
    got = K.top_up(kept.where("false"), more, models.composer(cards, fussy(), WordChecker())).orderBy("place").collect()
    assert [(r.entry_id, r.text) for r in got if r.entry_id == "a"] == [("a", c[4]), ("a", c[5])] and [r.text for r in got if r.entry_id == "b"] == [c[6]]
    assert K.top_up(kept.where("false"), cand.where("false"), models.composer(cards, fussy(), WordChecker())).count() == 0


def test_statements_say_why_they_failed(spark):
    cards = spark.createDataFrame([card("e1", "Built the red mill", "a", "experience")], CARD)
    plans = spark.createDataFrame([("p1", "experience", "a", "o", ["e1", "gone"]), ("p2", "experience", "a", "o", ["gone"]), ("p3", "experience", "a", "o", None)], "id string, section string, entry_id string, objective string, evidence_ids array<string>")
    got = {r.id: r for r in models.written(plans, cards, ClaimWriter(), WordChecker(), 2).collect()}
    assert got["p1"].text == "Built the red mill" and got["p2"].reason == "no known evidence" and "p3" in got
    full = models.resume_statements(plans.withColumn("requirement_ids", F.array(F.lit("r"))), cards, ClaimWriter(), WordChecker()).collect()
    assert [(r.id, r.source_labels, r.validated) for r in full] == [("p1", ["A"], True)]


def test_guard_skills_summary_limits(spark):
    cards = spark.createDataFrame([card("e1", "c", "a", "experience"), card("e2", "c", "p", "project")], CARD)
    entries = spark.createDataFrame([("experience", "a"), ("project", "p")], "kind string, entry_id string")
    b = spark.createDataFrame([("1", "summary", "a", ["e1", "zz"], ["r", "q"]), ("2", "experience", "a", ["e2", "e1"], None), ("3", "experience", "a", ["e2"], []), ("4", "projects", "a", ["e1"], []), ("5", "other", "a", ["e1"], []), ("6", "projects", "p", None, [])], "bullet_id string, section string, entry_id string, evidence_ids array<string>, requirement_ids array<string>")
    out = {r.bullet_id: (r.entry_id, r.evidence_ids, r.requirement_ids) for r in K.guarded_plan(b, entries, cards, spark.createDataFrame([("r",)], "requirement_id string")).collect()}
    assert out == {"1": (None, ["e1"], ["r"]), "2": ("a", ["e1"], [])}
    want = spark.createDataFrame([("o", 0, "GO"), ("o", 1, "no"), ("o", 2, "go")], "owner string, pos int, skill string")
    own = spark.createDataFrame([("o", 0, "Zig"), ("n", 0, "zig")], "owner string, pos int, skill string")
    sup = spark.createDataFrame([("o", "Go"), ("o", "Zig"), ("n", "Zig")], "owner string, skill string")
    assert {tuple(r) for r in K.emphasised(want, own, sup).collect()} == {("o", 1, "Go"), ("n", 1, "Zig")}
    s = spark.createDataFrame([("o", 1, "Built a red mill"), ("n", 0, "Fresh words"), ("n", 1, "later")], "owner string, pos int, text string")
    assert [tuple(r) for r in K.fresh_summary(s, spark.createDataFrame([("o", "built a RED mill"), ("n", "x")], "owner string, text string")).collect()] == [("n", "Fresh words")]
    inv = S.skill_inventory(own.where("owner = 'o'"), want.limit(0), spark.createDataFrame([("o", 5, "ZIG"), ("o", 6, "Go")], "owner string, pos int, skill string"))
    best = S.best_skills(inv, spark.createDataFrame([("o", "needs go")], "owner string, text string"), chosen=spark.createDataFrame([("o", "zig")], "owner string, skill string"))
    assert [(r.skill, r.score) for r in best.orderBy("place").collect()] == [("Go", 6), ("Zig", 2)]


def facts_model(version="m"):
    class Here:
        def __init__(self):
            self.version = version

        def generate(self, prompts):
            import json as j

            return ["nothing" if "broken" in p else j.dumps({"facts": [{"claim": j.loads(p.split("\n\nThe last", 1)[0])["text"], "category": "other", "skills": ["A", "a"], "metrics": [{"name": "n", "value": None, "context": None}]}]}) for p in prompts]

    return Here()


def test_incremental_extraction(spark):
    rows = [(f"c{k}", "d", "f.md", "markdown", f"text {k}", None, k, "e", "project") for k in range(3)] + [("c9", "d", "f.md", "markdown", "broken", None, 9, None, None)]
    ch = spark.createDataFrame(rows, schemas.RECORDS["chunk"])
    none = spark.createDataFrame([], schemas.RECORDS["state"]), spark.createDataFrame([], schemas.RECORDS["evidence"])
    cards, state, n = models.extract_incrementally(ch, *none, facts_model())
    assert n.first().asDict() == {"processed": 4, "skipped": 0, "failed": 1, "dropped": 0, "cards": 3}
    assert {r.chunk_id for r in state.collect()} == {"c0", "c1", "c2"} and cards.first().metrics == []
    changed = ch.withColumn("text", F.when(F.col("chunk_id") == "c1", "new").otherwise(F.col("text"))).where("chunk_id <> 'c2'")
    cards2, state2, n2 = models.extract_incrementally(changed, state, cards, facts_model())
    assert n2.first().asDict() == {"processed": 2, "skipped": 1, "failed": 1, "dropped": 1, "cards": 2}
    assert {r.claim for r in cards2.collect()} == {"text 0", "new"}
    assert models.extract_incrementally(changed, state2, cards2, facts_model("other"))[2].first().processed == 3  # another model


def test_fingerprints_differ(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "c"), (" ", "c"), ("", "c")], "x string, y string")
    assert len({r.f for r in df.select(E.fingerprint("m", "x", "y").alias("f")).collect()}) == 5


def replies(answer):
    class Here:
        version = "r"

        def generate(self, prompts):
            return [answer] * len(prompts)

    return Here()


def test_requirements_plans_profiles(spark):
    p = spark.createDataFrame([("j", "posting")], "id string, prompt string")
    r = models.extracted_requirements(p, replies('```json\n{"role_title":"Dev","company":null,"requirements":[{"text":"5+ years of Go","category":"required","importance":"unknown","skills":["Go","GO"],"years_experience":"5+"},{"text":" ","category":"other"},]}\n```')).collect()
    assert [(x.category, x.importance, x.skills, x.years_experience, x.search_query) for x in r] == [("experience", "required", ["Go"], 5.0, "5+ years of Go. Skills: Go")]
    with pytest.raises(Exception, match="no requirements in j"):
        models.extracted_requirements(p, replies("no")).collect()
    plan = models.parsed_plans(p, replies('{"summary_focus":"f","skills_to_emphasize":["Go"],"bullets":[{"section":"summary","entry_id":null,"objective":"o","evidence_ids":["e"],"requirement_ids":[]}]}')).collect()
    assert [(x.bullet_pos, x.section, x.skills) for x in plan] == [(0, "summary", ["Go"])]
    d = models.profile_drafts(spark.createDataFrame([("s", "t")], "source_file string, prompt string"), replies('{"experience":[{"company":"A","title":"B"},{"company":" ","title":"B"}],"skills":["x"]}')).first().draft
    assert len(d.experience) == 1 and d.projects == [] and d.skills == ["x"]


def test_merge_precedence(spark):
    ddl = "name string, pos int, source_file string, canonical boolean, date string, technologies array<string>"
    rows = [("P", 1, "u1", False, "u-first", ["A"]), ("P", 2, "c1", True, "c-first", ["B", "A"]), ("P", 3, "c1", True, "c-last", None), ("P", 4, "u2", False, "u-last", ["C"]), ("Q", 1, "u1", False, "first", None), ("Q", 2, "u2", False, "last", [])]
    out = {r.name: r for r in E.merged_entries(spark.createDataFrame(rows, ddl), ["name"], "pos", "canonical", "technologies").collect()}
    assert (out["P"].date, out["P"].first_pos, out["P"].technologies, out["P"].source_files) == ("c-last", 1, ["A", "B", "C"], ["u1", "c1", "u2"])
    assert (out["Q"].date, out["Q"].technologies) == ("first", [])


def test_search_and_results(spark):
    cards = spark.createDataFrame([(*card("e1", "red fox jumps", "a", "project")[:8], "c"), (*card("e2", "blue whale", "a", "project")[:8], "c")], CARD.replace("priority int", "source_chunk_id string"))
    assert [r.doc_id for r in search.search(cards, "red fox", 1).collect()] == ["e1"] and search.search(cards, " ").count() == 0
    m = search.match(search.indexed(cards), spark.createDataFrame([("q", "whale"), ("n", None)], "query_id string, text string"))
    got = search.results(m, cards).where("query_id = 'q'").orderBy(F.desc("retrieval.rerank_score")).first()
    assert got.evidence_id == "e2" and got.retrieval.bm25_rank == 1 and got.claim == "blue whale"


def test_labels_and_years(spark):
    df = spark.createDataFrame([("foo-bar_node.js o'neil",), ("éa1b",), ("",)], "e string")
    assert [r.s for r in df.select(T.source_label(F.col("e"), F.lit("x/my_file.v2.md")).alias("s")).collect()] == ["Foo Bar Node.Js O'Neil", "Éa1B", "My File.V2"]
    y = spark.createDataFrame([("2-3",), ("true",), ("five",), (None,), ("N/A",)], "t string")
    assert [r.p for r in y.select(T.years_problem(F.col("t")).alias("p")).collect()] == [None, "a truth value", "no number", None, None]


def test_documents_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "x string, y int")
    sinks.write_document(df, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"x": "a", "y": None}
    with pytest.raises(ValueError):
        sinks.write_document(df.union(df), str(tmp_path / "e.json"))
    assert sinks.compile_pdf(str(tmp_path / "x.tex"), "no-such-compiler") is None


def test_evidence_map(spark):
    cards = spark.createDataFrame([card("e1", "c1", "a", "project"), card("e2", "c2", "a", "project")], CARD)
    req = spark.createDataFrame([(f"r{k}", "t", "required") for k in range(4)] + [(None, "t", "x")], "requirement_id string, text string, importance string")
    cand = spark.createDataFrame([("r0", "e1", 1), ("r0", "e2", 2), ("r1", "e1", 1), ("r2", "gone", 1)], "requirement_id string, evidence_id string, place int")
    out = {r.requirement_id: (r.match_strength, r.evidence_ids) for r in resume.evidence_map(req, cand, cards, replies('{"match_strength":"Strong","evidence_ids":["e2","zz","e1"],"reason":"ok"}')).collect()}
    assert out == {"r0": ("strong", ["e2", "e1"]), "r1": ("strong", ["e1"]), "r2": ("none", []), "r3": ("none", [])}
    assert {r.match_strength for r in resume.evidence_map(req, cand, cards, replies("no idea")).collect()} == {"none"}


def test_profile_and_document(spark):
    ddl = f"pos int, source_file string, entity_id string, entity_type string, metadata {schemas.METADATA}"
    meta = lambda **k: {f.name: k.get(f.name) for f in spark.createDataFrame([], ddl).schema["metadata"].dataType.fields}
    docs = spark.createDataFrame([(1, "e.md", "exp_a", "experience", meta(company="A", title="Dev", start_date="2020-01")), (2, "e.md", "exp_b", "experience", meta(company=" a ", title="DEV", start_date="2020-01", location="X")), (3, "p.md", "proj_t", "project", meta(name="T", technologies=["Go"]))], ddl)
    drafts = models.profile_drafts(spark.createDataFrame([("cv.pdf", "t")], "source_file string, prompt string"), replies('{"experience":[{"company":"A","title":"dev","start_date":"2020-01"},{"company":"New","title":"Boss"}],"projects":[{"name":"t","technologies":["Zig","Go"]}]}'))
    exp = resume.profile_entries(docs, "experience", drafts).orderBy("pos").collect()
    assert [(r.entry_id[:5], r.company, r.location, r.source_files) for r in exp] == [("exp_b", " a ", "X", ["e.md", "cv.pdf"]), (exp[1].entry_id[:5], "New", None, ["cv.pdf"])]
    proj = resume.profile_entries(docs, "project", drafts)
    assert [(r.entry_id, r.technologies) for r in proj.collect()] == [("proj_t", ["Go", "Zig"])]
    assert resume.profile_entries(docs, "certification").count() == 0
    c = claims(3, 8)
    cards = spark.createDataFrame([card("e1", c[0], "exp_b", "experience"), card("e2", c[1], "proj_t", "project"), card("e3", c[2], "other", "project")], CARD)
    both = resume.profile_entries(docs, "experience").select(F.lit("o").alias("owner"), "*").unionByName(proj.select(F.lit("o").alias("owner"), "*"), allowMissingColumns=True)
    none = spark.createDataFrame([], "bullet_id string, section string, entry_id string, text string, evidence_ids array<string>")
    out = resume.composed(both, none, cards, spark.createDataFrame([("r", "strong", ["e1"])], "requirement_id string, match_strength string, evidence_ids array<string>"), spark.createDataFrame([("o", "needs Zig")], "owner string, text string"), spark.createDataFrame([("o", 0, "Ada")], "owner string, pos int, skill string"), spark.createDataFrame([("o", 0, c[0]), ("p", 0, "x")], "owner string, pos int, text string"), ClaimWriter(), WordChecker()).first()
    assert [b.text for e in out.experience for b in e.bullets] == [c[0]] and [e.name for e in out.projects] == ["T"] and out.skills == ["Zig", "Ada", "Go"] and out.summary is None
