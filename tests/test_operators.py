import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.operators import chunking, retrieval
from quillspark.operators import evidence as E
from quillspark.operators import markdown as M
from quillspark.operators import render as R
from quillspark.operators import selection as S
from quillspark.operators.scorers import embed, load
from quillspark.plans import index, rounds
from quillspark.sources import files, sinks
from quillspark.streaming.chunks import stream_chunks, write_chunks


# --- chunks against a plain model


def plain_chunks(text):
    def packed(parts, sep, tail):
        out, cur = [], ""
        for p in parts:
            joined = cur + sep + p if cur else p
            if len(joined) <= 500:
                cur = joined
            elif not cur:
                cur = p
            else:
                out.append(cur)
                lead = tail(cur)
                cur = lead + sep + p if lead else p
        return out + [cur] * bool(cur)

    def lead(c):
        if len(c) <= 150:
            return c
        t = c[-150:]
        return (t.split(" ", 1)[1] if " " in t else t).strip()

    paras = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    flat = []
    for p in paras:
        flat += [p] if len(p) <= 500 else packed([s.strip() for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()], " ", lambda c: "")
    merged = []
    for c in packed(flat, "\n\n", lead):
        if merged and len(c) < 200 and len(merged[-1]) + len(c) <= 500:
            merged[-1] += "\n\n" + c
        else:
            merged.append(c)
    return merged


def test_chunks_equal_a_plain_model(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 12)))
    texts = ["", " \n ", "x" * 900, "y" * 500, "z" * 501, ("a " * 100 + "\n\n") * 6]
    for _ in range(60):
        texts.append("".join(word() + r.choice([" "] * 8 + [". ", "! ", "\n\n", " \n \n"]) for _ in range(r.randint(1, 400))))
    df = spark.createDataFrame([(f"d{i}", t, i) for i, t in enumerate(texts)] + [("null", None, -1)], "document_id string, text string, page int")
    got = {}
    for row in chunking.chunk_documents(df).orderBy("document_id", "chunk_index").collect():
        assert row.chunk_id == f"{row.document_id}_chunk_{row.chunk_index:03d}"
        got.setdefault(row.document_id, []).append(row.text)
    for i, t in enumerate(texts):
        assert got.get(f"d{i}", []) == plain_chunks(t), i
    assert "null" not in got


# --- Markdown


EXPERIENCE = """---
x: y
---
lost: line
## Experience
## One Place
Company: First
Company: Second Ltd: x
Title: Engineer
Start Date: 2020-01
### Duties
- did a
### Notes
n1
### Duties
- did b
## exp_two
Title: Only
"""


def lines(spark, name, text):
    return M.numbered_lines(spark.createDataFrame([(f"/a/{name}", text)], "path string, text string"))


def test_experience_blocks(spark):
    rows = M.experience_entities(lines(spark, "experience.md", EXPERIENCE)).orderBy("block").collect()
    assert [(r.entity_id, r.company, r.title, r.start_date, r.problem) for r in rows] == [("exp_one_place", "Second Ltd: x", "Engineer", "2020-01", None), ("exp_two", None, "Only", None, "company")]
    b = M.entity_blocks(lines(spark, "experience.md", EXPERIENCE)).where("block_title = 'One Place'").first()
    assert b.sections["duties"] == ["- did a", "- did b"] and b.text.startswith("Company: First")


def test_projects_and_profile(spark):
    p = M.project_entities(lines(spark, "projects.md", "## Projects\n## Tool\nName: T\nYear: 2021\n### Technologies\n- Go\n- go\n- Go\n- none\n")).first()
    assert (p.entity_id, p.date, p.technologies, p.problem) == ("proj_tool", "2021", ["Go", "go"], None)
    text = "# Me\n## Contact\nName: A B\nEmail: none\nFax: 1\n## Professional Summary\nline one\n\nline two\n## Skills\n- X\n- X\n- Y\n## Education\n### Uni\nDegree: BSc\n- no prize\nAchievements:\n- prize\n### Other\n## Certifications\n- C1\n### Group\n- C2\n## Certifications\n- late\n"
    f = M.profile_sections(lines(spark, "profile.md", text)).first()
    assert f.text == "Professional Summary:\nline one line two\n\nSkills:\n- X\n- Y"
    assert (f.name, f.email, f.summary, f.skills) == ("A B", None, "line one line two", ["X", "Y"])
    e = M.education_entries(lines(spark, "profile.md", text)).orderBy("section").collect()
    assert [(r.institution, r.degree, r.achievements, r.problem) for r in e] == [("Uni", "BSc", ["prize"], None), ("Other", None, [], "degree")]
    assert e[0].text == "Institution: Uni\nDegree: BSc\n\nAchievements:\n- prize"
    c = M.certification_entries(lines(spark, "profile.md", text)).orderBy("pos").collect()
    assert [(r.name, r.entity_id, r.text) for r in c] == [("C1", "cert_c1", "Certification: C1"), ("C2", "cert_c2", "Certification: C2")]
    all_of = M.canonical_entities(lines(spark, "profile.md", text)).orderBy("part", "pos").collect()
    assert [(r.entity_type, r.problem) for r in all_of] == [("profile", None), ("education", None), ("education", "degree"), ("certification", None), ("certification", None)]
    assert all_of[0].metadata.skills == ["X", "Y"] and all_of[1].metadata.achievements == ["prize"]
    assert M.profile_sections(lines(spark, "profile.md", "")).first().skills == []


# --- retrieval


def test_vector_top_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[10] = v[11]
    df = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(v)] + [(99, None)], "doc_id bigint, vector array<float>")
    top = retrieval.vector_top(df, df.where("doc_id < 5").withColumnRenamed("doc_id", "query_id"), 7).collect()
    s = v[:5].astype(float) @ v.astype(float).T
    for q in range(5):
        want = sorted(range(60), key=lambda i: (-round(s[q, i], 9), i))[:7]
        assert [r.doc_id for r in sorted((r for r in top if r.query_id == q), key=lambda r: r.semantic_rank)] == want
    assert retrieval.vector_top(df.where("false"), df.withColumnRenamed("doc_id", "query_id")).count() == 0


def test_bm25_edges(spark):
    docs = spark.createDataFrame([("a", "red red fox"), ("b", "red"), ("c", None), ("d", ""), ("e", "blue")], "doc_id string, text string")
    q = spark.createDataFrame([("q", "red red RED"), ("none", "zzz"), ("empty", "")], "query_id string, text string")
    rows = {(r.query_id, r.doc_id): r for r in retrieval.bm25_top(docs, q).collect()}
    assert set(rows) == {("q", "a"), ("q", "b")} and rows["q", "a"].bm25_score != rows["q", "b"].bm25_score
    assert retrieval.bm25_top(docs.where("false"), q).count() == 0


def test_fusion_ties_and_lists(spark):
    lex = spark.createDataFrame([("q", "a", 2.0, 1), ("q", "b", 1.0, 2)], "query_id string, doc_id string, bm25_score double, bm25_rank int")
    sem = spark.createDataFrame([("q", "c", 0.9, 1), ("q", "b", 0.8, 2)], "query_id string, doc_id string, semantic_score double, semantic_rank int")
    out = retrieval.fuse(lex, sem).orderBy("fusion_rank").collect()
    assert [r.doc_id for r in out] == ["b", "a", "c"] and out[2].bm25_rank is None
    again = retrieval.rerank(retrieval.fuse(lex, sem), lambda df: df.withColumn("rerank_score", F.when(F.col("doc_id") == "c", 1.0))).orderBy("rerank_rank").collect()
    assert [r.doc_id for r in again] == ["c", "b", "a"]


def test_scorers(spark):
    v = spark.createDataFrame([("red fox jumps",), ("",), (None,)], "t string").select(embed(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-5 and not any(v[1].v)
    with pytest.raises(KeyError):
        load("nothing")


# --- cards, cache, selection


def test_cache_states(spark):
    ch = spark.createDataFrame([("same", "f"), ("changed", "f"), ("new", "f"), ("damaged", "f"), ("nofacts", "f")], "chunk_id string, fingerprint string")
    st = spark.createDataFrame([("same", "f", ["e1"]), ("changed", "g", []), ("damaged", "f", ["x"]), ("nofacts", "f", []), ("gone", "f", [])], "chunk_id string, fingerprint string, evidence_ids array<string>")
    cards = spark.createDataFrame([("e1", "same")], "evidence_id string, source_chunk_id string")
    assert dict(map(tuple, E.cache_diff(ch, st, cards).collect())) == {"same": "reuse", "changed": "changed", "new": "new", "damaged": "damaged", "nofacts": "reuse"}
    assert [r.chunk_id for r in E.vanished(ch, st).collect()] == ["gone"]


def test_cards_from_facts(spark):
    ddl = "chunk_id string, document_id string, source_file string, source_type string, page int, entity_id string, entity_type string, facts array<struct<claim:string,category:string,skills:array<string>,metrics:array<struct<name:string,value:string,context:string>>>>"
    out = E.cards_from_facts(spark.createDataFrame([("c", "d", "f", "txt", None, "e", "project", [(" Did it ", "other", ["A", "a"], [("n", "", "")]), ("did it", "other", None, None)])], ddl)).collect()
    assert len({r.evidence_id for r in out}) == 1 and out[0].claim == "Did it" and out[0].skills == ["A"] and out[0].metrics == []


def test_greedy_first_equals_a_loop(spark):
    r = random.Random(2)
    rows = [(f"g{i % 6}", f"{i:03d}", " ".join(r.choices("abcdefg", k=r.randint(0, 8)))) for i in range(90)] + [(None, "x", "a"), ("g0", None, "a"), ("g0", "x", None)]
    want = set()
    for g in {x[0] for x in rows} - {None}:
        kept = []
        for _, i, t in sorted(x for x in rows if x[0] == g and None not in x):
            a = set(t.split())
            if len(kept) < 3 and not any(a and b and len(a & b) / len(a | b) >= 0.72 for b in (set(k[1].split()) for k in kept)):
                kept.append((i, t))
        want |= {(g, n, i) for n, (i, _) in enumerate(kept, 1)}
    out = E.greedy_first(spark.createDataFrame(rows, "g string, i string, t string"), "g", "i", "t").collect()
    assert {(x.g, x.place, x.i) for x in out} == want


def test_merged_entries(spark):
    rows = [("A", "x", "1", "f1", "old"), ("A", "x", "3", "f1", "new"), ("A", "x", "2", "f2", "mid"), ("B", "y", "4", None, None)]
    out = {r.company: r for r in E.merged_entries(spark.createDataFrame(rows, "company string, title string, pos string, source_file string, location string"), ["company", "title"], "pos").collect()}
    assert (out["A"].location, out["A"].first_pos, out["A"].source_files) == ("new", "1", ["f1", "f2"]) and out["B"].location is None


def test_system_messages(spark):
    m = spark.createDataFrame([(1, 0, "system", "s1"), (1, 1, "user", "u"), (1, 2, "system", "s2"), (2, 0, "assistant", "a"), (2, 1, "system", "s"), (3, 0, "system", "only")], "conv_id int, turn int, role string, text string")
    out = sorted((r.conv_id, r.turn, r.role, r.text) for r in E.with_system_first(m).collect())
    assert out == [(1, 1, "user", "s1 s2\n\nu"), (2, -1, "user", "s"), (2, 0, "assistant", "a"), (3, -1, "user", "only")]


def test_plan_selection_keeps_quota_and_claims(spark):
    ddl = "evidence_id string, claim string, category string, skills array<string>, metrics array<string>, entity_id string, entity_type string, source_file string, priority int, plan string"
    rows = [(f"m{i:02d}", f"claim {i}", "other", [], [], "x", "profile", "f", 100, "p") for i in range(26)]
    rows += [(f"e{i}", f"work {i}", "other", [], [], "exp", "experience", "f", 0, "p") for i in range(5)] + [("dup", "WORK 0", "other", [], [], "exp", "experience", "f", 0, "p"), ("blank", " ", "other", [], [], "exp", "experience", "f", 100, "p")]
    out = S.plan_selection(spark.createDataFrame(rows, ddl), "plan").orderBy("pick").collect()
    assert len(out) == 28 and [r.phase for r in out] == [0] * 26 + [1, 1] and "blank" not in {r.evidence_id for r in out}


def test_best_skills_whole_words(spark):
    s = spark.createDataFrame([("o", 1, "Go"), ("o", 2, "C++"), ("o", 3, "java"), ("o", 4, "a:b"), ("o", 5, "GO")], "owner string, pos int, skill string")
    j = spark.createDataFrame([("o", "Good Java, C++ needed")], "owner string, text string")
    assert [(r.skill, r.score) for r in S.best_skills(s, j).orderBy("place").collect()] == [("C++", 6), ("java", 6), ("Go", 0)]
    assert S.best_skills(s, j.where("false")).count() == 3


def test_fit_trims_in_order(spark):
    lay = R.Layout(["s"], list("abcdefghij"), [["e1", "e2"]], [["p1", "p2"], ["q1", "q2", "q3"]])
    sizes = []

    def measure(x, density):
        n = len(x.summary) + len(x.skills) + sum(map(len, x.experience + x.projects))
        sizes.append(n)
        return (1 if n <= 13 else 2), 0.9

    assert R.fit(lay, measure) == ("normal", 1, [])
    assert lay.projects == [["p1"], ["q1"]] and lay.experience == [["e1"]] and not lay.summary


# --- sources, sinks, stream


def test_corpus_round_trip(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "experience.md").write_text(EXPERIENCE.replace("Title: Only", "Title: Only\nCompany: Late"))
    (tmp_path / "broken.pdf").write_bytes(b"\xff\xff")
    (tmp_path / "note.TXT").write_bytes(b"ok \xff\r\n\r\n\r\nmore ")
    (tmp_path / "empty.md").write_text(" \n")
    (tmp_path / "x.PDF").write_bytes(b"p1|p2| ")
    (tmp_path / "skip.csv").write_text("a,b")
    docs = files.parse_corpus(spark, str(tmp_path), lambda b: b.decode().split("|"))
    rows = {r.document_id: r for r in docs.collect()}
    assert set(rows) == {"exp_one_place", "exp_two", "note", "x_page_1", "x_page_2"}
    assert rows["note"].text == "ok\n\nmore" and rows["x_page_2"].page == 2 and rows["exp_two"].metadata.company == "Late"
    (tmp_path / "sub" / "experience.md").write_text(EXPERIENCE)
    with pytest.raises(Exception, match="has no company"):
        files.parse_corpus(spark, str(tmp_path)).collect()
    assert files.job_text(spark, str(tmp_path / "skip.csv")).first().text == "a,b"


def test_records_and_state(spark, tmp_path):
    p = str(tmp_path / "r")
    df = spark.createDataFrame([("c1", "f", ["e"])], schemas.RECORDS["state"])
    sinks.write_atomic(df.withColumn("version", F.lit(3)), p)
    sinks.write_atomic(df.withColumn("version", F.lit(3)), p)
    assert files.read_state(spark, p).count() == 1 and files.read_state(spark, p, 4).count() == 0 and files.read_state(spark, str(tmp_path / "no")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_records(spark, str(tmp_path / "no"), "chunk")
    assert files.read_records(spark, str(tmp_path / "no"), "chunk", missing_ok=True).count() == 0
    sinks.write_text(spark, "é", str(tmp_path / "t.txt"))
    assert (tmp_path / "t.txt").read_text() == "é"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "f", "txt", "word. " * 150, None, None, None) for i in range(6)], "document_id string, source_file string, source_type string, text string, page int, entity_id string, entity_type string")
    docs.repartition(3).write.json(str(tmp_path / "in"))
    write_chunks(stream_chunks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == chunking.chunk_documents(docs).count()


def test_index_is_used_only_for_its_rows(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    p = str(tmp_path / "i")
    assert index.load(spark, docs, p, "m") is None
    index.build(docs, p, "m", embed)
    assert index.load(spark, docs, p, "m").count() == 2 and index.load(spark, docs, p, "n") is None
    assert index.load(spark, docs.where("doc_id = 'a'"), p, "m") is None


def test_rounds(spark):
    class Stub:  # here, so that it travels by value
        version = "1"

        def generate(self, prompts):
            return ["bad" if p.count("can't") < int(p[0]) else "good" for p in prompts]

    df = spark.createDataFrame([(str(i), f"{i} prompt") for i in range(5)], "id string, prompt string")
    out = {r.id: (r.round, r.response) for r in rounds.generate_checked(df, Stub(), lambda c: F.when(c == "bad", "bad")).collect()}
    assert out == {"0": (1, "good"), "1": (2, "good"), "2": (3, "good"), "3": (3, "bad"), "4": (3, "bad")}


def test_required_fields(spark):
    df = spark.createDataFrame([([("a", "b"), ("a", " "), (None, "b")],)], "x array<struct<p:string,q:string>>")
    assert len(df.select(E.with_required(F.col("x"), "p", "q").alias("y")).first().y) == 1
