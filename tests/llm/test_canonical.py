import random

import pytest

from quillspark.llm import canonical as C
from quillspark.runtime import Scratch

REFS = [(1, "Python"), (2, "C++"), (2, "cpp"), (3, "C#"), (4, "Risk Assessment"), (5, "A/B Testing"), (6, "Node.js"), (7, "Visual Basic"), (8, "Master Data Management"), (9, "PL/SQL"), (10, "SQL"), (11, "Knowledge Graphs"), (12, "GraphQL"), (13, "Change Management"), (14, "Microsoft Azure"), (15, "Single Sign-On"), (16, "C")]
CASES = {
    "python": {1}, " PYTHON\t": {1}, "Pythоn": {1}, "Ｐｙｔｈｏｎ": {1}, "Pyhton": {1}, "5 years of Python": {1}, "Python (advanced)": {1}, "Python, certified": {1}, "good knowledge of Python": {1}, "c++": {2}, "C#": {3}, "C": {16}, "R": {0},
    "Risk Asmessment": {4}, "Assessment, Risk": {4}, "RiskAssessment": {4}, "Risk Assessments": {4}, "A/B Test.": {5}, "Visual Basic (1+ y.)": {7}, "MDM": {8}, "Python & SQL": {1, 10}, "PL/SQL; C#": {9, 3}, "Python and cooking": {1},
    "Knowledge Graphs 2026": {11}, "Change Mgmt": {13}, "MS Azure": {14}, "singlesign-on": {15}, "cooking": {0}, "Network Marketing": {0}, "???": {0}, " ": {0}, "": {0}, "x" * 30000: {0}, "Python, " * 3000: {1},
    # remarks of any wording, language and length; any number of entries
    "Python guru": {1}, "hands-on Python": {1}, "Python since 2019": {1}, "Kenntnisse in Python": {1}, "ich mag Pyhton sehr": {1}, "mucho Risk Assessment": {4}, "Node.js ninja": {6}, "wrote my thesis about knowledge graphs": {11},
    "Python (" + "x " * 10000 + ")": {1}, "Python " + "and so on " * 3000: {1}, "Skill (Python)": {1}, "Python [[very] good]": {1}, "Python, SQL and Docker": {1, 10}, "Python, SQL and C#": {1, 3, 10}, "C++/C#/Pyhton/node js": {1, 2, 3, 6}, "Python+C++": {1, 2},
    "vitamin C": {0}, "Sea of Change": {0}, "Risk it all": {0},
}


def test_cases(spark):
    values = spark.createDataFrame([(v, "e") for v in [*CASES, None, "python"]], "value string, ref_id string")
    refs = spark.createDataFrame([*REFS, (17, None), (18, " "), (None, "x")], "ref_id int, name string")
    got = {}
    for r in C.map_to_list(values, refs).collect():
        got.setdefault(r.value, set()).add(r.ref_id)
    assert set(got) == set(CASES)
    assert {v: g for v, g in got.items() if CASES[v] is not None and g != CASES[v]} == {}


@pytest.mark.parametrize("broadcast", [C.BROADCAST_REFS, 0])
def test_join_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(C, "BROADCAST_REFS", broadcast)
    r = random.Random(4)
    names = [C.fold(n) for _, n in REFS]
    parts = sorted({"".join(r.sample(list(n), len(n)))[: r.randint(1, 20)].strip() or "x" for n in names * 6} | set(names))
    df = spark.createDataFrame([(p, C.THRESHOLD if k % 2 else C.INSIDE, C.grams(p)) for k, p in enumerate(parts) if p], "part string, least double, grams array<int>")
    refs = spark.createDataFrame([(i, n, True, C.grams(n)) for i, n in enumerate(names)], "ref_id int, ref string, given boolean, grams array<int>")
    got = {(x.part, x.ref_id): x.jaccard for x in C.similar_entries(df, refs, Scratch(spark)).collect()}
    want = {}
    for k, p in enumerate(parts):
        a = set(C.grams(p))
        for i, n in enumerate(names):
            b = set(C.grams(n))
            if a and len(a & b) / len(a | b) >= (C.THRESHOLD if k % 2 else C.INSIDE):
                want[p, i] = len(a & b) / len(a | b)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_elements(spark):
    rec = spark.createDataFrame([("a", ["Python", None, " ", "pyton"]), ("a", ["Python", None, " ", "pyton"]), ("b", None), ("c", []), (None, ["x"])], "id string, skills array<string>")
    refs = spark.createDataFrame(REFS, "ref_id int, name string")
    assert {tuple(r) for r in C.map_elements(rec, "id", "skills", refs).collect()} == {("a", 3, "pyton")}
    assert C.map_to_list(rec.where("false").selectExpr("'' as value"), refs).count() == 0
    assert [tuple(r) for r in C.map_to_list(spark.createDataFrame([("x",)], "value string"), refs.where("false")).collect()] == [("x", 0)]


@pytest.mark.parametrize("a,b,most,want", [("abc", "acb", 2, 1), ("abc", "abc", 0, 0), ("kitten", "sitting", 3, 3), ("a", "abcd", 2, 3), ("", "ab", 2, 2)])
def test_edits(a, b, most, want):
    assert C.edits(a, b, most) == want


def test_found_equals_brute_force(spark, tmp_path):
    """Misspelt names and aliases mean the entry with the fewest edits among all; and only SQL stands as SQL."""
    from quillspark.llm import queries as Q

    assert all(isinstance(sql, str) for sql in Q.ORACLES.values())
    entries = [(1, "Python", ["CPython"]), (2, "Kubernetes", []), (3, "Risk Assessment", ["Hazard Analysis"]), (4, "Visual Basic", []), (5, "Photography", [])]
    names = [(i, n) for i, name, aliases in entries for n in [name, *aliases]]
    r = random.Random(2)
    values = [n[:k] + n[k + 1] + n[k] + n[k + 2 :] for _, n in names for k in r.sample(range(1, len(n) - 2), 3)]
    rows = {"skill_catalog": (entries, "skill_id int, skill_name string, aliases array<string>"), "evidence": ([("e1", values), ("e1", values)], "evidence_id string, skills array<string>"), "requirements": ([("r1", ["Python", None, " ", *values[:4]])], "requirement_id string, skills array<string>")}
    for name, (data, ddl) in rows.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    best = {v: min((C.edits(C.fold(v), C.fold(n), 99), i) for i, n in names)[1] for v in values}
    want = {("e1", k, best[v]) for k, v in enumerate(values)} | {("r1", k + 3, best[v]) for k, v in enumerate(values[:4])}
    got = [tuple(x) for x in Q.p1_found(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
