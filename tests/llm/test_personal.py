import sys
from pathlib import Path

import pytest

from quillspark.llm import examples
from quillspark.llm import personal as P
from quillspark.llm.examples import sentences

sys.path.insert(0, str(Path(__file__).resolve().parent))
import carriers  # noqa: E402


@pytest.fixture(scope="module")
def detector():
    return P.detector()


@pytest.mark.parametrize("kind", P.KINDS)
def test_recall_in_other_sentences(detector, kind):
    """Carriers and items that nothing was trained on: nine of ten are found from start to end, of names (some are words too) eight."""
    cases = [(c.format(x), c.index("{}"), x) for c in carriers.CARRIERS[kind] for x in carriers.ITEMS[kind]]
    found = detector.find_all([t for t, _, _ in cases])
    hit = [(kind, s, s + len(x)) in spans for (_, s, x), spans in zip(cases, found, strict=True)]
    assert sum(hit) / len(hit) >= (0.8 if kind == "name" else 0.9), [t for (t, _, _), h in zip(cases, hit, strict=True) if not h][:20]


def test_clean_sentences_stay(detector):
    found = detector.find_all(carriers.CLEAN)
    assert sum(map(bool, found)) <= len(found) // 10, [(t, f) for t, f in zip(carriers.CLEAN, found, strict=True) if f]


def test_names_without_capitals(detector):
    found = detector.find_all([t for t, _ in carriers.EAST])
    assert [{t[s:e] for k, s, e in f if k == "name"} for (t, _), f in zip(carriers.EAST, found, strict=True)] == [{x} for _, x in carriers.EAST]


def test_carriers_are_apart():
    trained = " ".join([*examples.POSITIVE, *examples.NEGATIVE, *examples.NAME_LEADS, *examples.NAME_TAILS])
    parts = [p.strip() for cs in carriers.CARRIERS.values() for c in cs for p in c.split("{}")]
    assert [p for p in parts if len(p) >= 12 and p in trained] == []


def test_held_out_accuracy(detector):
    data = sentences(800, 99)
    found = {(i, k, s) for i, spans in enumerate(detector.find_all([t for t, _ in data])) for k, s, _ in spans}
    real = {(i, k, s) for i, (_, spans) in enumerate(data) for k, s, _ in spans}
    assert len(found & real) / len(found) > 0.97 and len(found & real) / len(real) > 0.9
    assert all(p > 0.9 and r > 0.9 for k, (p, r) in detector.held_out.items() if "comma" not in k)


CASES = [
    ("Emergency contact Zoé-Marta St. Orrin: +49 30 23125 115 2016-05 to now", {("name", "Zoé-Marta St. Orrin"), ("phone", "+49 30 23125 115")}),
    ("Name: Hazelgarth, Ruth\nEmail: a.b (at) site (dot) example", {("name", "Hazelgarth, Ruth"), ("email", "a.b (at) site (dot) example")}),
    ("Please call (487) 555-0137 after 6 pm; ask for ANNA KELLER.", {("phone", "(487) 555-0137"), ("name", "ANNA KELLER")}),
    ("Payroll lists me under NI number QQ 42 08 23 A since the merger.", {("id_number", "QQ 42 08 23 A")}),
    ("Lives at Flat 5, 169 Gorsegate Crescent, Mirandelle, willing to relocate.", {("address", "Flat 5, 169 Gorsegate Crescent, Mirandelle")}),
    ("Wohnhaft in der Larchbrookstraße 54b, 51493 Ostrelle.", {("address", "Larchbrookstraße 54b, 51493 Ostrelle")}),
    ("Name: Zentora\nTitle: Site Manager\nLocation: Springfield", set()),
    ("Tickets 282-39-43 and OPS-45201 closed. Budget 664 975 EUR, code 988-1-6376-997-X.", set()),
    ("Skills: Data Modelling, Power BI, Load Balancing. Company: Harlow Foods Ltd", set()),
    ("", set()), ("☆", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(detector, text, want):
    assert {(k, text[s:e]) for k, s, e in detector.find_all([text])[0]} == want


def test_tables(spark):
    ddl = "id string, body string, record_id string, kind string"
    long = "Nothing to see here. " * 3000 + "Phone: +49 30 23125 115"
    rows = [("a", "Phone: +49 30 23125 115", "x", "y"), ("a", "Phone: +49 30 23125 115", "x", "y"), ("b", None, None, None), ("c", "", None, None), (None, "Phone: +49 30 23125 115", None, None), ("l", long, None, None), ("p", "plain", None, None)]
    df = spark.createDataFrame(rows, ddl)
    assert {tuple(r)[:3] for r in P.find_personal(df, "id", "body").collect()} == {("a", "phone", 7), ("l", "phone", long.index("+"))}
    red = {r.record_id: r.redacted for r in P.redact(df, "id", "body").collect()}
    assert red == {"a": "Phone: [PHONE]", "l": long[: long.index("+")] + "[PHONE]", "p": "plain"}
    assert P.find_personal(df.where("false"), "id", "body").count() == 0
