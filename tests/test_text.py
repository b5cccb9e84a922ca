import random
import re

from pyspark.sql import functions as F

from quillspark.functions import jsontext as J
from quillspark.functions import text as T


def one(spark, value, f, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(f(F.col("x")).alias("y")).first().y


def test_tokens_keep_inner_marks(spark):
    assert one(spark, "C++ Node.js, a/b-c #x é_1", T.tokens) == ["c++", "node.js", "a/b-c", "x", "1"]
    assert one(spark, "api. API", T.tokens) == ["api.", "api"]
    assert one(spark, None, T.tokens) == []


def test_strip_is_unicode_and_clean_keeps_paragraphs(spark):
    assert one(spark, "\t  x y 　", T.strip) == "x y"
    assert one(spark, " a \r\n\r\n\r\n b c\n", T.clean) == "a\n\nb\nc"
    assert one(spark, "", T.clean) == "" and one(spark, None, T.clean) is None


def test_scalars(spark):
    assert one(spark, "Straße 7 & Co.", T.slug) == "strasse_7_co"
    assert one(spark, "__", T.slug) == "entity" and one(spark, None, T.slug) == "entity"
    assert one(spark, "Exp One", lambda c: T.entity_id("experience", c)) == "exp_one"
    assert one(spark, "One", lambda c: T.entity_id("project", c)) == "proj_one"
    assert one(spark, " N/A ", T.scalar) is None and one(spark, "null", T.scalar) is None and one(spark, " x ", T.scalar) == "x"
    assert one(spark, "- none", T.list_item) is None and one(spark, "* a b", T.list_item) == "a b" and one(spark, "-x", T.list_item) is None
    assert one(spark, "2-3 years", T.years) == 2.0 and one(spark, "at least 4.5", T.years) == 4.5 and one(spark, "five", T.years) is None
    assert one(spark, "2021-03", T.date_label) == "Mar 2021" and one(spark, "2021-13", T.date_label) == "2021-13" and one(spark, "2021", T.date_label) == "2021"
    assert one(spark, " **__*a  b*__** ", T.clean_inline) == "a b" and one(spark, "**", T.clean_inline) == "**"
    assert one(spark, r"50% of A&B\_{x}~^", T.latex) == r"50\% of A\&B\textbackslash{}\_\{x\}\textasciitilde{}\textasciicircum{}"
    assert one(spark, "---\na: 1\n---\nrest", T.without_front_matter) == "rest" and one(spark, "---\nopen", T.without_front_matter) == "---\nopen"
    assert one(spark, " a  b\tc ", T.word_count) == 3 and one(spark, " ", T.word_count) == 0 and one(spark, None, T.word_count) == 0


def test_distinct_and_metrics(spark):
    assert one(spark, [" Git", "GIT", None, " ", "Straße", "STRASSE", "b"], T.distinct_folded, "x array<string>") == ["Git", "Straße", "b"]
    assert one(spark, None, T.distinct_folded, "x array<string>") == []
    m = "x array<struct<name:string,value:string,context:string>>"
    assert [r.name for r in one(spark, [("a", "1", None), ("b", " ", "c"), (None, "2", None)], T.metrics_complete, m)] == ["a"]


def test_json_repair(spark):
    assert one(spark, '{"a":"x,}",}', J.without_trailing_commas) == '{"a":"x,}"}'
    assert one(spark, '{"a":[1,2, ],"b":1,\n}', J.without_trailing_commas) == '{"a":[1,2 ],"b":1\n}'
    assert one(spark, 'Sure:\n```json\n{"a": 1}\n```', J.json_object) == '{"a": 1}'
    assert one(spark, '{"a":1,,}', lambda c: J.parsed(c, "a int")) is None
    assert one(spark, 'x {"a":1,} y', lambda c: J.parsed(c, "a int")).a == 1


def test_enum_repair(spark):
    ddl = "text string, category string, importance string, skills array<string>, years_experience double"
    rows = [("a", "nice_to_have", "unknown", ["x"], None), ("a remote job", "required", "preferred", [], None), ("a", "bogus", "technical", None, None), ("Scrum master", "unknown", "location", [" "], None), ("a", None, None, None, 2.0)]
    out = J.repair_enums(spark.createDataFrame(rows, ddl)).select("category", "importance").collect()
    assert [tuple(r) for r in out] == [("technical", "nice_to_have"), ("location", "preferred"), ("technical", "unknown"), ("education", "unknown"), (None, None)]


def test_similarity_against_sets(spark):
    r = random.Random(3)
    words = "a b c d e f g h".split()
    rows = [(" ".join(r.choices(words, k=r.randint(0, 6))), " ".join(r.choices(words, k=r.randint(0, 6)))) for _ in range(60)]
    out = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.jaccard(T.word_set(F.col("a")), T.word_set(F.col("b"))).alias("s")).collect()
    for x in out:
        a, b = set(re.findall("[a-z0-9]+", x.a)), set(re.findall("[a-z0-9]+", x.b))
        assert abs(x.s - (len(a & b) / len(a | b) if a and b else 0)) < 1e-12
