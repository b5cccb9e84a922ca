import random

import pytest

from quillspark.llm.splitting import BLANK, split_oversized, split_text


def check(text, limit, overlap):
    spans = split_text(text, limit, overlap)
    body = text.strip(BLANK)
    if len(body) <= limit:
        assert len(spans) == bool(body)
        return spans
    assert len(spans) > 1 and all(0 < e - s <= limit for s, e in spans)
    assert not text[: spans[0][0]].strip(BLANK) and not text[spans[-1][1] :].strip(BLANK)
    for (s, e), (s2, e2) in zip(spans, spans[1:]):
        assert s2 > s and e2 > e and e - s2 <= overlap and not text[e:s2].strip()
    return spans


def test_invariants():
    r = random.Random(0)
    for _ in range(150):
        text = "".join(r.choice(["word ", "a, ", "End. ", "\n\n", "\t", "日本。", "é", "x" * r.randint(1, 90)]) for _ in range(r.randint(0, 120)))
        check(text, r.choice([40, 100, 500]), r.choice([0, 10, 20]))
    for text in ["z" * 5000, " " * 3000, "👩‍🔬" * 300, "é" * 700, "a" * 499 + " " + "b" * 499, "x" + " " * 900 + "y"]:
        check(text, 500, 150)


def test_cuts_where_it_is_natural():
    text = ("A first sentence stands here. " * 12).strip() + "\n\n" + ("Then a second part follows it. " * 12).strip()
    (_, e), (s, _) = check(text, 400, 0)
    assert text[e : e + 2] == "\n\n" and s == e + 2
    for s, e in check("no dots but many words " * 60, 500, 150):
        assert text is not None and e - s > 200


def test_marks_stay_with_their_letters():
    text = "é" * 600
    for s, e in check(text, 500, 0):
        assert text[s] == "e" and text[e - 1] == "́"


def test_table(spark):
    ddl = "chunk_id string, piece string, text string, entity_id string"
    long = "Some words here. " * 60
    rows = [("a", "p", long, None), ("a", "p", long, None), ("b", None, None, "e"), ("c", None, "", "e"), ("d", None, " " * 900, "e"), ("e", None, " " + "x" * 500 + "\r\n", "e"), (None, None, "y" * 501, None)]
    out = split_oversized(spark.createDataFrame(rows, ddl), ["chunk_id", "entity_id"], "text").collect()
    assert {r.chunk_id for r in out} == {"a", None}
    a = sorted((r for r in out if r.chunk_id == "a"), key=lambda r: r.piece)
    assert [r.piece for r in a] == list(range(a[0].n_pieces)) and all(r.piece_text == long[r.start_pos : r.end_pos] for r in a)
    assert split_oversized(spark.createDataFrame([], ddl), ["chunk_id"], "text").count() == 0
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], ddl), ["chunk_id"], "text", 100, 90)


def test_letters_with_more_marks_than_the_limit():
    for text in ["e" + "\u0301" * 2000, "word " + "\u0301" * 501, "abcdefgh" + "e" + "\u0301" * 495 + "z" * 300]:
        check(text, 500, 150)
        check(text, 500, 0)
    text = "abcdefgh" + "e" + "\u0301" * 495 + "z" * 300
    assert all(text[s] != "\u0301" for s, _ in split_text(text, 500, 0))
