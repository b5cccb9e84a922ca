import random
import re

import pytest

from quillspark.llm import neardup as N

DDL = "kind int, id string, text string, class_id string"


def brute(rows, t):
    sets = {(k, i, frozenset(re.findall("[a-z0-9]+", x.lower()))) for k, i, x, *_ in rows if k is not None and i is not None and x is not None}
    sets = [s for s in sets if s[2]]
    return {(min(i, j), max(i, j)) for k, i, a in sets for m, j, b in sets if k == m and i != j and len(a & b) >= t * len(a | b)}


def rows_of(seed, n=220):
    r = random.Random(seed)
    vocabulary = [f"w{j}" for j in range(40)] + [f"rare{j}" for j in range(400)]
    rows = []
    for c in range(n):
        base = [r.choice(vocabulary[:40]) if r.random() < 0.6 else r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 5, 8, 14, 26, 40, 95, 130]))]
        for copy in range(r.choice([1, 1, 2, 4])):
            words = list(base)
            for _ in range(r.randint(0, 1 + len(words) // 10)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            r.shuffle(words)
            rows.append((c % 2, f"{'ab'[c % 2]}{c:03d}{copy}", " ".join(words).upper() if copy else ", ".join(words), "x"))
    return rows + rows[:20] + [(0, "null", None, "x"), (0, None, "w1 w2", "x"), (None, "k", "w1", "x"), (0, "blank", " \n", "x"), (0, "sign", "é — ☆", "x"), (1, "long", " ".join(f"q{j}" for j in range(5000)), "x"), (1, "long2", " ".join(f"q{j}" for j in range(300, 5200)), "x")]


def run(spark, rows, t=0.75):
    members, links = N.similar_classes(spark.createDataFrame(rows, DDL), t)
    return {(r.id_a, r.id_b) for r in N.pairs_of(members, links).collect()}, members, links


@pytest.mark.parametrize("t", [0.75, 0.8])
def test_no_link_is_lost_or_made_up(spark, t):
    rows = rows_of(int(t * 100))
    assert run(spark, rows, t)[0] == brute(rows, t)


def test_every_path(spark, monkeypatch):
    for name, value in (("CUT_ABOVE", 3), ("FILE_ROWS", 5), ("BLOCK", 50), ("BROADCAST_IDS", 0), ("COPIES", 2), ("LONG", 30)):
        monkeypatch.setattr(N, name, value)
    rows = rows_of(5) + [(0, f"copy{j}", "alpha beta gamma delta", "x") for j in range(9)]
    pairs, members, links = run(spark, rows)
    assert pairs == brute(rows, 0.75)
    out = {r.id: r for r in N.classes_with_links(members, links).collect()}
    assert out["copy0"].copies == 9 and out["copy3"].first_id == "copy0" and "blank" not in out and "null" not in out


def table_of(sets):
    import numpy as np

    n = np.array([len(x) for x in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    fine = N.pivot_rows(flat, row, len(sets))
    long = n > N.SHORT
    return (N._unsigned(N.coarse_rows(fine)), N._unsigned(fine[long]), np.where(long, np.cumsum(long) - 1, -1), N.prints_of(flat, row, len(sets))), n


def test_eight_differences_at_once():
    import numpy as np

    rng = np.random.default_rng(2)
    x, y = rng.integers(-127, 128, (2, 1000, 8)).astype(np.int8)
    want = np.abs(x.astype(int) - y).sum(1)
    assert (N._apart(N._unsigned(x)[:, 0], N._unsigned(y)[:, 0]) == want).all()


def test_pivot_rows_never_discard_a_close_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = []
    for n in [3, 4, 7, 12, 30, 63, 64, 65, 66, 100, 300, 2000, 60_000] * 8:
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        out = rng.random(n) < rng.random() / 7
        sets += [base, np.concatenate([base[~out], rng.integers(0, 1 << 63, int(out.sum())).astype(np.uint64)])]
    table, n = table_of(sets)
    near = [k for k in range(0, len(sets), 2) if (c := len(np.intersect1d(sets[k], sets[k + 1]))) >= 0.75 * (n[k] + n[k + 1] - c)]
    i, j = np.array(near), np.array(near) + 1
    assert len(i) > 50 and len(N._close(i, j, table, n, 0.75)[0]) == len(i)


@pytest.mark.parametrize("n", [10, 20, 40, 64, 100, 200, 300, 500])
def test_pivot_rows_discard_unrelated_pairs(n):
    import numpy as np

    rng = np.random.default_rng(n)
    table, sizes = table_of([rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(400)])
    i, j = np.triu_indices(400, 1)
    assert len(N._close(i, j, table, sizes, 0.75)[0]) <= 0.05 * len(i)


def test_large_linked_classes_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 3)
    words = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(0, f"a{j}", words, "x") for j in range(8)] + [(0, f"b{j}", words + " iota", "x") for j in range(7)]
    assert run(spark, rows)[0] == brute(rows, 0.75)


def test_empty(spark):
    assert run(spark, [])[0] == set() and run(spark, [(0, "a", None, None)])[0] == set()
    with pytest.raises(ValueError):
        run(spark, [], 0.3)
