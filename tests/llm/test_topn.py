import math
import random

import pytest

from quillspark.llm import topn

DDL = "g string, i string, s double, state string, n int"


def brute(rows, n):
    best = {}
    for g, i, s, *_ in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -math.inf), s)
    out = {}
    for (g, i), s in best.items():
        out.setdefault(g, []).append((-s, i))
    return {(g, i, k) for g, v in out.items() for k, (_, i) in enumerate(sorted(v)[:n], 1)}


def run(spark, rows, n):
    out = topn.top_n_per_group(spark.createDataFrame(rows, DDL), "g", "i", "s", n).collect()
    return {(r.g, r.i, r["rank"]) for r in out}


def rows_of(seed):
    r = random.Random(seed)
    rows = [(f"g{min(int(r.expovariate(0.4)), 6)}", f"id{r.randint(0, 400):03d}" + "x" * r.randint(0, 9), r.choice([0.0, -0.0, 1.5, 1.5, r.random(), r.uniform(-1e9, 1e9)]), "x", 1) for _ in range(1500)]
    rows += [("inf", f"k{j}", s, "x", 1) for j, s in enumerate([math.inf, -math.inf, math.inf, 1e308, -1e308, 5e-324, 0.0, math.nan])]
    rows += [("tie", f"same-long-prefix-{j:02d}", 2.0, "x", 1) for j in range(40)] + [("two", "a", 1.0, None, None), ("two", "a", 3.0, None, None), ("two", "a\0", 3.0, None, None)]
    return rows + [(None, "a", 1.0, None, None), ("n", None, 1.0, None, None), ("n", "a", None, None, None)] + rows[:50]


@pytest.mark.parametrize("n", [1, 5])
def test_equals_brute_force(spark, n):
    rows = rows_of(n)
    assert run(spark, rows, n) == brute(rows, n)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(topn, "HOT_PART", 20)
    rows = rows_of(9)
    assert run(spark, rows, 3) == brute(rows, 3)


def test_empty(spark):
    assert run(spark, [], 5) == set() and run(spark, [(None, None, None, None, None)], 5) == set()
    with pytest.raises(ValueError):
        run(spark, [], 0)
