import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, packing
from quillspark.llm.tokens import encoder, rank_file, token_counts


def check_packed(out, items, kinds):
    caps = dict(kinds)
    per = collections.defaultdict(list)
    total = collections.Counter()
    for r in out:
        per[r.container_kind, r.container_id].append((r.offset, r.n_tokens))
        total[r.container_kind, r.id] += r.n_tokens
        assert r.n_tokens == caps[r.container_kind] or r.piece == (dict(items)[r.id] - 1) // caps[r.container_kind]
    for (kind, _), slots in per.items():
        at = 0
        for o, n in sorted(slots):
            assert o >= at
            at = o + n
        assert at <= caps[kind]
    for kind, _ in kinds:
        assert {i: total[kind, i] for i, _ in items} == dict(items)
        ids = {c for k, c in per if k == kind}
        assert ids == set(range(len(ids)))
    return per


@pytest.mark.parametrize("together", [200_000, 7])
def test_pack_invariants(spark, monkeypatch, together):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", together)
    r = random.Random(1)
    items = [(i, r.choice([1, 5, 5, 5, 17, 50, 99, 100, 101, 350, r.randint(1, 120)])) for i in range(400)]
    rows = [(i, n, "x") for i, n in items] + [(1, items[1][1], "x"), (900, None, "x"), (901, 0, "x"), (902, -1, "x")]
    kinds = [("small", 100), ("large", 300)]
    out = packing.pack(spark.createDataFrame(rows, "id bigint, n int, kind string"), "id", "n", kinds).collect()
    per = check_packed(out, items, kinds)
    for kind, cap in kinds:
        used = [sum(n for _, n in v) for (k, _), v in per.items() if k == kind]
        assert sum(used) / (cap * len(used)) > 0.97


def test_best_fit_is_what_item_by_item_gives():
    r = random.Random(2)
    for _ in range(30):
        cap = r.randint(5, 60)
        items = sorted((r.randint(1, cap) for _ in range(200)), reverse=True)
        bins = []
        for n in items:
            fits = [b for b in range(len(bins)) if bins[b] >= n]
            b = min(fits, key=lambda b: bins[b], default=None)
            if b is None:
                bins.append(cap)
                b = len(bins) - 1
            bins[b] -= n
        plan = packing.best_fit(collections.Counter(items), cap)
        assert max(first + -(-(r1 - r0) // each) for _, r0, r1, first, each, _ in plan) == len(bins)


def test_pack_edges(spark):
    empty = spark.createDataFrame([], "id bigint, n int")
    assert packing.pack(empty, "id", "n", [("a", 10)]).count() == 0
    assert packing.pack(spark.createDataFrame([(None, 3), (None, 3)], "id bigint, n int"), "id", "n", [("a", 10)]).count() == 1
    with pytest.raises(ValueError):
        packing.pack(empty, "id", "n", [("a", 0)])
    with pytest.raises(ValueError):
        packing.pack(empty, "id", "n", [("a", 1), ("a", 2)])


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (1, "hello world", 0), (2, None, 0), (3, "", 0), (4, "<|endoftext|>", 0)], "id int, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in token_counts(df, ["id"], "text").collect()}
    e = encoder(rank_file())
    assert got == {1: len(e.encode_ordinary("hello world")), 4: len(e.encode_ordinary("<|endoftext|>"))} and got[4] > 1


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        p = mixing.permuted(np.arange(n), n, 5)
        assert sorted(p) == list(range(n))
    assert list(mixing.permuted(np.arange(100), 100, 1)) != list(mixing.permuted(np.arange(100), 100, 2))


def mixture(spark, docs, targets, **kw):
    counts = spark.createDataFrame(docs, "key bigint, source string, n_tokens bigint")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = mixing.mix(counts, t, block=32, **kw)
    return m.collect(), {r.source: r for r in mixing.shares(m, counts, t).collect()}, counts


@pytest.mark.parametrize("together", [200_000, 5])
def test_mixture(spark, monkeypatch, together):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 50)
    monkeypatch.setattr(mixing, "LAID_TOGETHER", together)
    r = random.Random(3)
    docs = [(i, r.choice(["big"] * 20 + ["mid"] * 5 + ["tiny"]), r.randint(1, 90)) for i in range(1500)] + [(9000, None, 5), (9001, "other", 500), (9002, "big", None)]
    targets = [("big", 0.5, 2), ("mid", 0.3, 3), ("tiny", 0.1, 2), ("none", 0.1, 3)]
    rows, shares, _ = mixture(spark, docs, targets)
    have = collections.Counter()
    for _, s, n in docs:
        have[s] += n or 0
    size = dict((k, n) for k, _, n in docs)
    blocks = collections.Counter()
    for x in rows:
        assert 0 <= x.token_from < x.token_to <= size[x.key]
        blocks[x.source, x.block, x.epoch] += x.token_to - x.token_from
    assert max(blocks.values()) <= 32 and len({(x.shard, x.slot) for x in rows}) == len(blocks)
    for s, _, cap in targets[:3]:
        epochs = {e for t, _, e in blocks if t == s}
        assert max(epochs) < cap
        n = -(-have[s] // 32)
        for e in epochs:
            assert e == max(epochs) or len({b for t, b, f in blocks if t == s and f == e}) == n
    assert shares["tiny"].short and shares["tiny"].repeats == 2.0 and shares["none"].used == 0
    assert abs(shares["big"].actual_share / shares["mid"].actual_share - 5 / 3) < 0.05
    assert {tuple(x) for x in mixture(spark, docs, targets)[0]} == {tuple(x) for x in rows}
    _, exact, _ = mixture(spark, docs, targets, total=None)
    assert all(abs(exact[s].actual_share - w / 0.9) < 0.05 for s, w, _ in targets[:3])


def test_mixture_edges(spark):
    assert mixture(spark, [], [("a", 1.0, 1)])[0] == [] and mixture(spark, [(1, "a", 5)], [])[0] == []
    rows, shares, _ = mixture(spark, [(1, "a", 5)], [("a", 1.0, 1), (None, 0.1, 1)])
    assert len(rows) == 1 and (rows[0].token_from, rows[0].token_to) == (0, 5)
    with pytest.raises(ValueError):
        mixture(spark, [(1, "a", 5)], [("a", 1.0, 1), ("a", 0.5, 1)])


def test_shards_find_their_own_counts():
    slots = [333, 50, 4, 0, 170]
    parts = [mixing.shard_counts(k, slots, 3, 10) for k in range(56)]
    assert sum(c for c, _ in parts).tolist() == slots and {int(c.sum()) for c, _ in parts[:-1]} == {10}
    done = np.zeros(5, int)
    for c, before in parts:
        assert before.tolist() == done.tolist() and c.min() >= 0
        done = done + c
    parts = [mixing.shard_counts(k, slots, 3, 10, 100)[0] for k in range(56)]  # as with very many shards
    assert sum(parts).tolist() == slots and all(p.min() >= 0 for p in parts)


def test_kinds_of_containers(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i}", i + 1) for i in range(1500)] * 2 + [(None, 3), ("x", None)], "kind string, cap int")
    assert len(packing.kinds_of(df, "kind", "cap")) == 1500
    monkeypatch.setattr(packing, "MOST_KINDS", 10)
    with pytest.raises(ValueError):
        packing.kinds_of(df, "kind", "cap")


def test_quotas():
    assert mixing.quotas({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 2)], None) == {"a": 20.0, "b": 20.0}
    assert mixing.quotas({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 2)], 110) == {"b": 20.0, "a": 90.0}
    assert mixing.quotas({}, [("a", 1.0, 1)], 5) == {}
