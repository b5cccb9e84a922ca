"""Mixing sources to target weights in fixed-length token blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import Scratch

#: Tokens in a block, blocks in a shard, and sources at most.
BLOCK_TOKENS = 512
SHARD_BLOCKS = 1024
#: Where more slots are dealt to two halves at once, their counts are split in proportion: a draw would differ by less than one in 10,000.
DRAWN_EXACTLY = 500_000_000
MOST_SOURCES = 10_000
#: Documents of a source are laid out in hash ranges of about so many.
LAID_TOGETHER = 200_000


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places of ``index`` under a pseudorandom permutation of 0 .. n - 1 (a four-round Feistel network, walked)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(xxhash.xxh64_intdigest(f"{seed}/{r}")) for r in range(4)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        with np.errstate(over="ignore"):
            for key in keys:
                f = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def quotas(tokens: dict[str, int], targets: list[tuple[str, float, int]], total: float | None) -> dict[str, float]:
    """Tokens that each source contributes: its share of the total, but no more than max_repeats times what it has.

    total None: the largest total at which every source that has tokens gets its exact share. Otherwise the sources
    whose share exceeds what they may repeat give all of that, and the others fill the total in proportion to their
    targets, as far as they may.
    """
    limit = {s: tokens.get(s, 0) * r for s, _, r in targets}
    share = {s: w for s, w, _ in targets if limit[s] > 0 and w > 0}
    if not share:
        return {}
    if total is None:
        scale = min(limit[s] / w for s, w in share.items())
        return {s: w * scale for s, w in share.items()}
    out: dict[str, float] = {}
    free, left = dict(share), float(total)
    while free:
        scale = left / sum(free.values())
        full = [s for s, w in free.items() if w * scale >= limit[s]]
        if not full:
            return out | {s: w * scale for s, w in free.items()}
        for s in full:
            out[s] = float(limit[s])
            left -= limit[s]
            del free[s]
    return out


def _left_part(counts: np.ndarray, slots: int, key: str, exactly: int) -> np.ndarray:
    """How many of each source's slots fall to the first ``slots`` of all: a multivariate hypergeometric draw that depends on the key alone."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(key))
    total = int(counts.sum())
    if total <= exactly:
        return rng.multivariate_hypergeometric(counts, slots, method="marginals")
    share = [int(c) * slots // total for c in counts]  # exact integers, then the rest by largest remainder
    rest = sorted(range(len(counts)), key=lambda i: (-(int(counts[i]) * slots % total), i))[: slots - sum(share)]
    return np.array([s + (i in set(rest)) for i, s in enumerate(share)], np.int64)


def shard_counts(shard: int, slots: list[int], seed: int, size: int, exactly: int = DRAWN_EXACTLY) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in a shard of ``size`` blocks, slots of each in all shards before): multinomial counts conditioned on the sources' totals.

    The shards are halved again and again, and each half draws its counts from its whole, so that any task finds its own shard's
    counts by itself in as many draws as the number of shards has binary digits.
    """
    total = sum(slots)
    lo, hi = 0, -(-total // size)
    counts, before = np.array(slots, np.int64), np.zeros(len(slots), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _left_part(counts, (mid - lo) * size, f"{seed}/{lo}/{hi}", exactly)
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, before, counts = mid, before + left, counts - left
    return counts, before


def _laid_out(counts: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """(source, key, n_tokens, start): the documents of each source in pseudorandom order, one after another."""
    hashed = counts.withColumn("h", F.xxhash64("key", F.lit(seed)))
    sizes = hashed.groupBy("source").agg(F.count("*").alias("docs"))
    few = F.broadcast(sizes.select("source", F.ceil(F.col("docs") / LAID_TOGETHER).alias("ranges")))
    ranged = hashed.join(few, "source").withColumn("range", F.expr("least(ranges - 1, cast(floor((h / 18446744073709551616.0D + 0.5D) * ranges) as bigint))"))
    sums = scratch.write(ranged.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens")), "ranges")
    offsets = sums.withColumn("before", F.sum("tokens").over(Window.partitionBy("source").orderBy("range")) - F.col("tokens")).drop("tokens")
    within = F.sum("n_tokens").over(Window.partitionBy("source", "range").orderBy("h", "key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    # One offset for each LAID_TOGETHER documents.
    return ranged.withColumn("within", within).join(offsets, ["source", "range"]).select("source", "key", "n_tokens", (F.col("within") + F.col("before")).alias("start"))


def mix(counts: DataFrame, targets: DataFrame, total: float | str | None = "once", seed: int = 7, block: int = BLOCK_TOKENS) -> DataFrame:
    """(shard, slot, source, epoch, block, key, token_from, token_to): which tokens of which document fill each slot.

    ``counts``: key, source string, n_tokens; ``targets``: source, target_share, max_repeats. Each source's documents
    are laid end to end in pseudorandom order and cut into blocks of ``block`` tokens (its last may be shorter). Quotas
    turn shares into numbers of slots; every task draws its shards' multinomial source counts, conditioned on the quotas
    (shard_counts); a source's k-th slot holds block permuted(k mod blocks) of epoch k div blocks, so no block is used again
    before all are, and none more than max_repeats times; slots and blocks are joined by index. The same seed gives
    the same mixture. ``total``: tokens of the mixture; "once": those of all sources with a target; None: see quotas.

    Documents with a null source or size, a source without target, and targets that are null, not positive or without
    documents contribute nothing; several targets of one source are an error; no documents, no rows; repeated rows
    count once.
    """
    spark = counts.sparkSession
    scratch = Scratch(spark)
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").distinct().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES or len({r.source for r in rows}) < len(rows):
        raise ValueError(f"targets must name at most {MOST_SOURCES} sources, each once")
    wanted = [(r.source, float(r.target_share), int(r.max_repeats)) for r in rows]
    names = spark.createDataFrame([(s,) for s, _, _ in wanted] or [("",)], "source string")
    used = scratch.write(counts.select("key", "source", F.col("n_tokens").cast("long")).where("n_tokens > 0").distinct().join(F.broadcast(names), "source"), "counts")
    have = {r.source: r.t for r in used.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # at most MOST_SOURCES
    goal = quotas(have, wanted, sum(have.values()) if total == "once" else total)
    most = {s: r for s, _, r in wanted}
    blocks = {s: -(-have[s] // block) for s in goal}
    slots = {s: min(most[s] * blocks[s], round(goal[s] / (have[s] / blocks[s]))) for s in goal}
    order = sorted(s for s in slots if slots[s] > 0)
    shared = spark.sparkContext.broadcast([(s, slots[s], blocks[s]) for s in order])  # at most MOST_SOURCES
    shard_size = SHARD_BLOCKS
    shards = -(-sum(slots[s] for s in order) // shard_size)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = shared.value
        for b in batches:
            for shard in b.column(0).to_pylist():
                counts, before = shard_counts(shard, [n for _, n, _ in sources], seed, shard_size)
                size, at = int(counts.sum()), 0
                for (source, _, n), c, k0 in zip(sources, counts.tolist(), before.tolist(), strict=True):
                    if not c:
                        continue
                    k = k0 + np.arange(c)
                    epoch, index = k // n, k % n
                    place = np.empty(c, np.int64)
                    for e in np.unique(epoch):
                        m = epoch == e
                        place[m] = permuted(index[m], n, xxhash.xxh64_intdigest(f"{seed}/{source}/{e}"))
                    slot = permuted(at + np.arange(c), size, xxhash.xxh64_intdigest(f"{seed}/{shard}"))
                    at += c
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(c, shard)), pa.array(slot), pa.array([source] * c, pa.string()), pa.array(epoch), pa.array(place)],
                        ["shard", "slot", "source", "epoch", "block"],
                    )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = spark.range(0, shards, 1, max(1, min(shards, 4 * parts))).mapInArrow(fill, "shard bigint, slot bigint, source string, epoch bigint, block bigint")
    laid = _laid_out(used, seed, scratch)
    end = F.col("start") + F.col("n_tokens")
    pieces = laid.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + n_tokens - 1) div {block})"))).select(
        "source", "block", "key",
        (F.greatest(F.col("block") * block, "start") - F.col("start")).alias("token_from"), (F.least((F.col("block") + 1) * block, end) - F.col("start")).alias("token_to"),
    )
    return filled.join(pieces, ["source", "block"]).select("shard", "slot", "source", "epoch", "block", "key", "token_from", "token_to")


def shares(mixture: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: target and actual share of all tokens, tokens used and available, repeats, and whether it fell short."""
    used = mixture.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used"))
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    all_used = F.sum("used").over(Window.partitionBy(F.lit(1)))  # one row a target
    return (
        targets.select("source", "target_share", "max_repeats").distinct().join(used, "source", "left").join(have, "source", "left")
        .withColumns({"used": F.coalesce("used", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
        .withColumn("actual_share", F.col("used") / F.greatest(all_used, F.lit(1)))
        .withColumn("repeats", F.when(F.col("available") > 0, F.col("used") / F.col("available")).otherwise(0.0))
        .withColumn("short", F.col("actual_share") < 0.99 * F.col("target_share"))
        .select("source", "target_share", "actual_share", "used", "available", "repeats", "max_repeats", "short")
    )
