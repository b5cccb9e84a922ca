"""Filling containers of fixed capacity by planning over the histogram of lengths."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import Scratch

#: Items of one length are ranked in groups of about so many.
RANKED_TOGETHER = 200_000
#: The sum of all capacities, which bounds the histogram and the plan on the driver.
MOST_CAPACITY = 4_000_000
#: Kinds of containers at most; more are an error.
MOST_KINDS = 10_000


def kinds_of(containers: DataFrame, kind: str, capacity: str) -> list[tuple[str, int]]:
    """The kinds of containers and their capacities, each row once; ValueError beyond MOST_KINDS. Rows with a null have no kind."""
    rows = containers.where(F.col(kind).isNotNull() & F.col(capacity).isNotNull()).select(F.col(kind).alias("k"), F.col(capacity).cast("long").alias("c")).distinct().limit(MOST_KINDS + 1).collect()
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    return sorted((r.k, r.c) for r in rows)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """A plan of rows (length, first rank, end rank, first container, items of it in each container, offset in it).

    Lengths run from the longest to the shortest; all items of a length go, count by count, to the fullest open
    containers that still hold one, as many to each as fit, before new ones are opened. Containers with the same room
    are kept as runs (start, number), so the work grows with the number of lengths and not with the number of items.
    """
    plan, room, runs, opened = [], [], {}, 0

    def put(left: int, start: int, number: int) -> None:
        if left and number:
            if left not in runs:
                bisect.insort(room, left)
                runs[left] = []
            runs[left].append((start, number))

    for length in sorted(histogram, reverse=True):
        rank, end = 0, histogram[length]
        while rank < end:
            k = bisect.bisect_left(room, length)
            if k < len(room):
                left = room[k]
                start, number = runs[left].pop()
                if not runs[left]:
                    del runs[left], room[k]
            else:
                left, start = capacity, opened
                number = -(-(end - rank) // (capacity // length))
                opened += number
            each = left // length
            full = min(number, (end - rank) // each)
            if full:
                plan.append((length, rank, rank + full * each, start, each, capacity - left))
                put(left - each * length, start, full)
                rank += full * each
            rest = min(end - rank, each - 1) if full < number else 0
            if rest:
                plan.append((length, rank, rank + rest, start + full, rest, capacity - left))
                put(left - rest * length, start + full, 1)
                rank += rest
            put(left, start + full + bool(rest), number - full - bool(rest))
    return plan


def pack(items: DataFrame, key: str, size: str, containers: list[tuple[str, int]]) -> DataFrame:
    """(container_kind, container_id, offset, key, piece, n_tokens): every item's place in containers of each kind.

    An item longer than a kind's capacity is cut into pieces of the capacity and a rest, numbered by ``piece``; no other
    item is cut. The lengths of all pieces are counted, best_fit plans the counts on the driver (no more lengths
    exist than the capacity), and the pieces take the planned slots by joining on their rank within their length. Ranks
    are made in hash groups of RANKED_TOGETHER, so one length may hold most of the items. ``offset`` is where the piece
    starts in its container; no two pieces of a container overlap.

    Items with a null or non-positive size have no rows; a null key is placed like any other; repeated rows of key
    and size count once; no items, no rows; other columns are not read.
    """
    spark = items.sparkSession
    if any(c < 1 for _, c in containers) or sum(c for _, c in containers) > MOST_CAPACITY:
        raise ValueError(f"capacities must be at least 1 and together at most {MOST_CAPACITY}")
    if len({k for k, _ in containers}) < len(containers):
        raise ValueError("kinds must differ")
    scratch = Scratch(spark)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("cap")) for k, c in containers])
    pieces = (
        items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).where("size > 0").distinct()
        .select("key", "size", F.explode(kinds).alias("k"))
        .select("key", "size", "k.kind", "k.cap", F.explode(F.expr("sequence(0L, (size - 1) div k.cap)")).alias("piece"))
        .select("key", "kind", "piece", F.least("cap", F.col("size") - F.col("piece") * F.col("cap")).alias("n"))
    )
    pieces = scratch.write(pieces, "pieces")
    counts = pieces.groupBy("kind", "n").count().collect()  # at most the sum of the capacities
    plan = []
    for kind, cap in containers:
        plan += [(kind, *row) for row in best_fit({r.n: r["count"] for r in counts if r.kind == kind}, cap)]
    plan_df = spark.createDataFrame(plan or [("", 0, 0, 0, 0, 1, 0)], "kind string, n bigint, r0 bigint, r1 bigint, first bigint, each bigint, used bigint")
    groups = spark.createDataFrame([(r.kind, r.n, -(-r["count"] // RANKED_TOGETHER)) for r in counts] or [("", 0, 1)], "kind string, n bigint, groups bigint")
    grouped = pieces.join(F.broadcast(groups), ["kind", "n"]).withColumn("g", F.expr("pmod(xxhash64(key, piece), groups)"))
    before = grouped.groupBy("kind", "n", "g").count().withColumn("before", F.sum("count").over(Window.partitionBy("kind", "n").orderBy("g")) - F.col("count"))
    within = F.row_number().over(Window.partitionBy("kind", "n", "g").orderBy("key", "piece")) - 1
    ranked = (
        grouped.where("groups = 1").withColumn("rank", within.cast("long"))
        .unionByName(
            grouped.where("groups > 1").withColumn("within", within)
            .join(F.broadcast(scratch.write(before.join(F.broadcast(groups.where("groups > 1")), ["kind", "n"]).select("kind", "n", "g", "before"), "before")), ["kind", "n", "g"])
            .withColumn("rank", F.col("within") + F.col("before")).drop("within", "before")
        )
    )
    nth = F.col("rank") - F.col("r0")
    return (
        ranked.join(F.broadcast(plan_df), ["kind", "n"]).where("rank >= r0 and rank < r1")
        .select(
            F.col("kind").alias("container_kind"), (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("container_id"),
            (F.col("used") + (nth % F.col("each")) * F.col("n")).cast("long").alias("offset"), F.col("key").alias(key), "piece", F.col("n").alias("n_tokens"),
        )
    )
