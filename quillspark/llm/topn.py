"""Top N items of every group by simultaneous bisection of per-group cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import Scratch

#: Midpoints of this many bisection levels are counted in one pass: 2**LEVELS bins.
LEVELS = 5
#: Passes that cut the score's own range before the cuts move to the bits of the score.
LINEAR_PASSES = 3
#: Up to this many groups (about 100 bytes each) the cutoffs are broadcast.
BROADCAST_GROUPS = 200_000
#: Beyond, only groups with at least 1 / HOT_PART of all rows are: no more than HOT_PART of them can exist.
HOT_PART = 2_000
SLICE = 5


def _bits(s: Column) -> Column:
    """The 64 bits of a double as a signed integer in the order of the doubles."""
    raw = F.expr("cast(reflect('java.lang.Double', 'doubleToLongBits', s) as bigint)")
    return F.when(raw < 0, raw.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(raw)


def _digit() -> Column:
    """Digit number ``lvl`` of the code of (s, i), larger is better; every digit is exact as a double.

    0: the score itself; 1, 2: the upper and lower half of its bits; from 3: five bytes of the identifier and how
    many of the five there are, negated, since smaller identifiers come first.
    """
    at = (F.col("lvl") - 3) * F.lit(2 * SLICE) + 1
    part = F.expr("hex(cast(i as binary))").substr(at, F.lit(2 * SLICE))
    number = F.conv(F.rpad(part, 2 * SLICE, "0"), 16, 10).cast("double") * 8 + F.length(part) / 2
    return (
        F.when(F.col("lvl") == 0, F.col("s"))
        .when(F.col("lvl") == 1, F.shiftright(_bits(F.col("s")), 32).cast("double"))
        .when(F.col("lvl") == 2, _bits(F.col("s")).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"))
        .otherwise(-number)
    )


def _bin() -> Column:
    """The row's bin among the 2**LEVELS parts of [lo, hi], 0 is best; never decreases as the digit falls."""
    n = 2**LEVELS
    return F.when(F.col("hi") <= F.col("lo"), 0).otherwise(
        F.least(F.lit(n - 1), F.floor((F.col("hi") - F.col("x")) / (F.col("hi") - F.col("lo")) * n)).cast("int")
    )


def _cutoffs(binned: DataFrame) -> DataFrame:
    """Per group: the bin in which the count from above reaches ``need``, and what is then open within that bin."""
    counts = binned.groupBy("g", "bin").agg(
        F.first("need").alias("need"), F.first("lvl").alias("lvl"), F.count("*").alias("c"), F.min("x").alias("x0"), F.max("x").alias("x1")
    )
    above = F.sum("c").over(Window.partitionBy("g").orderBy("bin")) - F.col("c")
    return (
        counts.withColumn("above", above)
        .where("above < need and above + c >= need")
        .select("g", F.col("bin").alias("cut"), (F.col("need") - F.col("above")).alias("left"), "c", "x0", "x1")
    )


def _attach(rows: DataFrame, state: DataFrame, groups: int, hot: DataFrame) -> DataFrame:
    """Rows with their group's state. ``hot`` holds the ids of the groups too large for one task."""
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(state), "g")
    few = F.broadcast(hot)
    return rows.join(F.broadcast(state.join(few, "g", "left_semi")), "g").unionByName(
        rows.join(few, "g", "left_anti").join(state.join(few, "g", "left_anti").hint("shuffle_hash"), "g")
    )


def top_n_per_group(df: DataFrame, group: str, ident: str, score: str, n: int) -> DataFrame:
    """Up to ``n`` rows (group, ident, score, rank) of every group: highest score first, ties to the smaller ident.

    Each pass counts, for all groups at once, the rows above the midpoints of the next LEVELS bisection levels of the
    group's open interval (counts are combined before the shuffle, so a group of any size costs a few rows), moves the
    cutoff to the interval where the count reaches n, and settles all rows outside it. The interval ends are the
    smallest and largest digit seen in it, so every pass separates at least two values; ties continue on the
    identifier's bytes. The loop ends when every group holds exactly min(n, its size) rows.

    Rows with a null group, identifier or score or a NaN score are ignored; an identifier counts once per group, with
    its highest score; an empty table gives an empty result; other columns are not read. -0.0 equals 0.0, infinities
    are ordinary scores. Group and ident come out as strings.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    scratch = Scratch(df.sparkSession)
    once = (
        df.select(F.col(group).cast("string").alias("g"), F.col(ident).cast("string").alias("i"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"))
        .where("g is not null and i is not null and s is not null and not isnan(s)")
        .groupBy("g", "i")
        .agg(F.max("s").alias("s"))
    )
    rows = scratch.write(once, "rows")
    sizes = scratch.write(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")), "sizes")
    groups, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = sizes.where(F.col("n") >= max(1.0, total / HOT_PART)).select("g")
    wide = F.expr("abs(lo) = double('infinity') or abs(hi) = double('infinity') or hi - lo = double('infinity')")
    start = sizes.select(
        "g", "n", F.lit(n).cast("long").alias("need"), F.when(F.col("lo") == F.col("hi"), 3).when(wide, 1).otherwise(0).alias("lvl"),
        F.when((F.col("lo") == F.col("hi")) | wide, F.lit(None)).otherwise(F.col("lo")).alias("lo"), F.when((F.col("lo") == F.col("hi")) | wide, F.lit(None)).otherwise(F.col("hi")).alias("hi"),
    )
    # Groups of at most n rows are settled; of the others, those cut on their scores are binned straight away.
    state = scratch.write(start.where(F.col("n") > n).drop("n"), "state")
    binned = _attach(rows, state.where("lvl = 0"), groups, hot).withColumn("x", _digit()).withColumn("bin", _bin())
    cuts = state.where("lvl = 0").join(_cutoffs(binned), "g").unionByName(state.where("lvl > 0"), allowMissingColumns=True)
    small = start.where(F.col("n") <= n).drop("n")
    plan = scratch.write(cuts.unionByName(small.withColumn("cut", F.lit(-1)), allowMissingColumns=True), "plan")
    settled: list[DataFrame] = []
    out = _attach(rows, plan, groups, hot)
    passes = 1
    while True:
        cut_here = F.col("cut").isNotNull() & (F.col("cut") >= 0)
        out = (
            out.withColumn("x", F.when(cut_here, _digit()))
            .withColumn("bin", F.when(cut_here, _bin()))
            .where(~cut_here | (F.col("bin") <= F.col("cut")))
            .withColumn("done", F.when(F.col("cut") == -1, True).when(cut_here, (F.col("bin") < F.col("cut")) | (F.col("left") == F.col("c"))).otherwise(False))
        )
        tied = F.col("x0") == F.col("x1")
        later = F.when(tied, F.when(F.col("lvl") == 0, 3).otherwise(F.col("lvl") + 1)).when((F.col("lvl") == 0) & F.lit(passes >= LINEAR_PASSES), 1).otherwise(F.col("lvl"))
        moved = ~tied & (later == F.col("lvl"))
        out = out.select(
            "g", "i", "s", "done",
            F.when(cut_here, F.col("left")).otherwise(F.col("need")).cast("long").alias("need"),
            F.when(cut_here, later).otherwise(F.col("lvl")).cast("int").alias("lvl"),
            F.when(cut_here & moved, F.col("x0")).when(~cut_here, F.col("lo")).alias("lo"),
            F.when(cut_here & moved, F.col("x1")).when(~cut_here, F.col("hi")).alias("hi"),
        )
        out = scratch.write(out, f"pass{passes}")
        settled.append(out.where("done").select("g", "i", "s"))
        open_rows = out.where(~F.col("done"))
        open_groups = open_rows.select("g").distinct().count()
        if not open_groups:
            break
        # Ends not known yet (a new digit) are looked up; then one more pass of counts.
        x = open_rows.drop("done").withColumn("x", _digit())
        ends = x.groupBy("g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
        state = scratch.write(
            _attach(x, ends, open_groups, hot).select("g", "i", "s", "need", "lvl", "x", F.coalesce("lo", "a").alias("lo"), F.coalesce("hi", "b").alias("hi")),
            f"open{passes}",
        )
        cuts = scratch.write(_cutoffs(state.withColumn("bin", _bin())), f"cuts{passes}")
        out = _attach(state.drop("x"), cuts, open_groups, hot)
        passes += 1
    best = settled[0]
    for more in settled[1:]:
        best = best.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "i"))
    return best.select(F.col("g").alias(group), F.col("i").alias(ident), F.col("s").alias(score), rank.cast("int").alias("rank"))
