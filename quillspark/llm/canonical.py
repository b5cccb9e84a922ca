"""Mapping free-typed values to a reference list by a prefix-filter set-similarity join."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import Scratch, join_spread

#: Pairs below this Jaccard similarity of their letter pairs are never candidates; where a part has other words beside it that
#: are no known remark, it must come as close as INSIDE.
THRESHOLD, INSIDE = 0.4, 0.5
#: A reference list of at most so many rows is broadcast (under 1 KB a row); a longer one is joined by shuffle.
BROADCAST_REFS = 20_000
#: What it costs, in edits, to leave a word unread, to read a further entry, one that no joint parts from the entry before, and
#: an inexact one across a joint.
UNREAD, FURTHER, UNPARTED, ACROSS = 5.0, 0.75, 1.0, 0.25
#: Beside unknown words an entry must have so many letters: LEAST_EXACT where it stands as it is, LEAST_CLOSE with one edit.
LEAST_EXACT, LEAST_CLOSE = 3, 6

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("авеёкмнорстухіјѕԁԛԝьгпαβεηικμνορτυχϲıøßłđ", "abeekmhopctyxijsdqwbrnabenikuvoptuxciosld")
# Words that state a level, a proof or an amount; they may be left unread at no cost (others at UNREAD).
LEVELS = (
    "advanced", "basic", "beginner", "certificate", "certified", "daily", "excellent", "experience", "experienced", "expert", "familiar", "fluent",
    "good", "in", "intermediate", "junior", "knowledge", "level", "of", "professional", "proficient", "senior", "skilled", "skills", "solid", "some",
    "strong", "with", "working", "year", "years", "yr", "yrs", "y", "month", "months", "mo", "mos",
)

_FREE = frozenset(LEVELS)
_AMOUNT = regex.compile(r"\d+\w{0,6}")
_BRACKETS = regex.compile(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}")
_JOINT = regex.compile(r"[&/;,|]|(?<!\bc|\bc\+)\++|(?<=\bc)\+(?!\+)|(?<=\bc\+\+)\++|(?<!\S)(?:and|und|or|y|et)(?!\S)")
_MARK = "\ue000"
_ALPHABET = {c: k for k, c in enumerate("^$abcdefghijklmnopqrstuvwxyz0123456789+#?")}
SIDE = len(_ALPHABET)


def fold(text: str, keep: str = "") -> str:
    """Lower-case words of letters and digits: compatibility forms, accents and look-alikes undone, C++ and C# kept."""
    s = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).translate(LOOKALIKES)
    s = regex.sub(r"(?<=\w)[.'’](?=\w)", "", s)
    s = regex.sub(r"(?<![\w+#])[#]+|(?<!\bc)[+]+|(?<!\b[a-z])#+", " ", s)
    return " ".join(regex.sub(rf"[^\p{{L}}\p{{N}}+#{keep}]+", " ", s).split())


def grams(folded: str) -> list[int]:
    """The distinct pairs of neighbouring letters of each word, in either order, its ends marked, as numbers below SIDE ** 2."""
    out = set()
    other = _ALPHABET["?"]
    for word in folded.split():
        codes = [0, *(_ALPHABET.get(c, other) for c in word), 1]
        out.update(min(a, b) * SIDE + max(a, b) for a, b in zip(codes, codes[1:], strict=False))
    return sorted(out)


def worded(value: str) -> list[list[str]]:
    """The value's folded words with a mark for each joint: without what stands in brackets, and if that differs, whole."""
    low = unicodedata.normalize("NFKC", value).lower()
    bare, outer = None, low
    while bare != outer:
        bare, outer = outer, _BRACKETS.sub(" ", outer)
    return [w for text in dict.fromkeys((bare, low)) if (w := fold(_JOINT.sub(f" {_MARK} ", text), _MARK).split())]


def _unread(word: str) -> float:
    return 0.0 if word == _MARK or word in _FREE or _AMOUNT.fullmatch(word) else UNREAD


def parts_of(value: str, most_words: int, longest: int, known: frozenset[str] = frozenset()) -> list[tuple[int, int, int, bool, str]]:
    """(version, from, to, alone, part): every run of at most ``most_words`` words, joints left out, of each version of the value.

    ``alone``: what stands beside it, up to the next joint or in the whole value, states a level or an amount. All words
    together are a part of any number of words; parts of more letters than ``longest`` are left out, as the length filter
    would discard them. Where all words but free ones are a ``known`` entry, that is the only part.
    """
    out = []
    for v, words in enumerate(worded(value)):
        n = len(words)
        taken = [k for k in range(n) if words[k] != _MARK]
        before = [0] * (n + 1)  # words that count, before each place
        piece = [0] * (n + 1)  # where the piece starts and ends that a place is in
        for k, w in enumerate(words):
            before[k + 1] = before[k] + (_unread(w) > 0)
            piece[k + 1] = k + 1 if w == _MARK else piece[k]
        stop = [n] * (n + 1)
        for k in range(n - 1, -1, -1):
            stop[k] = k if words[k] == _MARK else stop[k + 1]
        mine = []
        for a in range(len(taken)):
            for b in range(a, len(taken)):
                if b - a >= most_words and (a, b) != (0, len(taken) - 1):
                    if a:
                        break
                    continue
                i, j = taken[a], taken[b] + 1
                part = " ".join(words[k] for k in taken[a : b + 1]) if b - a < most_words or sum(len(words[k]) for k in taken) <= longest else ""
                if not 0 < len(part) <= longest:
                    continue
                start, end = piece[i], stop[j - 1]
                alone = before[n] - before[j] + before[i] == 0 or (start <= i and j <= end and before[i] - before[start] == 0 and before[end] - before[j] == 0)
                mine.append((v, i, j, alone, part))
        whole = [m for m in mine if m[4] in known and before[n] - before[m[2]] + before[m[1]] == 0 and before[m[2]] > before[m[1]]]
        if whole:
            return [*out, max(whole, key=lambda m: m[2] - m[1])]
        out += mine
    return out


def chosen(value: str, found: list[tuple[int, int, int, bool, float, float, int, int, bool]]) -> list[int]:
    """The entries of the cheapest reading, from (version, from, to, alone, cost, unlike, ref_id, letters, given) of its parts.

    A reading takes parts that don't overlap and leaves the other words unread. A part that isn't alone counts only where it
    is a given name as it stands, or with one edit, and has the letters for that. The value without its brackets is read first.
    """
    for v, words in enumerate(worded(value)):
        n = len(words)
        starts: dict[int, list[tuple]] = {}
        for version, i, j, alone, cost, unlike, ref, letters, given in found:
            inside = given and (cost == 0 and letters >= LEAST_EXACT or cost <= 1 and letters >= LEAST_CLOSE)
            if version == v and (alone or inside):
                starts.setdefault(i, []).append((j, cost, unlike, ref, letters))
        if not starts:
            continue
        # State: nothing read yet (0), an entry and no joint since (1), an entry and a joint since (2).
        best: list[dict[int, tuple]] = [{} for _ in range(n + 1)]
        best[0][0] = (0.0, 0, 0.0, ())

        def offer(at: int, state: int, way: tuple) -> None:
            if state not in best[at] or way < best[at][state]:
                best[at][state] = way

        for i in range(n):
            for state, (price, short, unlike, refs) in best[i].items():
                offer(i + 1, 2 if state and words[i] == _MARK else state, (price + _unread(words[i]), short, unlike, refs))
                for j, cost, u, ref, letters in starts.get(i, ()):
                    more = cost + (FURTHER if state else 0) + (UNPARTED if state == 1 else 0) + (ACROSS if cost and _MARK in words[i:j] else 0)
                    offer(j, 1, (price + more, short - letters, unlike + u, (*refs, ref)))
        ways = [w for state, w in best[n].items() if state]
        if ways:
            return sorted(set(min(ways)[3]))
    return [0]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance where swapping neighbours is one edit; most + 1 when it exceeds ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row[j] = d
        if min(row) > most:
            return most + 1
    return row[-1]


def tolerance(letters: int) -> int:
    return 0 if letters <= 3 else 1 if letters <= 5 else 2 if letters <= 11 else 3


def _word_cost(w: str, r: str, most: int) -> float:
    if w == r:
        return 0.0
    if 2 <= len(w) < len(r) and w[0] == r[0] and ((len(w) > 2 and r.startswith(w)) or (not set(w[1:]) & set("aeiou") and _within(w, r))):
        return 0.5
    if 3 <= len(w) <= 0.6 * len(r) and w[0] == r[0] and _within(w, r):
        return 1.0
    return edits(w, r, most)


def _within(w: str, r: str) -> bool:
    it = iter(r)
    return all(c in it for c in w)


def distance(folded: str, ref: str) -> float | None:
    """Edits that lead from the reference entry to the value, in any order of its words; None where they are too many.

    A plural s and a shortened word of an entry of several words cost half an edit.
    """
    a, b = folded.replace(" ", ""), ref.replace(" ", "")
    most = tolerance(len(b))
    if a == b:
        return 0.0
    if len(b) >= 3 and a == b + "s":
        return 0.5
    best: float = edits(a, b, most)
    words, targets = folded.split(), ref.split()
    if 1 < len(targets) == len(words) <= 12:
        total, left = 0.0, list(words)
        for r in sorted(targets, key=len, reverse=True):
            costs = [_word_cost(w, r, most) for w in left]
            k = costs.index(min(costs))
            total += costs[k]
            left.pop(k)
        best = min(best, total + (0.25 if words != targets else 0))
    return best if best <= most else None


def _ordered(ranks: list[int]) -> Column:
    return F.array_sort(F.transform("grams", lambda g: F.element_at(F.lit(ranks), g + 1)))


def _prefix(side: str, least: Column) -> list[Column]:
    n = F.size(f"{side}_set")
    return [F.posexplode(F.slice(f"{side}_set", 1, (n - F.ceil(n * (least - 1e-9)) + 1).cast("int"))).alias(f"{side}_at", "token")]


def similar_entries(parts: DataFrame, refs: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, ref_id, ref, given, jaccard) of all pairs whose letter pairs have at least the part's Jaccard similarity ``least``.

    ``parts``: part string, least double (THRESHOLD or more), grams array<int>; ``refs``: ref_id, ref string, given, grams
    array<int>. Letter pairs are ordered by how rare they are on both sides (there are SIDE ** 2 at most, whatever the data),
    only the rare prefixes are joined, then the length and positional filters apply, and the similarity is counted exactly.
    Parts are spread before they meet a broadcast list; a longer list is joined by shuffle on letter pair and length class,
    in which no pair of lengths within the threshold is lost.
    """
    seen = parts.select(F.explode("grams").alias("g")).unionByName(refs.select(F.explode("grams").alias("g"))).groupBy("g").count()
    order = [r.g for r in seen.orderBy("count", "g").collect()]  # at most SIDE ** 2 rows
    ranks = [0] * (SIDE * SIDE)
    for k, g in enumerate(order):
        ranks[g] = k
    spread = parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    left = spread.select("part", "least", _ordered(ranks).alias("v_set")).select("part", "least", "v_set", *_prefix("v", F.col("least")))
    right = refs.select("ref_id", "ref", "given", _ordered(ranks).alias("r_set")).select("ref_id", "ref", "given", "r_set", *_prefix("r", F.lit(THRESHOLD)))
    right = scratch.write(right, "refs")
    on = ["token"]
    if right.limit(BROADCAST_REFS * 8).count() < BROADCAST_REFS * 8:
        right = F.broadcast(right)
    else:  # the letters' pairs are few: beside the pair, both the part's number of pairs and the entry's place go into the key
        on = ["token", "n", "salt"]
        salts = 16
        lengths = F.sequence(F.ceil(F.size("v_set") * (F.col("least") - 1e-9)).cast("int"), F.floor(F.size("v_set") / (F.col("least") - 1e-9)).cast("int"))
        left = left.withColumn("n", F.explode(lengths)).withColumn("salt", F.expr(f"pmod(hash(part), {salts})"))
        right = right.withColumn("n", F.size("r_set")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    nv, nr = F.size("v_set"), F.size("r_set")
    t = F.col("least") - 1e-9
    possible = F.least("v_at", "r_at") + 1 + F.least(nv - F.col("v_at"), nr - F.col("r_at")) - 1
    both = F.size("both")
    return (
        left.join(right, on)
        .where((nv >= t * nr) & (nr >= t * nv) & (possible >= t / (1 + t) * (nv + nr)))
        .withColumn("both", F.array_intersect("v_set", "r_set"))
        .where((F.element_at("both", 1) == F.col("token")) & (both >= t * (nv + nr - both)))  # once per pair
        .select("part", "ref_id", "ref", "given", (both / (nv + nr - both)).alias("jaccard"))
    )


def map_to_list(values: DataFrame, refs: DataFrame) -> DataFrame:
    """(value, ref_id) for every distinct non-null ``value``: the reference entries it names, or 0 where it names none.

    ``values`` has a string column value; ``refs`` has ref_id int and name string, several names per id allowed. Every
    run of a value's words, up to one more than the longest name has, is a part; all parts go through the set-similarity
    join with the names (those of three words and more also by their initials, where these are no other entry), the
    survivors are compared letter by letter (_word_cost, distance), and the cheapest reading of the value is kept (chosen): any
    number of entries, with the words that belong to none left unread. So remarks of any wording, in any language, change
    nothing where an entry stands as it is or nearly so beside them; where only levels, years and amounts (LEVELS) stand
    beside it, or a joint parts it from the rest, it may be misspelt more, shortened or in another order.

    Null values give no rows, blank ones (value, 0); null or blank names never match; empty tables are fine; repeated
    values count once; other columns are not read. Values of any length are taken whole.
    """
    spark = values.sparkSession
    scratch = Scratch(spark)
    names = refs.where("ref_id is not null and name is not null").select(F.col("ref_id").cast("int").alias("ref_id"), "name").distinct()
    forms = scratch.write(names.mapInArrow(_forms, "ref_id int, ref string, given boolean, grams array<int>").where("ref <> ''").distinct(), "forms")
    given = forms.where("given")
    made = forms.where("not given").join(given.select("ref").distinct(), "ref", "left_anti")
    alone = made.groupBy("ref").agg(F.countDistinct("ref_id").alias("n")).where("n = 1").select("ref")
    entries = scratch.write(given.unionByName(made.join(alone, "ref", "left_semi")), "entries")
    sizes = entries.agg(F.max(F.length("ref")).alias("letters"), F.max(F.size(F.split("ref", " "))).alias("words"), F.count("*").alias("n")).first()
    longest, most_words = int((sizes.letters or 0) / THRESHOLD) + 2, (sizes.words or 0) + 1
    few = (sizes.n or 0) <= BROADCAST_REFS
    known = frozenset(r.ref for r in given.select("ref").distinct().collect()) if few else frozenset()
    shared = spark.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(v, *x) for v in b.column(0).to_pylist() for x in parts_of(v, most_words, longest, shared.value)]
            yield _batch(rows, _READ)

    distinct = scratch.write(values.select(F.col("value").cast("string").alias("value")).where("value is not null").distinct(), "values")
    read_as = scratch.write(distinct.mapInArrow(read, _READ_DDL), "readings")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([grams(p) for p in parts], pa.list_(pa.int32()))], ["part", "least", "grams"])

    least = F.min(F.when(F.col("alone"), THRESHOLD).otherwise(INSIDE)).alias("least")
    parts = scratch.write(read_as.groupBy("part").agg(least).mapInArrow(cut, "part string, least double, grams array<int>"), "parts")
    pairs = similar_entries(parts, entries, scratch).mapInArrow(_measure, "part string, ref_id int, given boolean, letters int, jaccard double, cost double")
    best_part = scratch.write(pairs, "pairs").groupBy("part").agg(F.min(F.struct("cost", (-F.col("jaccard")).alias("unlike"), "ref_id", "letters", "given")).alias("m")).select("part", "m.*")
    best_part = scratch.write(best_part, "best")
    met = join_spread(read_as, best_part, "part")  # one part may stand in a third of all values
    found = met.groupBy("value").agg(F.collect_list(F.struct("version", "i", "j", "alone", "cost", "unlike", "ref_id", "letters", "given")).alias("found"))  # of one value

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(v, r) for v, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in chosen(v, [tuple(m.values()) for m in f])]
            yield _batch(rows, {"value": pa.string(), "ref_id": pa.int32()})

    mapped = scratch.write(found.mapInArrow(choose, "value string, ref_id int"), "mapped")
    return mapped.unionByName(distinct.join(mapped, "value", "left_anti").select("value", F.lit(0).alias("ref_id")))


_READ = {"value": pa.string(), "version": pa.int32(), "i": pa.int32(), "j": pa.int32(), "alone": pa.bool_(), "part": pa.string()}
_READ_DDL = "value string, version int, i int, j int, alone boolean, part string"


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every name folded, and for names of three words and more their initials (not given)."""
    for b in batches:
        rows = []
        for i, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f = fold(name)
            rows.append((i, f, True, grams(f)))
            if len(f.split()) >= 3:
                short = "".join(w[0] for w in f.split())
                rows.append((i, short, False, grams(short)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["ref_id", "ref", "given", "grams"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"part": pa.string(), "ref_id": pa.int32(), "given": pa.bool_(), "letters": pa.int32(), "jaccard": pa.float64(), "cost": pa.float64()}
    for b in batches:
        rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
        yield _batch([(p, i, g, len(r.replace(" ", "")), j, d) for p, i, r, g, j in rows if (d := distance(p, r)) is not None], kinds)


def map_elements(records: DataFrame, key: str, array: str, refs: DataFrame) -> DataFrame:
    """(record_id, pos, value, ref_id) for every element of the array column that is neither null nor blank.

    Elements that equal a name byte for byte are left out, as they need no mapping. Null arrays and null keys give no rows; a
    repeated row counts once. Only the distinct values are matched, so a value that fills a third of all rows costs one.
    """
    items = (
        records.where(F.col(key).isNotNull())
        .select(F.col(key).cast("string").alias("record_id"), F.posexplode(array).alias("pos", "value"))
        .where(r"value is not null and not value rlike '^(?U)\\s*$'")
    )
    names = refs.select(F.col("name").alias("value")).where("value is not null").distinct()
    return items.join(names, "value", "left_anti").select("record_id", "pos", "value")
