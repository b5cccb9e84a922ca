"""Splitting oversized texts at natural boundaries by dynamic programming over boundary positions."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cost of cutting at a boundary of each kind; a piece off the even size costs up to about SIZE_COST.
PENALTY = {"paragraph": 0.0, "line": 1.0, "sentence": 1.5, "clause": 4.0, "word": 8.0, "inside": 60.0, "cluster": 600.0}
SIZE_COST = 12.0
PIECE_COST = 6.0
#: White space that is trimmed at the ends.
BLANK = " \t\r\n"
#: Spacing of the cut positions inside a run without any boundary.
STEP = 16

_CUTS = regex.compile(r"(?P<paragraph>\n[ \t\r]*\n\s*)|(?P<line>\n\s*)|(?P<sentence>(?<=[.!?…。！？])(?:[\"'”’)»]*)\s+|(?<=[。！？]))|(?P<clause>(?<=[,;:、，；：–—])\s+|(?<=[、，；：]))|(?P<word>\s+)")
_GLUE = regex.compile(r"[\p{M}‍️\U0001F3FB-\U0001F3FF]")


def boundaries(text: str, limit: int) -> list[tuple[int, int, float]]:
    """(end of the piece before, start of the text after, penalty) of every place where the text may be cut.

    The white space of a boundary belongs to neither side. Runs of more than half the limit without a boundary may be
    cut inside, but not between a base character and its combining marks, joiners or modifiers, unless these alone
    exceed the limit.
    """

    def glued(p: int) -> bool:
        return bool(_GLUE.match(text, p)) or text[p - 1] == "\u200d"

    cuts = [(m.start(), m.end(), PENALTY[m.lastgroup]) for m in _CUTS.finditer(text) if 0 < m.start() and m.end() < len(text)]
    merged: list[tuple[int, int, float]] = []
    for c in cuts:
        if merged and c[0] <= merged[-1][1]:  # an empty match directly before white space
            merged[-1] = (merged[-1][0], max(c[1], merged[-1][1]), min(c[2], merged[-1][2]))
        else:
            merged.append(c)
    out: list[tuple[int, int, float]] = []
    before = 0
    for c in [*merged, (len(text), len(text), 0.0)]:
        if c[0] - before > limit // 2:
            places, q = [before], before
            for p in range(before + STEP, c[0], STEP):
                if p <= q:
                    continue
                q = p
                while q < c[0] and glued(q):
                    q += 1
                if q < c[0]:
                    places.append(q)
            for lo, hi in itertools.pairwise([*places, c[0]]):
                if hi - lo > limit:
                    ends = [lo, *(p for p in range(lo + 1, hi) if not glued(p)), hi]
                    for x, y in itertools.pairwise(ends):
                        if y - x > limit:
                            out += [(p, p, PENALTY["cluster"]) for p in range(x + STEP, y, STEP)]
                        if y < hi:
                            out.append((y, y, PENALTY["inside"]))
                if hi < c[0]:
                    out.append((hi, hi, PENALTY["inside"]))
        out.append(c)
        before = c[1]
    return out[:-1]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Code-point spans of the pieces of ``text``, each at most ``limit`` long; see split_oversized."""
    a = len(text) - len(text.lstrip(BLANK))
    b = len(text.rstrip(BLANK))
    if b - a <= limit:
        return [(a, b)] if b > a else []
    body = text[a:b]
    cuts = boundaries(body, limit)
    n = len(body)
    ends = [c[0] for c in cuts] + [n]
    costs = [c[2] for c in cuts] + [0.0]
    at = [c[1] for c in cuts]
    worth = np.array([c[2] + PENALTY["word"] * c[1] / max(1, overlap) for c in cuts])

    def next_start(k: int) -> int:
        """Where the piece after end k starts: the best boundary at most ``overlap`` back that reaches the next end, the earliest of equals."""
        lo, hi = bisect.bisect_left(at, max(ends[k] - overlap, ends[k + 1] - limit)), bisect.bisect_left(at, ends[k])
        return at[lo + int(worth[lo:hi].argmin())] if lo < hi else cuts[k][1]

    # An even size for the number of pieces that is needed at least.
    least = max(1, -(-(n - overlap) // max(1, limit - overlap)))
    even = min(limit, (n + (least - 1) * overlap) / least)
    table = PIECE_COST + SIZE_COST * ((even - np.arange(limit + 1)) / even) ** 2
    cost, follow = np.full(len(ends), np.inf), np.zeros(len(ends), np.int64)
    prev, begin = [-1] * len(ends), [0] * len(ends)
    window = 0  # the earliest end whose follower still reaches the current end
    for k, e in enumerate(ends):
        if e <= limit:
            cost[k] = costs[k] + table[e]
        while window < k and e - follow[window] > limit:
            window += 1
        if window < k:
            sums = cost[window:k] + table[e - follow[window:k]]
            j = int(sums.argmin())
            if sums[j] + costs[k] < cost[k]:
                cost[k], prev[k], begin[k] = sums[j] + costs[k], window + j, int(follow[window + j])
        if k < len(cuts):
            follow[k] = max(next_start(k), follow[k - 1] if k else 0)
    if not np.isfinite(cost[-1]):
        raise AssertionError("every text can be cut")
    spans, k = [], len(ends) - 1
    while k >= 0:
        spans.append((a + begin[k], a + ends[k]))
        k = prev[k]
    return spans[::-1]


def split_oversized(df: DataFrame, key: list[str], text: str, limit: int = 500, overlap: int = 150) -> DataFrame:
    """Pieces of at most ``limit`` characters of every text that is longer without the white space at its ends.

    Result: the ``key`` columns, piece (0-based, in order), n_pieces, start_pos, end_pos (code points in the stored
    text) and piece_text. The pieces cover the text but for white space at cuts; a piece starts up to ``overlap``
    characters before the end of the piece before, at the best boundary there, or after the cut where there is none.
    A dynamic programme over the boundary positions (paragraph, line, sentence, clause, word, then inside a word)
    minimises the sum of cut penalties and squared deviations from an even size. Length is counted in code points.
    A letter stays with its marks, joiners and modifiers unless these alone exceed the limit; then it is cut inside.

    Null, blank and short texts give no rows; repeated rows of the key and text columns count once; an empty table
    gives an empty result; other columns are not read, so their names can't clash. Texts of any length are split
    whole, in time proportional to their length.
    """
    if not 0 <= overlap < limit // 2 + 1:
        raise ValueError("overlap must be at most half the limit")
    ends = r"^[ \t\r\n]+|[ \t\r\n]+$"
    long = (
        df.select(*key, F.col(text).alias("__text"))
        .where((F.length("__text") > limit) & (F.length(F.regexp_replace("__text", ends, "")) > limit))
        .distinct()
    )
    names = [f.name for f in long.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            rows, out = [], []
            for r, t in enumerate(texts):
                spans = split_text(t, limit, overlap)
                for p, (s, e) in enumerate(spans):
                    rows.append(r)
                    out.append((p, len(spans), s, e, t[s:e]))
                if len(out) >= 2000:
                    yield pack(batch, rows, out)
                    rows, out = [], []
            if out:
                yield pack(batch, rows, out)

    def pack(batch: pa.RecordBatch, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
        keys = [c.take(pa.array(rows, pa.int32())) for c in batch.columns[: len(names)]]
        p, n, s, e, t = zip(*out, strict=True)
        arrays = [*keys, *(pa.array(v, pa.int32()) for v in (p, n, s, e)), pa.array(t, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, [*names, "piece", "n_pieces", "start_pos", "end_pos", "piece_text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in long.schema.fields[:-1])
    return long.mapInArrow(run, f"{schema}, piece int, n_pieces int, start_pos int, end_pos int, piece_text string")
