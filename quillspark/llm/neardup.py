"""Near-duplicate texts by pivot distance tables over word fingerprints.

A text is the set of its words. Its fingerprint has 65,536 bits, each the parity of the words that fall on it, so every word
that only one of two texts has changes one bit at most. The bits form blocks (COARSE of them, or FINE for texts of more than
SHORT words), and a text's row of the pivot table has for every block the Hamming distance to a fixed reference fingerprint,
less that of no words. The references are all those that come of one by complementing any of its blocks: 2 ** blocks of them. The distance
to each is a sum of the row's entries with signs, so the largest difference that two rows have in any of these coordinates is the
sum of the differences of their entries. It never exceeds the number of words that only one text has. A similarity of t allows
(a + b) (1 - t) / (1 + t) such words in texts of a and b words: a pair whose largest coordinate difference is more is discarded unseen.
The table is made once and stored with the texts' words; distances are kept within a byte, which makes no difference larger. Of what is left,
pairs whose fingerprints, folded to 64 bits, differ in more bits than that are discarded too.

Rows meet in the table without comparing all with all: two texts as similar as that share several of their rarest
words, so each text is filed under its rarest words (enough of them that no pair is lost), and files that grow large are
cut by the next rare word that both texts share.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import Scratch

#: Blocks of the fingerprint, and of that of texts with more than SHORT words.
COARSE, FINE, SHORT = 8, 64, 64
#: Word counts are kept by this many hash buckets, whatever the vocabulary; they only decide which words are rare.
BUCKETS = 1 << 18
#: Texts of more words are filed under single rare words instead of chains of two and three.
LONG = 96
#: A file of more rows is cut by the next shared word; one that can't be cut is paired along its first coordinate.
CUT_ABOVE = 128
#: Words in more texts than this get a file for each word, or each two words, that may follow (single ones, for each
#: pair of blocks of their texts), so that no file fills a task.
FILE_ROWS = 100_000
#: Rows that are paired at a time.
BLOCK = 200_000
#: Up to this many row ids are broadcast when the survivors' words are fetched.
BROADCAST_IDS = 500_000
#: Copies of one text are paired in blocks of so many.
COPIES = 512

_WORD = re.compile("[a-z0-9]+")
_SIGNS = np.random.default_rng(20).integers(0, 2, 1 << 16).astype(np.int64) * 2 - 1  # what setting a bit does to the distance


def pivot_rows(flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The pivot table: FINE distances of each text to the reference, from its words' codes and whose they are."""
    at = np.sort((row.astype(np.int64) << 16) | (flat & np.uint64(0xFFFF)).astype(np.int64))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    odd = at[first[np.diff(np.r_[first, len(at)]) % 2 == 1]]  # bits that an odd number of words falls on
    block = (odd >> 16) * FINE + ((odd & 0xFFFF) * FINE >> 16)
    sums = np.bincount(block, _SIGNS[odd & 0xFFFF], rows * FINE).reshape(rows, FINE)
    return np.clip(np.rint(sums), -127, 127).astype(np.int8)


def prints_of(flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The fingerprints folded to 64 bits."""
    out = np.zeros(rows, np.uint64)
    np.bitwise_xor.at(out, row, np.uint64(1) << (flat & np.uint64(63)))
    return out


def coarse_rows(fine: np.ndarray) -> np.ndarray:
    """The pivot table in COARSE blocks."""
    return np.clip(fine.reshape(len(fine), COARSE, -1).sum(2, dtype=np.int64), -127, 127).astype(np.int8)


_TOP, _REST, _LOW = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x00FF00FF00FF00FF)
_B1, _B7, _B8, _B48, _FULL, _QUADS = np.uint64(1), np.uint64(7), np.uint64(8), np.uint64(48), np.uint64(255), np.uint64(0x0001000100010001)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of the differences of eight bytes (unsigned) in each pair of numbers, all eight at once."""
    with np.errstate(over="ignore"):
        d = ((x | _TOP) - (y & _REST)) ^ ((x ^ ~y) & _TOP)  # x - y in every byte
        less = (((~x & y) | (~(x ^ y) & d)) & _TOP) >> _B7  # 1 in the bytes where x < y
        d = (d ^ (less * _FULL)) + less
        return (((d & _LOW) + ((d >> _B8) & _LOW)) * _QUADS >> _B48).astype(np.int64)


def _unsigned(rows: np.ndarray) -> np.ndarray:
    """Rows of signed bytes as rows of numbers that hold eight unsigned bytes in the same order of size."""
    return np.ascontiguousarray(rows.view(np.uint8) ^ np.uint8(128)).view(np.uint64)


class _Codes(dict):
    """Word to 64-bit code; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


def _flat(words: list[str], codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """All words' codes in a row, and the number of words of each text."""
    parts = [w.split(" ") for w in words]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter((codes[w] for p in parts for w in p), np.uint64, int(sizes.sum())), sizes


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the slices [start, start + length) one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ b.astype(np.uint64)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


_FILES = pa.schema([("file", pa.int64()), ("rid", pa.int64()), ("p0", pa.int64()), ("p1", pa.int64()), ("meta", pa.int64()), ("tail", pa.binary()), ("fine", pa.binary())])
_FILES_DDL = "file bigint, rid bigint, p0 bigint, p1 bigint, meta bigint, tail binary, fine binary"


def _file_rows(rids: np.ndarray, words: list[str], p0: np.ndarray, p1: np.ndarray, fine: pa.Array, counts: np.ndarray, t: float, codes: _Codes, salt: np.ndarray) -> list[pa.RecordBatch]:
    """Every text's rows in the files of its rarest words.

    A chain row has meta = words of the text | (words of the tail that may come second) << 32, and as tail the rare
    words that follow; a single row has an empty tail and 0 there. Two texts within the threshold share at least
    ceil(t n) of the n words of either; so they share one of the n - ceil(t n) + 1 rarest, two of one word more, and
    three of two words more: a chain's first word has index up to e = n - ceil(t n), its second up to e + 1, its third up
    to e + 2. Chains need three shared words; shorter and LONG texts meet the others under single words.
    """
    flat, n = _flat(words, codes)
    row = np.repeat(np.arange(len(n)), n)
    count = counts[(flat >> np.uint64(46)).astype(np.int64)]
    order = np.lexsort((flat, count, row))
    flat, count = flat[order], count[order]
    start = np.cumsum(n) - n
    need = np.ceil(t * n - 1e-9).astype(np.int64)
    e = n - need
    chained = (need >= 3) & (n <= LONG)
    shortest = np.ceil(t * n - 1e-9)
    longest = np.floor(n / t + 1e-9)
    single = ~chained | (np.ceil(t * shortest - 1e-9) < 3) | (longest > LONG)
    word32 = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = []

    def emit(file, r, meta, tail_start, tail_len):
        offsets = np.zeros(len(r) + 1, np.int32)
        np.cumsum(tail_len * 4, out=offsets[1:])
        data = word32[_ragged(tail_start, tail_len)].tobytes()
        tail = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        cols = [pa.array(file.view(np.int64)), pa.array(rids[r]), pa.array(p0[r]), pa.array(p1[r]), pa.array(meta), tail, fine.take(pa.array(r))]
        out.append(pa.RecordBatch.from_arrays(cols, schema=_FILES))

    rows = np.flatnonzero(chained)
    if len(rows):
        k = e[rows] + 1
        r, i = np.repeat(rows, k), _ragged(np.zeros(len(rows), np.int64), k)
        at = start[r] + i
        last = np.minimum(n[r], e[r] + 3)  # one past the last word that a chain may use
        seconds = np.minimum(n[r], e[r] + 2) - i - 1
        wide = count[at] > FILE_ROWS
        a = ~wide & (seconds > 0)
        emit(_mix(flat[at[a]], salt[r[a]]), r[a], n[r[a]] | (seconds[a] << 32), at[a] + 1, (last - i - 1)[a])
        if wide.any():  # a file for each second word, or where that is as frequent for each third one
            w = np.flatnonzero(wide & (seconds > 0))
            k = seconds[w]
            rr, aa = np.repeat(r[w], k), np.repeat(at[w], k)
            second = np.repeat(at[w] + 1, k) + _ragged(np.zeros(len(w), np.int64), k)
            end = start[rr] + np.minimum(n[rr], e[rr] + 3)
            two = _mix(_mix(flat[aa], salt[rr]), flat[second])
            b = count[second] <= FILE_ROWS
            emit(two[b], rr[b], n[rr[b]] | (-1 << 32), second[b] + 1, (end - second - 1)[b])
            b = np.flatnonzero(~b)
            k = (end - second - 1)[b]
            r3 = np.repeat(rr[b], k)
            third = _ragged(second[b] + 1, k)
            emit(_mix(np.repeat(two[b], k), flat[third]), r3, n[r3], third, np.zeros(len(r3), np.int64))
    rows = np.flatnonzero(single)
    if len(rows):
        k = e[rows] + 1
        r = np.repeat(rows, k)
        at = start[r] + _ragged(np.zeros(len(rows), np.int64), k)
        # A frequent word has a file for each pair of blocks of its texts: FILE_ROWS texts or so in a block.
        blocks = -(-count[at] // FILE_ROWS)
        r, at, blocks, other = np.repeat(r, blocks), np.repeat(at, blocks), np.repeat(blocks, blocks), _ragged(np.zeros(len(at), np.int64), blocks)
        own = rids[r] % blocks
        pair = np.minimum(own, other) * blocks + np.maximum(own, other)
        emit(_mix(_mix(~flat[at], salt[r]), pair.astype(np.uint64)), r, n[r], at, np.zeros(len(r), np.int64))
    return out


def _near(i: np.ndarray, j: np.ndarray, most: np.ndarray, rows: np.ndarray, ri: np.ndarray, rj: np.ndarray) -> np.ndarray:
    """Which pairs differ by no more than ``most`` in any coordinate; eight blocks are added at a time, and pairs beyond it drop out."""
    left = np.arange(len(i))
    sums = np.zeros(len(i), np.int64)
    for c in range(rows.shape[1]):
        sums = sums + _apart(rows[ri[left], c], rows[rj[left], c])
        keep = np.flatnonzero(sums <= most[left])
        left, sums = left[keep], sums[keep]
        if not len(left):
            break
    return left


def _close(i: np.ndarray, j: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the pivot table and the folded fingerprints can't discard; table: coarse rows, fine rows, place of each text in these or -1, fingerprints."""
    coarse, fine, at, prints = table
    most = np.floor((n[i] + n[j]) * ((1 - t) / (1 + t)) + 1e-9).astype(np.int64)
    keep = _near(i, j, most, coarse, i, j)
    i, j, most = i[keep], j[keep], most[keep]
    keep = np.flatnonzero(np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9)
    i, j, most = i[keep], j[keep], most[keep]
    keep = np.flatnonzero(np.bitwise_count(prints[i] ^ prints[j]) <= most)
    i, j, most = i[keep], j[keep], most[keep]
    both = (at[i] >= 0) & (at[j] >= 0)
    if both.any():
        long = np.flatnonzero(both)
        keep = ~both
        keep[long[_near(i[long], j[long], most[long], fine, at[i[long]], at[j[long]])]] = True
        i, j = i[keep], j[keep]
    return i, j


def _pairs_in(file: np.ndarray, member: np.ndarray, at: np.ndarray, left: np.ndarray, tail: np.ndarray, cuttable: np.ndarray, table, n, t) -> Iterator[tuple]:
    """Close pairs among the entries with the same file; entries point to rows (member) and to the rest of their tail."""
    order = np.argsort(file)
    ordered = file[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    size = np.diff(np.r_[first, len(file)])
    cut = cuttable[order[first]]
    wide = size > CUT_ABOVE
    # Files of moderate size: all pairs at distance 1, 2, ... in the file.
    some = np.flatnonzero((size > 1) & ~wide)
    some = some[np.argsort(-size[some], kind="stable")]
    for d in range(1, CUT_ABOVE):
        some = some[: np.searchsorted(-size[some], -d, side="left")]  # files of more than d
        if not len(some):
            break
        for block in np.array_split(some, 1 + int((size[some] - d).sum()) // (1 << 17)):
            here = _ragged(first[block], size[block] - d)
            i, j = _close(member[order[here]], member[order[here + d]], table, n, t)
            if len(i):
                yield i, j
    # Large files that no further word cuts: sorted by the first coordinate, beyond a row that lies too far all do.
    for g in np.flatnonzero(wide & ~cut):
        rows = member[order[first[g] : first[g] + size[g]]]
        coordinate = (table[0][rows, 0] & _FULL).astype(np.int64)
        by = np.argsort(coordinate, kind="stable")
        rows, coordinate = rows[by], coordinate[by]
        reach = np.floor(2 * n[rows] / t * ((1 - t) / (1 + t)) + 1e-9).astype(np.int64)
        stop = np.searchsorted(coordinate, coordinate + reach, side="right")
        count = stop - np.arange(len(rows)) - 1
        for s in range(0, len(rows), step := max(1, (1 << 18) // max(1, int(count.max())))):
            c = count[s : s + step]
            i = np.repeat(np.arange(s, s + len(c)), c)
            i, j = _close(rows[i], rows[_ragged(np.arange(s, s + len(c)) + 1, c)], table, n, t)
            if len(i):
                yield i, j
    # Other large files: one entry for each word that may be the third.
    more = np.flatnonzero(wide & cut)
    if len(more):
        src = order[_ragged(first[more], size[more])]
        k = left[src]
        src, nxt = np.repeat(src, k), _ragged(at[src], k)
        none = np.zeros(len(src), np.int64)
        yield from _pairs_in(_mix(file[src], tail[nxt]), member[src], none, none, tail, np.zeros(len(src), bool), table, n, t)


def _pair_block(block: pa.Table, t: float) -> np.ndarray:
    """Close pairs of row ids, smaller first, of all files of the block."""
    rid = block["rid"].to_numpy()
    meta = block["meta"].to_numpy()
    n, seconds = meta & 0xFFFFFFFF, meta >> 32
    tails = block["tail"].combine_chunks()
    if isinstance(tails, pa.ChunkedArray):
        tails = pa.concat_arrays(tails.chunks)
    offsets = np.frombuffer(tails.buffers()[1], np.int32)[tails.offset : tails.offset + len(tails) + 1].astype(np.int64) // 4
    tail = np.frombuffer(tails.buffers()[2] or b"", np.uint32)
    length = np.diff(offsets)
    coarse = _unsigned(np.ascontiguousarray(block["p0"].to_numpy()).reshape(-1, 1).view(np.int8))
    long = n > SHORT
    fines = block["fine"].combine_chunks()
    fines = pa.concat_arrays(fines.chunks) if isinstance(fines, pa.ChunkedArray) else fines
    fine = _unsigned(np.frombuffer(b"".join(fines.filter(pa.array(long)).to_pylist()), np.int8).reshape(-1, FINE))
    table = (coarse, fine, np.where(long, np.cumsum(long) - 1, -1), block["p1"].to_numpy().view(np.uint64))
    file = block["file"].to_numpy().view(np.uint64)
    k = np.maximum(seconds, 0)
    chain = np.repeat(np.arange(len(rid)), k)
    nxt = _ragged(offsets[:-1], k)
    flat = np.flatnonzero(seconds <= 0)
    entry_file = np.concatenate([_mix(file[chain], tail[nxt]), file[flat]])
    member = np.concatenate([chain, flat])
    at = np.concatenate([nxt + 1, offsets[flat]])
    left = np.concatenate([offsets[1:][chain] - nxt - 1, length[flat]])
    cuttable = np.concatenate([np.ones(len(chain), bool), seconds[flat] < 0])
    found = [np.stack([rid[i], rid[j]], 1) for i, j in _pairs_in(entry_file, member, at, left, tail, cuttable, table, n, t)]
    if not found:
        return np.zeros((0, 2), np.int64)
    pairs = np.sort(np.concatenate(found), axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _pair_files(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(block: pa.Table) -> Iterator[pa.RecordBatch]:
            pairs = _pair_block(block, t)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:  # sorted by file: a block ends where a file does
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                block = pa.Table.from_batches(held)
                files = block["file"].to_numpy()
                edge = int(np.searchsorted(files, files[-1]))
                if edge:
                    yield from done(block.slice(0, edge))
                held = block.slice(edge).to_batches()
                rows = block.num_rows - edge
        if rows:
            yield from done(pa.Table.from_batches(held))

    return run


def _read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for kind, ident, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = sorted(set(_WORD.findall(text.lower())))
            if words:
                joined = " ".join(words)
                rows.append((kind, ident, xxhash.xxh64_intdigest(joined, kind) - (1 << 63), joined))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.string()), strict=True)], ["kind", "id", "rid", "words"])


def similar_classes(texts: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts whose words have a Jaccard similarity of at least ``threshold``.

    ``texts``: kind int, id string, text string; texts of different kinds are never compared. members: kind, id,
    class_id, one row per id; ids with the same words have the same class. links: kind, class_a, class_b, similarity of
    all pairs of classes within the threshold, smaller class_id first; no link is lost. Words are runs of a-z and digits
    in lower case.

    Null texts and ids and texts without words have no rows. An id with several texts is in several classes. Repeated
    rows count once. Texts of any length are read whole. A class id is a 64-bit hash of the words and kind.
    """
    if not 0.6 <= threshold < 1:
        raise ValueError("threshold must be from 0.6 up to 1")
    spark = texts.sparkSession
    scratch = Scratch(spark)
    t = float(threshold)
    read = texts.select(F.col("kind").cast("int"), F.col("id").cast("string"), F.col("text").cast("string")).where("kind is not null and id is not null and text is not null")
    members = scratch.write(read.mapInArrow(_read_words, "kind int, id string, rid bigint, words string"), "members")

    def pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            for s in range(0, b.num_rows, 4000):
                part = b.slice(s, 4000)
                flat, n = _flat(part.column(2).to_pylist(), codes)
                row = np.repeat(np.arange(len(n)), n)
                fine = pivot_rows(flat, row, len(n))
                rows = pa.array([f.tobytes() if k > SHORT else b"" for f, k in zip(fine, n, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(coarse_rows(fine).view(np.int64)[:, 0]), pa.array(prints_of(flat, row, len(n)).view(np.int64)), rows], ["rid", "kind", "words", "p0", "p1", "fine"])

    once = members.groupBy("rid").agg(F.first("kind").alias("kind"), F.first("words").alias("words"))
    sets = scratch.write(once.mapInArrow(pivot, "rid bigint, kind int, words string, p0 bigint, p1 bigint, fine binary"), "sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = _Codes(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            flat, _ = _flat(b.column(0).to_pylist(), codes)
            total += np.bincount((flat >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)  # the counts of all texts, BUCKETS numbers at most
    summed = sets.select("words").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            for s in range(0, b.num_rows, 4000):
                part = b.slice(s, 4000)
                fine = part.column(5)
                yield from _file_rows(part.column(0).to_numpy(), part.column(2).to_pylist(), part.column(3).to_numpy(), part.column(4).to_numpy(), fine, shared.value, t, codes, part.column(1).to_numpy().astype(np.uint64))

    filed = sets.select("rid", "kind", "words", "p0", "p1", "fine").mapInArrow(file, _FILES_DDL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    survivors = filed.repartition(parts, "file").sortWithinPartitions("file").mapInArrow(_pair_files(t), "a bigint, b bigint").distinct()
    survivors = scratch.write(survivors, "survivors")
    ids = survivors.select(F.col("a").alias("rid")).union(survivors.select("b")).distinct()
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    some = sets.join(wanted, "rid", "left_semi").select("rid", "kind", F.split("words", " ").alias("w"))
    some = scratch.write(some, "wanted")
    a, b = (some.select(F.col("rid").alias(x), F.col("kind").alias(f"k{x}"), F.col("w").alias(f"w{x}")) for x in "ab")
    common = F.size(F.array_intersect("wa", "wb"))
    links = (
        survivors.join(a, "a").join(b, "b").where("ka = kb")
        .withColumn("common", common)
        .withColumn("similarity", F.col("common") / (F.size("wa") + F.size("wb") - F.col("common")))
        .where(F.col("similarity") >= t - 1e-12)
        .select(F.col("ka").alias("kind"), F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity")
    )
    return members.select("kind", "id", F.col("rid").alias("class_id")).distinct(), scratch.write(links, "links")


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity): the links between ids, smaller id first, copies included.

    Large classes are paired in blocks of COPIES members, within a class and between linked ones, so that no key of a join has
    more than two blocks.
    """
    scratch = Scratch(members.sparkSession)
    sizes = scratch.write(members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / COPIES)), "sizes")
    m = members.join(sizes, "class_id").withColumn("part", F.expr("pmod(xxhash64(id), parts)"))
    blocks = m.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    keyed = blocks.select("class_id", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "id", "part")
    left, right = keyed.where("part = p"), keyed.where("part = q").withColumnRenamed("id", "id2").drop("part")
    same = left.drop("part").join(right, ["class_id", "p", "q"]).where("p < q or id < id2").select("id", "id2", F.lit(1.0).alias("similarity"))
    ids = members.select("class_id", "id")
    large = sizes.where("parts > 1").select("class_id")
    some = not large.isEmpty()
    small = links
    if some:
        small = links.join(large.withColumnRenamed("class_id", "class_a"), "class_a", "left_anti").join(large.withColumnRenamed("class_id", "class_b"), "class_b", "left_anti")
    across = (
        small.join(ids.withColumnRenamed("class_id", "class_a"), "class_a")
        .join(ids.select(F.col("class_id").alias("class_b"), F.col("id").alias("id2")), "class_b")
        .select("id", "id2", "similarity")
    )
    if some:
        parts_of = sizes.select("class_id", "parts")
        cut = (
            links.join(parts_of.withColumnsRenamed({"class_id": "class_a", "parts": "pa"}), "class_a", "left").join(parts_of.withColumnsRenamed({"class_id": "class_b", "parts": "pb"}), "class_b", "left").where("pa > 1 or pb > 1")
            .select("class_a", "class_b", "similarity", "pb", F.explode(F.expr("sequence(0L, coalesce(pa, 1L) - 1)")).alias("qa")).select("class_a", "class_b", "similarity", "qa", F.explode(F.expr("sequence(0L, coalesce(pb, 1L) - 1)")).alias("qb"))
        )
        cut = scratch.write(cut, "cut")
        placed = members.join(sizes, "class_id", "left").select("class_id", F.expr("pmod(xxhash64(id), coalesce(parts, 1L))").alias("part"), "id")
        placed_a, placed_b = placed.withColumnsRenamed({"class_id": "class_a", "part": "qa"}), placed.withColumnsRenamed({"class_id": "class_b", "part": "qb", "id": "id2"})
        key = ["class_a", "class_b", "qa", "qb"]
        across = across.unionByName(cut.join(placed_a, ["class_a", "qa"]).join(cut.drop("similarity").join(placed_b, ["class_b", "qb"]), key).select("id", "id2", "similarity"))
    both = same.unionByName(across).where("id <> id2")
    return both.groupBy(F.least("id", "id2").alias("id_a"), F.greatest("id", "id2").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def classes_with_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per id and class: the class by its smallest id, how many ids share it, and to how many other classes it is linked."""
    copies = members.groupBy("class_id").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("linked_classes"))
    classes = copies.join(degree, "class_id", "left")
    return members.join(classes, "class_id").select("kind", "id", "class_id", "first_id", "copies", F.coalesce("linked_classes", F.lit(0)).alias("linked_classes"))
