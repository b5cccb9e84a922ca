"""Restoring text that was decoded with the wrong character encoding, by minimum description length."""

from __future__ import annotations

import collections
import functools
import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import Scratch

#: Bytes of a language's dictionary, and of the stretches of text that it is put together from; and how thoroughly zstandard looks for what repeats it.
DICTIONARY_BYTES = 64_000
STRETCH = 1000
LEVEL = 7
#: Stretches are chosen by the pieces of so many bytes in them; these are counted in 2^COUNTER_BITS counters by their hash.
PIECE, COUNTER_BITS = 8, 22
#: Bytes of different segments that stretches are chosen from at once; so many such choices, of KEPT bytes each, are put together and chosen from again.
CHOICE_BYTES, FAN, KEPT = 2_000_000, 8, 256_000
#: Languages of fewer texts are no measure of rare letters.
FEW_TEXTS = 50
#: Fixed values: (encoding of the bytes, encoding they were read in), and bytes that naming the chain costs.
CHAINS = (
    ("utf-8", "cp1252", 2), ("utf-8", "cp1250", 3), ("utf-8", "cp1251", 3), ("utf-8", "cp437", 3), ("utf-8", "cp850", 3), ("utf-8", "mac_roman", 3),
    ("utf-8", "gbk", 4), ("utf-8", "koi8_r", 4), ("utf-8", "iso8859_2", 4), ("utf-8", "iso8859_15", 4), ("utf-8", "cp866", 4), ("utf-8", "shift_jis", 4), ("utf-8", "big5", 4), ("utf-8", "euc_kr", 4),
    ("cp1252", "mac_roman", 6), ("cp1252", "cp437", 6), ("cp1252", "cp850", 6), ("cp1252", "cp1251", 6), ("cp1252", "cp1250", 6), ("cp1252", "koi8_r", 6), ("cp1252", "gbk", 8), ("mac_roman", "cp1252", 6), ("cp850", "cp1252", 6), ("cp437", "cp1252", 6),
    ("cp1251", "cp1252", 5), ("koi8_r", "cp1252", 5), ("cp866", "cp1252", 5), ("koi8_r", "cp1251", 6), ("cp1251", "koi8_r", 6), ("cp866", "cp1251", 6), ("cp1251", "cp866", 6), ("cp1251", "mac_roman", 6), ("iso8859_5", "cp1252", 6),
    ("cp1250", "cp1252", 6), ("iso8859_2", "cp1252", 6), ("cp1250", "iso8859_2", 8), ("iso8859_2", "cp1250", 8), ("cp852", "cp1252", 6),
    ("shift_jis", "cp1252", 5), ("euc_jp", "cp1252", 5), ("shift_jis", "mac_roman", 6), ("shift_jis", "cp437", 6), ("euc_jp", "shift_jis", 6), ("gbk", "cp1252", 6), ("shift_jis", "gbk", 8),
)
#: Bytes that a segment must save to count.
LEAST_SAVED = 2
#: A letter costs STRANGE bytes for each halving of its frequency, in its surroundings, below RARE of the documents, down to NEVER; a frequency of NEVER * AS_NEVER counts as none (0.0014 bytes).
STRANGE, RARE, NEVER, AS_NEVER = 1.0, 0.01, 0.0001, 0.001
#: Characters of different segments, and different marks, that a task counts before it passes them on.
HELD_CHARS, HELD_MARKS = 8_000_000, 200_000
_LOST = re.compile("�")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_RUN = re.compile("[^\x00-\x7f]+")
_CUT = re.compile(r"(?<=[.!?。！？|])[ \t]+|[\r\n]+")
_CYRILLIC, _KANA = re.compile("[Ѐ-ӿ]"), re.compile("[぀-ヿ一-鿿]")

_MULTIBYTE = {"utf-8", "gbk", "big5", "euc_kr", "shift_jis", "euc_jp"}
_ENCODE: dict[str, dict[str, bytes]] = {}


def _encode(text: str, codec: str) -> bytes | None:
    """The bytes that were read as ``text``; undefined bytes of one-byte codecs are expected as control characters."""
    if codec in _MULTIBYTE:
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    table = _ENCODE.get(codec)
    if table is None:
        table = {chr(b): bytes([b]) for b in range(256)}
        for b in range(256):
            c = bytes([b]).decode(codec, "ignore")
            if c:
                table[c] = bytes([b])
        _ENCODE[codec] = table
    try:
        return b"".join([table[c] for c in text])
    except KeyError:
        return None


def _places(run: str, wrong: str) -> str | None:
    """A run with only the UTF-8 sequences in it decoded that were read in a one-byte codec; None without any."""
    _encode("", wrong)
    raw = b"".join(_ENCODE[wrong].get(c, b"\x00") for c in run)
    out, at = [], 0
    for m in _UTF8.finditer(raw):
        try:
            out += [run[at : m.start()], m.group().decode()]
        except UnicodeDecodeError:
            continue
        at = m.end()
    return "".join([*out, run[at:]]) if out else None


def _redecode(text: str, right: str, wrong: str) -> str | None:
    raw = _encode(text, wrong)
    if raw is None:
        return None
    try:
        return raw.decode(right)
    except UnicodeDecodeError:
        return None


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_SPACE = re.compile("(?<=[\xc2-\xf4]) (?=[^\x00-\x7f]| )")
_BY_WRONG: dict[str, list[tuple[int, str]]] = collections.defaultdict(list)
for _k, (_right, _wrong, _) in enumerate(CHAINS):
    _BY_WRONG[_wrong].append((_k, _right))
_SCRIPT = {"cp1251": "ru", "koi8_r": "ru", "cp866": "ru", "iso8859_5": "ru", "cp1250": "pl", "iso8859_2": "pl", "cp852": "pl", "shift_jis": "ja", "euc_jp": "ja"}


#: Encodings whose characters may take in a plain ASCII byte: text in them is decoded as a whole, all other text run by run.
_SPANNING = {"shift_jis", "gbk", "big5"}
_WHOLE = [k for k, (right, _, _) in enumerate(CHAINS) if right in _SPANNING]
_IN_PARTS = [right == "utf-8" for right, _, _ in CHAINS]
_RUNS: dict[str, list[str | None]] = {}


def _run_readings(run: str) -> list[str | None]:
    """For every chain what a run of characters beyond ASCII becomes: None where the chain can't be undone in it.

    For UTF-8 read in a one-byte codec, usual letters may touch garbled ones: then only the sequences that can be are decoded.
    """
    if (known := _RUNS.get(run)) is None:
        known = []
        for right, wrong, _ in CHAINS:
            x = None if right in _SPANNING else _redecode(run, right, wrong)
            if x is None and right == "utf-8" and wrong not in _MULTIBYTE:
                x = _places(run, wrong)
            known.append(x if x is None or "\ufffd" not in x else None)
        if len(_RUNS) > 200_000:
            _RUNS.clear()
        _RUNS[run] = known
    return known


def whole_readings(segment: str) -> dict[str, list[int]]:
    """New text and the chains that make it, of the chains that are undone in a segment as a whole."""
    out: dict[str, list[int]] = {}
    for k in _WHOLE:
        right, wrong, _ = CHAINS[k]
        raw = _encode(segment, wrong)
        if raw is not None:
            try:
                new = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if new != segment and "\ufffd" not in new:
                out.setdefault(new, []).append(k)
    if _SPACE.search(segment):  # a no-break space may have become a space
        new = _redecode(_SPACE.sub("\xa0", segment), *CHAINS[0][:2])
        if new is not None and new != segment:
            out.setdefault(new, []).append(0)
    return out


_KINDS: dict[str, str] = {"": " "}


def _kind(c: str) -> str:
    """What a neighbour counts as: letters of ASCII, Cyrillic and Japanese by their kind, other characters as they are."""
    if (kind := _KINDS.get(c)) is None:
        if c.isspace():
            kind = " "
        elif c <= "\x7f":
            kind = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c
        elif _CYRILLIC.match(c):
            kind = "Я" if c.isupper() else "я"
        else:
            kind = "字" if _KANA.match(c) else c
        if len(_KINDS) < 100_000:
            _KINDS[c] = kind
    return kind


def marks(text: str) -> list[str]:
    """Every character beyond ASCII between its neighbours' kinds."""
    out = []
    for m in _RUN.finditer(text):
        kinds = [_kind(text[m.start() - 1 : m.start()]), *map(_kind, m.group()), _kind(text[m.end() : m.end() + 1])]
        out += [kinds[i] + c + kinds[i + 2] for i, c in enumerate(m.group())]
    return out


def _joined(segment: str, spans: list[tuple[int, int]], shown: list[tuple[str, float]]) -> str:
    """The segment with its runs replaced."""
    parts, at = [], 0
    for (a, b), (new, _) in zip(spans, shown, strict=True):
        parts += [segment[at:a], new]
        at = b
    return "".join([*parts, segment[at:]])


class Model:
    """Per-language dictionaries and how usual letters are in their surroundings; measures and restores."""

    def __init__(self, dictionaries: dict[str, bytes], usual: dict[str, float]):
        self.dictionaries, self.usual = dictionaries, usual
        self.never = STRANGE * math.log2(RARE / NEVER) if usual else 0.0
        self.tools = []
        for lang, data in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            tool = zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            self.tools.append((lang, tool))
        self.sizes: dict[str, int] = {}
        self.runs: dict[tuple[bool, str], float] = {}
        self.runs_read: dict[tuple[str, str, str], tuple[float, list[tuple[str, float] | None]]] = {}
        self.empty = min((len(t.compress(b"")) for _, t in self.tools), default=0)
        self.options: dict[str, list[tuple[int, float, float, str]]] = {}

    def size(self, text: str) -> int:
        """Bytes of the text under the dictionary that fits it best."""
        if (n := self.sizes.get(text)) is not None:
            return n
        raw = text.encode("utf-8", "surrogatepass")
        n = min((len(t.compress(raw)) for _, t in self.tools), default=len(raw))
        if len(self.sizes) > 200_000:
            self.sizes.clear()
        self.sizes[text] = n
        return n

    def oddness(self, text: str) -> float:
        """Bytes that the letters of a text cost beyond their compressed size for being unusual where they stand."""
        total = 0.0
        for m in _RUN.finditer(text):
            around = text[m.start() - 1 : m.end() + 1] if m.start() else text[: m.end() + 1]
            key = (m.start() > 0, around)
            if (cost := self.runs.get(key)) is None:
                cost = sum(self.usual.get(mark, self.never) for mark in marks(around))
                if len(self.runs) > 300_000:
                    self.runs.clear()
                self.runs[key] = cost
            total += cost
        return total

    def of_run(self, before: str, run: str, after: str) -> tuple[float, list[tuple[str, float] | None]]:
        """What a run costs where it stands, and for every chain what it becomes and what that costs there."""
        key = (before, run, after)
        if (known := self.runs_read.get(key)) is None:
            known = (self.oddness(before + run + after), [None if new is None else (new, self.oddness(before + new + after)) for new in _run_readings(run)])
            if len(self.runs_read) > 100_000:
                self.runs_read.clear()
            self.runs_read[key] = known
        return known

    def rereadings(self, segment: str) -> list[tuple[list[int], float, Callable[[], str]]]:
        """(chains, bytes saved by usual letters, how to make the new text) of every chain that can be undone: in the whole segment, or for UTF-8 in single runs of it."""
        spans = [m.span() for m in _RUN.finditer(segment)]
        by_run = [self.of_run(segment[a - 1 : a] if a else "", segment[a:b], segment[b : b + 1]) for a, b in spans]
        own = [(segment[a:b], odd) for (a, b), (odd, _) in zip(spans, by_run, strict=True)]
        odd = sum(x for _, x in own)
        whole = whole_readings(segment)
        spaced = any(0 in chains for chains in whole.values())
        alike: dict[tuple, list[int]] = {}
        for k, news in enumerate(zip(*(read for _, read in by_run), strict=True)):
            if k not in _WHOLE and (None not in news or (_IN_PARTS[k] and any(news))) and not (spaced and k == 0):
                alike.setdefault(news, []).append(k)
        out = []
        for news, chains in alike.items():
            shown = [new or old for new, old in zip(news, own, strict=True)]
            if shown != own:
                out.append((chains, odd - sum(x for _, x in shown), functools.partial(_joined, segment, spans, shown)))
        for new, chains in whole.items():
            out.append((chains, odd - self.oddness(new), functools.partial(str, new)))
        return out

    def readings(self, segment: str) -> list[tuple[int, float, float, str]]:
        """(chain, bytes saved in all, bytes saved by usual letters, new text) of every chain that shortens the segment's description.

        Every candidate is compressed but those whose letters cost more than the whole segment's description beyond that of an empty text.
        """
        if (known := self.options.get(segment)) is not None:
            return known
        out, base = [], self.size(segment)
        for chains, usual, make in self.rereadings(segment):
            if usual + base - self.empty > 0:  # no text compresses to less than the empty one
                new = make()
                saved = base - self.size(new) + usual
                if saved >= LEAST_SAVED or usual > 0:
                    out += [(k, saved, usual, new) for k in chains]
        out.sort(key=lambda o: o[0])
        if len(self.options) > 100_000:
            self.options.clear()
        self.options[segment] = out
        return out

    def restore(self, text: str) -> tuple[str, list[str], bool] | None:
        """(restored text, chains undone, whether nothing is lost), or None for text that isn't garbled.

        For each chain the bytes are added up that its segments save; the chain that saves most beyond its own cost is
        undone where it saves or makes strange letters usual ones, and so on until none does, however often the text was garbled. Replacement and control
        characters that remain are lost text.
        """
        pieces, at = [], 0
        for m in _CUT.finditer(text):
            pieces += [text[at : m.start()], m.group()]
            at = m.end()
        pieces.append(text[at:])
        used: list[str] = []
        seen = {tuple(pieces)}
        while True:
            gain: dict[int, float] = collections.defaultdict(float)
            spots: dict[int, list[tuple[int, str]]] = collections.defaultdict(list)
            witness: dict[int, set[str]] = collections.defaultdict(set)
            for i, p in enumerate(pieces):
                if p and not p.isascii():
                    for k, saved, usual, new in self.readings(p):
                        gain[k] += max(saved, 0)
                        spots[k].append((i, new))
                        witness[k] |= {new} | ({"strange"} if usual > 0 else set())
            # Between two Latin code pages usual letters become usual letters: one segment is no evidence.
            gain = {k: g for k, g in gain.items() if CHAINS[k][0] in ("utf-8", *_SCRIPT) or len(witness[k]) > 1}
            best = max(gain, key=lambda k: (gain[k] - CHAINS[k][2], -k), default=None)
            if best is None or gain[best] <= CHAINS[best][2]:
                break
            for i, new in spots[best]:
                pieces[i] = new
            if tuple(pieces) in seen:  # nothing new comes of it
                break
            seen.add(tuple(pieces))
            used.append(f"{CHAINS[best][0]} read as {CHAINS[best][1]}")
        out = "".join(pieces)
        lost = bool(_LOST.search(out)) or bool(_CONTROL.search(out))
        return (out, used, not lost) if used or lost else None


@functools.lru_cache(100_000)
def _undoes(run: str) -> bool:
    return any((x := _redecode(run, "utf-8", w)) is not None and x != run for w in ("cp1252", "cp1251", "cp1250", "cp437", "cp850"))


def _clean(text: str) -> bool:
    """Whether nothing speaks against a text as an example of clean text."""
    return not (_LOST.search(text) or _CONTROL.search(text) or any(map(_undoes, set(_RUN.findall(text)))))


def _example(text: str, lang: str, usual: dict[str, float] | None) -> bool:
    """Whether a text is an example of its language: clean, Russian and Japanese with their script, and no letter very rare where it stands (as far as that is known)."""
    if not _clean(text) or (lang in ("ru", "ja") and not (_CYRILLIC if lang == "ru" else _KANA).search(text)):
        return False
    never = STRANGE * math.log2(RARE / NEVER)
    return usual is None or all(usual.get(mark, never) < never / 2 for mark in set(marks(text)) if not _KANA.search(mark))


def unusual(count: dict[str, int], texts: int) -> dict[str, float]:
    """What marks found in so many of the texts cost, each text's own occurrence left out."""
    return {mark: STRANGE * max(0.0, math.log2(RARE / (max(n - 1, 0) / texts + NEVER))) for mark, n in count.items()}


def _pieces(data: bytes, lang: str) -> np.ndarray:
    """The counter of the PIECE bytes from each byte on; -1 where they reach over the end of a line."""
    n = len(data) - PIECE + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = np.empty(n, np.uint64)
    for o in range(min(PIECE, n)):
        x[o::PIECE] = np.frombuffer(data, "<u8", len(x[o::PIECE]), o)
    x ^= np.uint64(int.from_bytes(lang.encode()[:8], "little") * 0xD6E8FEB86659FD93 % 2**64)
    counter = (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) == 10)])
    counter[ends[PIECE:] != ends[:n]] = -1
    return counter


def count_pieces(total: np.ndarray, segments: list[tuple[bytes, int]], lang: str) -> None:
    """Adds to the counters how often the segments' pieces occur, each segment that many times."""
    counter = _pieces(b"\n".join(s for s, _ in segments), lang)
    times = np.repeat([n for _, n in segments], [len(s) + 1 for s, _ in segments])[: len(counter)]
    np.add.at(total, counter[counter >= 0], times[counter >= 0])


def choose(texts: list[bytes], lang: str, counters: np.ndarray, counts: np.ndarray, limit: int = DICTIONARY_BYTES) -> list[bytes]:
    """Stretches of the texts that hold the most frequent pieces, up to so many bytes, the best first (cover selection, as zstandard trains dictionaries).

    The texts, in an order that sets alike ones apart, are gone through part by part; of each part the stretch of the highest sum of counts
    is taken, every piece once, and its pieces count no more. ``counters`` ascend.
    """
    data = b"\n".join(sorted(texts, key=lambda t: (zlib.crc32(t), t)))
    seen, at = np.unique(_pieces(data, lang), return_inverse=True)
    worth = np.zeros(len(seen), np.int64)
    if len(counters):
        place = np.minimum(np.searchsorted(counters, seen), len(counters) - 1)
        worth = np.where(counters[place] == seen, counts[place], 0)
    order = np.argsort(at, kind="stable")
    first = np.ones(len(at), bool)  # not within a stretch of the same piece
    first[order[1:]] = (at[order[1:]] != at[order[:-1]]) | (order[1:] - order[:-1] >= STRETCH)
    parts = max(1, min(limit // STRETCH // 4, len(at) // (10 * STRETCH)))
    cuts = np.linspace(0, len(at), parts + 1).astype(int)
    out: list[bytes] = []
    size = part = idle = 0
    while size < limit and idle < parts and len(at):
        here = at[cuts[part] : cuts[part + 1]]
        sums = np.concatenate([[0], np.cumsum(worth[here] * first[cuts[part] : cuts[part + 1]])])
        width = min(STRETCH - PIECE + 1, len(here))
        best = int(np.argmax(sums[width:] - sums[:-width]))
        news = np.flatnonzero(worth[here[best : best + width]])
        if len(news):
            start, end = best + int(news[0]), best + int(news[-1]) + 1
            worth[here[start:end]] = 0
            out.append(data[cuts[part] + start : cuts[part] + end + PIECE - 1])
            size += len(out[-1]) + 1
        idle = 0 if len(news) else idle + 1
        part = (part + 1) % parts
    return out


def dictionary(stretches: list[bytes]) -> bytes:
    """The best last, where they are cheapest to refer to."""
    return b"\n".join(reversed(stretches))[-DICTIONARY_BYTES:]


def train(samples: dict[str, list[str]], usual: dict[str, float] | None = None) -> Model:
    """A model from all texts by language, and what marks cost (by default as in the texts). Texts that look garbled, or have letters where they are very rare, are left out."""
    if usual is None:
        everything = [t for texts in samples.values() for t in texts]
        usual = unusual(collections.Counter(mark for t in everything for mark in set(marks(t))), len(everything))
    total, segments = np.zeros(2**COUNTER_BITS, np.int64), {}
    for lang, texts in samples.items():
        known = usual if len(texts) >= FEW_TEXTS else None
        found = collections.Counter(s for t in texts if _example(t, lang, known) for s in _CUT.split(t) if not s.isascii())
        segments[lang] = [(s.encode(), n) for s, n in found.items()]
        count_pieces(total, segments[lang], lang)
    counters = np.flatnonzero(total)
    chosen = {lang: choose([s for s, _ in found], lang, counters, total[counters]) for lang, found in segments.items()}
    return Model({lang: dictionary(stretches) for lang, stretches in chosen.items() if stretches}, usual)


_LOADED: dict[str, Model] = {}


def _usual(texts: DataFrame, total: int) -> dict[str, float]:
    """What marks cost, counted over all whole texts, so many in all; of those in two texts or more, all whose cost differs from that of a mark never seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: collections.Counter[str] = collections.Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(set(marks(t)))
            if len(found) > HELD_MARKS:
                yield pa.RecordBatch.from_pydict({"mark": list(found), "n": list(found.values())})
                found.clear()
        if found:
            yield pa.RecordBatch.from_pydict({"mark": list(found), "n": list(found.values())})

    sums = texts.mapInArrow(count, "mark string, n bigint").groupBy("mark").agg(F.sum("n").alias("n")).where(F.col("n") - 1 > total * NEVER * AS_NEVER)
    found = sums.where("n > 1").toArrow()
    return unusual(dict(zip(found["mark"].to_pylist(), found["n"].to_pylist(), strict=True)), total) if total else {}


def _segments(known: DataFrame, many: set[str], usual: dict[str, float]) -> DataFrame:
    """(lang, segment, n): every different segment with characters beyond ASCII in the texts that are examples of their language, and how often it occurs."""
    shared = known.sparkSession.sparkContext.broadcast((many, usual))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, usual = shared.value
        found: collections.Counter[tuple[str, str]] = collections.Counter()
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            counted = [(*key, n) for key, n in found.items()]
            for i in range(0, len(counted), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*counted[i : i + 10_000], strict=True)], ["lang", "segment", "n"])
            found.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if _example(text, lang, usual if lang in many else None):
                    for s in _CUT.split(text):
                        if not s.isascii():
                            held += 0 if (lang, s) in found else len(s)
                            found[lang, s] += 1
                if held > HELD_CHARS:
                    yield from rows()
                    held = 0
        yield from rows()

    return known.mapInArrow(cut, "lang string, segment string, n bigint").groupBy("lang", "segment").agg(F.sum("n").alias("n"))


def _counts(segments: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counters of all pieces of all segments that are not zero, and what they count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**COUNTER_BITS, np.int64)
        for b in batches:
            by: dict[str, list[tuple[bytes, int]]] = collections.defaultdict(list)
            for lang, s, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by[lang].append((s.encode(), n))
            for lang, found in by.items():
                count_pieces(total, found, lang)
        counters = np.flatnonzero(total)
        for i in range(0, len(counters), 100_000):
            some = counters[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["counter", "n"])

    sums = segments.select("lang", "segment", "n").mapInArrow(count, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counters, counts = sums["counter"].to_numpy().astype(np.int64), sums["n"].to_numpy()
    order = np.argsort(counters)
    return counters[order], counts[order]


def _dictionaries(known: DataFrame, sizes: dict[str, int], usual: dict[str, float]) -> dict[str, bytes]:
    """The dictionary of every language, from all its texts: pieces are counted over all segments, then stretches are chosen
    from groups of segments (by their hash, so that the choice doesn't depend on how the table is stored), and from what was chosen, until one group is left."""
    spark = known.sparkSession
    scratch = Scratch(spark)
    segments = scratch.write(_segments(known, {lang for lang, n in sizes.items() if n >= FEW_TEXTS}, usual), "segments")
    shared = spark.sparkContext.broadcast(_counts(segments))
    levels = F.ceil(F.log(float(FAN), F.greatest(F.lit(1.0), F.sum(F.octet_length("segment")) / CHOICE_BYTES)))
    deep = {r.lang: int(r.levels) for r in segments.groupBy("lang").agg(levels.alias("levels")).collect()}
    if not deep:
        return {}

    def best(limit: int) -> Callable[[pa.Table], pa.Table]:
        def of(group: pa.Table) -> pa.Table:
            stretches = choose(group["stretch"].to_pylist(), group["lang"][0].as_py(), *shared.value, limit)
            same = [group[c].slice(0, 1).combine_chunks().take(pa.array([0] * len(stretches), pa.int32())) for c in ("lang", "part")]
            return pa.table([*same, pa.array(stretches, pa.binary()), pa.array(range(len(stretches)), pa.int32())], ["lang", "part", "stretch", "place"])

        return of

    parts = F.lit(1)
    for lang, n in sorted((lang, n) for lang, n in deep.items() if n):  # those of much text
        parts = F.when(F.col("lang") == lang, FAN**n).otherwise(parts)
    chosen = segments.select("lang", F.pmod(F.xxhash64("segment"), parts).alias("part"), F.col("segment").cast("binary").alias("stretch"))
    for level in range(last := max(deep.values()), -1, -1):
        part = F.col("part") if level == last else F.floor(F.col("part") / FAN)
        groups = chosen.select("lang", part.cast("bigint").alias("part"), "stretch").groupBy("lang", "part")
        chosen = groups.applyInArrow(best(KEPT if level else DICTIONARY_BYTES), "lang string, part bigint, stretch binary, place int")
    found: dict[str, dict[int, bytes]] = collections.defaultdict(dict)
    for r in chosen.collect():
        found[r.lang][r.place] = bytes(r.stretch)
    scratch.clear()
    return {lang: dictionary([stretches[k] for k in sorted(stretches)]) for lang, stretches in found.items()}


def restore_texts(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, restored, chains array<string>, complete boolean) of the garbled texts; others have no row.

    Texts are cut into sentences and lines. Every chain of CHAINS that can be undone in a segment is tried, the segment
    and every candidate are compressed with zstandard dictionaries trained on each language's texts, and over a
    document the chain of the shortest total description, its own cost included, is undone where it shortens; if none
    shortens, the text stays as it is. ``complete``: no replacement or stray control character is left.

    A segment's description includes what its letters cost for being unusual where they stand, as counted over all texts.
    The languages are those that the column names, all of them. Their dictionaries are made from all segments with characters
    beyond ASCII in all their whole texts, but those that look garbled or have letters where they are very rare, by the counts of their pieces. Null, blank and ASCII texts, and null keys,
    have no rows; languages may be null or wrong; equal rows count once; no texts, no rows; without examples of any language
    nothing but lost characters is reported; other columns are not read.
    """
    spark = df.sparkSession
    code = F.regexp_extract(F.lower(lang), "^([a-z]{2,3})(-|_|$)", 1)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(code, F.lit("")).alias("lang")).where("key is not null and text is not null")
    foreign = rows.where(r"text rlike '[^\\x00-\\x7f]'")
    sizes = {r.lang: r["count"] for r in foreign.groupBy("lang").count().collect()}
    usual = _usual(foreign.select("text"), sum(sizes.values()))
    known = foreign.where("lang not in ('', 'und', 'mul', 'zxx')").select("lang", "text")
    model = Model(_dictionaries(known, sizes, usual), usual)
    shared = spark.sparkContext.broadcast((model.dictionaries, model.usual))
    ident = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ident not in _LOADED:
            _LOADED.clear()
            _LOADED[ident] = Model(*shared.value)
        m = _LOADED[ident]
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [(i, *r) for i, t in enumerate(texts) if (r := m.restore(t)) is not None]
            if found:
                at, out, chains, complete = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(out), pa.array(chains, pa.list_(pa.string())), pa.array(complete)], [key, "restored", "chains", "complete"]
                )

    kind = rows.schema["key"].dataType.simpleString()
    spread = foreign.select("key", "text")
    return spread.mapInArrow(run, f"`{key}` {kind}, restored string, chains array<string>, complete boolean").distinct()
