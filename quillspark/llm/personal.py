"""Personal information in free text: span generators with high recall, boosted trees and calibrated thresholds select."""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import boosting, tokens
from quillspark.llm.examples import GIVEN, SURNAME, TASK, TOPIC, sentences

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Invented sentences that the trees are fitted on, and further ones for calibration and thresholds.
TRAIN_SENTENCES, HELD_OUT_SENTENCES, SEED = 14_000, 4000, 11
BATCH = 2048
ROUNDS = 120
#: A missed item weighs so many times as much as a wrong one where thresholds are set.
BETA = 1.25
#: The part of the items that the sieve may lose.
SIEVED = 0.001

_CAP = r"\p{Lu}[\p{Lu}\p{Ll}\p{Lt}\p{M}’'\-]*"
_CITY = rf"{_CAP}(?:[ \-]{_CAP})?(?: \d{{4,6}})?"
_STREET = r"(?:Street|St\.|St|Road|Rd\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Lane|Ln\.?|Drive|Dr\.?|Way|Parkway|Pkwy|Court|Ct\.?|Close|Row|Terrace|Crescent|Place|Pl\.?|Square|Sq\.?|Gardens|Mews|Hill)"
_S = "[ .\\-  /]"

# The public formats that the generators look for, per kind; the index of a format is a feature.
FORMATS: dict[str, list[str]] = {
    "email": [
        r"[\p{L}\d][\w.+%\-]*[ ]?(?:@|[(\[]\s?(?:at|AT)\s?[)\]])[ ]?[\p{L}\d\-]+(?:(?:\.|[ ]?[(\[]\s?(?:dot|DOT)\s?[)\]][ ]?)[\p{L}\d\-]+)*(?:\.|[ ]?[(\[]\s?(?:dot|DOT)\s?[)\]][ ]?)\p{L}{2,}",
        r"[\p{L}\d][\w.+%\-]* (?:at|AT) [\p{L}\d\-]+(?: (?:dot|DOT) [\p{L}\d\-]+)+",
    ],
    "phone": [
        rf"(?:\+?1{_S}?)?\(\d{{3}}\){_S}?\d{{3}}{_S}\d{{4}}(?: ?(?:ext|x)\.? ?\d{{1,5}})?",
        rf"(?:\+?1{_S})?\d{{3}}{_S}\d{{3}}{_S}\d{{4}}(?: ?(?:ext|x)\.? ?\d{{1,5}})?",
        r"\+\d{9,14}",
        rf"(?:\+44{_S}?7|07)\d{{3}}{_S}?\d{{3}}{_S}?\d{{3}}",
        rf"(?:\+44|0044){_S}?\(?0?\)?\d{{2,4}}{_S}\d{{3,4}}{_S}?\d{{3,4}}",
        rf"(?:\+49|0049){_S}?(?:\(0\))?{_S}?\d{{2,4}}{_S}\d{{4,8}}(?:{_S}\d{{1,4}})?",
        rf"(?:\+49|0049){_S}?(?:\(0\))?{_S}?\d{{2,4}}{_S}\d{{5,8}}",
        rf"(?:(?:\+|00)33{_S}?\d|0\d)(?:{_S}\d{{2}}){{4}}",
        rf"(?:\+|00)\d{{1,3}}(?:{_S}?\(?\d{{1,5}}\)?){{2,5}}",
        rf"\(?0\d{{1,4}}\)?{_S}\d{{3,8}}(?:{_S}\d{{3,5}})?",
        rf"\d{{3}}{_S}\d{{3}}{_S}\d{{3}}",
        rf"(?:\+|00)\d{{1,3}}{_S}\d{{5}}{_S}\d{{4,5}}",
    ],
    "id_number": [
        r"\d{3}-\d{2}-\d{4}", r"\d{3} \d{2} \d{4}", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", r"[A-Z]{1,2}\d{6,8}", r"[XYZ]-?\d{7}-?[A-Z]", r"\d{8}-?[A-Z]", r"\d{6}[-+]\d{4}",
        r"[A-Z]\d{3}-\d{4}-\d{4}", r"\d{2}[A-Z]\d{2}-\d{5}", r"\d{2} \d{3} \d{3} \d{3}", r"\d{9,11}", r"[A-Z]{1,3}[ \-]?\d{5,9}[A-Z]?", r"[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?", r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"[A-Z]{2} \d{2} \d{2} \d{2} [A-Z]", r"[A-Z]{2}\d{6}[A-Z]",
    ],
    "address": [
        rf"(?:(?:Flat|Apt\.?|Unit|Suite) \d+\w?, )?\d{{1,5}}[a-z]? (?:(?:NE|NW|SE|SW|N|S|E|W|North|South|East|West)\.? )?(?:{_CAP} ){{1,3}}{_STREET}(?!\p{{L}})(?:, (?:Apt|Suite|Unit|Flat|#)\.? ?\w+)?(?:, {_CITY})?",
        rf"{_CAP}(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer) \d{{1,4}} ?[a-z]?(?!\p{{L}})(?:, \d{{4,5}} {_CITY})?",
        rf"\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|av\.|impasse|boulevard|bd|place|chemin|allée|quai|route|cours) (?:de la |du |des |de l[’']|de |d[’'])?{_CAP}(?: {_CAP}){{0,3}}(?:, \d{{5}} {_CITY})?",
        rf"(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Paseo|Camino|Carrera|Rua|Rúa|Travessa|Via|Viale|Corso|Piazza|ul\.|al\.) ?(?:de los |de las |del |de la |de |do |da |dos )?{_CAP}(?: {_CAP}){{0,3}},? \d{{1,4}}\w?(?:/\d+)?(?:, \d{{1,2}}[º.ª] ?\w)?(?:, (?:\d{{4,5}} )?{_CITY})?",
    ],
}
#: What no match of a kind may stand behind: for telephones also the sign or bracket that would be part of the number.
_BEHIND = {"email": r"(?<![\p{L}\d@])", "phone": r"(?<![\p{L}\d@+])(?<!\((?=\d{1,5}\)))", "id_number": r"(?<![\p{L}\d@])", "address": r"(?<![\p{L}\d])"}
_FIND = {kind: [regex.compile(rf"{_BEHIND[kind]}(?:{f})" + ("" if kind == "address" else r"(?![\p{L}\d])")) for f in formats] for kind, formats in FORMATS.items()}

#: Digits that a match of each format has at least: formats with more than a place has digits are not tried there.
_LEAST_DIGITS = {"phone": (10, 10, 9, 10, 9, 9, 9, 10, 6, 5, 9, 11), "id_number": (9, 9, 6, 6, 7, 8, 10, 11, 9, 11, 9, 5, 13, 11, 6, 6)}
#: What every match of the address format of the same index contains: cheap to look for.
_STREETS = [re.compile(p) for p in (
    r" (?:St|Road|Rd|Ave|Boul|Blvd|Lan|Ln|Dr|Way|Park|Pkwy|Cour|Ct|Clos|Row|Terr|Cres|Pl|Sq|Gard|Mews|Hill)", r"(?:stra(?:ß|ss)e|str\.|weg|platz|allee|gasse|ring|damm|ufer) \d",
    r"\d(?: ?(?:bis|ter))?,? (?:rue|av|impasse|boulevard|bd|place|chemin|allée|quai|route|cours)", r"(?:Calle|C/|Avda|Avenida|Av\.|Plaza|Paseo|Camino|Carrera|R[uú]a|Travessa|Via|Corso|Piazza|ul\.|al\.)",
)]
_DIGIT = re.compile(r"\d")
#: Every telephone and identity number has six digits or more with little between them.
_DIGITS = re.compile("\\d(?:[ .()\\-/\xa0\u202f+A-Z]{0,4}\\d){4,}")

# Words that are rarely part of a name; titles; what firms, posts and places are called; days and months.
COMMON = frozenset(
    "a an and as at about achievements address adresse after all also are author be both build but by call candidate certificate city company completed contact contract cover das day dear der die ein el email en end experience feedback final first for from für good hello he her his home i if in it key kind la last le les location mail main many mobile more "
    "my name new next no note notes now of office on one open or other our over page people phone photo please position product project q question questions read reference references regards role run salary section see sent she signed skills some start steps strong summary tel team terms thank thanks the their then there they this title to today tools together und "
    "up us very via we welcome what when where which who why will wir with work yes yesterday yet you your".split()
)
TITLES = frozenset("dr prof mr mrs ms miss sr sra srta señor señora herr frau mme mlle m sir dame sig dott pan pani".split())
ORG_END = frozenset("ltd gmbh inc sa ag llc bv plc group sons co corp kg foods systems energy mobility analytics logistics robotics media health labs partners bank insurance university institute hospital airlines software holdings consulting foundation council industries solutions technologies school college museum team press committee department office club union association".split())
ROLE_END = frozenset("manager engineer analyst developer assistant researcher designer consultant administrator associate director officer specialist lead intern architect scientist adviser editor nurse president executive writer coordinator technician cook pilot porter owner head chief senior junior vice".split())
PLACES = frozenset("san santa são saint port puerto villa bad los las fort lake mount new north south east west monte cape salt city town valley station bridge tower campus wing market old upper grand place house street road national international central gardens mews avenue lane drive court close terrace suite platform pro".split())
DATES = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december morning afternoon night montag freitag lundi lunes".split())
_TOPICS = frozenset(w.lower() for w in [*TOPIC, *TASK])
_GIVEN, _SURNAME = frozenset(w.lower() for w in GIVEN), frozenset(w.lower() for w in SURNAME)
_PARTICLE = "van|von|der|den|ter|de|la|del|di|da|do|dos|du|el|al|bin|ibn|zu|St\\.|ST\\."
_PARTICLES = frozenset(_PARTICLE.replace("\\", "").split("|"))
_RUN = regex.compile(rf"(?<![\p{{L}}\d@.\-])(?:(?:{_PARTICLE}) ){{0,2}}{_CAP}(?:(?: (?:\p{{Lu}}\.|(?:{_PARTICLE})(?= )|{_CAP}))*)")
# Letters without case: a run after a colon, before a form of address, or of two parts.
_EAST = regex.compile(r"(?<=[:：][ \u3000]?)\p{Lo}[\p{Lo}\p{M}ー]*(?:[ \u3000・]\p{Lo}[\p{Lo}\p{M}ー]*){0,3}|(?<![\p{Lo}\p{M}])\p{Lo}[\p{Lo}\p{M}]{0,5}(?:[ \u3000・]?\p{Lo}[\p{Lo}\p{M}]{0,5}?)?(?=さん|様|氏|先生|殿| ?씨|님)|(?<![\p{Lo}\p{M}])\p{Han}{1,3}[ \u3000・][\p{Han}\p{Hiragana}\p{Katakana}]{1,4}(?![\p{Lo}\p{M}])")
_ANY_EAST = re.compile("[\u0590-\u08ff\u0900-\u0dff\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
# What stands before a name, and what stands behind one, where words are not parted by spaces.
_EAST_LABEL = regex.compile("(?:氏名|名前|担当者?|連絡先|姓名|联系人|負責人|负责人|이름|성명|담당자|الاسم|שם|नाम|ชื่อ)[ \u3000]?[:：]?[ \u3000]?$")
_EAST_ADDRESSED = regex.compile("さん|様|氏|先生|殿| ?씨|님")
_WORD = regex.compile(r"\S+")
_TWO_WORDS = regex.compile(rf"(?<=, (?:\d+ )?{_CAP}) {_CAP}$")
_COMMA = regex.compile(rf", ({_CAP})(?: \p{{Lu}}\.)?")

# Words and phrases that stand before an item, by kind of clue; each kind is a feature.
_CLUES = (
    "name|contact|kontakt|contacto|contatto|attn|attention|signed|signature|author|candidate|referee|reference|references|supervisor|manager|employee|applicant|patient|customer|client|tenant|witness|teacher|instructor|doctor|owner|buyer|guest|editor|nom|nombre|nome|vorname|nachname|ansprechpartner|verfasser|responsable|nazwisko|person|panel|speaker|joindre|cc|full name",
    "|".join(TITLES), "dear|hi|hello|hallo|liebe|lieber|estimado|estimada|cher|chère|regards|wishes|sincerely|geehrter|geehrte",
    "signed by|written by|led by|taught by|approved by|reviewed by|interviewed by|mentored by|reported to|introduced to|ask for|asking for|spoke to|spoke with|thanks to|together with|according to|behalf of|memory of|met|ask|call|called|hired|told|thank|welcome",
    "by|with|for|mit|von|par|avec|con|por|para|für|z|od", "from|to|until|since|between|between|bis|a|à|da", "and|und|et|y|e|or|oder|ou|i", "at|in|on|of|auf|en|im|into|near", "the|a|an|this|that|our|my|their|its|der|die|das|le|la|les|el|los|un|une|ein|eine|l’équipe|each|every",
    "phone|tel|telephone|telefon|tél|téléphone|teléfono|telefone|telefono|móvil|mobil|mobile|cell|call|ring|dial|text|fax|whatsapp|handy|office|number|hotline|ph|t|f|unter|au|under|appelez|call us|us on",
    "ssn|security|nino|insurance|passport|id|ids|card|nie|dni|nif|pesel|cpf|personnummer|personalausweis|ausweisnummer|ausweis|licence|license|steuer-id|tax|identity|passeport|reisepass|pasaporte|security number|insurance number|passport number|identity number|id number|tax id|is", "registered|verified|holder|record|file|passed|check|form|noted|permit|as|quoting",
    "address|adresse|dirección|indirizzo|anschrift|lives at|live at|living at|domicilio|residence|resident of|resides at|wohnt|wohnhaft|vive|j'habite|moved to|ship to|went to|stopped at|visit us|billing|home|in der|location|delivered to|flat at", "mailto|email|e-mail|mail|courriel|correo|reply-to|write to|sender|login|uses|forwarded from|sent to",
    "isbn|code|ticket|tickets|order|version|invoice|port|batch|hash|build|commit|budget|grid|eur|€|$|£|lot|serial|sku|part|room|form|page|p|chapter|bus|ip|total|certificate|ref|score|sla|latency|ratio|v", "company|title|role|position|employer|firma|city|ort|place|based in|skills|tools|project|product|course|courses|diploma|strengths|certified in|certificate of|knows|learned|used|experience|conhecimentos|puesto|stanowisko|entreprise",
)
_NUMBERED = frozenset(("no", "nr", "number", "n°", "#"))
_BEFORE: dict[str, list[int]] = {}
for _k, _group in enumerate(_CLUES):
    for _phrase in _group.split("|"):
        _BEFORE.setdefault(_phrase, []).append(_k)
_CALLS = frozenset("|".join(_CLUES[1:3]).split("|"))
_SIGNS = ":,;|(<.-/@\"•"
# Words that stand after an item, by kind.
_NEXT = {w: k for k, group in enumerate(("eur usd gbp € rows records guests invoices users % months days people requests pixels units ms", "who dated has hat had is was will said wrote called sent left agreed a llamó kam", "by since willing", "ltd gmbh inc sa ag llc bv group", "and und et y", "at au in on from of to for about")) for w in group.split()}
_LISTS = ("skills", "tools", "technologies", "stack", "experience", "knows", "strong", "strengths", "course", "certif", "learned", "budget", "nice to have", "isbn", "version", "total")
_ABSTRACT = regex.compile(r"(?:ing|tion|sion|ment|ance|ence|ity|ics|sis|ware|base|ness|ship|ure|sign|on|graphs?|ers|ies|tems?|ory|form|face|work|code|script|sql|api|control|security|review|lake|data|cloud|web|services?|vision|boot|css|excel|studio|report|project|festival|handbook|award|suite|platform|points|notes|steps|dates)$", regex.I)
WINDOW = 40


def _usual(word: str) -> tuple[float, float]:
    """How early a public vocabulary has the word in lower case, and with a capital: common nouns the one, names the other."""
    known = tokens.ranks(tokens.rank_file())
    parts = [p for p in word.split("-") if p] or [word]
    return tuple(sum(math.log2(1 + known.get(f" {w}".encode(), 200_000)) for w in ws) / len(parts) for ws in (parts, [p.capitalize() for p in parts]))


class _Words(dict):
    """Word as written to what is known of it; forgets all when it has grown large."""

    def __missing__(self, word: str) -> tuple[float, ...]:
        if len(self) > 200_000:
            self.clear()
        w = word.lower().strip(".,;:()'’\"").removesuffix("’s").removesuffix("'s")
        parts = w.split("-")
        self[word] = known = (
            float(w in COMMON), float(w in TITLES), float(w in ORG_END), float(w in ROLE_END), float(w in PLACES), float(w in DATES), float(bool(_ABSTRACT.search(w))), float(parts[0] in _GIVEN), float(parts[-1] in _SURNAME or w.replace("’", "'") in _SURNAME),
            float(word.strip(",") in _PARTICLES), float(len(word) == 2 and word[1] == "."), float(len(w) > 1 and word.isupper()), float(any(c in "0123456789&/" for c in w)), float(any(p in _TOPICS for p in parts)), float(w.endswith(("ed", "ing"))), *_usual(w),
        )
        return known


_KNOWN = _Words()


def _before_features(text: str, start: int) -> list[float]:
    before = text[max(0, start - WINDOW) : start]
    bare = before.rstrip(" \t\xa0")
    last = bare[-1:] if bare else "\n"
    words = [w.strip(":,;|(<.") for w in bare.lower().rsplit(None, 4)[-4:]]
    words = [w for w in words if w]
    clue = [0.0] * len(_CLUES)
    numbered = bool(words) and words[-1] in _NUMBERED
    if last != "\n":
        for tail in (words[:-1], words) if numbered else (words,):
            for n in (1, 2):
                for k in _BEFORE.get(" ".join(tail[-n:]), ()) if len(tail) >= n else ():
                    clue[k] = 1.0
    sign = [0.0] * (len(_SIGNS) + 1)
    sign[_SIGNS.find(last)] = 1.0
    cut = max(text.rfind("\n", 0, start), text.rfind(". ", 0, start), start - 200, 0)
    line = text[cut:start].lower()
    firm = last == "," and bool(words) and words[-1] in ORG_END
    head = not line.strip(" \n.-•*")
    return [*clue, *sign, float(numbered), float(firm), float(head), float(any(w in line for w in _LISTS)), float(before[-1:].isupper() or bare[-1:].isalpha() and last != "\n" and words[-1:] and text[max(0, start - len(words[-1]) - 1)].isupper()), float(bool(_EAST_LABEL.search(before)))]


def _after_features(text: str, end: int) -> list[float]:
    after = text[end : end + 20]
    stripped = after.lstrip(" ")
    first = stripped[:1]
    word = stripped.split(None, 1)[0].lower().strip(".,;:)") if stripped.strip() else ""
    kinds = [0.0] * 6
    if word in _NEXT:
        kinds[_NEXT[word]] = 1.0
    return [
        *kinds, float(after[:1] in "-/" and after[1:2].isdigit()), float(first in ":("), float(first in ".,;)"), float(first in ("", "\n")), float(first == "|"), float(first == "&"), float(first.isupper()), float(first.islower()), float(first.isdigit()),
    ]


@dataclass(frozen=True)
class Candidate:
    kind: int
    start: int
    end: int
    format: int


def candidates(text: str) -> list[Candidate]:
    """Overlapping spans that may be personal information."""
    out: set[tuple[int, int, int, int]] = set()
    for f, hints in enumerate((("@", "(at", "[at", "(AT", "[AT", "( at", "[ at"), (" dot ", " DOT "))):
        if any(h in text for h in hints):
            out.update((0, m.start(), m.end(), f) for m in _FIND["email"][f].finditer(text))
    if _DIGIT.search(text):
        for f, p in enumerate(_FIND["address"]):
            if _STREETS[f].search(text):
                for m in p.finditer(text):
                    out.add((3, m.start(), m.end(), f))
                    if two := _TWO_WORDS.search(m.group()):  # the second may belong to the next sentence
                        out.add((3, m.start(), m.start() + two.start(), f))
        for near in _DIGITS.finditer(text):
            a, b = max(0, near.start() - 8), min(len(text), near.end() + 16)
            n = sum(map(str.isdigit, text[a:b]))
            for k, kind in ((1, "phone"), (2, "id_number")):
                for f, (p, least) in enumerate(zip(_FIND[kind], _LEAST_DIGITS[kind], strict=True)):
                    if n >= least:
                        out.update((k, m.start(), m.end(), f) for m in p.finditer(text, a, b))
    if _ANY_EAST.search(text):
        for m in _EAST.finditer(text):
            words = m.group().replace("\u3000", " ").split(" ")
            for n in range(1, len(words) + 1):
                out.add((4, m.start(), m.start() + sum(map(len, words[:n])) + n - 1, 6 + min(n, 2)))
    before, stop = "", -9  # the last word of the run before, and where it ends
    for m in _RUN.finditer(text):
        run, at = m.group(), m.start()
        called = before in _CALLS and text[stop:at] in (" ", ". ", ".")
        stop, comma = m.end(), None
        if text.startswith(", ", stop):
            comma = _COMMA.match(text, stop)
        if not comma and " " not in run:  # one word is no name unless a title, a greeting or a clue and the word itself say so
            before = run.lower()
            if called or (before in _GIVEN and _asked(text, at)):
                out.add((4, at, stop, 0))
            continue
        before = run.rsplit(" ", 1)[-1].lower()
        words, place = [], at
        for w in run.split(" "):
            words.append((place, place + len(w), w))
            place += len(w) + 1
        n = len(words)
        for s in range(n):
            head = words[s][2]
            if len(head) == 2 and head[1] == ".":
                continue
            if called if s == 0 else words[s - 1][2].lower() in _CALLS:
                out.add((4, words[s][0], words[s][1], 0))
            for e in range(s + 1, min(n, s + 6)):
                w = words[e][2]
                if w[-1] != "." and w[0].isupper():
                    out.add((4, words[s][0], words[e][1], min(3, e - s)))
            if comma and n - s <= 4:
                out.add((4, words[s][0], comma.end(), 4))
    return [Candidate(*c) for c in sorted(out, key=lambda c: (c[1], c[2], c[0]))]


def _asked(text: str, start: int) -> bool:
    """Whether a clue to a person stands directly before."""
    words = text[max(0, start - WINDOW) : start].lower().split()
    return any(3 in _BEFORE.get(" ".join(words[-n:]).strip("(\"'-•:,"), ()) for n in (1, 2) if len(words) >= n)


def _own(texts: list[str], spots: list[tuple[int, Candidate]]) -> np.ndarray:
    """What the candidates themselves look like, as numbers: their format, signs and words."""
    ids: dict[str, int] = {}
    words: list[int] = []
    first, rows = [], []
    for i, c in spots:
        text = texts[i]
        span = text[c.start : c.end]
        parts = span.split(" ")
        first.append(len(words))
        words += [ids.setdefault(w, len(ids)) for w in parts]
        name = c.kind == 4
        head = span[0]
        after = text[c.end : c.end + 2]
        before = text[c.start - 1] if c.start else " "
        rows.append((
            c.kind, c.kind * 20 + c.format, len(span), 0 if name else sum(map(str.isdigit, span)), len(parts), head == "+", head == "(", span[:2] == "00", head == "0", "." in span, "-" in span, "," in span, span.isupper(),
            before.isalnum() or before in "-/.", after[:1] in ("-", "/") and after[1:2].isdigit(), len(parts[-1]), len(parts[0]), name and c.format > 6 and bool(_EAST_ADDRESSED.match(text, c.end)),
        ))
    known = np.array([_KNOWN[w] for w in ids], np.float32)
    words, first = np.array(words), np.array(first)
    last = np.r_[first[1:], len(words)] - 1
    return np.hstack([np.array(rows, np.float32), np.add.reduceat(known[words], first, axis=0), known[words[first]], known[words[last]]])


def _around(texts: list[str], spots: list[tuple[int, Candidate]]) -> np.ndarray:
    """What stands before and after the candidates, as numbers; those of a text that start or end alike share them."""
    before: dict[tuple[int, int], list[float]] = {}
    after: dict[tuple[int, int], list[float]] = {}
    rows = []
    for i, c in spots:
        if (b := before.get((i, c.start))) is None:
            b = before[i, c.start] = _before_features(texts[i], c.start)
        if (a := after.get((i, c.end))) is None:
            a = after[i, c.end] = _after_features(texts[i], c.end)
        rows.append(b + a)
    return np.array(rows, np.float32)


@dataclass
class Detector:
    sieve: boosting.Boosted  # on what the candidates look like alone
    least: float
    model: boosting.Boosted
    thresholds: list[float]
    held_out: dict[str, tuple[float, float]]  # kind: precision, recall on the held-out sentences

    def scored(self, texts: list[str]) -> tuple[list[tuple[int, Candidate]], np.ndarray]:
        """The candidates that the sieve lets through and their probabilities."""
        spots = [(i, c) for i, t in enumerate(texts) for c in candidates(t)]
        if not spots:
            return [], np.zeros(0)
        own = _own(texts, spots)
        keep = np.flatnonzero(self.sieve.probability(own) >= self.least)
        spots = [spots[k] for k in keep]
        return spots, self.model.probability(np.hstack([own[keep], _around(texts, spots)])) if spots else np.zeros(0)

    def find_all(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Per text the chosen spans (kind, start, end): most probable first, none overlapping, in order of position."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        spots, p = self.scored(texts)
        for chosen in _select(spots, p, self.thresholds):
            i, c = spots[chosen]
            out[i].append((KINDS[c.kind], c.start, c.end))
        for spans in out:
            spans.sort(key=lambda s: s[1])
        return out


def _class(c: Candidate) -> int:
    """What shares a threshold: the kind, but names written with a comma apart, which lists of other words resemble."""
    return len(KINDS) if c.kind == 4 and c.format == 4 else c.kind


def _select(spots: list[tuple[int, Candidate]], p: np.ndarray, thresholds: list[float]) -> list[int]:
    """Indices of the candidates above their kind's threshold that no better one overlaps; longer ones are better among near equals."""
    good = [k for k, (_, c) in enumerate(spots) if p[k] >= thresholds[_class(c)]]
    good.sort(key=lambda k: (-round(float(p[k]), 2), -(spots[k][1].end - spots[k][1].start), spots[k][1].start))
    taken: dict[int, list[tuple[int, int]]] = {}
    out = []
    for k in good:
        i, c = spots[k]
        if all(c.end <= s or c.start >= e for s, e in taken.get(i, [])):
            taken.setdefault(i, []).append((c.start, c.end))
            out.append(k)
    return out


def _labelled(count: int, seed: int) -> tuple[list[str], list[set], list[tuple[int, Candidate]], np.ndarray]:
    data = list(sentences(count, seed))
    texts = [t for t, _ in data]
    right = [{(KINDS.index(k), s, e) for k, s, e in spans} for _, spans in data]
    spots = [(i, c) for i, t in enumerate(texts) for c in candidates(t)]
    return texts, right, spots, np.array([float((c.kind, c.start, c.end) in right[i]) for i, c in spots])


@functools.lru_cache(1)
def detector() -> Detector:
    """Trained on TRAIN_SENTENCES invented sentences, calibrated on half of the held-out ones, thresholds for the best F-measure (BETA) on the rest.

    A first, small model sees only the candidates themselves and drops those that no context can make an item: all that it
    finds less likely than all but SIEVED of the items it was not trained on.
    """
    texts, _, spots, y = _labelled(TRAIN_SENTENCES, SEED)
    own = _own(texts, spots)
    sieve = boosting.train(own, y, rounds=25, depth=4)
    model = boosting.train(np.hstack([own, _around(texts, spots)]), y, rounds=ROUNDS, depth=5)
    texts, _, spots, y = _labelled(HELD_OUT_SENTENCES // 2, SEED + 1)
    own = _own(texts, spots)
    model.calibrate(np.hstack([own, _around(texts, spots)]), y)
    found = Detector(sieve, float(np.quantile(sieve.probability(own[y > 0]), SIEVED)), model, [0.5] * (len(KINDS) + 1), {})
    texts, right, _, _ = _labelled(HELD_OUT_SENTENCES // 2, SEED + 2)
    spots, p = found.scored(texts)
    for k in range(len(found.thresholds)):
        best = (-1.0, 0.5, 0.0, 0.0)
        real = {(i, s) for i, spans in enumerate(right) for kind, s, e in spans if kind == min(k, 4) and (kind < 4 or ("," in texts[i][s:e]) == (k > 4))}
        for cut in np.arange(0.1, 0.95, 0.05):
            trial = [2.0] * len(found.thresholds)
            trial[k] = cut
            got = {(spots[j][0], spots[j][1].start) for j in _select(spots, p, trial)}
            hit = len(got & real)
            f = (1 + BETA**2) * hit / max(1, len(got) + BETA**2 * len(real))
            best = max(best, (f, float(cut), hit / max(1, len(got)), hit / max(1, len(real))), key=lambda b: (round(b[0], 3), -b[1]))
        found.thresholds[k], found.held_out[(*KINDS, "name with comma")[k]] = best[1], best[2:]
    return found


_LOADED: dict[str, Detector] = {}


def _mapped(rows: DataFrame, schema: str, make) -> DataFrame:
    """``make(record ids, texts, spans)`` over all rows of (record_id, text), with the detector broadcast (some 100 KB)."""
    shared = rows.sparkSession.sparkContext.broadcast(detector())
    ident = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ident not in _LOADED:
            _LOADED.clear()
            _LOADED[ident] = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, BATCH):
                part = batch.slice(s, BATCH)
                texts = part.column(1).to_pylist()
                made = make(part.column(0).to_pylist(), texts, _LOADED[ident].find_all(texts))
                if made.num_rows:
                    yield made

    return rows.mapInArrow(run, schema)


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(key).cast("string").alias("record_id"), F.col(text).cast("string").alias("text"))
    return rows.where("record_id is not null and length(text) > 0").distinct()


def find_personal(df: DataFrame, key: str, text: str) -> DataFrame:
    """(record_id, kind, start_pos, end_pos) of every item of personal data; positions are code points in the stored text.

    Generators propose overlapping spans by public formats (e-mail, telephone, identity number, street address) and
    by runs of capitalised words (names); boosted trees judge each by its format and what stands around it; spans
    above their kind's threshold are kept, the most probable of overlapping ones. The trees are trained on invented
    sentences, a fixed number. Labels and titles are not part of an item.

    Null keys and texts and empty texts have no rows; repeated rows count once; a text without items has no row; an
    empty table gives no rows; other columns are not read; texts of any length are read whole.
    """

    def make(ids, texts, spans):
        rows = [(i, *s) for i, found in zip(ids, spans, strict=True) for s in found]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["record_id", "kind", "start_pos", "end_pos"])

    return _mapped(_rows(df, key, text), "record_id string, kind string, start_pos int, end_pos int", make)


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(record_id, redacted, items): every text with typed placeholders for its items, all else unchanged; see find_personal."""

    def make(ids, texts, spans):
        out = []
        for t, found in zip(texts, spans, strict=True):
            parts, at = [], 0
            for kind, s, e in found:
                parts += [t[at:s], PLACEHOLDER[kind]]
                at = e
            out.append("".join([*parts, t[at:]]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string()), pa.array([len(f) for f in spans], pa.int32())], ["record_id", "redacted", "items"])

    return _mapped(_rows(df, key, text), "record_id string, redacted string, items int", make)
