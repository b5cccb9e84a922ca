"""Text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and line ends, written so that Java and RE2 regular expressions read them alike.
SPACE_NO_LF = r"\t\x{0b}-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = rf"[\n{SPACE_NO_LF}]"
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
TOKEN = "[A-Za-z0-9][A-Za-z0-9_+.#/-]*"
# Verbs that name an action, and phrases that say nothing.
ACTION = (
    r"(?i)\b(built|developed|designed|implemented|automated|tested|deployed|integrated|optimized|created|maintained|investigated|configured|improved|led|supported|documented|analyzed|engineered|reduced|authored|wrote|delivered)\b"
)
FILLER = r"(?i)\b(detail.oriented|passionate|demonstrat(?:ed|ing)\s+(?:technical\s+)?proficiency|familiar with|highly skilled)\b"
# Months, words for no value, LaTeX's characters, prefixes of entity ids.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
NO_VALUE = ("none", "null", "n/a", "na")
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
PREFIXES = {"experience": ("exp", ("exp_", "experience_")), "project": ("proj", ("proj_", "project_")), "education": ("edu", ("edu_", "education_")), "certification": ("cert", ("cert_", "certification_"))}


def strip(c: Column) -> Column:
    """Without white space at either end; any Unicode white space counts."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def fold_case(c: Column) -> Column:
    """Lower case with ß as ss: case folding for Latin text."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def clean(c: Column) -> Column:
    """Every line stripped, runs of blank lines cut to one, the whole stripped."""
    unix = F.regexp_replace(c, LINE_END, "\n")
    return strip(F.regexp_replace(F.regexp_replace(unix, f"[{SPACE_NO_LF}]*\n[{SPACE_NO_LF}]*", "\n"), "\n{3,}", "\n\n"))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that stands once in the plan, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def clean_inline(c: Column) -> Column:
    """One line: stripped, one wrapping pair each of ** __ * peeled off in that order, white space runs to one space."""
    def peeled(mark: str) -> Callable[[Column], Column]:
        k = len(mark)
        return lambda x: F.when(x.startswith(mark) & x.endswith(mark) & (F.length(x) > 2 * k), strip(x.substr(F.lit(k + 1), F.length(x) - 2 * k))).otherwise(x)

    s = strip(c)
    for mark in ("**", "__", "*"):
        s = let(s, peeled(mark))
    return F.regexp_replace(s, f"{SPACE}+", " ")


def without_front_matter(c: Column) -> Column:
    """Without a leading block between two lines of three hyphens; an open block is kept."""
    return F.regexp_replace(c, r"(?s)^---[ \t]*\n(.*?\n)?---[ \t]*(\n|$)", "")


def heading(c: Column) -> tuple[Column, Column]:
    """(level or null, title) of a Markdown heading line."""
    s = strip(c)
    level = F.length(F.regexp_extract(s, r"^(#{1,6})\s+\S", 1))
    return F.when(level > 0, level), F.when(level > 0, F.regexp_extract(s, r"^#{1,6}\s+(.+?)\s*$", 1))


def field(c: Column) -> tuple[Column, Column]:
    """(folded key or null, value) of a "Key: value" line, split at the first colon."""
    s = strip(c)
    hit = s.rlike(r"^[A-Za-z][^:]*:")
    return F.when(hit, fold_case(strip(F.regexp_extract(s, r"^([A-Za-z][^:]*):", 1)))), F.when(hit, strip(F.regexp_extract(s, r"(?s)^[A-Za-z][^:]*:(.*)$", 1)))


def list_item(c: Column) -> Column:
    """The text of a "- " or "* " line; null for other lines and for none, n/a, na."""
    s = strip(c)
    item = strip(F.regexp_extract(s, r"(?s)^[-*] (.*)$", 1))
    return F.when(s.rlike("^[-*] ") & (item != "") & ~F.lower(item).isin("none", "n/a", "na"), item)


def scalar(c: Column) -> Column:
    """Stripped; null for blank text and for none, null, n/a, na."""
    s = strip(c)
    return F.when((s != "") & ~F.lower(s).isin(*NO_VALUE), s)


def slug(c: Column) -> Column:
    """Folded, other than a-z and digits to single underscores, none at the ends; "entity" where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(fold_case(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "entity").otherwise(s)


def entity_id(kind: str, c: Column) -> Column:
    """The slug, with the prefix of its kind unless it has one."""
    short, known = PREFIXES[kind]
    s = slug(c)
    has = F.lit(False)
    for p in known:
        has = has | s.startswith(p)
    return F.when(has, s).otherwise(F.concat(F.lit(f"{short}_"), s))


def tokens(c: Column) -> Column:
    """Search tokens in order: letters and digits with _ + . # / - inside, lower case; null text has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null and blank text."""
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), f"{SPACE}+", " ")
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def card_text(claim: Column, category: Column, skills: Column, metrics: Column) -> Column:
    """Claim, category, skills and metrics as lines; empty parts are left out."""
    shown = F.filter(F.transform(skills, strip), lambda s: s.isNotNull() & (s != ""))

    def metric(m: Column) -> Column:
        pair = F.regexp_replace(F.concat(F.coalesce(m["name"], F.lit("")), F.lit(": "), F.coalesce(m["value"], F.lit(""))), "^[: ]+|[: ]+$", "")
        return F.when(F.coalesce(m["context"], F.lit("")) != "", F.concat(pair, F.lit(" ("), m["context"], F.lit(")"))).otherwise(pair)

    said = F.filter(F.transform(metrics, metric), lambda s: s != "")
    return F.concat_ws(
        "\n",
        F.when(F.coalesce(claim, F.lit("")) != "", claim),
        F.when(F.coalesce(category, F.lit("")) != "", F.concat(F.lit("Category: "), category)),
        F.when(F.size(shown) > 0, F.concat(F.lit("Skills: "), F.array_join(shown, ", "))),
        F.when(F.size(said) > 0, F.concat(F.lit("Metrics: "), F.array_join(said, "; "))),
    )


def bullet_text(c: Column) -> Column:
    """Stripped, the leading marks "- ", "• ", "* " peeled off in that order."""
    return strip(F.regexp_replace(strip(c), r"^(- )?(• )?(\* )?", ""))


def latex(c: Column) -> Column:
    """clean_inline with LaTeX's ten special characters escaped in one pass."""
    pairs = F.create_map(*[F.lit(x) for kv in LATEX.items() for x in kv])
    return F.array_join(F.transform(F.split(clean_inline(c), ""), lambda ch: F.coalesce(F.try_element_at(pairs, ch), ch)), "")


def date_label(c: Column) -> Column:
    """"2021-03" as "Mar 2021"; anything else, and months that don't exist, unchanged."""
    names = F.array(*[F.lit(m) for m in MONTHS])

    def label(x: Column) -> Column:
        month = F.regexp_extract(x, r"^\d{4}-(\d{2})$", 1).try_cast("int")
        ok = x.rlike(r"^\d{4}-(0[1-9]|1[0-2])$") & ~x.startswith("0000")
        return F.when(ok, F.concat(F.try_element_at(names, month), F.lit(" "), F.substring(x, 1, 4))).otherwise(x)

    return let(c, label)


def source_label(entity: Column, source_file: Column) -> Column:
    """The entity, or else the file's stem, with _ and - as spaces, with a capital after everything that is no letter."""
    name = F.element_at(F.split(F.coalesce(source_file, F.lit("")), "/"), -1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    raw = F.when(F.coalesce(entity, F.lit("")) != "", entity).otherwise(stem)
    chars = F.split(F.lower(F.regexp_replace(raw, "[_-]", " ")), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) | ~F.element_at(chars, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")


def search_query(text: Column, skills: Column) -> Column:
    """The text, followed by its skills where there are any."""
    return F.when(F.size(F.coalesce(skills, F.array())) > 0, F.concat(text, F.lit(". Skills: "), F.array_join(skills, ", "))).otherwise(text)


def years(c: Column) -> Column:
    """The first number of a text as double: the lower end of a range; null without one."""
    return F.regexp_extract(c, r"(\d+(\.\d+)?)", 1).try_cast("double")


def years_problem(c: Column) -> Column:
    """Why a text states no years: null for a number, for null and for words for no value; booleans and texts without a number are wrong."""
    s = F.lower(strip(c))
    return F.when(s.isNull() | (s == "") | s.isin(*NO_VALUE), F.lit(None)).when(s.isin("true", "false"), "a truth value").when(years(c).isNull(), "no number")


def hash_id(prefix: str, length: int, *parts: Column, by: str = ":") -> Column:
    """A prefix and the first hex digits of the SHA-256 of the parts."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws(by, *parts), 256), 1, length))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold_case(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words of two word sets by all their words; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def distinct_folded(arr: Column) -> Column:
    """Stripped non-empty strings, the first spelling of each up to case, in order; null arrays are empty."""
    kept = F.filter(F.transform(F.coalesce(arr, F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))
    folded = F.transform(kept, fold_case)
    return F.filter(kept, lambda x, i: F.array_position(folded, fold_case(x)) == i + 1)


def metrics_complete(arr: Column) -> Column:
    """The metrics whose name and value are neither null nor blank; null arrays are empty."""
    some = F.coalesce(arr, F.array().cast("array<struct<name:string,value:string,context:string>>"))
    return F.filter(some, lambda m: (F.coalesce(strip(m["name"]), F.lit("")) != "") & (F.coalesce(strip(m["value"]), F.lit("")) != ""))
