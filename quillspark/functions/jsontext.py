"""Reading JSON that a model wrote: fences, trailing commas, misplaced enum values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the two enums.
CATEGORIES = ("technical", "experience", "education", "certification", "soft_skill", "location", "work_authorization", "other")
IMPORTANCE = ("required", "preferred", "nice_to_have", "unknown")
# Words in a text that decide its category, in order of precedence.
CATEGORY_WORDS = (
    ("education", ("degree", "bachelor", "master", "phd", "education")),
    ("certification", ("certification", "certified", "certificate")),
    ("work_authorization", ("work authorization", "authorized to work", "sponsorship")),
    ("location", ("location", "onsite", "on-site", "hybrid", "remote")),
)


def json_object(c: Column) -> Column:
    """From the first { to the last } of the text inside an optional code fence; the bare text if there are none."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^```[^\n]*\n?", ""), r"\n?```\s*$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner).otherwise(bare)


def without_trailing_commas(c: Column) -> Column:
    """Commas directly before } or ] dropped, those inside strings kept."""
    return F.regexp_replace(c, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")


def parsed(c: Column, schema: str) -> Column:
    """The struct, read after repair if the text can't be read as it stands; null when it still can't."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    full = f"{schema}, _bad string"
    first = F.from_json(json_object(c), full, options)
    second = F.from_json(without_trailing_commas(json_object(c)), full, options)
    return F.when(first["_bad"].isNull() & first.isNotNull(), first).when(second["_bad"].isNull() & second.isNotNull(), second)


def inferred_category(text: Column, skills: Column, years: Column) -> Column:
    """Years mean experience, any skill technical, else the first group of words found anywhere in the text."""
    out = F.when(years.isNotNull(), "experience").when(F.exists(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.coalesce(F.trim(s), F.lit("")) != ""), "technical")
    low = F.lower(F.coalesce(text, F.lit("")))
    for category, words in CATEGORY_WORDS:
        out = out.when(low.rlike("|".join(words)), category)
    return out.otherwise("other")


def repair_enums(df: DataFrame) -> DataFrame:
    """category and importance with values that stand in each other's place moved; needs text, skills, years_experience."""
    swapped = F.col("category").isin(*IMPORTANCE)
    known = F.coalesce(F.col("importance").isin(*IMPORTANCE), F.lit(False))
    first = df.withColumns({
        "importance": F.when(swapped & (~known | (F.col("importance") == "unknown")), F.col("category")).otherwise(F.col("importance")),
        "category": F.when(swapped, inferred_category(F.col("text"), F.col("skills"), F.col("years_experience"))).otherwise(F.col("category")),
    })
    moved = F.col("importance").isin(*CATEGORIES)
    right = F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))
    return first.withColumns({"category": F.when(moved & ~right, F.col("importance")).otherwise(F.col("category")), "importance": F.when(moved, "unknown").otherwise(F.col("importance"))})
