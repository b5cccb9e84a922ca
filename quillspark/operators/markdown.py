"""Structured Markdown files as entities: blocks under second-level headings, with fields, sections and list items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import text as T

#: Files with a known structure.
CANONICAL = ("profile.md", "experience.md", "projects.md")
CONTACTS = ("name", "email", "phone", "location", "linkedin", "github")


def is_canonical(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1)).isin(*CANONICAL)


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, pos, line) without front matter; every kind of line end counts."""
    unix = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), T.LINE_END, "\n")
    return files.where("text is not null").select("path", F.posexplode(F.split(T.without_front_matter(unix), "\n")).alias("pos", "line"))


def structured(lines: DataFrame) -> DataFrame:
    """Lines with block (number of the second-level heading above), section (of the third-level one in it) and titles.

    Windows run within a file: files are parsed whole, as entities depend on the lines above them.
    """
    level, title = T.heading(F.col("line"))
    w = Window.partitionBy("path").orderBy("pos")
    marked = lines.withColumns({"level": level, "title": title})
    blocks = marked.withColumn("block", F.sum((F.coalesce("level", F.lit(0)) == 2).cast("int")).over(w))
    v = Window.partitionBy("path", "block").orderBy("pos")
    return blocks.withColumns({
        "block_title": F.last(F.when(F.col("level") == 2, F.col("title")), True).over(v),
        "section": F.sum((F.coalesce("level", F.lit(0)) == 3).cast("int")).over(v),
        "section_title": F.last(F.when(F.col("level") == 3, F.col("title")), True).over(v),
    })


def entity_blocks(lines: DataFrame) -> DataFrame:
    """(path, block, block_title, fields map, sections map, text): per block its fields before the first section, the last of
    equal keys, and the lines of its sections, those of equal titles joined. Lines before the first block are left out."""
    s = structured(lines).where("block > 0")
    key, value = T.field(F.col("line"))
    fields = (
        s.where("section = 0 and level is null").withColumns({"k": key, "v": value}).where("k is not null")
        .groupBy("path", "block", "k").agg(F.max_by("v", "pos").alias("v"))
        .groupBy("path", "block").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))
    )
    sections = (
        s.where("section > 0 and coalesce(level, 0) not in (2, 3)").withColumn("k", T.fold_case(F.col("section_title")))
        .groupBy("path", "block", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("v"))
        .groupBy("path", "block").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("sections"))
    )
    shown = F.when(F.col("level") == 3, F.concat(F.lit("### "), F.col("title"))).when(F.coalesce("level", F.lit(0)) != 2, F.rtrim("line"))
    body = s.withColumn("shown", shown).where("shown is not null").groupBy("path", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]), "\n").alias("text")
    )
    heads = s.groupBy("path", "block").agg(F.first("block_title").alias("block_title"))
    return (
        heads.join(fields, ["path", "block"], "left").join(sections, ["path", "block"], "left").join(body, ["path", "block"], "left")
        .withColumns({"fields": F.coalesce("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), "text": T.clean(F.coalesce("text", F.lit("")))})
    )


def _get(*names: str) -> Column:
    return F.coalesce(*[T.scalar(F.try_element_at("fields", F.lit(n))) for n in names])


def _items(*names: str) -> Column:
    lines = F.coalesce(*[F.try_element_at("sections", F.lit(n)) for n in names], F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(lines, T.list_item), lambda x: x.isNotNull()))


def experience_entities(lines: DataFrame) -> DataFrame:
    """One row per block of an experience file; ``problem`` names a required field that is missing."""
    b = entity_blocks(lines).where(T.fold_case(F.col("block_title")) != "experience")
    return b.select(
        "path", "block", T.entity_id("experience", F.col("block_title")).alias("entity_id"), F.lit("experience").alias("entity_type"), "text",
        _get("company").alias("company"), _get("title").alias("title"), _get("location").alias("location"), _get("start", "start date").alias("start_date"), _get("end", "end date").alias("end_date"),
        F.when(_get("company").isNull(), "company").when(_get("title").isNull(), "title").alias("problem"),
    )


def project_entities(lines: DataFrame) -> DataFrame:
    """One row per block of a projects file; technologies are the distinct list items of that section, in order."""
    b = entity_blocks(lines).where(T.fold_case(F.col("block_title")) != "projects")
    return b.select(
        "path", "block", T.entity_id("project", F.col("block_title")).alias("entity_id"), F.lit("project").alias("entity_type"), "text",
        _get("name").alias("name"), _get("type", "project type").alias("project_type"), _get("repository").alias("repository"), _get("date", "year").alias("date"), _items("technologies").alias("technologies"),
        F.when(_get("name").isNull(), "name").alias("problem"),
    )


def _metadata(**columns: Column) -> Column:
    """The metadata struct of a document, null where nothing is said."""
    fields = re.findall(r"(\w+):(array<string>|string)", schemas.METADATA)
    return F.struct(*[(columns[n] if n in columns else F.lit(None)).cast(k).alias(n) for n, k in fields])


def _lines_of(**columns: Column) -> list[Column]:
    return [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}: "), c)) for k, c in columns.items()]


def profile_sections(lines: DataFrame) -> DataFrame:
    """One row per profile file: contact fields, summary as one line, skills; a file without any of them still has a row."""
    s = structured(lines)
    title = T.fold_case(F.coalesce("block_title", F.lit("")))
    key, value = T.field(F.col("line"))
    first = s.where("block > 0").groupBy("path", title.alias("part")).agg(F.min("block").alias("block"))
    own = s.where("block > 0").withColumn("part", title).join(first, ["path", "part", "block"])
    contact = own.where("part = 'contact'").withColumns({"k": key, "v": T.scalar(value)}).where(F.col("k").isin(*CONTACTS))
    contacts = contact.groupBy("path").agg(*[F.max_by(F.when(F.col("k") == c, F.col("v")), F.when(F.col("k") == c, F.col("pos"))).alias(c) for c in CONTACTS])
    said = own.where("part = 'professional summary' and level is null").withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    summary = said.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("summary"))
    listed = own.where("part = 'skills'").withColumn("item", T.list_item(F.col("line"))).where("item is not null")
    skills = listed.groupBy("path").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])).alias("skills"))
    out = lines.select("path").distinct().join(contacts, "path", "left").join(summary, "path", "left").join(skills, "path", "left")
    skills = F.coalesce("skills", F.array().cast("array<string>"))
    listed = F.when(F.size(skills) > 0, F.concat(F.lit("Skills:\n"), F.array_join(F.transform(skills, lambda x: F.concat(F.lit("- "), x)), "\n")))
    text = F.concat_ws("\n\n", F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("Professional Summary:\n"), "summary")), listed)
    return out.withColumns({"text": text, "skills": skills, "entity_id": F.lit("profile"), "entity_type": F.lit("profile")})


def _first_block(lines: DataFrame, name: str) -> DataFrame:
    """The lines of the first block of that name of each file."""
    s = structured(lines).where("block > 0").where(T.fold_case(F.coalesce("block_title", F.lit(""))) == name)
    return s.join(s.groupBy("path").agg(F.min("block").alias("block")), ["path", "block"])


AWARDS = ("achievements", "honours", "honors")


def education_entries(lines: DataFrame) -> DataFrame:
    """One row per third-level heading of a profile's education part: institution, degree, field, dates, achievements; ``problem`` where the degree is missing.

    The last of equal fields counts. Achievements are the list items under a deeper heading, or a bare field, of that name.
    """
    s = _first_block(lines, "education").where("section > 0")
    key, value = T.field(F.col("line"))
    deep = F.coalesce("level", F.lit(0)) >= 4
    bare = F.coalesce(key.isin(*AWARDS) & (T.strip(value) == ""), F.lit(False))
    w = Window.partitionBy("path", "block", "section").orderBy("pos")
    part = F.last(F.when(deep, T.fold_case(F.col("title"))).when(bare, key), True).over(w)
    m = s.withColumns({"k": F.when(~deep & ~bare, key), "v": value, "part": part})
    pick = lambda n: T.scalar(F.max_by(F.when(F.col("k") == n, F.col("v")), F.when(F.col("k") == n, F.col("pos"))))
    item = F.when(F.col("part").isin(*AWARDS) & F.col("k").isNull() & ~deep, T.list_item(F.col("line")))
    out = m.withColumn("item", item).groupBy("path", "block", "section").agg(
        F.first("section_title").alias("institution"), pick("degree").alias("degree"), pick("field").alias("field"), pick("location").alias("location"), F.coalesce(pick("graduation"), pick("graduation date")).alias("graduation_date"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("pos", "item")))), lambda x: x["item"]).alias("achievements"),
    )
    shown = F.when(F.size("achievements") > 0, F.concat(F.lit("\nAchievements:\n"), F.array_join(F.transform("achievements", lambda x: F.concat(F.lit("- "), x)), "\n")))
    text = F.concat_ws("\n", *_lines_of(Institution=F.col("institution"), Degree=F.col("degree"), Field=F.col("field"), Location=F.col("location"), Graduation=F.col("graduation_date")), shown)
    return out.withColumns({"entity_id": T.entity_id("education", F.col("institution")), "entity_type": F.lit("education"), "text": text, "problem": F.when(F.col("degree").isNull(), "degree")})


def certification_entries(lines: DataFrame) -> DataFrame:
    """One row per list item of a profile's certifications part, in order of pos."""
    m = _first_block(lines, "certifications").withColumn("name", T.list_item(F.col("line"))).where("name is not null")
    return m.select("path", "block", "pos", "name", T.entity_id("certification", F.col("name")).alias("entity_id"), F.lit("certification").alias("entity_type"), F.concat(F.lit("Certification: "), "name").alias("text"))


def canonical_entities(lines: DataFrame) -> DataFrame:
    """(path, part, pos, entity_id, entity_type, text, metadata, problem) of every entity of the structured files, by (part, pos) in the order of the file.

    ``lines``: numbered_lines of canonical files. ``problem`` names a required field that is missing. Profiles always have their row; other
    entities need text.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    c = lambda *names: {n: F.col(n) for n in names}
    no = F.lit(None).cast("string")
    profile = lines.where(name == "profile.md")
    shape = lambda df, part, pos, problem, meta: df.select("path", F.lit(part).alias("part"), F.col(pos).cast("long").alias("pos"), "entity_id", "entity_type", "text", meta.alias("metadata"), problem.alias("problem"))
    parts = [
        shape(experience_entities(lines.where(name == "experience.md")), 0, "block", F.col("problem"), _metadata(**c("company", "title", "location", "start_date", "end_date"))),
        shape(project_entities(lines.where(name == "projects.md")), 0, "block", F.col("problem"), _metadata(**c("name", "project_type", "repository", "date", "technologies"))),
        shape(profile_sections(profile).withColumn("at", F.lit(0)), 0, "at", no, _metadata(**c(*CONTACTS, "summary", "skills"))),
        shape(education_entries(profile).withColumn("at", F.col("section")), 1, "at", F.col("problem"), _metadata(**c("institution", "degree", "field", "location", "graduation_date", "achievements"))),
        shape(certification_entries(profile), 2, "pos", no, _metadata(name=F.col("name"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("text <> '' or entity_type = 'profile'")
