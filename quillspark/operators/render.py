"""Documents as text, and the loop that fits one to a page with a measure that the caller provides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import clean_inline, date_label, latex
from quillspark.operators.selection import SKILL_GROUPS, skill_group

SECTIONS = ("Summary", "Skills", "Experience", "Projects", "Education", "Certifications")
DENSITIES = ("compact", "normal", "comfortable", "expanded")
ROUNDS, EXPAND_BELOW, WARN_BELOW, LEAST_SKILLS = 32, 0.80, 0.72, 8


def period(start: Column, end: Column) -> Column:
    """"Mar 2021 -- Jun 2022" of what is there."""
    return F.concat_ws(" -- ", F.when(F.coalesce(start, F.lit("")) != "", date_label(start)), F.when(F.coalesce(end, F.lit("")) != "", date_label(end)))


def latex_items(bullets: DataFrame, owner: str) -> DataFrame:
    """(owner, items): the validated bullets of each entry as one LaTeX list, in order."""
    b = bullets.where("validated").withColumn("item", F.concat(F.lit(r"\item "), latex(F.col("text"))))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), "\n")
    return b.groupBy(owner).agg(F.concat(F.lit("\\begin{itemize}\n"), lines, F.lit("\n\\end{itemize}")).alias("items"))


# Of each density the margin, font size, leading, space before and after a section, between items, and between entries.
PRESETS = {
    "expanded": ("0.73", "10.5pt", "13.2pt", "10pt", "5pt", "4.5pt", "4pt"), "comfortable": ("0.65", "10.0pt", "11.6pt", "7pt", "4pt", "3.0pt", "1pt"),
    "normal": ("0.64", "9.6pt", "11.0pt", "5pt", "3pt", "2.2pt", "1pt"), "compact": ("0.59", "9.3pt", "10.5pt", "4pt", "2pt", "1.6pt", "1pt"),
}
PAPERS = {"letter": "letterpaper", "a4": "a4paper"}


def _cmd(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"\\{name}{{"), c, F.lit("}"))


def _filled(c: Column) -> Column:
    return F.coalesce(clean_inline(c), F.lit("")) != ""


def _heading(title: Column, dates: Column) -> Column:
    return F.concat(_cmd("textbf", latex(F.coalesce(title, F.lit("")))), F.when(F.coalesce(dates, F.lit("")) != "", F.concat(F.lit(r"\hfill "), latex(dates))).otherwise(""), F.lit(r"\par"))


def _section(title: str, rows: Column, show: Column) -> Column:
    return F.when(show, F.concat(F.lit(f"\\section*{{{title}}}\n"), F.array_join(rows, "\n")))


def _statements(bullets: Column) -> Column:
    line = lambda b: F.concat(F.lit("% Evidence: "), F.replace(F.array_join(b["evidence_ids"], ", "), F.lit("\n"), F.lit(" ")), F.lit("\n\\item "), latex(b["text"]))
    items = F.transform(F.filter(bullets, lambda b: b["validated"]), line)
    return F.when(F.size(bullets) > 0, F.concat_ws("\n", F.lit(r"\begin{itemize}"), F.when(F.size(items) > 0, F.array_join(items, "\n")), F.lit(r"\end{itemize}")))


def _of_group(group: str) -> Callable[[Column], Column]:
    return lambda s: skill_group(s) == group


def skill_rows(skills: Column) -> Column:
    """One line a group of skills, in the order of the groups, Other last; groups without skills have none."""
    shown = F.filter(F.transform(skills, clean_inline), lambda s: F.coalesce(s, F.lit("")) != "")
    rows = []
    for group in (*SKILL_GROUPS, "Other"):
        members = F.filter(shown, _of_group(group))
        rows.append(F.when(F.size(members) > 0, F.concat(F.lit(r"\textbf{"), latex(F.lit(group)), F.lit(":} "), latex(F.array_join(members, ", ")), F.lit(r"\par"))))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def latex_document(density: str = "normal", paper: str = "letter") -> Column:
    """A whole document as LaTeX from a row's columns header, summary, skills, experience, projects, education, certifications.

    header: struct of name, email, phone, location, linkedin, github; summary: array of statements (text, evidence_ids, validated);
    experience: array of title, company, location, start_date, end_date, bullets; projects: array of name, date, technologies, bullets;
    education: array of institution, degree, field, location, graduation_date; certifications: array of name, issuer, date. Only validated
    statements are shown; empty parts are left out; null arrays are empty. A row is one document, so nothing is shuffled.
    """
    margin, font, leading, before, after, between, gap = PRESETS[density]
    head = [
        rf"\documentclass[10pt,{PAPERS[paper]}]{{article}}", rf"\usepackage[margin={margin}in]{{geometry}}", r"\usepackage[T1]{fontenc}", r"\usepackage{lmodern}", r"\usepackage{enumitem}", r"\usepackage[hidelinks]{hyperref}", r"\usepackage{titlesec}", r"\usepackage{microtype}",
        r"\pagestyle{empty}", r"\setlength{\parindent}{0pt}", r"\setlength{\parskip}{0pt}", rf"\setlist[itemize]{{leftmargin=1.15em,topsep=1.1pt,partopsep=0pt,parsep=0pt,itemsep={between}}}", r"\titleformat{\section}{\bfseries\normalsize}{}{0pt}{}[\vspace{-4pt}\titlerule]",
        rf"\titlespacing*{{\section}}{{0pt}}{{{before}}}{{{after}}}", r"\begin{document}", rf"\fontsize{{{font}}}{{{leading}}}\selectfont", r"\begin{center}",
    ]
    name = F.concat(F.lit(r"{\fontsize{15}{16}\selectfont\bfseries "), latex(F.coalesce("header.name", F.lit(""))), F.lit(r"}\par"))
    contacts = F.filter(F.array(*[F.when(_filled(F.col(f"header.{c}")), latex(F.col(f"header.{c}"))) for c in ("email", "phone", "location", "linkedin", "github")]), lambda x: x.isNotNull())
    contact = F.when(F.size(contacts) > 0, F.concat(F.lit(r"\vspace{2pt}{\small "), F.array_join(contacts, r" \textbar{} "), F.lit(r"}\par")))
    place = lambda who, where: F.concat(F.coalesce(clean_inline(who), F.lit("")), F.when(F.coalesce(where, F.lit("")) != "", F.concat(F.lit(", "), clean_inline(where))).otherwise(""))
    listed = lambda *cs: F.array_join(F.filter(F.array(*cs), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    space = F.lit(rf"\vspace{{{gap}}}")
    job = lambda e: F.concat_ws("\n", _heading(e["title"], period(e["start_date"], e["end_date"])), F.concat(_cmd("textit", latex(place(e["company"], e["location"]))), F.lit(r"\par")), _statements(e["bullets"]), space)
    tools = lambda e: F.when(F.size(F.coalesce(e["technologies"], F.array().cast("array<string>"))) > 0, F.concat(_cmd("textit", latex(F.array_join(F.slice(e["technologies"], 1, 7), ", "))), F.lit(r"\par")))
    project = lambda e: F.concat_ws("\n", _heading(e["name"], date_label(e["date"])), tools(e), _statements(e["bullets"]), space)
    school = lambda e: F.concat_ws("\n", _heading(listed(e["degree"], e["field"]), date_label(e["graduation_date"])), F.concat(latex(place(e["institution"], e["location"])), F.lit(r"\par")))
    paper_of = lambda e: F.concat(latex(listed(e["name"], e["issuer"], e["date"])), F.lit(r"\par"))
    some = lambda c: F.size(F.coalesce(c, F.array())) > 0
    said = F.array_join(F.transform(F.filter("summary", lambda b: b["validated"]), lambda b: b["text"]), " ")
    return F.concat_ws(
        "\n", *[F.lit(x) for x in head], name, contact, F.lit(r"\end{center}"), F.lit(r"\vspace{-9pt}"),
        _section("Summary", F.array(latex(said)), some("summary")), _section("Technical Skills", skill_rows(F.col("skills")), some("skills")), _section("Professional Experience", F.transform("experience", job), some("experience")),
        _section("Projects", F.transform("projects", project), some("projects")), _section("Education", F.transform("education", school), some("education")), _section("Certifications", F.transform("certifications", paper_of), some("certifications")), F.lit("\\end{document}\n"),
    )


def layout_counts() -> list[Column]:
    """Entries and statements of a document's sections, from its columns experience and projects."""
    n = lambda c: F.size(F.coalesce(c, F.array()))
    total = lambda c: F.aggregate(F.coalesce(c, F.array()), F.lit(0), lambda acc, e: acc + F.size(e["bullets"]))
    return [n("experience").alias("experience_entries"), n("projects").alias("project_entries"), total("experience").alias("experience_bullets"), total("projects").alias("project_bullets")]


def layout_report(document: DataFrame, density: str, pages: int, used: float | None, warnings: list[str]) -> DataFrame:
    """One row: the report that goes with a document that was fitted to its page."""
    bare = [F.when(F.col(f"{k}_entries") == 0, f"No {k} entry contains a verified bullet") for k in ("experience", "project")]
    said = F.filter(F.concat(F.array(*[F.lit(w) for w in warnings]).cast("array<string>"), F.array(*bare)), lambda w: w.isNotNull())
    counted = document.select(F.lit(pages).alias("page_count"), F.lit(density).alias("density"), *layout_counts(), F.lit(used).cast("double").alias("estimated_bottom_usage"))
    return counted.withColumn("warnings", said)


def with_statements(entries: DataFrame, statements: DataFrame, columns: list[str]) -> DataFrame:
    """(owner, entries): each owner's entries by pos as structs of ``columns`` and their statements in order of place; entries without statements are left out.

    ``entries``: owner, pos, entry_id, columns; ``statements``: owner, entry_id, place, text, evidence_ids, validated. An owner has few entries (see
    composition.limited_entries) and an entry few statements.
    """
    said = statements.groupBy("owner", "entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text", "evidence_ids", "validated"))), lambda b: b.dropFields("place")).alias("bullets"))
    rows = entries.join(said, ["owner", "entry_id"]).select("owner", F.struct("pos", "entry_id", *columns, "bullets").alias("e"))
    return rows.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e.dropFields("pos")).alias("entries"))


@dataclass
class Layout:
    summary: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    experience: list[list[str]] = field(default_factory=list)
    projects: list[list[str]] = field(default_factory=list)

    def drop_one(self) -> bool:
        """Takes away the least needed item: a last bullet, the summary, two skills; False if nothing may go."""
        for part in (self.projects, self.experience):
            for entry in reversed(part):
                if len(entry) > 1:
                    entry.pop()
                    return True
        if self.summary:
            self.summary.clear()
            return True
        if len(self.skills) > LEAST_SKILLS:
            del self.skills[-2:]
            return True
        return False


def fit(layout: Layout, measure: Callable[[Layout, str], tuple[int, float | None]]) -> tuple[str, int, list[str]]:
    """(density, pages, warnings): trims the layout until ``measure`` (pages, used part of the page) says one page.

    In each round normal and compact spacing are tried; a page that is less than EXPAND_BELOW full is tried wider.
    """
    for _ in range(ROUNDS):
        for density in ("normal", "compact"):
            pages, used = measure(layout, density)
            if pages != 1:
                continue
            if density == "normal" and used is not None and used < EXPAND_BELOW:
                for wider in ("expanded", "comfortable"):
                    p, u = measure(layout, wider)
                    if p == 1:
                        density, used = wider, u
                        break
            return density, 1, ["the page is rather empty"] if used is not None and used < WARN_BELOW else []
        if not layout.drop_one():
            break
    return "compact", measure(layout, "compact")[0], ["does not fit on one page"]
