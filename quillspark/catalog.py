"""The queries of the core by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import jsontext as J
from quillspark.functions import text as T
from quillspark.operators import chunking, retrieval
from quillspark.operators import composition as K
from quillspark.operators import evidence as E
from quillspark.operators import markdown as M
from quillspark.operators import render as R
from quillspark.operators import selection as S
from quillspark.operators.scorers import ClaimWriter, WordChecker, overlap_score
from quillspark.plans import cards as C
from quillspark.plans import models, search
from quillspark.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Q = Callable[[SparkSession, str], DataFrame]
SP, LF, NL = T.SPACE, T.LINE_END, T.SPACE_NO_LF


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


_FOLD = "replace(lower({}), 'ß', 'ss')"
_CARDS = "cards AS (SELECT DISTINCT * EXCLUDE (extracted_at, loaded_at) FROM evidence WHERE evidence_id IS NOT NULL)"


def _clean_sql(x: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(regexp_replace({x}, '{LF}', chr(10), 'g'), '[{NL}]*\\n[{NL}]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


# --- text


@query(f"SELECT document_id, {_clean_sql('text')} AS clean FROM parsed_documents")
def txt_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_documents").select("document_id", T.clean(F.col("text")).alias("clean"))


_TOKENS = "list_transform(regexp_extract_all(coalesce({}, ''), '" + T.TOKEN + "'), lambda t: lower(t))"


@query(f"SELECT evidence_id, array_to_string({_TOKENS.format('claim')}, ' ') AS tokens, CAST(len({_TOKENS.format('claim')}) AS INT) AS n FROM evidence")
def txt_tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("claim"))
    return table(spark, d, "evidence").select("evidence_id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


_SLUG = "regexp_replace(regexp_replace(" + _FOLD + ", '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""
WITH s AS (SELECT document_id, coalesce(nullif({_SLUG.format("coalesce(metadata.company, '')")}, ''), 'entity') AS slug, coalesce(nullif({_SLUG.format("coalesce(metadata.title, metadata.name, '')")}, ''), 'entity') AS t FROM parsed_documents)
SELECT document_id, slug, CASE WHEN starts_with(t, 'exp_') OR starts_with(t, 'experience_') THEN t ELSE 'exp_' || t END AS entity FROM s""")
def txt_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_documents").select("document_id", T.slug(F.col("metadata.company")).alias("slug"), T.entity_id("experience", F.coalesce("metadata.title", "metadata.name")).alias("entity"))


@query(r"""SELECT requirement_id, TRY_CAST(regexp_extract(text, '(\d+(?:\.\d+)?)', 1) AS DOUBLE) AS years,
  CASE WHEN text IS NULL OR lower(trim(text)) IN ('', 'none', 'null', 'n/a', 'na') THEN NULL WHEN lower(trim(text)) IN ('true', 'false') THEN 'a truth value' WHEN NOT regexp_matches(text, '[0-9]') THEN 'no number' END AS problem FROM requirements""")
def txt_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "requirements").select("requirement_id", T.years(F.col("text")).alias("years"), T.years_problem(F.col("text")).alias("problem"))


_LABEL = r"CASE WHEN regexp_matches({0}, '^\d{{4}}-(0[1-9]|1[0-2])$') AND NOT starts_with({0}, '0000') THEN (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[CAST(substr({0}, 6, 2) AS INT)] || ' ' || substr({0}, 1, 4) ELSE {0} END"


@query(f"SELECT document_id, {_LABEL.format('metadata.start_date')} AS start_label, {_LABEL.format('metadata.end_date')} AS end_label FROM parsed_documents")
def txt_date_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_documents").select("document_id", T.date_label(F.col("metadata.start_date")).alias("start_label"), T.date_label(F.col("metadata.end_date")).alias("end_label"))


_INLINE = _strip("text")
for _m in ("**", "__", "*"):
    _INLINE = f"(CASE WHEN starts_with({_INLINE}, '{_m}') AND ends_with({_INLINE}, '{_m}') AND length({_INLINE}) > {2 * len(_m)} THEN {_strip(f'substr({_INLINE}, {len(_m) + 1}, length({_INLINE}) - {2 * len(_m)})')} ELSE {_INLINE} END)"
_INLINE = f"regexp_replace({_INLINE}, '{SP}+', ' ', 'g')"


@query(f"SELECT bullet_id, {_INLINE} AS inline_text, {_strip('regexp_replace(' + _strip('text') + chr(44) + chr(32) + chr(39) + '^(- )?(• )?([*] )?' + chr(39) + ', ' + chr(39) * 2 + ')')} AS bullet FROM bullets")
def txt_inline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bullets").select("bullet_id", T.clean_inline(F.col("text")).alias("inline_text"), T.bullet_text(F.col("text")).alias("bullet"))


def _escaped_sql(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LATEX.items())
    return f"list_transform(string_split({x}, ''), lambda c: CASE c {cases} ELSE c END)"



@query(f"SELECT bullet_id, array_to_string({_escaped_sql(_INLINE)}, '') AS latex FROM bullets")
def txt_latex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bullets").select("bullet_id", T.latex(F.col("text")).alias("latex"))


@query("SELECT requirement_id, CASE WHEN len(coalesce(skills, [])) > 0 THEN text || '. Skills: ' || array_to_string(skills, ', ') ELSE text END AS search_query FROM requirements")
def txt_search_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "requirements").select("requirement_id", T.search_query(F.col("text"), F.col("skills")).alias("search_query"))


_SHOWN = f"list_filter(list_transform(coalesce(skills, []), lambda s: {_strip('s')}), lambda s: s IS NOT NULL AND s <> '')"
_METRIC = "regexp_replace(coalesce(m.name, '') || ': ' || coalesce(m.value, ''), '^[: ]+|[: ]+$', '', 'g')"
_SAID = f"list_filter(list_transform(coalesce(metrics, []), lambda m: CASE WHEN coalesce(m.context, '') <> '' THEN {_METRIC} || ' (' || m.context || ')' ELSE {_METRIC} END), lambda s: s <> '')"
_CARD = f"""concat_ws(chr(10), nullif(coalesce(claim, ''), ''), CASE WHEN coalesce(category, '') <> '' THEN 'Category: ' || category END, CASE WHEN len({_SHOWN}) > 0 THEN 'Skills: ' || array_to_string({_SHOWN}, ', ') END,
  CASE WHEN len({_SAID}) > 0 THEN 'Metrics: ' || array_to_string({_SAID}, '; ') END)"""


@query(f"SELECT evidence_id, {_CARD} AS card FROM evidence")
def txt_card(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").select("evidence_id", T.card_text(F.col("claim"), F.col("category"), F.col("skills"), F.col("metrics")).alias("card"))


@query(r"""
WITH s AS (SELECT coalesce(nullif(entity_id, ''), regexp_replace(list_last(string_split(coalesce(source_file, ''), '/')), '(.)\.[^.]*$', '\1')) AS raw, evidence_id FROM evidence)
SELECT evidence_id, array_to_string(list_transform(string_split(lower(regexp_replace(raw, '[_-]', ' ', 'g')), ''), lambda c, i: CASE WHEN i = 1 OR NOT regexp_matches(string_split(lower(regexp_replace(raw, '[_-]', ' ', 'g')), '')[i - 1], '\p{L}') THEN upper(c) ELSE c END), '') AS label FROM s""")
def txt_source_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").select("evidence_id", T.source_label(F.col("entity_id"), F.col("source_file")).alias("label"))


def _words_sql(x: str) -> str:
    s = _strip(f"coalesce({x}, '')")
    return f"CAST(CASE WHEN {s} = '' THEN 0 ELSE len(string_split(regexp_replace({s}, '{SP}+', ' ', 'g'), ' ')) END AS INT)"


@query(f"SELECT evidence_id, regexp_matches(claim, '{T.ACTION}') AS acts, regexp_matches(claim, '{T.FILLER}') AS fills, {_words_sql('claim')} AS words FROM evidence")
def pred_action_filler(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("claim")
    return table(spark, d, "evidence").select("evidence_id", c.rlike(T.ACTION).alias("acts"), c.rlike(T.FILLER).alias("fills"), T.word_count(c).alias("words"))


@query(f"""SELECT evidence_id, 'ev_' || substr(sha256(concat_ws(':', source_chunk_id, lower({_strip('claim')}))), 1, 16) AS ev, 'req_' || substr(sha256(coalesce(lower({_strip('claim')}), '')), 1, 12) AS req,
  'compose_' || substr(sha256(concat_ws('/', entity_id, evidence_id)), 1, 12) AS compose FROM evidence""")
def id_hash(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower(T.strip(F.col("claim")))
    return table(spark, d, "evidence").select("evidence_id", T.hash_id("ev", 16, F.col("source_chunk_id"), low).alias("ev"), T.hash_id("req", 12, low).alias("req"), T.hash_id("compose", 12, F.col("entity_id"), F.col("evidence_id"), by="/").alias("compose"))


@query(rf"""
WITH d AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '{LF}', chr(10), 'g'), chr(10))) AS line, unnest(range(len(string_split(regexp_replace(text, '{LF}', chr(10), 'g'), chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CAST(pos AS INT) AS pos, {_strip('line')} AS l FROM d)
SELECT doc_id, pos, CAST(nullif(length(regexp_extract(l, '^(#{{1,6}})\s+\S', 1)), 0) AS INT) AS level, CASE WHEN regexp_matches(l, '^#{{1,6}}\s+\S') THEN regexp_extract(l, '^#{{1,6}}\s+(.+?)\s*$', 1) END AS title,
  CASE WHEN regexp_matches(l, '^[A-Za-z][^:]*:') THEN {_FOLD.format(_strip("regexp_extract(l, '^([A-Za-z][^:]*):', 1)"))} END AS key, CASE WHEN regexp_matches(l, '^[A-Za-z][^:]*:') THEN {_strip("regexp_extract(l, '^[A-Za-z][^:]*:(.*)$', 1)")} END AS value,
  CASE WHEN regexp_matches(l, '^[-*] ') AND lower({_strip("substr(l, 3)")}) NOT IN ('', 'none', 'n/a', 'na') THEN {_strip("substr(l, 3)")} END AS item
FROM s""")
def md_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document, read as Markdown: heading, field or list item."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", LF, "\n"), "\n")).alias("pos", "line"))
    level, title = T.heading(F.col("line"))
    key, value = T.field(F.col("line"))
    return lines.select("doc_id", "pos", level.alias("level"), title.alias("title"), key.alias("key"), value.alias("value"), T.list_item(F.col("line")).alias("item"))


# --- JSON and enums


@query("""SELECT bullet_id, '{"text":"' || replace(replace(text, chr(92), ''), '"', '') || ',}","ids":["' || coalesce(array_to_string(evidence_ids, '","'), '') || '"]}' AS repaired FROM bullets WHERE text IS NOT NULL""")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Fenced model output with trailing commas, repaired; commas and braces inside strings stay."""
    plain = F.replace(F.replace("text", F.lit("\\"), F.lit("")), F.lit('"'), F.lit(""))
    ids = F.coalesce(F.array_join("evidence_ids", '","'), F.lit(""))
    said = F.concat(F.lit('```json\n{"text":"'), plain, F.lit(',}","ids":["'), ids, F.lit('",]'), F.lit(",}\n```"))
    return table(spark, d, "bullets").where("text is not null").select("bullet_id", J.without_trailing_commas(J.json_object(said)).alias("repaired"))


@query(f"WITH {_CARDS} SELECT evidence_id, claim, category, array_to_string(list_filter(skills, lambda s: s IS NOT NULL), '|') AS skills FROM cards")
def json_parse(spark: SparkSession, d: str) -> DataFrame:
    """Cards written as JSON, broken with a trailing comma, and read back."""
    text = F.concat(F.lit("Here it is:\n"), F.regexp_replace(F.to_json(F.struct("claim", "category", "skills"), {"ignoreNullFields": "false"}), r"\}$", ",}"), F.lit("\nDone."))
    got = J.parsed(text, "claim string, category string, skills array<string>")
    return C.cards(spark, d).select("evidence_id", got.alias("g")).select("evidence_id", "g.claim", "g.category", F.array_join("g.skills", "|").alias("skills"))


_CAT = f"""CASE WHEN years_experience IS NOT NULL THEN 'experience' WHEN len(list_filter(coalesce(skills, []), lambda s: trim(coalesce(s, '')) <> '')) > 0 THEN 'technical' {' '.join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{'|'.join(w)}') THEN '{c}'" for c, w in J.CATEGORY_WORDS)} ELSE 'other' END"""


@query(f"SELECT requirement_id, {_CAT} AS inferred FROM requirements")
def category_infer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "requirements").select("requirement_id", J.inferred_category(F.col("text"), F.col("skills"), F.col("years_experience")).alias("inferred"))


_IMP, _CATS = str(J.IMPORTANCE), str(J.CATEGORIES)


@query(f"""
WITH a AS (SELECT requirement_id, CASE WHEN category IN {_IMP} AND (importance IS NULL OR importance = 'unknown' OR importance NOT IN {_IMP}) THEN category ELSE importance END AS i, CASE WHEN category IN {_IMP} THEN {_CAT} ELSE category END AS c FROM requirements)
SELECT requirement_id, CASE WHEN i IN {_CATS} AND NOT coalesce(c IN {_CATS}, false) THEN i ELSE c END AS category, CASE WHEN i IN {_CATS} THEN 'unknown' ELSE i END AS importance FROM a""")
def enum_repair(spark: SparkSession, d: str) -> DataFrame:
    return J.repair_enums(table(spark, d, "requirements")).select("requirement_id", "category", "importance")


_DEDUP = f"list_filter(list_transform(coalesce(skills, []), lambda s: {_strip('s')}), lambda s: s IS NOT NULL AND s <> '')"


@query(f"SELECT evidence_id, array_to_string(list_filter({_DEDUP}, lambda x, i: list_position(list_transform({_DEDUP}, lambda y: {_FOLD.format('y')}), {_FOLD.format('x')}) = i), '|') AS skills FROM evidence")
def arr_dedup_ci(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").select("evidence_id", F.array_join(T.distinct_folded(F.col("skills")), "|").alias("skills"))


@query(f"SELECT evidence_id, array_to_string(list_transform(list_filter(coalesce(metrics, []), lambda m: coalesce({_strip('m.name')}, '') <> '' AND coalesce({_strip('m.value')}, '') <> ''), lambda m: m.name || '=' || m.value), '|') AS metrics FROM evidence")
def arr_metric_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = F.transform(T.metrics_complete(F.col("metrics")), lambda m: F.concat(m["name"], F.lit("="), m["value"]))
    return table(spark, d, "evidence").select("evidence_id", F.array_join(kept, "|").alias("metrics"))


# --- chunks and Markdown


def _parts_sql(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda p: {_strip('p')}), lambda p: p <> '')"


def _packed_sql(pieces: str, glue: str, fresh: str) -> str:
    """Greedy packing as a fold: each piece as {{o: what is done, c: what is open}}; ``fresh`` of a.c and x.c starts the next."""
    start = "[{'o': CAST([] AS VARCHAR[]), 'c': ''}]"
    joined = f"CASE WHEN a.c = '' THEN x.c ELSE a.c || {glue} || x.c END"
    step = f"CASE WHEN length({joined}) <= 500 THEN {{'o': a.o, 'c': {joined}}} WHEN a.c = '' THEN {{'o': a.o, 'c': x.c}} ELSE {{'o': list_append(a.o, a.c), 'c': {fresh}}} END"
    folded = f"list_reduce(list_concat({start}, list_transform({pieces}, lambda p: {{'o': CAST([] AS VARCHAR[]), 'c': p}})), lambda a, x: {step})"
    return f"list_transform([{folded}], lambda f: CASE WHEN f.c = '' THEN f.o ELSE list_append(f.o, f.c) END)[1]"


def _sentences_sql(x: str) -> str:
    return _parts_sql(f"string_split(regexp_replace({x}, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1))")



_TAIL = f"CASE WHEN length(a.c) <= 150 THEN a.c WHEN contains(right(a.c, 150), ' ') THEN {_strip('substr(right(a.c, 150), instr(right(a.c, 150), chr(32)) + 1)')} ELSE {_strip('right(a.c, 150)')} END"
_DOCS = "docs AS (SELECT DISTINCT document_id, source_file, source_type, text, page, entity_id, entity_type FROM parsed_documents WHERE document_id IS NOT NULL AND text IS NOT NULL)"
_PARAGRAPHS = _parts_sql(f"string_split(regexp_replace(text, '\\n{SP}*\\n', chr(1), 'g'), chr(1))")


@query(f"""
WITH {_DOCS}, para AS (SELECT *, flatten(list_transform({_PARAGRAPHS}, lambda p: CASE WHEN length(p) <= 500 THEN [p] ELSE {_packed_sql(_sentences_sql('p'), "' '", 'x.c')} END)) AS paras FROM docs),
packed AS (SELECT *, {_packed_sql('paras', 'chr(10) || chr(10)', f"CASE WHEN ({_TAIL}) = '' THEN x.c ELSE ({_TAIL}) || chr(10) || chr(10) || x.c END")} AS big FROM para WHERE len(paras) > 0),
merged AS (SELECT * EXCLUDE (paras, big), list_reduce(list_transform(big, lambda c: [c]), lambda a, x: CASE WHEN length(x[1]) < 200 AND length(a[-1]) + length(x[1]) <= 500 THEN list_append(a[:-2], a[-1] || chr(10) || chr(10) || x[1]) ELSE list_append(a, x[1]) END) AS cut FROM packed),
chunks_of AS (SELECT * EXCLUDE (cut, text), unnest(cut) AS text, CAST(unnest(range(len(cut))) AS INT) AS chunk_index FROM merged)
SELECT *, document_id || '_chunk_' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') AS chunk_id FROM chunks_of""")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(C.documents(spark, d).drop("metadata").distinct())


@query(f"""
WITH docs AS (SELECT DISTINCT document_id, text FROM parsed_documents WHERE document_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT document_id, {_packed_sql(_sentences_sql(_strip('text')), "' '", 'x.c')} AS pieces FROM docs)
SELECT document_id, CAST(unnest(range(len(pieces))) AS INT) AS pos, unnest(pieces) AS piece FROM s""")
def chunk_sentence_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = C.documents(spark, d).where("text is not null").select("document_id", "text").distinct()
    return docs.select("document_id", F.posexplode(chunking.packed_sentences(T.strip(F.col("text")))).alias("pos", "piece"))


@query("""
SELECT DISTINCT document_id, nullif(trim(metadata.company), '') AS company, nullif(trim(metadata.title), '') AS title, nullif(trim(metadata.location), '') AS location, nullif(trim(metadata.start_date), '') AS start_date
FROM parsed_documents WHERE entity_type = 'experience' AND document_id IS NOT NULL AND trim(coalesce(metadata.company, '')) <> '' AND trim(coalesce(metadata.title, '')) <> ''""")
def md_experience(spark: SparkSession, d: str) -> DataFrame:
    """Experience records written as canonical Markdown and parsed again."""
    m = C.documents(spark, d).where("entity_type = 'experience' and trim(coalesce(metadata.company, '')) <> '' and trim(coalesce(metadata.title, '')) <> ''")
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.coalesce(f"metadata.{c}", F.lit("none")))
    text = F.concat_ws("\n", F.lit("---\nkind: cv\n---\n# Work\n"), F.concat(F.lit("## "), "document_id"), line("Company", "company"), line("Title", "title"), line("Location", "location"), line("Start", "start_date"), line("End", "end_date"), F.lit("### Notes\n- Company: other"))
    files = m.select(F.col("document_id").alias("path"), text.alias("text"))
    return M.experience_entities(M.numbered_lines(files)).select(F.col("path").alias("document_id"), "company", "title", "location", "start_date")


# --- retrieval

_TF = f"WITH {_CARDS}, toks AS (SELECT evidence_id AS doc_id, unnest({_TOKENS.format('claim')}) AS term FROM cards), tf AS (SELECT doc_id, term, CAST(count(*) AS INT) AS tf FROM toks GROUP BY 1, 2)"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return C.cards(spark, d).select(F.col("evidence_id").alias("doc_id"), F.col("claim").alias("text"))


@query(_TF + " SELECT * FROM tf")
def bm25_tf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_counts(_claims(spark, d))


@query(_TF + " SELECT term, count(*) AS df FROM tf GROUP BY 1")
def bm25_df(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.doc_frequencies(retrieval.term_counts(_claims(spark, d)))


@query(f"WITH {_CARDS} SELECT count(*) AS n, CAST(sum(len({_TOKENS.format('claim')})) AS BIGINT) AS tokens, round(avg(len({_TOKENS.format('claim')})), 9) AS avgdl FROM cards")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.corpus_stats(_claims(spark, d)).withColumn("avgdl", F.round("avgdl", 9))


_BM25 = f"""
WITH {_CARDS}, docs AS (SELECT evidence_id AS doc_id, {_TOKENS.format('(' + _CARD + ')')} AS toks FROM cards),
q AS (SELECT DISTINCT requirement_id AS query_id, coalesce(search_query, text) AS text FROM requirements WHERE CAST('0x' || substr(requirement_id, 5) AS BIGINT) % 20 = 0),
qt AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('text')}) AS term FROM q WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs),
t AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM docs), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM t GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s)
"""


@query(_BM25 + "SELECT query_id, doc_id, round(score, 6) AS bm25_score, CAST(r AS INT) AS bm25_rank FROM top WHERE r <= 30")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.lexical(spark, d).withColumn("bm25_score", F.round("bm25_score", 6))


_WORDSET = "list_distinct(regexp_extract_all(" + _FOLD.format("coalesce({}, '')") + ", '[a-z0-9]+'))"


def _jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE) ELSE 0 END"


@query(_BM25 + f""", r AS (SELECT top.query_id, top.doc_id, r, {_jaccard_sql(_WORDSET.format('q.text'), _WORDSET.format('c.claim'))} AS s FROM top JOIN q USING (query_id) JOIN cards c ON c.evidence_id = top.doc_id WHERE r <= 20)
SELECT query_id, doc_id, round(s, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) AS INT) AS rerank_rank FROM r QUALIFY rerank_rank <= 5""")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    top = search.lexical(spark, d, 20).withColumnRenamed("bm25_rank", "fusion_rank")
    j = top.join(C.queries(spark, d).withColumnRenamed("text", "query"), "query_id").join(_claims(spark, d), "doc_id")
    return retrieval.rerank(j, overlap_score("query", "text")).select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS doc_id, list_dot_product(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS n FROM s)
SELECT query_id, doc_id, round(s, 6) AS semantic_score, CAST(n AS INT) AS semantic_rank FROM r WHERE n <= 10""")
def sem_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    top = retrieval.vector_top(v, v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))
    return top.withColumn("semantic_score", F.round("semantic_score", 6))


def _best(c: str) -> str:
    return f"max(CASE WHEN NOT isnan({c}) THEN {c} END) AS {c}"


_RRF = f"""
WITH sc AS (SELECT requirement_id AS query_id, evidence_id AS doc_id, {_best('bm25_score')}, {_best('semantic_score')}, {_best('rerank_score')} FROM candidates WHERE requirement_id IS NOT NULL AND evidence_id IS NOT NULL GROUP BY 1, 2),
lex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS br FROM sc WHERE bm25_score > 0 QUALIFY br <= 30),
sem AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(semantic_score, 9) DESC, doc_id) AS sr FROM sc WHERE semantic_score IS NOT NULL QUALIFY sr <= 30),
f AS (SELECT coalesce(lex.query_id, sem.query_id) AS query_id, coalesce(lex.doc_id, sem.doc_id) AS doc_id, br, sr, coalesce(1e0 / (60 + br), 0) + coalesce(1e0 / (60 + sr), 0) AS w FROM lex FULL JOIN sem ON lex.query_id = sem.query_id AND lex.doc_id = sem.doc_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 12) DESC, br NULLS LAST, sr NULLS LAST, doc_id) AS fr FROM f QUALIFY fr <= 20)
"""


@query(_RRF + "SELECT query_id, doc_id, CAST(br AS INT) AS bm25_rank, CAST(sr AS INT) AS semantic_rank, round(w, 9) AS fusion_score, CAST(fr AS INT) AS fusion_rank FROM fused")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return search.stored(spark, d).select("query_id", "doc_id", "bm25_rank", "semantic_rank", F.round("fusion_score", 9).alias("fusion_score"), "fusion_rank")


@query(_RRF + "SELECT query_id, doc_id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, fr) AS INT) AS rerank_rank FROM fused JOIN sc USING (query_id, doc_id) QUALIFY rerank_rank <= 5")
def match_all(spark: SparkSession, d: str) -> DataFrame:
    """The cascade over the stored scores of all requirements."""
    return search.match_stored(spark, d).select("query_id", "doc_id", "rerank_score", "rerank_rank")


_VEC = """
, docw AS (SELECT doc_id, unnest(toks) AS w FROM docs), qw AS (SELECT query_id, unnest({TOK}) AS w FROM q),
dh AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM docw), qh AS (SELECT query_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM qw),
dv AS (SELECT doc_id, h % 64 AS b, sum(CASE WHEN h >= 2147483648 THEN 1e0 ELSE -1e0 END) AS v FROM dh GROUP BY 1, 2), qv AS (SELECT query_id, h % 64 AS b, sum(CASE WHEN h >= 2147483648 THEN 1e0 ELSE -1e0 END) AS v FROM qh GROUP BY 1, 2),
dn AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM dv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY 1),
du AS (SELECT doc_id, b, CAST(CAST(v / CASE WHEN n > 0 THEN n ELSE 1 END AS FLOAT) AS DOUBLE) AS v FROM dv JOIN dn USING (doc_id)), qu AS (SELECT query_id, b, CAST(CAST(v / CASE WHEN n > 0 THEN n ELSE 1 END AS FLOAT) AS DOUBLE) AS v FROM qv JOIN qn USING (query_id)),
dots AS (SELECT query_id, doc_id, sum(qu.v * du.v) AS s FROM qu JOIN du USING (b) GROUP BY 1, 2),
every AS (SELECT query_id, doc_id, coalesce(s, 0e0) AS s FROM (SELECT query_id FROM q) CROSS JOIN (SELECT doc_id FROM docs) LEFT JOIN dots USING (query_id, doc_id)),
sem AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS sr FROM every QUALIFY sr <= 30),
lex AS (SELECT query_id, doc_id, r AS br FROM top WHERE r <= 30),
f AS (SELECT coalesce(lex.query_id, sem.query_id) AS query_id, coalesce(lex.doc_id, sem.doc_id) AS doc_id, br, sr, coalesce(1e0 / (60 + br), 0) + coalesce(1e0 / (60 + sr), 0) AS w FROM lex FULL JOIN sem ON lex.query_id = sem.query_id AND lex.doc_id = sem.doc_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 12) DESC, br NULLS LAST, sr NULLS LAST, doc_id) AS fr FROM f QUALIFY fr <= 20),
rr AS (SELECT fused.*, {JAC} AS s FROM fused JOIN q USING (query_id) JOIN docs USING (doc_id))
SELECT query_id, doc_id, CAST(br AS INT) AS bm25_rank, CAST(sr AS INT) AS semantic_rank, CAST(fr AS INT) AS fusion_rank, round(s, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fr) AS INT) AS rerank_rank FROM rr QUALIFY rerank_rank <= 5"""


@query(_BM25.replace("evidence_id AS doc_id, ", f"evidence_id AS doc_id, {_CARD} AS body, ", 1) + _VEC.replace("{TOK}", _TOKENS.format("text")).replace("{JAC}", _jaccard_sql(_WORDSET.format("q.text"), _WORDSET.format("docs.body"))))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole cascade from texts: lexical and vector retrieval of 30 each, fused to 20, reranked to 5."""
    m = search.match_all(spark, d)
    return m.select("query_id", "doc_id", "bm25_rank", "semantic_rank", "fusion_rank", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


@query(_RRF + f", m AS (SELECT query_id, doc_id, w, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, fr) AS rr FROM fused JOIN sc USING (query_id, doc_id) QUALIFY rr <= 5), {_CARDS} SELECT query_id, evidence_id, claim, entity_id, round(w, 9) AS fusion_score, rerank_score FROM m JOIN cards ON evidence_id = doc_id")
def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Matched cards as they are handed out, with how they were found."""
    r = search.results(search.match_stored(spark, d), C.cards(spark, d))
    return r.select("query_id", "evidence_id", "claim", "entity_id", F.round("retrieval.fusion_score", 9).alias("fusion_score"), "retrieval.rerank_score")


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    """Lexical and vector retrieval, rank fusion and reranking, from texts."""
    return search.match_all(spark, sf_dir)


# --- joins and groups

_BULLETS = "bs AS (SELECT DISTINCT bullet_id, section, entry_id, text, evidence_ids, validated FROM bullets WHERE bullet_id IS NOT NULL)"


def _bullets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bullets").where("bullet_id is not null").select("bullet_id", "section", "entry_id", "text", "evidence_ids", "validated").distinct()


_CITED = f"WITH {_CARDS}, {_BULLETS}, x AS (SELECT bullet_id, unnest(evidence_ids) AS evidence_id, unnest(range(len(evidence_ids))) AS pos, text FROM bs)"


@query(_CITED + " SELECT bullet_id, CAST(pos AS INT) AS pos, evidence_id, claim, entity_id, entity_type FROM x JOIN cards USING (evidence_id)")
def join_bullet_evidence(spark: SparkSession, d: str) -> DataFrame:
    return E.cited(_bullets(spark, d), "bullet_id", "evidence_ids", C.cards(spark, d))


@query(_CITED + f" SELECT bullet_id, evidence_id, round({_jaccard_sql(_WORDSET.format('text'), _WORDSET.format('claim'))}, 9) AS similarity FROM x JOIN cards USING (evidence_id)")
def sim_jaccard(spark: SparkSession, d: str) -> DataFrame:
    b = _bullets(spark, d)
    j = E.cited(b, "bullet_id", "evidence_ids", C.cards(spark, d)).join(b.select("bullet_id", "text"), "bullet_id")
    return j.select("bullet_id", "evidence_id", F.round(T.jaccard(T.word_set(F.col("text")), T.word_set(F.col("claim"))), 9).alias("similarity"))


_WRONG = _CITED + ", wrong AS (SELECT DISTINCT x.bullet_id FROM x JOIN bs USING (bullet_id) LEFT JOIN cards ON cards.evidence_id = x.evidence_id WHERE entity_id IS NULL OR entry_id IS NULL OR entity_id <> entry_id)"


@query(_WRONG + " SELECT bullet_id, entry_id FROM bs WHERE len(evidence_ids) > 0 AND bullet_id NOT IN (SELECT bullet_id FROM wrong)")
def join_semi_owned(spark: SparkSession, d: str) -> DataFrame:
    return E.owned(_bullets(spark, d), C.cards(spark, d))[0].select("bullet_id", "entry_id")


@query(_WRONG + " SELECT bullet_id, entry_id FROM bs WHERE len(evidence_ids) > 0 AND bullet_id IN (SELECT bullet_id FROM wrong)")
def join_anti_foreign(spark: SparkSession, d: str) -> DataFrame:
    return E.owned(_bullets(spark, d), C.cards(spark, d))[1].select("bullet_id", "entry_id")


@query(f"WITH {_CARDS} SELECT source_chunk_id AS chunk_id, count(*) AS n_cards, array_to_string(list_sort(list_distinct(list(evidence_id))), ',') AS evidence_ids FROM cards WHERE source_chunk_id IS NOT NULL GROUP BY 1")
def group_cards(spark: SparkSession, d: str) -> DataFrame:
    return E.cards_by_chunk(C.cards(spark, d)).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query("SELECT evidence_id, max(loaded_at) AS loaded_at FROM evidence WHERE evidence_id IS NOT NULL GROUP BY 1")
def latest_cards(spark: SparkSession, d: str) -> DataFrame:
    """The last load of every card: the build side of every look-up by id."""
    return E.latest(table(spark, d, "evidence").where("evidence_id is not null"), "evidence_id", "loaded_at").select("evidence_id", "loaded_at")


_ENTRIES = "e AS (SELECT DISTINCT metadata.company AS company, metadata.title AS title, metadata.location AS location, document_id, source_file FROM parsed_documents WHERE entity_type = 'experience' AND document_id IS NOT NULL AND metadata.company IS NOT NULL AND metadata.title IS NOT NULL)"


@query(f"""WITH {_ENTRIES}, g AS (SELECT company, title, min(document_id) AS first_pos, max(document_id) AS last_pos, array_to_string(list_filter(list(source_file ORDER BY document_id, source_file), lambda x, i: list_position(list(source_file ORDER BY document_id, source_file), x) = i), ',') AS source_files FROM e GROUP BY 1, 2)
SELECT company, title, location, first_pos, source_files FROM g JOIN e USING (company, title) WHERE document_id = last_pos""")
def profile_merge(spark: SparkSession, d: str) -> DataFrame:
    m = C.documents(spark, d).where("entity_type = 'experience' and metadata.company is not null and metadata.title is not null")
    rows = m.select("metadata.company", "metadata.title", "metadata.location", "document_id", "source_file").distinct()
    return E.merged_entries(rows, ["company", "title"], "document_id").select("company", "title", "location", "first_pos", F.array_join("source_files", ",").alias("source_files"))


# The earlier state, for the queries on incremental extraction: no chunk whose index is 3, an older text where it is 2, and one
# card too many where it is 1; chunks of index 0 that are gone are made up.
_STATE = f"""
WITH {_CARDS}, ch AS (SELECT DISTINCT chunk_id, chunk_index, sha256(coalesce(text, '')) AS fingerprint FROM chunks WHERE chunk_id IS NOT NULL),
have AS (SELECT source_chunk_id AS chunk_id, list_sort(list_distinct(list(evidence_id))) AS ids FROM cards WHERE source_chunk_id IS NOT NULL GROUP BY 1),
state AS (SELECT chunk_id, CASE WHEN chunk_index = 2 THEN 'old' ELSE fingerprint END AS fp, CASE WHEN chunk_index = 1 THEN list_append(coalesce(ids, []), 'zz') ELSE coalesce(ids, []) END AS said FROM ch LEFT JOIN have USING (chunk_id) WHERE chunk_index <> 3
  UNION ALL SELECT 'gone_' || chunk_id, fingerprint, [] FROM ch WHERE chunk_index = 0)
"""


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ch = table(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", "chunk_index", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint")).distinct()
    cards = C.cards(spark, d)
    have = E.cards_by_chunk(cards)
    none = F.array().cast("array<string>")
    ids = F.coalesce("evidence_ids", none)
    old = ch.where("chunk_index <> 3").join(have, "chunk_id", "left").select(
        "chunk_id", F.when(F.col("chunk_index") == 2, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(F.col("chunk_index") == 1, F.array_append(ids, F.lit("zz"))).otherwise(ids).alias("evidence_ids")
    )
    gone = ch.where("chunk_index = 0").select(F.concat(F.lit("gone_"), "chunk_id").alias("chunk_id"), "fingerprint", none.alias("evidence_ids"))
    return ch, old.unionByName(gone), cards


@query(_STATE + "SELECT ch.chunk_id, CASE WHEN fp IS NULL THEN 'new' WHEN fp <> fingerprint THEN 'changed' WHEN list_sort(said) <> coalesce(ids, []) THEN 'damaged' ELSE 'reuse' END AS status FROM ch LEFT JOIN state USING (chunk_id) LEFT JOIN have USING (chunk_id)")
def cache_diff(spark: SparkSession, d: str) -> DataFrame:
    return E.cache_diff(*_state(spark, d))


@query(_STATE + "SELECT count(*) FILTER (WHERE fp IS NULL OR fp <> fingerprint OR list_sort(said) <> coalesce(ids, [])) AS processed, count(*) FILTER (WHERE fp = fingerprint AND list_sort(said) = coalesce(ids, [])) AS skipped FROM ch LEFT JOIN state USING (chunk_id) LEFT JOIN have USING (chunk_id)")
def cache_counters(spark: SparkSession, d: str) -> DataFrame:
    return models.cache_counters(E.cache_diff(*_state(spark, d)))


_PRINT = """sha256('{"document_id":' || to_json(document_id) || ',"entity_type":' || coalesce(to_json(entity_type), 'null') || ',"made_by":"3/m1","source_file":' || coalesce(to_json(source_file), 'null') || '}')"""


@query(f"""
WITH ch AS (SELECT DISTINCT chunk_id, document_id, entity_type, source_file, chunk_index FROM chunks WHERE chunk_id IS NOT NULL AND document_id IS NOT NULL),
st AS (SELECT chunk_id, CASE WHEN chunk_index = 2 THEN 'other' ELSE {_PRINT} END AS fp FROM ch WHERE chunk_index <> 3)
SELECT ch.chunk_id, coalesce(fp = {_PRINT}, false) AS valid FROM ch LEFT JOIN st USING (chunk_id)""")
def cache_valid(spark: SparkSession, d: str) -> DataFrame:
    """Whether each chunk's stored fingerprint is that of its columns and of the model."""
    columns = ("document_id", "entity_type", "source_file")
    ch = table(spark, d, "chunks").where("chunk_id is not null and document_id is not null").select("chunk_id", "chunk_index", *columns).distinct()
    own = ch.withColumn("now", E.fingerprint("m1", *columns))
    old = own.where("chunk_index <> 3").select("chunk_id", F.when(F.col("chunk_index") == 2, "other").otherwise(F.col("now")).alias("fp"))
    return own.join(old, "chunk_id", "left").select("chunk_id", F.coalesce(F.col("fp") == F.col("now"), F.lit(False)).alias("valid"))


@query(_STATE + "SELECT chunk_id FROM state WHERE chunk_id NOT IN (SELECT chunk_id FROM ch)")
def cache_orphans(spark: SparkSession, d: str) -> DataFrame:
    ch, state, _ = _state(spark, d)
    return E.vanished(ch, state)


@query("""
WITH d AS (SELECT DISTINCT source_file, coalesce(page, 0) AS page, document_id, text FROM parsed_documents WHERE source_type = 'pdf' AND text IS NOT NULL AND document_id IS NOT NULL)
SELECT source_file, sha256(string_agg('## Page ' || page || chr(10) || text, chr(10) || chr(10) ORDER BY page, document_id)) AS prompt FROM d GROUP BY 1""")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    """The pages of every file in order as one text, by its hash."""
    p = C.documents(spark, d).where("source_type = 'pdf' and text is not null").select("source_file", F.coalesce("page", F.lit(0)).alias("page"), "document_id", "text").distinct()
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page", "document_id", "text"))), lambda x: F.concat(F.lit("## Page "), x["page"].cast("string"), F.lit("\n"), x["text"]))
    return p.groupBy("source_file").agg(F.sha2(F.array_join(pages, "\n\n"), 256).alias("prompt"))


@query("""
WITH p AS (SELECT DISTINCT entity_id, document_id, metadata.email AS email, metadata.phone AS phone FROM parsed_documents WHERE entity_type = 'profile' AND entity_id IS NOT NULL AND document_id IS NOT NULL)
SELECT entity_id, arg_min(email, document_id) FILTER (trim(coalesce(email, '')) <> '') AS email, arg_min(phone, document_id) FILTER (trim(coalesce(phone, '')) <> '') AS phone FROM p GROUP BY 1""")
def contact_first(spark: SparkSession, d: str) -> DataFrame:
    """Per profile: the first contact of each kind that isn't blank."""
    p = C.documents(spark, d).where("entity_type = 'profile' and entity_id is not null").select("entity_id", "document_id", "metadata.email", "metadata.phone")
    return E.first_filled(p, "entity_id", "document_id", ["email", "phone"])


@query(f"WITH {_CARDS} SELECT count(*) AS n, CAST(sum(CASE WHEN claim IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_claim FROM cards")
def index_size(spark: SparkSession, d: str) -> DataFrame:
    """What a search index of all cards holds: the count that a stored index is checked against."""
    return C.cards(spark, d).agg(F.count("*").alias("n"), F.sum(F.when(F.col("claim").isNull(), 1).otherwise(0)).alias("without_claim"))


# --- selection

_MATCH = f"""
WITH {_CARDS}, sc AS (SELECT requirement_id, evidence_id, {_best('rerank_score')} FROM candidates WHERE requirement_id IS NOT NULL AND evidence_id IS NOT NULL GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY rerank_score DESC, evidence_id) AS pos FROM sc WHERE rerank_score IS NOT NULL QUALIFY pos <= 5),
matches AS (SELECT requirement_id, CASE WHEN max(rerank_score) >= 4 THEN 'strong' WHEN max(rerank_score) >= 0 THEN 'partial' ELSE 'none' END AS match_strength, list(evidence_id ORDER BY pos) AS evidence_ids FROM top GROUP BY 1),
e AS (SELECT requirement_id, match_strength, unnest(evidence_ids) AS evidence_id, unnest(range(len(evidence_ids))) AS pos FROM matches),
prio AS (SELECT evidence_id, max(CASE match_strength WHEN 'strong' THEN 100 WHEN 'partial' THEN 70 ELSE 0 END) AS p FROM e GROUP BY 1),
prio8 AS (SELECT evidence_id, max(CASE match_strength WHEN 'strong' THEN 8 WHEN 'partial' THEN 4 ELSE 0 END) AS p FROM e GROUP BY 1)
"""


@query(_MATCH + "SELECT evidence_id, CAST(max(CASE match_strength WHEN 'strong' THEN 100 WHEN 'partial' THEN 70 ELSE 0 END) AS INT) AS priority, array_to_string(list_sort(coalesce(list_distinct(list(requirement_id) FILTER (match_strength <> 'none')), [])), ',') AS requirement_ids FROM e GROUP BY 1")
def match_priority(spark: SparkSession, d: str) -> DataFrame:
    return S.priorities(C.matches(spark, d), S.PLAN_WEIGHTS).withColumn("requirement_ids", F.array_join("requirement_ids", ","))


@query(_MATCH + """, k AS (SELECT requirement_id, list(evidence_id ORDER BY pos) AS kept FROM e JOIN cards USING (evidence_id) WHERE cards.category IN ('achievement', 'experience', 'project') GROUP BY 1)
SELECT requirement_id, CASE WHEN kept IS NOT NULL AND match_strength IN ('strong', 'partial') THEN match_strength ELSE 'none' END AS match_strength, CASE WHEN kept IS NOT NULL AND match_strength IN ('strong', 'partial') THEN array_to_string(kept, ',') ELSE '' END AS evidence_ids
FROM matches LEFT JOIN k USING (requirement_id)""")
def match_downgrade(spark: SparkSession, d: str) -> DataFrame:
    """Matches kept to cards of three categories; what loses all its cards is downgraded."""
    m = C.matches(spark, d)
    fit = C.cards(spark, d).where("category in ('achievement', 'experience', 'project')").select("evidence_id")
    allowed = m.select("requirement_id", F.explode("evidence_ids").alias("evidence_id")).join(fit, "evidence_id")
    return S.downgraded(m, allowed).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


_BASE = "list_last(string_split(coalesce(source_file, ''), '/'))"
_CATRANK = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.PLAN_CATEGORY.items()) + " ELSE 0 END"
_PLAN = _MATCH + f""", r AS (SELECT cards.*, coalesce(p, 0) AS r1, CASE WHEN lower({_BASE}) IN {S.CANONICAL} THEN 2 ELSE 0 END AS r2, {_CATRANK} AS r3, CASE WHEN len(coalesce(metrics, [])) > 0 THEN 2 ELSE 0 END AS r4, least(len(coalesce(skills, [])), 3) AS r5,
  CASE WHEN contains(source_file, '/') THEN string_split(source_file, '/')[1] ELSE 'shared' END AS plan FROM cards LEFT JOIN prio USING (evidence_id))"""
_BEST = "r1 DESC, r2 DESC, r3 DESC, r4 DESC, r5 DESC, evidence_id DESC"


def _planned(spark: SparkSession, d: str) -> DataFrame:
    c = C.cards(spark, d).join(S.priorities(C.matches(spark, d), S.PLAN_WEIGHTS).select("evidence_id", "priority"), "evidence_id", "left")
    plan = F.when(F.col("source_file").contains("/"), F.element_at(F.split("source_file", "/"), 1)).otherwise("shared")
    return c.withColumn("plan", plan)


@query(_PLAN + " SELECT evidence_id, CAST(r1 AS INT) AS r1, CAST(r2 AS INT) AS r2, CAST(r3 AS INT) AS r3, CAST(r4 AS INT) AS r4, CAST(r5 AS INT) AS r5 FROM r")
def planner_rank(spark: SparkSession, d: str) -> DataFrame:
    return S.plan_order(_planned(spark, d)).select("evidence_id", "r1", "r2", "r3", "r4", "r5")


@query(_PLAN + f""", said AS (SELECT *, {_FOLD.format(_strip("coalesce(claim, '')"))} AS said FROM r),
once AS (SELECT * FROM said WHERE said <> '' QUALIFY row_number() OVER (PARTITION BY plan, entity_id, said ORDER BY {_BEST}) = 1),
nth AS (SELECT *, row_number() OVER (PARTITION BY plan, entity_id ORDER BY {_BEST}) AS k, CASE entity_type WHEN 'experience' THEN 0 WHEN 'project' THEN 1 END AS entry FROM once),
ph AS (SELECT *, CASE WHEN r1 > 0 THEN 0 WHEN entry IS NOT NULL AND k <= 3 THEN 1 ELSE 2 END AS phase FROM nth)
SELECT plan, evidence_id, CAST(phase AS INT) AS phase, CAST(row_number() OVER (PARTITION BY plan ORDER BY phase, CASE WHEN phase = 1 THEN entry END NULLS LAST, {_BEST}) AS INT) AS pick FROM ph QUALIFY pick <= 28""")
def planner_select(spark: SparkSession, d: str) -> DataFrame:
    return S.plan_selection(_planned(spark, d), "plan").select("plan", "evidence_id", "phase", "pick")


_CCAT = "CASE lower(coalesce(category, '')) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.COMPOSE_CATEGORY.items()) + " ELSE 0 END"
_COMPOSE = _MATCH + f""", s AS (SELECT evidence_id, entity_id, CAST(coalesce(p, 0) + CASE WHEN len(coalesce(metrics, [])) > 0 THEN 4 ELSE 0 END + {_CCAT} + CASE WHEN regexp_matches(coalesce(claim, ''), '{T.ACTION}') THEN 2 ELSE 0 END
  - CASE WHEN regexp_matches(coalesce(claim, ''), '{T.FILLER}') THEN 5 ELSE 0 END AS INT) AS score, CAST(least(length(coalesce(claim, '')), 180) AS INT) AS weight FROM cards LEFT JOIN prio8 USING (evidence_id))"""


def _composed(spark: SparkSession, d: str) -> DataFrame:
    return S.compose_score(C.cards(spark, d).join(S.priorities(C.matches(spark, d), S.COMPOSE_WEIGHTS).select("evidence_id", "priority"), "evidence_id", "left"))


@query(_COMPOSE + " SELECT evidence_id, score, weight FROM s")
def compose_rank(spark: SparkSession, d: str) -> DataFrame:
    return _composed(spark, d).select("evidence_id", "score", "weight")


@query(_COMPOSE + " SELECT entity_id, evidence_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, weight DESC, evidence_id DESC) AS INT) AS place FROM s WHERE entity_id IS NOT NULL QUALIFY place <= 3")
def compose_quota(spark: SparkSession, d: str) -> DataFrame:
    return S.compose_best(_composed(spark, d).where("entity_id is not null"), "entity_id", 3).select("entity_id", "evidence_id", "place")


@query(f"WITH x AS (SELECT DISTINCT unnest(skills) AS skill FROM evidence) SELECT {_strip('skill')} AS skill, CASE " + " ".join(f"WHEN {_FOLD.format(_strip('skill'))} IN {v} THEN '{k}'" for k, v in S.SKILL_GROUPS.items()) + " ELSE 'Other' END AS skill_group, count(*) AS spellings FROM x WHERE skill IS NOT NULL GROUP BY 1, 2")
def skill_grouping(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "evidence").select(F.explode("skills").alias("skill")).where("skill is not null").distinct().withColumn("skill", T.strip(F.col("skill")))
    return s.groupBy("skill", S.skill_group(F.col("skill")).alias("skill_group")).agg(F.count("*").alias("spellings"))


@query(rf"""
WITH r AS (SELECT DISTINCT requirement_id, text, skills FROM requirements WHERE requirement_id IS NOT NULL), x AS (SELECT requirement_id AS owner, {_FOLD.format('text')} AS job, unnest(skills) AS s, unnest(range(len(skills))) AS pos FROM r),
y AS (SELECT owner, job, pos, {_strip('s')} AS skill FROM x WHERE s IS NOT NULL), z AS (SELECT owner, job, {_FOLD.format('skill')} AS folded, min_by(skill, pos) AS skill FROM y WHERE skill <> '' AND length(skill) <= 42 AND NOT contains(skill, ':') AND NOT contains(skill, chr(10)) GROUP BY 1, 2, 3),
q AS (SELECT *, CASE WHEN coalesce(regexp_matches(job, '(^|\W)' || regexp_escape(folded) || '(\W|$)'), false) THEN 6 ELSE 0 END AS score FROM z)
SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY score DESC, folded) AS INT) AS place, skill, score FROM q QUALIFY place <= 16""")
def pick_skills(spark: SparkSession, d: str) -> DataFrame:
    """Per requirement: its skills, those that its text names first, then by spelling."""
    r = table(spark, d, "requirements").where("requirement_id is not null").select(F.col("requirement_id").alias("owner"), "text", "skills").distinct()
    return S.best_skills(r.select("owner", F.posexplode("skills").alias("pos", "skill")), r.select("owner", "text"))


_LAYOUT = f"""WITH {_BULLETS}, p AS (SELECT section, entry_id, bullet_id, row_number() OVER (PARTITION BY section, entry_id ORDER BY bullet_id) - 1 AS bullet_pos FROM bs WHERE entry_id IS NOT NULL)"""


@query(f"""WITH {_BULLETS}, b AS (SELECT substr(md5(entry_id), 1, 2) AS owner, section, CAST('0x' || substr(md5(entry_id), 3, 6) AS INT) AS entry_pos, bullet_id FROM bs WHERE entry_id IS NOT NULL AND section IN ('projects', 'experience')),
n AS (SELECT *, row_number() OVER (PARTITION BY owner, section, entry_pos ORDER BY bullet_id) AS k FROM b)
SELECT owner, section, entry_pos, bullet_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY CASE section WHEN 'projects' THEN 0 ELSE 1 END, entry_pos DESC, bullet_id DESC) AS INT) AS step FROM n WHERE k > 1 QUALIFY step <= 32""")
def layout_trim_order(spark: SparkSession, d: str) -> DataFrame:
    """What 256 documents, to which entries are dealt by hash, would drop first."""
    h = F.md5("entry_id")
    b = _bullets(spark, d).where("entry_id is not null").select(F.substring(h, 1, 2).alias("owner"), "section", F.conv(F.substring(h, 3, 6), 16, 10).cast("int").alias("entry_pos"), F.col("bullet_id").alias("bullet"))
    return S.trim_order(b).select("owner", "section", "entry_pos", F.col("bullet").alias("bullet_id"), "step")


def _near_sql(a: str, b: str) -> str:
    return f"({_jaccard_sql(_WORDSET.format(a), _WORDSET.format(b))}) >= 0.72"


@query(f"""
WITH {_BULLETS}, r AS (SELECT entry_id, bullet_id, text FROM bs WHERE entry_id IS NOT NULL AND text IS NOT NULL),
f1 AS (SELECT entry_id, min(bullet_id) AS bullet_id, min_by(text, bullet_id) AS text FROM r GROUP BY 1),
r2 AS (SELECT r.* FROM r JOIN f1 USING (entry_id) WHERE r.bullet_id > f1.bullet_id AND NOT {_near_sql('r.text', 'f1.text')}), f2 AS (SELECT entry_id, min(bullet_id) AS bullet_id, min_by(text, bullet_id) AS text FROM r2 GROUP BY 1),
r3 AS (SELECT r2.* FROM r2 JOIN f2 USING (entry_id) WHERE r2.bullet_id > f2.bullet_id AND NOT {_near_sql('r2.text', 'f2.text')}), f3 AS (SELECT entry_id, min(bullet_id) AS bullet_id FROM r3 GROUP BY 1)
SELECT entry_id, CAST(1 AS INT) AS place, bullet_id FROM f1 UNION ALL SELECT entry_id, 2, bullet_id FROM f2 UNION ALL SELECT entry_id, 3, bullet_id FROM f3""")
def bullets_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Per entry: its first three bullets that don't repeat one another in other words."""
    return E.greedy_first(_bullets(spark, d), "entry_id", "bullet_id", "text").select("entry_id", "place", "bullet_id")


@query(_LAYOUT.replace("bullet_id, row_number", "bullet_id, text, row_number").replace("FROM bs WHERE entry_id IS NOT NULL", "FROM bs WHERE entry_id IS NOT NULL AND validated AND text IS NOT NULL") + f""", i AS (SELECT entry_id, bullet_id, array_to_string({_escaped_sql(_INLINE)}, '') AS t FROM p)
SELECT entry_id, '\\begin{{itemize}}' || chr(10) || string_agg('\\item ' || t, chr(10) ORDER BY bullet_id) || chr(10) || '\\end{{itemize}}' AS items FROM i GROUP BY 1""")
def render_items(spark: SparkSession, d: str) -> DataFrame:
    return R.latex_items(_bullets(spark, d).where("entry_id is not null and text is not null").withColumn("pos", F.col("bullet_id")), "entry_id")


# --- composition


@query(f"""SELECT evidence_id, length({_strip("coalesce(claim, '')")}) >= 26 AND NOT regexp_matches({_strip("coalesce(claim, '')")}, '{T.FILLER}') AND coalesce(category, '') NOT IN ('education', 'certification', 'skill') AS eligible FROM evidence""")
def pred_eligible(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").select("evidence_id", K.eligible(F.col("claim"), F.col("category")).alias("eligible"))


_KEPT = f"""
WITH {_CARDS}, {_BULLETS}, x AS (SELECT bullet_id, entry_id, CASE section WHEN 'experience' THEN 'experience' WHEN 'projects' THEN 'project' END AS kind, unnest(evidence_ids) AS evidence_id FROM bs),
foreign_ AS (SELECT DISTINCT x.bullet_id FROM x LEFT JOIN cards USING (evidence_id) WHERE NOT coalesce(entity_id = x.entry_id AND entity_type = kind, false)),
r AS (SELECT CASE section WHEN 'experience' THEN 'experience' ELSE 'project' END AS kind, entry_id, bullet_id, text, evidence_ids FROM bs WHERE section IN ('experience', 'projects') AND entry_id IS NOT NULL AND text IS NOT NULL AND len(evidence_ids) > 0 AND bullet_id NOT IN (SELECT bullet_id FROM foreign_)
  AND {_words_sql('text')} <= 43 AND NOT regexp_matches(text, '{T.FILLER}')),
f1 AS (SELECT kind, entry_id, min(bullet_id) AS bullet_id, min_by(text, bullet_id) AS text FROM r GROUP BY 1, 2),
r2 AS (SELECT r.* FROM r JOIN f1 USING (kind, entry_id) WHERE r.bullet_id > f1.bullet_id AND NOT {_near_sql('r.text', 'f1.text')}), f2 AS (SELECT kind, entry_id, min(bullet_id) AS bullet_id, min_by(text, bullet_id) AS text FROM r2 GROUP BY 1, 2),
r3 AS (SELECT r2.* FROM r2 JOIN f2 USING (kind, entry_id) WHERE r2.bullet_id > f2.bullet_id AND NOT {_near_sql('r2.text', 'f2.text')}), f3 AS (SELECT kind, entry_id, min(bullet_id) AS bullet_id, min_by(text, bullet_id) AS text FROM r3 WHERE kind = 'experience' GROUP BY 1, 2),
kept AS (SELECT *, 1 AS place FROM f1 UNION ALL SELECT *, 2 FROM f2 UNION ALL SELECT *, 3 FROM f3)
"""


@query(_KEPT + "SELECT kind, entry_id, CAST(place AS INT) AS place, bullet_id FROM kept")
def keep_existing(spark: SparkSession, d: str) -> DataFrame:
    """What each entry keeps of its statements: owned, short, without filler, each said once."""
    return K.kept_existing(_bullets(spark, d), C.cards(spark, d)).select("kind", "entry_id", "place", "bullet_id")


_TOPPED = _KEPT + ", " + _COMPOSE.split("WITH", 1)[1].replace(_CARDS + ", ", "", 1) + f"""
, el AS (SELECT cards.entity_id AS entry_id, cards.entity_type AS kind, evidence_id, claim, score, weight FROM cards JOIN s USING (evidence_id) WHERE cards.entity_type IN ('experience', 'project') AND cards.entity_id IS NOT NULL
  AND length({_strip("coalesce(claim, '')")}) >= 26 AND NOT regexp_matches({_strip("coalesce(claim, '')")}, '{T.FILLER}') AND coalesce(category, '') NOT IN ('education', 'certification', 'skill')),
had AS (SELECT kind, entry_id, count(*) AS n, list({_WORDSET.format('text')}) AS sets, flatten(list(ids)) AS used FROM kept JOIN (SELECT bullet_id, evidence_ids AS ids FROM bs) USING (bullet_id) GROUP BY 1, 2),
lists AS (SELECT kind, entry_id, list({{'n': 0, 'calls': 0, 'sets': CAST([] AS VARCHAR[][]), 'used': CAST([] AS VARCHAR[]), 'out': CAST([] AS VARCHAR[]), 'id': evidence_id, 'ws': {_WORDSET.format('claim')}, 'nw': {_words_sql('claim')}}} ORDER BY score DESC, weight DESC, evidence_id DESC) AS cands FROM el GROUP BY 1, 2),
folded AS (SELECT kind, entry_id, coalesce(n, 0) AS n0, list_reduce(list_concat([{{'n': CAST(coalesce(n, 0) AS INT), 'calls': 0, 'sets': coalesce(sets, []), 'used': coalesce(used, []), 'out': CAST([] AS VARCHAR[]), 'id': '', 'ws': CAST([] AS VARCHAR[]), 'nw': 0}}], cands),
  lambda a, x: CASE WHEN a.n >= CASE kind WHEN 'experience' THEN 3 ELSE 2 END OR a.calls >= 5 OR list_contains(a.used, x.id) OR len(list_filter(a.sets, lambda w: ({_jaccard_sql('w', 'x.ws')}) >= 0.72)) > 0 THEN a
    WHEN x.nw > 38 THEN {{'n': a.n, 'calls': a.calls + 1, 'sets': a.sets, 'used': a.used, 'out': a.out, 'id': '', 'ws': CAST([] AS VARCHAR[]), 'nw': 0}}
    ELSE {{'n': a.n + 1, 'calls': a.calls + 1, 'sets': list_append(a.sets, x.ws), 'used': list_append(a.used, x.id), 'out': list_append(a.out, x.id), 'id': '', 'ws': CAST([] AS VARCHAR[]), 'nw': 0}} END) AS f FROM lists LEFT JOIN had USING (kind, entry_id)),
made AS (SELECT kind, entry_id, n0, unnest(f.out) AS evidence_id, unnest(range(len(f.out))) + 1 AS k FROM folded)
SELECT kind, entry_id, CAST(place AS INT) AS place, text, false AS made FROM kept
UNION ALL SELECT kind, entry_id, CAST(n0 + k AS INT), {_strip('regexp_replace(' + _strip('claim') + chr(44) + chr(32) + chr(39) + '^(- )?(• )?([*] )?' + chr(39) + ', ' + chr(39) * 2 + ')')}, true FROM made JOIN cards USING (evidence_id)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    c = _composed(spark, d).where("entity_type in ('experience', 'project') and entity_id is not null").where(K.eligible(F.col("claim"), F.col("category")))
    return c.select(F.col("entity_id").alias("entry_id"), F.col("entity_type").alias("kind"), "evidence_id", "claim", "score", "weight")


@query(_TOPPED)
def compose_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every entry's statements: those it keeps, topped up with statements written from its best cards and checked against them."""
    cards, b = C.cards(spark, d), _bullets(spark, d)
    kept = K.kept_existing(b, cards).join(b.select("bullet_id", "evidence_ids"), "bullet_id")
    out = K.top_up(kept, _candidates(spark, d), models.composer(cards, ClaimWriter(), WordChecker()))
    return out.select("kind", "entry_id", "place", "text", "made")


_PROFILE = "pe AS (SELECT DISTINCT entity_type AS kind, entity_id AS entry_id FROM parsed_documents WHERE entity_type IN ('experience', 'project') AND entity_id IS NOT NULL)"


@query(f"""
WITH {_CARDS}, {_PROFILE}, pb AS (SELECT DISTINCT bullet_id, section, CASE WHEN section <> 'summary' THEN entry_id END AS entry_id, CASE section WHEN 'experience' THEN 'experience' WHEN 'projects' THEN 'project' END AS kind, evidence_ids, requirement_ids FROM bullets WHERE bullet_id IS NOT NULL AND section IN ('summary', 'experience', 'projects')),
ok AS (SELECT pb.* FROM pb LEFT JOIN pe ON pe.kind = pb.kind AND pe.entry_id = pb.entry_id WHERE section = 'summary' OR pe.entry_id IS NOT NULL),
e AS (SELECT bullet_id, kind, entry_id, unnest(evidence_ids) AS evidence_id, unnest(range(len(evidence_ids))) AS pos FROM ok), fit AS (SELECT bullet_id, list(evidence_id ORDER BY pos) AS ids FROM e JOIN cards USING (evidence_id) WHERE kind IS NULL OR (entity_id = entry_id AND entity_type = kind) GROUP BY 1),
q AS (SELECT bullet_id, unnest(requirement_ids) AS requirement_id, unnest(range(len(requirement_ids))) AS pos FROM ok), asked AS (SELECT bullet_id, list(requirement_id ORDER BY pos) AS req FROM q WHERE requirement_id IN (SELECT requirement_id FROM requirements) GROUP BY 1)
SELECT bullet_id, section, entry_id, array_to_string(ids, ',') AS evidence_ids, coalesce(array_to_string(req, ','), '') AS requirement_ids FROM ok JOIN fit USING (bullet_id) LEFT JOIN asked USING (bullet_id)""")
def plan_guard(spark: SparkSession, d: str) -> DataFrame:
    """Planned statements that keep to known entries, cards of theirs, and known requirements."""
    b = table(spark, d, "bullets").where("bullet_id is not null").select("bullet_id", "section", "entry_id", "evidence_ids", "requirement_ids").distinct()
    entries = C.documents(spark, d).where("entity_type in ('experience', 'project') and entity_id is not null").select(F.col("entity_type").alias("kind"), F.col("entity_id").alias("entry_id"))
    out = K.guarded_plan(b, entries, C.cards(spark, d), table(spark, d, "requirements").where("requirement_id is not null"))
    return out.withColumns({"evidence_ids": F.array_join("evidence_ids", ","), "requirement_ids": F.array_join("requirement_ids", ",")})


@query(f"""
WITH r AS (SELECT DISTINCT requirement_id AS owner, skills, string_split(role_title, ' ') AS own FROM requirements WHERE requirement_id IS NOT NULL), sup AS (SELECT {_FOLD.format('skill_name')} AS folded, max(skill_name) AS shown FROM skill_catalog GROUP BY 1),
w AS (SELECT owner, unnest(skills) AS skill, unnest(range(len(skills))) AS pos FROM r), o AS (SELECT owner, unnest(own) AS skill, unnest(range(len(own))) AS pos FROM r),
first AS (SELECT owner, shown, min(pos) AS pos FROM w JOIN sup ON folded = {_FOLD.format('skill')} GROUP BY 1, 2), rest AS (SELECT owner, shown, min(pos) AS pos FROM o JOIN sup ON folded = {_FOLD.format('skill')} WHERE owner NOT IN (SELECT owner FROM first) GROUP BY 1, 2)
SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY pos, shown) AS INT) AS place, shown AS skill FROM (SELECT * FROM first UNION ALL SELECT * FROM rest)""")
def plan_skills(spark: SparkSession, d: str) -> DataFrame:
    """Per requirement: the catalogue's spelling of its skills, or where it has none of those, of the words of its role."""
    r = table(spark, d, "requirements").where("requirement_id is not null").select(F.col("requirement_id").alias("owner"), "skills", F.split("role_title", " ").alias("own")).distinct()
    return K.emphasised(r.select("owner", F.posexplode("skills").alias("pos", "skill")), r.select("owner", F.posexplode("own").alias("pos", "skill")), table(spark, d, "skill_catalog").select(F.col("skill_name").alias("skill")))


@query("""
WITH e AS (SELECT DISTINCT source_file AS owner, entity_type AS kind, entity_id AS entry_id, document_id AS pos, metadata.technologies AS technologies FROM parsed_documents WHERE entity_type IN ('experience', 'project') AND document_id IS NOT NULL AND source_file IS NOT NULL)
SELECT owner, kind, entry_id, pos, array_to_string(coalesce(technologies[:7], []), ',') AS technologies, CAST(row_number() OVER (PARTITION BY owner, kind ORDER BY pos, entry_id NULLS FIRST) AS INT) AS place FROM e QUALIFY place <= CASE kind WHEN 'experience' THEN 3 ELSE 2 END""")
def entry_limits(spark: SparkSession, d: str) -> DataFrame:
    """The first three experiences and two projects of every file, technologies cut to seven."""
    m = C.documents(spark, d).where("entity_type in ('experience', 'project') and source_file is not null")
    e = m.select(F.col("source_file").alias("owner"), F.col("entity_type").alias("kind"), F.col("entity_id").alias("entry_id"), F.col("document_id").alias("pos"), "metadata.technologies").distinct()
    return K.limited_entries(e, "owner").withColumn("technologies", F.array_join("technologies", ","))


@query(_CITED + f""", j AS (SELECT bullet_id, pos, evidence_id, claim FROM x JOIN cards USING (evidence_id))
SELECT bullet_id, count(*) AS n_cards, arg_min(evidence_id, pos) AS first_id, arg_max(evidence_id, pos) AS last_id FROM j GROUP BY 1""")
def prompt_payload(spark: SparkSession, d: str) -> DataFrame:
    """The cards of every statement as they go into a prompt, written as JSON and read back."""
    e = models.evidence_payload(_bullets(spark, d).select(F.col("bullet_id").alias("id"), "evidence_ids"), C.cards(spark, d), ("claim", "skills", "metrics"))
    back = F.from_json(F.to_json(F.struct("evidence")), "evidence array<struct<evidence_id:string,claim:string>>")["evidence"]
    return e.select(F.col("id").alias("bullet_id"), back.alias("b")).select("bullet_id", F.size("b").cast("long").alias("n_cards"), F.element_at("b", 1)["evidence_id"].alias("first_id"), F.element_at("b", -1)["evidence_id"].alias("last_id"))


@query("""
WITH p AS (SELECT DISTINCT metadata.name AS name, document_id AS pos, source_file, source_type = 'markdown' AS canonical, metadata.date AS date, metadata.technologies AS technologies FROM parsed_documents WHERE entity_type = 'project' AND document_id IS NOT NULL AND metadata.name IS NOT NULL AND source_type IS NOT NULL),
v AS (SELECT name, min(pos) AS first_pos, coalesce(max(pos) FILTER (canonical), min(pos)) AS at FROM p GROUP BY 1), t AS (SELECT name, pos, unnest(technologies) AS item, unnest(range(len(technologies))) AS k FROM p), o AS (SELECT name, item, min((pos, k)) AS p FROM t WHERE item IS NOT NULL GROUP BY 1, 2)
SELECT v.name, first_pos, p.date, coalesce((SELECT string_agg(item, ',' ORDER BY o.p, item) FROM o WHERE o.name = v.name), '') AS technologies FROM v JOIN p ON p.name = v.name AND p.pos = v.at""")
def profile_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects by name: the values of their last structured document, else of their first, and the technologies of all."""
    m = C.documents(spark, d).where("entity_type = 'project' and metadata.name is not null and source_type is not null")
    rows = m.select("metadata.name", F.col("document_id").alias("pos"), "source_file", (F.col("source_type") == "markdown").alias("canonical"), "metadata.date", "metadata.technologies").distinct()
    return E.merged_entries(rows, ["name"], "pos", "canonical", "technologies").select("name", "first_pos", "date", F.array_join("technologies", ",").alias("technologies"))


@query("""
WITH m AS (SELECT DISTINCT document_id AS conv_id, chunk_index AS turn, CASE chunk_index % 3 WHEN 0 THEN 'system' WHEN 1 THEN 'user' ELSE 'assistant' END AS role, chunk_id AS text FROM chunks WHERE document_id IS NOT NULL AND chunk_index IS NOT NULL AND chunk_id IS NOT NULL),
lead AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS lead FROM m WHERE role = 'system' GROUP BY 1), rest AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM m WHERE role <> 'system')
SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, CASE WHEN n = 1 AND role = 'user' AND lead IS NOT NULL THEN lead || chr(10) || chr(10) || text ELSE text END AS text FROM rest LEFT JOIN lead USING (conv_id)
UNION ALL SELECT lead.conv_id, CAST(-1 AS BIGINT), 'user', lead FROM lead LEFT JOIN rest ON rest.conv_id = lead.conv_id AND n = 1 WHERE role IS NULL OR role <> 'user'""")
def msg_merge_system(spark: SparkSession, d: str) -> DataFrame:
    """A document's chunks as a conversation (every third one a system message), the system texts led into the first other message."""
    ch = table(spark, d, "chunks").where("document_id is not null and chunk_index is not null and chunk_id is not null")
    role = F.when(F.col("chunk_index") % 3 == 0, "system").when(F.col("chunk_index") % 3 == 1, "user").otherwise("assistant")
    return E.with_system_first(ch.select(F.col("document_id").alias("conv_id"), F.col("chunk_index").alias("turn"), role.alias("role"), F.col("chunk_id").alias("text")).distinct())
