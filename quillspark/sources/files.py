"""Reading collections of files and the pipeline's own tables."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions.text import clean
from quillspark.operators import markdown as md
from quillspark.runtime import Scratch


# What is looked for in the names of files, whatever its case; only matching files are opened.
GLOBS = {"text": "*.{[mM][dD],[tT][xX][tT]}", "pdf": "*.[pP][dD][fF]", "all": "*.{[mM][dD],[tT][xX][tT],[pP][dD][fF]}"}


def discover(spark: SparkSession, root: str, what: str = "all") -> DataFrame:
    """(path, kind, content) of the .pdf, .md and .txt files under a folder, whatever the case of the ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOBS[what]).load(root)
    kind = F.when(F.lower("path").endswith(".pdf"), "pdf").when(F.lower("path").endswith(".txt"), "txt").when(F.lower("path").endswith(".md"), F.when(md.is_canonical(F.col("path")), "canonical").otherwise("markdown"))
    return files.select("path", kind.alias("kind"), "content").where("kind is not null")


def job_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file whole as one UTF-8 text; a missing one is an error."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _named(df: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumns({"source_file": name, "stem": F.regexp_replace(name, r"\.[^.]*$", "")})


def text_documents(files: DataFrame) -> DataFrame:
    """Every text or plain Markdown file as one document; bytes that aren't UTF-8 are left out, blank files have no row."""
    text = F.replace(F.expr("try_validate_utf8(cast(content as string))"), F.lit("\r\n"), F.lit("\n"))
    lenient = F.coalesce(text, F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), "�", ""))
    d = _named(files.where("kind in ('txt', 'markdown')")).withColumn("text", clean(lenient)).where("text <> ''")
    return d.select(F.col("stem").alias("document_id"), "source_file", F.col("kind").alias("source_type"), "text", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("entity_type"))


def pdf_documents(files: DataFrame, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """Every non-blank page of every PDF as one document; ``pages`` turns a file into the texts of its pages, files that it fails on are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, n, t) for n, t in enumerate(pages(content), 1) if t and t.strip()]
                except Exception as error:  # whatever a reader raises for a broken file
                    logging.getLogger(__name__).warning("%s is left out: %s", path, error)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], ["path", "page", "text"])

    read = files.where("kind = 'pdf'").select("path", "content").mapInArrow(run, "path string, page int, text string")
    d = _named(read)
    return d.select(F.format_string("%s_page_%d", "stem", "page").alias("document_id"), "source_file", F.lit("pdf").alias("source_type"), clean(F.col("text")).alias("text"), "page", F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("entity_type"))


def canonical_documents(files: DataFrame) -> DataFrame:
    """Every entity of the structured files as one document with its metadata; a missing required field stops the read with its name and file."""
    lines = md.numbered_lines(files.where("kind = 'canonical'").select("path", F.expr("cast(content as string)").alias("text")))
    d = _named(md.canonical_entities(Scratch(files.sparkSession).write(lines, "lines")))
    broken = F.raise_error(F.concat_ws(" ", F.col("path"), F.lit("has no"), F.col("problem"), F.lit("in"), F.col("entity_id")))
    text = F.when(F.col("problem").isNotNull(), broken).otherwise(F.col("text"))
    return d.select(F.col("entity_id").alias("document_id"), "source_file", F.lit("markdown").alias("source_type"), text.alias("text"), F.lit(None).cast("int").alias("page"), "entity_id", "entity_type", "metadata")


def parse_corpus(spark: SparkSession, root: str, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """All documents of a folder: canonical entities, texts, and PDF pages where a reader for them is given.

    The folder's text files are read once for the structured and once for the other ones, PDFs only by their branch; a broken structured
    file stops the read, other broken files are left out. Rows are in order of file and place within it.
    """
    none = F.lit(None).cast(schemas.METADATA).alias("metadata")
    texts = discover(spark, root, "text")
    out = canonical_documents(texts).unionByName(text_documents(texts).select("*", none))
    if pages:
        out = out.unionByName(pdf_documents(discover(spark, root, "pdf"), pages).select("*", none))
    return out.orderBy("source_file", F.coalesce("page", F.lit(0)), "document_id")


def read_records(spark: SparkSession, path: str, kind: str, missing_ok: bool = False) -> DataFrame:
    """JSON lines of a known record kind; blank lines are skipped, a bad line fails the read, a missing file is empty only if allowed."""
    ddl = schemas.RECORDS[kind]
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        if missing_ok:
            return spark.createDataFrame([], ddl)
        raise FileNotFoundError(path)
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def read_state(spark: SparkSession, path: str, version: int = 3) -> DataFrame:
    """The extraction state (chunk_id, fingerprint, evidence_ids); a missing, unreadable or other version's is empty."""
    ddl = schemas.RECORDS["state"]
    try:
        rows = spark.read.schema(f"{ddl}, version int").json(path)
        rows = rows.where((F.col("version") == version) & F.col("chunk_id").isNotNull() & F.col("fingerprint").isNotNull()).drop("version")
        rows.isEmpty()
        return rows
    except Exception:  # whatever is wrong with it, everything is extracted again
        return spark.createDataFrame([], ddl)
