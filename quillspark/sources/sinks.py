"""Writing tables and single documents."""

from __future__ import annotations

import os
import shutil
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Overwrites; JSON lines keep null fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").format(fmt).save(path)


def write_atomic(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Writes beside the target and renames, so that readers see the old table or the new one."""
    staging, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    write_records(df, staging, fmt)
    fs, target = _fs(df.sparkSession, path)
    new, aside = _fs(df.sparkSession, staging)[1], _fs(df.sparkSession, old)[1]
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, target):
        fs.rename(aside, target)
        raise OSError(f"can't move the new table to {path}")
    fs.delete(aside, True)


def write_extraction(cards: DataFrame, state: DataFrame, folder: str) -> None:
    """Cards first, then the state: a crash in between only costs a new extraction."""
    write_atomic(cards, f"{folder}/evidence", "parquet")
    write_atomic(state, f"{folder}/state", "json")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One UTF-8 file."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_document(document: DataFrame, path: str) -> None:
    """One document (a row of structs and arrays) as one JSON text, null fields kept; more rows than one are an error."""
    rows = document.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("j")).take(2)
    if len(rows) != 1:
        raise ValueError("a document is one row")
    write_text(document.sparkSession, rows[0].j + "\n", path)


def compile_pdf(tex: str, compiler: str = "pdflatex") -> str | None:
    """Compiles a LaTeX file beside itself; None where the compiler isn't installed, RuntimeError with the end of its output where it fails."""
    program = shutil.which(compiler)
    if program is None:
        return None
    done = subprocess.run([program, "-interaction=nonstopmode", "-halt-on-error", os.path.basename(tex)], cwd=os.path.dirname(tex) or ".", capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(done.stdout[-5000:])
    return os.path.splitext(tex)[0] + ".pdf"
