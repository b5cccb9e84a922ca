"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rank file that is used where the caller names none; a parameter of every operator that counts tokens.
DEFAULT_RANKS = os.environ.get("QUILLSPARK_RANKS", "byte_bpe_multi_50k.tiktoken")


def rank_file(name: str = DEFAULT_RANKS) -> str:
    """The path itself, or the place of a file of the installed public vocabularies (the module ``public_tokenizers``, see README)."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """Every token of a rank file with its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def token_counts(df: DataFrame, key: list[str], text: str, vocabulary: str = DEFAULT_RANKS) -> DataFrame:
    """The ``key`` columns and n_tokens of every non-null text that has tokens; rows equal in both count once."""
    path = rank_file(vocabulary)
    rows = df.select(*key, F.col(text).cast("string").alias("__text")).where(F.length("__text") > 0)
    names = [f.name for f in rows.schema.fields[:-1]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            n = [len(encode.encode_ordinary(t)) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(n, pa.int64())], [*names, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, f"{schema}, n_tokens bigint").where("n_tokens > 0").distinct()
