"""Models as pluggable vectorised columns: a registry of factories, and deterministic ones that need no model file."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspark.functions.text import TOKEN, jaccard, word_set

DIMENSIONS = 64
_TOKEN = re.compile(TOKEN)


class TextModel(Protocol):
    """What a generator plugs in: a version for fingerprints and a batch call."""

    version: str

    def generate(self, prompts: list[str]) -> list[str]: ...


class ClaimWriter:
    """A writer that needs no model: the claim of the first card of the payload is the statement."""

    version = "claims-1"

    def generate(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"text": json.loads(p.split("\n\nThe last answer", 1)[0])["evidence"][0]["claim"]}) for p in prompts]


class WordChecker:
    """A checker that needs no model: a statement is supported if every word of it stands in its cards."""

    version = "words-1"

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in map(json.loads, prompts):
            known = set(re.findall(r"\w+", " ".join(str(c.get("claim")) for c in p["evidence"]).lower()))
            odd = [w for w in re.findall(r"\w+", p["generated_statement"].lower()) if w not in known]
            out.append(json.dumps({"supported": not odd, "unsupported_claims": odd, "reason": "words without evidence" if odd else ""}))
        return out


def embed(text: Column) -> Column:
    """Unit vectors of hashed search tokens, whole batches at a time: deterministic, and close for texts that share words; a stand-in for a model."""

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        parts = [[w.lower() for w in _TOKEN.findall(t or "")] for t in texts]
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        known = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in {w for p in parts for w in p}}
        h = np.fromiter((known[w] for p in parts for w in p), np.uint64, len(row))
        v = np.zeros((len(parts), DIMENSIONS))
        np.add.at(v, (row, (h % np.uint64(DIMENSIONS)).astype(np.int64)), np.where(h >> np.uint64(31), 1.0, -1.0))
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series(list((v / np.where(n > 0, n, 1)).astype(np.float32)))

    return run(text)


def overlap_score(query: str, doc: str) -> Callable[[DataFrame], DataFrame]:
    """A reranker by shared words of two columns: the stand-in for a cross-encoder."""
    return lambda df: df.withColumn("rerank_score", jaccard(word_set(F.col(query)), word_set(F.col(doc))))


REGISTRY: dict[str, Callable[..., object]] = {"overlap": overlap_score, "hashed-words": lambda: embed, "claims": ClaimWriter, "words": WordChecker}


def load(name: str, *args: object) -> object:
    """A scorer by name; an unknown name is a KeyError."""
    return REGISTRY[name](*args)
