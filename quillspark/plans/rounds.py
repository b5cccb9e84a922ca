"""Model calls for whole tables in rounds: what fails its check goes into the next round with the reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.scorers import TextModel
from quillspark.runtime import Scratch


def generate_checked(prompts: DataFrame, model: TextModel, problem: Callable[[Column], Column], tries: int = 3) -> DataFrame:
    """(id, response, round, problem): for every (id, prompt) the first response without a problem, or the last one with it.

    ``problem`` makes of the response column a reason or null. Each round calls the model once a pending row, in batches, and
    is written before its check, so that a model that answers differently each time is never asked twice for a round.
    """
    scratch = Scratch(prompts.sparkSession)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.generate(b.column(1).to_pylist()), pa.string())], ["id", "prompt", "response"])

    pending, done = prompts.select(F.col("id").cast("string"), "prompt"), None
    for r in range(1, tries + 1):
        said = scratch.write(pending.mapInArrow(call, "id string, prompt string, response string"), f"round{r}").withColumn("problem", problem(F.col("response")))
        over = said.where(F.col("problem").isNull()) if r < tries else said
        over = over.select("id", "response", F.lit(r).alias("round"), "problem")
        done = over if done is None else done.unionByName(over)
        pending = said.where(F.col("problem").isNotNull()).select("id", F.concat("prompt", F.lit("\n\nThe last answer can't be used: "), "problem").alias("prompt"))
    return done
