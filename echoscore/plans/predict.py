"""The one place where user code (a model call) runs: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from echoscore.sources.readers import path_exists
from echoscore.sources.stage import staged

MEMORY = "digest string, answer string, asked_in string"


def with_answers(
    requests: DataFrame, predict: Callable[[pd.Series], pd.Series], prompt: str = "prompt", answer: str = "answer"
) -> DataFrame:
    """Add ``answer`` = predict(prompt) per batch.

    ``predict`` gets a batch of prompts and returns as many texts. Its cost is the user's: a task
    that is retried calls it again, so write the result to a table before using it twice.
    """
    schema = requests.drop(answer).schema.add(answer, "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{answer: predict(batch[prompt])})

    return requests.mapInPandas(run, schema)


def with_remembered_answers(
    requests: DataFrame, predict: Callable[[pd.Series], pd.Series], memory: str, asked_in: str = "",
    prompt: str = "prompt", answer: str = "answer",
) -> DataFrame:
    """``with_answers`` that asks the model for each different prompt once, over all calls with the same ``memory`` folder.

    Answers are kept by the prompt's digest, with ``asked_in``, the caller's name for this run; both are added to ``requests``. New digests
    are found on narrow rows, and only their prompts move to the tasks that call. A run that fails leaves no answers; what was asked by two runs at
    once is kept twice and the smallest answer counts. A NULL prompt is not asked.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("_digest", F.sha2(F.col(prompt), 256))
    asked = keyed.select("_digest").where("_digest IS NOT NULL").distinct()
    if path_exists(spark, memory):
        asked = asked.join(spark.read.schema(MEMORY).parquet(memory).select(F.col("digest").alias("_digest")), "_digest", "left_anti")
    asked = staged(asked, "new-prompts")
    new = keyed.select("_digest", prompt).join(asked, "_digest", "left_semi").dropDuplicates(["_digest"])
    told = with_answers(new, predict, prompt, "_answer").select(
        F.col("_digest").alias("digest"), F.col("_answer").alias("answer"), F.lit(asked_in).alias("asked_in"))
    told.write.mode("append").parquet(memory)
    kept = spark.read.schema(MEMORY).parquet(memory).groupBy("digest").agg(F.min(F.struct("answer", "asked_in")).alias("_kept"))
    joined = keyed.drop(answer, "asked_in").join(kept.withColumnRenamed("digest", "_digest"), "_digest", "left")
    return joined.withColumns({answer: F.col("_kept.answer"), "asked_in": F.col("_kept.asked_in")}).drop("_digest", "_kept")
