"""Response lines back into predictions and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from echoscore.functions import responses as R
from echoscore.operators.ranking import last_row


def malformed(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Non-blank lines that are not JSON; kept apart so that one bad line stops nothing."""
    return lines.where((F.trim(raw) != "") & R.is_malformed(F.col(raw)))


def parse_responses(lines: DataFrame, keep: Sequence[str] = (), raw: str = "raw") -> DataFrame:
    """(keep..., key, gcs_uri, prediction) of every line that names an audio file."""
    parsed = lines.where(F.trim(raw) != "").withColumn("_line", R.response_line(F.col(raw)))
    return parsed.select(
        *keep,
        F.col("_line.key").alias("key"),
        R.file_uri(F.col("_line")).alias("gcs_uri"),
        R.answer_text(F.col("_line")).alias("prediction"),
    ).where(F.col("gcs_uri").isNotNull())


def latest_predictions(parsed: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One prediction per key, the last by ``order``."""
    return last_row(parsed, keys, *order).select(*keys, "prediction")


def join_predictions(samples: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("gcs_uri",)) -> DataFrame:
    """Samples with their prediction, '' where none came back. ``predictions`` is unique by key."""
    joined = samples.join(predictions, list(keys), "left")
    return joined.withColumn("prediction", F.coalesce("prediction", F.lit("")))


def parse_chunk_labels(lines: DataFrame, *order: Column, raw: str = "raw") -> DataFrame:
    """(chunk_idx, labels): boolean array per chunk from the last line that carries an answer.

    ``order`` tells which of several lines for one chunk is the last. Answers that do not parse
    give an empty array.
    """
    parsed = lines.where(F.trim(raw) != "").withColumn("_line", R.response_line(F.col(raw)))
    answers = parsed.select(
        *[c.alias(f"_order{i}") for i, c in enumerate(order)],
        R.chunk_number(F.col("_line.key")).alias("chunk_idx"),
        R.answer_text(F.col("_line")).alias("answer"),
        R.has_answer(F.col("_line")).alias("_answered"),
    ).where(F.col("chunk_idx").isNotNull() & F.col("_answered"))
    last = last_row(answers, ["chunk_idx"], *[F.col(f"_order{i}") for i in range(len(order))])
    return last.select("chunk_idx", R.boolean_list(F.col("answer")).alias("labels"))


def apply_chunk_labels(chunked: DataFrame, labels: DataFrame) -> DataFrame:
    """Samples + ``medical_yn``: entry ``pos`` of the chunk's array, false when there is none."""
    joined = chunked.join(labels, "chunk_idx", "left")
    flag = F.get(F.col("labels"), F.col("pos"))
    return joined.withColumn("medical_yn", F.coalesce(flag, F.lit(False))).drop("labels")


def chunk_shortfalls(chunked: DataFrame, labels: DataFrame) -> DataFrame:
    """Chunks whose answer has another length than the chunk."""
    sizes = chunked.groupBy("chunk_idx").agg(F.count(F.lit(1)).alias("n"))
    got = F.coalesce(F.size("labels"), F.lit(0)).cast("long")
    return (
        sizes.join(labels, "chunk_idx", "left")
        .select("chunk_idx", "n", got.alias("n_labels"))
        .where(F.col("n") != F.col("n_labels"))
    )
