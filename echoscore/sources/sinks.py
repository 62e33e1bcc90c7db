"""Sinks. Parquet between stages; CSV, JSON and JSONL only where files leave the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from echoscore.operators.indexing import range_index
from echoscore.sources.readers import LOG_PLACES, path_exists


def requests(df: DataFrame, folder: str, job_col: str = "job_id", line_col: str = "line") -> None:
    """Request lines as JSONL below one folder per job.

    Lines are dealt by job and rebalanced: AQE splits a job above the advisory partition size over as
    many tasks and files as it needs, and small jobs share a task.
    """
    lines = df.select(job_col, F.col(line_col).alias("value"))
    lines.hint("rebalance", job_col).write.partitionBy(job_col).text(folder)


def csv(df: DataFrame, folder: str) -> None:
    """CSV with a header, quotes doubled, no row numbers."""
    df.write.option("header", True).option("escape", '"').csv(folder)


def json(df: DataFrame, folder: str) -> None:
    """One JSON object per line; NULL fields are written, so every row has every key."""
    df.write.option("ignoreNullFields", False).json(folder)


def job_log(df: DataFrame, folder: str, order: Sequence[str]) -> None:
    """Job records as JSON lines with their place in the log (``log_seq``), by ``order``, whichever part file they are in."""
    json(range_index(df, order, "log_seq"), folder)


def append_runs(summary: DataFrame, path: str, round_key: str | None = None) -> str | None:
    """Append summary rows to the Parquet run table, with ``LOG_FILE`` and ``run_seq``; returns the round's key.

    ``run_seq`` goes on from the table's highest, in log order. A call is a round, by default named after the result paths it
    holds. Its rows are one partition of the table, which is overwritten as a whole, and once it is there its name is put on the table's list of rounds
    (``readers.run_table`` reads those on the list). So a call that failed, or is repeated, leaves one copy with the numbers of the first.
    """
    spark = summary.sparkSession
    places = [c for c in LOG_PLACES if c in summary.columns]
    rows = range_index(summary, [*places, "local_inference_csv_path"], "_no")
    found = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("local_inference_csv_path"))).first()
    if not found[0]:
        return None
    key = round_key or f"round-{found[0]}-{found[1] & (1 << 64) - 1:016x}"
    first = 1
    if path_exists(spark, path):
        there = spark.read.option("recursiveFileLookup", False).parquet(path)
        own = there.where(F.col("append_round") == key).agg(F.count(F.lit(1)), F.min("run_seq")).first()
        others = there.where(F.col("append_round") != key).agg(F.max("run_seq")).first()[0]
        first = own[1] if own[0] >= found[0] else (others or 0) + 1
    kept = [F.col(c) for c in rows.columns if c not in (*LOG_PLACES, "_no")]
    if "log_file" in summary.columns:
        kept.append(F.element_at(F.split("log_file", "/"), -1).alias("LOG_FILE"))
    numbered = rows.select(*kept, (F.col("_no") + first).cast("long").alias("run_seq"), F.lit(key).alias("append_round"))
    _put_round(numbered, path)
    _put_round(numbered.groupBy("append_round").agg(F.min("run_seq").alias("first"), F.count(F.lit(1)).alias("n")), f"{path}-rounds")
    return key


def _put_round(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("append_round").parquet(path)
