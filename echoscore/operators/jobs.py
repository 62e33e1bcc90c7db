"""Job logs and job states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from echoscore import constants as K
from echoscore.operators.ranking import last_row


def bare_state(c: Column) -> Column:
    """State name without an enum prefix, upper case."""
    return F.upper(F.substring_index(c, ".", -1))


def latest_status(statuses: DataFrame, *order: Column) -> DataFrame:
    """Last reported state per job with its active / terminal flags."""
    last = last_row(statuses, ["job_name"], *order)
    state = bare_state(F.col("state"))
    return last.withColumn("state", state).withColumn(
        "is_active", F.col("state").isin(*K.ACTIVE_STATES)
    ).withColumn("is_terminal", F.col("state").isin(*K.TERMINAL_STATES))


def status_counts(latest: DataFrame) -> DataFrame:
    return latest.groupBy("state", "is_active", "is_terminal").agg(F.count(F.lit(1)).alias("n_jobs"))


def newest_log_jobs(logs: DataFrame, by: Sequence[str] = ("log_time", "log_file")) -> DataFrame:
    """Job names in the newest log file."""
    newest = logs.agg(F.max(F.struct(*by)).alias("m"))
    latest = newest.select(f"m.{by[-1]}").scalar()
    return logs.where(F.col(by[-1]) == latest).where("job_name IS NOT NULL").select("job_name")


def distinct_jobs(*names: DataFrame) -> DataFrame:
    """Union of job names without duplicates; each side is reduced before the shuffle."""
    out = names[0].select("job_name")
    for other in names[1:]:
        out = out.unionByName(other.select("job_name"))
    return out.distinct()


def run_progress(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Per job: distinct requests (rows without a URI are never sent), distinct answers, and whether it is complete."""
    # distinct pairs first: a job that holds a third of all rows is then counted by many tasks
    def pairs(df: DataFrame, name: str) -> DataFrame:
        return df.select("job_id", "gcs_uri").distinct().groupBy("job_id").agg(F.count("gcs_uri").alias(name))

    sent, got = pairs(expected, "n_expected"), pairs(received, "n_received")
    joined = sent.join(got, "job_id", "left").withColumn("n_received", F.coalesce("n_received", F.lit(0)))
    return joined.withColumn("complete", F.col("n_received") >= F.col("n_expected"))
