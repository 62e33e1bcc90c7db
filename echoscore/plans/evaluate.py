"""Scoring: jobs + samples + response lines -> scored rows and run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from echoscore.operators.requests import fan_out
from echoscore.operators.responses import join_predictions, latest_predictions, parse_responses
from echoscore.operators.runs import pending_jobs
from echoscore.operators.scoring import corpus_rates, scored_rows
from echoscore.sources.readers import LOG_PLACES
from echoscore.sources.stage import bucketed

SAMPLE_COLUMNS = ("id", "transcription", "gcs_uri")
RUN_COLUMNS = ("job_id", "lang", "group", "model", "config", "prompt_version", "local_inference_csv_path")


def predictions(lines: DataFrame) -> DataFrame:
    """Last prediction per (job, uri) from lines (job_id, file, seq, raw)."""
    parsed = parse_responses(lines, keep=("job_id", "file", "seq"))
    return latest_predictions(parsed, ["job_id", "gcs_uri"], F.col("file"), F.col("seq"), F.col("prediction"))


def scored_texts(jobs: DataFrame, noisy: DataFrame | None, silence: DataFrame | None, lines: DataFrame) -> DataFrame:
    """Every (job, sample) with its prediction. Jobs without any response file drop out."""
    answered = jobs.join(lines.select("job_id").distinct(), "job_id", "left_semi")
    fanned = fan_out(answered, noisy, silence, SAMPLE_COLUMNS)
    return join_predictions(fanned, predictions(lines), ["job_id", "gcs_uri"])


def stored_scores(rows: DataFrame, path: str = "path", id_col: str = "id", buckets: int | None = None) -> DataFrame:
    """``rows`` (one per result file and sample, with transcription and prediction) scored once and stored by (path, id).

    Summary (``scoring.rates_of_counts``), worst cases, report rows and prompt rewriting read this table; joins by path and id do not move it,
    and as a file with a third of all rows spreads over all buckets, none is hot.
    """
    return bucketed(scored_rows(rows), [path, id_col], "scores", buckets)


def run_summary(
    jobs: DataFrame, done: DataFrame, noisy: DataFrame | None, silence: DataFrame | None, lines: DataFrame
) -> DataFrame:
    """One summary row per job that is not in ``done`` yet, all jobs in one pass, with the job's place in the logs."""
    todo = pending_jobs(jobs, done).withColumnRenamed("config_name", "config")
    rows = scored_texts(todo, noisy, silence, lines)
    places = [c for c in LOG_PLACES if c in todo.columns]
    return corpus_rates(rows, [*RUN_COLUMNS, *places])
