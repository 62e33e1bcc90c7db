"""Choosing among scored runs. ``run_seq`` is the order in which runs were appended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from echoscore import constants as K
from echoscore.functions import text as T
from echoscore.operators.ranking import first_row, join_rows, last_row, low_first, text_key

RUN_KEY = ("lang", "group", "model", "config", "prompt_version")


def parse_metrics(runs: DataFrame) -> DataFrame:
    """Metrics read as text: whatever is no number becomes NULL and ranks last."""
    return runs.withColumn("wer", T.number_or_null(F.col("wer"))).withColumn("cer", T.number_or_null(F.col("cer")))


def parse_report_metrics(runs: DataFrame) -> DataFrame:
    """As the report reads them: whatever is no number counts as 0."""
    return runs.withColumn("wer", T.number_or_zero(F.col("wer"))).withColumn("cer", T.number_or_zero(F.col("cer")))


def latest_run(runs: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """The last appended run per key. NULL is a key value like any other."""
    return last_row(runs, keys, F.col("run_seq"))


def training_runs(runs: DataFrame) -> DataFrame:
    """Latest training run per setting, with the prompt's label."""
    return latest_run(runs.where(F.col("group") == "train")).withColumn(
        "version_label", T.version_label(F.col("prompt_version"))
    )


def best_run_per_lang(runs: DataFrame) -> DataFrame:
    """Lowest cer, then wer, then oldest, per language: among test runs if there are any at all."""
    has_test = runs.agg(F.coalesce(F.max(F.col("group") == "test"), F.lit(False))).scalar()
    considered = runs.where((F.col("group") == "test") | ~has_test)
    return first_row(considered, ["lang"], low_first("cer"), low_first("wer"), F.col("run_seq"))


def _report_order(*names: str) -> list[Column]:
    return [text_key(n) for n in names] + [F.col("run_seq")]


def best_run_per_group_lang(runs: DataFrame) -> DataFrame:
    """Lowest cer per (group, lang); ties go to the first in report order."""
    return first_row(
        runs, ["group", "lang"], low_first("cer"), *_report_order("model", "config", "prompt_version")
    )


def best_report_lang(runs: DataFrame) -> DataFrame:
    """Lowest cer per language over test and silence runs; ties go to the first in report order."""
    considered = runs.where(F.col("group").isin("test", K.SILENCE_GROUP) & (text_key("lang") != ""))
    return first_row(
        considered, ["lang"], low_first("cer"), *_report_order("group", "model", "config", "prompt_version")
    )


def in_view(runs: DataFrame, lang: str = "all", group: str = "all") -> DataFrame:
    """The report's language / group filter; 'all' lets everything through."""
    for column, wanted in (("lang", lang), ("group", group)):
        if wanted != "all":
            runs = runs.where(F.col(column) == wanted)
    return runs


def best_view_setting(runs: DataFrame, views: Sequence[str] = ()) -> DataFrame:
    """Lowest cer of a view; ties go to the **last** in report order.

    ``views`` are columns that each define one view; none means the whole table is the view.
    """
    order = _report_order(*RUN_KEY)
    return last_row(runs, views, -low_first("cer"), *order) if views else (
        runs.agg(F.max_by(F.struct(*runs.columns), F.struct(-low_first("cer"), *order)).alias("_row")).select("_row.*")
    )


def next_version(best: DataFrame, override: int | None = None) -> DataFrame:
    """One row: the highest prompt version among the best runs plus one, unless overridden."""
    following = F.coalesce(F.max(T.version_number(F.col("prompt_version"))), F.lit(0)) + 1
    return best.agg((following if override is None else F.lit(override)).cast("int").alias("next_version"))


def train_run_of_best(best: DataFrame, runs: DataFrame) -> DataFrame:
    """Best run -> latest training run of the same language, model, config and prompt version.

    Languages without such a run drop out. NULL settings compare as equal.
    """
    settings = ("lang", "model", "config", "prompt_version")
    latest = latest_run(runs.where(F.col("group") == "train"), settings)
    train = latest.select(*settings, F.col("run_seq").alias("train_run_seq"), "local_inference_csv_path")
    chosen = best.select(*settings, F.col("run_seq").alias("best_run_seq"), F.col("cer").alias("best_cer"), F.col("wer").alias("best_wer"))
    return join_rows(chosen, train, settings).select(
        *settings, "best_run_seq", "best_cer", "best_wer", "train_run_seq", "local_inference_csv_path")


def pending_jobs(jobs: DataFrame, summary: DataFrame) -> DataFrame:
    """Jobs with an output location whose normalised result path is not in the summary yet.

    A path that is logged more than once counts for its first job, by time of the log, log file and
    place in it (``readers.job_logs`` gives all three); equal or missing places go by the row itself.
    """
    # normalising never empties a path, so the plain columns decide and can be pushed to the scan
    located = jobs.where((F.col("gcs_output_base_uri") != "") & (F.col("local_output_csv") != ""))
    todo = located.withColumn(
        "local_inference_csv_path", T.result_path(F.col("local_output_csv"), F.col("prompt_version"))
    )
    done = summary.select("local_inference_csv_path").where("local_inference_csv_path IS NOT NULL")
    todo = todo.join(done, "local_inference_csv_path", "left_anti")
    places = [F.col(c) for c in ("log_time", "log_file", "log_seq", "log_row") if c in todo.columns]
    rest = [c for c, kind in todo.dtypes if not kind.startswith(("map", "variant"))]
    return first_row(todo, ["local_inference_csv_path"], *places, F.struct(*rest))
