"""Critique and prompt rewriting for all languages in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from echoscore import constants as K
from echoscore.functions import text as T
from echoscore.operators import errors as E, runs as R
from echoscore.sources.stage import staged

RUN = ("run_seq",)


def _path(base: str) -> Column:
    return T.absolute_path(F.col("local_inference_csv_path"), base)


def critic_request_table(
    runs: DataFrame, rows: DataFrame, top_n: int = K.CRITIC_TOP_N, base: str = "/"
) -> DataFrame:
    """One critic prompt per latest training run.

    ``rows`` are result files as (path, id, transcription, prediction [, noisy_output_path]), best with their rates as
    ``evaluate.stored_scores`` gives them; runs whose file is missing drop out. Relative paths of runs start at ``base``.
    """
    train = R.training_runs(runs).withColumn("path", _path(base))
    texts = _cases(train, rows, top_n)
    return E.critic_requests(train.join(texts, list(RUN)), top_n)


def _cases(runs: DataFrame, rows: DataFrame, top_n: int) -> DataFrame:
    audio = "noisy_output_path" if "noisy_output_path" in rows.columns else None
    if {"wer", "cer"} <= set(rows.columns):
        worst = E.worst_stored(rows, runs, RUN, top_n)
    else:
        worst = E.worst_cases(rows.join(runs.select(*RUN, "path"), "path"), RUN, top_n)
    return E.case_text(worst, RUN, audio)


def rewrite_request_table(
    runs: DataFrame, rows: DataFrame, exact: DataFrame, general: DataFrame, main_prompts: DataFrame,
    modified_prompts: DataFrame, template: str, top_n: int = K.OPTIMISER_TOP_N, base: str = "/",
) -> DataFrame:
    """One prompt-rewrite request per language whose best test run has a training run."""
    best = R.best_run_per_lang(runs)
    train = R.train_run_of_best(best, runs).withColumnRenamed("train_run_seq", "run_seq")
    train = staged(train.withColumn("path", _path(base)).withColumn("group", F.lit("train")), "train-of-best")
    train = train.withColumn("version_label", T.version_label(F.col("prompt_version")))
    cases = _cases(train, rows, top_n)
    critiques = E.critiques_for_runs(train, exact, general).where("critic_source <> 'none'")
    critique_texts = E.critique_text(critiques, RUN)
    ready = (
        E.prompt_for_runs(train, main_prompts, modified_prompts)
        .join(cases, list(RUN))
        .join(critique_texts, list(RUN), "left")
    )
    return E.rewrite_requests(ready, template)
