"""Worst cases, critiques and the texts made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from echoscore import constants as K
from echoscore.functions import responses as R, text as T
from echoscore.operators.ranking import join_rows, top_n
from echoscore.operators.scoring import row_rates
from echoscore.sources.schemas import CRITIQUE_FIELDS
from echoscore.sources.stage import staged

SETTING = ("lang", "group", "model", "config", "version_label")


def worst_cases(scored_texts: DataFrame, keys: Sequence[str], n: int = K.CRITIC_TOP_N, id_col: str = "id") -> DataFrame:
    """The n worst rows per run by cer, then wer, then id, numbered from 1, with their rates.

    Rows without wer and cer are scored in place and once; only (run, id, rates) is ranked. The n winners per run are
    staged and fetch their texts.
    """
    unique = [*keys, id_col]
    known = {"wer", "cer"} <= set(scored_texts.columns)
    rates = (scored_texts if known else row_rates(scored_texts)).select(*unique, "wer", "cer")
    scored_texts = scored_texts.drop("wer", "cer")
    order = [F.col("cer").desc_nulls_last(), F.col("wer").desc_nulls_last(), F.col(id_col)]
    winners = top_n(rates, keys, order, n, unique, rank="case_no")
    return join_rows(scored_texts, staged(winners, "worst-cases"), unique)


def worst_stored(scores: DataFrame, runs: DataFrame, keys: Sequence[str], n: int = K.CRITIC_TOP_N) -> DataFrame:
    """``worst_cases`` of ``runs`` (keys, path) over rows stored by (path, id) with their rates (``evaluate.stored_scores``).

    Rates are read where they are; the winners go to the table's buckets, the table stays.
    """
    rates = scores.select("path", "id", "wer", "cer").join(runs.select(*keys, "path"), "path")
    order = [F.col("cer").desc_nulls_last(), F.col("wer").desc_nulls_last(), F.col("id")]
    winners = staged(top_n(rates, keys, order, n, [*keys, "id"], rank="case_no"), "worst-cases")
    return scores.drop("wer", "cer").join(winners, ["path", "id"])


def _block(heading: str, number: Column, lines: Sequence[tuple[str, Column]]) -> Column:
    parts: list[Column] = [F.lit(f"## {heading} "), number.cast("string"), F.lit("\n")]
    for label, value in lines:
        parts += [F.lit(label), value, F.lit("\n")]
    return F.concat(*parts, F.lit("\n"))


def _numbered_text(df: DataFrame, keys: Sequence[str], number: str, block: Column, name: str) -> DataFrame:
    blocks = F.array_sort(F.collect_list(F.struct(F.col(number), block.alias("block"))))
    return df.groupBy(*keys).agg(F.array_join(blocks["block"], "").alias(name))


def case_text(cases: DataFrame, keys: Sequence[str], audio: str | None = None) -> DataFrame:
    """One text block per run listing its worst cases in order."""
    rates = F.format_string("%.2f, CER: %.2f", "wer", "cer")
    lines = [
        ("Ground Truth: ", F.coalesce("transcription", F.lit(""))),
        ("Prediction:   ", T.remove_end_mark(F.col("prediction"))),
        ("WER: ", rates),
    ]
    if audio:
        lines.append(("Audio File:   ", F.coalesce(T.basename(F.col(audio)), F.lit(""))))
    block = _block("Case", F.col("case_no"), lines)
    return _numbered_text(cases, keys, "case_no", block, "error_cases_text")


def critique_text(critiques: DataFrame, keys: Sequence[str], number: str = "critique_no") -> DataFrame:
    """One text block per run listing its critiques in order."""
    labels = ("Error Pattern: ", "Affected Cases: ", "Reason for Failure: ", "Generalizable Improvement: ")
    lines = [(label, F.coalesce(field, F.lit(""))) for label, field in zip(labels, CRITIQUE_FIELDS)]
    return _numbered_text(critiques, keys, number, _block("Critique", F.col(number), lines), "critiques_text")


def critic_requests(case_texts: DataFrame, top_n_cases: int = K.CRITIC_TOP_N) -> DataFrame:
    """Add the critic ``prompt`` to (lang, error_cases_text) rows."""
    # The two short values go in first, the long text last: it may hold the markers itself.
    head, tail = K.CRITIC_PROMPT.split("{error_cases_text}")
    intro = T.fill_template(F.lit(head.replace("{top_n}", str(top_n_cases))), {"{lang}": F.col("lang")})
    return case_texts.withColumn("prompt", F.concat(intro, F.col("error_cases_text"), F.lit(tail)))


def critic_rows(answers: DataFrame, keys: Sequence[str], answer: str = "answer") -> DataFrame:
    """One row per critique of each answer, numbered from 1; broken or empty answers give none."""
    rows = answers.select(*keys, F.posexplode(R.critique_list(F.col(answer))).alias("_pos", "_critique"))
    return rows.select(*keys, (F.col("_pos") + 1).alias("critique_no"), "_critique.*")


def critiques_for_runs(runs: DataFrame, exact: DataFrame, general: DataFrame) -> DataFrame:
    """Critiques of each run: its own ones, else those of its language, else one empty row.

    ``exact`` is keyed by SETTING, ``general`` by language; NULL keys equal NULL keys. Runs with own critiques are joined
    once; only the rest sees the per-language rows, so the two sources never have to be ranked.
    """
    fields = ["critique_no", *CRITIQUE_FIELDS]
    own = join_rows(runs, exact.select(*SETTING, *fields), SETTING).withColumn("critic_source", F.lit("run"))
    rest = join_rows(runs, exact.select(*SETTING).distinct(), SETTING, "left_anti")
    by_lang = join_rows(rest, general.select("lang", *fields), ["lang"], "left").withColumn(
        "critic_source", F.when(F.col("critique_no").isNull(), "none").otherwise("language")
    )
    return own.unionByName(by_lang)


def prompt_for_runs(runs: DataFrame, main: DataFrame, modified: DataFrame) -> DataFrame:
    """Text of the prompt each run used.

    Looked up by file name in the main folder, then in the modified folder, then the shared prompt;
    an empty text found on the way is not skipped but replaced by the fixed note.
    """
    first = main.select("prompt_version", F.col("text").alias("_main"))
    second = modified.select("prompt_version", F.col("text").alias("_modified"))
    shared = main.where(F.col("prompt_version") == K.SHARED_PROMPT).agg(F.max("text")).scalar()
    found = runs.join(first, "prompt_version", "left").join(second, "prompt_version", "left")
    text = F.coalesce("_main", "_modified", shared, F.lit(""))
    used = F.when(text == "", K.MISSING_PROMPT).otherwise(text)
    return found.withColumn("used_prompt", used).drop("_main", "_modified")


def rewrite_requests(rows: DataFrame, template: str | Column) -> DataFrame:
    """Add ``analysis_prompt``: the meta prompt with model, config, prompt, cases and critiques."""
    template = F.lit(template) if isinstance(template, str) else template
    columns = ("model", "config", "used_prompt", "error_cases_text", "critiques_text")
    values = {p: F.col(c).cast("string") for p, c in zip(K.META_PLACEHOLDERS, columns)}
    filled = T.fill_template(template, values)
    return rows.withColumn("analysis_prompt", F.concat(filled, F.lit(K.PROMPT_BLOCK_REQUEST)))


def new_prompts(answers: DataFrame, version: Column, answer: str = "answer") -> DataFrame:
    """(prompt_version, lang, text, report): the prompt proposed in each answer, under its file name."""
    name = F.concat(F.lit("prompt_v"), version.cast("string"), F.lit("_"), F.col("lang"), F.lit(".txt"))
    return answers.select(
        name.alias("prompt_version"), "lang", T.extract_prompt(F.col(answer)).alias("text"),
        F.col(answer).alias("report"),
    )
