"""Tables behind the evaluation report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from echoscore import constants as K
from echoscore.functions import text as T
from echoscore.operators.ranking import join_rows, text_key, top_n
from echoscore.operators.samples import audio_path
from echoscore.operators.runs import RUN_KEY, best_run_per_group_lang, in_view
from echoscore.operators.scoring import row_rates
from echoscore.sources.stage import staged


# Where a result row names its clip, by preference.
AUDIO_COLUMNS = ("noisy_output_path", "silence_output_path", "file_path")


def summary_sorted(runs: DataFrame) -> DataFrame:
    """Runs in report order, missing values first like empty text."""
    return runs.orderBy(*[text_key(c) for c in RUN_KEY], "run_seq")


def sorted_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sort by one column: numerically where a value is a number, by lower-case text elsewhere."""
    text = F.replace(F.col(column).cast("string"), F.lit("%"), F.lit(""))
    keys = [text.try_cast("double"), F.lower(text)]
    return df.orderBy(*[k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys])


def dimensions(runs: DataFrame) -> DataFrame:
    """Distinct languages and groups as (dim, value), found in one scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in ("lang", "group")]))
    return runs.select(pairs.alias("p")).select("p.*").distinct()


def _mean_percent(c: str) -> Column:
    """Mean in percent with two decimals; NaN if any value is NaN.

    Summed as decimals: a sum of doubles depends on the order of the partitions, and a last-digit
    difference is enough to round the other way.
    """
    exact = F.col(c).try_cast("decimal(28,15)")
    mean = F.round(F.sum(exact) / F.count(c) * 100, 2).cast("double")
    # infinite and very large values have no decimal form
    mean = F.when(F.count(exact) < F.count(c), F.round(F.avg(c) * 100, 2)).otherwise(mean)
    return F.when(F.max(F.isnan(c)), float("nan")).otherwise(mean)


def _bar_label() -> Column:
    version = F.coalesce(T.first_filled(F.col("prompt_version")), F.lit(K.DEFAULT_LABEL))
    return F.concat(F.coalesce("model", F.lit("")), F.lit(" ("), F.coalesce("config", F.lit("")), F.lit(") ["), version, F.lit("]"))


def chart(runs: DataFrame, lang: str = "all", group: str = "all") -> DataFrame:
    """Mean wer and cer in percent per setting of a view, the bar label and the best-bar flags.

    Bars never mix languages or groups: a filtered view has one value, an unfiltered one puts it
    into the label.
    """
    bars = (
        in_view(runs, lang, group)
        .groupBy(*RUN_KEY)
        .agg(_mean_percent("wer").alias("avg_wer"), _mean_percent("cer").alias("avg_cer"))
    )
    label = _bar_label()
    for column, wanted in (("lang", lang), ("group", group)):
        if wanted == "all":
            label = F.concat(label, F.lit(" ["), F.coalesce(column, F.lit("")), F.lit("]"))
    lowest = bars.agg(
        F.struct(*[F.min(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("avg_wer", "avg_cer")])
    ).scalar()
    return bars.select(
        *RUN_KEY, label.alias("label"), "avg_wer", "avg_cer",
        (F.col("avg_wer") == lowest["avg_wer"]).alias("best_wer"),
        (F.col("avg_cer") == lowest["avg_cer"]).alias("best_cer"),
    )


def chart_views(runs: DataFrame) -> DataFrame:
    """The chart of every choice of the page's language and group filters: ``view_lang`` and ``view_group`` ('all' or one value), then the
    columns of ``chart``.

    Bars are made once. Their lowest rates come from one pass with grouping sets, whose id tells a view over all languages from the view
    of the missing one.
    """
    bars = staged(
        runs.groupBy(*RUN_KEY).agg(_mean_percent("wer").alias("avg_wer"), _mean_percent("cer").alias("avg_cer")), "bars"
    )
    least = [F.min(F.when(~F.isnan(c), F.col(c))).alias(f"_{c}") for c in ("avg_wer", "avg_cer")]
    dims = ["lang", "group"]
    lowest = bars.groupingSets([dims, ["lang"], ["group"], []], *dims).agg(F.grouping_id().cast("int").alias("_set"), *least)
    lowest = lowest.select("_set", F.col("lang").alias("_lang"), F.col("group").alias("_group"), "_avg_wer", "_avg_cer")
    shown = bars.withColumn("_set", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    # bit 2: over all languages, bit 1: over all groups
    over = {"lang": F.col("_set") >= 2, "group": F.col("_set") % 2 == 1}
    shown = shown.withColumns({f"_{c}": F.when(~over[c], F.col(c)) for c in dims})
    joined = join_rows(shown, lowest, ["_set", "_lang", "_group"])
    label = _bar_label()
    for c in dims:
        label = F.concat(label, F.when(over[c], F.concat(F.lit(" ["), F.coalesce(c, F.lit("")), F.lit("]"))).otherwise(""))
    views = [F.when(over[c], F.lit("all")).otherwise(F.coalesce(c, F.lit(""))).alias(f"view_{c}") for c in dims]
    return joined.select(
        *views, *RUN_KEY, label.alias("label"), "avg_wer", "avg_cer",
        (F.col("avg_wer") == F.col("_avg_wer")).alias("best_wer"), (F.col("avg_cer") == F.col("_avg_cer")).alias("best_cer"),
    )


def best_flags(runs: DataFrame, views: Sequence[str]) -> DataFrame:
    """Mark every run that has its view's lowest wer / cer; all ties are marked.

    The minima are one row per view and join back, so no view is sorted or gathered.
    """
    lowest = runs.groupBy(*views).agg(F.min("wer").alias("_wer"), F.min("cer").alias("_cer"))
    return (
        join_rows(runs, lowest, views)
        .withColumn("best_wer", F.col("wer") == F.col("_wer"))
        .withColumn("best_cer", F.col("cer") == F.col("_cer"))
        .drop("_wer", "_cer")
    )


def locate_results(
    runs: DataFrame, files: DataFrame, alt_files: DataFrame, base: str | None = None
) -> DataFrame:
    """Add ``result_path``: the run's own path if listed, else the same file name in ``alt_files``.

    Listings have a ``path`` column; NULL means neither has the file. Relative paths of runs start
    at ``base`` when it is given.
    """
    if base is not None:
        path = T.absolute_path(F.col("local_inference_csv_path"), base)
        runs = runs.withColumn("local_inference_csv_path", path)
    own = files.select(F.col("path").alias("local_inference_csv_path"), F.col("path").alias("_own"))
    alt = alt_files.select(T.basename(F.col("path")).alias("_name"), F.col("path").alias("_alt"))
    return (
        runs.withColumn("_name", T.basename(F.col("local_inference_csv_path")))
        .join(own, "local_inference_csv_path", "left")
        .join(alt, "_name", "left")
        .withColumn("result_path", F.coalesce("_own", "_alt"))
        .drop("_name", "_own", "_alt")
    )


def detail(best: DataFrame, rows: DataFrame, n: int = K.REPORT_DETAIL_ROWS) -> DataFrame:
    """First n rows of each best run's result file, then without blank references, with row rates (the rows' own if they have them).

    ``best`` has (lang, group, result_path), ``rows`` the scored files as (result_path, id,
    transcription, prediction and any of AUDIO_COLUMNS). Only the n rows per file are scored.
    """
    wanted = best.select(F.col("lang").alias("_l"), F.col("group").alias("_g"), "result_path")
    wanted = staged(wanted.where("result_path IS NOT NULL"), "best-runs")
    narrow = rows.select("result_path", "id").join(wanted.select("result_path").distinct(), "result_path", "left_semi")
    first = top_n(narrow, ["result_path"], [F.col("id")], n, ["result_path", "id"], rank="row_no")
    picked = join_rows(rows, staged(first, "first-rows"), ["result_path", "id"]).join(wanted, "result_path")
    shown = picked.where(T.normalize(F.col("transcription")) != "")
    scored = shown if {"wer", "cer"} <= set(rows.columns) else row_rates(shown)
    audio = audio_path(scored, *AUDIO_COLUMNS)
    return scored.select(
        F.col("_g").alias("group"), F.col("_l").alias("lang"), "row_no", "id", "transcription",
        T.remove_end_mark(F.col("prediction")).alias("prediction"), "wer", "cer", audio.alias("audio_path"),
    )


def dataset_sections(runs: DataFrame, files: DataFrame, alt_files: DataFrame) -> DataFrame:
    """Best run per (group, lang) with the place of its result file."""
    return locate_results(best_run_per_group_lang(runs), files, alt_files)


def prompt_listing(prompts: DataFrame, name: Column | str = "prompt_version") -> DataFrame:
    """Prompt texts escaped for the page, in file-name order."""
    name = F.col(name) if isinstance(name, str) else name
    return prompts.select(name.alias("name"), T.html_escape(F.col("text")).alias("html")).orderBy("name")
