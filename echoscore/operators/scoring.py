"""Word and character error rates per row and per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from echoscore.functions import metrics as M, text as T

COUNTS = ("word_edits", "ref_words", "char_edits", "ref_chars")


def with_edit_counts(
    df: DataFrame, strip_eot: bool, ref: str = "transcription", hyp: str = "prediction", word_sep: str = " "
) -> DataFrame:
    """Add COUNTS. A reference that is blank after normalising gets NULL counts."""
    hypothesis = T.remove_end_mark(F.col(hyp)) if strip_eot else F.col(hyp)
    texts = df.withColumn("_ref", T.normalize(F.col(ref))).withColumn("_hyp", T.normalize(hypothesis))
    counted = texts.withColumn("_counts", M.edit_counts(F.col("_ref"), F.col("_hyp"), word_sep))
    scoreable = F.col("_ref") != ""
    return counted.select(
        *df.columns, *[F.when(scoreable, F.col(f"_counts.{c}")).alias(c) for c in COUNTS]
    )


def row_rates(df: DataFrame, strip_eot: bool = True, **columns: str) -> DataFrame:
    """Add wer and cer per row; rows with a blank reference score 0."""
    counted = with_edit_counts(df, strip_eot, **columns)
    return counted.select(
        *df.columns,
        F.coalesce(M.rate(F.col("word_edits"), F.col("ref_words")), F.lit(0.0)).alias("wer"),
        F.coalesce(M.rate(F.col("char_edits"), F.col("ref_chars")), F.lit(0.0)).alias("cer"),
    )


def scored_rows(df: DataFrame, ref: str = "transcription", hyp: str = "prediction", word_sep: str = " ") -> DataFrame:
    """Add COUNTS with the end mark kept, as runs are scored, and wer and cer with it removed, as rows are shown. All in one pass;
    texts without the mark are compared once."""
    texts = df.withColumn("_ref", T.normalize(F.col(ref))).withColumn("_hyp", T.normalize(F.col(hyp)))
    texts = texts.withColumn("_bare", T.normalize(T.remove_end_mark(F.col(hyp))))
    same = F.col("_bare") == F.col("_hyp")
    counted = texts.withColumn("_kept", M.edit_counts(F.col("_ref"), F.col("_hyp"), word_sep))
    # equal texts cost next to nothing
    counted = counted.withColumn("_shown", M.edit_counts(F.col("_ref"), F.when(same, F.col("_ref")).otherwise(F.col("_bare")), word_sep))
    scoreable = F.col("_ref") != ""

    def shown(edits: str, length: str) -> Column:
        found = M.rate(F.when(same, F.col(f"_kept.{edits}")).otherwise(F.col(f"_shown.{edits}")), F.col(f"_kept.{length}"))
        return F.coalesce(F.when(scoreable, found), F.lit(0.0))

    return counted.select(
        *df.columns, *[F.when(scoreable, F.col(f"_kept.{c}")).alias(c) for c in COUNTS],
        shown("word_edits", "ref_words").alias("wer"), shown("char_edits", "ref_chars").alias("cer"),
    )


def corpus_rates(df: DataFrame, keys: Sequence[str], strip_eot: bool = False, **columns: str) -> DataFrame:
    """wer and cer per run: all edits over all reference lengths, blank references left out.

    Texts are scored where they are; only per-run integer sums are shuffled. Runs without any
    scoreable row do not appear.
    """
    # blank references have NULL counts, which sums and counts skip; a filter on the counts would
    # make Spark run the counting a second time below it
    return rates_of_counts(with_edit_counts(df, strip_eot, **columns), keys)


def rates_of_counts(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``corpus_rates`` of rows that have COUNTS already."""
    sums = counted.groupBy(*keys).agg(
        F.count("ref_chars").alias("n_scored"), *[F.sum(c).alias(c) for c in COUNTS]
    ).where(F.col("n_scored") > 0)
    return sums.select(
        *keys, "n_scored", *COUNTS,
        M.rate(F.col("word_edits"), F.col("ref_words")).alias("wer"),
        M.rate(F.col("char_edits"), F.col("ref_chars")).alias("cer"),
    )


def eval_counts(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per run: rows to evaluate, rows with a prediction, rows with a scoreable reference."""
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("prediction") != "").alias("n_predicted"),
        F.count_if(T.normalize(F.col("transcription")) != "").alias("n_scoreable"),
    )
