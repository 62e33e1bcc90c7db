"""From raw corpus rows to labelled, noisy and silence-padded sample plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from echoscore import constants as K
from echoscore.functions import text as T
from echoscore.operators.indexing import global_index, hash_bucket, sample_index
from echoscore.functions.audio import usable
from echoscore.operators.ranking import first_row, join_rows, top_n
from echoscore.sources.stage import staged


def corpus_samples(raw: DataFrame, base_path: str) -> DataFrame:
    """One row per (lang, group, id) of the raw corpus, the first in file order."""
    unique = first_row(raw, ["lang", "group", "id"], F.col("seq"))
    audio = F.concat_ws("/", F.lit(base_path.rstrip("/")), "lang", F.lit("audio"), "group", "file_name")
    return unique.select("id", "transcription", audio.alias("file_path"), "lang", "group")


def labelled_only(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("medical_yn"))


def audio_path(df: DataFrame, *candidates: str) -> Column:
    """First non-empty of the candidate columns that the table has; NULL when none."""
    present = [F.col(c) for c in candidates if c in df.columns]
    return T.first_filled(*present) if present else F.lit(None).cast("string")


def first_present(df: DataFrame, *candidates: str) -> Column:
    """The first of the candidate columns that the table has, whatever its values; NULL when none."""
    return next((F.col(c) for c in candidates if c in df.columns), F.lit(None).cast("string"))


def _first_labelled(samples: DataFrame, n: int, valid: Column | None) -> DataFrame:
    """The first n usable labelled samples per language, with rank (0-based) and index.

    The index counts every labelled sample, the rank only the usable ones. Ranking and indexing
    touch (lang, group, id) only; texts and paths are fetched for the winners, at most n per language.
    """
    labelled = labelled_only(samples)
    usable = labelled if valid is None else labelled.where(valid)
    keys = ["lang", "group", "id"]
    first = top_n(
        usable.select(*keys), ["lang"], [F.col("group"), F.col("id")], n, keys, rank="_rank"
    ).select(*keys, (F.col("_rank") - 1).alias("rank"))
    first = staged(first, "first-labelled")
    index = sample_index(labelled.select(*keys), only=first.select(*keys), only_on=keys)
    # the staged winners reduce the wide rows first; the join with the index is then a small one
    return join_rows(join_rows(labelled, first, keys), index, keys)


def pick_noise(rows: DataFrame, noise: DataFrame, seed: int = 0) -> DataFrame:
    """Give each row one noise clip, the same one in every run with the same seed.

    Every (lang, group, id) draws for itself. Where ``noise`` has the clips' ``samples``, only those
    that can be mixed are drawn.
    """
    if "samples" in noise.columns:
        noise = noise.where(usable(F.col("samples")))
    clips = global_index(noise.select("noise_id"), [], [F.md5("noise_id"), "noise_id"], hash_bucket("noise_id"), name="_pick")
    n_clips = noise.agg(F.count(F.lit(1))).scalar()
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "group", "id") if c in rows.columns]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return rows.withColumn("_pick", F.pmod(draw, n_clips)).join(clips, "_pick").drop("_pick")


def noise_plan(
    samples: DataFrame, noise: DataFrame, out_dir: str, seed: int = 0, per_lang: int = K.NOISY_PER_LANG,
    train_per_lang: int = K.NOISY_TRAIN_PER_LANG, valid: Column | None = None,
) -> DataFrame:
    """Which samples get noise: the first ``per_lang`` per language, split into train and test."""
    chosen = pick_noise(_first_labelled(samples, per_lang, valid), noise, seed)
    chosen = chosen.withColumn("group_name", F.when(F.col("rank") < train_per_lang, "train").otherwise("test"))
    name = F.concat(F.concat_ws("-", "lang", "group_name", "idx", "id", "noise_id"), F.lit(".wav"))
    return chosen.withColumn("noisy_output_path", F.concat(F.lit(out_dir.rstrip("/") + "/"), name))


def silence_plan(
    samples: DataFrame, out_dir: str, per_lang: int = K.SILENCE_PER_LANG, valid: Column | None = None
) -> DataFrame:
    """Which samples get silence, and where: front, middle, back in equal shares."""
    chosen = _first_labelled(samples, per_lang, valid).withColumn(
        "silence_position",
        F.when(F.col("rank") < K.SILENCE_FRONT_END, "front")
        .when(F.col("rank") < K.SILENCE_MIDDLE_END, "middle")
        .otherwise("back"),
    )
    name = F.concat(F.concat_ws("-", "lang", "silence_position", "idx", "id"), F.lit("-silence.wav"))
    return chosen.withColumn("silence_output_path", F.concat(F.lit(out_dir.rstrip("/") + "/"), name))


def language_shortfalls(samples: DataFrame, wanted: int = K.NOISY_PER_LANG) -> DataFrame:
    """Languages with fewer than ``wanted`` rows."""
    counts = samples.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") < wanted)


def dataset_shape(samples: DataFrame) -> DataFrame:
    return samples.groupBy("lang", "group").agg(F.count(F.lit(1)).alias("n"))
