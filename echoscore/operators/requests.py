"""Experiment grid, fan-out over samples, and request lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoscore import constants as K
from echoscore.functions import text as T
from echoscore.sources import schemas as S


def _options(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def config_options(configs: Sequence[tuple]) -> Column:
    """Config tuples (name, audio_timestamp, temperature, topK, topP) as an array of structs.

    A config without any parameter gets a NULL generation_config, which leaves the key out of the
    request.
    """
    options = []
    for name, *params in configs:
        fields = [F.lit(p).cast(t).alias(f) for f, t, p in zip(
            ("audio_timestamp", "temperature", "topK", "topP"), ("boolean", "double", "int", "double"), params
        )]
        body = F.struct(*fields) if any(p is not None for p in params) else F.lit(None)
        options.append(F.struct(F.lit(name).alias("name"), body.cast(S.GENERATION_CONFIG).alias("params")))
    return F.array(*options)


def job_grid(
    langs: DataFrame, groups: Sequence[str], models: Sequence[str], bucket: str, results_dir: str,
    configs: Sequence[tuple] = K.CONFIGS, silence_configs: Sequence[tuple] = K.SILENCE_CONFIGS,
    submitted_at: Column | None = None,
) -> DataFrame:
    """One job per language x group x model x config.

    ``langs`` has (lang, prompt_version). The other dimensions are argument lists and unfold from
    literal arrays, so no join takes part. The ``silence`` group has its own config list, folders
    and file suffix.
    """
    silent = F.col("group") == K.SILENCE_GROUP
    jobs = (
        langs.select("lang", "prompt_version")
        .withColumn("group", F.explode(_options(groups)))
        .withColumn("model", F.explode(_options(models)))
        .withColumn("_config", F.explode(F.when(silent, config_options(silence_configs)).otherwise(config_options(configs))))
        .withColumn("kind", F.when(silent, "silence").otherwise("normal"))
    )
    splitter = F.concat_ws("_", "group", "lang")
    tag = F.concat_ws("-", "model", "config_name")
    suffix = F.when(silent, "_silence").otherwise("")
    store = F.lit(f"gs://{bucket}/")
    return (
        jobs.withColumn("config_name", F.col("_config.name"))
        .withColumn("generation_config", F.col("_config.params"))
        .withColumn("splitter", splitter)
        .withColumn("slug", T.drop_extension(F.col("prompt_version")))
        .withColumn("job_id", F.concat_ws("_", "splitter", tag, "slug"))
        .withColumn("request_file", F.concat("job_id", suffix, F.lit("_requests.jsonl")))
        .withColumn("gcs_input_uri", F.concat(store, F.lit("batch_input"), suffix, F.lit("/"), "splitter", F.lit("/"), "request_file"))
        .withColumn("gcs_output_base_uri", F.concat(store, F.lit("batch_output"), suffix, F.lit("/"), "job_id"))
        .withColumn(
            "local_output_csv",
            F.concat(F.lit(results_dir.rstrip("/") + "/evaluation_"), "job_id", suffix, F.lit(".csv")),
        )
        .withColumn("submitted_at", F.current_timestamp() if submitted_at is None else submitted_at)
        .drop("_config")
    )


def languages(spark: SparkSession, names: Sequence[str] = K.LANGUAGES) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "lang string")


def prompt_for_language(langs: DataFrame, version: str | None) -> DataFrame:
    """(lang, prompt_version): the per-language file of ``version``, or the shared file for None."""
    name = F.concat(F.lit(f"prompt_{version}_"), "lang", F.lit(".txt")) if version else F.lit(K.SHARED_PROMPT)
    return langs.select("lang", name.alias("prompt_version"))


def job_records(jobs: DataFrame, submitted: DataFrame) -> DataFrame:
    """Log records of the jobs that were accepted: ``submitted`` has (job_id, job_name)."""
    return jobs.join(submitted, "job_id").select(
        "lang", "group", "splitter", "model", "config_name", "job_name", "prompt_version", "gcs_output_base_uri",
        "local_output_csv", F.date_format("submitted_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("submitted_at"),
    )


def with_prompt_text(jobs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Add ``prompt_text`` with the language filled in; a job without prompt file is an error."""
    found = jobs.join(prompts.select("prompt_version", F.col("text").alias("_template")), "prompt_version", "left")
    missing = F.raise_error(F.concat(F.lit("prompt not found: "), F.coalesce("prompt_version", F.lit("NULL"))))
    template = F.coalesce(F.col("_template"), missing.cast("string"))
    filled = T.fill_template(template, {K.LANGUAGE_PLACEHOLDER: F.col("lang")})
    return found.withColumn("prompt_text", filled).drop("_template")


def config_conflicts(configs: DataFrame, name: str = "config_name", params: str = "params") -> DataFrame:
    """Config names that stand for more than one parameter set."""
    sets = configs.groupBy(name).agg(F.count_distinct(F.coalesce(F.col(params), F.lit(""))).alias("n_param_sets"))
    return sets.where(F.col("n_param_sets") > 1)


def fan_out(jobs: DataFrame, noisy: DataFrame | None, silence: DataFrame | None, sample_cols: Sequence[str]) -> DataFrame:
    """One row per (job, sample).

    Normal jobs take the samples of their (lang, group_name); silence jobs all silence samples of
    their language. Two equi-joins; jobs without samples vanish.
    """
    parts = []
    if noisy is not None:
        side = noisy.select(*sample_cols, F.col("lang").alias("_lang"), F.col("group_name").alias("_group"))
        normal = jobs.where(F.col("kind") == "normal")
        match = (F.col("lang") == F.col("_lang")) & (F.col("group") == F.col("_group"))
        parts.append(normal.join(side, match).drop("_lang", "_group"))
    if silence is not None:
        side = silence.select(*sample_cols, F.col("lang").alias("_lang"))
        silent = jobs.where(F.col("kind") == "silence")
        parts.append(silent.join(side, F.col("lang") == F.col("_lang")).drop("_lang"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def inference_requests(fanned: DataFrame, row_index: str = "idx") -> DataFrame:
    """(job_id, key, line) per job and sample with a URI.

    Expects prompt_text, slug, generation_config, gcs_uri. NULL struct fields stay out of the JSON.
    """
    no_text, no_file = F.lit(None).cast("string"), F.lit(None).cast("struct<mimeType: string, fileUri: string>")
    audio = F.struct(F.lit(K.AUDIO_MIME_TYPE).alias("mimeType"), F.col("gcs_uri").alias("fileUri"))
    parts = F.array(
        F.struct(audio.alias("fileData"), no_text.alias("text")),
        F.struct(no_file.alias("fileData"), F.col("prompt_text").alias("text")),
    )
    contents = F.array(F.struct(F.lit("user").alias("role"), parts.alias("parts")))
    body = F.struct(contents.alias("contents"), F.col("generation_config").alias("generationConfig"))
    key = F.concat(F.lit("req-"), F.col(row_index).cast("string"), F.lit("-"), F.col("slug"))
    return fanned.where(F.col("gcs_uri").isNotNull()).select(
        "job_id", key.alias("key"), F.to_json(F.struct(key.alias("key"), body.alias("request"))).alias("line")
    )


def chunk_prompts(chunked: DataFrame, text: str = "transcription") -> DataFrame:
    """One classify prompt per chunk: the fixed instruction and the numbered texts."""
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.coalesce(text, F.lit("")), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    packed = chunked.groupBy("chunk_idx").agg(F.count(F.lit(1)).alias("n"), lines.alias("_lines"))
    listing = F.array_join(F.col("_lines.line"), "")
    return packed.select("chunk_idx", "n", F.concat(F.lit(K.CLASSIFY_PROMPT), listing).alias("prompt"))


def classify_requests(prompts: DataFrame) -> DataFrame:
    """(chunk_idx, key, line) per chunk prompt."""
    key = F.concat(F.lit("req-"), F.col("chunk_idx").cast("string"))
    parts = F.array(F.struct(F.col("prompt").alias("text")))
    contents = F.array(F.struct(F.lit("user").alias("role"), parts.alias("parts")))
    config = F.struct(F.lit(K.JSON_MIME_TYPE).alias("response_mime_type"))
    body = F.struct(contents.alias("contents"), config.alias("generationConfig"))
    line = F.to_json(F.struct(key.alias("key"), body.alias("request")))
    return prompts.select("chunk_idx", key.alias("key"), line.alias("line"))
