"""The driver's tables seen as the engine's tables.

No speech corpus is at hand, so the catalogue queries read these views. Each one covers the whole
table(s) it comes from, with whole texts; ``oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoscore.functions import text as T
from echoscore.operators.indexing import chunked, sample_index
from echoscore.operators.runs import parse_metrics
from echoscore.sources.readers import lang_and_split, spread, table

BUCKET = "bucket"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """documents + labels as labelled utterances; ``toxic`` marks clips that cannot be mixed."""
    split = F.when(F.col("n_chars") < 1000, "dev").when(F.col("n_chars") < 2500, "test").otherwise("train")
    docs = spread(table(spark, d, "documents"), "doc_id").withColumn("group", split)
    path = F.concat(F.lit("/corpus/"), "lang", F.lit("/audio/"), "group", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("text").alias("transcription"), path.alias("file_path"), "lang", "group",
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("medical_yn"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    )


def raw_corpus(spark: SparkSession, d: str) -> DataFrame:
    """documents and benchmark as raw corpus rows with the path they would have been read from."""
    split = F.when(F.col("n_chars") < 1000, "dev").when(F.col("n_chars") < 2500, "test").otherwise("train")
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("transcription"), F.col("doc_id").alias("seq"),
        F.concat(F.lit("/corpus/"), "lang", F.lit("/"), split, F.lit(".tsv")).alias("path"),
    )
    bench = table(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("transcription"),
        (F.col("item_id") + 1_000_000_000_000).alias("seq"), F.lit("/corpus/en/dev.tsv").alias("path"),
    )
    rows = docs.unionByName(bench)
    return rows.select(
        "id", F.concat(F.col("id").cast("string"), F.lit(".wav")).alias("file_name"), "transcription", "seq",
        *lang_and_split(F.col("path")),
    )


def noise_clips(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as noise; in tens of ids one clip is silent, one empty and one ends in NaN."""
    digit, clip = F.col("vec_id") % 10, F.col("embedding")
    samples = (
        F.when(digit == 3, F.transform(clip, lambda x: F.lit(0.0).cast("float")))
        .when(digit == 5, F.slice(clip, 1, 0))
        .when(digit == 7, F.concat(clip, F.array(F.lit(float("nan")).cast("float"))))
        .otherwise(clip)
    )
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("noise"), F.col("vec_id").cast("string")).alias("noise_id"), samples.alias("samples")
    )


def main_clips(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as clips twice as long as the noise, so that noise has to loop."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat("embedding", F.reverse("embedding")).alias("main")
    )


def _letters(lang: Column, *rules: tuple[str, str]) -> Column:
    out = F.lit("en")
    for pattern, name in reversed(rules):
        out = F.when(lang.rlike(pattern), name).otherwise(out)
    return out


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conversations as reference transcripts: language guessed from letters, group from the role."""
    text = F.col("text")
    rows = spread(table(spark, d, "conversations"), "conv_id", "turn").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.col("text").alias("transcription"),
        _letters(text, ("[êèç]", "fr"), ("[äöüß]", "de"), ("[ñíáóú]", "es")).alias("lang"),
        F.when(F.col("role") == "assistant", "train").when(F.col("role") == "user", "test").otherwise("silence").alias("group"),
    )
    uri = F.concat(F.lit(f"gs://{BUCKET}/batch_audio/"), "group", F.lit("_"), "lang", F.lit("/"), F.col("id").cast("string"), F.lit(".wav"))
    return rows.withColumn("gcs_uri", uri)


def _settings() -> Column:
    """Three (model, config, prompt, distorted text) settings per turn."""
    text = F.col("transcription")
    shared, own = F.lit("prompt_v2.txt"), F.concat(F.lit("prompt_v3_"), "lang", F.lit(".txt"))
    respelled = F.replace(F.replace(text, F.lit("th"), F.lit("t")), F.lit(". "), F.lit(" uh "))
    dropped = F.regexp_replace(text, " (the|la|die|el|of|le) ", " ")
    vowels = F.replace(text, F.lit("e"), F.lit("a"))

    def setting(model: str, config: str, prompt: Column, heard: Column) -> Column:
        return F.struct(
            F.lit(model).alias("model"), F.lit(config).alias("config"), prompt.alias("prompt_version"), heard.alias("heard")
        )

    return F.array(
        setting("model-a", "default", shared, respelled),
        setting("model-a", "temperature", shared, dropped),
        setting("model-b", "default", own, vowels),
    )


def job_id(config: str = "config") -> Column:
    slug = T.drop_extension(F.col("prompt_version"))
    return F.concat_ws("_", "group", "lang", F.concat_ws("-", "model", config), slug)


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Every turn under every setting with its prediction; silence turns were never answered."""
    rows = turns(spark, d).withColumn("_s", F.explode(_settings())).select("*", "_s.*").drop("_s")
    heard = F.when(F.col("group") == "test", F.concat("heard", F.lit(" [EOT]"))).otherwise(F.col("heard"))
    rows = rows.withColumn("prediction", F.when(F.col("group") == "silence", "").otherwise(heard)).drop("heard")
    return rows.withColumn("job_id", job_id())


RUN_KEYS = ["lang", "group", "model", "config", "prompt_version"]


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """The job log: one job per setting, language and group of the turns."""
    keys = transcripts(spark, d).select(*RUN_KEYS).distinct()
    return keys.select(
        *[c for c in RUN_KEYS if c != "config"], F.col("config").alias("config_name"), job_id().alias("job_id"),
        F.when(F.col("group") == "silence", "silence").otherwise("normal").alias("kind"),
        F.concat(F.lit(f"gs://{BUCKET}/batch_output/"), job_id()).alias("gcs_output_base_uri"),
        F.concat(F.lit("/results/evaluation_"), job_id(), F.lit(".csv")).alias("local_output_csv"),
    )


def response_lines(spark: SparkSession, d: str) -> DataFrame:
    """Response files: an empty first attempt and the answer per prediction; silence lines broken off."""
    t = transcripts(spark, d)
    key = F.concat(F.lit("req-"), F.col("id").cast("string"))
    no_text, no_file = F.lit(None).cast("string"), F.lit(None).cast("struct<mimeType: string, fileUri: string>")
    audio = F.struct(F.lit("audio/wav").alias("mimeType"), F.col("gcs_uri").alias("fileUri"))
    parts = F.array(
        F.struct(audio.alias("fileData"), no_text.alias("text")),
        F.struct(no_file.alias("fileData"), F.lit("Transcribe.").alias("text")),
    )
    request = F.struct(F.array(F.struct(F.lit("user").alias("role"), parts.alias("parts"))).alias("contents"))

    def line(text: Column) -> Column:
        answer = F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content")))
        return F.to_json(F.struct(key.alias("key"), request.alias("request"), F.struct(answer.alias("candidates")).alias("response")))

    broken = F.concat(F.lit('{"key": "'), key)
    attempts = F.when(
        F.col("group") == "silence", F.array(F.struct(F.lit(1).alias("seq"), broken.alias("raw")))
    ).otherwise(
        F.array(
            F.struct(F.lit(1).alias("seq"), line(F.lit("")).alias("raw")),
            F.struct(F.lit(2).alias("seq"), line(F.col("prediction")).alias("raw")),
        )
    )
    return t.select("id", "job_id", F.lit("predictions.jsonl").alias("file"), F.explode(attempts).alias("_a")).select(
        "id", "job_id", "file", "_a.*"
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """orders + customer + nation as the run summary, metrics still text. One order is one run."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    o = spread(o, "o_orderkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    version = (F.year("o_orderdate") - 1990).cast("string")
    lang = F.lower("n_name")
    per_lang = F.concat(F.lit("prompt_v"), version, F.lit("_"), lang, F.lit(".txt"))
    prompt = F.when(F.col("c_acctbal") >= 0, F.when(F.month("o_orderdate") <= 6, F.concat(F.lit("prompt_v"), version, F.lit(".txt"))).otherwise(per_lang))
    rows = rows.select(
        F.col("o_orderkey").alias("run_seq"), lang.alias("lang"),
        F.when(F.col("o_orderstatus") == "F", "test").when(F.col("o_orderstatus") == "O", "train").otherwise("silence").alias("group"),
        F.col("o_orderpriority").alias("model"), F.col("c_mktsegment").alias("config"), prompt.alias("prompt_version"),
        F.when(F.col("c_acctbal") >= 0, (F.floor(F.col("c_acctbal") / 10) / 1000).cast("string")).otherwise("n/a").alias("wer"),
        (F.floor(F.col("o_totalprice") / 1000) / 1000).cast("string").alias("cer"),
    )
    label = T.version_label(F.col("prompt_version"))
    path = F.concat(F.lit("/results/evaluation_"), F.concat_ws("_", "group", "lang", F.concat_ws("-", "model", "config"), label), F.lit(".csv"))
    return rows.withColumn("local_inference_csv_path", path)


def critics(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Critiques per setting (large training orders) and one per language (its nation and region)."""
    large = parse_metrics(runs(spark, d)).where((F.col("group") == "train") & (F.col("cer") >= 0.4))
    seq = F.col("run_seq").cast("string")
    exact = large.select(
        "lang", "group", "model", "config", T.version_label(F.col("prompt_version")).alias("version_label"),
        F.col("run_seq").alias("critique_no"), F.concat(F.lit("pattern "), seq).alias("error_pattern"),
        F.concat(F.lit("case "), seq).alias("affected_cases"), F.col("model").alias("reason_for_failure"),
        F.col("config").alias("generalizable_improvement"),
    )
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    general = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("n_name").alias("lang"), F.col("n_nationkey").cast("long").alias("critique_no"), F.col("n_name").alias("error_pattern"),
        F.lit("all").alias("affected_cases"), F.col("r_name").alias("reason_for_failure"),
        F.concat(F.lit("See "), "r_name").alias("generalizable_improvement"),
    )
    return exact, general


def prompt_folders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Main folder: benchmark texts as prompt_v<n>.txt. Modified folder: one v4 file per nation."""
    main = table(spark, d, "benchmark").select(
        F.concat(F.lit("prompt_v"), F.col("item_id").cast("string"), F.lit(".txt")).alias("prompt_version"), "text"
    )
    modified = table(spark, d, "nation").select(
        F.concat(F.lit("prompt_v4_"), F.lower("n_name"), F.lit(".txt")).alias("prompt_version"),
        F.concat(F.lit("Rules for "), "n_name").alias("text"),
    )
    return main, modified


def chunk_answers(spark: SparkSession, d: str) -> DataFrame:
    """Classify responses: a broken first line and a fenced array per chunk.

    The array holds one flag per *labelled* document of the chunk, so most answers are too short.
    """
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("flag"))
    placed = chunked(sample_index(samples(spark, d).select("id", "lang", "group"))).join(labels, "id")
    flags = F.array_sort(F.collect_list(F.struct("pos", "flag")))["flag"]
    arrays = placed.groupBy("chunk_idx").agg(F.to_json(flags).alias("json"))
    key = F.concat(F.lit("req-"), F.col("chunk_idx").cast("string"))

    def line(text: Column) -> Column:
        answer = F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content")))
        return F.to_json(F.struct(key.alias("key"), F.struct(answer.alias("candidates")).alias("response")))

    fenced = F.concat(F.lit("```json\n"), F.col("json"), F.lit("\n```"))
    attempts = F.array(
        F.struct(F.lit(1).alias("seq"), line(F.lit("[true,")).alias("raw")),
        F.struct(F.lit(2).alias("seq"), line(fenced).alias("raw")),
    )
    return arrays.select(F.lit("labels.jsonl").alias("file"), F.explode(attempts).alias("_a")).select("file", "_a.*")


def statuses(spark: SparkSession, d: str) -> DataFrame:
    """events as job state reports: user = job, event type = state."""
    state = (
        F.when(F.col("event_type") == "view", "JOB_STATE_PENDING")
        .when(F.col("event_type") == "click", "JOB_STATE_RUNNING")
        .when(F.col("event_type") == "signup", "JOB_STATE_QUEUED")
        .when(F.col("event_type") == "purchase", "JOB_STATE_SUCCEEDED")
        .otherwise("JOB_STATE_FAILED")
    )
    return table(spark, d, "events").select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_name"),
        F.concat(F.lit("JobState."), state).alias("state"), "ts", "event_id",
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    """conversations as free-text model answers in every layout the parsers know."""
    t = F.col("text")
    fence = "```"
    free = (
        F.when(F.col("role") == "assistant", F.concat(F.lit(f"Old:\n{fence}text\nold\n{fence}\nNew:\n{fence}prompt\n"), t, F.lit(f"\n{fence}\nDone.")))
        .when(F.col("role") == "user", F.concat(F.lit("1. **Analysis**\n3. **Optimized Prompt Proposal**\n "), t))
        .otherwise(t)
    )
    fenced = (
        F.when(F.col("role") == "assistant", F.concat(F.lit(f"{fence}json\n"), t, F.lit(f"\n{fence}")))
        .when(F.col("role") == "user", F.concat(F.lit(f" {fence}"), t, F.lit(fence)))
        .otherwise(t)
    )
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", free.alias("free"), fenced.alias("fenced"))
