"""One query per operator over the driver's tables (see ``standins.py``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from echoscore import constants as K
from echoscore.functions import audio as A, responses as R, text as T
from echoscore.operators import assets, clips, errors, jobs, ranking, report, requests, responses, runs, samples, scoring, sync
from echoscore.operators.indexing import chunked, sample_index
from echoscore.plans import evaluate, improve, predict, standins as V
from echoscore.session import shared_folder
from echoscore.sources import sinks
from echoscore.sources.readers import job_logs, response_lines, run_table as stored_runs, spread, summary_csv, table
from echoscore.sources.schemas import CRITIQUE_FIELDS, RUN_SUMMARY_TEXT
from echoscore.sources.stage import staged
from echoscore.streaming import completion, scoring as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AUDIO_DIR = "/audio/noisy"
SILENCE_DIR = "/audio/silence"
MODELS = ("model-a", "model-b", "model-c")
SILENCE_SAMPLES = 16
SETTING = V.RUN_KEYS


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- text and metrics -----------------------------------------------------------------------


@query
def normalize_text(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    return docs.select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query
def row_wer_cer(spark, d):
    scored = scoring.row_rates(V.transcripts(spark, d))
    return _rounded(scored.select("id", "model", "config", "wer", "cer"), "wer", "cer")


@query
def corpus_wer_cer(spark, d):
    return _rounded(scoring.corpus_rates(V.transcripts(spark, d), SETTING), "wer", "cer")


@query
def eval_counts(spark, d):
    return scoring.eval_counts(V.transcripts(spark, d), SETTING)


@query
def evaluation_summary(spark, d):
    turns = V.turns(spark, d)
    noisy = turns.where(F.col("group") != "silence").withColumnRenamed("group", "group_name")
    silence = turns.where(F.col("group") == "silence")
    jobs_ = staged(V.jobs(spark, d), "jobs")
    done = jobs_.where(F.col("lang") == "es").select(F.col("local_output_csv").alias("path"), "prompt_version")
    done = done.select(T.result_path(F.col("path"), F.col("prompt_version")).alias("local_inference_csv_path"))
    summary = evaluate.run_summary(jobs_, done, noisy, silence, V.response_lines(spark, d))
    return _rounded(summary.drop("job_id", *scoring.COUNTS), "wer", "cer")


@query
def run_table(spark, d):
    """From files to the run table: response files and job logs written, read, scored and appended in two
    rounds, the second over all logs; then the newest run of each setting and the best of each language."""
    base = shared_folder(spark, "runs")
    lines = V.response_lines(spark, d).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(8)))
    # all lines of a request go to one file, in the order of the attempts
    ordered = lines.repartition("job_id", "_part").sortWithinPartitions("job_id", "_part", "seq")
    ordered.select("job_id", F.col("raw").alias("value")).write.partitionBy("job_id").text(f"{base}/answers")
    turns = V.turns(spark, d)
    noisy = turns.where(F.col("group") != "silence").withColumnRenamed("group", "group_name")
    silence = turns.where(F.col("group") == "silence")
    logged = V.jobs(spark, d).withColumn("job_name", F.col("job_id")).drop("job_id", "kind")
    first = F.col("lang").isin("es", "fr")
    done = spark.createDataFrame([], "local_inference_csv_path string")
    for number, some in ((1, logged.where(first)), (2, logged)):
        sinks.job_log(some, f"{base}/logs/round={number}", ["job_name"])
        jobs_ = job_logs(spark, f"{base}/logs/round=*", arrays=False).withColumn("job_id", T.basename(F.col("gcs_output_base_uri")))
        summary = evaluate.run_summary(jobs_, done, noisy, silence, response_lines(spark, f"{base}/answers"))
        summary = staged(summary.withColumn("round", F.lit(number)), "round")
        for _ in range(2):  # appended again, a round is still there once
            sinks.append_runs(summary, f"{base}/table")
        done = stored_runs(spark, f"{base}/table")
    newest = runs.latest_run(done, SETTING)
    best = runs.best_run_per_lang(newest).select("run_seq", F.lit(True).alias("best"))
    flagged = newest.join(best, "run_seq", "left").withColumn("best", F.coalesce("best", F.lit(False)))
    named = flagged.withColumn("logged", F.col("LOG_FILE").endswith(".json"))
    return _rounded(named.select(*SETTING, "round", "n_scored", "wer", "cer", "best", "logged"), "wer", "cer")


# --- samples --------------------------------------------------------------------------------


@query
def ingest_union(spark, d):
    return samples.corpus_samples(V.raw_corpus(spark, d), "/corpus")


@query
def dedup_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))
    return ranking.first_row(docs, ["lang", "text_md5"], F.col("doc_id"))


@query
def label_filter(spark, d):
    return samples.labelled_only(V.samples(spark, d)).select("id", "lang", "group", "file_path")


@query
def dataset_shape(spark, d):
    return samples.dataset_shape(V.samples(spark, d))


@query
def first_n_per_lang(spark, d):
    valid = V.samples(spark, d).where(~F.col("toxic"))
    order = [F.col("group"), F.col("id")]
    first = ranking.top_n_wide(valid, ["lang"], ["group", "id"], order, K.NOISY_PER_LANG, ["lang", "group", "id"])
    return first.select("id", "lang", "group", "transcription", "rank")


@query
def noise_plan(spark, d):
    plan = samples.noise_plan(V.samples(spark, d), V.noise_clips(spark, d), AUDIO_DIR, valid=~F.col("toxic"))
    return plan.select("id", "lang", "group", "rank", "idx", "group_name", "noise_id", "noisy_output_path", "transcription")


@query
def silence_plan(spark, d):
    plan = samples.silence_plan(V.samples(spark, d), SILENCE_DIR)
    return plan.select("id", "lang", "group", "rank", "idx", "silence_position", "silence_output_path")


@query
def audio_path_fallback(spark, d):
    s = V.samples(spark, d).select(
        "id", F.when(F.col("medical_yn"), F.concat(F.lit("/noisy/"), "lang", F.lit("/"), F.col("id").cast("string"))).otherwise("").alias("noisy_output_path"),
        F.when(F.col("toxic"), F.concat(F.lit("/silence/"), F.col("id").cast("string"))).alias("silence_output_path"),
        F.when(F.col("group") != "dev", F.col("file_path")).alias("audio"),
    )
    return s.select("id", samples.audio_path(s, "noisy_output_path", "silence_output_path", "audio").alias("audio_path"))


@query
def quality_checks(spark, d):
    return samples.language_shortfalls(samples.labelled_only(V.samples(spark, d)))


@query
def sync_plan(spark, d):
    s = V.samples(spark, d).withColumn(
        "noisy_output_path",
        F.when(F.col("group") != "dev", F.concat(F.lit(AUDIO_DIR + "/"), "lang", F.lit("-"), F.col("id").cast("string"), F.lit(".wav"))),
    )
    uri = F.concat(F.lit("gs://bucket/batch_audio/"), "group", F.lit("_"), "lang", F.lit("/"), "lang", F.lit("-"), F.col("id").cast("string"), F.lit(".wav"))
    stored = V.samples(spark, d).where("medical_yn").select(uri.alias("path"))
    local = table(spark, d, "pages").join(table(spark, d, "documents"), F.col("page_id") == F.col("doc_id"))
    local = local.select(F.concat(F.lit(AUDIO_DIR + "/"), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"))
    return sync.sync_plan(s, stored, local, V.BUCKET, "batch_audio").select("id", "noisy_output_path", "status", "gcs_uri")


# --- chunked labelling ----------------------------------------------------------------------


def _chunks(spark, d, *columns):
    return chunked(sample_index(V.samples(spark, d).select("id", "lang", "group", *columns)))


@query
def chunk_prompts(spark, d):
    return requests.chunk_prompts(_chunks(spark, d, "transcription"))


@query
def classify_requests(spark, d):
    lines = requests.classify_requests(requests.chunk_prompts(_chunks(spark, d, "transcription")))
    schema = (
        "key string, request struct<contents: array<struct<role: string, parts: array<struct<text: string>>>>, "
        "generationConfig: struct<response_mime_type: string>>"
    )
    body = lines.select("chunk_idx", F.from_json("line", schema).alias("l"))
    content = F.get(F.col("l.request.contents"), F.lit(0))
    return body.select(
        "chunk_idx", F.col("l.key").alias("key"), content["role"].alias("role"),
        F.get(content["parts"], F.lit(0))["text"].alias("prompt"),
        F.col("l.request.generationConfig.response_mime_type").alias("mime"),
    )


@query
def strip_fence(spark, d):
    return V.answers(spark, d).select("conv_id", "turn", T.strip_fence(F.col("fenced")).alias("answer"))


def _labels(spark, d):
    return responses.parse_chunk_labels(V.chunk_answers(spark, d), F.col("file"), F.col("seq"))


@query
def parse_chunk_labels(spark, d):
    labels = _labels(spark, d)
    return labels.select(
        "chunk_idx", F.size("labels").cast("long").alias("n_labels"),
        F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"),
    )


@query
def chunk_label_apply(spark, d):
    labelled = responses.apply_chunk_labels(_chunks(spark, d), _labels(spark, d))
    return labelled.select("id", "lang", "group", "idx", "chunk_idx", "pos", "medical_yn")


@query
def chunk_shortfalls(spark, d):
    return responses.chunk_shortfalls(_chunks(spark, d), _labels(spark, d))


# --- jobs, requests, responses --------------------------------------------------------------


def _langs(spark, d):
    return table(spark, d, "documents").select("lang").distinct()


def _grid(spark, d, version="v3"):
    langs = requests.prompt_for_language(_langs(spark, d), version)
    submitted = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return requests.job_grid(langs, ("test", "silence"), MODELS, V.BUCKET, "/results", submitted_at=submitted)


@query
def job_grid(spark, d):
    g = _grid(spark, d)
    params = F.coalesce(F.to_json("generation_config"), F.lit("none")).alias("params")
    return g.select(
        "job_id", "kind", "lang", "group", "splitter", "model", "config_name", "prompt_version", "slug", "request_file",
        "gcs_input_uri", "gcs_output_base_uri", "local_output_csv", params,
    )


def _planned(spark, d):
    noisy = samples.noise_plan(V.samples(spark, d), V.noise_clips(spark, d), AUDIO_DIR, valid=~F.col("toxic"))
    silence = samples.silence_plan(V.samples(spark, d), SILENCE_DIR)
    return staged(noisy.drop("transcription"), "noisy"), staged(silence.drop("transcription"), "silence")


@query
def job_sample_fanout(spark, d):
    noisy, silence = _planned(spark, d)
    return requests.fan_out(_grid(spark, d), noisy, silence, ["id", "idx"]).select("job_id", "kind", "id", "idx")


def _stored_by_pages(spark, d):
    """Local audio: the planned files of the samples that have a page."""
    return table(spark, d, "pages").select(F.col("page_id").alias("id"))


@query
def request_json(spark, d):
    noisy, silence = _planned(spark, d)

    def with_uri(plan, column, prefix):
        local = plan.join(_stored_by_pages(spark, d), "id", "left_semi").select(F.col(column).alias("path"))
        nothing = local.where(F.lit(False))
        return sync.sync_plan(plan, nothing, local, V.BUCKET, prefix, (column,))

    prompts = table(spark, d, "documents").groupBy("lang").agg(F.count_distinct("source").alias("n")).select(
        F.concat(F.lit("prompt_v3_"), "lang", F.lit(".txt")).alias("prompt_version"),
        F.concat(F.lit("Language {language_code}, {"), F.col("n").cast("string"), F.lit("} sources.")).alias("text"),
    )
    jobs_ = requests.with_prompt_text(_grid(spark, d), prompts)
    fanned = requests.fan_out(
        jobs_, with_uri(noisy, "noisy_output_path", "batch_audio"),
        with_uri(silence, "silence_output_path", "batch_audio_silence"), ["id", "idx", "gcs_uri"],
    )
    lines = requests.inference_requests(fanned).withColumn("l", R.response_line(F.col("line")))
    content = F.get(F.col("l.request.contents"), F.lit(0))
    audio, text = F.get(content["parts"], F.lit(0)), F.get(content["parts"], F.lit(1))
    return lines.select(
        "job_id", F.col("l.key").alias("key"), content["role"].alias("role"),
        audio["fileData"]["mimeType"].alias("mime"), audio["fileData"]["fileUri"].alias("uri"), text["text"].alias("prompt"),
        F.col("line").contains("generationConfig").alias("has_config"),
        *[F.col(f"l.request.generationConfig.{c}").alias(c) for c in ("audio_timestamp", "temperature", "topK", "topP")],
    )


@query
def config_conflicts(spark, d):
    configs = table(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_returnflag"), F.col("l_linenumber").cast("string"), F.floor("l_quantity").cast("string")).alias("config_name"),
        F.format_string('{"temperature": %d}', F.round(F.col("l_discount") * 100).cast("int")).alias("params"),
    )
    return requests.config_conflicts(configs)


@query
def parse_responses(spark, d):
    return evaluate.predictions(V.response_lines(spark, d))


@query
def malformed_responses(spark, d):
    return responses.malformed(V.response_lines(spark, d)).select("id", "job_id", "raw")


@query
def join_predictions(spark, d):
    t = V.transcripts(spark, d).select("id", "job_id", "gcs_uri", "transcription")
    return responses.join_predictions(t, evaluate.predictions(V.response_lines(spark, d)), ["job_id", "gcs_uri"])


@query
def run_progress(spark, d):
    parsed = responses.parse_responses(V.response_lines(spark, d), keep=("job_id",))
    return jobs.run_progress(V.transcripts(spark, d).select("job_id", "gcs_uri"), parsed)


def _job_log(spark, d):
    """Every run as a logged job; runs without a prompt version have no output location."""
    r = V.runs(spark, d)
    return r.select(
        F.col("run_seq"), "lang", "group", "model", F.col("config").alias("config_name"), "prompt_version",
        F.when(F.col("prompt_version").isNotNull(), F.concat(F.lit("gs://bucket/batch_output/"), F.col("run_seq").cast("string"))).alias("gcs_output_base_uri"),
        F.concat(F.lit("/results/run_"), F.col("run_seq").cast("string"), F.when(F.col("group") == "silence", "_prompt_v1_silence").otherwise(""), F.lit(".csv")).alias("local_output_csv"),
    )


@query
def normalize_output_path(spark, d):
    log = _job_log(spark, d)
    return log.select("run_seq", T.result_path(F.col("local_output_csv"), F.col("prompt_version")).alias("result_path"))


@query
def incremental_runs(spark, d):
    """Every job is logged a second time, later, under another number."""
    log = _job_log(spark, d)
    log = log.unionByName(log.withColumn("run_seq", F.col("run_seq") + 1_000_000_000)).withColumn("log_row", F.col("run_seq"))
    returned = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("run_seq"))
    done = log.join(returned, "run_seq", "left_semi")
    done = done.select(T.result_path(F.col("local_output_csv"), F.col("prompt_version")).alias("local_inference_csv_path"))
    return runs.pending_jobs(log, done).select("run_seq", "lang", "group", "local_inference_csv_path")


@query
def stream_scores(spark, d):
    """Two waves of response files, streamed one after the other; later answers replace earlier ones."""
    base = shared_folder(spark, "stream")
    expected = V.transcripts(spark, d).select("job_id", "gcs_uri", "id", "transcription")
    lines = V.response_lines(spark, d)
    for wave in (1, 2):
        sinks.requests(lines.where(F.col("seq") == wave), f"{base}/landing/wave={wave}", line_col="raw")
        arriving = streaming.response_stream(spark, f"{base}/landing")
        streaming.start(arriving, expected, f"{base}/scores", f"{base}/progress").awaitTermination()
    return _rounded(streaming.current_summary(spark, f"{base}/scores", expected), "wer", "cer")


@query
def run_completions(spark, d):
    """Answers in two waves, a part and then all; the second replaces the first. Each run comes out when its last request is answered."""
    base = shared_folder(spark, "completion")
    expected = V.transcripts(spark, d).select("job_id", "gcs_uri", "id", "transcription")
    lines = V.response_lines(spark, d)
    for wave, some in ((1, (F.col("seq") == 1) & (F.col("id") % 2 == 0)), (2, F.col("seq") == 2)):
        sinks.requests(lines.where(some), f"{base}/landing/wave={wave}", line_col="raw")
        arriving = streaming.response_stream(spark, f"{base}/landing")
        completion.start(arriving, expected, f"{base}/out", f"{base}/progress", available_now=True).awaitTermination()
    done = completion.completed_runs(spark, f"{base}/out")
    return _rounded(done.select("job_id", "n_expected", "n_answered", "n_scored", "wer", "cer"), "wer", "cer")


@query
def summary_files(spark, d):
    """The run summary written as CSV files and read back, whatever the metric columns hold."""
    folder = shared_folder(spark, "summary")
    columns = [c.split()[0].strip("`") for c in RUN_SUMMARY_TEXT.split(", ")]
    sinks.csv(V.runs(spark, d).withColumn("LOG_FILE", F.col("run_seq").cast("string")).select(*columns), folder)
    read = runs.parse_metrics(summary_csv(spark, folder))
    return read.select(F.col("LOG_FILE").cast("long").alias("run_seq"), *SETTING, "wer", "cer")


# --- run selection --------------------------------------------------------------------------

RUN_OUT = ["run_seq", "lang", "group", "model", "config", "prompt_version", "wer", "cer"]


def _runs(spark, d):
    return runs.parse_metrics(V.runs(spark, d))


def _report_runs(spark, d):
    return runs.parse_report_metrics(V.runs(spark, d))


@query
def dedup_last(spark, d):
    return runs.training_runs(_runs(spark, d)).select(*RUN_OUT, "version_label")


@query
def best_run_per_lang(spark, d):
    return runs.best_run_per_lang(_runs(spark, d)).select(*RUN_OUT)


@query
def best_run_per_group_lang(spark, d):
    return runs.best_run_per_group_lang(_report_runs(spark, d)).select(*RUN_OUT)


@query
def best_report_lang(spark, d):
    return runs.best_report_lang(_report_runs(spark, d)).select(*RUN_OUT)


@query
def best_view_setting(spark, d):
    whole = runs.best_view_setting(_report_runs(spark, d)).select(F.lit("all").alias("view"), *RUN_OUT)
    each = runs.best_view_setting(_report_runs(spark, d), ["lang", "group"])
    return whole.unionByName(each.select(F.concat_ws("/", "lang", "group").alias("view"), *RUN_OUT))


@query
def next_version(spark, d):
    return runs.next_version(runs.best_run_per_lang(_runs(spark, d)))


@query
def best_to_train_run(spark, d):
    # every latest test run plays the part of a best run, so that many of them have a partner
    r = _runs(spark, d)
    best = runs.latest_run(r.where(F.col("group") == "test"))
    return runs.train_run_of_best(best, r)


# --- error analysis -------------------------------------------------------------------------


def _worst(spark, d, n=K.CRITIC_TOP_N):
    return errors.worst_cases(V.transcripts(spark, d), SETTING, n)


@query
def worst_cases(spark, d):
    return _rounded(_worst(spark, d).select(*SETTING, "id", "case_no", "transcription", "wer", "cer"), "wer", "cer")


@query
def error_case_text(spark, d):
    return errors.case_text(_worst(spark, d, K.OPTIMISER_TOP_N), SETTING, audio="gcs_uri")


@query
def critic_prompt(spark, d):
    return errors.critic_requests(errors.case_text(_worst(spark, d), SETTING)).select(*SETTING, "prompt")


def _critique_answers(spark, d):
    """One model answer per turn: a fenced array of two critiques holding the whole text."""
    c = table(spark, d, "conversations")

    def critique(*values):
        return F.struct(*[v.alias(f) for f, v in zip(CRITIQUE_FIELDS, values)])

    case = F.concat(F.lit("Case "), F.col("turn").cast("string"))
    keep = F.concat(F.lit("Keep: "), "text")
    items = F.array(critique(F.col("role"), case, F.col("text"), keep), critique(F.lit("Other"), F.lit("all"), F.md5("text"), F.col("text")))
    answer = F.concat(F.lit("```json\n"), F.to_json(items), F.lit("\n```"))
    return c.select("conv_id", "turn", answer.alias("answer"))


@query
def critic_rows(spark, d):
    return errors.critic_rows(_critique_answers(spark, d), ["conv_id", "turn"])


@query
def critique_text(spark, d):
    return errors.critique_text(critic_rows(spark, d), ["conv_id", "turn"])


@query
def critic_fallback(spark, d):
    exact, general = V.critics(spark, d)
    train = runs.training_runs(_runs(spark, d))
    found = errors.critiques_for_runs(train, exact, general)
    return found.select("run_seq", "critic_source", "critique_no", "error_pattern", "affected_cases", "reason_for_failure", "generalizable_improvement")


def _counted(prompts):
    return "chars " + prompts.str.len().astype(str)


@query
def remembered_answers(spark, d):
    """The users' texts are asked first, then all texts; the second run asks for those that the first did not have."""
    memory = f"{shared_folder(spark, 'answers')}/memory"
    asked = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"))
    predict.with_remembered_answers(asked.where("role = 'user'"), _counted, memory, "first")
    return predict.with_remembered_answers(asked, _counted, memory, "second").select("conv_id", "turn", "answer", "asked_in")


@query
def prompt_fallback(spark, d):
    main, modified = V.prompt_folders(spark, d)
    return errors.prompt_for_runs(_runs(spark, d).select("run_seq", "prompt_version"), main, modified)


META_TEMPLATE = (
    "Model {args.model}, config {used_config} {keep this}.\n# Prompt\n{used_prompt}\n"
    "# Cases\n{error_cases_text}\n# Critiques\n{critiques_text}"
)


@query
def render_prompt(spark, d):
    rows = table(spark, d, "conversations").join(critique_text(spark, d), ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("role").alias("model"), F.lit("default").alias("config"),
        F.concat(F.lit("{error_cases_text} "), "text").alias("used_prompt"),
        F.concat(F.lit("Cases of "), "text").alias("error_cases_text"), "critiques_text",
    )
    return errors.rewrite_requests(rows, META_TEMPLATE).select("conv_id", "turn", "analysis_prompt")


@query
def rewrite_requests(spark, d):
    """Scored runs -> best per language -> worst cases of its training run -> one filled meta prompt."""
    t = V.transcripts(spark, d).withColumn("path", F.concat(F.lit("/results/evaluation_"), V.job_id(), F.lit(".csv")))
    rows = t.select(*SETTING, "path", "id", "transcription", "prediction", F.col("gcs_uri").alias("noisy_output_path"))
    rows = evaluate.stored_scores(rows)
    summary = scoring.rates_of_counts(rows, [*SETTING, "path"]).withColumnRenamed("path", "local_inference_csv_path")
    seq = F.conv(F.substring(F.md5("local_inference_csv_path"), 1, 15), 16, 10).cast("long")
    summary = staged(summary.withColumn("run_seq", seq), "summary")
    rows = rows.select("path", "id", "transcription", "prediction", "noisy_output_path", "wer", "cer")
    key = F.col("n_regionkey")
    lang = F.when(key == 0, "en").when(key == 1, "fr").when(key == 2, "de").otherwise("none")
    name = F.col("n_name")
    general = table(spark, d, "nation").select(
        lang.alias("lang"), F.col("n_nationkey").cast("long").alias("critique_no"), name.alias("error_pattern"),
        F.lit("all").alias("affected_cases"), name.alias("reason_for_failure"), name.alias("generalizable_improvement"),
    )
    exact, _ = V.critics(spark, d)
    main, modified = V.prompt_folders(spark, d)
    out = improve.rewrite_request_table(summary, rows, exact, general, main, modified, META_TEMPLATE)
    return out.select("lang", "model", "config", "prompt_version", "analysis_prompt")


@query
def extract_fenced(spark, d):
    a = V.answers(spark, d).select("conv_id", "turn", F.col("role").alias("lang"), F.col("free").alias("answer"))
    found = errors.new_prompts(a.withColumn("v", F.col("turn")), F.col("v"))
    return found.select("prompt_version", "lang", "text", F.md5("report").alias("report_md5"))


# --- report ---------------------------------------------------------------------------------


@query
def summary_sorted(spark, d):
    return report.summary_sorted(_report_runs(spark, d)).select(*RUN_OUT, "local_inference_csv_path")


@query
def report_dims(spark, d):
    return report.dimensions(_report_runs(spark, d))


@query
def report_chart(spark, d):
    return report.chart(_report_runs(spark, d), group="test")


@query
def report_views(spark, d):
    return report.chart_views(_report_runs(spark, d))


@query
def report_flags(spark, d):
    return report.best_flags(_report_runs(spark, d).withColumn("group", F.when(F.col("group") != "silence", F.col("group"))), ["lang", "group"]).select(*RUN_OUT, "best_wer", "best_cer")


@query
def report_detail(spark, d):
    t = V.transcripts(spark, d)
    path = F.concat(F.lit("/results/evaluation_"), V.job_id(), F.lit(".csv"))
    moved = F.concat(F.lit("/archive/evaluation_"), V.job_id(), F.lit(".csv"))
    rows = evaluate.stored_scores(t.select(
        *SETTING, F.when(F.col("lang") == "fr", moved).otherwise(path).alias("result_path"), path.alias("path"), "id", "transcription", "prediction",
        F.col("gcs_uri").alias("file_path"),
    ), "result_path")
    summary = scoring.rates_of_counts(rows, [*SETTING, "path"]).withColumnRenamed("path", "local_inference_csv_path").withColumn("run_seq", F.lit(0))
    rows = rows.select("result_path", "id", "transcription", "prediction", "file_path", "wer", "cer")
    listing = rows.select(F.col("result_path").alias("path")).distinct()
    best = report.dataset_sections(
        summary, listing.where(F.col("path").startswith("/results/")), listing.where(F.col("path").startswith("/archive/"))
    )
    return _rounded(report.detail(best, rows), "wer", "cer")


@query
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


def _assets(spark, d):
    """Known assets: '/<word>' for every word of the benchmark texts."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", "[ \n]")).alias("w"))
    return words.where("w <> ''").select(F.concat(F.lit("/"), "w").alias("path")).distinct()


@query
def asset_manifest(spark, d):
    return assets.asset_manifest(table(spark, d, "pages"), _assets(spark, d), attribute="href")


@query
def asset_rewrite(spark, d):
    return assets.rewrite_pages(table(spark, d, "pages"), _assets(spark, d), attribute="href").select("page_id", "html")


# --- audio ----------------------------------------------------------------------------------


def _mixed(spark, d):
    picked = samples.pick_noise(V.main_clips(spark, d), V.noise_clips(spark, d))
    return picked.join(V.noise_clips(spark, d), "noise_id")


@query
def audio_dbfs(spark, d):
    return _rounded(V.main_clips(spark, d).select("id", A.dbfs(F.col("main")).alias("dbfs")), "dbfs", digits=5)


@query
def noise_gain(spark, d):
    gain = A.noise_gain(F.col("main"), F.col("samples"))
    return _rounded(_mixed(spark, d).select("id", "noise_id", gain.alias("gain")), "gain")


def _samples_out(df, clip):
    out = df.select("id", F.posexplode(clip).alias("pos", "sample"))
    return out.withColumn("sample", F.round(F.col("sample").cast("double"), 4))


@query
def noise_mix(spark, d):
    mixed = _mixed(spark, d).withColumn("gain", A.noise_gain(F.col("main"), F.col("samples")))
    return _samples_out(mixed, A.mix(F.col("main"), F.col("samples"), F.col("gain")))


@query
def usable_clips(spark, d):
    return V.noise_clips(spark, d).select("noise_id", A.usable(F.col("samples")).alias("usable"))


@query
def silence_insert(spark, d):
    positions = F.explode(F.array(F.lit("front"), F.lit("middle"), F.lit("back"))).alias("position")
    clips = V.main_clips(spark, d).select("id", "main", positions)
    out = A.insert_silence(F.col("main"), SILENCE_SAMPLES, F.col("position"))
    return clips.select("id", "position", F.posexplode(out).alias("pos", "sample")).withColumn(
        "sample", F.round(F.col("sample").cast("double"), 4)
    )


#: Samples per block where clips are kept in blocks; the clips here are short.
CLIP_BLOCK = 24


def _block_samples(df, *keys):
    out = df.select(*keys, "block", F.posexplode("samples").alias("at", "sample"))
    return out.select(*keys, (F.col("block") * CLIP_BLOCK + F.col("at")).cast("int").alias("pos"), F.round(F.col("sample").cast("double"), 4).alias("sample"))


@query
def noise_mix_blocks(spark, d):
    """``noise_mix`` over clips in blocks."""
    main, noise = V.main_clips(spark, d), V.noise_clips(spark, d)
    picks = samples.pick_noise(main.select("id"), noise)
    noise = clips.blocks(noise, "samples", CLIP_BLOCK, ("noise_id",))
    return _block_samples(clips.mixed(clips.blocks(main, "main", CLIP_BLOCK), noise, picks, CLIP_BLOCK), "id")


@query
def silence_insert_blocks(spark, d):
    """``silence_insert`` over clips in blocks."""
    main = V.main_clips(spark, d)
    places = main.select("id", F.explode(F.array(F.lit("front"), F.lit("middle"), F.lit("back"))).alias("position"))
    return _block_samples(clips.with_silence(clips.blocks(main, "main", CLIP_BLOCK), places, SILENCE_SAMPLES, CLIP_BLOCK), "id", "position")


# --- job states -----------------------------------------------------------------------------


@query
def job_status(spark, d):
    latest = jobs.latest_status(V.statuses(spark, d), F.col("ts"), F.col("event_id"))
    return latest.select("job_name", "state", "is_active", "is_terminal")


@query
def job_state_counts(spark, d):
    return jobs.status_counts(jobs.latest_status(V.statuses(spark, d), F.col("ts"), F.col("event_id")))


@query
def job_union_distinct(spark, d):
    logged = table(spark, d, "orders").select(F.concat(F.lit("job-"), F.col("o_custkey").cast("string")).alias("job_name"))
    return jobs.distinct_jobs(logged, V.statuses(spark, d))


@query
def newest_log_jobs(spark, d):
    logs = table(spark, d, "orders").select(
        F.col("o_orderdate").alias("log_time"), F.concat(F.lit("log_"), F.date_format("o_orderdate", "yyyyMMdd")).alias("log_file"),
        F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_name"),
    )
    return jobs.newest_log_jobs(logs)
