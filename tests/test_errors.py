import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoscore import constants as K
from echoscore.operators import errors
from echoscore.plans import evaluate, improve
from echoscore.plans.predict import with_answers
from echoscore.sources.schemas import CRITIQUE_FIELDS


def test_worst_cases(spark):
    rows = [("r1", i, "abcd efgh", "abcd efgh"[: i % 10]) for i in range(50)] + [("r2", 1, "x", "y")]
    df = spark.createDataFrame(rows, "run string, id long, transcription string, prediction string")
    got = errors.worst_cases(df, ["run"], 7).where("run = 'r1'").orderBy("case_no").collect()
    assert [r.case_no for r in got] == list(range(1, 8))
    assert [r.id for r in got] == [0, 10, 20, 30, 40, 1, 11]
    assert errors.worst_cases(df, ["run"], 7).where("run = 'r2'").first().case_no == 1


def test_case_text(spark):
    df = spark.createDataFrame(
        [(1, 2, "b", None, 0.5, 0.256, "/x/y.wav"), (1, 1, "a", "A [EOT]", 1.0, 1 / 3, None)],
        "run long, case_no int, transcription string, prediction string, wer double, cer double, noisy_output_path string",
    )
    assert errors.case_text(df, ["run"]).first().error_cases_text == (
        "## Case 1\nGround Truth: a\nPrediction:   A\nWER: 1.00, CER: 0.33\n\n"
        "## Case 2\nGround Truth: b\nPrediction:   \nWER: 0.50, CER: 0.26\n\n"
    )
    with_audio = errors.case_text(df, ["run"], audio="noisy_output_path").first().error_cases_text
    assert "CER: 0.26\nAudio File:   y.wav\n\n" in with_audio


def test_critic_request_keeps_marks_inside_cases(spark):
    df = spark.createDataFrame([("en_us", "case {lang} {top_n}")], "lang string, error_cases_text string")
    prompt = errors.critic_requests(df, 5).first().prompt
    assert "the top 5 worst STT failure cases (highest WER/CER) for the language 'en_us'." in prompt
    assert prompt.endswith("# Error Cases:\ncase {lang} {top_n}\n")


def test_critic_rows(spark):
    item = {f: f + "!" for f in CRITIQUE_FIELDS}
    answers = [(1, json.dumps([item, {"error_pattern": "only"}])), (2, "```json\n[]\n```"), (3, "[{broken"), (5, json.dumps(item)), (6, None), (4, "```json\n" + json.dumps([item]) + "\n```")]
    df = spark.createDataFrame(answers, "run long, answer string")
    got = {(r.run, r.critique_no): r for r in errors.critic_rows(df, ["run"]).collect()}
    assert set(got) == {(1, 1), (1, 2), (4, 1)}
    assert got[(1, 1)].affected_cases == "affected_cases!" and got[(1, 2)].affected_cases is None


def test_critique_text(spark):
    df = spark.createDataFrame([(1, 2, "p2", "c2", "r2", "i2"), (1, 1, "p1", None, "r1", "i1")], "run long, critique_no int, " + ", ".join(f"{f} string" for f in CRITIQUE_FIELDS))
    assert errors.critique_text(df, ["run"]).first().critiques_text == (
        "## Critique 1\nError Pattern: p1\nAffected Cases: \nReason for Failure: r1\nGeneralizable Improvement: i1\n\n"
        "## Critique 2\nError Pattern: p2\nAffected Cases: c2\nReason for Failure: r2\nGeneralizable Improvement: i2\n\n"
    )


def critiques(spark, rows, general=False):
    keys = "lang string" if general else "lang string, `group` string, model string, config string, version_label string"
    return spark.createDataFrame(rows, keys + ", critique_no long, " + ", ".join(f"{f} string" for f in CRITIQUE_FIELDS))


def test_critiques_for_runs(spark):
    runs = spark.createDataFrame([(1, "en", "train", "m", "c", "v2"), (2, "en", "train", "m", "d", "v2"), (3, "fr", "train", "m", "c", "v2")], "run_seq long, lang string, `group` string, model string, config string, version_label string")
    text = ("p", "a", "r", "i")
    exact = critiques(spark, [("en", "train", "m", "c", "v2", n, *text) for n in (1, 2)])
    general = critiques(spark, [("en", 7, *text)], general=True)
    got = sorted((r.run_seq, r.critic_source, r.critique_no) for r in errors.critiques_for_runs(runs, exact, general).collect())
    assert got == [(1, "run", 1), (1, "run", 2), (2, "language", 7), (3, "none", None)]


def test_prompt_for_runs(spark):
    runs = spark.createDataFrame([(1, "a.txt"), (2, "b.txt"), (3, "gone.txt"), (4, None), (5, "empty.txt")], "run_seq long, prompt_version string")
    main = spark.createDataFrame([("a.txt", "A"), (K.SHARED_PROMPT, "shared"), ("empty.txt", "")], "prompt_version string, text string")
    modified = spark.createDataFrame([("b.txt", "B"), ("a.txt", "other"), ("empty.txt", "not reached")], "prompt_version string, text string")
    got = {r.run_seq: r.used_prompt for r in errors.prompt_for_runs(runs, main, modified).collect()}
    assert got == {1: "A", 2: "B", 3: "shared", 4: "shared", 5: K.MISSING_PROMPT}
    none = main.where("prompt_version = 'x'")
    assert errors.prompt_for_runs(runs.where("run_seq = 3"), none, none).first().used_prompt == K.MISSING_PROMPT


def test_new_prompts(spark):
    df = spark.createDataFrame([("en", "why\n```prompt\nDo it\n```")], "lang string, answer string")
    r = errors.new_prompts(df, F.lit(4)).first()
    assert (r.prompt_version, r.text, r.report) == ("prompt_v4_en.txt", "Do it", "why\n```prompt\nDo it\n```")


def test_with_answers(spark):
    df = spark.range(5).selectExpr("id", "concat('p', id) prompt")
    got = with_answers(df, lambda prompts: prompts.str.upper())
    assert {(r.id, r.answer) for r in got.collect()} == {(i, f"P{i}") for i in range(5)}


@pytest.fixture(scope="module")
def world(spark):
    """Two languages, two models: jobs, samples and response lines."""
    rows, lines = [], []
    for lang in ("en", "de"):
        for model in ("m1", "m2"):
            for group in ("test", "train"):
                rows.append((lang, group, model, "default", "prompt_v2.txt", f"{lang}-{group}-{model}", "normal", "gs://o", f"/r/{lang}_{group}_{model}.csv"))
    jobs = spark.createDataFrame(rows, "lang string, `group` string, model string, config_name string, prompt_version string, job_id string, kind string, gcs_output_base_uri string, local_output_csv string")
    samples = [(i, f"one two three {i}", f"gs://{lang}/{i}", lang, "test" if i % 2 else "train") for lang in ("en", "de") for i in range(30)]
    for job in rows:
        for i, text, uri, lang, group in samples:
            if (lang, group) == job[:2] and i != 4:
                heard = text if job[2] == "m1" else text.replace("two", "too")
                lines.append((job[5], "f", i, json.dumps({"request": {"contents": [{"parts": [{"fileData": {"fileUri": uri}}]}]}, "response": {"candidates": [{"content": {"parts": [{"text": heard}]}}]}})))
    noisy = spark.createDataFrame(samples, "id long, transcription string, gcs_uri string, lang string, group_name string")
    return jobs, noisy, spark.createDataFrame(lines, "job_id string, file string, seq long, raw string")


def test_evaluate_critic_and_rewrite_end_to_end(spark, world):
    jobs, noisy, lines = world
    done = spark.createDataFrame([("/r/de_test_m2_prompt_v2.csv",)], "local_inference_csv_path string")
    summary = evaluate.run_summary(jobs, done, noisy, None, lines).collect()
    rates = {(r.lang, r.group, r.model): (r.n_scored, r.word_edits, r.ref_words) for r in summary}
    assert len(rates) == 7 and ("de", "test", "m2") not in rates
    assert rates[("en", "test", "m1")] == (15, 0, 60)
    assert rates[("en", "train", "m1")] == (15, 4, 60)  # sample 4 was never answered
    assert rates[("en", "test", "m2")] == (15, 15, 60)

    runs = spark.createDataFrame(pd.DataFrame([r.asDict() for r in summary])).withColumn("run_seq", F.hash("job_id").cast("long"))
    texts = evaluate.scored_texts(evaluate.pending_jobs(jobs, done).withColumnRenamed("config_name", "config"), noisy, None, lines)
    rows = texts.selectExpr("local_inference_csv_path path", "id", "transcription", "prediction")
    requests = improve.critic_request_table(runs, rows, top_n=2).collect()
    assert {(r.lang, r.model) for r in requests} == {(lang, m) for lang in ("en", "de") for m in ("m1", "m2")}
    worst = next(r for r in requests if (r.lang, r.model) == ("en", "m1")).prompt
    assert "## Case 1\nGround Truth: one two three 4\nPrediction:   \nWER: 1.00, CER: 1.00\n" in worst and "## Case 3" not in worst

    text = ("pattern", "Case 1", "why", "fix")
    exact = critiques(spark, [("en", "train", "m1", "default", "prompt_v2", 1, *text)])
    general = critiques(spark, [], general=True)
    main = spark.createDataFrame([("prompt_v2.txt", "Old prompt")], "prompt_version string, text string")
    template = "{args.model}|{used_config}|{used_prompt}|{error_cases_text}|{critiques_text}"
    rewrites = {r.lang: r for r in improve.rewrite_request_table(runs, rows, exact, general, main, main.limit(0), template, 1).collect()}
    assert set(rewrites) == {"en", "de"}
    assert rewrites["en"].analysis_prompt.startswith("m1|default|Old prompt|## Case 1\nGround Truth: one two three 4\n")
    assert "## Critique 1\nError Pattern: pattern\n" in rewrites["en"].analysis_prompt
    assert rewrites["de"].analysis_prompt.endswith("CER: 1.00\n\n|" + K.PROMPT_BLOCK_REQUEST)


def test_stored_scores_serve_summary_and_cases(spark):
    """Scored once, with and without the end mark; joins by path and id do not move the table."""
    from echoscore.operators import scoring
    from echoscore.plans import evaluate

    texts = [("one two three", "one two [EOT]"), ("four", "four"), ("...", "x"), (None, None), ("a b", ""), ("[EOT]", "[EOT]"), ("x y z", "x [EOT] z")]
    rows = [(f"/p{p}", i * 10 + p, r, h) for p in range(3) for i, (r, h) in enumerate(texts)]
    df = spark.createDataFrame(rows, "path string, id long, transcription string, prediction string")
    table = evaluate.stored_scores(df, buckets=4)
    want = {r["id"]: (r["wer"], r["cer"]) for r in scoring.row_rates(df).collect()}
    assert {r["id"]: (r["wer"], r["cer"]) for r in table.collect()} == want
    whole = sorted(map(tuple, scoring.corpus_rates(df, ["path"]).collect()))
    assert sorted(map(tuple, scoring.rates_of_counts(table, ["path"]).collect())) == whole
    runs = spark.createDataFrame([(7, "/p0"), (8, "/p2"), (9, "/none")], "run_seq long, path string")
    plain = errors.worst_cases(df.join(runs, "path"), ["run_seq"], 3)
    columns = ["run_seq", "case_no", "id", "wer", "cer", "prediction"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = errors.worst_stored(table, runs, ["run_seq"], 3)
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, plain.select(*columns).collect()))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one side of the join is dealt to the buckets, the table is read as it lies
    assert "ArrowEvalPython" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    final = plan.split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 1
