"""Rows whose keys are NULL, clips that cannot be mixed, jobs logged twice."""

import math

import pytest
from pyspark.sql import functions as F

from echoscore.functions import audio as A
from echoscore.operators import errors, indexing, ranking, report, runs, samples, sync


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_row_gets_a_number(spark):
    rows = [("en", "a", 5), (None, "a", 1), ("en", None, 2), ("en", "a", None), (None, None, None), ("en", "a", 1 << 40)]
    df = spark.createDataFrame(rows, "lang string, `group` string, id long")
    got = indexing.sample_index(df)
    assert sorted(r["idx"] for r in got.collect()) == list(range(6)) and rows_of(got.select("lang", "group", "id")) == sorted(rows, key=str)
    only = df.where("lang is null")
    some = indexing.sample_index(df, only=only, only_on=["lang", "group", "id"])
    assert rows_of(some) == rows_of(got.where("lang is null"))


def test_winners_with_null_keys_fetch_their_rows(spark):
    rows = [(None, 1, "a b", "a c"), (None, 2, "a b", "a b"), ("p", 1, "x", "y"), ("p", None, "x y", "x")]
    df = spark.createDataFrame(rows, "prompt_version string, id long, transcription string, prediction string")
    cases = errors.worst_cases(df, ["prompt_version"], 2)
    assert cases.count() == 4 and cases.where("prompt_version is null").count() == 2
    wide = ranking.top_n_wide(df, ["prompt_version"], ["id"], [F.col("id")], 1, ["prompt_version", "id"])
    assert {(r["prompt_version"], r["id"]) for r in wide.collect()} == {(None, 1), ("p", None)}


def test_samples_without_a_group_are_planned(spark):
    df = spark.createDataFrame([(1, "t", "en", None, True), (2, "u", "en", "dev", True)], "id long, transcription string, lang string, `group` string, medical_yn boolean")
    assert sorted(r["id"] for r in samples.silence_plan(df, "/out").collect()) == [1, 2]


def test_flags_and_labels_without_a_group(spark):
    rows = [("en", None, "m", "c", None, 0.5, 0.1), ("en", "test", "m", "c", "p", 0.4, 0.2)]
    df = spark.createDataFrame(rows, "lang string, `group` string, model string, config string, prompt_version string, wer double, cer double")
    got = report.best_flags(df, ["lang", "group"])
    assert got.count() == 2 and all(r["best_wer"] and r["best_cer"] for r in got.collect())
    assert {r["label"] for r in report.chart(df).collect()} == {"m (c) [default] [en] []", "m (c) [p] [en] [test]"}


@pytest.mark.parametrize("values, mean", [([math.inf, 0.3], math.inf), ([0.1, 0.2], 15.0), ([math.nan, 0.1], math.nan), ([1e20, 1e20], 1e22)])
def test_mean_of_any_doubles(spark, values, mean):
    df = spark.createDataFrame([("en", "test", "m", "c", "p", v, v) for v in values], "lang string, `group` string, model string, config string, prompt_version string, wer double, cer double")
    assert report.chart(df).first()["avg_wer"] == pytest.approx(mean, nan_ok=True)


@pytest.mark.parametrize("noise", [[0.0, 0.0], [], [math.nan, 0.5], [math.inf], None])
def test_unusable_noise_is_not_mixed(spark, noise):
    df = spark.createDataFrame([([0.5, -0.5], noise)], "main array<float>, noise array<float>")
    gain = A.noise_gain(F.col("main"), F.col("noise"))
    assert df.select(A.mix(F.col("main"), F.col("noise"), gain)).first()[0] is None
    clips = spark.createDataFrame([("bad", noise), ("good", [0.1])], "noise_id string, samples array<float>")
    picked = samples.pick_noise(spark.createDataFrame([("en", "dev", i) for i in range(20)], "lang string, `group` string, id long"), clips)
    assert {r["noise_id"] for r in picked.collect()} == {"good"}


def test_noise_is_drawn_per_row(spark):
    rows = spark.createDataFrame([(lang, "dev", 7) for lang in "abcdefghij"], "lang string, `group` string, id long")
    clips = spark.createDataFrame([(f"n{i}", [0.1]) for i in range(50)], "noise_id string, samples array<float>")
    assert len({r["noise_id"] for r in samples.pick_noise(rows, clips).collect()}) > 3


def test_a_missing_path_is_not_another_clip(spark):
    manifest = spark.createDataFrame([("/n/1.wav", "/c/1.wav", "dev", "en"), (None, "/c/2.wav", "dev", "en")], "noisy_output_path string, file_path string, `group` string, lang string")
    local = spark.createDataFrame([("/n/1.wav",), ("/c/2.wav",)], "path string")
    stored = local.limit(0)
    got = sync.sync_plan(manifest, stored, local, "b", "p")
    assert {(r["status"], r["gcs_uri"]) for r in got.collect()} == {("upload", "gs://b/p/dev_en/1.wav"), ("no_path", None)}
    plain = sync.sync_plan(manifest.drop("noisy_output_path"), stored, local, "b", "p")
    assert {r["status"] for r in plain.collect()} == {"missing", "upload"}


def test_a_result_path_counts_for_its_first_job(spark):
    logged = [("j2", "f2", 0), ("j1", "f1", 9), ("j3", "f1", 3)]
    jobs = spark.createDataFrame([(j, f, r, "gs://o", "/r/x.csv", None) for j, f, r in logged], "job_name string, log_file string, log_row long, gcs_output_base_uri string, local_output_csv string, prompt_version string")
    done = spark.createDataFrame([], "local_inference_csv_path string")
    assert [r["job_name"] for r in runs.pending_jobs(jobs, done).collect()] == ["j3"]
