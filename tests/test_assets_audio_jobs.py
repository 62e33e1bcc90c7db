import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from echoscore.functions import audio as A
from echoscore.operators import assets, jobs, samples


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, '<a src="/x/a%20b.wav"></a><a src=""></a><b src="/x/a%20b.wav"/>tail'),
        (2, '<a src="/gone.wav">'),
        (3, "no links"),
        (4, 'src="/y/%E4%B8%96.wav"'),
        (5, None),
    ]
    return spark.createDataFrame(rows, "page_id long, html string")


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([("/x/a b.wav",), ("/x/a b.wav",), ("/y/世.wav",), ("/unused",)], "path string")


def test_asset_links(pages):
    got = [(r.page_id, r.pos, r.path) for r in assets.asset_links(pages).orderBy("page_id", "pos").collect()]
    assert got == [(1, 0, "/x/a b.wav"), (1, 1, ""), (1, 2, "/x/a b.wav"), (2, 0, "/gone.wav"), (4, 0, "/y/世.wav")]


def test_asset_manifest(pages, known):
    got = {(r.path, r.new_link, r.n_links) for r in assets.asset_manifest(pages, known).collect()}
    assert got == {("/x/a b.wav", "audio/a%20b.wav", 2), ("/y/世.wav", "audio/%E4%B8%96.wav", 1)}


def test_rewrite_pages(pages, known):
    got = {r.page_id: r.html for r in assets.rewrite_pages(pages, known).collect()}
    assert got == {
        1: '<a src="audio/a%20b.wav"></a><a src=""></a><b src="audio/a%20b.wav"/>tail',
        2: '<a src="/gone.wav">', 3: "no links", 4: 'src="audio/%E4%B8%96.wav"', 5: None,
    }


# --- audio ----------------------------------------------------------------------------------


def clip(*xs):
    return F.array(*[F.lit(float(x)).cast("float") for x in xs]).cast("array<float>")


def test_level(one):
    assert math.isclose(one(A.dbfs(clip(0.5, -0.5, 0.5))), 20 * math.log10(0.5))
    assert one(A.dbfs(clip(0, 0))) is None
    assert one(A.dbfs(clip())) is None


def test_usable(one):
    assert one(A.usable(clip(0.1, 0))) is True
    assert [one(A.usable(c)) for c in (clip(), clip(0, 0), clip(0.1, float("nan")), clip(float("inf")))] == [False] * 4
    assert one(A.usable(F.lit(None).cast("array<float>"))) is False


def test_gain(one):
    main, noise = clip(0.4, -0.4), clip(0.1, -0.1, 0.1)
    assert math.isclose(one(A.noise_gain(main, noise, 0.3)), 1.2, rel_tol=1e-6)
    assert math.isclose(one(A.noise_gain(main, noise, 0)), 4 * 10 ** (-100 / 20), rel_tol=1e-6)
    assert one(A.noise_gain(main, clip(0, 0))) is None


def test_mix_loops_and_saturates(one):
    got = one(A.mix(clip(0.5, 0.5, 0.5, -0.9, 0.9), clip(0.1, -0.2), F.lit(2.0)))
    assert [round(x, 5) for x in got] == [0.7, 0.1, 0.7, -1.0, 1.0]
    longer = one(A.mix(clip(0.5), clip(0.1, 0.9), F.lit(1.0)))
    assert [round(x, 5) for x in longer] == [0.6]


def test_insert_silence(one):
    main = clip(1, 0.5, 0.25)
    assert one(A.insert_silence(main, 2, F.lit("front"))) == [0, 0, 1, 0.5, 0.25]
    assert one(A.insert_silence(main, 2, F.lit("middle"))) == [1, 0, 0, 0.5, 0.25]
    assert one(A.insert_silence(main, 2, F.lit("back"))) == [1, 0.5, 0.25, 0, 0]
    assert one(A.insert_silence(clip(), 1, F.lit("middle"))) == [0]
    with pytest.raises(Exception, match="unknown position: top"):
        one(A.insert_silence(main, 2, F.lit("top")))


def test_failing_clips_are_replaced_by_later_ones(spark):
    rows = [(i, "en", "dev", True, [] if i == 0 else [0.0] if i == 2 else [0.5]) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, lang string, `group` string, medical_yn boolean, clip array<float>")
    noise = spark.createDataFrame([("n",)], "noise_id string")
    plan = samples.noise_plan(df, noise, "/o", per_lang=3, train_per_lang=2, valid=A.usable(F.col("clip")))
    got = [(r.id, r.idx, r["rank"], r.group_name) for r in plan.orderBy("id").collect()]
    assert got == [(1, 1, 0, "train"), (3, 3, 1, "train"), (4, 4, 2, "test")]


# --- jobs -----------------------------------------------------------------------------------

T0 = dt.datetime(2026, 1, 1)


def test_job_status(spark):
    rows = [
        ("a", "JobState.JOB_STATE_PENDING", T0, 1), ("a", "JobState.JOB_STATE_SUCCEEDED", T0, 2), ("b", "JOB_STATE_RUNNING", T0, 3),
        ("c", "job_state_queued", T0, 4), ("d", "JOB_STATE_PARTIALLY_SUCCEEDED", T0, 5), ("e", "JOB_STATE_UNSPECIFIED", T0, 6),
    ]
    df = spark.createDataFrame(rows, "job_name string, state string, ts timestamp, seq int")
    latest = jobs.latest_status(df, F.col("ts"), F.col("seq"))
    got = {r.job_name: (r.state, r.is_active, r.is_terminal) for r in latest.collect()}
    assert got == {
        "a": ("JOB_STATE_SUCCEEDED", False, True), "b": ("JOB_STATE_RUNNING", True, False), "c": ("JOB_STATE_QUEUED", True, False),
        "d": ("JOB_STATE_PARTIALLY_SUCCEEDED", False, True), "e": ("JOB_STATE_UNSPECIFIED", False, False),
    }
    assert sum(r.n_jobs for r in jobs.status_counts(latest).where("is_active").collect()) == 2


def test_newest_log_and_distinct_names(spark):
    logs = spark.createDataFrame([(T0, "f1", "j1"), (T0 + dt.timedelta(1), "f2", "j2"), (T0 + dt.timedelta(1), "f2", None)], "log_time timestamp, log_file string, job_name string")
    assert [r.job_name for r in jobs.newest_log_jobs(logs).collect()] == ["j2"]
    assert sorted(r.job_name for r in jobs.distinct_jobs(logs.where("job_name is not null"), logs.where("job_name = 'j2'")).collect()) == ["j1", "j2"]


def test_run_progress(spark):
    sent = spark.createDataFrame([("a", "u1"), ("a", "u2"), ("a", "u2"), ("a", None), ("b", "u1"), ("c", "u1"), ("d", None)], "job_id string, gcs_uri string")
    got = spark.createDataFrame([("a", "u1"), ("a", "u1"), ("b", "u1")], "job_id string, gcs_uri string")
    assert {tuple(r) for r in jobs.run_progress(sent, got).collect()} == {("a", 2, 1, False), ("b", 1, 1, True), ("c", 1, 0, False), ("d", 0, 0, True)}
