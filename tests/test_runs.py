import pytest
from pyspark.sql import functions as F

from echoscore.operators import report, runs

SCHEMA = "run_seq long, lang string, `group` string, model string, config string, prompt_version string, wer string, cer string, local_inference_csv_path string"
V2, V3 = "prompt_v2.txt", "prompt_v3_en.txt"
ROWS = [
    (1, "en", "test", "m1", "a", V2, "0.5", "0.2", "/r/1.csv"),
    (2, "en", "test", "m2", "a", V2, "0.4", "0.2", "/r/2.csv"),
    (3, "en", "test", "m1", "b", V3, "0.4", "0.2", "/r/3.csv"),
    (4, "en", "train", "m2", "a", V2, "0.9", "0.01", "/r/4.csv"),
    (5, "en", "train", "m2", "a", V2, "0.8", "0.02", "/r/5.csv"),
    (6, "de", "test", "m1", "a", None, "0.3", "0.3", "/r/6.csv"),
    (7, "de", "test", "m1", "b", None, "0.1", "n/a", "/r/7.csv"),
    (8, "de", "train", "m1", "a", None, "0.7", "0.7", "/r/8.csv"),
    (9, "fr", "test", "m1", "a", "prompt_v11_fr.txt", "0.2", "NaN", "/r/9.csv"),
    (10, "fr", "test", "m1", "a", "prompt_v11_fr.txt", None, "", "/r/10.csv"),
    (11, "es", "train", "m1", "a", V2, "0.1", "0.1", "/r/11.csv"),
    (12, "en", "silence", "m9", "z", V2, "0.1", "0.2", "/r/12.csv"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def parsed(raw):
    return runs.parse_metrics(raw)


@pytest.fixture(scope="module")
def reported(raw):
    return runs.parse_report_metrics(raw)


def test_latest_run(parsed):
    got = {r.run_seq for r in runs.latest_run(parsed).collect()}
    assert got == {1, 2, 3, 5, 6, 7, 8, 10, 11, 12}
    assert {(r.run_seq, r.version_label) for r in runs.training_runs(parsed).collect()} == {(5, "prompt_v2"), (8, "default"), (11, "prompt_v2")}


def test_best_run_prefers_test_and_puts_missing_scores_last(parsed):
    got = {r.lang: r.run_seq for r in runs.best_run_per_lang(parsed).collect()}
    # en: tie on cer and wer -> the older run; de: the unparsable cer loses; fr: no usable cer, then wer
    assert got == {"en": 2, "de": 6, "fr": 9}


def test_best_run_without_any_test_run(parsed):
    got = {r.lang: r.run_seq for r in runs.best_run_per_lang(parsed.where("`group` <> 'test'")).collect()}
    assert got == {"en": 4, "de": 8, "es": 11}


def test_best_run_per_group_lang(reported):
    got = {(r.group, r.lang): r.run_seq for r in runs.best_run_per_group_lang(reported).collect()}
    assert got[("test", "en")] == 1 and got[("test", "de")] == 7 and got[("train", "en")] == 4


def test_best_report_lang_ties_go_first_and_view_ties_go_last(reported):
    assert {r.lang: r.run_seq for r in runs.best_report_lang(reported).collect()}["en"] == 12  # silence sorts before test
    view = runs.in_view(reported, "en", "test")
    assert runs.best_view_setting(view).first().run_seq == 2  # m2 is the last of the tied settings
    assert {(r.lang, r.group): r.run_seq for r in runs.best_view_setting(reported, ["lang", "group"]).collect()}[("en", "test")] == 2
    assert runs.best_view_setting(runs.in_view(reported, "xx")).first().run_seq is None


def test_view_filter(reported):
    assert runs.in_view(reported).count() == len(ROWS)
    assert runs.in_view(reported, lang="en").count() == 6
    assert runs.in_view(reported, group="test", lang="fr").count() == 2


def test_next_version(parsed):
    best = runs.best_run_per_lang(parsed)
    assert runs.next_version(best).first().next_version == 12
    assert runs.next_version(best, 40).first().next_version == 40
    assert runs.next_version(best.where("lang = 'de'")).first().next_version == 1


def test_train_run_of_best(parsed):
    got = runs.train_run_of_best(runs.best_run_per_lang(parsed), parsed)
    assert {(r.lang, r.best_run_seq, r.train_run_seq) for r in got.collect()} == {("en", 2, 5), ("de", 6, 8)}


def test_pending_jobs(spark):
    jobs = spark.createDataFrame(
        [(1, "gs://o/1", "/r/a.csv", V2), (2, "gs://o/2", "/r/b_prompt_v2.csv", V2), (3, None, "/r/c.csv", V2), (4, "gs://o/4", None, V2),
         (5, "gs://o/5", "/r/d.csv", None), (6, "", "/r/e.csv", V2)],
        "id long, gcs_output_base_uri string, local_output_csv string, prompt_version string",
    )
    done = spark.createDataFrame([("/r/b_prompt_v2.csv",), (None,)], "local_inference_csv_path string")
    got = {r.id: r.local_inference_csv_path for r in runs.pending_jobs(jobs, done).collect()}
    assert got == {1: "/r/a_prompt_v2.csv", 5: "/r/d.csv"}


def test_summary_sorted(reported):
    got = [r.run_seq for r in report.summary_sorted(reported).collect()]
    expected = sorted(ROWS, key=lambda x: tuple(c or "" for c in x[1:6]) + (x[0],))
    assert got == [x[0] for x in expected]


def test_sorted_by_number_or_text(spark):
    df = spark.createDataFrame([("10%",), ("9.5%",), ("b",), ("A",), (None,)], "v string")
    assert [r.v for r in report.sorted_by(df, "v").collect()] == ["9.5%", "10%", "A", "b", None]
    assert [r.v for r in report.sorted_by(df, "v", True).collect()][:2] == ["10%", "9.5%"]


def test_dimensions(reported):
    got = {(r.dim, r.value) for r in report.dimensions(reported).collect()}
    assert got == {("lang", x) for x in ("en", "de", "fr", "es")} | {("group", x) for x in ("test", "train", "silence")}


def test_chart(reported):
    got = {r.label: r for r in report.chart(reported, group="train").collect()}
    bar = got["m2 (a) [prompt_v2.txt] [en]"]
    assert (bar.avg_wer, bar.avg_cer, bar.best_wer, bar.best_cer) == (85.0, 1.5, False, True)
    assert got["m1 (a) [prompt_v2.txt] [es]"].best_wer is True
    assert "m1 (a) [default] [de]" in got and len(got) == 3
    assert {r.label for r in report.chart(reported, "en", "train").collect()} == {"m2 (a) [prompt_v2.txt]"}
    assert any(r.label.endswith("[en] [silence]") for r in report.chart(reported).collect())


def test_chart_means_are_exact(spark):
    wers = [0.1, 0.2, 0.3, 0.05, 0.005, 0.105, 0.24] * 3 + [float("nan")]
    rows = [(i, "en", "test", "m" if w == w else "nan", "c", None, w, w, "") for i, w in enumerate(wers)]
    df = spark.createDataFrame(rows, SCHEMA.replace("wer string, cer string", "wer double, cer double"))
    for parts in (1, 5):
        got = {r.model: r.avg_wer for r in report.chart(df.repartition(parts)).collect()}
        assert got["m"] == 14.29 and got["nan"] != got["nan"]


def test_flags_mark_all_ties(reported):
    got = {r.run_seq: (r.best_wer, r.best_cer) for r in report.best_flags(reported, ["lang", "group"]).collect()}
    assert [i for i in (1, 2, 3) if got[i][1]] == [1, 2, 3]
    assert [i for i in (1, 2, 3) if got[i][0]] == [2, 3]
    assert got[7] == (True, True) and got[6] == (False, False)


def test_locate_results(spark):
    r = spark.createDataFrame([(1, "/r/a.csv"), (2, "/r/b.csv"), (3, "/r/c.csv")], "run_seq long, local_inference_csv_path string")
    files = spark.createDataFrame([("/r/a.csv",)], "path string")
    alt = spark.createDataFrame([("/alt/a.csv",), ("/alt/b.csv",)], "path string")
    got = {x.run_seq: x.result_path for x in report.locate_results(r, files, alt).collect()}
    assert got == {1: "/r/a.csv", 2: "/alt/b.csv", 3: None}
    relative = r.withColumn("local_inference_csv_path", F.expr("substring(local_inference_csv_path, 4)"))
    moved = report.locate_results(relative, files, alt, base="/r")
    assert {x.run_seq: x.result_path for x in moved.collect()} == got


def test_detail_cuts_before_it_drops_blank_references(spark):
    best = spark.createDataFrame([("en", "test", "/r/a.csv"), ("de", "test", None)], "lang string, `group` string, result_path string")
    rows = spark.createDataFrame(
        [("/r/a.csv", i, "..." if i % 5 == 0 else f"word {i}", f"word {i} [EOT]") for i in range(40)] + [("/r/other.csv", 1, "x", "x")],
        "result_path string, id long, transcription string, prediction string",
    )
    got = report.detail(best, rows).orderBy("id").collect()
    assert [r.id for r in got] == [i for i in range(20) if i % 5]
    assert all((r.wer, r.cer, r.lang, r.group) == (0.0, 0.0, "en", "test") for r in got)
    assert got[0].prediction == "word 1" and got[0].row_no == 2


def test_prompt_listing(spark):
    p = spark.createDataFrame([("b.txt", "<x>"), ("a.txt", "&")], "prompt_version string, text string")
    assert [(r.name, r.html) for r in report.prompt_listing(p).collect()] == [("a.txt", "&amp;"), ("b.txt", "&lt;x&gt;")]
