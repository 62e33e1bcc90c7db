"""Chart views by grouping sets, remembered answers, NULL settings."""

import pandas as pd
import pytest

from echoscore.operators import errors, report, runs
from echoscore.plans import prepare
from echoscore.plans.predict import with_remembered_answers


def test_each_view_is_the_chart_of_its_filter(spark):
    rows = [
        (1, "de", "test", "m", "c", "p.txt", 0.5, 0.2), (2, "de", "test", "m", "c", "p.txt", 0.3, 0.4), (3, "de", "train", "m", "d", None, 0.1, 0.9),
        (4, "fr", "test", "n", "c", "", 0.2, 0.1), (5, None, "test", "n", None, "q.txt", 0.2, float("nan")), (6, "fr", None, None, "c", "q.txt", 0.7, 0.3),
    ]
    df = spark.createDataFrame(rows, "run_seq long, lang string, `group` string, model string, config string, prompt_version string, wer double, cer double")
    got = [r.asDict() for r in report.chart_views(df).collect()]
    for lang, group in (("all", "all"), ("de", "all"), ("all", "test"), ("fr", "test"), ("de", "train")):
        view = [{k: v for k, v in r.items() if not k.startswith("view_")} for r in got if (r["view_lang"], r["view_group"]) == (lang, group)]
        want = [r.asDict() for r in report.chart(df, lang, group).collect()]
        assert sorted(map(repr, view)) == sorted(map(repr, want)) and view
    # the missing language and group are views of their own, not the ones over all
    assert len([r for r in got if r["view_lang"] == ""]) == 2 and len(got) == 4 * 5


def test_only_new_prompts_are_asked(spark, tmp_path):
    log, memory = tmp_path / "asked", f"{tmp_path}/memory"
    log.mkdir()

    def model(prompts: pd.Series) -> pd.Series:
        for p in prompts:
            (log / f"{p}-{len(list(log.iterdir()))}").write_text(p)
        return prompts + "!"

    def ask(values, run):
        df = spark.createDataFrame([(i, v, "old") for i, v in enumerate(values)], "id long, prompt string, answer string")
        found = with_remembered_answers(df.repartition(1), model, memory, run)
        assert sorted(found.columns) == ["answer", "asked_in", "id", "prompt"]
        return [(r["answer"], r["asked_in"]) for r in found.orderBy("id").collect()]

    assert ask(["a", "b", "a", None], "one") == [("a!", "one"), ("b!", "one"), ("a!", "one"), (None, None)]
    assert ask(["b", "c"], "two") == [("b!", "one"), ("c!", "two")]
    assert ask(["c", "a"], "three") == [("c!", "two"), ("a!", "one")]
    assert ask([], "four") == []
    assert sorted(p.read_text() for p in log.iterdir()) == ["a", "b", "c"]


def test_labelling_remembers(spark, tmp_path):
    samples = spark.createDataFrame([(i, f"text {i}", "de", "test") for i in range(60)], "id long, transcription string, lang string, `group` string")

    def yes(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda _: "[" + ", ".join(["true"] * 50) + "]")

    def refuse(prompts: pd.Series) -> pd.Series:
        assert not len(prompts), "asked again"
        return prompts

    first = sorted(map(tuple, prepare.labelled_by(samples, yes, f"{tmp_path}/memory").collect()))
    assert sorted(map(tuple, prepare.labelled_by(samples, refuse, f"{tmp_path}/memory").collect())) == first and all(r[-1] for r in first)


def test_null_settings_find_their_runs_and_critiques(spark):
    schema = "run_seq long, lang string, `group` string, model string, config string, prompt_version string, wer double, cer double, local_inference_csv_path string"
    table = spark.createDataFrame([
        (1, None, "test", "m", None, None, 0.1, 0.1, "/a"), (2, None, "train", "m", None, None, 0.2, 0.2, "/b"), (3, "de", "test", "m", None, "p", 0.1, 0.1, "/c"),
        (4, "de", "train", "m", "x", "p", 0.1, 0.1, "/d"),
    ], schema)
    found = runs.train_run_of_best(runs.best_run_per_lang(table), table).collect()
    assert [(r["best_run_seq"], r["train_run_seq"], r["local_inference_csv_path"]) for r in found] == [(1, 2, "/b")]
    train = runs.training_runs(table)
    critique = "critique_no long, error_pattern string, affected_cases string, reason_for_failure string, generalizable_improvement string"
    exact = train.where("lang is null").select("lang", "group", "model", "config", "version_label").crossJoin(spark.createDataFrame([(1, "own", "", "", "")], critique))
    general = spark.createDataFrame([("de", 1, "general", "", "", ""), (None, 2, "of none", "", "", "")], f"lang string, {critique}")
    assert {r["run_seq"]: (r["critic_source"], r["error_pattern"]) for r in errors.critiques_for_runs(train, exact, general).collect()} == {2: ("run", "own"), 4: ("language", "general")}
    nothing = exact.where("false")
    assert {r["run_seq"]: r["error_pattern"] for r in errors.critiques_for_runs(train, nothing, general).collect()} == {2: "of none", 4: "general"}
