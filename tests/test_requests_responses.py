import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoscore import constants as K
from echoscore.functions import responses as R
from echoscore.operators import requests, responses
from echoscore.plans import prepare


def answer_line(key, text, uri=None):
    line = {"key": key, "response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}}
    if uri is not None:
        line["request"] = {"contents": [{"role": "user", "parts": [{"fileData": {"mimeType": "audio/wav", "fileUri": uri}}, {"text": "p"}]}]}
    return json.dumps(line)


def test_job_grid(spark):
    langs = requests.prompt_for_language(spark.createDataFrame([("en",), ("de",)], "lang string"), "v3")
    grid = requests.job_grid(langs, ["test", "silence"], ["m1", "m2", "m3"], "b", "/res/").collect()
    assert len(grid) == 2 * 2 * 3 * 3 and len({g.job_id for g in grid}) == len(grid)
    g = next(g for g in grid if (g.lang, g.group, g.model, g.config_name) == ("en", "test", "m2", "temperature"))
    assert g.job_id == "test_en_m2-temperature_prompt_v3_en"
    assert g.request_file == "test_en_m2-temperature_prompt_v3_en_requests.jsonl"
    assert g.gcs_input_uri == "gs://b/batch_input/test_en/" + g.request_file
    assert g.gcs_output_base_uri == "gs://b/batch_output/test_en_m2-temperature_prompt_v3_en"
    assert g.local_output_csv == "/res/evaluation_test_en_m2-temperature_prompt_v3_en.csv"
    assert g.generation_config.asDict() == {"audio_timestamp": True, "temperature": 0.2, "topK": None, "topP": None}
    s = next(g for g in grid if (g.lang, g.group, g.model, g.config_name) == ("en", "silence", "m2", "temperature"))
    assert s.generation_config.asDict() == {"audio_timestamp": True, "temperature": None, "topK": 1, "topP": 0.1}
    assert s.request_file.endswith("_silence_requests.jsonl") and "/batch_output_silence/" in s.gcs_output_base_uri
    assert s.local_output_csv.endswith("_silence.csv") and s.submitted_at is not None
    assert all(g.generation_config is None for g in grid if g.config_name == "default")
    assert requests.prompt_for_language(langs, None).first().prompt_version == K.SHARED_PROMPT


def test_default_grid_and_job_records(spark, tmp_path):
    from echoscore.sources import readers, sinks

    langs = requests.prompt_for_language(requests.languages(spark), "v3")
    grid = requests.job_grid(langs, ["test"], ["m1", "m2", "m3"], "b", "/r", submitted_at=F.lit("2026-01-02 03:04:05.5").cast("timestamp"))
    assert grid.count() == 81
    accepted = grid.where("lang <> 'el_gr'").selectExpr("job_id", "concat('jobs/', job_id) job_name")
    sinks.json(requests.job_records(grid, accepted), f"{tmp_path}/log")
    back = readers.job_logs(spark, f"{tmp_path}/log", arrays=False)
    assert back.count() == 72
    r = back.where("lang = 'ja_jp' and model = 'm1' and config_name = 'default'").first()
    assert (r.job_name, r.kind, r.splitter) == ("jobs/test_ja_jp_m1-default_prompt_v3_ja_jp", "normal", "test_ja_jp")
    assert str(r.submitted_at) == "2026-01-02 03:04:05.500000"


def test_prompt_text_and_missing_prompt(spark):
    jobs = spark.createDataFrame([("en", "prompt_v2.txt")], "lang string, prompt_version string")
    prompts = spark.createDataFrame([("prompt_v2.txt", "Say {language_code} {not this}")], "prompt_version string, text string")
    assert requests.with_prompt_text(jobs, prompts).first().prompt_text == "Say en {not this}"
    with pytest.raises(Exception, match="prompt not found"):
        requests.with_prompt_text(jobs.withColumn("prompt_version", F.lit("gone.txt")), prompts).collect()


def test_fan_out(spark):
    jobs = spark.createDataFrame(
        [("j1", "en", "test", "normal"), ("j2", "en", "train", "normal"), ("j3", "en", "silence", "silence"), ("j4", "de", "test", "normal")],
        "job_id string, lang string, `group` string, kind string",
    )
    noisy = spark.createDataFrame([(1, "en", "test"), (2, "en", "train"), (3, "en", "test"), (9, "fr", "test")], "id long, lang string, group_name string")
    silence = spark.createDataFrame([(1, "en"), (5, "en"), (6, "de")], "id long, lang string")
    got = {(r.job_id, r.id) for r in requests.fan_out(jobs, noisy, silence, ["id"]).collect()}
    assert got == {("j1", 1), ("j1", 3), ("j2", 2), ("j3", 1), ("j3", 5)}
    assert requests.fan_out(jobs, noisy, None, ["id"]).count() == 3


def test_request_lines(spark):
    langs = requests.prompt_for_language(spark.createDataFrame([("en",)], "lang string"), None)
    grid = requests.job_grid(langs, ["test"], ["m"], "b", "/r").withColumn("prompt_text", F.lit('Ünï "q" {x}\n'))
    noisy = spark.createDataFrame([(1, 7, "en", "test", "gs://b/1.wav"), (2, 8, "en", "test", None)], "id long, idx long, lang string, group_name string, gcs_uri string")
    lines = requests.inference_requests(requests.fan_out(grid, noisy, None, ["id", "idx", "gcs_uri"])).collect()
    assert len(lines) == 3
    for line in lines:
        body = json.loads(line.line)
        assert body["key"] == line.key == "req-7-prompt_v2"
        content = body["request"]["contents"]
        assert content == [{"role": "user", "parts": [{"fileData": {"mimeType": "audio/wav", "fileUri": "gs://b/1.wav"}}, {"text": 'Ünï "q" {x}\n'}]}]
        config = body["request"].get("generationConfig")
        name = line.job_id.split("-")[1].split("_prompt")[0].removesuffix("_prompt_v2")
        expected = {"default": None, "temperature": {"audio_timestamp": True, "temperature": 0.2}, "audio_ts_true": {"audio_timestamp": True, "topK": 1, "topP": 0.1}}
        assert config == expected[name]


def test_config_conflicts(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", None), ("c", None)], "config_name string, params string")
    assert [tuple(r) for r in requests.config_conflicts(df).collect()] == [("b", 2)]


def test_parse_responses(spark):
    lines = [
        ("f1", 1, answer_line("k", "first", "u1")),
        ("f1", 2, answer_line("k", "zweite ü 世", "u1")),
        ("f1", 3, ""),
        ("f1", 4, "   "),
        ("f1", 5, '{"key": "broken'),
        ("f1", 6, json.dumps({"key": "k", "request": {"contents": [{"parts": [{"fileData": {"fileUri": "u2"}}]}]}})),
        ("f1", 7, json.dumps({"key": "k", "request": {"contents": [{"parts": [{"fileData": {"fileUri": "u3"}}]}]}, "response": {"candidates": []}})),
        ("f1", 8, json.dumps({"key": "k", "request": {"contents": [{"parts": [{"fileData": {"fileUri": ""}}]}]}})),
        ("f1", 9, answer_line("k", "no uri")),
        ("f1", 10, json.dumps({"request": {"contents": [{"parts": []}]}})),
        ("f2", 1, answer_line("k", "", "u4")),
        ("f1", 11, answer_line("k", "early", "u4")),
    ]
    df = spark.createDataFrame(lines, "file string, seq int, raw string")
    parsed = responses.parse_responses(df, keep=("file", "seq"))
    latest = responses.latest_predictions(parsed, ["gcs_uri"], F.col("file"), F.col("seq"))
    assert {r.gcs_uri: r.prediction for r in latest.collect()} == {"u1": "zweite ü 世", "u2": "", "u3": "", "u4": ""}
    assert [r.seq for r in responses.malformed(df).collect()] == [5]


def test_join_predictions(spark):
    s = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, None)], "id long, gcs_uri string")
    p = spark.createDataFrame([("u1", "hi"), ("u9", "lost")], "gcs_uri string, prediction string")
    got = {r.id: r.prediction for r in responses.join_predictions(s, p).collect()}
    assert got == {1: "hi", 2: "", 3: ""}


def test_chunk_prompts_and_requests(spark):
    df = spark.createDataFrame([(0, 1, "b"), (0, 0, "a"), (1, 0, None)], "chunk_idx long, pos int, transcription string")
    prompts = requests.chunk_prompts(df).orderBy("chunk_idx")
    got = [r.prompt for r in prompts.collect()]
    assert got == [K.CLASSIFY_PROMPT + "[0] a\n[1] b\n", K.CLASSIFY_PROMPT + "[0] \n"]
    line = json.loads(requests.classify_requests(prompts).where("chunk_idx = 1").first().line)
    assert line == {
        "key": "req-1",
        "request": {"contents": [{"role": "user", "parts": [{"text": got[1]}]}], "generationConfig": {"response_mime_type": "application/json"}},
    }


@pytest.mark.parametrize(
    "text, expected",
    [
        ("[true, false]", [True, False]), ("```json\n[true]\n```", [True]), ("```\n[false]\n```", [False]), ("[true", []),
        ('{"a": true}', []), ("", []), ('[true, "true", 1, null, false]', [True, False, False, False, False]), ("[]", []),
    ],
)
def test_boolean_list(one, text, expected):
    assert one(R.boolean_list(F.col("t")), t=text) == expected


@pytest.mark.parametrize("key, expected", [("req-12", 12), ("req-3-slug-x", 3), ("req-x", None), ("other-3", None), (None, None), ("req-", None)])
def test_chunk_number(one, key, expected):
    assert one(R.chunk_number(F.col("k").cast("string")), k=key) == expected


def labelled(spark, n, lines):
    samples = spark.createDataFrame([(i, f"t{i}", "f", "en", "dev") for i in range(n)], "id long, transcription string, file_path string, lang string, `group` string")
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, seq int, raw string")
    return samples, df


def test_labels_come_back_to_their_samples(spark):
    flags = [i % 3 == 0 for i in range(130)]
    lines = [
        answer_line("req-0", "[true"),
        answer_line("req-0", json.dumps(flags[:50])),
        answer_line("req-1", "```json\n" + json.dumps(flags[50:90]) + "\n```"),  # ten short
        answer_line("req-2", json.dumps(flags[100:] + [True] * 9)),  # nine too many
        answer_line("other", "[true]"),
        json.dumps({"key": "req-0", "response": {"candidates": []}}),  # no answer: does not replace the one above
        "",
        "not json",
    ]
    samples, df = labelled(spark, 130, lines)
    got = {r.id: r.medical_yn for r in prepare.labelled_from_lines(samples, df).collect()}
    assert got == {i: flags[i] if not 90 <= i < 100 else False for i in range(130)}


def test_chunk_shortfalls(spark):
    samples, df = labelled(spark, 120, [answer_line("req-0", json.dumps([True] * 50)), answer_line("req-1", "[]")])
    from echoscore.operators.indexing import chunked, sample_index

    labels = responses.parse_chunk_labels(df, F.col("seq"))
    got = {r.chunk_idx: (r.n, r.n_labels) for r in responses.chunk_shortfalls(chunked(sample_index(samples)), labels).collect()}
    assert got == {1: (50, 0), 2: (20, 0)}


def test_labelling_with_a_model(spark):
    samples, _ = labelled(spark, 70, [])

    def predict(prompts: pd.Series) -> pd.Series:
        def flags(prompt):
            lines = prompt.split("Transcriptions:\n")[1].splitlines()
            return json.dumps([x.endswith("7") for x in lines])

        return prompts.map(flags)

    got = prepare.labelled_by(samples, predict)
    assert {r.id for r in got.where("medical_yn").collect()} == {7, 17, 27, 37, 47, 57, 67}
    assert prepare.label_requests(samples).count() == 2
