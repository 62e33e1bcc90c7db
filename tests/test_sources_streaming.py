import json
import os

import pytest
from pyspark.sql import functions as F

from echoscore.operators import samples
from echoscore.operators.indexing import range_index
from echoscore.session import shared_folder
from echoscore.sources import readers, schemas, sinks
from echoscore.sources.stage import drop_staged, staged
from echoscore.streaming import scoring as streaming


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_corpus_scan(spark, tmp_path):
    for lang in ("en_us", "ja_jp"):
        for split in ("dev", "test", "train"):
            rows = [f'{i}\t{i}_{k}.wav\traw\ttext "{lang} {k}\tw\t100\tMALE' for i in (7, 5) for k in (0, 1)]
            write(f"{tmp_path}/{lang}/{split}.tsv", "\n".join(rows) + "\n")
    raw = readers.corpus(spark, readers.corpus_paths(f"{tmp_path}/", ["en_us", "ja_jp"]))
    assert raw.count() == 24 and raw.select("lang", "group").distinct().count() == 6
    got = samples.corpus_samples(raw, "/base")
    assert got.count() == 12 and got.columns == ["id", "transcription", "file_path", "lang", "group"]
    r = got.where("lang = 'ja_jp' and `group` = 'dev' and id = 5").first()
    assert (r.transcription, r.file_path) == ('text "ja_jp 0', "/base/ja_jp/audio/dev/5_0.wav")


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith a line', "f", "en", "dev"), (2, None, "f", "en", "dev"), (3, "世界", "f", "ja", "test")]
    sinks.csv(spark.createDataFrame(rows, schemas.SAMPLES).coalesce(1), f"{tmp_path}/out")
    back = readers.csv_table(spark, f"{tmp_path}/out", schemas.SAMPLES)
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_csv_with_byte_order_mark(spark, tmp_path):
    write(f"{tmp_path}/b.csv", "﻿id,transcription,file_path,lang,group\n1,x,f,en,dev\n")
    assert tuple(readers.csv_table(spark, f"{tmp_path}/b.csv", schemas.SAMPLES).first()) == (1, "x", "f", "en", "dev")


def test_summary_falls_back_to_the_archive(spark, tmp_path):
    head = "LOG_FILE,lang,group,model,local_inference_csv_path,config,prompt_version,wer,cer\n"
    write(f"{tmp_path}/old.csv", head + "l,en,test,m,/p,c,v,n/a,0.5\n")
    r = readers.summary_csv(spark, f"{tmp_path}/new.csv", f"{tmp_path}/old.csv").first()
    assert (r.wer, r.cer) == ("n/a", "0.5")


def test_json_lines(spark, tmp_path):
    write(f"{tmp_path}/a/x.jsonl", '{"k": 1}\n\n   \n{"k": 2}\n')
    write(f"{tmp_path}/a/b/y.jsonl", "broken\n")
    write(f"{tmp_path}/a/z.txt", "other\n")
    got = readers.json_lines(spark, f"{tmp_path}/a")
    assert sorted(r.raw for r in got.collect()) == ["broken", '{"k": 1}', '{"k": 2}']
    assert {os.path.basename(r.file) for r in got.collect()} == {"x.jsonl", "y.jsonl"}


def test_job_logs(spark, tmp_path):
    jobs = [
        {"lang": "en", "group": "test", "job_name": "j1", "submitted_at": "2026-01-02T03:04:05.123456"},
        {"lang": "en", "group": "silence", "job_name": "j2", "gcs_output_base_uri": "gs://x"},
    ]
    write(f"{tmp_path}/log_1.json", json.dumps(jobs, indent=4))
    write(f"{tmp_path}/log_2.json", "[{broken")
    got = {r.job_name: r for r in readers.job_logs(spark, f"{tmp_path}/*.json").collect()}
    assert set(got) == {"j1", "j2"}
    assert (got["j1"].kind, got["j2"].kind) == ("normal", "silence")
    assert got["j1"].submitted_at.second == 5 and got["j2"].gcs_output_base_uri == "gs://x"
    bad = readers.broken_job_logs(spark, f"{tmp_path}/*.json").collect()
    assert [os.path.basename(r.log_file) for r in bad] == ["log_2.json"]


def test_prompts_and_listing(spark, tmp_path):
    write(f"{tmp_path}/p/prompt_v2.txt", "line one\nline {language_code}\n")
    write(f"{tmp_path}/p/prompt_v3_en.txt", "")
    write(f"{tmp_path}/p/report.md", "no")
    got = {r.prompt_version: r.text for r in readers.prompts(spark, f"{tmp_path}/p").collect()}
    assert got["prompt_v2.txt"] == "line one\nline {language_code}\n" and "report.md" not in got
    files = {os.path.basename(r.path): r.length for r in readers.file_listing(spark, f"{tmp_path}/p").collect()}
    assert files == {"prompt_v2.txt": 30, "report.md": 2, "prompt_v3_en.txt": 0} and got["prompt_v3_en.txt"] == ""
    assert readers.path_exists(spark, f"{tmp_path}/p") and not readers.path_exists(spark, f"{tmp_path}/q")


def test_request_sink_and_json_sink(spark, tmp_path):
    df = spark.createDataFrame([(f"job{i % 2}", json.dumps({"i": i})) for i in range(40)], "job_id string, line string")
    sinks.requests(df, f"{tmp_path}/req")
    assert {d for d in os.listdir(f"{tmp_path}/req") if d.startswith("job")} == {"job_id=job0", "job_id=job1"}
    assert spark.read.text(f"{tmp_path}/req").count() == 40
    sinks.json(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/json")
    assert spark.read.text(f"{tmp_path}/json").first().value == '{"a":1,"b":null}'


def test_append_runs(spark, tmp_path):
    schema = "job_id string, local_inference_csv_path string, log_file string, log_row long"
    for jobs in ([("b", "/b", "x/log1.json", 2), ("a", "/a", "x/log1.json", 1)], [("c", "/c", "x/log2.json", 0)]):
        sinks.append_runs(spark.createDataFrame(jobs, schema), f"{tmp_path}/runs")
    got = readers.run_table(spark, f"{tmp_path}/runs").select("run_seq", "job_id", "LOG_FILE").orderBy("run_seq").collect()
    assert [tuple(r) for r in got] == [(1, "a", "log1.json"), (2, "b", "log1.json"), (3, "c", "log2.json")]


def test_appending_a_round_again_leaves_one_copy(spark, tmp_path):
    schema = "local_inference_csv_path string, log_file string, log_seq long, cer double"
    path = f"{tmp_path}/runs"

    def rows(*jobs):
        return spark.createDataFrame([(f"/{j}", "log.json", n, cer) for n, (j, cer) in enumerate(jobs)], schema).repartition(3)

    def stored():
        return {r["local_inference_csv_path"]: (r["run_seq"], r["cer"]) for r in readers.run_table(spark, path).collect()}

    assert sinks.append_runs(rows().limit(0), path) is None
    key = sinks.append_runs(rows(("z", 0.1), ("b", 0.2), ("c", 0.3)), path)
    assert stored() == {"/z": (1, 0.1), "/b": (2, 0.2), "/c": (3, 0.3)}
    sinks.append_runs(rows(("d", 0.4)), path)
    assert sinks.append_runs(rows(("z", 0.5), ("b", 0.2), ("c", 0.3)), path) == key
    assert stored() == {"/z": (1, 0.5), "/b": (2, 0.2), "/c": (3, 0.3), "/d": (4, 0.4)}
    # a round that grew would run into the next one's numbers, so it is numbered after it
    sinks.append_runs(rows(("x", 1.0)), path, "named")
    sinks.append_runs(rows(("x", 1.0), ("y", 2.0)), path, "named")
    assert {k: v for k, v in stored().items() if k in ("/x", "/y", "/d")} == {"/d": (4, 0.4), "/x": (5, 1.0), "/y": (6, 2.0)}
    # rows whose round did not get on the list do not count
    sinks._put_round(spark.createDataFrame([("/lost", 9.0, 9, "lost")], "local_inference_csv_path string, cer double, run_seq long, append_round string"), path)
    assert "/lost" not in stored() and len(stored()) == 6


def test_rows_are_numbered_by_range(spark):
    rows = [(i * 37 % 500, None if i % 7 == 0 else f"k{i % 11}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string").repartition(13)
    got = [(r["k"] or "", r["id"]) for r in sorted(range_index(df, ["k", "id"], "n").collect(), key=lambda r: r["n"])]
    assert got == sorted((k or "", i) for i, k in rows)
    assert sorted(r["n"] for r in range_index(df, ["k"], "n").collect()) == list(range(500))
    assert range_index(df.limit(0), ["k"]).count() == 0


def test_logs_keep_their_order_over_part_files(spark, tmp_path):
    jobs = spark.createDataFrame([(f"job{9 - i}", "de") for i in range(10)], "job_name string, lang string").repartition(4)
    sinks.job_log(jobs, f"{tmp_path}/log", ["job_name"])
    got = readers.job_logs(spark, f"{tmp_path}/log", arrays=False).orderBy("log_seq").select("job_name").collect()
    assert [r[0] for r in got] == [f"job{i}" for i in range(10)]


def test_response_lines_keep_the_order_inside_a_file(spark, tmp_path):
    from echoscore.plans import evaluate

    write(f"{tmp_path}/in/job_id=j%201/a.jsonl", "\n".join([line("u1", "zeta"), "", line("u2", "x"), line("u1", "alpha")]))
    lines = readers.response_lines(spark, f"{tmp_path}/in")
    got = {tuple(r) for r in evaluate.predictions(lines).collect()}
    assert got == {("j 1", "u1", "alpha"), ("j 1", "u2", "x")}


def test_staged_small_table_is_broadcast(spark, tmp_path):
    spark.range(5_000_000).selectExpr("id", "uuid() u").write.parquet(f"{tmp_path}/big")
    big = spark.read.parquet(f"{tmp_path}/big")
    small = staged(spark.range(10), "t")
    assert small.schema.simpleString() == spark.range(10).schema.simpleString() and small.count() == 10
    plan = big.join(small, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_staged_folders_can_be_dropped(spark):
    drop_staged(spark)
    kept = staged(spark.range(3), "t").inputFiles()
    assert drop_staged(spark) == 1 and drop_staged(spark) == 0
    assert not readers.path_exists(spark, kept[0])


def test_shared_folder_comes_from_the_session(spark):
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    assert readers.spread(one, "id").rdd.getNumPartitions() == cores
    many = spark.range(100).repartition(cores + 3)
    assert readers.spread(many, "id") is many


# --- streaming ------------------------------------------------------------------------------


def line(uri, text):
    return json.dumps({
        "request": {"contents": [{"parts": [{"fileData": {"fileUri": uri}}]}]},
        "response": {"candidates": [{"content": {"parts": [{"text": text}]}}]},
    })


@pytest.fixture
def expected(spark):
    return spark.createDataFrame(
        [("j1", "u1", 1, "one two"), ("j1", "u2", 2, "three four"), ("j 2", "u1", 1, "one two")],
        "job_id string, gcs_uri string, id long, transcription string",
    )


def test_stream_scores_new_files_once_and_keeps_the_last_answer(spark, tmp_path, expected):
    landing, out, progress = (f"{tmp_path}/{x}" for x in ("landing", "out", "progress"))

    def run():
        streaming.start(streaming.response_stream(spark, landing), expected, out, progress).awaitTermination()
        return {r.job_id: (r.n_scored, r.wer, r.complete) for r in streaming.current_summary(spark, out, expected).collect()}

    write(f"{landing}/job_id=j1/a.jsonl", "\n".join([line("u1", "one too"), "", "broken", line("u9", "unknown")]))
    write(f"{landing}/job_id=j%202/a.jsonl", line("u1", "one two"))
    assert run() == {"j1": (1, 0.5, False), "j 2": (1, 0.0, True)}

    write(f"{landing}/job_id=j1/b.jsonl", "\n".join([line("u1", "one two"), line("u2", "three")]))
    os.utime(f"{landing}/job_id=j1/b.jsonl", (4e9, 4e9))
    assert run() == {"j1": (2, 0.25, True), "j 2": (1, 0.0, True)}

    before = spark.read.schema(streaming.SCORES).parquet(out).count()
    assert run() == {"j1": (2, 0.25, True), "j 2": (1, 0.0, True)}  # nothing new: nothing scored
    assert spark.read.schema(streaming.SCORES).parquet(out).count() == before == 4
    assert [(r.job_id, r.raw) for r in streaming.malformed_lines(spark, out).collect()] == [("j1", "broken")]


def test_last_answer_of_a_file_is_its_last_line(spark, tmp_path, expected):
    write(f"{tmp_path}/in/job_id=j1/a.jsonl", "\n".join([line("u1", "zeta"), line("u2", "three four"), line("u1", "alpha")]))
    streaming.start(streaming.response_stream(spark, f"{tmp_path}/in"), expected, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.gcs_uri: r.prediction for r in streaming.current_scores(spark, f"{tmp_path}/out").collect()}
    assert got == {"u1": "alpha", "u2": "three four"}


def test_stream_agrees_with_batch(spark, tmp_path, expected):
    from echoscore.operators.scoring import corpus_rates

    answers = {("j1", "u1"): "one", ("j1", "u2"): "x four [EOT]", ("j 2", "u1"): ""}
    for n, ((job, uri), text) in enumerate(answers.items()):
        write(f"{tmp_path}/in/job_id={job.replace(' ', '%20')}/{n}.jsonl", line(uri, text))
    arriving = streaming.response_stream(spark, f"{tmp_path}/in", 1)
    streaming.start(arriving, expected, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.job_id: (r.wer, r.cer) for r in streaming.current_summary(spark, f"{tmp_path}/out", expected).collect()}
    text = F.udf(lambda j, u: answers[(j, u)])
    batch = corpus_rates(expected.withColumn("prediction", text("job_id", "gcs_uri")), ["job_id"])
    assert got == {r.job_id: (r.wer, r.cer) for r in batch.collect()}
