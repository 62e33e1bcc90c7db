"""Runs whose completion a stream reports."""

import json
import os
import time

import pytest

from echoscore.operators.scoring import corpus_rates
from echoscore.streaming import completion, scoring as streaming


def line(uri, text):
    return json.dumps({
        "request": {"contents": [{"parts": [{"fileData": {"fileUri": uri}}]}]},
        "response": {"candidates": [{"content": {"parts": [{"text": text}]}}]},
    })


def write(path, text, at):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    hidden = os.path.join(os.path.dirname(path), "_" + os.path.basename(path))
    with open(hidden, "w") as f:
        f.write(text)
    os.utime(hidden, (at, at))
    os.rename(hidden, path)  # files appear whole


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A micro-batch starts a worker for each state partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def expected(spark):
    rows = [("j1", f"u{i}", i, f"one two {i}") for i in range(12)] + [("j2", "u1", 1, "a b"), ("j2", "u2", 2, "..."), ("j2", None, 3, "x"), ("j3", "u1", 1, "z")]
    return spark.createDataFrame(rows, "job_id string, gcs_uri string, id long, transcription string")


def found(spark, out):
    return {r["job_id"]: (r["n_answered"], r["n_scored"], r["wer"]) for r in completion.completed_runs(spark, out).collect()}


def test_a_run_comes_out_when_its_last_answer_does(spark, tmp_path, expected):
    landing, out, progress = (f"{tmp_path}/{x}" for x in ("landing", "out", "progress"))
    os.makedirs(landing)

    def follow():
        return completion.start(streaming.response_stream(spark, landing), expected, out, progress, shards=3)

    query = follow()  # no availableNow: it runs on
    try:
        write(f"{landing}/job_id=j1/a.jsonl", "\n".join(line(f"u{i}", f"one two {i}") for i in range(11)), 1e9)
        write(f"{landing}/job_id=j2/a.jsonl", "\n".join([line("u1", "a"), line("u1", "a b"), "broken", line("u9", "unknown")]), 1e9)
        query.processAllAvailable()
        assert found(spark, out) == {}
        write(f"{landing}/job_id=j2/b.jsonl", line("u2", "anything"), 2e9)
        query.processAllAvailable()
        assert found(spark, out) == {"j2": (2, 1, 0.0)}
        first = completion.completed_runs(spark, out).first()["batch"]
    finally:
        query.stop()
        query.awaitTermination()
    query = follow()  # goes on where it stopped
    try:
        write(f"{landing}/job_id=j1/b.jsonl", line("u11", "one two"), 2e9)
        query.processAllAvailable()
        assert found(spark, out) == {"j1": (12, 12, 1 / 36), "j2": (2, 1, 0.0)}
        # a later answer replaces one of a complete run; an older one doesn't
        write(f"{landing}/job_id=j1/c.jsonl", line("u11", "one two 11"), 3e9)
        write(f"{landing}/job_id=j2/c.jsonl", line("u1", "x y"), 5e8)
        query.processAllAvailable()
        assert found(spark, out) == {"j1": (12, 12, 0.0), "j2": (2, 1, 0.0)}
        assert {r["job_id"]: r["batch"] for r in completion.completed_runs(spark, out).collect()}["j2"] == first
    finally:
        query.stop()
        query.awaitTermination()


def test_shards_that_wait_are_reported(spark, tmp_path, expected):
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write(f"{landing}/job_id=j2/a.jsonl", line("u1", "a b"), 1e9)
    query = completion.start(streaming.response_stream(spark, landing), expected, out, f"{tmp_path}/cp", shards=1, stall_ms=500)
    # with timers the query goes on with batches without data, so the test waits for what they bring
    def until(rows):
        end = time.time() + 120
        while time.time() < end and not (os.path.isdir(f"{out}/runs") and rows()):
            assert query.isActive
            time.sleep(1)
        return rows()

    try:
        assert until(lambda: [tuple(r) for r in completion.stalled_runs(spark, out).collect()]) == [("j2", 1)] and found(spark, out) == {}
        write(f"{landing}/job_id=j2/b.jsonl", line("u2", ""), 2e9)
        assert until(lambda: found(spark, out)) == {"j2": (2, 1, 0.0)}
        assert completion.stalled_runs(spark, out).count() == 0
    finally:
        query.stop()
        query.awaitTermination()


def test_stream_agrees_with_batch(spark, tmp_path, expected):
    import random

    rng = random.Random(2)
    rows = [(r["job_id"], r["gcs_uri"]) for r in expected.collect() if r["gcs_uri"]]
    last = {}
    for n in range(6):
        for job in {j for j, _ in rows}:
            some = [u for j, u in rows if j == job and (n == 5 or rng.random() < 0.5)]
            answers = [(u, rng.choice(["one two", "a b", "one two 3 [EOT]", ""])) for u in some]
            last |= {(job, u): t for u, t in answers}
            write(f"{tmp_path}/in/job_id={job}/{n}.jsonl", "\n".join(line(u, t) for u, t in answers), 1e9 + n)
    query = completion.start(streaming.response_stream(spark, f"{tmp_path}/in", 5), expected, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True)
    query.awaitTermination()
    got = {r["job_id"]: (r["wer"], r["cer"]) for r in completion.completed_runs(spark, f"{tmp_path}/out").collect()}
    answers = spark.createDataFrame([(*k, t) for k, t in last.items()], "job_id string, gcs_uri string, prediction string")
    batch = corpus_rates(expected.join(answers, ["job_id", "gcs_uri"]), ["job_id"])
    assert got == {r["job_id"]: (r["wer"], r["cer"]) for r in batch.collect()} and len(got) == 3
