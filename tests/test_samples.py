import random

import pytest
from pyspark.sql import functions as F

from echoscore.operators import ranking, samples, sync
from echoscore.operators.indexing import chunked, global_index, hash_bucket, sample_index

SCHEMA = "id long, transcription string, file_path string, lang string, `group` string, medical_yn boolean, ok boolean"


def make(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if r.random() < 0.7 else r.choice(["de", "fr"])
        rows.append((i * 40_000 % 9_999_999, f"t{i}", f"/a/{i}.wav", lang, r.choice(["dev", "test", "train"]), r.random() < 0.8, r.random() < 0.9))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(7)


def by_position(rows):
    return sorted(rows, key=lambda x: (x[3], x[4], x[0]))


def test_global_index_equals_sorted_position(spark):
    rows, df = make(spark)
    got = {(r.lang, r.group, r.id): r.idx for r in sample_index(df).collect()}
    assert got == {(x[3], x[4], x[0]): i for i, x in enumerate(by_position(rows))}


def test_global_index_of_scattered_ids(spark):
    r = random.Random(3)
    ids = sorted({r.randrange(-(2**62), 2**62) for _ in range(500)} | {k << 40 for k in range(20)} | {-1, 0, 1})
    df = spark.createDataFrame([("en", "dev" if i % 3 else "test", i) for i in ids], "lang string, `group` string, id long").repartition(5)
    got = [(x.group, x.id) for x in sample_index(df).orderBy("idx").collect()]
    assert got == sorted(("dev" if i % 3 else "test", i) for i in ids)


def test_global_index_of_a_few_rows(spark):
    rows, df = make(spark)
    only = df.where("id % 7 = 0").select("lang", "group", "id")
    got = {r.id: r.idx for r in sample_index(df, only=only, only_on=["lang", "group", "id"]).collect()}
    assert got == {x[0]: i for i, x in enumerate(by_position(rows)) if x[0] % 7 == 0}


def test_global_index_without_groups(spark):
    names = [f"n{i}" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "noise_id string")
    got = global_index(df, [], [F.md5("noise_id")], hash_bucket("noise_id")).orderBy("idx").collect()
    import hashlib

    assert [r.noise_id for r in got] == sorted(names, key=lambda n: hashlib.md5(n.encode()).hexdigest())
    assert [r.idx for r in got] == list(range(300))


def test_chunks(spark):
    df = chunked(spark.range(120).withColumnRenamed("id", "idx"))
    got = df.groupBy("chunk_idx").agg(F.count("*").alias("n"), F.max("pos").alias("m")).orderBy("chunk_idx").collect()
    assert [(r.chunk_idx, r.n, r.m) for r in got] == [(0, 50, 49), (1, 50, 49), (2, 20, 19)]


def test_corpus_samples_keep_the_first_of_each_id(spark):
    raw = spark.createDataFrame(
        [(1, "b.wav", "second", "en", "dev", 2), (1, "a.wav", "first", "en", "dev", 1), (1, "c.wav", "other split", "en", "test", 1)],
        "id long, file_name string, transcription string, lang string, `group` string, seq long",
    )
    got = {(r.group, r.transcription, r.file_path) for r in samples.corpus_samples(raw, "/base/").collect()}
    assert got == {("dev", "first", "/base/en/audio/dev/a.wav"), ("test", "other split", "/base/en/audio/test/c.wav")}


def test_top_n_never_exceeds_n_and_matches_sorting(spark):
    rows, df = make(spark, 300)
    got = ranking.top_n(df, ["lang"], [F.col("group").desc(), F.col("id")], 30, ["lang", "group", "id"]).collect()
    for lang in ("en", "de", "fr"):
        mine = sorted((x for x in rows if x[3] == lang), key=lambda x: ([-ord(c) for c in x[4]], x[0]))[:30]
        expected = [(x[0], i) for i, x in enumerate(mine, 1)]
        assert sorted(((r.id, r["rank"]) for r in got if r.lang == lang), key=lambda p: p[1]) == expected


def test_top_n_prunes_before_the_shuffle(spark):
    _, df = make(spark)
    plan = ranking.top_n(df, ["lang"], [F.col("id")], 5, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_first_and_last_row(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), (None, 2, "z"), (None, 5, "w")], "k string, o int, v string")
    assert {(r.k, r.v) for r in ranking.first_row(df, ["k"], F.col("o")).collect()} == {("a", "y"), (None, "z")}
    assert {(r.k, r.v) for r in ranking.last_row(df, ["k"], F.col("o")).collect()} == {("a", "x"), (None, "w")}


@pytest.fixture(scope="module")
def noise(spark):
    return spark.createDataFrame([(f"n{i}",) for i in range(17)], "noise_id string")


def test_noise_plan(spark, noise):
    rows, df = make(spark, 600)
    plan = samples.noise_plan(df, noise, "/out/", per_lang=40, train_per_lang=15, valid=F.col("ok")).collect()
    labelled = [x for x in by_position(rows) if x[5]]
    place = {x[0]: i for i, x in enumerate(labelled)}
    for lang in ("en", "de", "fr"):
        expected = [x[0] for x in labelled if x[3] == lang and x[6]][:40]
        mine = sorted((r for r in plan if r.lang == lang), key=lambda r: r["rank"])
        assert [r.id for r in mine] == expected
        assert [r["rank"] for r in mine] == list(range(len(expected)))
        assert [r.group_name for r in mine] == ["train" if i < 15 else "test" for i in range(len(expected))]
    for r in plan:
        assert r.idx == place[r.id]
        assert r.noisy_output_path == f"/out/{r.lang}-{r.group_name}-{r.idx}-{r.id}-{r.noise_id}.wav"
        assert r.transcription
    again = samples.noise_plan(df.repartition(3), noise, "/out/", per_lang=40, train_per_lang=15, valid=F.col("ok"))
    assert {(r.id, r.noise_id) for r in again.collect()} == {(r.id, r.noise_id) for r in plan}
    other = samples.noise_plan(df, noise, "/out/", seed=5, per_lang=40, train_per_lang=15, valid=F.col("ok"))
    assert {(r.id, r.noise_id) for r in other.collect()} != {(r.id, r.noise_id) for r in plan}


def test_silence_plan(spark):
    rows, df = make(spark, 300)
    plan = samples.silence_plan(df, "/out").collect()
    labelled = [x for x in by_position(rows) if x[5]]
    place = {x[0]: i for i, x in enumerate(labelled)}
    for lang in ("en", "de", "fr"):
        mine = sorted((r for r in plan if r.lang == lang), key=lambda r: r["rank"])
        assert [r.id for r in mine] == [x[0] for x in labelled if x[3] == lang][:30]
        spots = [r.silence_position for r in mine]
        assert spots == (["front"] * 10 + ["middle"] * 10 + ["back"] * 10)[: len(mine)]
    assert all(r.silence_output_path == f"/out/{r.lang}-{r.silence_position}-{place[r.id]}-{r.id}-silence.wav" for r in plan)


def test_shortfalls_and_shape(spark):
    rows, df = make(spark, 200)
    labelled = samples.labelled_only(df)
    counts = {lang: sum(1 for x in rows if x[3] == lang and x[5]) for lang in ("en", "de", "fr")}
    got = {r.lang: r.n for r in samples.language_shortfalls(labelled, 50).collect()}
    assert got == {k: v for k, v in counts.items() if v < 50}
    assert sum(r.n for r in samples.dataset_shape(df).collect()) == 200


def test_audio_path(spark):
    df = spark.createDataFrame([("", "s", "a"), (None, None, "a"), ("n", "s", "a"), ("", "", "")], "noisy_output_path string, silence_output_path string, audio string")
    got = df.select(samples.audio_path(df, "noisy_output_path", "silence_output_path", "absent", "audio").alias("p")).collect()
    assert [r.p for r in got] == ["s", "a", "n", None]
    assert df.select(samples.audio_path(df, "absent").alias("p")).first().p is None


def test_sync_plan_covers_the_manifest(spark):
    manifest = spark.createDataFrame(
        [(1, "/x/1.wav", "en", "dev"), (2, "/x/2.wav", "en", "dev"), (3, "/x/3.wav", "de", "test"), (4, None, "de", "test"), (5, "", "fr", "dev"), (6, "/x/3.wav", "de", "test")],
        "id long, noisy_output_path string, lang string, `group` string",
    )
    stored = spark.createDataFrame([("gs://b/p/dev_en/1.wav",), ("gs://b/p/dev_en/1.wav",), ("gs://b/p/zzz",)], "path string")
    local = spark.createDataFrame([("/x/1.wav",), ("/x/2.wav",)], "path string")
    got = {r.id: (r.status, r.gcs_uri) for r in sync.sync_plan(manifest, stored, local, "b", "p").collect()}
    assert got == {
        1: ("reuse", "gs://b/p/dev_en/1.wav"), 2: ("upload", "gs://b/p/dev_en/2.wav"), 3: ("missing", None),
        4: ("no_path", None), 5: ("no_path", None), 6: ("missing", None),
    }
    bare = manifest.where("id = 1").select("id", "noisy_output_path")
    assert sync.sync_plan(bare, stored, local, "b", "p").first().gcs_uri == "gs://b/p/unknown_unknown/1.wav"
