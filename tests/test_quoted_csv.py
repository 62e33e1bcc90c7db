"""Quoted CSV read in splits against Spark's one-task reader."""

import csv
import random

import pytest

from echoscore.sources import quoted, readers

SCHEMA = "id string, text string, n string"


def whole_reader(spark, path):
    return spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_reader_that_takes_whole_files(spark, tmp_path, small_splits, end):
    rng, want = random.Random(len(end)), []
    parts = ["a", 'say ""', '"', "\n", ",", "é", "\n\n", " x ", "word " * 20, "日本"]
    for f in range(4):
        with open(f"{tmp_path}/{f}.csv", "w", encoding="utf-8-sig" if f == 1 else "utf-8", newline="") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerow(["id", "te\nxt", "n"])
            for i in range(150):
                # f = 3: single fields longer than several splits
                text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) + ("line\n" * 700 if f == 3 and i % 40 == 7 else "")
                want.append((f"{f}-{i}", text.strip() or "x", str(i) if i % 5 else None))
                writer.writerow([x or "" for x in want[-1]])
    assert len(spark.read.text(str(tmp_path)).inputFiles()) == 4
    found = readers.csv_table(spark, str(tmp_path), SCHEMA)
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 40
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    if end == "\n":  # else that reader leaves \r in the last field
        assert rows_of(found) == rows_of(whole_reader(spark, str(tmp_path)))


def test_where_splits_start():
    splits = [("b", 0, False, False), ("a", 0, True, True), ("a", 10, False, False), ("a", 20, True, True), ("a", 30, True, True), ("a", 40, False, True)]
    # a: opens in 0, goes on through 10, closes in 20; opens in 30 and is still open in 40
    assert quoted.inside_starts(splits) == {("a", 10): 0, ("a", 20): 0, ("a", 40): 30}
    # a split that starts inside, closes a record and opens another one
    assert quoted.inside_starts([("a", 0, True, True), ("a", 9, False, True), ("a", 19, True, True)]) == {("a", 9): 0, ("a", 19): 9}


def test_empty_and_headless(spark, tmp_path):
    for name, text in (("none", ""), ("header", "id,text,n\n"), ("blank", "id,text,n\n\n1,\"\",2\n\n"), ("last", 'id,text,n\n1,"a\nb",3')):
        (tmp_path / f"{name}.csv").write_text(text, newline="")
    for name in ("none", "header", "blank", "last"):
        path = f"{tmp_path}/{name}.csv"
        assert rows_of(readers.csv_table(spark, path, SCHEMA)) == rows_of(whole_reader(spark, path)), name
