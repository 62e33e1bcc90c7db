"""Every catalogue query against its SQL on the smallest data set, plus plan checks."""

import os

import duckdb
import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as entry_point
from echoscore.plans.catalog import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not available")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def comparable(rows):
    return sorted(tuple(repr(v + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = entry_point.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    result = db.execute(entry_point.oracle_sql()[name])
    places = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted(d[0] for d in result.description) == columns
    expected = [tuple(r[i] for i in places) for r in result.fetchall()]
    assert got and comparable(got) == comparable(expected)


def plan(spark, name):
    return entry_point.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["corpus_wer_cer", "evaluation_summary", "row_wer_cer"])
def test_scoring_runs_once(spark, name):
    assert plan(spark, name).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cartesian_plans(spark, name, monkeypatch):
    """Neither in the result's plan nor in those of the tables that are staged on the way."""
    plans, write = [], DataFrameWriter.parquet

    def recorded(writer, *args, **kwargs):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return write(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    plans.append(plan(spark, name))
    assert not any("CartesianProduct" in text or "BroadcastNestedLoopJoin" in text for text in plans)


def test_staged_plans_score_once(spark, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def recorded(writer, *args, **kwargs):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return write(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    entry_point.queries()["worst_cases"](spark, SF)
    assert [text.count("ArrowEvalPython") for text in plans] == [1]


def test_scans_read_only_what_is_used(spark):
    text = plan(spark, "dedup_last")
    assert "o_totalprice" in text and "o_clerk" not in text
    counts = plan(spark, "dataset_shape")
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in counts


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0
