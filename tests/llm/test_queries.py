"""The registered queries on the smallest tables, and the pipeline against plain Python."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from echoscore.llm import neardup, packing, quality, queries, secrets, toxicity
from echoscore.sources.readers import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not available")


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.execute(queries.ORACLE[name])
    places = [[d[0] for d in want.description].index(c) for c in columns]
    assert len(want.description) == len(columns)
    rows = lambda found: sorted(map(repr, found))
    got = rows(tuple(r[c] for c in columns) for r in df.collect())
    assert got and got == rows(tuple(r[i] for i in places) for r in want.fetchall())


def test_all_are_registered():
    names = list(entry_point.queries())
    assert [n for n in range(1, 14) if sum(x.startswith(f"op{n}_") for x in names) != 1] == [] and "pipeline" in names


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_packing_ids(spark, texts):
    from tokenizers import Tokenizer
    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {d: slow.encode(t, add_special_tokens=False).ids + [1] for d, t in texts.items()}
    got = queries.QUERIES["op1_packing"](spark, SF).collect()
    import zlib

    import numpy as np

    assert sum(r["length"] for r in got) == sum(map(len, whole.values()))
    for r in got:
        part = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]


@pytest.mark.parametrize("name, plain", [("op2_pii", "pii"), ("op3_secrets", "secrets")])
def test_base_spans(spark, texts, name, plain):
    from echoscore.llm import pii

    from . import test_spans

    order = pii.KINDS if plain == "pii" else secrets.KINDS
    find = test_spans.plain_pii if plain == "pii" else test_spans.plain_secrets
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        base = sorted(find(t), key=lambda s: (s[1], order.index(s[0])))
        listed = [":".join(map(str, s)) for s in base]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(got[d]["spans"].split(","))
        assert all(got[d][f"n_{k}"] == sum(s[0] == k for s in base) for k in {s[0] for s in base})


def test_pieces(spark, texts):
    from echoscore.llm.pieces import Pieces

    library = Pieces().library
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.QUERIES["op9_pieces"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_pipeline_equals_plain_python(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels").selectExpr("doc_id as id", "toxic as label")
    import pyarrow as pa

    model = toxicity.fit(docs.selectExpr("doc_id as id", "text"), labels.where(queries.remainder("id", 3) != 1))
    rows = [tuple(r) for r in docs.collect()]
    score = toxicity.scores(pa.array([r[1] for r in rows]), model)
    rows = [r for r, s in zip(rows, score) if s < toxicity.THRESHOLD]
    frame = spark.createDataFrame(rows, docs.schema)
    good = {r["row"]["doc_id"] for r in quality.judged(frame).where("kept").collect()}
    rows = [r for r in rows if r[0] in good]

    from .test_neardup import brute

    rows = [r for r, (_, _, component) in zip(rows, brute([r[:2] for r in rows])) if r[0] == component]
    frame = spark.createDataFrame(rows, docs.schema)
    net = secrets.fit(frame.selectExpr("doc_id as id", "text"))
    masked = {r[0]: secrets.replace(r[1], secrets.text_spans([r[1]], net)[0], "[SECRET]") for r in rows}
    tokens = {d: len(t) + 1 for d, t in zip(masked, packing.byte_bpe()(list(masked.values())))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == tokens
    assert sum(r["length"] for r in got) == sum(tokens.values()) and len(rows) > 50


def test_stages_keep_columns_and_odd_rows(spark):
    good = " ".join(f"the word{i} of" for i in range(40))
    rows = [(1, good, "en", "s", 1, "x"), (1, good, "en", "s", 1, "x"), (2, None, None, None, None, None), (None, good + " end", "en", "s", 9, "y"), (3, "", "de", "s", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `masked` string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert neardup.distinct_documents(corpus_pipeline.drop_poor(spark, docs, SF)).count() == 1
    secret = spark.createDataFrame([(1, "é password=abcdef12 end", "en", "s", 23, "x")], docs.schema)
    assert tuple(corpus_pipeline.mask_secrets(spark, secret, SF).first()) == (1, "é [SECRET] end", "en", "s", 14, "x")
