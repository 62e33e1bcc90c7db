import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoscore.llm import ann, chat


def exact(rows, asks, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if asks(q):
            near = sorted({(float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in good if i != q})
            out[q] = [(i, d) for d, i in near[:k]]
    return out


def vectors(n, dims=32, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.6, size=(n, dims))
    return [(int(i), [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("part_rows, query_block", [(8192, 1024), (400, 7)])
def test_recall_against_all_pairs(spark, part_rows, query_block):
    rows = vectors(2000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(ann.nearest(df, F.col("vec_id") % 20 == 0, part_rows=part_rows, query_block=query_block))
    want = exact(rows, lambda q: q % 20 == 0)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    by_id = {i: np.array(v) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (p[1], p[0]))
        assert [d for _, d in near] == pytest.approx([np.linalg.norm(by_id[i] - by_id[q]) for i, _ in near], abs=1e-12)


def test_odd_vectors_ties_and_copies(spark):
    same = [1.0] * 8
    rows = [(i, same) for i in range(40)] + [(100, [2.0] + same[1:]), (101, [0.0] + same[1:]), (101, [0.0] + same[1:]), (200, None), (220, []), (240, [0.0] * 8)]
    rows += [(260, [float("nan")] + same[1:]), (280, [float("inf")] + same[1:]), (300, [None] + same[1:]), (320, same[1:]), (None, same)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, part int")
    got = found(ann.nearest(df, F.col("vec_id") % 20 == 0))
    want = exact([r for r in rows if not r[1] or len(r[1]) == 8], lambda q: q % 20 == 0)
    assert got == want and got[0][0] == (1, 0.0) and got[20][:2] == [(0, 0.0), (1, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1, 100)"), F.col("vec_id") % 20 == 0)
    assert found(few) == {0: [(1, 0.0), (100, 1.0)], 100: [(0, 1.0), (1, 1.0)]}


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (500, 4), dtype=np.uint8)
    x, tables = rng.normal(size=(500, 3)), ann.tables_of(codes)
    for radius in (3, 7, 9, 12):
        near, _ = ann.search(codes, x, codes[0], x[0], tables, radius, 1)
        apart = np.bitwise_count(codes ^ codes[0]).sum(1)
        assert set(near.tolist()) == set(np.flatnonzero(apart <= radius).tolist())


def plain_chat(rows):
    logged = {}
    for conv, turn, role, text in set(rows):
        if conv is not None and turn is not None:
            logged.setdefault(conv, []).append((turn, (role is not None, role or ""), (text is not None, text or "")))
    logged = {c: sorted(t) for c, t in logged.items()}
    out = []
    for c, ts in logged.items():
        longer = any(len(o) > len(ts) and o[: len(ts)] == ts and o[len(ts)][0] != ts[-1][0] for o in logged.values())
        if not longer and not any(o == ts and d < c for d, o in logged.items()):
            out.append((c, len(ts), "".join(f"<|{r[1]}|>\n{t[1]}\n<|end|>\n" for _, r, t in ts)))
    return sorted(out)


@pytest.mark.parametrize("seed, chunk", [(0, 1024), (1, 3), (2, 1), (3, 2)])
def test_collapse_equals_plain_python(spark, seed, chunk):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        turns = [rng.choice(["user", "user", None]) if k % 2 == 0 else "assistant" for k in range(rng.randint(1, 9))]
        own = [(k, r, rng.choice(["a", "a", "b", "", None]) if k else "hello") for k, r in enumerate(turns)]
        rows += [(conv, *t) for t in own]
        for copy in range(rng.randint(0, 3)):
            rows += [(1000 * (copy + 1) + conv, *t) for t in own[: rng.randint(1, len(own))]]
    rows += rows[:10] + [(None, 0, "user", "x"), (7, None, "user", "x"), (2, 0, "system", "same turn number"), (5000, 0, "user", "z" * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, h1 int")
    got = sorted(map(tuple, chat.formatted(df, chunk=chunk).collect()))
    assert got == plain_chat(rows)


def test_chat_edges(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(df).count() == 0
    plan = chat.formatted(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
