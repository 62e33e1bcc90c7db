import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoscore.llm import lm
from echoscore.llm.pieces import Pieces, encoded


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "The", *(f"w{i}" for i in range(60))]
    texts = [" ".join(rng.choices(vocabulary, [30, 20, 5] + [1] * 60, k=rng.randint(0, 60))) for _ in range(n)]
    texts += [None, "", " \n ", texts[3], "never-seen-anywhere " * 3, "é é É"]
    return list(enumerate(texts))


def learned(doc):
    return zlib.crc32(str(doc).encode()) % 7 != 2


def plain(rows, weights):
    words = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in (t or "").encode().decode().split()] + ["</s>"]
    one, two, docs = Counter(), Counter(), 0
    for doc, text in rows:
        if learned(doc):
            w = words(text)
            docs += 1
            one.update(w)
            two.update(zip([None, *w], w))
    total, distinct = sum(one.values()), len(one)
    out = {}
    for doc, text in rows:
        w, base, score = words(text), 0.0, 0.0
        for u, x in zip([None, *w], w):
            context = docs if u is None else one[u]
            l0, l1, l2 = weights[min(int(math.log2(context + 1)), lm.BUCKETS - 1)]
            base += math.log10((one[x] + 1) / (total + distinct + 1))
            score += math.log10(l0 / (distinct + 1) + l1 * one[x] / total + (l2 * two[u, x] / context if context else 0))
        out[doc] = (not learned(doc), len(w), sum(one[x] > 0 for x in w), total, base, score)
    return out


@pytest.mark.parametrize("block_bytes, range_tokens", [(1 << 24, 2_000_000), (600, 100)])
def test_scores_equal_plain_counts(spark, monkeypatch, block_bytes, range_tokens, tmp_path):
    kept = []
    original = lm.mixture
    monkeypatch.setattr(lm, "mixture", lambda *a, **k: kept.append(original(*a, **k)) or kept[-1])
    rows = corpus()
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, learn int").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    got = lm.scored(docs, fold != 2, fold == 2, block_bytes=block_bytes, range_tokens=range_tokens).collect()
    want = plain(rows, kept[-1])
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4]
        assert tuple(r)[5:] == pytest.approx(want[r["doc_id"]][4:], rel=1e-9)


def test_mixture_beats_its_parts_on_held_out_text(spark, monkeypatch, tmp_path):
    rng = random.Random(4)
    follows = {w: rng.choices(range(40), k=3) for w in range(40)}
    texts = []
    for _ in range(400):
        w, out = rng.randrange(40), []
        for _ in range(40):
            out.append(f"v{w}")
            w = rng.choice(follows[w]) if rng.random() < 0.8 else rng.randrange(40)
        texts.append(" ".join(out))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs, fold = spark.read.parquet(str(tmp_path / "docs")), F.crc32(F.col("doc_id").cast("string")) % 7
    held = lambda: lm.scored(docs, fold != 2, fold == 2).where("held_out").agg(F.sum("score")).first()[0]
    best = held()
    for only in ([0.05, 0.95, 0.0], [0.01, 0.0, 0.99], [0.34, 0.33, 0.33]):
        monkeypatch.setattr(lm, "mixture", lambda grid, order, words, w=only: np.tile(w, (lm.BUCKETS, 1)))
        assert held() < best


def test_em_finds_the_weights_that_made_the_counts():
    grid = [((5, -8, 1), 700), ((5, -40, -4), 300)]
    weights = lm.mixture(grid, 2, 10**9)
    assert weights[5] == pytest.approx([0, 0.7, 0.3], abs=0.01) and weights[6] == pytest.approx(weights[5])


def test_nothing_learned_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = lm.scored(docs, F.lit(False), F.lit(None).cast("boolean")).collect()
    assert {(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(1, False, 3, 0, 0, 0.0), (None, False, 1, 0, 0, 0.0)}
    assert lm.scored(docs.limit(0), F.lit(True), F.lit(False)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return Pieces()


def odd_texts(n=3000):
    rng = random.Random(1)
    alphabet = "ab e▁ \n\t日本éñ😀<0x41></s><s><unk>    ​\x00́thein.,\r"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + ["", " ", "a" * 3000, " " * 500, "\n" * 100, "ab" * 2000, "aaab" * 700, "x" * 50 + " " * 33 + "y", "<s>", "▁▁ ▁"]


def test_ids_and_texts_equal_the_library(vocabulary):
    for text in odd_texts():
        ids, shown = vocabulary.encode(text)
        assert ids == vocabulary.library.encode(text), text
        assert shown == vocabulary.library.decode(ids) == vocabulary.decode(ids), text


def test_decoding_any_pieces(vocabulary):
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(3, 32000) for _ in range(20)]
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


def test_encoded_rows(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(odd_texts(40))] + [(None, "null id"), (3, "again"), (3, "again"), (-1, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    got = encoded(docs).collect()
    want = [(d, vocabulary.library.encode(t or ""), vocabulary.library.decode(vocabulary.library.encode(t or ""))) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert encoded(docs.limit(0)).count() == 0
