import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echoscore.llm import quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def cases():
    rng = random.Random(5)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a\n\na\n a\na", "# $ é|<> !!", "\x1c a b \x85", "\r\n".join(["l"] * 4)]
    out += [" ".join(rng.choice("ab") for _ in range(n)) for n in range(3, 30, 4)]
    out += ["\n".join(rng.choice(["the of and", "x y", ""]) for _ in range(40)), "the " * 300, " ".join(f"the w{i}" for i in range(4000)) + " the w1 the w2 the"]
    return out


def test_measures_equal_plain_python(spark):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(cases())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, n_words double")
    got = {r["row"]["doc_id"]: r for r in quality.judged(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r, want = got[i], plain(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (not r["broken"])


def test_filter_keeps_columns_and_repeated_rows(spark):
    good = " ".join(f"the word{i} of" for i in range(40))
    docs = spark.createDataFrame([(1, good, "a"), (1, good, "a"), (2, "short", "b"), (None, good, None), (3, None, "c")], "doc_id long, text string, `row` string")
    out = quality.filtered(docs)
    assert out.columns == docs.columns
    assert sorted(out.collect(), key=str) == sorted([(1, good, "a"), (1, good, "a"), (None, good, None)], key=str)
    assert quality.filtered(docs.limit(0)).count() == 0


def test_filter_is_linear_in_the_text(spark):
    """A filter pushed below the measures once split the text again for every word: hours for this row."""
    text = " ".join(f"the word{i} of" for i in range(30_000))
    assert quality.filtered(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1


def test_no_python_in_the_plan(spark):
    plan = quality.judged(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def toxic_rows(n, seed=0):
    """Toxic: an insult (inflected) beside a group word; either alone is clean."""
    rng = random.Random(seed)
    filler = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    out = []
    for i in range(n):
        words = [rng.choice(filler) for _ in range(rng.randint(5, 40))]
        kind = rng.randint(0, 3)
        if kind in (1, 3):
            words.insert(0, "vermin" + rng.choice(["", "s", "ly", "ish"]))
        if kind in (2, 3):
            words.append("outsiders")
        out.append((i, " ".join(words), int(kind == 3)))
    return out


def test_interactions_are_learned(spark):
    rows = toxic_rows(1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, label int")
    model = toxicity.fit(docs, labels)
    test = toxic_rows(600, 9)
    score = toxicity.scores(pa.array([t for _, t, _ in test]), model)
    y = np.array([label for *_, label in test])
    assert ((score >= 0.5) == y).mean() > 0.97
    # without the pair part, which additive weights lack, the same model does worse
    flat = model._replace(factors=np.zeros_like(model.factors))
    loss = lambda m: -np.log(np.where(y > 0, s := toxicity.scores(pa.array([t for _, t, _ in test]), m), 1 - s) + 1e-9).mean()
    assert loss(model) < loss(flat)
    again = docs.select("id", toxicity.score(spark, model).alias("s")).orderBy("id").collect()
    assert np.allclose([r["s"] for r in again], toxicity.scores(pa.array([r[1] for r in rows]), model))


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1), (2, 1), (None, 1), (3, None)]])
def test_without_both_labels_scores_are_zero(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (None, "b")], "id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "id long, label int"))
    got = docs.select(toxicity.score(spark, model).alias("s"))
    assert [r["s"] for r in got.collect()] == pytest.approx([0.0] * 4, abs=1e-9)
    assert docs.limit(0).select(toxicity.score(spark, model)).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    labels = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    a, b = (sorted(toxicity.sample(x, 100).collect()) for x in (labels, labels.repartition(7)))
    assert a == b and len(a) == 100 and sum(r["label"] for r in a) == 50


def test_scores_do_not_depend_on_the_share_sampled(spark):
    """6 % of the rows are toxic, 40 % of those with the marked term; a sample of halves once scored the term 0.9."""
    rng = random.Random(3)
    rows = []
    for i in range(16_000):
        marked = rng.random() < 0.1
        words = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(8)]
        rows.append((i, " ".join(words + ["vermin"] * marked), int(rng.random() < (0.4 if marked else 0.02))))
    docs = spark.createDataFrame([r[:2] for r in rows], "id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, label int")
    texts = pa.array(["vermin", "bana"])
    whole, part = (toxicity.scores(texts, toxicity.fit(docs, labels, max_rows=n)) for n in (40_000, 1600))
    assert whole == pytest.approx([0.4, 0.02], abs=0.1) and part == pytest.approx(whole, abs=0.12)
    assert toxicity.prior_shift(labels, 40_000) == 0
