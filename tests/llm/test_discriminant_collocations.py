"""Quadratic discriminant and phrase collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from echoscore.llm import collocations, discriminant
from echoscore.llm.quality import STOP_WORDS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    text = text or ""
    raw, words = text.encode(), WORD.findall(text)
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    sizes = [len(w.encode()) for w in words]
    share = lambda part, whole: np.arcsin(np.sqrt(part / max(whole, 1)))
    lines = [fold(x) for x in text.split("\n") if x]
    n = len(words)
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "!", "|", "#*$%&<>@^~_=+\\/{}[]", "\n"]
    return [
        np.log1p(n), np.log1p(np.mean(sizes) if n else 0), np.log1p(np.std(sizes) if n else 0),
        *[share(sum(chr(b) in g for b in raw), len(raw)) for g in groups], share(sum(b > 127 for b in raw), len(raw)),
        share(sum(fold(w) in STOP_WORDS for w in words), n), share(len(set(map(fold, words))), n),
        share(sum(fold(x) == fold(y) for x, y in zip(words, words[1:])), n), share(len(lines) - len(set(lines)), len(lines)),
        share(sum("A" <= w[0] <= "Z" for w in words), n), share(sum(not (w[-1].isalnum() if ord(w[-1]) < 128 else True) for w in words), n),
    ]


def quality_rows(n, seed=0):
    rng = random.Random(seed)
    filler = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    out = []
    for i in range(n):
        words = [rng.choice([*filler, "the", "of"]) for _ in range(rng.randint(1, 120))]
        good = rng.random() < 0.8
        if not good:
            words = [w.upper() + "!!" if rng.random() < 0.7 else w for w in words] if rng.random() < 0.5 else [w for w in words for _ in range(5)]
        out.append((i, " ".join(words), int(good)))
    return out


ODD = [None, "", " \n\t ", "a", "É|É", "x\nx\ny\n\nX", "the The OF of, end!", "日本 語 the", "a" * 5000 + " b"]


def test_statistics_equal_plain_python():
    texts = ODD + [t for _, t, _ in quality_rows(40)]
    assert np.allclose(discriminant.statistics(pa.array(texts)), [plain_statistics(t) for t in texts])
    assert discriminant.statistics(pa.array([], pa.string())).shape == (0, len(discriminant.NAMES))


def test_model_equals_plain_discriminant(spark):
    rows = quality_rows(900)
    docs = spark.createDataFrame([(i, t, "c", 1.0) for i, t, _ in rows], "doc_id long, text string, x string, label double").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:600]], "id long, label int")
    table = discriminant.measured(docs).cache()
    model = discriminant.fit(table, labels)
    x = np.array([plain_statistics(t) for _, t, _ in rows])
    y = np.array([label for *_, label in rows])
    target = np.maximum(x[:600].var(0), 1e-6)
    difference = np.zeros(len(x))
    for c in (0, 1):
        own = x[:600][y[:600] == c]
        # the chosen intensity is one of the listed ones
        fits = []
        for a in discriminant.INTENSITIES:
            s = (1 - a) * np.cov(own.T, bias=True) + a * np.diag(target)
            off = x - own.mean(0)
            fits.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(s), off) - 0.5 * np.linalg.slogdet(s)[1])
        got = model.classes[c].log_density(x)
        assert min(abs(got - f).max() for f in fits) < 1e-6 * abs(got).max()
        difference += got if c else -got
    want = 1 / (1 + np.exp(-(model.scale * np.clip(difference, -60, 60) + model.shift)))
    got = {r["id"]: r["score"] for r in table.select("id", discriminant.score(spark, model).alias("score")).collect()}
    assert np.allclose([got[i] for i, *_ in rows], want)
    held = np.arange(600, 900)
    assert ((want[held] >= 0.5) == y[held]).mean() > 0.97
    assert abs(want[held].mean() - y[held].mean()) < 0.05


def test_best_intensity_is_likeliest_on_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (60, 8)) @ rng.normal(0, 1, (8, 8))
    halves = [discriminant.Moments(len(h), h.sum(0), h.T @ h) for h in (x[:30], x[30:])]
    target = np.maximum(x.var(0), 1e-6)

    def sure(a):
        return sum(discriminant.gaussian(halves[k], target, a).log_density(x[30:] if k == 0 else x[:30]).sum() for k in (0, 1))

    chosen = discriminant.best_intensity(halves, target)
    assert sure(chosen) == pytest.approx(max(map(sure, discriminant.INTENSITIES)))
    assert chosen > min(discriminant.INTENSITIES)


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0), (2, 1), (None, 0), (3, None)]])
def test_without_two_rows_of_both_kinds(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (2, "")], "doc_id long, text string")
    table = spark.createDataFrame(labels, "id long, label int")
    got = [r["score"] for r in discriminant.scored(docs, table).collect()]
    assert len(got) == 4 and len(set(got)) == 1 and 0 < got[0] < 1
    assert discriminant.scored(docs.limit(0), table).count() == 0


def test_repeated_ids_and_long_texts(spark):
    rows = [(i % 50, t) for i, t, _ in quality_rows(200)] + [(7, "the long word " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 0)], "id long, label int")
    found = discriminant.scored(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)


# --- collocations -----------------------------------------------------------------------------


def plain_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, words), a in candidates.items():
        if len(words) == 3:
            dropped |= {(lang, part) for part in (words[:2], words[1:]) if 100 * a >= 50 * f[lang, part]}
    found = []
    for (lang, words), a in candidates.items():
        if (lang, words) in dropped:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((lang, -score, -a, " ".join(words).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "B", "c\x01", "c", "é", "É", "日本", "the", "New", "York", "x\x0ey"]
    out = [(None, None), ("en", ""), ("und", "a b a b"), ("", "q r " * 30), ("en", ".,;:!?\r\n\x0b\x0c")]
    for _ in range(120):
        words = [rng.choice(vocabulary[: rng.randint(2, 12)]) for _ in range(rng.randint(1, 50))]
        out.append((rng.choice(["en", "en", "de", None]), "".join(w + rng.choice([" ", " ", "\t", "  ", ". ", "!", "\n", ","]) for w in words)))
    return out


@pytest.mark.parametrize("least, top, size", [(10, 2000, 1 << 20), (2, 7, 40), (1, 2000, 1 << 20)])
def test_phrases_equal_plain_python(spark, least, top, size):
    rows = phrase_rows(least)
    docs = spark.createDataFrame([(i, lang, t, "clash", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, w1 string, n long")
    import echoscore.llm.collocations as module

    found = module.mined(docs.repartition(4), least=least, top=top).collect() if size == 1 << 20 else None
    if found is None:
        table = module.staged(module.blocks(docs.repartition(4), size=size), "blocks")
        terms = module.vocabulary(table, least)
        got = {(r["w1"], r["w2"], r["w3"]): r["a"] for r in module.phrases(module.grams(table, terms, least)).collect()}
        names = {r["id"]: (r["lang"], r["word"]) for r in terms.collect()}
        want = {(lang, p): a for lang, _, p, a, *_ in plain_phrases(rows, least, 10**9)}
        listed = {(names[w1][0], " ".join(names[w][1] for w in (w1, w2, w3) if w)): a for (w1, w2, w3), a in got.items()}
        assert want.items() <= listed.items() and sorted(names) == list(range(1, len(names) + 1))
        return
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r[c] for c in columns) for r in found) == plain_phrases(rows, least, top)


def test_triples_are_counted_over_cuts():
    rng = np.random.default_rng(2)
    line, ids = rng.integers(0, 6, 5000), np.array([0, 9, 4, 0, 7, 1 << 40])
    want = Counter()
    known = ids[line].tolist() + [0, 0]
    for x, y, z in zip(known, known[1:], known[2:]):
        if x and y:
            want[x, y, z] += 1
    for size in (1 << 20, 64):
        got = Counter()
        for parts in collocations.triples(line, ids, size):
            assert sorted(zip(*(p.tolist() for p in parts[:3]))) == list(zip(*(p.tolist() for p in parts[:3])))
            for *key, n in zip(*(p.tolist() for p in parts)):
                got[tuple(key)] += n
        assert got == want


def test_lockstep_over_cut_ranges():
    """A range that starts inside a word's and a pair's phrases gives what one pass over all gives."""
    rng = random.Random(8)
    keys = sorted({(rng.randint(1, 4), rng.randint(0, 4), 0) for _ in range(40)} | {(w, 0, 0) for w in range(1, 5)})
    keys = sorted(set(keys) | {(a, b, rng.randint(1, 6)) for a, b, _ in keys if b for _ in range(4)})
    k, f = np.array(keys).T, np.array([rng.randint(1, 99) for _ in keys])

    def rows(start, stop):
        heads = [(a, b, c, n) for (a, b, c), n in zip(keys[:start], f[:start].tolist())]
        word = next((h[3] for h in reversed(heads) if not h[1]), 0)
        pair = next(((h[0], h[1], h[3]) for h in reversed(heads) if h[1] and not h[2]), (0, 0, 0))
        own, n, first, two, more = collocations.lockstep(k[:, start:stop], f[start:stop], (word, *pair))
        return list(zip(*own.tolist(), n.tolist(), first.tolist(), two.tolist())), list(zip(*more.tolist()))

    plain = {key: n for key, n in zip(keys, f.tolist())}
    for cut in range(len(keys) + 1):
        (a, more), (b, more_) = rows(0, cut), rows(cut, len(keys))
        assert a + b == [(*key, plain[key], plain[key[0], 0, 0], plain[key[0], key[1], 0] if key[2] else 0) for key in keys if key[1]]
        longest = Counter()
        for x, y, _, n in more + more_:
            longest[x, y] = max(longest[x, y], n)
        want = Counter()
        for (x, y, z), n in plain.items():
            if z:
                want[x, y] = max(want[x, y], n)
        assert longest == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mined(empty).collect() == []
    assert collocations.mined(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).collect() == []
