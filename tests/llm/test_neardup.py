import random

import pytest

from echoscore.llm import components, neardup


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(doc, ids.get(find(i), doc))
    return [(doc, len(sets[i]), ids.get(find(i))) for i, (doc, _) in enumerate(rows)]


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(seed):
    """Groups of copies with few and many changes, chains, a passage that many share, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 60, 70, 150, 400, 900]))]
        texts.append(base)
        texts += [changed(rng, base, rng.randint(0, max(1, len(base) // 40))) for _ in range(rng.randint(0, 12))]
        for _ in range(4):
            base = changed(rng, base, max(1, len(base) // 60))
            texts.append(base)
    texts += [passage + [rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 8, 15, 60]))] for _ in range(50)]
    texts = [" ".join(t) for t in texts] + ["", None, " \n", "a b", "A  b", "a b c", texts[0][0], "x" * 3000 + " tail"]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    return rows + [rows[3], rows[3], (rows[5][0], "another text under the same id here"), (None, rows[7][1]), (None, "only a null id has this text"), (None, max((t or "" for t in texts), key=len) + " end")]


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, node int, label string")
    got = neardup.near_duplicates(docs).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_distinct_documents(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " more", "b"), (3, "alone", "c"), (None, "null id", "d"), (4, None, None), (5, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = neardup.distinct_documents(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {rows[0], rows[3], rows[4], rows[5], rows[6]} and out.count() == 5


def test_one_document_of_a_group_without_or_with_repeated_ids_stays(spark):
    """Every different text stayed once where all ids of a group are NULL or the same."""
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in "abc"]
    rows = [(None, texts[0] + end) for end in ("", " x", " y")] + [(7, texts[1] + end) for end in ("", " x", " y")] + [(7, texts[2]), (None, None), (None, ""), (7, None)]
    out = neardup.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = [(r["doc_id"], (r["text"] or "")[:2]) for r in out]
    assert sorted(left, key=str) == sorted([(None, "a0"), (7, "b0"), (7, "c0"), (None, ""), (None, ""), (7, "")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == 0 and neardup.distinct_documents(docs).count() == 0


def test_components(spark):
    links = [(1, 1), (None, 2)] + [(i, i + 1) for i in range(10, 70)] + [(100, i) for i in range(101, 140)] + [(150, 151), (152, 151), (151, 150)]
    want = {n: 10 for n in range(10, 71)} | {n: 100 for n in range(100, 140)} | {n: 150 for n in (150, 151, 152)}
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want
    assert components.components(spark.createDataFrame(links[:2], "a long, b long")).count() == 0


def test_documents_of_one_template_do_not_meet_pairwise(spark, monkeypatch):
    """Sets of 400 shingles of which 355 are shared by all: 80 %, no links. Comparisons grow with the documents, not with their pairs."""
    template = [f"t{i}" for i in range(359)]
    compared = {}
    for n in (60, 180):
        docs = spark.createDataFrame([(i, " ".join(template + [f"d{i}x{k}" for k in range(45)])) for i in range(n)], "doc_id long, text string")
        counts = []

        def counting(df, purpose, plain=neardup.staged):
            out = plain(df, purpose)
            if purpose == "pairs":
                counts.append(out.count())
            return out

        with monkeypatch.context() as m:
            m.setattr(neardup, "staged", counting)
            found = neardup.near_duplicates(docs).collect()
        assert len(found) == n and all(r["kept"] and r["n_shingles"] == 400 for r in found)
        compared[n] = sum(counts)
    assert all(c <= 3 * n for n, c in compared.items()), compared
