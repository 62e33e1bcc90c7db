"""Tokenizer alignment against loops over bytes."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from echoscore.llm import alignment, bytepairs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_level(token):
    """The bytes that a token of the JSON vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return bytes(names[c] for c in token)


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(texts, tools):
    """Rows of the query, from every pair of tokens."""
    a_tool, b_tool = tools
    docs = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        a, b = a_tool.encode(" " + (t or ""), add_special_tokens=False).ids, b_tool.encode(t or "")
        a_bytes = [byte_level(a_tool.id_to_token(i)) for i in a]
        names = [b_tool.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(n[3:-1], 16)]) if b_tool.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
        if not t or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            docs.append(([], [], [], []))
            continue
        sa, sb = spans(a_bytes), spans(b_bytes)
        links = [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([i for i, s in zip(a, sa) if lo <= s[0] < hi], [i for i, s in zip(b, sb) if lo <= s[0] < hi]) for lo, hi in zip([0, *cuts], cuts)]
        docs.append((a, b, [(a[i], b[j]) for i, j in links], groups))
    count = Counter(p for d in docs for p in set(d[2]))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    rows = []
    for a, b, links, groups in docs:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((
            len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if text else "", sum(len(x) * len(y) for x, y in groups),
        ))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "  ", "a", "\n", "Grüße, 日本語 texts!", "mark ▁ inside", "<|endoftext|> and </s> <s> <unk> <0x41>", "é" * 40, "\x00\x01 ퟿", "a  b   c\t\n\n d ", " lead"]
    words = ["the", "of", "re", "token", "isation", "ß", "naïve", "12345", "don't", "...", "　", "🙂", "x" * 30]
    return out + ["".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]


def test_equals_loops_over_all_pairs(spark, tools):
    rows = [(i if i % 9 else None, t, "clash", 1) for i, t in enumerate(texts())] + [(3, "again the same", "x", 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, n long").repartition(3)
    want = Counter(zip([r[0] for r in rows], plain([r[1] for r in rows], tools)))
    # small blocks, so that pair totals come from many
    for size in (50, 1 << 21):
        got = Counter((r["id"], tuple(r[c] for c in COLUMNS)) for r in alignment.digests(docs, size=size).collect())
        assert got == want
    assert alignment.digests(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not available")
def test_query_equals_loops(spark, tools):
    from echoscore.llm import queries
    from echoscore.sources.readers import table

    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    rows = [r for r in rows if len(r[1] or "") < 3000]  # the loops take the product of both lengths
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: tuple(r[c] for c in COLUMNS) for r in alignment.digests(docs).collect()}
    assert got == dict(zip([r[0] for r in rows], plain([r[1] for r in rows], tools))) and len(rows) > 100
    whole = {r["doc_id"]: (r["n_a"], r["n_links"], r["groups_sha256"]) for r in queries.QUERIES["op13_alignment"](spark, SF).collect()}
    assert all(whole[i] == (g[0], g[3], g[6]) for i, g in got.items())


def test_links_list_shared_bytes(spark, tools):
    docs = spark.createDataFrame([(7, "naïve tokenisation"), (None, None)], "doc_id long, text string")
    found = alignment.links(docs).collect()
    a = tools[0].encode(" naïve tokenisation", add_special_tokens=False).ids
    assert sum(r["shared_bytes"] for r in found) == len(" naïve tokenisation".encode()) and {r["id"] for r in found} == {7}
    assert [a[r["a_place"]] for r in found] == [r["a"] for r in found]


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)

    def rows(m):
        return alignment.Rows(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])

    for _ in range(50):
        n, k, m = rng.integers(1, 9, 3)
        x, y = (rng.random(s) < 0.3 for s in ((n, k), (k, m)))
        got = alignment.product(rows(x), rows(y))
        dense = np.zeros((n, m), int)
        dense[np.repeat(np.arange(n), np.diff(got.starts)), got.columns] = got.values
        assert (dense == x.astype(int) @ y.astype(int)).all()
        back = rows(x).transposed()
        assert (np.diff(back.starts) == x.sum(0)).all()
        one = np.zeros((k, m), bool)
        one[np.arange(k), rng.integers(0, m, k)] = True
        each = rows(np.eye(k, dtype=bool)[rng.permutation(k)])
        assert (alignment.product_sizes(each, rows(one)) == np.diff(alignment.product(each, rows(one)).starts)).all()


def test_parts_do_not_change_the_links(tools):
    vocabularies = alignment.Vocabularies()
    encoded = vocabularies.encode([t or "" for t in texts()] * 3)
    whole, cut = (alignment.aligned(encoded, vocabularies.sizes, part) for part in (1 << 20, 7))
    assert all(np.array_equal(x, y) for x, y in zip(whole, cut))
    assert (whole.group_a[whole.link_a] == whole.group_b[whole.link_b]).all()


@pytest.mark.parametrize("text", [" " * 1_200_000, "\n" * 1_200_000 + "x", "a" * 300_000, "b " + " \t" * 600_000 + " c"])
def test_long_runs_have_the_ids_of_the_slow_form(tools, text):
    assert bytepairs.encoder(False)([text])[0].tolist() == tools[0].encode(text, add_special_tokens=False).ids
