import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from echoscore.llm import packing
from echoscore.llm.words import BLANKS, PUNCTUATION, pieces, spans, text_bytes, word_hashes

TEXTS = ["", None, "a", " a  b\t\nc ", "é è x", "The the THE", "x" * 5000, "abcdefgh abcdefghi abcdefgh", "\x1c a\x85b", "日本 語"]


@pytest.mark.parametrize("table", [BLANKS, PUNCTUATION])
def test_spans_follow_the_word_rule(table):
    data, bounds = text_bytes(pa.array(TEXTS))
    starts, ends, first = spans(data, bounds, table)
    got = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    rule = re.compile(rb"[^\x20\x09-\x0D]+" if table is BLANKS else rb"[0-9A-Za-z\x80-\xff]+")
    want = [rule.findall((t or "").encode()) for t in TEXTS]
    assert got == [w for ws in want for w in ws]
    assert np.diff(first).tolist() == [len(w) for w in want]


def test_equal_words_and_only_they_share_a_hash():
    rng = random.Random(1)
    words = ["".join(rng.choice("abABé") for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    hashes, _ = word_hashes(pa.array(words))
    fold = [w.translate(str.maketrans("AB", "ab")) for w in words]
    assert len(set(hashes.tolist())) == len(set(fold))
    assert dict(zip(fold, hashes.tolist())) == {f: h for f, h in zip(fold, hashes.tolist())}


def test_pieces_keep_every_row_and_bound_their_bytes():
    texts = ["x" * n for n in (10, 0, 500, 30, 30, 30, 1000, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(pieces([batch.slice(0, 3), batch.slice(3)], "text", 100))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(len(p) == 1 or sum(map(len, p.column(0).to_pylist())) <= 100 for p in parts)


@pytest.mark.parametrize("seed", range(6))
def test_pack_places_every_token_once(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, rng.randint(1, 64), rng.randint(1, 400)]) for _ in range(rng.randint(0, 200))]
    placed = packing.pack(lengths, 64)
    for doc, n in enumerate(lengths):
        own = sorted((a, k) for d, a, k, _, _ in placed if d == doc)
        assert sum(k for _, k in own) == n and [a for a, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))]
    used = {}
    for _, _, k, s, offset in sorted(placed, key=lambda p: (p[3], p[4])):
        assert used.setdefault(s, 0) == offset and k > 0
        used[s] += k
    assert all(u <= 64 for u in used.values())
    assert sorted(used) == list(range(len(used))) and len(used) == -(-sum(lengths) // 64)


def test_pack_prefers_the_cheapest_sequence():
    # two of 40 open two sequences; of the pieces of 20, each goes to the cheaper one
    placed = packing.pack([40, 41, 20, 19], 64)
    assert {(d, s) for d, _, _, s, _ in placed if d < 2} == {(1, 0), (0, 1)}
    assert {(d, s) for d, _, _, s, _ in placed if d >= 2} == {(2, 1), (3, 0)}


def test_both_tokenizer_libraries_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [t or "" for t in TEXTS] + ["<|endoftext|> a<|endoftext|>", "it's 12  \n\n x", "\x00�😀"]
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [t.tolist() for t in packing.byte_bpe()(rows)] == [slow.encode(t, add_special_tokens=False).ids for t in rows]


def test_packed_rows(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 5), (3, "same id again", "x", 5), (3, "same id again", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, length int").repartition(3)
    encode = lambda texts: [np.frombuffer(t.encode(), np.uint8).astype(np.uint32) for t in texts]
    got = packing.packed(docs, lambda: encode, capacity=64, window=500).collect()
    texts = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc in {r[0] for r in rows}:
        streams = [np.append(encode([t or ""])[0], np.uint32(1)).astype("<u4") for i, t, *_ in rows if i == doc]
        assert sum(r["length"] for r in by_doc[doc]) == sum(map(len, streams))
        for r in by_doc[doc]:
            parts = [s[r["start"] : r["start"] + r["length"]] for s in streams if len(s) == r["doc_tokens"]]
            assert r["ids_crc32"] in {zlib.crc32(p.tobytes()) for p in parts}
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.setdefault(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 64 and texts
    empty = packing.packed(docs.limit(0), lambda: encode)
    assert empty.count() == 0


def test_very_long_runs_of_white_space(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 2_000_000, "a" + "\n" * 2_000_000 + " b<|endoftext|>", "x" * 200_000]
    want = [slow.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.packed(docs).collect()
    for i, ids in enumerate(want):
        parts = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in parts) == len(ids) == parts[0]["doc_tokens"]
        for r in parts:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
