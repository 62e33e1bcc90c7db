"""Alignment of two tokenizers over whole texts by products of sparse incidence matrices.

A text in UTF-8, with a space before it, is cut into tokens by both tokenizers. A and B are their token-byte incidence matrices: a row per token, a column
per byte, ones where the token covers the byte, as compressed rows built from the tokens' lengths. Gustavson's row products give A B^T: its
entries are the overlapping token pairs, its values the bytes they share. Byte offsets where tokens of both end cut the text into groups; the
token-group incidence matrices give, as P Q^T, the pairs that share a group (counted by row products without writing them out, as there can be many).

Texts of a batch are one block-diagonal matrix, multiplied in parts of about ``PART`` bytes between group borders. The corpus-wide
count of an id pair is the number of documents that hold it linked. Blocks of documents list their distinct pairs with document
counts; Spark sums them, and each block gets the totals of its own pairs back by a join. So a hot pair is one row per block,
texts are read and encoded once, and what is staged is a few bytes per link.

NULL and empty texts, and texts whose tokens' bytes differ from space and text, have no tokens: zeros and ''. Rows are neither
merged nor lost, whatever their ids; rows with equal texts count as documents each. Other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from echoscore.llm import bytepairs
from echoscore.llm.words import pieces
from echoscore.llm.worker import kept
from echoscore.sources.stage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART = 1 << 20
#: Links of a block, about.
BLOCK = 1 << 21
MARK = "▁"


class Rows(NamedTuple):
    """Compressed rows: the columns of row i are ``columns[starts[i]:starts[i + 1]]``. Without ``values`` all are 1."""

    starts: np.ndarray
    columns: np.ndarray
    width: int
    values: np.ndarray | None = None

    def transposed(self) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return Rows(starts, row[order], len(self.starts) - 1)


def product(a: Rows, b: Rows) -> Rows:
    """Row by row: the rows of ``b`` that a row of ``a`` has columns for are put together and equal columns added up."""
    sizes = np.diff(b.starts)[a.columns]
    ends = np.cumsum(sizes)
    # places in b of everything that is put together
    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(b.starts[a.columns] - (ends - sizes), sizes)
    row = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), sizes)
    keys = row * b.width + b.columns[take]
    if len(keys) and (keys[1:] < keys[:-1]).any():
        keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    row, column = np.divmod(keys[at], max(1, b.width))
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(a.starts) - 1))])
    return Rows(starts, column, b.width, np.diff(np.concatenate([at, [len(keys)]])))


def product_sizes(a: Rows, b: Rows) -> np.ndarray:
    """Entries of each row of ``product(a, b)`` where no two rows of ``b`` share a column."""
    total = np.concatenate([[0], np.cumsum(np.diff(b.starts)[a.columns])])
    return total[a.starts[1:]] - total[a.starts[:-1]]


def incidence(ends: np.ndarray, first: int, width: int) -> Rows:
    """Tokens that lie side by side from byte ``first`` on, by the bytes they end before."""
    return Rows(np.concatenate([[0], ends - first]), np.arange(width), width)


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, rank_path: str | None = None, json_path: str | None = None, piece_path: str | None = None):
        import sentencepiece

        if piece_path is None:
            import public_tokenizers

            piece_path = public_tokenizers.path("piece_bpe_32k.model")
        rank_path, json_path = bytepairs.paths(rank_path, json_path)
        self.encode_a = bytepairs.encoder(False, rank_path, json_path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.bytes_a = [b""] * (1 + max(found := bytepairs.ranks(rank_path).items(), key=lambda r: r[1])[1])
        for token, rank in found:
            self.bytes_a[rank] = token
        lib = self.library
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:-1], 16)]) if lib.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.sizes = [np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b)]
        self.n_a = len(self.bytes_a)
        # digits of ids with what follows them: inside and at the end of A's part, then of B's
        digits = [[str(i) for i in range(len(table))] for table in (self.bytes_a, self.bytes_b)]
        self.shown = [d + end for own, ends in zip(digits, (",|", ",;")) for end in ends for d in own]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none where the bytes differ."""
        none = np.zeros(0, np.int64)
        spaced = [" " + t for t in texts]
        out = []
        for text, a, b in zip(spaced, self.encode_a(spaced), self.library.encode(texts), strict=True):
            raw = text.encode()
            if len(raw) > 1 and b"".join([self.bytes_b[i] for i in b]) == raw and b"".join([self.bytes_a[i] for i in a.tolist()]) == raw:
                out.append((a.astype(np.int64), np.array(b, np.int64)))
            else:
                out.append((none, none))
        return out


class Aligned(NamedTuple):
    """Tokens, groups and links of a batch of texts; ``first_*`` have the first of each text, and the total."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    first_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    shared_bytes: np.ndarray
    first_link: np.ndarray
    group_links: np.ndarray


def aligned(encoded: list[tuple[np.ndarray, np.ndarray]], sizes: list[np.ndarray], part: int = PART) -> Aligned:
    none = [np.zeros(0, np.int64)]
    a, b = (np.concatenate(none + [e[k] for e in encoded]) for k in (0, 1))
    first_a, first_b = (np.concatenate([[0], np.cumsum([len(e[k]) for e in encoded])]).astype(np.int64) for k in (0, 1))
    ends_a, ends_b = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    total = int(ends_a[-1]) if len(a) else 0
    cuts = np.unique(np.concatenate([[0], common[np.searchsorted(common, np.arange(part, total, part))], [total]])).astype(np.int64)
    links, bytes_ = [np.zeros((2, 0), np.int64)], none[:]
    for start, stop in zip(cuts[:-1], cuts[1:]):
        (i, i_stop), (j, j_stop) = (np.searchsorted(e, [start, stop], "right") for e in (ends_a, ends_b))
        width = int(stop - start)
        found = product(incidence(ends_a[i:i_stop], start, width), incidence(ends_b[j:j_stop], start, width).transposed())
        row = np.repeat(np.arange(i, i_stop), np.diff(found.starts))
        links.append(np.stack([row, found.columns + j]))
        bytes_.append(found.values)
    link_a, link_b = np.concatenate(links, 1)
    first_link = np.searchsorted(link_a, first_a)
    first_group = np.concatenate([[0], group_a + 1])[first_a]
    in_a = Rows(np.arange(len(a) + 1), group_a, len(common))
    in_b = Rows(np.arange(len(b) + 1), group_b, len(common))
    shared = np.concatenate([[0], np.cumsum(product_sizes(in_a, in_b.transposed()))])
    return Aligned(a, b, first_a, first_b, group_a, group_b, first_group, link_a, link_b, np.concatenate(bytes_), first_link, np.diff(shared[first_a]))


def group_texts(x: Aligned, vocabularies: Vocabularies) -> list[str]:
    """Each text's groups as ids: ``a,a|b;a|b,b``."""
    n = len(x.a) + len(x.b)
    codes = np.zeros(n, np.int64)
    for ids, group, other, side, base, size in (
        (x.a, x.group_a, x.group_b, "left", 0, vocabularies.n_a),
        (x.b, x.group_b, x.group_a, "right", 2 * vocabularies.n_a, len(vocabularies.bytes_b)),
    ):
        last = np.ones(len(ids), bool)
        last[:-1] = group[1:] != group[:-1]
        codes[np.arange(len(ids)) + np.searchsorted(other, group, side)] = base + ids + size * last
    shown, first = vocabularies.shown, (x.first_a + x.first_b).tolist()
    return ["".join([shown[c] for c in codes[i:j].tolist()])[:-1] for i, j in zip(first[:-1], first[1:])]


def _packed(numbers: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


#: Columns of each document that need no other document.
OWN = ("id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256")
BLOCKS = (
    "block long, a array<int>, b array<int>, docs array<long>, id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "n_group_links array<long>, groups_sha256 array<string>, entries array<long>, size long, pairs binary, times binary"
)


class _Block:
    """Documents that wait to be written together."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.entries: list[int] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.links = 0

    def add(self, ids: list, x: Aligned, texts: list[str]) -> None:
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
        per_text = (np.diff(f).tolist() for f in (x.first_a, x.first_b, x.first_group, x.first_link))
        self.rows += zip(ids, *per_text, x.group_links.tolist(), digests, strict=True)
        pairs, place = np.unique(x.a[x.link_a] << 32 | x.b[x.link_b], return_inverse=True)
        text = np.repeat(np.arange(len(ids)), np.diff(x.first_link))
        each, times = np.unique(text * max(1, len(pairs)) + place, return_counts=True)
        text, place = np.divmod(each, max(1, len(pairs)))
        self.entries += np.bincount(text, minlength=len(ids)).tolist()
        self.keys.append(pairs[place])
        self.times.append(times)
        self.links += len(x.link_a)

    def batch(self, block: int) -> pa.RecordBatch:
        keys = np.concatenate(self.keys)
        pairs, place, docs = np.unique(keys, return_inverse=True, return_counts=True)
        listed = {"a": (pairs >> 32).astype(np.int32), "b": (pairs & 0xFFFFFFFF).astype(np.int32), "docs": docs}
        own = dict(zip(OWN, zip(*self.rows)))
        columns = {"block": [block]} | {k: [v] for k, v in listed.items()} | {k: [list(v)] for k, v in own.items()}
        columns |= {"entries": [self.entries], "size": [len(keys)], "pairs": [_packed(place)], "times": [_packed(np.concatenate(self.times))]}
        kinds = {"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "groups_sha256": pa.list_(pa.string()), "pairs": pa.binary(), "times": pa.binary()}
        plain = {"block", "size"}
        arrays = [pa.array(v, kinds.get(k) or (pa.int64() if k in plain else pa.list_(pa.int64()))) for k, v in columns.items()]
        return pa.RecordBatch.from_arrays(arrays, list(columns))


def blocks(docs: DataFrame, id_col: str, text_col: str, tokenizers: tuple[str | None, str | None, str | None], size: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = TaskContext.get().partitionId() << 33
        vocabularies = kept(("alignment", tokenizers), lambda: Vocabularies(*tokenizers))
        waiting = _Block()
        for batch in pieces(batches, "text", PART):
            x = aligned(vocabularies.encode([t or "" for t in batch.column("text").to_pylist()]), vocabularies.sizes)
            waiting.add(batch.column("id").to_pylist(), x, group_texts(x, vocabularies))
            if waiting.links >= size:
                yield waiting.batch(following)
                following, waiting = following + 1, _Block()
        if waiting.rows:
            yield waiting.batch(following)

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, BLOCKS)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str | None, str | None, str | None] = (None, None, None)) -> DataFrame:
    """One row per overlapping token pair: (id, a_place, b_place, a, b, shared_bytes, group). Pairs that share a group are those that agree on
    (id, group)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = kept(("alignment", tokenizers), lambda: Vocabularies(*tokenizers))
        for batch in pieces(batches, "text", PART):
            x = aligned(vocabularies.encode([t or "" for t in batch.column("text").to_pylist()]), vocabularies.sizes)
            text = np.repeat(np.arange(len(batch)), np.diff(x.first_link))
            columns = [batch.column("id").take(pa.array(text)), x.link_a - x.first_a[text], x.link_b - x.first_b[text], x.a[x.link_a], x.b[x.link_b], x.shared_bytes]
            columns.append(x.group_a[x.link_a] - x.first_group[text])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "a_place", "b_place", "a", "b", "shared_bytes", "group"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, "id long, a_place long, b_place long, a long, b long, shared_bytes long, `group` long")


def pair_counts(table: DataFrame) -> DataFrame:
    """(a, b, n, best): documents that hold the pair linked, and whether no pair of its A id is in more."""
    listed = table.select(F.inline(F.arrays_zip("a", "b", "docs")))
    counts = listed.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    # an A id meets at most as many B ids as there are
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    tokenizers: tuple[str | None, str | None, str | None] = (None, None, None), size: int = BLOCK,
) -> DataFrame:
    """One row per document: OWN, n_best, count_sum. ``tokenizers`` are the paths of A's ranks and JSON and of B's model."""
    table = staged(blocks(docs, id_col, text_col, tokenizers, size), "alignment")
    listed = table.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "pair")).select("block", "pos", "pair.a", "pair.b")
    totals = (
        listed.join(pair_counts(table), ["a", "b"]).groupBy("block")
        .agg(F.collect_list(F.struct("pos", "n", "best")).alias("totals"))
    )
    names = [*OWN, "n_best", "count_sum"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                n = row["size"].as_py()
                pairs, times = (_unpacked(row[c].as_py(), n) for c in ("pairs", "times"))
                count, best = np.zeros((2, row["n_pairs"].as_py()), np.int64)
                if row["totals"].is_valid:
                    found = row["totals"].values.flatten()
                    count[np.asarray(found[0])], best[np.asarray(found[0])] = np.asarray(found[1]), found[2].to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.cumsum(np.asarray(row["entries"].values))])
                sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[pairs])])[first]) for x in (best, count)]
                yield pa.RecordBatch.from_arrays([row[c].values for c in OWN] + [pa.array(s) for s in sums], names)

    whole = table.select("block", F.size("a").alias("n_pairs"), *OWN, "entries", "size", "pairs", "times").join(totals, "block", "left").drop("block")
    return whole.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names))
