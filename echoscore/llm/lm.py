"""Language-model scores by deleted interpolation.

P(w | context) = l0 / (V + 1) + l1 c(w) / N + l2 c(uw) / c(u) ... : maximum-likelihood estimates of all orders, mixed with
weights that depend on how often the longest context was seen (buckets by powers of two). The weights come from
expectation-maximisation on deleted counts: every training token is predicted from the counts without itself.

Counting. Documents are dealt into blocks of neighbouring rows, of about ``block_bytes`` of text. Each block lists its distinct
n-grams (64-bit hashes) with its own training counts, cut by hash range; each range is summed by one task of bounded
size; back to a block go the totals of those n-grams that other blocks have too. A block then knows the counts of
all its tokens. So a hot word is one entry per block, texts are shuffled once, and what moves grows with the
distinct n-grams of the blocks, in proportion to the input. The statistics that EM reads are sums over a grid of
(bucket, estimates in quarter powers of two), whose size does not depend on the input.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, A-Z folded; each text ends with one end token. NULL and empty texts
are that token alone. Rows that are not to be learned from are only scored; a table without training rows gives every
token 1 / (V + 1) with V = 0. Rows are neither merged nor lost, ids may be NULL or repeat. Blocks rely on row
order within the input's partitions, so ``docs`` should be read from files: two passes must see the same rows.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from echoscore.llm.words import combine, pieces, signed, word_hashes
from echoscore.sources.stage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 2
BLOCK_BYTES = 8 << 20
RANGE_TOKENS = 1_000_000
END = np.uint64(0xE0D0E0D0E0D0E0D1)
START = np.uint64(0x57A2757A2757A271)
BUCKETS = 40


def streams(hashes: np.ndarray, first: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the n-grams that end at each token, for n = 1 .. order, and the places where texts start."""
    n = len(first) - 1
    at = np.arange(n)
    tokens = np.empty(len(hashes) + n, np.uint64)
    tokens[np.arange(len(hashes)) + np.repeat(at, np.diff(first))] = hashes
    tokens[first[1:] + at] = END
    starts = first[:-1] + at
    levels = [tokens]
    for _ in range(1, order):
        context = np.empty_like(tokens)
        context[1:] = levels[-1][:-1]
        context[starts] = START
        levels.append(combine(context, tokens))
    return levels, starts


def _planes(values: np.ndarray) -> bytes:
    """64-bit values, equal bytes side by side, compressed."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _values(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _block_levels(texts: list[pa.Array], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of all tokens of a block, and the number of tokens of each text."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for column in texts:
        h, first = word_hashes(column)
        hashes.append(h)
        counts.append(np.diff(first))
    counts = np.concatenate(counts)
    levels, _ = streams(np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)]), order)
    return levels, counts + 1


def _own_counts(keys: np.ndarray, learned: np.ndarray, inverse: bool = False) -> tuple:
    """Distinct keys, how often each occurs in learned tokens, and the tokens' places among them."""
    if inverse:
        distinct, place = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(place[learned], minlength=len(distinct)).astype(np.uint64), place
    # as many zero counts as keys outside the learned texts
    distinct, counts = np.unique(keys[learned], return_counts=True)
    others = np.setdiff1d(keys[~learned], distinct)
    at = np.searchsorted(distinct, others)
    return np.insert(distinct, at, others), np.insert(counts.astype(np.uint64), at, np.uint64(0)), None


def _range_cuts(distinct: np.ndarray, bits: int) -> np.ndarray:
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct, bounds), [len(distinct)]])


def _listed(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """(level, range, block, keys, counts) of every block."""

    def rows(block: int, texts: list[pa.Array], learned: list[np.ndarray]) -> Iterator[tuple]:
        levels, sizes = _block_levels(texts, order)
        flags = np.repeat(np.concatenate(learned), sizes)
        for level, keys in enumerate(levels, 1):
            distinct, counts, _ = _own_counts(keys, flags)
            cuts = _range_cuts(distinct, bits).tolist()
            for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if b > a:
                    yield level, r, block, _planes(distinct[a:b]), _planes(counts[a:b])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["level", "range", "block", "keys", "counts"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

        def out(found: Iterator[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        now, texts, learned = None, [], []
        for batch in pieces(batches, "text"):
            blocks_ = batch.column("block").to_numpy()
            flags = batch.column("learn").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(blocks_)) + 1).tolist(), len(blocks_)]
            for a, b in zip(edges[:-1], edges[1:]):
                if texts and blocks_[a] != now:
                    yield out(rows(now, texts, learned))
                    texts, learned = [], []
                now = int(blocks_[a])
                texts.append(batch.column("text").slice(a, b - a))
                learned.append(flags[a:b])
        if texts:
            yield out(rows(now, texts, learned))

    return blocks.select("block", "text", "learn").mapInArrow(run, "level int, range long, block long, keys binary, counts binary")


SUMMED = "block long, level int, range long, changed binary, totals binary, tokens long, words long"


def _summed(listed: DataFrame) -> DataFrame:
    """(SUMMED): for each list, which of its n-grams another block has learned too (one bit each, in the list's order),
    and their totals; block NULL: a range's learned tokens and distinct words."""

    def run(table: pa.Table) -> pa.Table:
        level, part = table.column("level")[0].as_py(), table.column("range")[0].as_py()
        blocks = table.column("block").to_pylist()
        keys = [_values(k) for k in table.column("keys").to_pylist()]
        counts = [_values(c) for c in table.column("counts").to_pylist()]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        every = np.concatenate(counts)
        totals = np.zeros(len(distinct), np.uint64)
        np.add.at(totals, place, every)
        rows, at = [], 0
        for block, own, count in zip(blocks, keys, counts):
            total = totals[place[at : at + len(own)]]
            at += len(own)
            more = total != count
            if more.any():
                rows.append((block, level, part, zlib.compress(np.packbits(more).tobytes(), 1), _planes(total[more]), 0, 0))
        if level == 1:
            rows.append((None, level, part, None, None, int(totals.sum()), int((totals > 0).sum())))
        columns = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in SUMMED.split(", ")])

    return listed.groupBy("level", "range").applyInArrow(run, SUMMED)


COUNTED = "id long, held_out boolean, learn boolean, n_tokens long, n_known long, base_score double, counts binary"


def _counted(blocks: DataFrame, totals: DataFrame, order: int, bits: int, tokens: int, words: int) -> DataFrame:
    """(COUNTED) for every document: ``counts`` has its tokens' n-gram counts, one level after the other."""

    def run(docs: pa.Table, others: pa.Table) -> pa.Table:
        texts = [c for batch in pieces(docs.select(["text"]).to_batches(), "text") for c in [batch.column("text")]]
        levels, sizes = _block_levels(texts, order)
        learn = docs.column("learn").to_numpy()
        flags = np.repeat(learn, sizes)
        found = []
        for level, keys in enumerate(levels, 1):
            distinct, counts, place = _own_counts(keys, flags, True)
            cuts = _range_cuts(distinct, bits)
            for other, part, changed, t in zip(*(others.column(c).to_pylist() for c in ("level", "range", "changed", "totals"))):
                if other == level:
                    n = int(cuts[part + 1] - cuts[part])
                    marks = np.unpackbits(np.frombuffer(zlib.decompress(changed), np.uint8), count=n).astype(bool)
                    counts[cuts[part] : cuts[part + 1]][marks] = _values(t)
            found.append(counts[place])
        ends = np.cumsum(sizes)
        base = np.add.reduceat(np.log10((found[0] + 1.0) / (tokens + 1.0 * (words + 1))), ends - sizes) if len(ends) else np.zeros(0)
        known = np.add.reduceat((found[0] > 0).astype(np.int64), ends - sizes) if len(ends) else np.zeros(0, np.int64)
        packed = [_planes(np.concatenate([f[b - n : b] for f in found])) for n, b in zip(sizes.tolist(), ends.tolist())]
        columns = [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(packed, pa.binary())]
        return pa.table([docs.column("id"), docs.column("held_out"), docs.column("learn"), *columns], names=[c.split()[0] for c in COUNTED.split(", ")])

    wanted = blocks.groupBy("block").cogroup(totals.groupBy("block"))
    return wanted.applyInArrow(run, COUNTED)


def _estimates(counts: list[np.ndarray], firsts: np.ndarray, docs: int, tokens: int, words: int, deleted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and estimates (level, token). ``deleted`` takes each token's own occurrence out of all counts."""
    own = 1 if deleted else 0
    n = len(counts[0])
    out = np.empty((len(counts) + 1, n))
    out[0] = 1.0 / (words + 1)
    out[1] = (counts[0].astype(np.float64) - own) / max(1, tokens - own)
    context = np.zeros(n)
    for level in range(1, len(counts)):
        context = np.empty(n)
        context[1:] = counts[level - 1][:-1]
        context[firsts] = docs
        context -= own
        out[level + 1] = np.divide(counts[level].astype(np.float64) - own, context, out=np.zeros(n), where=context > 0)
    bucket = np.minimum(np.floor(np.log2(context + 1)).astype(np.int64), BUCKETS - 1)
    return bucket, out


def _levels(rows: list[tuple[bytes, int]], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    parts = [_values(c).reshape(order, n) for c, n in rows]
    sizes = np.array([n for _, n in rows], np.int64)
    counts = np.concatenate(parts, axis=1)
    return list(counts), np.cumsum(sizes) - sizes, sizes


def _grid(counted: DataFrame, order: int, docs: int, tokens: int, words: int) -> list[tuple[tuple[int, ...], int]]:
    """Training tokens by (bucket, estimates in quarter powers of two; 1 stands for an estimate of 0)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, ...], int] = {}
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                counts, firsts, _ = _levels(list(zip(part.column("counts").to_pylist(), part.column("n_tokens").to_pylist())), order)
                bucket, estimates = _estimates(counts, firsts, docs, tokens, words, True)
                with np.errstate(divide="ignore"):
                    steps = np.where(estimates[1:] > 0, np.round(4 * np.log2(estimates[1:])), 1).astype(np.int64)
                code = bucket
                for s in steps:
                    code = code * 256 + (s + 250)
                for cell, n in zip(*(x.tolist() for x in np.unique(code, return_counts=True))):
                    cells[cell] = cells.get(cell, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int64()), pa.array(list(cells.values()), pa.int64())], ["cell", "n"])

    found = counted.where("learn").select("counts", "n_tokens").mapInArrow(run, "cell long, n long")
    out = []
    for row in found.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cell, steps = row["cell"], []
        for _ in range(order):
            steps.append(cell % 256 - 250)
            cell //= 256
        out.append(((cell, *reversed(steps)), row["n"]))
    return out


def mixture(grid: list[tuple[tuple[int, ...], int]], order: int, words: int, rounds: int = 60) -> np.ndarray:
    """(bucket, level) weights by expectation-maximisation. A bucket without tokens takes its lower neighbour's."""
    weights = np.zeros((BUCKETS, order + 1))
    last = np.array([0.5, 0.5] + [0.0] * (order - 1))
    for bucket in range(BUCKETS):
        own = sorted((steps, n) for (b, *steps), n in grid if b == bucket)
        if own:
            n = np.array([n for _, n in own], float)
            p = np.array([[1 / (words + 1)] + [0.0 if s == 1 else 2.0 ** (s / 4) for s in steps] for steps, _ in own])
            # each level starts with the same weight; a level that never helps falls to nothing
            w = np.full(order + 1, 1 / (order + 1))
            for _ in range(rounds):
                share = p * w
                w = (n[:, None] * share / share.sum(1, keepdims=True)).sum(0) / n.sum()
                w = np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum()
            last = w
        weights[bucket] = last
    return weights


def scored(docs: DataFrame, learn, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; ``learn`` and
    ``held_out`` are conditions on ``docs``. ``base_score`` is the add-one unigram score. Runs jobs when called."""
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    sizes = narrow.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.col("learn").cast("long")), F.lit(0))).first()
    rows, size, learned = sizes
    # powers of two divide the numbers that Spark gives a partition's rows
    per_block = 1 << max(0, int(np.log2(max(1, block_bytes / max(1, size / max(1, rows))))))
    bits = max(0, int(np.ceil(np.log2(max(1, size / 6 / range_tokens)))))
    blocks = narrow.withColumn("block", F.floor(F.monotonically_increasing_id() / per_block).cast("long"))
    totals = staged(_summed(_listed(blocks, order, bits)), "totals")
    tokens, words = (int(x or 0) for x in totals.where("block is null").agg(F.sum("tokens"), F.sum("words")).first())
    counted = staged(_counted(blocks, totals.where("block is not null"), order, bits, tokens, words), "counted")
    weights = mixture(_grid(counted, order, learned, tokens, words), order, words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                counts, firsts, _ = _levels(list(zip(part.column("counts").to_pylist(), part.column("n_tokens").to_pylist())), order)
                bucket, estimates = _estimates(counts, firsts, learned, tokens, words, False)
                score = np.add.reduceat(np.log10((weights[bucket].T * estimates).sum(0)), firsts)
                keep = [part.column(c) for c in ("id", "held_out", "n_tokens", "n_known")]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array([tokens] * len(part), pa.int64()), part.column("base_score"), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return counted.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
