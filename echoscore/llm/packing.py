"""Cost-balanced packing of documents into training sequences of a fixed token capacity.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention inside the piece). Every task packs its own rows in
windows of a bounded number of tokens: full sequences are cut off long documents first; the rest go, largest first, to
the cheapest of ceil(tokens / capacity) sequences that can still hold them. What fits nowhere whole fills the
cheapest sequences with room, so a window pads less than one sequence and nothing is shuffled. Sequence ids hold
the partition's number, so a task that runs again gives the same rows.

Texts that are NULL count as empty: one end token. Rows with equal or NULL ids are packed each for itself; any
other columns are ignored. An empty table gives no rows. A document longer than a window is a window of its own.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from echoscore.llm import bytepairs
from echoscore.llm.words import pieces
from echoscore.llm.worker import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
WINDOW = 4_000_000
END = 1
#: Cost of a token and of a pair of tokens: with 4096-wide layers, attention equals the rest at some 24,000 tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / 24_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"
)


def byte_bpe(path: str | None = None) -> Callable[[list[str]], list[np.ndarray]]:
    """Encoder for the byte-level vocabulary, whose end-of-text string is an id of its own inside texts."""
    return bytepairs.encoder(True, path)


def cost(n: float, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def pack(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for one window of documents."""
    out, rest, full = [], [], 0
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((doc, k * capacity, capacity, full + k, 0))
        full += whole
        if n > whole * capacity:
            rest.append((n - whole * capacity, doc, whole * capacity))
    rest.sort(key=lambda r: (-r[0], r[1]))
    count = -(-sum(r[0] for r in rest) // capacity)
    # Sequences by cost. One that lacks room for a piece has it for none that is as long, so it waits in ``tight``.
    open_, tight = [(0.0, s, 0) for s in range(full, full + count)], []
    cut = []
    for n, doc, start in rest:
        # shorter pieces may fit where longer ones did not
        while tight and -tight[0][0] >= n:
            heapq.heappush(open_, heapq.heappop(tight)[1:])
        while open_ and open_[0][2] + n > capacity:
            heapq.heappush(tight, (open_[0][2] - capacity, *heapq.heappop(open_)))
        if not open_:
            cut.append((n, doc, start))
            continue
        so_far, s, used = heapq.heappop(open_)
        out.append((doc, start, n, s, used))
        heapq.heappush(open_, (so_far + cost(n, linear, quadratic), s, used + n))
    room = sorted([t[1:] for t in tight] + open_)
    at = 0
    for n, doc, start in cut:
        while n:
            so_far, s, used = room[at]
            take = min(n, capacity - used)
            if take:
                out.append((doc, start, take, s, used))
                room[at] = (so_far + cost(take, linear, quadratic), s, used + take)
                n, start = n - take, start + take
            if room[at][2] == capacity:
                at += 1
    return out


def _rows(ids: list, tokens: list[np.ndarray], first: int, capacity: int, linear: float, quadratic: float) -> tuple[pa.RecordBatch, int]:
    placed = pack([len(t) for t in tokens], capacity, linear, quadratic)
    costs: dict[int, float] = {}
    for _, _, n, s, _ in placed:
        costs[s] = costs.get(s, 0.0) + cost(n, linear, quadratic)
    columns = [
        [ids[d] for d, *_ in placed],
        [a for _, a, *_ in placed],
        [n for _, _, n, *_ in placed],
        [zlib.crc32(tokens[d][a : a + n].astype("<u4").tobytes()) for d, a, n, *_ in placed],
        [len(tokens[d]) for d, *_ in placed],
        [first + s for *_, s, _ in placed],
        [o for *_, o in placed],
    ]
    batch = [pa.array(c, pa.int64()) for c in columns] + [pa.array([costs[s] for *_, s, _ in placed], pa.float64())]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(batch, names), first + len(costs)


def packed(
    docs: DataFrame,
    encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]] = byte_bpe,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    window: int = WINDOW,
    end: int = END,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row per piece (SCHEMA). ``encoder`` is built once in each task, the usual one once in each worker."""
    usual = encoder is byte_bpe

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept("packing", encoder) if usual else encoder()
        following = TaskContext.get().partitionId() << 33
        ids, tokens, total = [], [], 0
        for batch in pieces(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, t in zip(batch.column("id").to_pylist(), encode(texts), strict=True):
                t = np.append(t, np.uint32(end))
                if tokens and total + len(t) > window:
                    out, following = _rows(ids, tokens, following, capacity, linear, quadratic)
                    yield out
                    ids, tokens, total = [], [], 0
                ids.append(doc)
                tokens.append(t)
                total += len(t)
        if tokens:
            yield _rows(ids, tokens, following, capacity, linear, quadratic)[0]

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
