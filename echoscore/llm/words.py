"""Words of whole Arrow batches as 64-bit hashes, without a Python object per word.

The word rule of all operators here: runs of bytes outside a separator table. UTF-8 never uses an
ASCII byte inside a longer character, so cutting bytes equals cutting code points.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes that end a word: space and \t \n \v \f \r.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
# Bytes that end a term: all of ASCII but letters and digits.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
# The first n bytes of a little-endian 64-bit load.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _K2
        h = (h ^ (h >> np.uint64(27))) * _K3
    return h ^ (h >> np.uint64(31))


def combine(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its head and of its last item."""
    with np.errstate(over="ignore"):
        return mix((h * _K1) ^ more)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        texts = batch.column(column)
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array (NULL: none) and each text's first place in them, plus the end."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def spans(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per text the number of its first word (plus the total)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge[1:] - 1] = inside[edge[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(texts: pa.Array, separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z folded, and per text the number of its first word.

    Words up to 8 bytes of one length never share a hash; longer ones do by chance only.
    """
    hashes, _, first = word_and_stem_hashes(texts, separators)
    return hashes, first


def word_and_stem_hashes(
    texts: pa.Array, separators: np.ndarray = BLANKS, stems: tuple[int, ...] = ()
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """As ``word_hashes``; also, for each length in ``stems`` (at most 8 bytes), the numbers of the words that
    are longer and the hashes of their first bytes."""
    data, bounds = text_bytes(texts)
    starts, ends, first = spans(data, bounds, separators)
    if not len(starts):
        return np.zeros(0, np.uint64), [], first
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(LOWER, data, out=padded[: len(data)])
    loads = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    left = ends - starts
    with np.errstate(over="ignore"):
        h = left.astype(np.uint64) * _K1
        h = mix(h ^ (loads[starts] & _FIRST[np.minimum(left, 8)]))
        at = np.flatnonzero(left > 8)
        place, rest = starts[at] + 8, left[at] - 8
        while len(at):
            h[at] = combine(h[at], loads[place] & _FIRST[np.minimum(rest, 8)])
            more = rest > 8
            at, place, rest = at[more], place[more] + 8, rest[more] - 8
        heads = []
        for n in stems:
            at = np.flatnonzero(left > n)
            heads.append((at, mix((loads[starts[at]] & _FIRST[n]) ^ mix(np.full(len(at), 256 + n, np.uint64)))))
    return h, heads, first


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
