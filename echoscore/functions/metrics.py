"""Edit counts and error rates of (reference, hypothesis) pairs."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# The functions below travel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EDIT_COUNTS = "word_edits int, ref_words int, char_edits int, ref_chars int"
#: Code points of the pairs that are taken apart into words and numbers at a time, and what a pair counts besides its own: however many
#: pairs a batch has, no more than these, or one pair that is longer, are held in that form (some 30 bytes a code point).
SLICE, PAIR = 1 << 20, 32


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences of hashable items.

    Myers' bit-vector recurrence in Hyyro's form: one column of the distance table is a pair of
    integers whose bits are the +1 / -1 steps, so a step costs one pass over len(a)/64 words
    instead of len(a) cells. Equal ends are cut off first; they never change the distance.
    """
    if a == b:
        return 0
    shorter = min(len(a), len(b))
    head = 0
    while head < shorter and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < shorter - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a  # the long side lives in the bits, the short side drives the loop

    where: dict = {}
    bit = 1
    for item in a:
        where[item] = where.get(item, 0) | bit
        bit <<= 1
    full = bit - 1
    up, down = full, 0
    for item in b:
        match = where.get(item, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        falling = (up & diagonal) << 1
        rising = ((down | ~(diagonal | up)) << 1) | 1
        up = (falling | ~(diagonal | rising)) & full
        down = rising & diagonal
    # the last column starts at len(b) and takes the remaining steps
    return len(b) + up.bit_count() - (down & full).bit_count()


#: Smallest group of pairs that are advanced together, the most 64-bit words of a long side there, and of all of a group.
TOGETHER, WIDEST, CELLS = 60, 60, 1 << 14
#: Number of different items up to which each pair has a row of bits for all of them.
SMALL = 128


class Sequences:
    """Many integer sequences end to end; ``first`` has the start of each and the total length."""

    def __init__(self, items: np.ndarray, lengths: np.ndarray):
        self.items, self.lengths = items, lengths
        self.first = np.concatenate([[0], np.cumsum(lengths)])

    def __getitem__(self, k: int) -> list[int]:
        return self.items[self.first[k] : self.first[k + 1]].tolist()

    def taken(self, chosen: np.ndarray) -> Sequences:
        n = self.lengths[chosen]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[chosen] - (ends - n), n)
        return Sequences(self.items[at], n)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The sequence of each item and its place there."""
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return owner, np.arange(len(self.items)) - self.first[owner]


def _columns(long: Sequences, short: Sequences, width: int) -> np.ndarray:
    """Distances of pairs whose long side fits ``width`` 64-bit words (at most WIDEST), short sides in descending length.

    The same recurrence as ``edit_distance`` over a matrix, a column per pair and a row per 64 rows of its table: a step advances every
    pair that still has items. Only the addition crosses words. Words that overflow by themselves and words that pass a carry on are
    collected as two bit sets per pair; adding the sets gives the carries into all its words at once.
    """
    count, alphabet = len(long.lengths), int(max(long.items.max(initial=0), short.items.max(initial=0))) + 1
    owner, place = long.places()
    # one row of bits per pair and item, and an empty one for items that its long side lacks
    row = owner * alphabet + long.items
    if alphabet <= SMALL:
        known = np.arange(count * alphabet)
    else:
        known, row = np.unique(row, return_inverse=True)
    masks = np.zeros((width, len(known) + 1), np.uint64)
    np.add.at(masks.reshape(-1), (place >> 6) * (len(known) + 1) + row, np.uint64(1) << (place & 63).astype(np.uint64))
    owner, place = short.places()
    keys = owner * alphabet + short.items
    at = keys if alphabet <= SMALL else np.minimum(np.searchsorted(known, keys), len(known) - 1)
    rows = np.full((int(short.lengths.max(initial=0)), count), len(known), np.int32)
    rows[place, owner] = np.where(known[at] == keys, at, len(known))
    one, top, full = np.uint64(1), np.uint64(63), ~np.uint64(0)
    up, down = np.full((width, count), full), np.zeros((width, count), np.uint64)
    weight = (one << np.arange(width, dtype=np.uint64))[:, None]
    shift = np.arange(width, dtype=np.uint64)[:, None]
    spare = [np.zeros((width, count), np.uint64) for _ in range(4)]
    for step, n in enumerate(np.searchsorted(-short.lengths, -np.arange(len(rows)), "left").tolist()):
        u, d = up[:, :n], down[:, :n]
        match, x, t, v = (s[:, :n] for s in spare)
        np.take(masks, rows[step, :n], axis=1, out=match, mode="clip")
        np.bitwise_or(match, d, out=v)
        np.bitwise_and(match, u, out=x)
        np.add(x, u, out=t)
        if width > 1:
            own = (np.less(t, u) * weight).sum(0, dtype=np.uint64)
            passed = (np.equal(t, full) * weight).sum(0, dtype=np.uint64) | own
            carried = (own + passed) ^ own ^ passed
            np.right_shift(carried, shift, out=x)
            np.bitwise_and(x, one, out=x)
            np.add(t, x, out=t)
        np.bitwise_xor(t, u, out=t)
        np.bitwise_or(t, match, out=t)  # the diagonal steps, in x those that rise, in t those that fall
        np.bitwise_or(t, u, out=x)
        np.invert(x, out=x)
        np.bitwise_or(x, d, out=x)
        np.bitwise_and(t, u, out=t)
        for bits, first in ((x, 1), (t, 0)):
            np.right_shift(bits, top, out=match)
            np.left_shift(bits, one, out=bits)
            np.bitwise_or(bits[1:], match[:-1], out=bits[1:])
            bits[0] |= np.uint64(first)
        np.bitwise_or(v, x, out=u)
        np.invert(u, out=u)
        np.bitwise_or(u, t, out=u)
        np.bitwise_and(x, v, out=d)
    # the last column starts at the short side's length and takes the remaining steps
    inside = np.clip(long.lengths[None, :] - 64 * np.arange(width)[:, None], 0, 64).astype(np.uint64)
    inside = np.where(inside == 64, full, (one << (inside & top)) - one)
    return short.lengths + (np.bitwise_count(up & inside).astype(int) - np.bitwise_count(down & inside)).sum(0)


def edit_distances(a: Sequences, b: Sequences) -> np.ndarray:
    """Levenshtein distances of pairs of integer sequences. Pairs of about equal lengths are advanced together, the rest one by one."""
    swap = a.lengths < b.lengths
    long, short = np.where(swap, b.lengths, a.lengths), np.where(swap, a.lengths, b.lengths)
    out = long.copy()  # right where the other side is empty
    words = -(-long // 64)
    # widths within a half of each other form a group
    step = np.maximum(1, 1 << np.maximum(0, np.floor(np.log2(np.maximum(words, 1))).astype(int) - 1))
    width = -(-words // step) * step
    left = np.flatnonzero(short > 0)
    left = left[np.lexsort((-short[left], width[left]))]
    for group in np.split(left, np.flatnonzero(np.diff(width[left])) + 1) if len(left) else []:
        size = max(TOGETHER, CELLS // int(width[group[0]]))
        for chosen in (group[k : k + size] for k in range(0, len(group), size)):
            if len(chosen) < TOGETHER or width[chosen[0]] > WIDEST:
                out[chosen] = [edit_distance(a[k], b[k]) for k in chosen.tolist()]
                continue
            sides = [s.taken(chosen) for s in (a, b)]
            turned = swap[chosen]
            both = Sequences(np.concatenate([s.items for s in sides]), np.concatenate([s.lengths for s in sides]))
            n = np.arange(len(chosen))
            out[chosen] = _columns(both.taken(np.where(turned, n + len(n), n)), both.taken(np.where(turned, n, n + len(n))), int(width[group[0]]))
    return out


_RUNS = re.compile(r"\s\s+")


def _split_words(text: str, word_sep: str) -> list[str]:
    return [w for w in _RUNS.sub(" ", text).strip().split(word_sep) if w]


def _characters(*sides: list[str]) -> list[Sequences]:
    """Code points, numbered by what occurs."""
    points = [np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) for texts in sides]
    used = np.zeros(0x110000, bool)
    for p in points:
        used[p] = True
    number = np.cumsum(used) - 1
    return [Sequences(number[p], np.array([len(t) for t in texts], int)) for p, texts in zip(points, sides)]


def _numbered(lists: list[list[str]], numbers: dict[str, int]) -> Sequences:
    items = [numbers.setdefault(w, len(numbers)) for words in lists for w in words]
    return Sequences(np.array(items, np.int64), np.array([len(words) for words in lists], int))


def _lengths(texts: Sequence[str] | pa.Array) -> np.ndarray:
    return np.asarray(pc.utf8_length(texts)) if isinstance(texts, pa.Array) else np.array([len(t) for t in texts], int)


def _taken(texts: Sequence[str] | pa.Array, chosen: np.ndarray) -> list[str]:
    return texts.take(pa.array(chosen)).to_pylist() if isinstance(texts, pa.Array) else [texts[k] for k in chosen.tolist()]


def _slices(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Places of all pairs by their lengths, those of about equal lengths together, about SLICE at a time."""
    order = np.lexsort((np.minimum(a, b), np.maximum(a, b)))
    ends = np.cumsum(a[order].astype(np.int64) + b[order] + PAIR)
    yield from np.split(order, np.flatnonzero(np.diff(ends // SLICE)) + 1)


def _counted(refs: list[str], hyps: list[str], word_sep: str) -> np.ndarray:
    out = np.zeros((len(refs), 4), int)
    ref_words = [_split_words(r, word_sep) for r in refs]
    out[:, 1], out[:, 3] = [len(w) for w in ref_words], [len(r) for r in refs]
    differ = [k for k, (r, h) in enumerate(zip(refs, hyps)) if r != h]
    if differ:
        numbers: dict[str, int] = {}
        rw = _numbered([ref_words[k] for k in differ], numbers)
        hw = _numbered([_split_words(hyps[k], word_sep) for k in differ], numbers)
        del ref_words
        out[differ, 0] = edit_distances(rw, hw)
        out[differ, 2] = edit_distances(*_characters(*([side[k] for k in differ] for side in (refs, hyps))))
    return out


def count_edits(refs: Sequence[str] | pa.Array, hyps: Sequence[str] | pa.Array, word_sep: str = " ") -> np.ndarray:
    """EDIT_COUNTS of each pair, one row each."""
    out = np.zeros((len(refs), 4), int)
    for chosen in _slices(_lengths(refs), _lengths(hyps)):
        out[chosen] = _counted(_taken(refs, chosen), _taken(hyps, chosen), word_sep)
    return out


def edit_counts(ref: Column, hyp: Column, word_sep: str = " ") -> Column:
    """Struct of EDIT_COUNTS for two already normalised texts.

    Words are the non-empty pieces between ``word_sep``; characters are code points. Runs in
    Arrow batches, slices of whose pairs are advanced together: the JVM's own ``levenshtein`` has no word form and fills len(a) x len(b) cells.
    """

    @F.arrow_udf(EDIT_COUNTS)
    def count(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        columns = count_edits(refs, hyps, word_sep).astype(np.int32).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["word_edits", "ref_words", "char_edits", "ref_chars"])

    return count(ref, hyp)


def rate(edits: Column, length: Column) -> Column:
    """edits / length, NULL for an empty reference. May exceed 1."""
    return F.try_divide(edits.cast("double"), length.cast("double"))
