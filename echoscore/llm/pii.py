"""Personal data in texts: fixed patterns, plus a semi-Markov conditional random field.

A text is read around its anchors (digits and @): 160 characters on both sides, overlapping pieces joined, cut into tokens (runs of
letters, runs of digits, single other characters). A segmentation covers a piece with entities of at most 24 tokens and
single tokens outside; its score sums whole-span features (digit count and grouping, dots, @, checksum, length, neighbours)
with weights per type. Dynamic programming over (end, length, type) chooses boundaries and types together.

Weights maximise the likelihood of a bounded sample: at most ``max_pieces`` pieces of some ``max_docs`` documents chosen by a
hash of the id, segmented by the pattern matches; gradients come from the forward and backward sums of the same
program. ``findings`` gives every text's spans: pattern matches always, and decoded entities that touch no match, with
the same kinds. NULL and empty texts have none; rows are neither merged nor lost; whole texts are read. Time grows with their
digits (up to 24 spans for each token near one: some two minutes for a MB of nothing but short numbers), memory by an entry per token.
Other columns are not looked at; an empty table gives no rows. One pass, no shuffle, a model of fixed size.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"
MAX_DOCS, MAX_PIECES = 20_000, 300
REACH, LONGEST = 160, 24
#: First tokens whose spans are held at a time.
TOKENS = 2048

# The base patterns. Possessive runs and the look-behind change no match, they only keep long
# digit runs linear: a match can only start where a run starts.
EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match begins where the run of name characters before an @ begins, so look left from each @."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_LEFT.match(text[start - 1]):
            start -= 1
        m = EMAIL_RIGHT.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def pieces(text: str) -> list[tuple[int, int]]:
    """The parts of a text that can hold entities."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _tokens(text: str, a: int, b: int) -> np.ndarray:
    """Token starts, and ``b``."""
    return np.array([m.start() for m in TOKEN.finditer(text, a, b)] + [b])


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def features(span: str, left: str, right: str) -> list[int]:
    """Numbers of the whole-span features that hold; ``left`` and ``right`` are up to two characters beside the span."""
    goes_on = right[:1] == "." and _alnum(right[1:])
    left, right = left[-1:], right[:1]
    digits = _digits(span)
    n, dots = len(digits), span.count(".")
    local, at, domain = span.partition("@")
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    numeric = not re.search(r"[A-Za-z@]", span)
    out = [0]
    if at:
        out.append(1 if local and "." in domain.strip(".") and domain[-1:].isalnum() and not re.search(r"[^A-Za-z0-9.-]", domain) else 2)
        out.append(3 if re.fullmatch(r"[A-Za-z0-9._%+-]+", local) else 4)
    if numeric and n:
        out.append(5 + min(n // 2, 10))
        out.append(16 + min(len(groups), 6))
        if dots == 3 and len(groups) == 4:
            out.append(23 if all(len(g) < 4 and int(g) < 256 for g in span.split(".") if g) and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span) else 24)
        if 12 <= n <= 19:
            out.append(25 if luhn(digits) else 26)
        if re.fullmatch(r"[0-9]+([\x20-][0-9]+)*", span):
            out.append(27)
    if span[0] == "+":
        out.append(28)
    if re.search(r"\([0-9]+\)", span):
        out.append(29)
    if n and not numeric and not at:
        out.append(30)
    out.append(31 if _alnum(left) else 32)
    out.append(33 if _alnum(right) else 34)
    if left in "._%+-@" and left:
        out.append(35)
    if right in "@-" and right:
        out.append(36)
    if re.search(r"[\x20]{2}|[\n\t,;:]", span):
        out.append(37)
    if not numeric and " " in span:
        out.append(38)
    if goes_on:
        out.append(40)
    if not (_alnum(span[-1]) and (_alnum(span[0]) or span[0] in "+(")):
        out.append(39)
    return out


FEATURES = 41


def segments(text: str, starts: np.ndarray, first: int = 0, last: int | None = None) -> list[tuple[int, int, list[int]]]:
    """(first token, end token, features) of all spans that may be entities: of bounded length, holding a digit or
    an @, and not ending in a blank. ``first`` and ``last`` bound the first tokens."""
    out = []
    n = len(starts) - 1
    last = n if last is None else last
    kind = {i: text[starts[i]] for i in range(first, min(n, last + LONGEST))}
    anchor = dict(zip(range(first, first + len(kind) + 1), np.cumsum([0] + [c == "@" or "0" <= c <= "9" for c in kind.values()]).tolist()))
    for i in range(first, last):
        if not (_alnum(kind[i]) or kind[i] in "+("):
            continue
        if anchor[min(n, i + LONGEST)] == anchor[i]:
            continue
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            if kind[j - 1] in "\n\t":
                break
            if anchor[j] > anchor[i] and _alnum(kind[j - 1]):
                a, b = int(starts[i]), int(starts[j])
                out.append((i, j, features(text[a:b], text[max(0, a - 2) : a], text[b : b + 2])))
    return out


def _scores(found: list[tuple[int, int, list[int]]], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[:, f].sum(1) for _, _, f in found]).reshape(-1, len(KINDS))


def decode(found: list[tuple[int, int, list[int]]], n: int, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's entities as (first token, end token, kind); tokens outside score 0."""
    return _decoded([(n, found)], n, weights)


def decode_text(text: str, starts: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """``decode`` of all spans of a text, which are made for ``TOKENS`` first tokens at a time."""
    n = len(starts) - 1
    lasts = [min(n, first + TOKENS) for first in range(0, n, TOKENS)]
    return _decoded(((last, segments(text, starts, first, last)) for first, last in zip(range(0, n, TOKENS), lasts)), n, weights)


def _decoded(parts: Iterable[tuple[int, list[tuple[int, int, list[int]]]]], n: int, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """``parts``: spans by first token, each part up to a token. They are scored part by part and go into the table where they end; only those
    above 0 stay until then, as a span below 0 loses to its tokens outside. So beside the table, an entry per token, nothing grows with the text."""
    best, begin, kind = np.zeros(n + 1), np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int8)
    waiting: dict[int, list[tuple[int, float, int]]] = {}
    done = 0
    for last, found in parts:
        if found:
            scores = _scores(found, weights)
            top, which = scores.max(1), scores.argmax(1)
            for s in np.flatnonzero(top > 0).tolist():
                waiting.setdefault(found[s][1], []).append((found[s][0], float(top[s]), int(which[s])))
        # spans that begin later end later
        for j in range(done + 1, last + 1):
            best[j] = best[j - 1]
            for i, score, k in waiting.pop(j, ()):
                if best[i] + score > best[j]:
                    best[j], begin[j], kind[j] = best[i] + score, i, k
        done = last
    out, j = [], n
    while j > 0:
        if begin[j] >= 0:
            out.append((int(begin[j]), j, int(kind[j])))
            j = int(begin[j])
        else:
            j -= 1
    return out[::-1]


def _gradient(found, n: int, gold: set[tuple[int, int, int]], weights: np.ndarray) -> np.ndarray:
    """Features of the gold segmentation minus those expected under the model."""
    scores = np.exp(np.clip(_scores(found, weights), -30, 30))
    ends, begins = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for s, (i, j, _) in enumerate(found):
        ends[j].append(s)
        begins[i].append(s)
    total = scores.sum(1)
    # each step is divided by its own size, so that long pieces neither overflow nor vanish
    ahead, log = np.zeros(n + 1), 0.0
    ahead[0] = 1.0
    scale = np.zeros(n + 1)
    for j in range(1, n + 1):
        value = ahead[j - 1] + sum(ahead[found[s][0]] * np.exp(scale[found[s][0]] - scale[j - 1]) * total[s] for s in ends[j])
        scale[j] = scale[j - 1] + np.log(value)
        ahead[j] = 1.0
    back = np.zeros(n + 1)  # logs
    for i in range(n - 1, -1, -1):
        terms = [back[i + 1]] + [np.log(total[s]) + back[found[s][1]] for s in begins[i]]
        top = max(terms)
        back[i] = top + np.log(sum(np.exp(t - top) for t in terms))
    log = back[0]
    grad = np.zeros_like(weights)
    for s, (i, j, f) in enumerate(found):
        inside = np.exp(scale[i] + back[j] - log) * scores[s]
        for k in range(len(KINDS)):
            grad[k, f] += (1.0 if (i, j, k) in gold else 0.0) - inside[k]
    return grad


def train(texts: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-3) -> np.ndarray:
    """Weights from (text, pattern matches). Entities that cross token borders or exceed the bound are left out."""
    weights = np.zeros((len(KINDS), FEATURES))
    weights[:, 0] = -3.0
    squares = np.full_like(weights, 1e-2)
    cases = []
    for text, base in texts:
        starts = _tokens(text, 0, len(text))
        place = {int(s): i for i, s in enumerate(starts)}
        gold, end = set(), 0
        for kind, a, b in sorted(base, key=lambda s: (s[1], KINDS.index(s[0]))):
            if a >= end and a in place and b in place and place[b] - place[a] <= LONGEST:
                gold.add((place[a], place[b], KINDS.index(kind)))
                end = b
        cases.append((segments(text, starts), len(starts) - 1, gold))
    for _ in range(epochs):
        for found, n, gold in cases:
            if found:
                grad = _gradient(found, n, gold, weights) - decay * weights
                squares += grad * grad
                weights += rate * grad / np.sqrt(squares)
    return weights


def _window(text: str, m: re.Match) -> str:
    return text[max(0, m.start() - 60) : m.end() + 60]


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_pieces: int = MAX_PIECES) -> np.ndarray:
    """``docs`` (id, text). At most ``max_pieces`` short pieces of some ``max_docs`` documents reach the driver, at
    most half of them without a match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            out = []
            for text in texts.filter(pc.match_substring_regex(texts, "[0-9@]").fill_null(False)).to_pylist():
                end = 0
                for m in ANCHOR.finditer(text):
                    if m.start() >= end:
                        out.append(_window(text, m))
                        end = m.end() + 60
            out = list(dict.fromkeys(out))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([bool(base_spans(p)) for p in out], pa.bool_())], ["piece", "matched"])

    total = docs.count()
    share = min(1.0, max_docs / max(1, total))
    order = F.pmod(F.xxhash64(F.lit("pii"), "id"), F.lit(1_000_003))
    chosen = docs.where(F.col("id").isNotNull() & (order <= int(share * 1_000_003))).select("text")
    found = chosen.mapInArrow(run, "piece string, matched boolean").distinct()
    halves = [found.where(c).orderBy(F.xxhash64("piece"), "piece").limit(max_pieces // 2) for c in ("matched", "not matched")]
    rows = sorted(r["piece"] for r in halves[0].unionByName(halves[1]).collect())
    return train([(p, base_spans(p)) for p in rows])


def text_spans(text: str, weights: np.ndarray) -> list[tuple[str, int, int, bool]]:
    """Spans by start, then kind, then end."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    out = [(*s, True) for s in base]
    at, reached = 0, 0
    for a, b in pieces(text):
        starts = _tokens(text, a, b)
        for i, j, k in decode_text(text, starts, weights):
            s, e = int(starts[i]), int(starts[j])
            # base spans of different kinds may overlap, so the furthest end so far decides
            while at < len(taken) and taken[at][0] < e:
                reached = max(reached, taken[at][1])
                at += 1
            if reached <= s:
                out.append((KINDS[k], s, e, False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def findings(spark: SparkSession, weights: np.ndarray, text: str = "text") -> Column:
    """Column of SPANS: code point offsets, end exclusive; ``base`` tells pattern matches from the model's own."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        for texts in batches:
            near = pc.match_substring_regex(texts, "[0-9@]").fill_null(False).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(near).tolist()
            out: list[list] = [[]] * len(texts)
            for i, value in zip(rows, texts.take(pa.array(rows, pa.int64())).to_pylist()):
                out[i] = [dict(zip(("kind", "start", "end", "base"), s)) for s in text_spans(value, shared.value)]
            yield pa.array(out, pa.list_(kind))

    return run(F.col(f"`{text}`"))
