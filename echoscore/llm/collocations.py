"""Phrase collocations from count streams in prefix and in suffix order, merge-joined in lockstep.

1. *Blocks.* Tasks cut their texts into pieces and words and write blocks of at most some ``BLOCK`` words of one language: the
   block's own dictionary, exact, and the words as numbers in it. One word count per block and word gives the vocabulary:
   words that occur often enough get dense numbers, rarer ones can be in no candidate and end a run.
2. *Count stream.* Each block lists its word triples (the third may be missing at the end of a run) sorted, with counts. Spark
   deals them by range of the whole triple and sorts; one pass over each sorted range adds equal neighbours up. Pairs are the sums over runs of
   triples, so only the longest phrases are ever counted. Pairs and triples below ``least`` are dropped.
3. *Streams of both orders.* What is left, words, pairs and triples together, is dealt by range in prefix order, and again with reversed words. In
   such a stream a phrase stands behind its own beginnings: a pass that remembers the last word and the last pair meets,
   for every phrase, the counts of its first one and two words (in the reversed stream the last ones) and, for every pair, its most
   frequent extension. A range starts with the word and pair that the ranges before it ended on.
4. The two results are put side by side by phrase, scored with exact decimals, and ranked.

A hot word or pair is one row per block before it is summed and spreads over as many ranges as its phrases need. Ranges hold
distinct phrases, so none is hot. What comes to the driver is one row per range or partition. Counts use ids and sorting, no hashes
of words.

Only A-Z is folded. NULL and empty texts have no words; NULL languages are ``und``. Repeated rows count each
for itself, ids don't matter and other columns are ignored. Very long texts are cut into blocks by their words. An empty table gives no
rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from echoscore.llm import words
from echoscore.sources.stage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 10
TOP = 2000
#: Drop a phrase if a longer one has this percentage of its count.
INSIDE = 50
BLOCK = 1 << 19
BUCKETS = 64

#: Bytes that end a piece, and those that end a word.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
ENDS = BREAKS.copy()
ENDS[[0x20, 0x09]] = True


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


class _Open:
    """Words of one language that wait to become a block."""

    def __init__(self) -> None:
        self.dictionaries: list[pa.Array] = []
        self.tokens: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.size = 0

    def add(self, dictionary: pa.Array, tokens: np.ndarray, starts: np.ndarray) -> None:
        self.tokens.append(tokens + self.size)
        self.size += len(dictionary)
        self.dictionaries.append(dictionary)
        self.starts.append(starts)

    def block(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, their counts, and the words of all pieces as numbers from 1, each piece after a 0."""
        one = pa.concat_arrays(self.dictionaries).dictionary_encode()
        tokens = np.asarray(one.indices)[np.concatenate(self.tokens)]
        starts = np.concatenate(self.starts)
        line = np.zeros(len(tokens) + int(starts.sum()), np.int64)
        line[np.arange(len(tokens)) + np.cumsum(starts)] = tokens + 1
        return one.dictionary, np.bincount(tokens, minlength=len(one.dictionary)), line


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words, which of them start a piece, and the text of each."""
    data, bounds = words.text_bytes(texts)
    starts, ends, first = words.spans(data, bounds, ENDS)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, bool), text
    opens = np.ones(len(starts), bool)
    breaks = np.cumsum(BREAKS[data])[starts]
    opens[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = words.LOWER[data[~ENDS[data]]]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)), opens, text


def blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """(block, lang, words, counts, n, tokens) with ``tokens`` packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = TaskContext.get().partitionId() << 33
        waiting: dict[str, _Open] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal following
            for lang, held in waiting.items():
                dictionary, counts, line = held.block()
                row = {
                    "block": [following], "lang": [lang], "words": pa.array([dictionary.to_pylist()], pa.list_(pa.string())),
                    "counts": pa.array([counts], pa.list_(pa.int64())), "n": [len(line)], "tokens": [_packed(line)],
                }
                following += 1
                yield pa.RecordBatch.from_pydict(row)
            waiting.clear()

        for batch in words.pieces(batches, "text", 1 << 22):
            found, opens, text = _words(batch.column("text"))
            coded = found.dictionary_encode()
            tokens = np.asarray(coded.indices)
            langs = batch.column("lang").dictionary_encode()
            of_text = np.asarray(langs.indices)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = of_text[text] == k
                # a very long text becomes several blocks: the cut repeats two words of lookahead below
                mine, mine_opens = tokens[own], opens[own]
                if not len(mine):
                    continue
                used, place = np.unique(mine, return_inverse=True)
                waiting.setdefault(lang, _Open()).add(coded.dictionary.take(pa.array(used)), place, mine_opens)
                count += len(mine)
            if count >= size:
                yield from flush()
                count = 0
        yield from flush()

    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    narrow = docs.select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, "block long, lang string, words array<string>, counts array<long>, n long, tokens binary")


def vocabulary(table: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, f): words of ``blocks`` with ``least`` occurrences, numbered from 1 without gaps."""
    listed = table.select("lang", F.inline(F.arrays_zip("words", "counts"))).toDF("lang", "word", "f")
    often = listed.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = staged(often.select("lang", "word", "f", F.spark_partition_id().alias("part"), row.alias("row")), "vocabulary")
    sizes = numbered.groupBy("part").agg(F.max("row").alias("last")).orderBy("part").collect()  # one row per partition
    offsets, total = [], 1
    for r in sizes:
        offsets.append((r["part"], total))
        total += r["last"] + 1
    starts = table.sparkSession.createDataFrame(offsets, "part int, start long")
    return numbered.join(starts, "part").select((F.col("start") + F.col("row")).alias("id"), "lang", "word", "f")


def triples(line: np.ndarray, ids: np.ndarray, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted ids of word triples and their counts. ``ids`` has the id of each number in ``line``, 0 for those that end a run.

    Pairs at the end of a run have 0 as the third.
    """
    known = ids[line]
    for start in range(0, len(known), size):
        part = np.zeros(min(size, len(known) - start) + 2, known.dtype)
        tail = known[start : start + size + 2]
        part[: len(tail)] = tail
        # Ranks among the ids that occur here keep their order and fit three into 63 bits.
        here = np.unique(part)
        here = here[here > 0]
        rank = np.where(part > 0, np.searchsorted(here, part) + 1, 0).astype(np.uint64)
        a, b, c = rank[:-2], rank[1:-1], rank[2:]
        at = (a > 0) & (b > 0)
        keys, counts = np.unique(a[at] << np.uint64(42) | b[at] << np.uint64(21) | c[at], return_counts=True)
        ranked = np.concatenate([[0], here])
        low = np.uint64((1 << 21) - 1)
        yield ranked[keys >> np.uint64(42)], ranked[keys >> np.uint64(21) & low], ranked[keys & low], counts


def counted_triples(table: DataFrame, words_table: DataFrame) -> DataFrame:
    """(w1, w2, w3, f): one row per block and triple."""
    listed = table.select("block", "lang", F.posexplode("words").alias("pos", "word"))
    hits = (
        listed.join(words_table.select("lang", "word", "id"), ["lang", "word"])
        .groupBy("block").agg(F.collect_list("pos").alias("pos"), F.collect_list("id").alias("id"))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                ids = np.zeros(row["size"].as_py() + 1, np.int64)
                ids[np.asarray(row["pos"].values) + 1] = np.asarray(row["id"].values)
                for found in triples(_unpacked(row["tokens"].as_py(), row["n"].as_py()), ids):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["w1", "w2", "w3", "f"])

    joined = table.select("block", "n", "tokens", F.size("words").alias("size")).join(hits, "block")
    return joined.mapInArrow(run, "w1 long, w2 long, w3 long, f long")


def _same(*columns: np.ndarray) -> np.ndarray:
    """Where a row starts that differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def summed(stream: DataFrame, least: int) -> DataFrame:
    """(w1, w2, w3, f) from the sorted stream of ``counted_triples``: triples with ``least`` occurrences, and pairs (w3 = 0), of
    which a range's first and last may lack what is in the ranges beside it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)  # the last triple, which the next batch may go on with
        pair = np.zeros((3, 0), np.int64)  # the last pair
        first = True

        def pairs_of(done: np.ndarray, last: bool) -> np.ndarray:
            nonlocal pair, first
            joined = np.concatenate([pair, done[[0, 1, 3]]], 1)
            at = _same(joined[0], joined[1])
            joined = np.stack([joined[0, at], joined[1, at], np.add.reduceat(joined[2], at)]) if len(at) else joined
            keep = np.ones(joined.shape[1], bool)
            if not last and len(keep):
                keep[-1] = False
            pair = joined[:, ~keep]
            out = joined[:, keep]
            sure = out[2] >= least
            if first and len(sure):
                sure[0], first = True, False
            if last and len(sure):
                sure[-1] = True
            return out[:, sure]

        def rows(done: np.ndarray, last: bool) -> pa.RecordBatch:
            two = pairs_of(done, last)
            three = done[:, (done[3] >= least) & (done[2] > 0)]
            columns = [np.concatenate([two[0], three[0]]), np.concatenate([two[1], three[1]])]
            columns += [np.concatenate([np.zeros_like(two[0]), three[2]]), np.concatenate([two[2], three[3]])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["w1", "w2", "w3", "f"])

        for batch in batches:
            joined = np.concatenate([held, np.stack([np.asarray(c) for c in batch.columns])], 1)
            if not joined.shape[1]:
                continue
            at = _same(*joined[:3])
            joined = np.concatenate([joined[:3, at], np.add.reduceat(joined[3], at)[None]])
            held = joined[:, -1:]
            yield rows(joined[:, :-1], False)
        yield rows(held, True)

    return stream.mapInArrow(run, "w1 long, w2 long, w3 long, f long")


def grams(table: DataFrame, words_table: DataFrame, least: int) -> DataFrame:
    """(w1, w2, w3, f) of all words, pairs and triples with ``least`` occurrences; what is missing is 0."""
    order = ["w1", "w2", "w3"]
    stream = counted_triples(table, words_table).repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(summed(stream, least), "phrases")
    two = found.where("w3 = 0").groupBy("w1", "w2").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    one = words_table.select(F.col("id").alias("w1"), F.lit(0).cast("long").alias("w2"), F.lit(0).cast("long").alias("w3"), "f")
    return one.unionByName(two.select("w1", "w2", F.lit(0).cast("long").alias("w3"), "f")).unionByName(found.where("w3 > 0"))


def _latest(kind: np.ndarray, values: np.ndarray, before: int) -> np.ndarray:
    """At each row, the value of the last row of the kind, ``before`` where there is none yet."""
    at = np.maximum.accumulate(np.where(kind, np.arange(len(kind)), -1))
    return np.where(at < 0, before, values[at])


def lockstep(k: np.ndarray, f: np.ndarray, head: tuple[int, int, int, int]) -> tuple[np.ndarray, ...]:
    """One pass over a sorted range of a stream.

    ``k`` (3 x rows) are ids, ``head`` the last word's count and the last pair (two ids and count) before the range. Gives per
    phrase of two or three words its own ids and count, the count of its first word and of its first two, and per pair the
    largest count of a phrase of three that goes on from it; the pair of ``head`` comes too, with its largest here.
    """
    one, two = k[1] == 0, (k[1] > 0) & (k[2] == 0)
    first, pair = _latest(one, f, head[0]), _latest(two, f, head[3])
    three = ~one & ~two
    # runs of triples behind their pair
    at = np.flatnonzero(three)
    runs = at[np.flatnonzero(np.concatenate([[True], (k[0, at][1:] != k[0, at][:-1]) | (k[1, at][1:] != k[1, at][:-1])]))] if len(at) else at
    masked = np.where(three, f, 0)
    longest = np.maximum.reduceat(masked, runs) if len(runs) else masked[:0]
    extended = np.stack([k[0, runs], k[1, runs], np.zeros_like(runs), longest])
    own = np.flatnonzero(~one)
    return k[:, own], f[own], first[own], np.where(three, pair, 0)[own], extended


def stream(found: DataFrame, order: list[str]) -> DataFrame:
    """(``order``, first, pair, longest) by one lockstep pass over each range of ``found`` in that order. Phrases come without
    ``longest``, then pairs again with ``longest`` alone, once per range they go on in."""
    # words before their pairs before their triples; missing words are at the end in both orders
    keys = [F.col(c) for c in order]
    ranged = staged(found.repartitionByRange(*keys).select(*order, "f", F.spark_partition_id().alias("part")), "stream")
    word, pair = F.when(F.col(order[1]) == 0, F.struct(*order, "f")), F.when((F.col(order[1]) > 0) & (F.col(order[2]) == 0), F.struct(*order, "f"))
    # the last word and pair of each range: one row per range
    heads, now = {}, (0, 0, 0, 0)
    for r in ranged.groupBy("part").agg(F.max(word).alias("word"), F.max(pair).alias("pair")).orderBy("part").collect():
        heads[r["part"]] = now
        now = (r["word"]["f"] if r["word"] else now[0], *((r["pair"][0], r["pair"][1], r["pair"]["f"]) if r["pair"] else now[1:]))
    names = [*order, "f", "first", "pair", "longest"]

    def run(group: pa.Table) -> pa.Table:
        k = np.stack([np.asarray(group.column(c)) for c in order])
        sort = np.lexsort(k[::-1])
        own, f, first, two, extended = lockstep(k[:, sort], np.asarray(group.column("f"))[sort], heads[group.column("part")[0].as_py()])
        none = np.zeros(extended.shape[1], np.int64)
        columns = [np.concatenate([own[i], extended[i]]) for i in range(3)]
        columns += [np.concatenate([f, none]), np.concatenate([first, none]), np.concatenate([two, none])]
        columns.append(np.concatenate([np.zeros(len(f), np.int64), extended[3]]))
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return ranged.groupBy("part").applyInArrow(run, ", ".join(f"{n} long" for n in names))


def phrases(found: DataFrame) -> DataFrame:
    """(w1, w2, w3, a, l1, l2, r1, r2, longest): a phrase's count, those of its parts for a cut after one or two words, and the
    largest of a longer phrase around it (0 without one)."""
    before = stream(found, ["w1", "w2", "w3"]).select(
        "w1", "w2", "w3", "f", F.col("first").alias("l1"), F.col("pair").alias("l2"), F.lit(0).cast("long").alias("r1"),
        F.lit(0).cast("long").alias("last"), "longest")
    two = F.col("w3") == 0
    # reversed, a pair is (w2, w1, 0)
    turned = found.select(
        F.when(F.col("w2") == 0, F.col("w1")).when(two, F.col("w2")).otherwise(F.col("w3")).alias("x1"),
        F.when(F.col("w2") == 0, F.lit(0)).when(two, F.col("w1")).otherwise(F.col("w2")).cast("long").alias("x2"),
        F.when(two, F.lit(0)).otherwise(F.col("w1")).cast("long").alias("x3"), "f")
    short = F.col("x3") == 0
    after = stream(turned, ["x1", "x2", "x3"]).select(
        F.when(short, F.col("x2")).otherwise(F.col("x3")).alias("w1"), F.when(short, F.col("x1")).otherwise(F.col("x2")).alias("w2"),
        F.when(short, F.lit(0)).otherwise(F.col("x1")).cast("long").alias("w3"),
        "f", F.lit(0).cast("long").alias("l1"), F.lit(0).cast("long").alias("l2"), F.col("pair").alias("r1"), F.col("first").alias("last"), "longest")
    sides = before.unionByName(after).groupBy("w1", "w2", "w3").agg(
        *[F.max(c).alias(n) for c, n in (("f", "a"), ("l1", "l1"), ("l2", "l2"), ("r1", "r1"), ("last", "last"), ("longest", "longest"))])
    return sides.select("w1", "w2", "w3", "a", "l1", "l2", F.when(two, F.col("last")).otherwise(F.col("r1")).alias("r1"), F.col("last").alias("r2"), "longest")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in exact decimals."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", (wide[0] * wide[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def scored(found: DataFrame, inside: int = INSIDE) -> DataFrame:
    """(w1, w2, w3, a, l, r, score) of the phrases that no longer one nearly always surrounds, at their weakest cut."""
    free = found.where(F.col("longest") * 100 < F.col("a") * inside)
    cuts = free.withColumn("s1", _score(F.col("a"), F.col("l1"), F.col("r1")))
    cuts = cuts.withColumn("s2", F.when(F.col("w3") > 0, _score(F.col("a"), F.col("l2"), F.col("r2"))))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    pick = lambda a, b: F.when(second, F.col(b)).otherwise(F.col(a))
    return cuts.select("w1", "w2", "w3", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))


def mined(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, inside: int = INSIDE,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words of each language."""
    table = staged(blocks(docs, lang_col, text_col), "blocks")
    terms = staged(vocabulary(table, least), "terms")
    candidates = staged(scored(phrases(grams(table, terms, least)), inside), "collocations")
    named = terms.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1"))
    # first within buckets of each language, so that no task ranks all of a language; ties at the last rank stay until their texts are known
    near = candidates.join(named, "w1").withColumn("bucket", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(BUCKETS)))
    for keys in (("lang", "bucket"), ("lang",)):
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"))
        near = near.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place")
    for k in (2, 3):
        near = near.join(terms.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}")), f"w{k}", "left")
    totals = table.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3")).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
