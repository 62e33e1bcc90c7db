"""CSV whose quoted fields may hold line breaks, read by many tasks per file.

Spark splits a text file at line ends; whether such an end lies inside quotes depends on all quotes before it. So a first pass counts quotes:
per split, their parity, and whether a record can end in it. Summed up over a file's splits, in order, that tells of each split if it
starts inside a record, and in which split that record began. The second pass puts lines together: records that lie in one split come out at once, the
pieces of the few that cross a border (at most two per split) meet in a grouping by file and first split.

One row per split comes to the driver, fewer than it planned to read them. A quote inside an unquoted field, which no
writer of proper CSV produces, would be taken for the start of a quoted one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES = "file string, owner long, block long, first boolean, whole boolean, text string"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array, np.ndarray]]:
    """Stretches of a batch that come from one split: (file, block), lines, quotes per line."""
    block = np.asarray(batch.column("block"))
    files = batch.column("file").dictionary_encode()
    code = np.asarray(files.indices)
    edges = np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1
    quotes = np.asarray(pc.count_substring(batch.column("value"), '"'))
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
        if b > a:
            yield (files.dictionary[int(code[a])].as_py(), int(block[a])), batch.column("value").slice(a, b - a), quotes[a:b]


def split_parities(lines: DataFrame) -> DataFrame:
    """(file, block, odd, closes): parity of a split's quotes, and whether it is odd at the end of some line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, closes = None, 0, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [now[0]], "block": [now[1]], "odd": [bool(odd)], "closes": [closes]})

        for batch in batches:
            for key, _, quotes in _runs(batch):
                if key != now:
                    if now is not None:
                        yield row()
                    now, odd, closes = key, 0, False
                parity = (odd + np.cumsum(quotes)) & 1
                odd, closes = int(parity[-1]), closes or bool(parity.any())
        if now is not None:
            yield row()

    return lines.mapInArrow(run, "file string, block long, odd boolean, closes boolean")


def inside_starts(splits: Sequence[tuple[str, int, bool, bool]]) -> dict[tuple[str, int], int]:
    """For each split that starts inside a record: the block in which that record began."""
    found: dict[tuple[str, int], int] = {}
    file, inside, owner = None, False, 0
    for name, block, odd, closes in sorted(splits):
        if name != file:
            file, inside, owner = name, False, block
        if inside:
            found[name, block] = owner
        # a record ends where the parity from the split's start is odd if it started inside, and anywhere else if not
        if not inside or closes:
            owner = block
        inside ^= odd
    return found


def pieces(lines: DataFrame, inside: dict[tuple[str, int], int]) -> DataFrame:
    """PIECES: whole records, and what a split has of records that cross its borders, under the block where they began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        open_: list[str] | None = None  # lines of the record that has not ended yet
        owner, first = 0, False
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            columns = list(zip(*out)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            out.clear()
            for key, texts, quotes in _runs(batch):
                if key != now:
                    if open_ is not None:
                        out.append((now[0], owner, now[1], first, False, "\n".join(open_)))
                    now, first = key, key[1] == 0
                    owner = inside.get(key, key[1])
                    open_ = [] if key in inside else None
                crossing = open_ is not None and owner != now[1]
                for text, n in zip(texts.to_pylist(), (quotes & 1).tolist()):
                    if open_ is None:
                        if not n:
                            out.append((now[0], now[1], now[1], first, True, text))
                            first = False
                        else:
                            open_ = [text]
                        continue
                    open_.append(text)
                    if n:
                        out.append((now[0], owner, now[1], first, not crossing, "\n".join(open_)))
                        open_, owner, crossing, first = None, now[1], False, False
            yield flush()
        if open_ is not None:
            out[:] = [(now[0], owner, now[1], first, False, "\n".join(open_))]
            yield flush()

    return lines.mapInArrow(run, PIECES)


def records(spark: SparkSession, paths: str | Sequence[str], file: Column) -> DataFrame:
    """(file, first, text): each record's text, and whether it is its file's first."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = [tuple(r) for r in split_parities(lines).collect()]  # one row per split
    found = pieces(lines, inside_starts(splits))
    whole = found.where("whole").select("file", "first", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n")
    crossing = found.where("not whole").groupBy("file", "owner").agg(F.max("first").alias("first"), joined.alias("text"))
    return whole.unionByName(crossing.select("file", "first", "text"))


def table(spark: SparkSession, paths: str | Sequence[str], schema: str, file: Column) -> DataFrame:
    """Fields of all records but each file's first, its header, by position against ``schema``. Empty fields and lines as in Spark's reader."""
    rows = records(spark, paths, file).where(~F.col("first"))
    # line ends as Spark's reader hands them on
    text = F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    rows = rows.select(text.alias("text")).where(F.col("text") != "")
    return rows.select(F.from_csv("text", schema, {"escape": '"', "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")
