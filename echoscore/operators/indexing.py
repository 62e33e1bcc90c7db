"""Dense 0-based row numbers over a whole table, and fixed-size chunks of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from echoscore import constants as K
from echoscore.operators.ranking import join_rows
from echoscore.sources.stage import staged


def id_bucket(id_col: str = "id") -> Column:
    """Bucket of a numeric id. Ids are unique per key group, so a bucket holds at most 65,536 rows."""
    return F.shiftright(id_col, 16)


def id_bucket_parent(bucket: str) -> Column:
    """Buckets of 2^24 neighbouring id buckets; a 64-bit id space has at most 2^24 of them."""
    return F.shiftright(bucket, 24)


def hash_bucket(c: str) -> Column:
    """One of 65,536 buckets that sort like the md5 of a text column."""
    return F.substring(F.md5(c), 1, 4)


def _running(counts: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the sum of ``_n`` over all earlier rows of the same key."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum("_n").over(window), F.lit(0)))


def _totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("_n").alias("_n"))


def _bucket_offsets(counts: DataFrame, keys: Sequence[str], parent: Callable[[str], Column] | None) -> DataFrame:
    """(keys, _bucket, _offset) from (keys, _bucket, _n): rows in front of each bucket.

    Sums run inside parent buckets, over the parents, and over the key groups (few by nature:
    language x split), so even ids scattered over 64 bits keep every sorted run bounded.
    """
    if parent is None:
        offsets = _running(counts, keys, ["_bucket"], "_offset")
    else:
        nested = counts.withColumn("_parent", parent("_bucket"))
        parents = _running(_totals(nested, [*keys, "_parent"]), keys, ["_parent"], "_base").drop("_n")
        offsets = _running(nested, [*keys, "_parent"], ["_bucket"], "_inside")
        offsets = join_rows(offsets, parents, [*keys, "_parent"])
        offsets = offsets.withColumn("_offset", F.col("_inside") + F.col("_base"))
    if keys:
        starts = _running(_totals(counts, keys), [], keys, "_start").drop("_n")
        offsets = join_rows(offsets, starts, keys).withColumn("_offset", F.col("_offset") + F.col("_start"))
    return offsets.select(*keys, "_bucket", "_offset")


def global_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column,
    parent: Callable[[str], Column] | None = None, name: str = "idx",
    only: DataFrame | None = None, only_on: Sequence[str] = (),
) -> DataFrame:
    """Number all rows 0, 1, 2 ... by (keys, order) without ever sorting them in one task.

    ``bucket`` must grow with ``order`` inside a key group and must bound its own size; ``parent``
    groups buckets the same way. Bucket counts (one row per bucket) are summed up front; a row's
    number is its bucket's offset plus its place in the bucket. Everything follows from the data, so
    a recomputed task gives the same numbers and nothing needs to be cached between the passes.

    ``only`` (rows that carry ``only_on`` and the bucket's input columns) restricts the output; then
    only the buckets it touches are sorted.
    """
    # One struct holds keys and bucket: it is never NULL, so rows with a NULL key are numbered like
    # any other, and window and joins share its partitioning.
    at = F.struct(*keys, bucket.alias("_bucket"))
    df = df.withColumn("_at", at)
    counts = df.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).select("_at.*", "_n")
    offsets = _bucket_offsets(counts, keys, parent).select(F.struct(*keys, "_bucket").alias("_at"), "_offset")
    if only is not None:
        df = df.join(only.select(at.alias("_at")).distinct(), "_at", "left_semi")
    place = Window.partitionBy("_at").orderBy(*order)
    numbered = (
        df.withColumn("_place", F.row_number().over(place) - 1)
        .join(offsets, "_at")
        .withColumn(name, (F.col("_offset") + F.col("_place")).cast("long"))
        .drop("_at", "_place", "_offset")
    )
    if only is not None:
        numbered = join_rows(numbered, only.select(*only_on), only_on, "left_semi")
    return numbered


def range_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Number all rows 0, 1, 2 ... in any order, without a bucket expression.

    Spark deals the rows by ranges of ``order``; the sorted ranges are staged with each row's place, so that numbers stay as they are
    however often they are read, and a range's first number is the size of those before it. One row per range comes to the driver.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = dealt.select("*", F.shiftright(at, 33).cast("int").alias("_range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    ranged = staged(ranged, "ranges")
    starts, total = [], 0
    for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
        starts.append((r["_range"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    return ranged.join(offsets, "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def sample_index(df: DataFrame, name: str = "idx", **kwargs) -> DataFrame:
    """Place of each sample in (lang, group, id) order."""
    return global_index(df, ["lang", "group"], ["id"], id_bucket("id"), id_bucket_parent, name, **kwargs)


def chunked(df: DataFrame, size: int = K.CHUNK_SIZE, idx: str = "idx") -> DataFrame:
    """Chunk number and place in the chunk from a global index."""
    return df.withColumn("chunk_idx", F.expr(f"{idx} div {size}")).withColumn("pos", (F.col(idx) % size).cast("int"))
