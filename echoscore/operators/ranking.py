"""First, last, best and top-N rows per group, safe for a few very large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from echoscore.sources.stage import staged

NAN = float("nan")


def low_first(c: str) -> Column:
    """Ascending key inside a struct. A NULL there would sort first, NaN sorts last."""
    return F.coalesce(F.col(c).cast("double"), F.lit(NAN))


def text_key(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def join_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where a NULL key equals a NULL key.

    The keys travel as one struct, which is never NULL itself and compares its fields, so sort-merge
    and hash joins, skew splitting and the reuse of a partitioning work as for plain columns.
    """
    key = F.struct(*keys)
    return left.withColumn("_key", key).join(right.withColumn("_key", key).drop(*keys), "_key", how).drop("_key")


def _pick(df: DataFrame, keys: Sequence[str], pick, order: Sequence[Column]) -> DataFrame:
    rows = df.groupBy(*keys).agg(pick(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return rows.select("_row.*")


def first_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The row with the smallest ``order`` per key.

    An aggregate, not a window: every map task hands on one row per key, so a key that holds a
    third of all rows costs no more than any other. ``order`` must not tie.
    """
    return _pick(df, keys, F.min_by, order)


def last_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The row with the largest ``order`` per key."""
    return _pick(df, keys, F.max_by, order)


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, unique: Sequence[str],
    rank: str = "rank", buckets: int = 16,
) -> DataFrame:
    """Rows ranked 1..n per key.

    Ranks twice: inside ``buckets`` hash buckets of each key, then over the survivors. Spark's
    group limit prunes before both shuffles, so one task sees at most buckets x n rows of a key.
    ``unique`` identifies a row and feeds the bucket hash.
    """
    bucket = F.pmod(F.xxhash64(*unique), F.lit(buckets))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    survivors = (
        df.withColumn("_bucket", bucket)
        .withColumn("_rank", F.row_number().over(inner)).where(F.col("_rank") <= n)
        .drop("_bucket", "_rank")
    )
    return survivors.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)


def top_n_wide(
    df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], order: Sequence[Column], n: int,
    unique: Sequence[str], rank: str = "rank",
) -> DataFrame:
    """``top_n`` for rows with long texts: rank the narrow columns, then fetch the winners.

    Winners are at most n per key and get staged, so the long rows are read once more and, while the
    winners fit a broadcast, never shuffled or sorted.
    """
    narrow = df.select(*dict.fromkeys([*keys, *order_cols, *unique]))
    winners = top_n(narrow, keys, order, n, unique, rank).select(*unique, rank)
    return join_rows(df, staged(winners, "winners"), unique)
