"""Small intermediate results as tables in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from echoscore.session import shared_folder

_written: list[str] = []
_tables: list[str] = []


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    For results that are small by construction (top-N winners, one row per run) but come out of a
    long plan. Spark then plans the joins that follow with the table's real size: a broadcast when
    it is under ``spark.sql.autoBroadcastJoinThreshold``, a shuffle join when it is not. The work
    above runs once however often the result is used, and a lost executor does not repeat it.
    """
    folder = shared_folder(df.sparkSession, purpose)
    _written.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, keys: Sequence[str], purpose: str, buckets: int | None = None) -> DataFrame:
    """``df`` as a table below ``spark.checkpoint.dir``, dealt and sorted by ``keys`` into ``buckets`` (default: the session's number
    of shuffle partitions), for rows that several later steps join by those keys: such a join moves its other side only.

    Rows with a NULL key are stored too, but equal nothing in a plain join.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one file per bucket instead of one per task and bucket
    dealt = df.repartition(count, *keys)
    dealt.write.bucketBy(count, *keys).sortBy(*keys).option("path", folder).saveAsTable(name)
    _written.append(folder)
    _tables.append(name)
    return spark.table(name)


def drop_staged(spark: SparkSession) -> int:
    """Delete the folders that ``staged`` and ``bucketed`` wrote in this process; results that read them must be finished."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS `{_tables.pop()}`")
    count = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        count += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return count
