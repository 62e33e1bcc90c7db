"""Readers: one scan per artifact kind, schemas declared, bad input kept apart."""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoscore import constants as K
from echoscore.functions.text import url_unquote
from echoscore.sources import quoted, schemas as S


#: Where a job stands in the logs: its written place, else by time, file and row of the scan.
LOG_PLACES = ("log_seq", "log_time", "log_file", "log_row")


def _file_path() -> Column:
    """The row's file; Spark reports it as an encoded URI."""
    return url_unquote(F.col("_metadata.file_path"))


def lang_and_split(path: Column) -> list[Column]:
    """``lang`` and ``group`` from a path that ends in ``<lang>/<split>.tsv``."""
    layout = r"([^/]+)/([^/]+)\.tsv$"
    return [F.regexp_extract(path, layout, i).alias(name) for i, name in ((1, "lang"), (2, "group"))]


def corpus_paths(base: str, langs: Sequence[str] = K.LANGUAGES, splits: Sequence[str] = K.SPLITS) -> list[str]:
    """The corpus files of the given languages and splits."""
    return [f"{base.rstrip('/')}/{lang}/{split}.tsv" for lang in langs for split in splits]


def corpus(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Headerless corpus TSVs laid out as ``.../<lang>/<split>.tsv``, all in one scan.

    Adds ``lang`` and ``group`` from the path and ``seq``, the row's place in its file: the offset of
    the file split it came from, then an id that grows inside a split. Quoting is off: transcripts
    may hold any character but the tab.
    """
    raw = (
        spark.read.schema(S.CORPUS)
        .option("sep", "\t").option("quote", "").option("encoding", "UTF-8")
        .csv(paths)
    )
    return raw.select(
        "*",
        *lang_and_split(_file_path()),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("seq"),
    )


def csv_table(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """CSV with a header line, columns matched by position against ``schema``.

    Quoted fields may hold line breaks; a file is still read by as many tasks as it has splits (``quoted``). A byte-order mark goes with
    the header; empty fields come back as NULL.
    """
    return quoted.table(spark, paths, schema, _file_path())


def summary_csv(spark: SparkSession, path: str, archive_path: str | None = None) -> DataFrame:
    """Run summary with its metrics as text; the archive copy when ``path`` does not exist."""
    if archive_path and not path_exists(spark, path):
        path = archive_path
    return csv_table(spark, path, S.RUN_SUMMARY_TEXT)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on the session's file systems."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Non-blank lines of every ``*.jsonl`` below ``folder``: (file, raw)."""
    return (
        spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).text(folder)
        .select(_file_path().alias("file"), F.col("value").alias("raw"))
        .where(F.trim("raw") != "")
    )


def response_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Response files of many jobs, laid out as ``<folder>/.../job_id=<job>/*.jsonl`` (or ``.txt``): (job_id, file, seq, raw).

    ``seq`` is the line's place in its file, the offset of the file split and an id that grows inside
    it, so the last answer of a file is the last line.
    """
    path = _file_path()
    return (
        spark.read.option("pathGlobFilter", "*.{jsonl,txt}").option("recursiveFileLookup", True).text(folder)
        .select(
            # folder names of partitions have their special characters escaped once more
            url_unquote(F.regexp_extract(path, r"/job_id=([^/]+)/", 1)).alias("job_id"), path.alias("file"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"),
            F.col("value").alias("raw"),
        )
        .where(F.trim("raw") != "")
    )


def job_logs(spark: SparkSession, paths: str | Sequence[str], arrays: bool = True) -> DataFrame:
    """Job records of JSON-array logs (``arrays=False``: JSON lines, as ``sinks.json`` writes them).

    What does not parse contributes nothing. ``log_row`` grows with the place in a log; ``log_seq`` is the place that ``sinks.job_log`` writes. ``kind`` tells silence runs apart, whatever the log file
    is called.
    """
    rows = (
        spark.read.schema(S.JOB_LOG + ", _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .json(paths, multiLine=arrays)
        .select("*", _file_path().alias("log_file"), F.col("_metadata.file_modification_time").alias("log_time"))
    )
    # the second condition also keeps Spark from reading nothing but the error column
    named = "lang IS NOT NULL OR job_name IS NOT NULL OR local_output_csv IS NOT NULL"
    good = rows.where(f"_corrupt_record IS NULL AND ({named})").drop("_corrupt_record")
    good = good.withColumn("log_row", F.monotonically_increasing_id())
    kind = F.when(F.col("group") == "silence", "silence").otherwise("normal")
    return good.withColumn("submitted_at", F.col("submitted_at").try_cast("timestamp")).withColumn("kind", kind)


def run_table(spark: SparkSession, path: str) -> DataFrame:
    """The run table as ``sinks.append_runs`` writes it: all rounds that are on its list."""
    listed = spark.read.parquet(f"{path}-rounds").select("append_round")
    return spark.read.parquet(path).join(listed, "append_round", "left_semi").drop("append_round")


def broken_job_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The files ``job_logs`` left out: (log_file, content)."""
    files = spark.read.text(paths, wholetext=True).select(_file_path().alias("log_file"), F.col("value").alias("content"))
    return files.where(F.try_parse_json("content").isNull())


def prompts(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """Prompt files of one folder as whole texts: (prompt_version, text). An empty file is an empty text."""
    read = (
        spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
        .select(F.col("_metadata.file_name").alias("prompt_version"), F.col("value").alias("text"))
    )
    empty = [(path.rsplit("/", 1)[1], "") for path in empty_files(spark, folder, False) if path.endswith(suffix)]
    return read.unionByName(spark.createDataFrame(empty, read.schema)) if empty else read


def empty_files(spark: SparkSession, folder: str, recursive: bool = True) -> list[str]:
    """Files of length 0, which Spark's scans leave out. Asks the file system for one listing."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(jvm_path, recursive)
    found = []
    while files.hasNext():
        status = files.next()
        if status.getLen() == 0:
            found.append(status.getPath().toString())
    return found


def file_listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files below a folder without reading them: (path, length), empty ones too."""
    read = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .load(folder).select("path", "length")
    )
    empty = [(path, 0) for path in empty_files(spark, folder) if fnmatch(path.rsplit("/", 1)[1], glob)]
    return read.unionByName(spark.createDataFrame(empty, read.schema)) if empty else read


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy work at least one partition per core.

    For plain scans only. A large table already has many splits and passes through untouched; a
    table that fits one or two splits is hashed by ``keys`` over the cores first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
