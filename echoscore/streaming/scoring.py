"""Score response files as they arrive, with Structured Streaming.

Every response line is scored once, when its file shows up. A micro-batch writes one folder named by
its number and overwrites it when it runs again, which makes that exactly-once across restarts. A later
answer for the same request does not need state: all scored rows stay and readers take the last one
per (job, uri): by time and name of the file, then by the line's place in it. Lines that are no JSON
are kept beside the scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from echoscore.functions import metrics as M, text as T
from echoscore.operators.jobs import run_progress
from echoscore.operators.ranking import last_row
from echoscore.operators.responses import malformed, parse_responses
from echoscore.operators.scoring import COUNTS, with_edit_counts

LINE_KEYS = ("job_id", "arrived", "file", "block", "row")
SCORES = (
    "job_id string, gcs_uri string, arrived timestamp, file string, block long, row long, id long, prediction string, "
    "word_edits int, ref_words int, char_edits int, ref_chars int"
)


def response_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New ``*.jsonl``/``*.txt`` lines below ``.../job_id=<job>/``: (job_id, arrived, file, block, raw)."""
    path = T.url_unquote(F.col("_metadata.file_path"))  # reported as an encoded URI
    return (
        spark.readStream.format("text")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{jsonl,txt}")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(
            # folder names of partitions have their special characters escaped once more
            T.url_unquote(F.regexp_extract(path, r"/job_id=([^/]+)/", 1)).alias("job_id"),
            F.col("_metadata.file_modification_time").alias("arrived"), path.alias("file"),
            F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"),
        )
    )


def scored_lines(lines: DataFrame, expected: DataFrame, strip_eot: bool = False) -> DataFrame:
    """Lines (LINE_KEYS, raw) joined with the request table (job_id, gcs_uri, id, transcription) and scored."""
    parsed = parse_responses(lines, keep=LINE_KEYS).drop("key")
    wanted = expected.select("job_id", "gcs_uri", "id", "transcription")
    scored = with_edit_counts(parsed.join(wanted, ["job_id", "gcs_uri"]), strip_eot)
    return scored.select("job_id", "gcs_uri", "arrived", "file", "block", "row", "id", "prediction", *COUNTS)


def start(lines: DataFrame, expected: DataFrame, out: str, checkpoint: str, strip_eot: bool = False) -> StreamingQuery:
    """Score everything that is there into ``out``, keep malformed lines in ``<out>-malformed``, and stop."""

    def write(batch: DataFrame, number: int) -> None:
        # inside a file split, ids grow with the line
        rows = batch.withColumn("row", F.monotonically_increasing_id())
        scored_lines(rows, expected, strip_eot).write.mode("overwrite").parquet(f"{out}/batch={number}")
        malformed(rows).select(*LINE_KEYS, "raw").write.mode("overwrite").parquet(f"{out}-malformed/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def malformed_lines(spark: SparkSession, out: str) -> DataFrame:
    """Lines that could not be read: (LINE_KEYS, raw)."""
    return spark.read.parquet(f"{out}-malformed").drop("batch")


def current_scores(spark: SparkSession, out: str) -> DataFrame:
    """The last scored row per request."""
    rows = spark.read.schema(SCORES).parquet(out).drop("batch")
    return last_row(rows, ["job_id", "gcs_uri"], F.col("arrived"), F.col("file"), F.col("block"), F.col("row"))


def current_summary(spark: SparkSession, out: str, expected: DataFrame) -> DataFrame:
    """Rates per job so far and whether every request has been answered."""
    latest = current_scores(spark, out)
    sums = latest.groupBy("job_id").agg(F.count("ref_chars").alias("n_scored"), *[F.sum(c).alias(c) for c in COUNTS])
    rates = sums.where(F.col("n_scored") > 0).select(
        "job_id", "n_scored",
        M.rate(F.col("word_edits"), F.col("ref_words")).alias("wer"),
        M.rate(F.col("char_edits"), F.col("ref_chars")).alias("cer"),
    )
    return rates.join(run_progress(expected, latest), "job_id")
