"""Completion of runs while their answers arrive: a run's rates come out in the batch that brings its last answer.

Scored lines are dealt by job and ``shard``, a share of the job's requests, so that a job with a third of all rows is kept by many
tasks. Each shard's state in the store has the last answer of each of its requests and their running sums, so an answer costs one look-up however many
came before, and a later answer for a request replaces the earlier one's share. A shard with all its answers puts out a row, and again when an answer is
replaced; a timer may report shards that wait too long. The run's own row follows when its last shard is there.

Every micro-batch writes folders named by its number and overwrites them when it runs again: a query that was stopped goes on from its
checkpoint and gives the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from echoscore.functions import metrics as M
from echoscore.operators.ranking import last_row
from echoscore.operators.scoring import COUNTS
from echoscore.sources.stage import staged
from echoscore.streaming.scoring import LINE_KEYS, scored_lines

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 16
ORDER = ("arrived", "file", "block", "row")
SUMS = ("n_answered", "n_scored", *COUNTS)
SHARD = "job_id string, shard int, n_expected long, " + ", ".join(f"{c} long" for c in SUMS) + ", stalled boolean"
RUN = "job_id string, n_expected long, " + ", ".join(f"{c} long" for c in SUMS)
# State is kept by RocksDB, changes alone go to the checkpoint. All its instances on an executor share one bound of memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


class Answers(StatefulProcessor):
    """State of one shard: the last answer per request, and sums over them."""

    def __init__(self, stall_ms: int | None):
        self.stall_ms = stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        counts = ", ".join(f"{c} long" for c in ("scored", *COUNTS))
        self.answers = handle.getMapState("answers", "gcs_uri string", f"arrived long, file string, block long, `row` long, {counts}")
        self.sums = handle.getValueState("sums", "n_expected long, " + ", ".join(f"{c} long" for c in SUMS))

    def _row(self, key: Any, sums: list[int], stalled: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, *sums, stalled)], columns=["job_id", "shard", "n_expected", *SUMS, "stalled"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        sums = list(self.sums.get()) if self.sums.exists() else [0] * (1 + len(SUMS))
        changed = False
        for frame in rows:
            last = frame.sort_values(list(ORDER)).drop_duplicates("gcs_uri", keep="last")
            for r in last.itertuples(index=False):
                sums[0] = int(r.n_expected)
                new = (int(r.arrived), r.file, int(r.block), int(r.row), int(r.scored), *(int(getattr(r, c)) for c in COUNTS))
                old = self.answers.getValue((r.gcs_uri,)) if self.answers.containsKey((r.gcs_uri,)) else None
                if old is not None and tuple(old)[:4] >= new[:4]:
                    continue
                self.answers.updateValue((r.gcs_uri,), new)
                before = tuple(old)[4:] if old is not None else (0,) * (1 + len(COUNTS))
                sums[1] += old is None
                sums[2:] = [s + n - b for s, n, b in zip(sums[2:], new[4:], before)]
                changed = True
        self.sums.update(tuple(sums))
        complete = sums[1] >= sums[0]
        if self.stall_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if not complete:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall_ms)
        if complete and changed:
            yield self._row(key, sums, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        sums = list(self.sums.get())
        if sums[1] < sums[0]:
            yield self._row(key, sums, True)

    def close(self) -> None:
        pass


def shard_of(uri: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(uri), F.lit(shards)).cast("int")


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with their place in the file split: a task reads a split's lines in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.append_column("row", pa.array(range(seen, seen + len(batch)), pa.int64()))
            seen += len(batch)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in lines.dtypes)
    return lines.mapInArrow(run, f"{schema}, `row` long")


def start(
    lines: DataFrame, expected: DataFrame, out: str, checkpoint: str, shards: int = SHARDS, stall_ms: int | None = None,
    strip_eot: bool = False, available_now: bool = False,
) -> StreamingQuery:
    """Follow ``lines`` (``scoring.response_stream``) until stopped, or until all that is there is done.

    ``expected`` (job_id, gcs_uri, id, transcription) are the requests sent. ``stall_ms``: report a shard that waits that long for its
    next answer.
    """
    spark = lines.sparkSession
    # rows without a URI are never sent
    sent = expected.where("gcs_uri IS NOT NULL").withColumn("shard", shard_of(F.col("gcs_uri"), shards))
    sizes = staged(sent.select("job_id", "shard", "gcs_uri").distinct().groupBy("job_id", "shard").agg(F.count(F.lit(1)).alias("n_expected")), "expected")
    scored = scored_lines(_placed(lines), expected, strip_eot).withColumn("shard", shard_of(F.col("gcs_uri"), shards))
    rows = scored.join(sizes, ["job_id", "shard"]).select(
        "job_id", "shard", "gcs_uri", "n_expected", F.unix_micros("arrived").alias("arrived"), "file", "block", "row",
        F.col("ref_chars").isNotNull().cast("long").alias("scored"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
    )
    done = rows.groupBy("job_id", "shard").transformWithStateInPandas(Answers(stall_ms), SHARD, "Update", "None" if stall_ms is None else "ProcessingTime")
    of_job = sizes.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_shards"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/shards/batch={number}")
        session = batch.sparkSession
        own = session.read.schema(SHARD).parquet(f"{out}/shards/batch={number}").where("not stalled")
        known = _shards(session, out).where(F.col("batch") <= number).join(own.select("job_id").distinct(), "job_id", "left_semi")
        latest = last_row(known.where("not stalled"), ["job_id", "shard"], F.col("batch"))
        runs = latest.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("n_expected", *SUMS)])
        complete = runs.join(of_job, "job_id").where(F.col("n") == F.col("n_shards"))
        complete.select("job_id", "n_expected", *SUMS).write.mode("overwrite").parquet(f"{out}/runs/batch={number}")

    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        writer = done.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _shards(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{SHARD}, batch long").parquet(f"{out}/shards")


def completed_runs(spark: SparkSession, out: str) -> DataFrame:
    """The last row of each run that has had all its answers: rates, counts, and the batch."""
    rows = last_row(spark.read.schema(f"{RUN}, batch long").parquet(f"{out}/runs"), ["job_id"], F.col("batch"))
    return rows.select(
        "job_id", "n_expected", "n_answered", "n_scored",
        M.rate(F.col("word_edits"), F.col("ref_words")).alias("wer"), M.rate(F.col("char_edits"), F.col("ref_chars")).alias("cer"), "batch",
    )


def stalled_runs(spark: SparkSession, out: str) -> DataFrame:
    """Runs with a shard whose last report was that it waits: (job_id, n_waiting shards)."""
    latest = last_row(_shards(spark, out), ["job_id", "shard"], F.col("batch"))
    return latest.where("stalled").groupBy("job_id").agg(F.count(F.lit(1)).alias("n_waiting"))
