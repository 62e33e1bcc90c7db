"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators are written for. All but the last two are Spark's defaults, stated
# because plans rely on them: AQE splits skewed join partitions, merges small shuffle
# partitions and turns joins into broadcasts only once a side's real size is known.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Scoring is CPU bound, so merged shuffle partitions may stay small ...
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # ... and long transcripts must not pile up in one Arrow batch.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def build_session(master: str | None = None, app: str = "echoscore", **conf: str) -> SparkSession:
    """A session with SETTINGS; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, the storage every executor can reach.

    Only a local master (tests, one process) may go without the setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="echoscore-")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")
