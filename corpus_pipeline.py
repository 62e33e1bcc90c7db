"""The corpus pipeline: toxic documents go, poor ones go, one of each group of near copies stays, secrets are
masked, the rest is packed into training sequences.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and read again for the next one. All but the
last keep the columns of ``documents``, whatever else they hold. NULL texts count as empty and go with the poor
documents; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from echoscore.llm import neardup, packing, quality, secrets, toxicity
from echoscore.llm.queries import remainder
from echoscore.sources.readers import table
from echoscore.sources.stage import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the labels outside the fold that the toxicity query holds out."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels.where(remainder("id", 3) != 1))
    return docs.where(toxicity.score(spark, model) < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.distinct_documents(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text."""
    network = secrets.fit(docs.select(F.col("doc_id").alias("id"), "text"))
    masked = docs.select(F.struct("*").alias("row"), secrets.redacted(spark, network).alias("masked"))
    change = F.length("masked") - F.length("row.text")
    new = {"text": F.col("masked"), "n_chars": F.col("row.n_chars") + F.coalesce(change, F.lit(0))}
    return masked.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# Learned models are beyond SQL; tests/llm compares run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
