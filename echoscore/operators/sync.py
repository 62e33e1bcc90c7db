"""Upload work list: which audio files are stored already, which must go up, which are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from echoscore import constants as K
from echoscore.functions import text as T
from echoscore.operators.samples import first_present


def storage_uri(df: DataFrame, path: Column, bucket: str, prefix: str, scheme: str = "gs") -> Column:
    """scheme://bucket/prefix/<group>_<lang>/<file name>; NULL without a path."""

    def part(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(K.UNKNOWN)

    folder = F.concat(F.lit(f"{scheme}://{bucket}/{prefix}/"), part("group"), F.lit("_"), part("lang"))
    return F.concat(folder, F.lit("/"), T.basename(path))


def sync_plan(
    manifest: DataFrame, stored: DataFrame, local: DataFrame, bucket: str, prefix: str,
    path_columns: tuple[str, ...] = ("noisy_output_path", "file_path"), scheme: str = "gs",
) -> DataFrame:
    """Manifest + ``status`` (reuse / upload / missing / no_path) and the final ``gcs_uri``.

    The path is the first of ``path_columns`` that the manifest has. A row whose path is missing there is
    ``no_path``: another column would name another clip. ``stored`` and ``local`` are listings with a ``path`` column: storage URIs and file paths.
    """
    plan = manifest.withColumn("_path", T.first_filled(first_present(manifest, *path_columns)))
    plan = plan.withColumn("_uri", storage_uri(manifest, F.col("_path"), bucket, prefix, scheme))
    in_store = stored.select(F.col("path").alias("_uri"), F.lit(True).alias("_stored")).distinct()
    on_disk = local.select(F.col("path").alias("_path"), F.lit(True).alias("_local")).distinct()
    plan = plan.join(in_store, "_uri", "left").join(on_disk, "_path", "left")
    status = (
        F.when(F.col("_path").isNull(), "no_path")
        .when(F.col("_stored"), "reuse")
        .when(F.col("_local"), "upload")
        .otherwise("missing")
    )
    return (
        plan.withColumn("status", status)
        .withColumn("gcs_uri", F.when(F.col("status").isin("reuse", "upload"), F.col("_uri")))
        .select(*manifest.columns, "status", "gcs_uri")
    )
