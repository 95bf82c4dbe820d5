"""Loading of the parquet tables and the cleaning steps several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_clip(clip: Column) -> Column:
    """Clip names compare lower-cased and without surrounding white space; null stays null."""
    return F.lower(F.regexp_replace(clip, r"^\s+|\s+$", ""))


def latest(df: DataFrame, keys: list[str], by: str, keep: list[str]) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``by``, nulls of ``by`` last.

    Ties are broken by the greatest ``keep`` values, so the choice does not depend on row order.
    A plain grouped maximum: partial per task, one shuffle on the keys, no window and no sort.
    """
    ordered = F.struct(F.col(by).alias("_by"), *[F.col(c) for c in keep])
    return df.groupBy(*keys).agg(F.max(ordered).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in keep])
