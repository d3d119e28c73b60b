"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table, narrowed to the named columns so that only they are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """Redelivered rows repeat an earlier row of the same id unchanged; keep one."""
    return df.dropDuplicates([key])
