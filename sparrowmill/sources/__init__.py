"""Readers for the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``. The path goes to Spark's reader as it
    is, so any file system that Spark knows will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
