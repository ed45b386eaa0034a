"""Relational operators that several jobs share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key under ``order``, which must break ties.

    Spark prunes each group to k rows before the shuffle (WindowGroupLimit), so
    a hot key sends at most k rows from each task."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(rank) <= k)


def sessions(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """Number the sessions of each key: a new one starts after a pause of more
    than ``gap_seconds``. One shuffle on ``key`` serves both windows."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    pause = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w))
    starts = F.when(pause.isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0)
    return df.withColumn("_starts", starts).withColumn("session", F.sum("_starts").over(w)).drop("_starts")
