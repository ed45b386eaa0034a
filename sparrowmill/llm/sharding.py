"""Sharding by sampled splitters."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.llm.common import without, written
from sparrowmill.sources import table


def splitters(drawn: Iterable[tuple[int, object, float]], parts: dict[int, int]) -> tuple[list, list]:
    """From weighted keys ``(range, key, weight)`` the quantile boundaries that
    divide each range into about ``parts[range]``: keys that end a part, and keys
    that begin one. A key of a part's weight or more begins and ends its own."""
    weights: dict[int, dict] = defaultdict(lambda: defaultdict(float))
    for place, key, weight in drawn:
        weights[place][key] += weight
    ends, begins = [], []
    for place, own in weights.items():
        goal, held = sum(own.values()) / parts[place], 0.0
        for key, weight in sorted(own.items()):
            held += weight
            if weight >= goal:
                begins.append(key)
            if held >= goal or weight >= goal:
                ends.append(key)
                held = 0.0
    return ends, begins


def passed(key: Column, bounds: list, met: bool) -> Column:
    """How many of the sorted ``bounds`` are below ``key``, or with ``met`` equal
    to it: first among every so many of them, then among those between."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def count(some: Column) -> Column:
        return F.size(F.filter(some, lambda b: b <= key if met else b < key))

    coarse = count(F.array(*[F.lit(g[-1]) for g in groups]))
    rest = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), coarse)
    return F.when(coarse == len(groups), len(bounds)).otherwise(coarse * step + count(rest))


def ranged(rows: DataFrame, ranges: int, overfull: float, most_rows: int, per_range: int, rounds: int) -> tuple[DataFrame, dict[int, int]]:
    """``rows (_key, _size, _row)`` with ``_range``, ranges of keys in their order,
    and how many parts each of those needs that hold one key and too much of it.

    The first round draws keys from all rows, with a chance that grows with their
    size, and cuts at quantiles; each later one draws in the same way within the
    ranges that hold too much yet, so that they are cut by key as well. About
    ``per_range`` keys come to the driver for each range that is made: there are
    about twice ``ranges`` of these, or one for every ``most_rows`` rows."""
    ends: set = set()
    begins: set = set()
    mean_bytes = mean_rows = 1
    for turn in range(rounds + 1):
        key = F.col("_key")
        place = passed(key, sorted(ends), False) + passed(key, sorted(begins), True) + 1
        placed = rows.withColumn("_range", F.when(key.isNull(), 0).otherwise(place).cast("int"))
        found = placed.groupBy("_range").agg(F.sum("_size").alias("b"), F.count("*").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high")).collect()
        if not turn:
            mean_bytes = max(1, sum(r["b"] for r in found) // ranges)
            mean_rows = min(most_rows, max(1, sum(r["n"] for r in found) // ranges))
        # Bytes decide where shards end, rows how much one task has to sort.
        full = [r for r in found if r["b"] > overfull * mean_bytes or r["n"] > overfull * mean_rows]
        parts = {r["_range"]: max(-(-r["b"] // mean_bytes), -(-r["n"] // mean_rows)) for r in full}
        mixed = [r for r in full if r["low"] != r["high"]]
        if not mixed or turn == rounds:
            return placed, {r["_range"]: parts[r["_range"]] for r in full if r["low"] == r["high"]}
        share = [(0.0, 0.0)] * (max(r["_range"] for r in found) + 1)
        for r in mixed:
            rate = float(per_range * parts[r["_range"]])
            share[r["_range"]] = (rate / r["b"] if r["b"] > overfull * mean_bytes else 0.0, rate / r["n"] if r["n"] > overfull * mean_rows else 0.0)
        by_bytes, by_rows = (F.get(F.array(*[F.lit(x[i]) for x in share]), F.col("_range")) for i in (0, 1))
        rate = F.greatest(F.col("_size") * by_bytes, by_rows)
        chance = F.pmod(F.xxhash64("_row", F.lit(7 + turn)), F.lit(1 << 30)) / float(1 << 30)
        drawn = placed.filter(F.col("_key").isNotNull() & (chance < rate)).select("_range", "_key", F.greatest(rate, F.lit(1.0)))
        more = splitters((tuple(r) for r in drawn.collect()), parts)
        ends |= set(more[0])
        begins |= set(more[1])
    raise AssertionError


def shard(df: DataFrame, shards: int = 8, key: str = "doc_id", size: str = "size", ranges_per_shard: int = 16, overfull: float = 2.0, most_rows: int = 1_000_000, per_range: int = 40, rounds: int = 4) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1, ranges of ``key``) and ``slot`` (gapless
    in a shard) so that shards hold equal sums of ``size``, each within one row.

    Size-weighted sampled keys give quantile boundaries; a range of over
    ``overfull`` times the mean in bytes or rows (or ``most_rows``) is subdivided
    by keys drawn within it, for up to ``rounds`` rounds, and rows of one key that
    are too many by row number. Exact byte offsets of the pieces then place every
    row; a shard ends where the running sum crosses its share, so two shards
    have no more than one key in common.

    Null keys form one range before all others and null sizes count 0; very long
    texts count by their size alone; rows with equal keys, repeated ones among
    them, keep an order fixed once; an empty table gives no rows; a column named
    ``shard`` or ``slot`` is replaced."""
    rows = without(df, "shard", "slot")
    rows = written(rows.withColumns({"_key": F.col(key), "_size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "_row": F.monotonically_increasing_id()}))
    total = rows.agg(F.sum("_size")).first()[0] or 0
    rows, full = ranged(rows, shards * ranges_per_shard, overfull, most_rows, per_range, rounds)
    parts = F.coalesce(F.get(F.array(*[F.lit(int(full.get(i, 1))) for i in range(max(full, default=0) + 1)]), F.col("_range")), F.lit(1))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_row"), parts).cast("int"))
    pieces = rows.groupBy("_range", "_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    # Few rows in one task: pieces are about twice the ranges, or one for every `most_rows` rows.
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_range", "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_r0"))
    order = Window.partitionBy("_range", "_part").orderBy("_key", "_row")
    rows = rows.join(F.broadcast(pieces), ["_range", "_part"])
    rows = rows.withColumns({
        "_at": F.col("_b0") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"),
        "_nth": F.col("_r0") + F.row_number().over(order) - 1,
    })
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("_at") * shards / F.lit(max(1, total)))).cast("int"))
    firsts = rows.groupBy("shard").agg(F.min("_nth").alias("_first"))
    out = rows.join(F.broadcast(firsts), "shard").withColumn("slot", (F.col("_nth") - F.col("_first")).cast("long"))
    return out.drop("_key", "_size", "_row", "_range", "_part", "_b0", "_r0", "_at", "_nth", "_first")


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of equal bytes, by ranges of doc_id. A null text
    counts as an empty one, of size 1; null ids come first; very long, equal and
    repeated rows as in :func:`shard`."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_shard_documents": op1_shard_documents}
ORACLE_SQL: dict[str, str] = {}
