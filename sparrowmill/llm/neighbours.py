"""Nearest vectors by p-stable hashing with probes in the order of their estimated success."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.llm.common import is_empty, written
from sparrowmill.sources import table

NEAR = "query_id long, vec_id long, score double"


@dataclass
class Index:
    """``tables`` hash tables of ``width``-wide buckets along ``functions`` Gaussian
    directions each. ``radius`` is a distance within which the neighbours looked
    for lie, ``mass`` the part of them that the probes of a table shall meet.

    Inner products become distances by one more coordinate that brings all
    vectors to the length of the longest, ``longest``: the largest product is the
    smallest distance then. Queries have length 1 and 0 there."""

    directions: np.ndarray  # table, function, coordinate
    shifts: np.ndarray
    width: float
    longest: float
    radius: float
    mass: float

    def keys(self, hashes: np.ndarray, t: int) -> np.ndarray:
        """64-bit bucket numbers; two buckets under one number only add candidates."""
        key = np.full(len(hashes), t + 1, np.uint64)
        for h in hashes.T:
            key = (key ^ h.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key.view(np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])
        return np.stack([self.keys(np.floor((x @ d.T + b) / self.width), t) for t, (d, b) in enumerate(zip(self.directions, self.shifts, strict=True))], axis=1)

    def probes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets to visit for a query, and each one's place in its table's order.
        Along a direction a neighbour lies off the query by a Gaussian of the
        radius, so a bucket's chance is a product of one factor for each; the
        most likely buckets come first, until they add up to ``mass``."""
        keys, places = [], []
        for t, (d, b) in enumerate(zip(self.directions, self.shifts, strict=True)):
            at = d[:, :-1] @ (q / np.linalg.norm(q)) + b
            options = []
            for f in at:
                h = np.arange(math.floor((f - 5 * self.radius) / self.width), math.floor((f + 5 * self.radius) / self.width) + 1)
                edges = [0.5 * (1 + math.erf(z)) for z in (np.append(h, h[-1] + 1) * self.width - f) / (self.radius * math.sqrt(2))]
                options.append(sorted(zip(np.diff(edges).tolist(), h.tolist(), strict=True), reverse=True))
            chance = math.prod(o[0][0] for o in options)
            heap, met, found = [(-chance, (0,) * len(options), 0)], 0.0, []
            while heap and met < self.mass:
                negative, picks, last = heapq.heappop(heap)
                met -= negative
                found.append([o[i][1] for o, i in zip(options, picks, strict=True)])
                # Every bucket has one way there: directions take turns, from the first to the last.
                for k in range(last, len(options)):
                    if (i := picks[k] + 1) < len(options[k]) and (p := options[k][i][0]) > 0:
                        heapq.heappush(heap, (negative / options[k][i - 1][0] * p, (*picks[:k], i, *picks[k + 1 :]), k))
            keys.append(self.keys(np.array(found).reshape(-1, len(options)), t))
            places.append(np.arange(len(found)))
        return np.concatenate(keys), np.concatenate(places)


def stacked(values: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(-1, dims)


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """For each query its ``k`` vectors of largest product among ``x`` whose product
    is ``least`` or more, ties by id. Products are first made together, then those
    that can count again, each by itself: equal vectors have equal ones anywhere."""
    slack = 1e-12 * np.linalg.norm(q, axis=1) * (np.linalg.norm(x, axis=1).max() if len(x) else 0)
    for a in range(0, len(q), 64):
        part = slice(a, a + 64)
        s = q[part] @ x.T
        s[query_ids[part][:, None] == ids] = -np.inf
        floor = least[part]
        if len(ids) > k:
            floor = np.maximum(floor, np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k])
        i, j = np.nonzero((s >= (floor - slack[part])[:, None]) & (s > -np.inf))
        score = np.concatenate([np.zeros(0), *((x[j[c : c + 8192]] * q[part][i[c : c + 8192]]).sum(axis=1) for c in range(0, len(i), 8192))])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        out = pd.DataFrame({"query_id": query_ids[part][i], "vec_id": ids[j], "score": score})
        yield out[nth < k]


def against_all(rows: DataFrame, queries: list[tuple[int, bytes]], dims: int, k: int) -> DataFrame:
    """``NEAR`` of a bounded list of queries, each against every row."""
    query_ids, q = np.array([i for i, _ in queries]), stacked(pd.Series([v for _, v in queries]), dims)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        for b in batches:
            found = pd.concat([held, *nearest(b["vec_id"].to_numpy(), stacked(b["v"], dims), query_ids, q, np.full(len(q), -np.inf), k)])
            held = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        yield held

    return first(rows.select("vec_id", "v").mapInPandas(scan, NEAR), k)


def first(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` ids of each query, with ``rank``."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(vec_id, v, size)``: rows with an id and a vector that is neither zero
    nor holds a null or a number that is not finite; ``v`` as doubles in bytes."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias(vector))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).filter(good & F.exists(vector, lambda x: x != 0))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [np.asarray(x, np.float64) for x in b[vector]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [x.tobytes() for x in v], "size": [len(x) for x in v], "norm": [float(np.linalg.norm(x)) for x in v]})

    return rows.mapInPandas(packed, "vec_id long, v binary, size int, norm double")


def fitted(rows: DataFrame, dims: int, k: int, tables: int, bucket: int, recall: float, sample: int, tried: int) -> tuple[Index, int]:
    """An index over ``rows``, and how many there are. Bucket widths come from the
    spread of ``sample`` vectors, the radius from the true neighbours of ``tried``
    of them, found among all rows: nine in ten have their ``k`` nearest in it."""
    n, longest = rows.agg(F.count("*"), F.max("norm")).first()
    some = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(12)), "v").limit(sample).collect()
    x = stacked(pd.Series([r.v for r in some]), dims)
    drawn = dict(zip((r.vec_id for r in some), x, strict=True))
    near = against_all(rows, [(i, v.tobytes()) for i, v in list(drawn.items())[:tried]], dims, k).groupBy("query_id").agg(F.min("score").alias("score")).collect()
    radius = [math.sqrt(max(0.0, 2 - 2 * r.score / (np.linalg.norm(drawn[r.query_id]) * longest))) for r in near]
    functions = max(1, round(math.log2(max(2, n / bucket)) / 1.3))
    rng = np.random.default_rng(12)
    directions = rng.standard_normal((tables, functions, dims + 1))
    x = x / longest
    x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])
    width = max(1e-6, 2 * float(np.median((x @ directions.reshape(-1, dims + 1).T).std(axis=0))))
    shifts = rng.uniform(0, width, (tables, functions))
    return Index(directions, shifts, width, longest, max(1e-9, float(np.quantile(radius or [1.0], 0.9))), 1 - (1 - recall) ** (1 / tables)), n


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = 2, bucket: int = 512, recall: float = 0.97, early: int = 4, sample: int = 2000, tried: int = 100, most: int = 2048) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the ``k`` ids
    of ``vectors`` with the largest inner product, as far as found, its own id
    left out.

    Every vector is in one bucket of about ``bucket`` in each table; a query
    visits buckets in the order of their chance to hold a neighbour until those
    add up to ``recall`` over all tables. The ``early`` first ones of a table give
    each query a product to beat, so later ones return few. Within a bucket
    products are exact. Buckets meet queries in cells of ``most`` vectors and
    ``most`` queries: crowded ones make more cells, not larger ones. A query that
    found too few goes against all rows, in blocks. The fit uses ``sample`` rows.

    Vectors null, zero, holding null or non-finite components, without an id or
    of another length than most take no part; ids come from few or many rows, of
    which the best counts; equal products go by id; fewer than ``k`` others are
    all returned; empty tables give no rows; other columns are ignored."""
    rows = written(usable(vectors, key, vector))
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    dims = sizes[0]["size"] if sizes else 1
    rows = rows.filter(F.col("size") == dims)
    asked = usable(queries, key, vector).filter(F.col("size") == dims).select(F.col("vec_id").alias("query_id"), "v")
    if not sizes:
        return rows.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    index, n = fitted(rows, dims, k, tables, bucket, recall, sample, tried)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = index.rows(stacked(b["v"], dims))
            for t in range(tables):
                yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "key": keys[:, t]})

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 16):
                part = b.iloc[i : i + 16]
                found = [index.probes(q) for q in stacked(part["v"], dims)]
                count = [len(keys) for keys, _ in found]
                yield pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), count), "key": np.concatenate([x for x, _ in found]), "early": np.concatenate([y for _, y in found]) < early})

    placed = written(rows.select("vec_id", "v").mapInPandas(hashed, "vec_id long, v binary, key long"))
    asked = written(asked)
    visits = written(asked.mapInPandas(probed, "query_id long, key long, early boolean").distinct())
    # Each side of a bucket goes into parts of at most about `most`; every two parts make a cell.
    met = placed.groupBy("key").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    met = written(met.join(visits.groupBy("key").agg(F.ceil(F.count("*") / most).cast("int").alias("query_parts")), "key"))

    def cells(df: DataFrame, own: str, other: str, name: str, across: str, by: str) -> DataFrame:
        dealt = df.join(met, "key").withColumn(name, F.pmod(F.xxhash64(by, F.lit(13)), F.col(own)).cast("int"))
        return dealt.withColumn(across, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("parts", "query_parts")

    def looked(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.concat(nearest(x["vec_id"].to_numpy(), stacked(x["v"], dims), q["query_id"].to_numpy(), stacked(q["v"], dims), q["least"].to_numpy(), k))

    def found(visits: DataFrame, least: DataFrame | None) -> DataFrame:
        q = visits.join(asked, "query_id")
        q = q.join(least, "query_id", "left").fillna(-math.inf, ["least"]) if least is not None else q.withColumn("least", F.lit(-math.inf))
        q = cells(q, "query_parts", "parts", "r", "c", "query_id").groupBy("key", "c", "r")
        x = cells(placed, "parts", "query_parts", "c", "r", "vec_id").groupBy("key", "c", "r")
        return x.cogroup(q).applyInPandas(looked, NEAR)

    start = written(found(visits.filter("early"), None))
    least = first(start, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = written(found(visits.filter("NOT early"), written(least)))
    best = written(first(start.union(more), k))
    others = min(k, n - 1)
    short = asked.select("query_id").distinct().join(best.groupBy("query_id").count(), "query_id", "left").filter(F.coalesce("count", F.lit(0)) < others).select("query_id")
    short = written(short.withColumn("block", F.floor(F.monotonically_increasing_id() / 1000)))
    if not is_empty(short):
        full = best.join(short, "query_id", "left_anti")
        # Rare: queries far from everything. A block of 1,000 at a time is sent to the tasks.
        for (block,) in short.select("block").distinct().collect():
            some = [tuple(r) for r in asked.join(short.filter(F.col("block") == block), "query_id").select("query_id", "v").collect()]
            full = full.union(written(against_all(rows, some, dims, k)))
        best = full
    return best.select("query_id", "rank", "vec_id", "score")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by id, odd rows as in :func:`search`."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


QUERIES = {"op12_neighbours": op12_neighbours}
ORACLE_SQL: dict[str, str] = {}
