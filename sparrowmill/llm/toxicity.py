"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.common import labelled, release, written
from sparrowmill.sources import table

TOKEN = re.compile(r"[^\W_]+")
BUCKETS = 1 << 18
#: What cross-validation chooses from, the first of equally good ones: prior, drift, least score of a segment.
GRID = [(prior, drift, least) for prior in (1.0, 3.0, 10.0) for drift in (0.1, 0.3) for least in (1.0, 2.0)]
FOLDS = 4


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token, 42) % BUCKETS


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n = {}
        for text, label, fold in zip(b["_text"], b["label"], b["fold"], strict=True):
            for token in set(TOKEN.findall((text or "").lower())):
                n[token, label, fold] = n.get((token, label, fold), 0) + 1
        yield pd.DataFrame([(bucket(t), int(label), int(fold), c) for (t, label, fold), c in n.items()], columns=["bucket", "label", "fold", "n"])


def log_odds(n: np.ndarray, prior: float, drift: float, most: float = 6.0) -> np.ndarray:
    """Per bucket of ``n (label, bucket)``, the log odds of toxic against other
    text under a Dirichlet prior of ``prior`` tokens a bucket, dealt to the two as
    their totals are, so that an unseen token scores 0; less ``drift``, which
    makes the expected score of a token negative."""
    part = np.maximum(n.sum(axis=1, keepdims=True), 1)
    rate = np.log(n / (part / part.sum()) + prior)
    return np.clip(rate[1] - rate[0], -most, most) - drift


def segments(scores: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score) with a score of
    ``least`` or more, in one pass: each segment in hand knows the sums before
    and after it, and a new positive one takes in those that it extends."""
    total = np.cumsum(scores)
    hand: list[tuple[int, int, float, float]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, float(total[i] - scores[i]), float(total[i])
        while True:
            j = len(hand) - 1
            # The stack keeps, below each segment, only those that start lower.
            while j >= 0 and hand[j][2] >= low:
                j = -1 if hand[j][4] is None else hand[j][4]
            if j < 0 or hand[j][3] >= high:
                hand.append((start, end, low, high, j if j >= 0 else None))
                break
            start, low = hand[j][0], hand[j][2]
            del hand[j:]
    return [(a, b, high - low) for a, b, low, high, _ in hand if high - low >= least]


class Scorer:
    """Segments and scores of texts. ``rate`` and ``size`` are the extreme-value
    parameters of the best segment's score over ``n`` tokens of clean text:
    P(score >= s) = 1 - exp(-size * n * exp(-rate * s))."""

    def __init__(self, odds: np.ndarray, least: float):
        self.odds, self.least, self.cache = odds, least, {}
        self.rate, self.size, self.slope, self.base = 1.0, 1.0, 1.0, 0.0

    def token_scores(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > 500_000:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = float(self.odds[bucket(w)])
        return np.fromiter((cache[w] for w in words), float, len(words))

    def read(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens, and segments as (first character, end, score)."""
        low = (text or "").lower()
        words = TOKEN.findall(low)
        found = segments(self.token_scores(words), self.least)
        if found:
            at = [m.span() for m in TOKEN.finditer(low)]
            found = [(at[a][0], at[b - 1][1], s) for a, b, s in found]
        return len(words), found

    def evidence(self, n: int, scores: list[float]) -> float:
        """Minus log of the chance of the best segments: the smallest, over the
        r best, of the chance that clean text has r segments that good."""
        best = 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            mean = self.size * max(n, 1) * math.exp(-self.rate * s)
            # Poisson tail: at most mean^r / r!.
            tail = r * math.log(max(mean, 1e-300)) - math.lgamma(r + 1) if r > 1 else math.log(max(-math.expm1(-mean), 1e-300))
            best = max(best, -tail)
        return min(best, 60.0)

    def score(self, n: int, scores: list[float]) -> float:
        z = self.slope * math.log1p(self.evidence(n, scores)) + self.base
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _tried(batches: Iterator[pd.DataFrame], counts: np.ndarray) -> Iterator[pd.DataFrame]:
    """Each text read with every choice by a model that has not seen its fold."""
    least = min(g[2] for g in GRID)
    rest = counts.sum(axis=0) - counts
    scorers = {(p, d, f): Scorer(log_odds(rest[f], p, d).astype(np.float32), least) for p, d in {g[:2] for g in GRID} for f in range(FOLDS)}
    for b in batches:
        rows = []
        for text, label, fold in zip(b["_text"], b["label"], b["fold"], strict=True):
            read = {}
            for i, (prior, drift, floor) in enumerate(GRID):
                if (prior, drift) not in read:
                    read[prior, drift] = scorers[prior, drift, fold].read(text)
                n, found = read[prior, drift]
                rows.append((i, n, [s for *_, s in found if s >= floor], label))
        yield pd.DataFrame(rows, columns=["choice", "n", "scores", "label"])


def _weighed(batches: Iterator[pd.DataFrame], scorers: list[Scorer]) -> Iterator[pd.DataFrame]:
    for b in batches:
        x = [math.log1p(scorers[i].evidence(n, list(s))) for i, n, s in zip(b["choice"], b["n"], b["scores"], strict=True)]
        yield pd.DataFrame({"choice": b["choice"], "x": x, "label": b["label"]})


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope and base of the probability of 1, and the mean loss, by Newton's steps."""
    a, b = 1.0, -1.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * x).sum() - 1e-3 * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
    z = np.clip(a * x + b, -30, 30)
    return float(a), float(b), float(np.mean(np.log1p(np.exp(z)) - y * z))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", max_labels: int = 100_000, max_tried: int = 10_000) -> Scorer:
    """Learns from at most about ``max_labels`` labelled rows, whose tokens are
    counted on Spark by fold, a hash of the id, into a fixed number of buckets.

    At most about ``max_tried`` of them are read by models of the other folds,
    with every choice of ``GRID``: from those labelled 0 come the extreme-value
    parameters, from all a logistic curve from evidence to probability. The choice
    of the smallest loss is taken, with its parameters and the counts of all
    folds. No other row than those of ``labels`` has a part in this."""
    known = F.broadcast(labelled(labels, F.col(label).cast("int"), max_labels).withColumnRenamed("doc_id", "_id"))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_text")).join(known, "_id")
    rows = written(rows.select("_text", "label", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold"), F.pmod(F.xxhash64("_id", F.lit(4)), F.lit(1 << 30)).alias("_u")))
    found = rows.mapInPandas(_counts, "bucket int, label int, fold int, n long")
    cell = [F.sum(F.when((F.col("fold") == f) & (F.col("label") == y), F.col("n")).otherwise(0)).cast("int").alias(f"n{f}_{y}") for f in range(FOLDS) for y in (0, 1)]
    by_bucket = found.groupBy("bucket").agg(*cell).toPandas()  # as many rows as buckets at most
    counts = np.zeros((FOLDS, 2, BUCKETS), np.int32)
    counts[:, :, by_bucket["bucket"].to_numpy()] = by_bucket.drop(columns="bucket").to_numpy(np.int32).T.reshape(FOLDS, 2, -1)
    del by_bucket
    some = rows.filter(F.col("_u") < int((1 << 30) * min(1.0, max_tried / max(1, rows.count()))))
    tried = written(some.mapInPandas(lambda it: _tried(it, counts), "choice int, n long, scores array<double>, label int"))
    sums = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s)
    clean = {r["choice"]: r for r in tried.filter("label = 0").groupBy("choice").agg(F.sum("n").alias("n"), F.sum(F.size("scores")).alias("found"), F.sum(sums).alias("total")).collect()}
    scorers = []
    for i, (prior, drift, least) in enumerate(GRID):
        scorers.append(Scorer(np.zeros(0), least))
        if i in clean and clean[i]["n"]:
            n, found = clean[i]["n"], clean[i]["found"]
            # Scores over the threshold of clean text fall off exponentially.
            over = clean[i]["total"] / found - least if found else 1.0
            scorers[i].rate = float(min(3.0, max(0.05, 1 / max(1e-3, over))))
            scorers[i].size = float(max(found, 1) / n * math.exp(scorers[i].rate * least))
    got = tried.mapInPandas(lambda it: _weighed(it, scorers), "choice int, x double, label int").toPandas()
    losses = []
    for i, s in enumerate(scorers):
        x, y = (got.loc[got["choice"] == i, c].to_numpy(float) for c in ("x", "label"))
        if len(y) and 0 < y.sum() < len(y):
            s.slope, s.base, loss = logistic(x, y)
            losses.append((loss, i))
        else:
            s.base = -2.0
    best = min(losses)[1] if losses else 0
    out = scorers[best]
    out.odds = log_odds(counts.sum(axis=0), *GRID[best][:2])
    release(rows, tried)
    return out


def _scored(batches: Iterator[pd.DataFrame], scorer: Scorer) -> Iterator[pd.DataFrame]:
    for b in batches:
        read = [scorer.read(t) for t in b["_text"]]
        yield b.drop(columns="_text").assign(
            score=[scorer.score(n, [s for *_, s in found]) for n, found in read],
            passages=[[{"start": a, "end": z, "score": s} for a, z, s in found] for _, found in read],
        )


def score(docs: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, passages)`` per row; passages are (start, end, score) in
    characters. Null and empty texts have no passages and the lowest score;
    very long ones are read whole; of equal stretches the first is a passage;
    repeated rows score alike; without labels of both kinds all score low; an
    empty table gives no rows; other columns are not carried."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInPandas(lambda it: _scored(it, scorer), "doc_id long, score double, passages array<struct<start:int,end:int,score:double>>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, odd rows as in :func:`score`. Held-out labels take
    no part in the fit, nor in the choice of its parameters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scorer = fit(docs, table(spark, sf_dir, "labels").filter(~held))
    return score(docs, scorer).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
