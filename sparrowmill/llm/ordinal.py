"""Ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.common import labelled
from sparrowmill.sources import table

DIM = 1 << 12
DENSE = 8


WORDS = re.compile(r"[^\W_]+")


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features: its hashed words, signed and of
    length one, and a few measures of it in the last places. One pass counts
    words and one counts characters; the rest is done per distinct one."""
    t = text or ""
    words = Counter(WORDS.findall(t.lower()))
    chars = Counter(t)
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=np.uint64)
    values = (1 + np.log(np.array(list(words.values()), dtype=float))) * np.where(hashes >> np.uint64(63), 1.0, -1.0)
    at, place = np.unique((hashes % np.uint64(DIM - DENSE)).astype(np.int64), return_inverse=True)
    x = np.bincount(place, values, minlength=len(at))
    x = x / (np.sqrt((x * x).sum()) or 1)
    total, n, size = words.total(), max(1, words.total()), max(1, len(t))
    letters = sum(len(w) * c for w, c in words.items())
    lines = [y for y in t.split("\n") if y.strip()]
    dense = np.array([
        min(2, np.log1p(total) / 4), len(words) / n, letters / n / 8, sum(k for c, k in chars.items() if c.isupper()) / size * 4,
        sum(k for c, k in chars.items() if c.isdigit()) / size * 4, min(2, sum(chars[c] for c in "#*$%&|<>!") / n * 4), len(set(lines)) / max(1, len(lines)), min(2, chars["."] / n * 8),
    ])
    at, x = np.concatenate([at, np.arange(DIM - DENSE, DIM)]), np.concatenate([x, dense])
    return at[x != 0], x[x != 0]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = [vector(t) for t in b["_text"]]
        yield pd.DataFrame({"at": [a.astype("<i4").tobytes() for a, _ in made], "x": [v.astype("<f4").tobytes() for _, v in made], "label": b["label"].to_numpy()})


class Model:
    """P(grade <= k) = sigmoid(threshold k - w.x), thresholds in order."""

    def __init__(self, w: np.ndarray, thresholds: np.ndarray):
        self.w, self.thresholds = w, thresholds

    def tails(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the top grade."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.w[at] @ x, -30, 30)))


def cuts(theta: np.ndarray) -> np.ndarray:
    """The thresholds: a first one and positive gaps, so they cannot cross."""
    return theta[DIM] + np.concatenate([[0.0], np.cumsum(np.exp(theta[DIM + 1 :]))])


def loss(theta: np.ndarray, row: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, grades: int, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of grades ``y`` with a ridge on the weights,
    and its gradient by ``theta``: weights, first threshold, logs of the gaps.
    ``row``, ``at`` and ``x`` are the entries of all vectors."""
    w, gaps, limits = theta[:DIM], theta[DIM + 1 :], cuts(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    f = np.bincount(row, w[at] * x, minlength=len(y))
    upper = np.where(y < grades - 1, sig(limits[np.minimum(y, grades - 2)] - f), 1.0)
    lower = np.where(y > 0, sig(limits[np.maximum(y - 1, 0)] - f), 0.0)
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    df = (du - dl) / len(y)
    dc = np.array([(dl[y == k + 1].sum() - du[y == k].sum()) / len(y) for k in range(grades - 1)])
    rest = np.cumsum(dc[::-1])[::-1]
    return -np.log(p).mean() + ridge / 2 * (w @ w), np.concatenate([np.bincount(at, df[row] * x, minlength=DIM) + ridge * w, [rest[0]], rest[1:] * np.exp(gaps)])


def fit(docs: DataFrame, ratings: DataFrame, rating, grades: int, text: str = "text", max_labels: int = 6_000, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """Fits on at most ``max_labels`` rated rows, whose hashed vectors (at most
    ``DIM`` entries each, 200 MB in all if each were full) come to the driver."""
    known = F.broadcast(labelled(ratings, rating.cast("int"), max_labels).withColumnRenamed("doc_id", "_id"))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_text")).join(known, "_id")
    got = rows.select("_text", "label").mapInPandas(_features, "at binary, x binary, label int").collect()
    theta = np.concatenate([np.zeros(DIM), [-1.0], np.zeros(max(0, grades - 2))])
    if not got:
        return Model(theta[:DIM], cuts(theta))
    row = np.repeat(np.arange(len(got)), [len(r["at"]) // 4 for r in got])
    at = np.concatenate([np.frombuffer(r["at"], "<i4") for r in got])
    x = np.concatenate([np.frombuffer(r["x"], "<f4") for r in got]).astype(float)
    y = np.array([r["label"] for r in got])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = loss(theta, row, at, x, y, grades, ridge)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:DIM], cuts(theta))


def _graded(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for b in batches:
        tails = [model.tails(*vector(t)) for t in b["_text"]]
        yield b.drop(columns="_text").assign(expected_grade=[float(t.sum()) for t in tails], tails=[t.tolist() for t in tails])


def grade(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, expected_grade, tails)``; ``tails[k]`` is P(grade > k). Null and
    empty texts get the grade of a text without words; very long ones are read
    whole; repeated rows and equal texts grade alike; without ratings all grade
    alike; an empty table gives no rows; other columns are not carried."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInPandas(lambda it: _graded(it, model), "doc_id long, expected_grade double, tails array<double>")


def three_grades() -> Column:
    """Grades of the labels: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades by :func:`three_grades`. Kept from a probability of one half that the grade is over 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), three_grades(), 3)
    return grade(docs, model).select("doc_id", "expected_grade", F.get("tails", F.lit(0)).alias("p_good"), F.get("tails", F.lit(1)).alias("p_best"), (F.get("tails", F.lit(0)) >= 0.5).alias("kept"))


QUERIES = {"op6_ordinal_quality": op6_ordinal_quality}
ORACLE_SQL: dict[str, str] = {}
