"""Quality rules under weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.common import SPACE, identity, only, settled, without, written
from sparrowmill.sources import table

HELPERS = ("_upper", "_letters", "_ends", "_common", "_bare", "_marked")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The commonest function words of English, French, German and Spanish.
COMMON = (
    "a an and are as at be by for from has have in is it not of on or that the this to was were with "
    "au aux ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "auf das dem den der des die ein eine für ist mit nicht sich und von zu "
    "al como con del el es las lo los más no para por se su y"
).split()
ADDED = (*COUNTS, "base_failed", "votes", "p_good", "kept")


def counts(df: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """Adds the counts of the rules, those that are not results under names with an
    underscore: capitals, letters, sentence ends, function words, words without a
    letter or digit, and words with symbols stuck to them. Windows of words are compared by 64-bit hash within a row; nothing is
    exploded, so no text is shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_w", F.filter(F.split(t, SPACE), lambda w: w != ""))
    n = F.size("_w")
    heads = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_h", F.transform(heads, lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(window)])))
    # Only texts in which a window comes again are looked at place by place.
    found = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), found))
    s = F.col("_s")
    again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    df = df.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_p", start, lambda a, i: F.struct((a["n"] + i + window - F.greatest(a["end"], i)).alias("n"), (i + window).alias("end")))["n"]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
        "_letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")),
        "_ends": F.length(F.regexp_replace(t, r"[^.!?]+", "")),
        "_common": F.size(F.filter("_w", lambda w: w.isin(COMMON))),
        "_bare": F.regexp_count(t, F.lit(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)")),
        "_marked": F.regexp_count(t, F.lit(r"[^\s#*$%&|<>][#*$%&|<>]")),
    }).drop("_w", "_h", "_s", "_p")


def rules() -> list[Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    n, letters = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("_letters"), F.lit(1))
    mean = F.col("word_chars") / n

    def vote(good, bad):
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return [
        vote(n >= 30, n < 10),
        vote(mean.between(3.5, 9), (mean < 2.2) | (mean > 14)),
        vote(F.col("n_symbols") < 0.02 * n, F.col("n_symbols") > 0.2 * n),
        vote(F.col("n_repeat_words") < 0.05 * n, F.col("n_repeat_words") > 0.2 * n),
        vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") > 3),
        vote(F.col("_upper") < 0.15 * letters, F.col("_upper") > 0.6 * letters),
        vote(F.col("_letters") > 0.92 * F.col("word_chars"), F.col("_letters") < 0.8 * F.col("word_chars")),
        vote(F.col("_ends").between(0.01 * n, 0.25 * n), F.col("_ends") > 0.7 * n),
        vote(F.col("_common") > 0.06 * n, (F.col("_common") < 0.02 * n) & (n >= 30)),
        vote(F.col("_bare") < 0.02 * n, F.col("_bare") > 0.1 * n),
        vote(F.col("_marked") < 0.02 * n, F.col("_marked") > 0.1 * n),
    ]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over vote patterns and their row counts: the log
    prior odds of good, and per rule the log-likelihood ratio of each vote.

    It starts from texts that no rule votes against, which fixes the class that
    is good. A prior worth a hundredth of the rows says that rules seldom vote
    against good texts, and that a bad text often fails few of the rules."""
    m, rows = len(patterns[0][0]) if patterns else 0, sum(c for _, c in patterns)
    posts = [0.05 if -1 in v else 0.95 for v, _ in patterns]
    base, odds = 0.0, [dict.fromkeys((1, 0, -1), 0.0) for _ in range(m)]
    weight = 0.01 * rows + 1
    for _ in range(rounds if patterns else 0):
        good = sum(c * p for (_, c), p in zip(patterns, posts, strict=True))
        share = (good + 0.8 * weight) / (rows + weight)
        base = math.log(share / (1 - share))
        for j in range(m):
            g = {1: 0.9 * weight, 0: 0.095 * weight, -1: 0.005 * weight}
            b = {1: 0.6 * weight, 0: 0.1 * weight, -1: 0.3 * weight}
            for (v, c), p in zip(patterns, posts, strict=True):
                g[v[j]] += c * p
                b[v[j]] += c * (1 - p)
            odds[j] = {x: math.log(g[x] / sum(g.values())) - math.log(b[x] / sum(b.values())) for x in (1, -1)}
            # A vote never counts against its own side; who abstains says nothing.
            odds[j] = {1: max(0.0, odds[j][1]), 0: 0.0, -1: min(0.0, odds[j][-1])}
        posts = [1 / (1 + math.exp(-max(-30.0, min(30.0, base + sum(odds[j][x] for j, x in enumerate(v)))))) for v, _ in patterns]
    return base, odds


def votes(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts, ``base_failed`` and ``votes``."""
    voted = counts(df, text).withColumn("votes", F.array(*rules()))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.withColumn("base_failed", failed).drop(*HELPERS)


def posterior(voted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A written table of ``votes`` with ``p_good`` and ``kept``. Votes are counted
    by pattern over all rows (at most 3 to the number of rules patterns, and far
    fewer in a corpus, reach the driver); accuracies are estimated from them."""
    patterns = sorted((tuple(r[0]), r[1]) for r in voted.groupBy("votes").count().collect())
    base, odds = fit(patterns)
    logit = F.lit(base)
    for j, o in enumerate(odds):
        v = F.get("votes", F.lit(j))
        logit = logit + F.when(v == 1, o[1]).when(v == -1, o[-1]).otherwise(0.0)
    scored = voted.withColumn("p_good", 1 / (1 + F.exp(-logit)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def judge(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns of ``df`` but ``text``, with the counts, ``base_failed``,
    ``votes``, ``p_good`` (posterior that the text is good) and ``kept``. The
    posterior is a sum over each row's votes; texts are read once and neither
    written nor shuffled.

    A null or empty text has no words and fails the base rule; a very long one
    is counted whole, within its row; repeated rows are judged alike, each on
    its own; a text for which the votes balance out is kept; an empty table
    gives no rows; columns named as the added ones are replaced (:func:`keep`
    leaves all columns as they are)."""
    rows = without(df, *ADDED, *HELPERS, "_w", "_h", "_s", "_p")
    return posterior(written(votes(rows, text).drop(text)), threshold)


def keep(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns, whatever these
    are called. The verdicts are joined back by identity."""
    h1, h2 = identity()
    judged = settled(lambda: judge(df.select(h1.alias("_h1"), h2.alias("_h2"), "text"), threshold=threshold).filter("kept").select("_h1", "_h2").distinct())
    return only(df, judged)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept", "p_good")


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE_SQL: dict[str, str] = {}
