"""Benchmark items in documents, with edits, by the pigeonhole principle."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.common import release, written
from sparrowmill.sources import table

HIT = "item_id long, distance int, at long"


def normal(text: str | None) -> str:
    """Lower case, with everything but letters and digits as single blanks."""
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a part of ``text`` and the first
    end of such a part, by bit-parallel columns."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        diag = ((((eq & up) + up) ^ up) | eq | down) & mask
        right, left = (down | ~(diag | up)) & mask, up & diag
        score += 1 if right & last else -1 if left & last else 0
        right, left = (right << 1) & mask, (left << 1) & mask
        up, down = (left | ~(diag | right)) & mask, right & diag
        if score < best:
            best, end = score, j
    return best, end


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``item`` as budget + 1 pieces of about equal length, with their places."""
    cuts = [round(len(item) * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def budget_of(length: int, per_error: int = 12, exact_below: int = 24) -> int:
    """Edits that a match may have: one for every ``per_error`` characters."""
    return length // per_error if length >= exact_below else 0


#: A run of so many characters is common if more than so many items of a block have it.
GRAM, COMMON = 6, 4
#: Shorter runs, and the length of the stretches of a text in which they are looked up.
SHORT, STRETCH = 4, 1024
_SLOTS, _SHORT_SLOTS = 1 << 23, 1 << 16


def grams(text: str, size: int, slots: int) -> np.ndarray:
    """A slot for each run of ``size`` characters, by hash."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(c) - size + 1), np.uint64)
    for i in range(size):
        h = (h + c[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h & np.uint64(slots - 1)).astype(np.int64)


def rare_pieces(item: str, budget: int, rare: np.ndarray) -> list[tuple[int, str]] | None:
    """budget + 1 pieces, with their places, each with a ``rare`` run in it, or None
    if there are too few such runs that do not overlap. So many pieces do not have
    to cover the item: that many edits leave one of them as it is anyway."""
    starts, free = [], 0
    for at in np.flatnonzero(rare).tolist():
        if at >= free:
            starts.append(at)
            free = at + GRAM
    if len(starts) <= budget:
        return None
    starts = [starts[round(i * (len(starts) - 1) / max(1, budget))] for i in range(budget + 1)]
    return [(a, item[a:b]) for a, b in zip(starts, [*starts[1:], len(item)], strict=True)]


class Searcher:
    """The items of a block, ready to be looked for in texts. An item with k
    edits allowed is split into k + 1 pieces; one of them must occur as it is.
    Pieces that many items have would send a text that has them to all of these.
    So items with such pieces are cut where runs are rare, if there are enough.
    Of others that share a piece, those come into question whose runs of ``SHORT``
    characters side by side are, all but k, somewhere in the text around it."""

    def __init__(self, items: list[tuple[int, str]], per_error: int):
        import ahocorasick

        self.texts, self.spots = {}, {}
        for item_id, text in items:
            if text := normal(text):
                self.texts[item_id] = (text, budget_of(len(text), per_error))
        cut = {item_id: pieces(text, k) if k else [(0, f" {text} ")] for item_id, (text, k) in self.texts.items()}
        owners = Counter(piece for own in cut.values() for _, piece in own)
        if crowded := [i for i, own in cut.items() if self.texts[i][1] and any(owners[piece] > COMMON for _, piece in own)]:
            seen = np.zeros(_SLOTS, np.uint8)
            for text, _ in self.texts.values():
                slots = np.unique(grams(text, GRAM, _SLOTS))
                seen[slots] = np.minimum(seen[slots], 254) + 1
            for i in crowded:
                text, k = self.texts[i]
                cut[i] = rare_pieces(text, k, seen[grams(text, GRAM, _SLOTS)] <= COMMON) or cut[i]
        for item_id, own in cut.items():
            for at, piece in own:
                self.spots.setdefault(piece, []).append((item_id, at, len(piece)))
        self.short = {i: grams(self.texts[i][0], SHORT, _SHORT_SLOTS)[::SHORT] for i in crowded}
        self.reach = max((len(t) + 2 * k for t, k in (self.texts[i] for i in crowded)), default=0)
        self.found = ahocorasick.Automaton()
        for piece, where in self.spots.items():
            self.found.add_word(piece, where)
        if self.spots:
            self.found.make_automaton()

    def _around(self, text: str, stretch: int) -> np.ndarray:
        """Which short runs are in this stretch of a text and as far from it as a match can reach."""
        there = np.zeros(_SHORT_SLOTS, np.int8)
        there[grams(text[max(0, stretch * STRETCH - self.reach) : (stretch + 1) * STRETCH + self.reach], SHORT, _SHORT_SLOTS)] = 1
        return there

    def _possible(self, where: list[tuple[int, int, int]], there: np.ndarray) -> list[tuple[int, int, int]]:
        """Those of a piece's items that can match where these short runs are."""
        crowd = [x for x in where if x[0] in self.short]
        if not crowd:
            return where
        own = [self.short[i] for i, *_ in crowd]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        missing = sizes - np.add.reduceat(there[np.concatenate(own)], np.cumsum(sizes) - sizes, dtype=np.int64)
        return [x for x, n in zip(crowd, missing.tolist(), strict=True) if n <= self.texts[x[0]][1]] + [x for x in where if x[0] not in self.short]

    def best(self, text: str | None, one: bool = False) -> dict[int, tuple[int, int]]:
        """Item to (distance, place) of its best match; with ``one``, the search
        ends at the first match of any item."""
        best: dict[int, tuple[int, int]] = {}
        if not self.spots:
            return best
        text = f" {normal(text)} "
        # A place is tried once for hits that point to about the same start.
        tried = set()
        possible: dict[tuple[int, int], list] = {}
        around: dict[int, np.ndarray] = {}
        for end, where in self.found.iter(text):
            if len(where) > COMMON:
                stretch = end // STRETCH
                if stretch not in around:
                    around = {stretch: self._around(text, stretch)}
                if (id(where), stretch) not in possible:
                    possible[id(where), stretch] = self._possible(where, around[stretch])
                where = possible[id(where), stretch]
            for item_id, at, size in where:
                if one and best:
                    return best
                item, k = self.texts[item_id]
                if not k:
                    best.setdefault(item_id, (0, end - len(item)))
                    continue
                zone = (end + 1 - size - at) // max(1, k)
                if (item_id, zone) in tried or best.get(item_id, (1, 0))[0] == 0:
                    continue
                tried.add((item_id, zone))
                low = max(0, zone * k - k)
                d, stop = myers(item, text[low : zone * k + 2 * k + len(item)])
                if d <= k and (item_id not in best or d < best[item_id][0]):
                    best[item_id] = (d, max(0, low + stop - len(item)))
        return best


def _scan(batches: Iterator[pd.DataFrame], items: list[tuple[int, str]], per_error: int) -> Iterator[pd.DataFrame]:
    searcher = Searcher(items, per_error)
    for b in batches:
        rows = [(row, item_id, d, at) for row, text in zip(b["_row"], b["_text"], strict=True) for item_id, (d, at) in searcher.best(text).items()]
        yield pd.DataFrame(rows, columns=["_row", "item_id", "distance", "at"])


def _apart(items: list[tuple[int, str]], per_error: int) -> Callable:
    def apart(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(items, per_error)
        for part in texts:
            yield pd.Series([not searcher.best(t, one=True) for t in part], dtype=bool)

    return apart


def blocks(benchmark: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """The distinct texts of the benchmark as a written table ``(item, _ids, _key,
    _block)``, and the number of blocks of at most about ``block_chars``."""
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).filter("item IS NOT NULL")
    named = named.groupBy("item").agg(F.collect_set(F.struct("item_id")).alias("_ids"), F.sum(F.length("item")).alias("_n"))
    n = max(1, -(-(benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    return written(named.select("item", "_ids", F.monotonically_increasing_id().alias("_key"), F.pmod(F.xxhash64("item"), F.lit(n)).alias("_block"))), n


def matches(docs: DataFrame, benchmark: DataFrame, row: str = "_row", text: str = "text", per_error: int = 12, block_chars: int = 8_000_000) -> DataFrame:
    """``(row, item_id, distance, at)``: the best match of every text of an item
    that occurs in a text with at most one edit per ``per_error`` characters, and
    of equally good ones the first; a match that is not exact may be any of its
    zone's.

    Items go to the tasks in blocks of at most about ``block_chars`` characters.
    Items with pieces that many of a block share are cut at rare runs instead. A
    block has a pass over the texts of its own, and its matches are written
    before the next one is fetched, so what the driver or a task holds does not
    grow with the benchmark. Items under 24 characters have to occur word for
    word; null and empty items and texts match nothing; very long texts are
    searched whole; a repeated row has its matches each time; every distinct
    text of an item id is searched, and a match comes out for each id that has
    the text, a null id included; empty tables give no rows; other columns are
    not carried."""
    named, n = blocks(benchmark, block_chars)
    rows = docs.select(F.col(f"`{row}`").alias("_row"), F.col(f"`{text}`").alias("_text"))
    found = []
    for block in range(n):
        items = [tuple(r) for r in named.filter(F.col("_block") == block).select("_key", "item").collect()]
        hits = rows.mapInPandas(lambda it, items=items: _scan(it, items, per_error), f"_row long, {HIT}")
        found.append(hits if n == 1 else written(hits))
    hits = reduce(DataFrame.union, found).join(named.select(F.col("_key").alias("item_id"), "_ids"), "item_id")
    return hits.select("_row", F.explode("_ids.item_id").alias("item_id"), "distance", "at")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", per_error: int = 12, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` without a match, with all their columns, whatever these
    are called; null and empty texts stay, repeated rows stay or go together.
    Only texts go through Python, and nothing is shuffled. Where the benchmark
    has several blocks, what a block leaves is written and goes to the next."""
    named, n = blocks(benchmark, block_chars)
    for block in range(n):
        items = [tuple(r) for r in named.filter(F.col("_block") == block).select("_key", "item").collect()]
        before, docs = docs, docs.filter(F.pandas_udf(_apart(items, per_error), "boolean")(F.col(f"`{text}`")))
        if n > 1:
            docs = written(docs)
            release(before)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, table(spark, sf_dir, "benchmark"), row="doc_id")
    return found.select(F.col("_row").alias("doc_id"), "item_id", "distance")


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE_SQL: dict[str, str] = {}
