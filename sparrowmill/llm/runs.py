"""Periodic runs of words: suffix array, longest previous factors, Main's extensions and copies."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.common import fresh, without
from sparrowmill.sources import table

FOUND = "starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def numbered(docs: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``docs`` as numbers, in one array with a number that occurs
    nowhere else before, between and after the texts, and the place of each
    text's first word. No word has the same number in two texts and those of a
    text are above all earlier ones, so suffixes of different texts share
    nothing and sort by text."""
    out, firsts, base = [0], [], 1
    for words in docs:
        seen: dict = {}
        firsts.append(len(out))
        out += [seen.setdefault(w, base + len(seen)) for w in words]
        base += len(seen)
        out.append(base)
        base += 1
    return np.array(out, np.int64), np.array(firsts, np.int64)


class Suffixes:
    """Suffixes of ``codes`` in order, by prefix doubling. ``levels[j]`` keeps
    equal numbers for suffixes that agree in their first ``2**j`` codes: common
    extensions to either side follow from it by halving. Only suffixes that
    still agree with another are sorted again, and doubling ends when none do,
    so memory is a number for each word and doubling of the longest repeat."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.order = np.argsort(codes, kind="stable")
        rank = np.empty(n, np.int32)
        slots = np.arange(n)
        keys = codes[self.order]
        self.levels: list[np.ndarray] = []
        while len(slots):
            head = np.empty(len(slots), bool)
            head[0], head[1:] = True, keys[1:] != keys[:-1]
            rank[self.order[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
            width = 1 << len(self.levels)
            self.levels.append(rank.copy())
            slots = slots[~(head & np.append(head[1:], True))]
            at = self.order[slots]
            keys = rank[at].astype(np.int64) * (n + 1) + rank[at + width]
            by = np.argsort(keys, kind="stable")
            self.order[slots], keys = at[by], keys[by]
        self.slot = rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes from ``i`` and ``j`` on agree (``i != j``)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            out += (self.levels[k][i + out] == self.levels[k][j + out]).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes up to and with ``i`` and ``j`` agree (``i != j``)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            level, inside = self.levels[k], np.minimum(x, y) >= 0
            out += ((level[np.maximum(x, 0)] == level[np.maximum(y, 0)]) & inside).astype(np.int64) << k
        return out


def previous_factors(s: Suffixes) -> tuple[list[int], list[int]]:
    """For each place the length of the longest factor from it on that also
    starts earlier, and such a start. Places leave a list in suffix order from
    the last to the first: a place's neighbours are then the nearest suffixes
    that start before it."""
    n = len(s.order)
    order, slot = s.order.tolist(), s.slot.tolist()
    lcp = [0, *s.ahead(s.order[:-1], s.order[1:]).tolist(), 0]
    before, after = list(range(-1, n)), list(range(1, n + 2))
    length, source = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r = slot[i]
        p, q = before[r], after[r]
        a, b = lcp[r], lcp[q]
        if a >= b:
            if a:
                length[i], source[i] = a, order[p]
        else:
            length[i], source[i] = b, order[q]
            lcp[q] = a
        after[p], before[q] = q, p
    return length, source


def blocks(length: list[int], first: int, end: int) -> list[int]:
    """Starts of the Lempel-Ziv blocks of the text from ``first`` to before ``end``."""
    out = []
    while first < end:
        out.append(first)
        first += length[first] or 1
    return out


def runs_of(docs: list[list], exponent: int = 2, least: int = 2) -> list[list[tuple[int, int, int]]]:
    """For each text, all its runs ``(start, length, period)`` in order: maximal
    stretches of smallest period ``q`` and at least ``max(least, exponent * q)`` words.

    A run that meets a border between two blocks starts less than its period
    before the earlier one: had that block gone on, it would have been longer.
    So for each border and each period up to ``(blocks' lengths) / (exponent - 1)``
    what agrees to both sides of the border, a period before it and behind it,
    gives every such run; the numbers of periods add up to no more than twice
    the text. All other runs lie within a block and are copied from where the
    block occurs earlier, from left to right."""
    codes, firsts = numbered(docs)
    s = Suffixes(codes)
    length, source = previous_factors(s)
    border, reach, inner = [], [], []
    for first, words in zip(firsts.tolist(), docs, strict=True):
        end = first + len(words)
        cuts = [*blocks(length, first, end), end]
        sizes = [0, *(b - a for a, b in zip(cuts, cuts[1:], strict=False)), 0]
        border += cuts
        reach += [(a + b) // (exponent - 1) for a, b in zip(sizes, sizes[1:], strict=False)]
        inner += [(c, n) for c, n in zip(cuts, sizes[1:], strict=True) if n >= least + 2]
    b, count = np.array(border, np.int64), np.array(reach, np.int64)
    p = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
    b = np.repeat(b, count)
    doc_of = np.searchsorted(firsts, np.arange(len(codes)), side="right") - 1
    found: dict[tuple[int, int], int] = {}
    for shift in (-1, 1):  # the period that is compared lies before or behind the border
        far = b + shift * p
        inside = (far >= 1) & (far < len(codes))
        x, y, q = b[inside], far[inside], p[inside]
        # A run has more than the one period that the two sides are apart, so one side at least agrees.
        hit = (doc_of[x - 1] == doc_of[y - 1]) & ((codes[x] == codes[y]) | (codes[x - 1] == codes[y - 1]))
        x, y, q = x[hit], y[hit], q[hit]
        left = s.behind(x - 1, y - 1)
        size = left + s.ahead(x, y) + q
        long = size >= np.maximum(least, exponent * q)
        for at, n, period in zip((np.minimum(x, y) - left)[long].tolist(), size[long].tolist(), q[long].tolist(), strict=True):
            found[at, n] = min(period, found.get((at, n), period))
    runs = sorted((at, n, period) for (at, n), period in found.items())
    if runs:
        for first, n in inner:
            back = source[first]
            k = bisect_right(runs, (back, len(codes), 0))
            while k < len(runs) and runs[k][0] < back + n:
                at, size, period = runs[k]
                if at + size < back + n:
                    insort(runs, (at + first - back, size, period))
                k += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for at, n, period in runs:
        d = int(doc_of[at])
        out[d].append((at - int(firsts[d]), n, period))
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` less those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for at, n, period in runs:
        change[at + period] += 1
        change[at + n] -= 1
    return [w for w, inside in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not inside]


def _found(texts: Iterator[list[bytes]], exponent: int, least: int, words_at_once: int) -> Iterator[tuple]:
    held: list[list[bytes]] = []
    n = 0

    def done() -> Iterator[tuple]:
        for words, runs in zip(held, runs_of(held, exponent, least), strict=True):
            at, size, period = zip(*runs, strict=True) if runs else ((), (), ())
            yield at, size, period, b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")

    for words in texts:
        if held and n + len(words) > words_at_once:
            yield from done()
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield from done()


def find(df: DataFrame, text: str = "text", exponent: int = 4, least: int = 6, change: Callable[[object, list[bytes]], list[bytes]] | None = None, key: str | None = None, words_at_once: int = 200_000) -> DataFrame:
    """``df`` with ``runs`` (an array of ``start, length, period``, by start, then
    period, counted in words split at ASCII white space) and ``collapsed`` (the
    words, joined by one blank, less those that a run contains after its first
    period). ``change(value of key, words)`` may alter the words first.

    Every text is taken whole in the task that has its row, several together up
    to ``words_at_once`` words; nothing is shuffled. Of a very long text a task
    holds some 100 bytes a word, and 4 for each doubling of its longest repeat.
    A null or empty text has no runs and collapses to an empty one; repeated rows
    have the same result each; equal runs cannot occur twice; an empty table gives
    no rows; columns named ``runs`` or ``collapsed`` are replaced, others stay."""

    def udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in parts:
            split = ((t or "").encode("utf-8", "surrogatepass").split() for t in texts)  # splits at the six ASCII blanks
            if change:
                split = (change(None if pd.isna(k) else k, w) for k, w in zip(keys, split, strict=True))
            yield pd.DataFrame(_found(split, exponent, least, words_at_once), columns=["starts", "lengths", "periods", "collapsed"])

    udf.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    (name,) = fresh(df, "_found")
    given = F.col(f"`{key}`").cast("string") if key else F.lit(None).cast("string")
    out = without(df.withColumn(name, F.pandas_udf(udf, FOUND)(given, F.col(f"`{text}`"))), "runs", "collapsed")
    zipped = F.arrays_zip(F.col(f"{name}.starts").alias("start"), F.col(f"{name}.lengths").alias("length"), F.col(f"{name}.periods").alias("period"))
    return out.withColumns({"runs": zipped.cast("array<struct<start:long,length:long,period:long>>"), "collapsed": F.col(f"{name}.collapsed")}).drop(name)


def looped(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, by a checksum of their id, repeat
    from some word on with a period of a tenth to a third of the rest; those
    without an id stay."""
    n = len(words)
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents. Null, empty and very long texts, repeated rows and
    an empty table as in :func:`find`; a null id stays null and its words are as
    they are."""
    docs = find(table(spark, sf_dir, "documents").select("doc_id", "text"), change=looped, key="doc_id")

    def best(field: str, sign: int) -> Column:
        return (F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))[field] * sign).cast("long")

    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = docs.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best("start", -1).alias("start"),
        best("length", 1).alias("length"),
        best("period", -1).alias("period"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return out.withColumn("exponent_milli", F.expr("1000 * length div period"))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
