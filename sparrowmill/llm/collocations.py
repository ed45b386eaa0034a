"""Phrases whose words keep together: contiguous patterns grown from their prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.llm.common import written
from sparrowmill.sources import table

#: Pairs of words are counted in this many slots by hash, in blocks of this many.
SLOTS, BLOCK = 1 << 24, 1 << 12
#: Ends of pieces become full stops, which no word can hold then; tabs are blanks.
MARKS = bytes.maketrans(b"\t,;:!?\n\x0b\x0c\r", b" " + b"." * 9)


def parts(b: pd.DataFrame, chars: int = 6_000_000) -> Iterator[tuple[str, bytes]]:
    """``(lang, text)``: the texts of each language as one, in parts of about
    ``chars`` that end where a piece does."""
    for lang, texts in b.groupby("lang", sort=False)["_text"]:
        data = "\n".join(texts).encode("utf-8", "surrogatepass").lower().translate(MARKS)
        at = 0
        while at < len(data):
            end = data.find(b".", at + chars)
            end = len(data) if end < 0 else end
            yield lang, data[at:end]
            at = end


def coded(lang: str, data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words, the text as places in that list, 0 between pieces, and
    for each place the slot of the word there and the next, -1 if there is none."""
    seen = {b".": 0}
    codes = np.array([0, *[seen.setdefault(w, len(seen)) for w in data.replace(b".", b" . ").split()], 0], np.int64)
    words = list(seen)
    seed = xxhash.xxh32_intdigest(lang, 3)
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    x, y = h[codes[:-1]], h[codes[1:]]
    mixed = (x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    slot = (mixed >> np.uint64(40)).astype(np.int64)
    slot[(codes[:-1] == 0) | (codes[1:] == 0)] = -1
    return words, codes, slot


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words, and of pairs by slot, up to 65,535 each, as compressed blocks."""
    pairs = np.zeros(SLOTS, np.uint16)
    for b in batches:
        for lang, data in parts(b):
            words, codes, slot = coded(lang, data)
            if len(words) == 1:
                continue
            n = np.bincount(codes, minlength=len(words))[1:]
            yield pd.DataFrame({"lang": lang, "word": [w.decode("utf-8", "surrogatepass") for w in words[1:]], "n": n, "block": None, "counts": None})
            at, n = np.unique(slot[slot >= 0], return_counts=True)
            pairs[at] = np.minimum(pairs[at].astype(np.int64) + n, 65_535)
    pack = zstandard.ZstdCompressor(level=1).compress
    full = np.flatnonzero(pairs.reshape(-1, BLOCK).any(axis=1)).tolist()
    for at in range(0, len(full), 512):
        some = full[at : at + 512]
        yield pd.DataFrame({"lang": None, "word": None, "n": None, "block": some, "counts": [pack(pairs[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in some]})


def _added(batches: Iterator[pd.DataFrame], least: int, crowded: int) -> Iterator[pd.DataFrame]:
    """For each block, which slots have ``least`` pairs or more, and ``crowded``."""
    total: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for i, counts in zip(b["block"].tolist(), b["counts"], strict=True):
            total[i] = total.get(i, np.zeros(BLOCK, np.int64)) + np.frombuffer(unpack(counts), np.uint16)
    rows = [(i, np.packbits(n >= least).tobytes(), np.packbits(n > crowded).tobytes()) for i, n in total.items()]
    yield pd.DataFrame(rows, columns=["block", "frequent", "crowded"])


def _pointers(batches: Iterator[pd.DataFrame], most_words: int, frequent: np.ndarray, crowded: np.ndarray) -> Iterator[pd.DataFrame]:
    """``(lang, pointer, split)``: the words from each place on, as far as each and
    the next make a pair that can be frequent."""
    frequent, crowded = np.unpackbits(frequent).view(bool), np.unpackbits(crowded).view(bool)
    for b in batches:
        for lang, data in parts(b):
            words, codes, slot = coded(lang, data)
            go = frequent[slot] & (slot >= 0)
            size = go.astype(np.int64)
            for _ in range(most_words - 2):
                size = go * (1 + np.append(size[1:], 0))
            at = np.flatnonzero(size)
            if not len(at):
                continue
            told = [w.decode("utf-8", "surrogatepass") for w in words]
            texts = [" ".join([told[c] for c in codes[i : i + k + 1].tolist()]) for i, k in zip(at.tolist(), size[at].tolist(), strict=True)]
            yield pd.DataFrame({"lang": lang, "pointer": texts, "split": crowded[slot[at]]})


def grow(prefix: str, depth: int, pointers: list[tuple[list[str], int]], least: int) -> Iterator[tuple[str, int]]:
    """``prefix`` of ``depth`` words with its count and all its extensions to the
    right, depth first: the pointers of each next word are projected in turn."""
    n = sum(c for _, c in pointers)
    if n < least:
        return
    yield prefix, n
    following: dict[str, list[tuple[list[str], int]]] = {}
    for pointer in pointers:
        if len(pointer[0]) > depth:
            following.setdefault(pointer[0][depth], []).append(pointer)
    for word, own in following.items():
        yield from grow(f"{prefix} {word}", depth + 1, own, least)


def _grown(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    held: list[tuple[list[str], int]] = []
    now: tuple = ()

    def done() -> list[tuple[str, str, int]]:
        if not held:
            return []
        return [(now[0], phrase, n) for phrase, n in grow(" ".join(held[0][0][:2]), 2, held, 1 if now[2] else least)]

    for b in batches:
        out = []
        for lang, prefix, split, pointer, n in zip(b["lang"], b["prefix"], b["split"].tolist(), b["pointer"], b["n"].tolist(), strict=True):
            if (lang, prefix, split) != now:
                out += done()
                held, now = [], (lang, prefix, split)
            held.append((pointer.split(" "), n))
        yield pd.DataFrame(out, columns=["lang", "phrase", "n"])
    yield pd.DataFrame(done(), columns=["lang", "phrase", "n"])


def frequencies(df: DataFrame, text: str = "text", lang: str = "lang", most_words: int = 5, least: int = 100, crowded: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, f)`` of all words and phrases of up to ``most_words`` words
    that occur ``least`` times or more, and ``(lang, n)`` with the number of words.

    One pass counts words, and pairs of words by hash in 16 million slots: tables
    of one size whatever the input. A second makes a pointer of every place from
    which pairs go on that can be frequent by their slots. Equal pointers are
    added up, before and after a shuffle, then dealt by their first two words,
    and each such prefix is grown in one task. A prefix whose slot has over
    ``crowded`` pairs goes to many tasks, by whole pointers, and the counts found
    there are added up. No more than ``crowded`` pointers are ever held, and
    counts are exact: slots only rule out what cannot be."""
    if not 0 < least <= crowded <= 65_534:
        raise ValueError("0 < least <= crowded <= 65534 is needed: slots count so far")
    rows = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    counts = written(rows.mapInPandas(_counted, "lang string, word string, n long, block int, counts binary"))
    words = written(counts.filter("block IS NULL").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("f")))
    added = counts.filter("block IS NOT NULL").select("block", "counts").repartition("block").mapInPandas(lambda it: _added(it, least, crowded), "block int, frequent binary, crowded binary")
    bits = np.zeros((2, SLOTS // BLOCK, BLOCK // 8), np.uint8)
    for block, *own in added.collect():  # of one size: 4 MB
        bits[:, block] = [np.frombuffer(x, np.uint8) for x in own]
    frequent, full = bits.reshape(2, -1)
    found = rows.mapInPandas(lambda it: _pointers(it, most_words, frequent, full), "lang string, pointer string, split boolean")
    found = found.groupBy("lang", "pointer", "split").agg(F.count("*").alias("n"))
    prefix = F.when(F.col("split"), F.col("pointer")).otherwise(F.substring_index("pointer", " ", 2))
    found = found.repartition("lang", prefix).withColumn("prefix", prefix).sortWithinPartitions("lang", "prefix", "split")
    grown = found.mapInPandas(lambda it: _grown(it, least), "lang string, phrase string, n long")
    phrases = grown.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).union(words).filter(F.col("f") >= least)
    return written(phrases), words.groupBy("lang").agg(F.sum("f").alias("n"))


def mine(df: DataFrame, text: str = "text", lang: str = "lang", most_words: int = 5, least: int = 100, top: int = 2000, crowded: int = 50_000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: of each language the ``top``
    phrases of 2 to ``most_words`` words by ``floor(1000 * a * n / (l * r))`` at
    their weakest cut, of equal ones the first, less those that a longer frequent
    phrase always contains.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line ends,
    pieces into words at blanks and tabs. A null language is ``und``; a null or
    empty text has no words; very long texts are read whole, in parts that end
    where a piece does; repeated rows count each time; ties go by ``a``, then by
    the phrase's bytes; an empty table gives no rows; other columns are ignored."""
    both, totals = frequencies(df, text, lang, most_words, least, crowded)
    # A longer phrase comes no more often than one inside it, nor do those between the two, so one word longer tells.
    phrases = both.withColumn("w", F.split("phrase", " ")).filter(F.size("w") > 1)
    within = F.array(*(F.array_join(F.expr(f"slice(w, {i}, size(w) - 1)"), " ") for i in (1, 2)))
    inside = phrases.filter(F.size("w") > 2).select("lang", "f", F.explode(within).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("_most"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").filter("_most IS NULL OR _most < f")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.array_join(F.expr("slice(w, 1, k)"), " "), "rest": F.array_join(F.expr("slice(w, k + 1, size(w))"), " ")}).drop("w")
    cuts = cuts.join(both.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(both.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(CAST(1000 * a AS DECIMAL(19)) * CAST(n AS DECIMAL(19))) div (CAST(l AS DECIMAL(19)) * CAST(r AS DECIMAL(19)))").cast("long")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", rank).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents, null, empty and odd rows as in :func:`mine`."""
    return mine(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": op11_collocations}
ORACLE_SQL = {
    "op11_collocations": r"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
        grams AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS s(k))),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
        total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
        cand AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
        inside AS (
            SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS most
            FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM cand, range(2, 5) AS s(j) WHERE j < m) GROUP BY 1, 2),
        cut AS (
            SELECT c.lang, c.phrase, c.a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
            FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) AS c LEFT JOIN inside USING (lang, phrase) WHERE coalesce(100 * most < 100 * a, true)),
        scored AS (
            SELECT cut.lang, cut.phrase, a, cut.k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
            FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = head JOIN f AS y ON y.lang = cut.lang AND y.phrase = tail JOIN total ON total.lang = cut.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best QUALIFY rank <= 2000"""
}
