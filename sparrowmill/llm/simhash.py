"""Near copies by SimHash, found with Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.common import WORD, identity, is_empty, one_each, release, settled, written
from sparrowmill.sources import table

#: Generator polynomial of the perfect binary Golay code of length 23 (a fixed value): x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, PARITY = 23, 11
#: The fingerprint's segments as (first bit, width); the last is filled up with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
MISSING = np.int64(-1)


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        v = np.where((v >> bit) & 1, v ^ (GENERATOR << (bit - PARITY)), v)
    return v


def _leaders() -> np.ndarray:
    """The one error pattern of weight at most 3 for each of the 2048 syndromes."""
    bits = [1 << i for i in range(LENGTH)]
    errors = [0, *bits]
    errors += [bits[i] | bits[j] for i in range(LENGTH) for j in range(i)]
    errors += [bits[i] | bits[j] | bits[k] for i in range(LENGTH) for j in range(i) for k in range(j)]
    out = np.zeros(1 << PARITY, np.int64)
    e = np.array(errors, np.int64)
    out[_syndrome(e)] = e
    return out


LEADERS = _leaders()


def decode(v: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit value."""
    v = v.astype(np.int64)
    return (v ^ LEADERS[_syndrome(v)]) >> PARITY


def fuzzy(v: np.ndarray) -> np.ndarray:
    """Per value, the indices of the codewords that it or a value one bit away
    decodes to: up to six, the rest filled with ``MISSING``."""
    near = np.stack([decode(v)] + [decode(v ^ (1 << i)) for i in range(LENGTH)], axis=1)
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = MISSING
    near[:, ::-1].sort(axis=1)
    return near[:, :6]


def keys(fps: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(kind, side, row numbers, key values) for signed 64-bit fingerprints. A key
    that a fingerprint has on both sides comes once, with side 2.

    At most four differing bits over three segments leave either one segment
    equal or two with at most one error each. Kinds 0 to 14: a segment as it is,
    with one of five parts of the rest (four errors leave one part equal); both
    sides alike. Kinds 15 to 23: for two segments, side 0 has the fuzzy indices
    of the first and the index of the second, side 1 the other way round; values
    one error apart in each then meet. If no segment is equal, the third one has
    at most two errors, so one of three parts of it is equal and joins the key,
    without which 24 bits alone would meet by chance."""
    u = fps.view(np.uint64)
    parts = [((u >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    every = np.arange(len(u))
    for s, (a, w) in enumerate(SEGMENTS):
        low, high = u & np.uint64((1 << a) - 1), (u >> np.uint64(min(63, a + w))) if a + w < 64 else np.zeros_like(u)
        rest, width = (low | (high << np.uint64(a))).astype(np.int64), 64 - w
        edges = [round(width * i / 5) for i in range(6)]
        for p in range(5):
            piece = (rest >> edges[p]) & ((1 << (edges[p + 1] - edges[p])) - 1)
            yield 5 * s + p, 2, every, (parts[s] << 12) | piece
    exact, loose = [decode(p) for p in parts], [fuzzy(p) for p in parts]
    for k, (x, y, z) in enumerate(((0, 1, 2), (0, 2, 1), (1, 2, 0))):
        edges = [round(SEGMENTS[z][1] * i / 3) for i in range(4)]
        thirds = [(parts[z] >> a) & ((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        own = ((exact[x] << 20) | (exact[y] << 8))[:, None]
        for side, a, b in ((0, loose[x], exact[y][:, None]), (1, exact[x][:, None], loose[y])):
            many = (a << 20) | (b << 8)
            rows, cols = np.nonzero((a != MISSING) & (b != MISSING) & (many != own))
            for t, third in enumerate(thirds):
                yield 15 + 3 * k + t, side, rows, many[rows, cols] | third[rows]
        for t, third in enumerate(thirds):
            yield 15 + 3 * k + t, 2, every, own[:, 0] | third


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fps = b["fp"].to_numpy(np.int64)
        for kind, side, rows, values in keys(fps):
            yield pd.DataFrame({"fp": fps[rows], "key": (np.int64(kind) << 48) | values, "side": np.int8(side)})


def _fingerprints(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    find, digest = re.compile(WORD).findall, xxhash.xxh64_intdigest
    for b in batches:
        out = np.zeros(len(b), np.uint64)
        for r, text in enumerate(b["_text"]):
            w = find((text or "").translate(lower))
            if not w:
                continue
            n = max(1, len(w) - words + 1)
            ones = np.zeros(64, np.int64)
            for at in range(0, n, 1 << 16):
                h = np.fromiter((digest(" ".join(w[i : i + words]), 42) for i in range(at, min(n, at + (1 << 16)))), np.uint64)
                ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[r] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
        yield b.drop(columns="_text").assign(fp=out.view(np.int64))


def components(edges: DataFrame) -> DataFrame:
    """``(fp, root)``: the smallest label reachable over ``edges (a, b)``. Labels
    go to neighbours and then jump along themselves until nothing changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = written(both.select(F.col("a").alias("fp")).distinct().withColumn("root", F.col("fp")))
    while True:
        seen = both.join(label, F.col("b") == F.col("fp")).groupBy("a").agg(F.min("root").alias("least"))
        next_ = label.join(seen, F.col("fp") == F.col("a"), "left").select("fp", F.col("root").alias("was"), F.least("root", "least").alias("mid"))
        to = label.select(F.col("fp").alias("mid"), F.col("root").alias("far"))
        fresh = written(next_.join(to, "mid", "left").select("fp", "was", F.least("mid", "far").alias("root")))
        changed = fresh.filter("root < was").take(1)
        release(label)
        label = fresh
        if not changed:
            release(both)
            return label.select("fp", "root")


def merged(roots: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """``roots (fp, root)``, which leaves out what is its own root, after the two
    roots of each of the ``edges (a, b)`` have become one."""
    edges = written(edges.distinct())
    if is_empty(edges):
        release(edges)
        return roots
    top = components(edges).toDF("root", "top")
    if roots is None:
        return written(top.toDF("fp", "root"))
    known = roots.union(top.select(F.col("root").alias("fp"), "root")).dropDuplicates(["fp"])
    out = written(known.join(top, "root", "left").select("fp", F.coalesce("top", "root").alias("root")))
    release(roots, edges)
    return out


def rooted(rows: DataFrame, roots: DataFrame | None, name: str = "fp") -> DataFrame:
    """``rows`` with the ``root`` of their column ``name``, itself if it has none."""
    if roots is None:
        return rows.withColumn("root", F.col(name))
    return rows.join(roots.select(F.col("fp").alias(name), F.col("root").alias("_r")), name, "left").withColumn("root", F.coalesce("_r", name)).drop("_r")


def divided(rows: DataFrame, depth: int, parts: int) -> DataFrame:
    """Buckets divided by further bits: each goes into ``parts`` of them, by the
    values of as many parts of all 64 bits, dealt anew at each depth. Two that
    differ in fewer than ``parts`` bits agree in one part and so meet again."""
    dealt = np.random.default_rng(depth).permutation(64)
    masks = [sum(1 << int(b) for b in dealt[p::parts]) for p in range(parts)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    bits = [F.xxhash64("key", F.lit(p), F.col("fp").bitwiseAND(F.lit(m))) for p, m in enumerate(masks)]
    return rows.select("fp", "side", "root", F.explode(F.array(*bits)).alias("key"))


def link(prints: DataFrame, bits: int = 4, few: int = 64, turns: int = 2) -> DataFrame:
    """``(fp, root)`` for the distinct fingerprints that have a link at ``bits``
    (at most 4) or fewer differing bits; ``root`` is the smallest reached.

    In turns, every member of a bucket is held against one of them drawn by
    hash, and what is close becomes one. This costs one comparison a member and
    merges groups of near copies. Then, in buckets of up to ``few``, pairs with
    different roots are compared. Larger ones in which several roots meet are
    divided by further bits, which loses no link, and go round again: so no
    bucket makes more than ``few`` pairs a member, however large it is."""
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(prints.repartition(tasks).mapInPandas(_key_rows, "fp long, key long, side byte"))
    roots, depth = None, 0

    def near(a, b):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits

    while True:
        # Most keys have one member: only here do all rows move. A part of a bucket with one root is done.
        root = "root" if depth else "fp"
        drawn = F.min_by("fp", F.xxhash64("fp", "key", F.lit(turns * depth)))
        met = rows.groupBy("key").agg(F.count("*").alias("met"), drawn.alias("low"), F.min(root).alias("_r0"), F.max(root).alias("_r1")).filter("_r0 < _r1")
        live = written(rows.select("key", "side", "fp").join(met.select("key", "met", "low"), "key"))
        release(rows)
        if is_empty(live):
            break
        close = live.filter((F.col("fp") != F.col("low")) & near("fp", "low")).select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
        close = rooted(rooted(close, roots, "a").withColumnRenamed("root", "ra"), roots, "b")
        roots = merged(roots, close.select(F.col("ra").alias("a"), F.col("root").alias("b")).filter("a != b"))
        for turn in range(1, turns):
            tagged = rooted(live.select("key", "fp"), roots)
            drawn = F.min_by(F.struct("fp", "root"), F.xxhash64("fp", "key", F.lit(turns * depth + turn)))
            lead = tagged.groupBy("key").agg(drawn.alias("_l"), F.min("root").alias("_r0"), F.max("root").alias("_r1")).filter("_r0 < _r1")
            lead = lead.select(F.col("key").alias("_key"), F.col("_l.fp").alias("low"), F.col("_l.root").alias("a"))
            close = tagged.join(lead, (F.col("key") == F.col("_key")) & (F.col("root") != F.col("a")) & near("fp", "low"))
            roots = merged(roots, close.select("a", F.col("root").alias("b")))
        tagged = written(rooted(live.select("key", "side", "fp", "met"), roots))
        release(live)
        small = tagged.filter(F.col("met") <= few).drop("met")
        x, y = small.filter("side != 1").toDF("key", "sa", "a", "ra"), small.filter("side != 0").toDF("_key", "sb", "b", "rb")
        once = (F.col("sa") != 2) | (F.col("sb") != 2) | (F.col("a") < F.col("b"))
        pairs = x.join(y, (F.col("key") == F.col("_key")) & (F.col("ra") != F.col("rb")) & once & near("a", "b"))
        roots = merged(roots, pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        large = tagged.filter(F.col("met") > few)
        mixed = large.groupBy("key").agg(F.min("root").alias("_r0"), F.max("root").alias("_r1")).filter("_r0 < _r1").select("key")
        rows = written(divided(large.join(mixed, "key", "left_semi"), depth, bits + 1))
        release(tagged)
        depth += 1
    return roots if roots is not None else prints.select("fp", F.col("fp").alias("root")).limit(0)


def grouped(rows: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """``rows`` with ``fp`` for their column ``_text``, and ``root``, which rows
    share that are linked, directly or over others."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]
    rows = written(rows.mapInPandas(lambda it: _fingerprints(it, words), ", ".join([*kinds, "fp long"])))
    prints = written(rows.select("fp").distinct())
    roots = rooted(prints, link(prints, bits))
    # A fingerprint may hold a third of the rows: these are dealt over 16 salts.
    salted = roots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    dealt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "fp"]), F.lit(16)).cast("int")
    return rows.withColumn("_salt", dealt).join(salted, ["fp", "_salt"]).drop("_salt")


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``df``.

    Equal fingerprints are one from the start; links between different ones
    come from :func:`link`. ``component_id`` is the smallest id reachable. Null
    and empty texts have fingerprint zero and link like any other; very long
    ones are read whole, in blocks of shingles; rows with a null id take part
    and get a component id, null only if no row of the group has an id; repeated
    rows all come out; an empty table gives no rows; other columns are not
    carried, so their names cannot clash."""
    found = settled(lambda: grouped(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text")), words, bits))
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # Groups are dealt over salts like fingerprints.
    least = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    found = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "fp"), F.lit(16)).cast("int"))
    return found.join(least, ["root", "_salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of(found: DataFrame) -> DataFrame:
    """``(_h1, _h2, n)`` of one row of each ``root`` in ``found (doc_id, _h1, _h2,
    root)``: that with the smallest doc_id, a null before all others; ``n``
    counts its repeats."""
    counted = found.groupBy("root", "doc_id", "_h1", "_h2").agg(F.count("*").alias("n"))
    return counted.groupBy("root").agg(F.min(F.struct("doc_id", "_h1", "_h2", "n")).alias("_f")).select("_f._h1", "_f._h2", "_f.n")


def keep_one(df: DataFrame) -> DataFrame:
    """One row of each group of near copies with all its columns: that with the
    smallest doc_id, and one of its repeats. A null text is like an empty one; a
    group without ids keeps one row; an empty table gives no rows."""
    h1, h2 = identity()
    rows = df.select("doc_id", h1.alias("_h1"), h2.alias("_h2"), F.col("text").alias("_text"))
    return one_each(df, settled(lambda: first_of(grouped(rows))))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
