"""The text operators against plain versions over whole tables and edge cases."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from compare import duck, same
from sparrowmill.llm import decontamination, minhash, ordinal, packing, pii, quality_rules, quotes, secrets, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t", "en", "a", 5), (4, LONG, "en", "b", len(LONG)), (5, "same words here in two rows of the table", "en", None, 40), (5, "same words here in two rows of the table", "en", None, 40), (None, "no id for this row, mail me at a.b@c.de", "en", "x", 9), (7, "9" * 30000, "en", "x", 30000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check_shards(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sums = Counter()
    for r in rows:
        sums[r.shard] += size(r)
    largest = max(map(size, rows))
    assert max(sums.values()) - min(sums[i] for i in range(8)) <= 2 * largest + 2


def test_shards(spark, docs):
    got = sharding.op1_shard_documents(spark, SF).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts(docs))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    check_shards(got, lambda r: r.size)


def test_shards_hot_key_and_nulls(spark, empty):
    df = spark.range(3000).select(F.when(F.col("id") < 1500, 7).when(F.col("id") < 1700, None).otherwise(F.col("id")).alias("doc_id"), F.lit(10).cast("long").alias("size"), F.lit("x").alias("shard"))
    got = sharding.shard(df).collect()
    assert len(got) == 3000
    check_shards(got, lambda r: r["size"])
    few = spark.range(4000).select("id", F.when(F.col("id") % 200 == 0, 100_000).otherwise(1).alias("size"), F.lit(1).alias("a.b")).toDF("doc_id", "size", "a.b")
    got = sharding.shard(few).collect()
    assert len(got) == 4000 and "a.b" in got[0].asDict()
    check_shards(got, lambda r: r["size"])
    assert sharding.shard(empty.withColumn("size", F.lit(1))).count() == 0


def check_key_order(rows):
    """Shards are ranges of the key: neighbours share one key at most."""
    low, high = {}, {}
    for r in rows:
        if r.doc_id is not None:
            low[r.shard], high[r.shard] = min(r.doc_id, low.get(r.shard, r.doc_id)), max(r.doc_id, high.get(r.shard, r.doc_id))
    used = sorted(low)
    assert all(high[a] <= low[b] for a, b in zip(used, used[1:], strict=False))


def test_shards_are_key_ranges(spark):
    n = F.col("id")
    skewed = {
        "bytes": spark.range(4000).select(n.alias("doc_id"), F.when(n % 200 == 0, 100_000).otherwise(1).alias("size")),
        "rows": spark.range(6000).select(F.when(n < 3000, n % 700).otherwise(n * 1000).alias("doc_id"), F.when(n < 3000, 0).otherwise(50).alias("size")),
        "both": spark.range(6000).select(F.when(n < 2500, 4321).when(n < 3500, n).otherwise(n * n).alias("doc_id"), F.when(n % 97 == 0, 5000).otherwise(n % 7).alias("size")),
        "two keys": spark.range(3000).select(F.when(n < 5, 1).otherwise(2).alias("doc_id"), F.lit(3).alias("size")),
    }
    for name, df in skewed.items():
        got = sharding.shard(df.withColumn("size", F.col("size").cast("long"))).collect()
        assert len(got) == df.count(), name
        check_shards(got, lambda r: r["size"])
        check_key_order(got)


def test_shards_divide_overfull_ranges_by_key(spark):
    from sparrowmill.llm.common import written

    n = F.col("id")
    df = spark.range(8000).select(F.when(n < 1000, 500).otherwise(n * n).alias("_key"), F.when(n % 1000 == 0, 20_000).otherwise(1).cast("long").alias("_size"), n.alias("_row"))
    rows, parts = sharding.ranged(written(df), 32, 2.0, 1_000_000, 40, 4)
    found = rows.groupBy("_range").agg(F.sum("_size").alias("b"), F.count("*").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high")).collect()
    total, ordered = sum(r.b for r in found), sorted(found, key=lambda r: r["_range"])
    assert all(a.high < b.low for a, b in zip(ordered, ordered[1:], strict=False))
    for r in found:
        if r.low == r.high:
            assert parts.get(r["_range"], 1) >= r["n"] // 500
        else:
            assert r.b <= 2 * total // 32 and r.n <= 2 * 8000 // 32
    assert len(found) < 200


def test_shards_odd_documents(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op1_shard_documents(spark, str(tmp_path)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ODD)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    check_shards(got, lambda r: r.size)
    check_key_order(got)
    words = spark.range(500).select(F.concat(F.lit("é"), (F.col("id") % 90).cast("string")).alias("doc_id"), F.lit(2).alias("size"))
    got = sharding.shard(words).collect()
    check_shards(got, lambda r: r["size"])
    check_key_order(got)


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_counts(request, which):
    df = request.getfixturevalue(which)
    got = quality_rules.judge(df.withColumn("kept", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((d, *plain_counts(t)) for d, t in texts(df))
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_quality_keeps_labelled_good(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # The base rule is given; the method is judged on what passes it.
    rows = quality_rules.judge(docs).join(labels, "doc_id").filter("NOT base_failed").select("kept", "quality").collect()
    good, poor = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good)
    assert sum(poor) <= 0.5 * len(poor)


def plain_base(text):
    text, out = text or "", []
    patterns = dict(zip(pii.KINDS, pii.BASE, strict=True))
    for kind in pii.KINDS:
        for m in re.finditer(patterns[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), pii.KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_pii_base(request, which):
    df = request.getfixturevalue(which)
    got = pii.find(df).collect()
    want = Counter((d, hashlib.sha256(",".join(plain_base(t)).encode()).hexdigest()) for d, t in texts(df))
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert pii.redact(df).columns == df.columns


@pytest.mark.parametrize("text", ["a@b.c_d@e.fg", "x@y.z@w.v.u @a.b a@.c ..@-.-", "1.2.3.4.5.6.7.8 300.1.1.1 1.1.1.1", "+1 (212) 555-0100 4111 1111 1111 1111", "+12 3+45 67 89 01 23"])
def test_pii_patterns(text):
    assert [f"{k}:{a}:{b}" for a, b, k in pii.base_spans(text)] == plain_base(text)


def test_pii_digit_by_digit():
    for number in ("2 1 2 5 5 5 0 1 0 0", "(2) 1-2.5 - 5"):
        alone = pii.candidates(f"call {number} now")
        beside = pii.candidates(f"call {number} now, room 12")
        assert alone == beside and (len(alone) == 1) == (len(number) > 15)


def test_pii_repeats_agree(docs):
    weights = pii.fit(docs)
    text = "Call +1 212 555 0100 today. Later: 212 555 0100 again. Order 1234567."
    assert [text[a:b] for a, b, *_ in pii.spans(text, weights)] == ["+1 212 555 0100", "212 555 0100"]
    import numpy as np

    one = np.log(np.array([[0.6, 0.4], [0.05, 0.95]]))
    assert pii.infer(one, ["a", "b"], 0.0, 3.0)[0, 0] > 0.5 > pii.infer(one, ["a", "a"], 0.0, 3.0)[0, 0]


def test_pii_loose_forms(docs):
    """Base spans rewritten without what makes them one: found again, and little else."""
    import random

    field = pii.fit(docs.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    r = random.Random(3)
    planted = hits = others = 0
    for _, text in texts(docs):
        out, at, size, where = [], 0, 0, []
        for a, z, kind in pii.base_spans(text):
            if kind in ("email", "phone") and a >= at:
                shown = pii.masked(text[a:z], kind, r.randrange(40))
                size += a - at
                where.append((size, size + len(shown)))
                out += [text[at:a], shown]
                size, at = size + len(shown), z
        found = [(a, b) for a, b, _, base in pii.spans("".join(out) + text[at:], field) if not base]
        planted += len(where)
        hits += sum(any(a < q and p < b for a, b in found) for p, q in where)
        others += sum(not any(a < q and p < b for p, q in where) for a, b in found)
    assert planted >= 3 and hits >= 0.9 * planted and others <= 2
    assert not pii.spans("@" * 2_000_000, field)


def other_form(span, kind, r):
    """A base span in a form that the examples do not have (another generator than theirs)."""
    if kind == "email":
        name, host = span.split("@")
        first, rest = host.split(".", 1)
        return r.choice((f"{name} AT {host}", f"{name} <at> {first} <dot> {rest}", f"{name}[at]{host}", f"{name} {{at}} {first} dot {rest}", f"{name}(AT){first}(DOT){rest}".upper()))
    groups = re.findall("[0-9]+", span)
    body = groups[1:] if len(groups) > 2 else groups
    whole = "".join(body)
    return r.choice((f"({whole[:3]}) {whole[3:6]}-{whole[6:]}", f"0{whole[:3]}/{whole[3:]}", f"00{groups[0]} {' '.join(body)}", " - ".join(body), f"{whole[:3]} / {whole[3:6]}.{whole[6:]}"))


def no_person(r):
    """What looks a little like personal data and is none, by rules of this test alone."""
    n = r.randrange
    return r.choice((
        f"{n(1, 29)}/{n(1, 13)}/{n(1990, 2030)}", f"{n(1990, 2030)}/{n(10, 13)}/{n(10, 29)} {n(10, 24)}:{n(10, 60)}", f"0-{n(100, 999)}-{n(10000, 99999)}-{n(0, 9)}",
        f"{n(10, 99)}.{n(100000, 999999)}", f"{n(1000, 9999)}-{n(1000, 9999)}", f"{n(10, 99)} {n(100, 999)} {n(100, 999)}", f"{n(1900, 1999)}-{n(1900, 1999)}", "meet at noon.then", "look at example dot",
    ))


@pytest.mark.parametrize("sf", ["0.1"])
def test_pii_unseen_forms(spark, sf):
    """Forms of another generator than the examples', for and against, on texts
    whose hash keeps them from the fit: recall and precision; the shared weights
    are learned."""
    import random

    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").dropDuplicates(["text"])
    held = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(3)) == 0
    field = pii.fit(docs.filter(~held))
    assert abs(field.chain - 0.1) > 0.04 and abs(field.skip - 3.0) > 0.04
    r, planted, hits, others, decoys = random.Random(5), 0, 0, 0, 0
    for (text,) in docs.filter(held & F.col("text").rlike("@|[+][0-9]")).select("text").orderBy("doc_id").collect():
        out, at, size, where = [], 0, 0, []
        for a, z, kind in pii.base_spans(text):
            if kind in ("email", "phone") and a >= at:
                shown, extra = other_form(text[a:z], kind, r), f" see {no_person(r)} too " if r.random() < 0.5 else ""
                size += a - at
                where.append((size, size + len(shown)))
                out += [text[at:a], shown, extra]
                size, at = size + len(shown) + len(extra), z
                decoys += bool(extra)
        shown = "".join(out) + text[at:]
        found = [(a, b) for a, b, _, base in pii.spans(shown, field) if not base]
        planted += len(where)
        hits += sum(any(a < q and p < b for a, b in found) for p, q in where)
        others += sum(not any(a < q and p < b for p, q in where) for a, b in found)
    print("unseen forms", sf, "planted", planted, "found", hits, "decoys", decoys, "others", others, "chain", field.chain, "skip", field.skip)
    assert planted >= 5 and hits >= 0.85 * planted and others <= 0.15 * hits + 1


def test_pii_shared_weights():
    """Rows whose labels follow neighbours, or equal tokens, or neither: the search finds which."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(4)

    def learned(chain_like, skip_like):
        rows = []
        for doc in range(400):
            first = int(r.integers(0, 2))
            for i, token in enumerate((1, 2, 1)):
                same = (chain_like and i == 1) or (skip_like and i == 2)
                label = first if i == 0 or same else int(r.integers(0, 2))
                rows.append((doc * 32, i, label, [label if i == 0 else 5], token, True, i == 0))
        return pii.train(pd.DataFrame(rows, columns=pii.EXAMPLE))

    plain, chain, skip = learned(False, False), learned(True, False), learned(False, True)
    assert chain.chain > plain.chain + 1
    assert skip.skip > plain.skip + 1
    assert pii.train(pd.DataFrame([], columns=pii.EXAMPLE)).skip == 3.0


def test_pii_odd_rows(spark):
    """Repeated rows, ties, a null id, a clashing column and long texts have their defined results."""
    long = "call +1 212 555 0100 " * 2_000
    rows = [(1, "a@b.co", "x"), (1, "a@b.co", "x"), (None, "a@b.co", "y"), (2, None, "z"), (3, long, "z"), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(pii.find(df).collect(), key=lambda x: (x["doc_id"] or 0, x["n_phone"]))
    assert [(x["doc_id"], x["n_email"], x["n_phone"]) for x in got] == [(None, 1, 0), (1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 2_000), (4, 0, 0)]
    assert got[1]["spans"] == "email:0:6" and got[3]["spans"] == ""
    clean = pii.redact(df).orderBy("doc_id").collect()
    assert [x["spans"] for x in clean] == ["y", "x", "x", "z", "z", None] and clean[1]["text"] == "<email>"


def test_stages_keep_clashing_columns(spark):
    """Columns named as the operators' own, and with a dot, come through unchanged."""
    text = "the committee met on tuesday and it was agreed that the road to the north is to be closed for the winter of this year"
    rows = [(1, text, "a", "b", "c", "d"), (2, "zz", "a", "b", "c", "d"), (1, text, "a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes string, _h1 string, _clean string, `a.b` string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = Counter(tuple(x) for x in out.collect())
        assert out.columns == docs.columns
        want = {"quality_rules": Counter({rows[0]: 2}), "near_dedup": Counter([rows[0], rows[1]])}.get(name, Counter(rows))
        assert got == want, name


def test_packing_encoder():
    """Ids by ranks are those of the tokenizer, added tokens and odd characters included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._coder("byte_bpe_50k.json")
    step = 7
    made = ["<|endoftext|>x <|endoftext|>", "a" * 20_000, " " * 20_000, "\r\n\t 1a'S it's  ..."]
    made += ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)}  {chr(c)}b" for c in range(at, min(at + 700, 0x110000), step) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, 700)]
    assert all(encode(x) == plain.encode(x, add_special_tokens=False).ids for x in made)


def test_packing_encoder_blanks():
    """Runs of white space of megabytes, alone and within text, have the tokenizer's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._coder("byte_bpe_50k.json")
    made = [" " * 5_000_000, "\t" * 1_200_000, "a\n" + "\n" * 1_200_000, "x." + " \n\t\r" * 300_000 + "y 1"]
    for c in (" ", "\t", "\n", "\u2003", "\x85", "\x1c", "\xa0 ", " \n"):
        for n in (9_999, 10_000, 10_001, 20_000):
            run = (c * n)[:n]
            made += [f"ab{run}cd", f"{run}é", f"1{run}", f"..{run}'s{run}!{run} {run}"]
    for x in made:
        assert encode(x) == plain.encode(x, add_special_tokens=False).ids, (len(x), x[:3])


def test_written_tables_go(spark, docs, tmp_path):
    """A settled step leaves its own table only."""
    from sparrowmill.llm import common

    folder = common.shared_folder(spark).removeprefix("file://") + "/sparrowmill"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = common.settled(lambda: simhash.keep_one(docs.limit(20)))
    assert len(set(os.listdir(folder)) - before) == 1
    common.release(out)
    assert set(os.listdir(folder)) == before


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_myers():
    import random

    r = random.Random(1)
    for _ in range(300):
        p, t = ("".join(r.choices("abc", k=r.randint(a, 20))) for a in (1, 0))
        assert decontamination.myers(p, t)[0] == plain_distance(p, t)


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy("item_id").first()["text"]
    edited = item[:20] + "zz" + item[23:60] + item[62:]
    extra = spark.createDataFrame([(10_001, "before " + item.upper() + " after"), (10_002, "some text " * 50 + edited), (10_003, item[:30]), (None, None)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    got = {(r._1, r._2): r._3 for r in decontamination.matches(both, bench, "doc_id").toDF("_1", "_2", "_3", "_4").collect()}
    items = [(r.item_id, decontamination.normal(r.text)) for r in bench.collect()]
    want = {}
    for d, t in texts(both):
        t = f" {decontamination.normal(t)} "
        if len(t) < 20_000:
            for i, p in items:
                k = decontamination.budget_of(len(p))
                if (x := decontamination.myers(p, t)[0]) <= k:
                    want[d, i] = x
    assert got == {k: v for k, v in got.items() if k in want} | want
    assert {10_001, 10_002} <= {d for d, _ in got} and 10_003 not in {d for d, _ in got}
    assert decontamination.clean(both, bench.limit(0)).count() == both.count()


def plain_best(items, text, per_error=12):
    """Item to its least distance, by Myers' columns over the whole text."""
    out, text = {}, decontamination.normal(text)
    for item_id, item in items:
        item = decontamination.normal(item)
        k = decontamination.budget_of(len(item), per_error)
        d = decontamination.myers(item, text)[0] if item and k else 0 if item and f" {item} " in f" {text} " else None
        if d is not None and d <= k:
            out[item_id] = d
    return out


def test_decontamination_templates():
    """Items of one opening: matches as ever, and the opening alone costs little."""
    import random
    import time

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    opening = " ".join(word() for _ in range(40))
    items = [(i, f"{opening} {' '.join(word() for _ in range(30))}") for i in range(400)]
    searcher = decontamination.Searcher(items, 12)
    start = time.process_time()
    assert searcher.best(" ".join([opening] * 15)) == {}
    assert time.process_time() - start < 1.5  # 5.5 with a run for every item and place
    # Short and long openings, tails too short for rare pieces, edits of all kinds.
    for tail in (0, 2, 5, 12):
        few = [(i, f"{opening[: r.choice((40, 90, 200))]} {' '.join(word() for _ in range(tail))}") for i in range(12)]
        searcher = decontamination.Searcher(few, 12)
        for _ in range(12):
            text = list(f"{word()} {r.choice(few)[1]} {word()} {r.choice(few)[1]} {word()}")
            for _ in range(r.choice((0, 1, 4, 9, 15))):
                at = r.randrange(len(text))
                text[at : at + r.choice((0, 1))] = r.choice(("", "x", "yz"))
            text = "".join(text)
            assert {i: d for i, (d, _) in searcher.best(text).items()} == plain_best(few, text)


def test_decontamination_odd_rows(spark, empty):
    item = "the quick brown fox jumps over the lazy dog while seven wizards box quietly"
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, " .,")], "item_id long, text string")
    long = "lorem ipsum dolor " * 30_000
    rows = [(1, long + item + " " + long), (2, f"a {item.replace('fox', 'fax')} b"), (2, f"a {item.replace('fox', 'fax')} b"), (3, None), (4, ""), (None, "Short, ONE!"), (5, item[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.matches(docs, bench, row="doc_id").collect()
    assert Counter((r["_row"], r["item_id"], r["distance"]) for r in found) == Counter({(1, 1, 0): 1, (2, 1, 1): 2, (None, 2, 0): 1})
    assert [r["at"] for r in found if r["_row"] == 1] == [len(decontamination.normal(long)) + 2]
    assert Counter(x.doc_id for x in decontamination.clean(docs, bench).collect()) == Counter([3, 4, 5])
    assert decontamination.matches(empty, bench, row="doc_id").count() == 0 and decontamination.clean(empty, bench).count() == 0
    assert decontamination.matches(docs, bench.limit(0), row="doc_id").count() == 0 and decontamination.clean(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_ids(spark):
    """Texts without an id, or under one with a longer text, or under several."""
    item = "the quick brown fox number {} jumps over the lazy dog near river {}"
    a, b, c, d = (item.format(*x) for x in (("one", "rhine and then home"), ("seven", "oder"), ("twenty", "elbe"), ("nine", "main")))
    bench = spark.createDataFrame([(1, a), (1, b), (1, b), (None, c), (2, d), (3, d), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"start {x} end") for i, x in enumerate((a, b, c, d, "clean"))], "doc_id long, text string")
    got = Counter((r._row, r.item_id) for r in decontamination.matches(docs, bench, "doc_id").filter("distance = 0").collect())
    assert got == Counter([(0, 1), (1, 1), (2, None), (3, 2), (3, 3)])
    assert [r.doc_id for r in decontamination.clean(docs, bench).collect()] == [4]


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints, bits=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[root(i)].append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    rows = texts(df)
    prints = [plain_fingerprint(t) for _, t in rows]
    want = Counter((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, plain_components([d for d, _ in rows], prints), strict=True))
    assert Counter(tuple(r) for r in simhash.near_copies(df).collect()) == want
    assert simhash.keep_one(df).count() == len({plain_components(list(range(len(rows))), prints)[i] for i in range(len(rows))})


def test_simhash_links(spark):
    """Chains at exactly 0 to 5 bits, which no shared text would give."""
    import random

    r = random.Random(3)
    prints = []
    for _ in range(60):
        x = r.getrandbits(64)
        prints.append(x)
        for bits in (1, 2, 3, 4, 4, 4, 5, 6):
            y = x
            for b in r.sample(range(64), bits):
                y ^= 1 << b
            prints.append(y)
            x = y if r.random() < 0.3 else x
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = {r.fp: r.root for r in simhash.link(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    want = plain_components(prints, [p % (1 << 64) for p in prints])
    assert [got.get(p, p) for p in prints] == want


def test_simhash_dense_groups(spark):
    """Over a thousand prints round a few centres: large buckets are divided, and no
    join makes more than some rows for each row of the buckets."""
    import random

    import numpy as np

    r = random.Random(6)
    prints = set()
    for _ in range(3):
        x = r.getrandbits(64)
        while len(prints) % 300 != 299:
            prints.add(x ^ sum(1 << b for b in r.sample(range(64), r.choice((2, 3, 6, 9)))))
        prints.add(x)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    got = {x.fp: x.root for x in simhash.link(spark.createDataFrame([(p,) for p in prints], "fp long"), few=4, turns=1).collect()}
    u = np.array(prints, np.int64).view(np.uint64)
    parent = np.arange(len(u))
    while True:
        least = parent.copy()
        for i in range(len(u)):
            least[i] = parent[np.bitwise_count(u ^ u[i]) <= 4].min()
        if (least == parent).all():
            break
        parent = least
    assert [got.get(p, p) for p in prints] == [prints[i] for i in parent]


def plain_shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_near(rows, like=0.8):
    """The rows that stay, by comparing all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= like * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, t) in enumerate(rows):
        least.setdefault(root(i), []).append((d is not None, d or 0, i, d, t))
    return Counter((d, t) for *_, d, t in (min(g) for g in least.values()))


def test_near_dedup_crowded(spark):
    """A large group of short near copies of one text, most of them not alike by
    pairs, in bands of over two texts: the exact join takes them."""
    import random

    r = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"x{r.randrange(10**6)}" if r.random() < r.choice((0.01, 0.03, 0.06)) else w for w in base)) for i in range(250)]
    made = spark.createDataFrame([(*x, "en", "a", 0) for x in rows], SCHEMA)
    found = minhash.grouped(made, few=2, turns=1).collect()
    assert len({x.root for x in found}) == sum(plain_near(rows).values())
    keep = minhash.keep_one(made)
    assert Counter(texts(keep)) == plain_near(rows)


def test_near_dedup_by_simhash(spark):
    """The stage's candidates come from fuzzy Golay keys of SimHash: up to two
    differing bits of a segment leave a key, near copies meet by them and only
    similar texts are linked; the exact join adds what is left, and only that."""
    import random

    r = random.Random(17)
    prints = np.array([[r.randrange(1 << 23) for _ in range(minhash.SEGMENTS)] for _ in range(60)])
    other = prints.copy()
    other[:, 4] ^= [sum(1 << b for b in r.sample(range(23), r.randint(0, 2))) for _ in prints]
    other[:, [0, 1, 2, 3, 7, 8, 9, 10, 11]] ^= 1 << 22  # so only the key of segment 4, with 5 and 6 beside it, is left
    for x, y in zip(minhash.codes(prints), minhash.codes(other), strict=True):
        assert {int(k) >> 32 for k in set(x) & set(y)} >= {4}
    words = [[f"w{r.randrange(5000)}" for _ in range(400)] for _ in range(40)]
    pairs = []
    for i, w in enumerate(words):
        y = list(w)
        for at in r.sample(range(400), 1 if i < 20 else 8):
            y[at] = f"v{r.randrange(5000)}"
        pairs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(y))]
    made = spark.createDataFrame([(*x, "en", "a", 0) for x in pairs], SCHEMA)
    rows = minhash.sketched(made.select("doc_id", *[c.alias(n) for c, n in zip(minhash.identity(), ("_h1", "_h2"), strict=True)], F.col("text").alias("_text")), 5, 0.8)
    copies = minhash.written(rows.withColumnRenamed("doc_id", "rep"))
    roots = {x.fp: x.root for x in minhash.by_simhash(made, copies, 5, 0.8, 16, 3).collect()}
    linked = [i for i in range(40) if roots.get(2 * i, 2 * i) == roots.get(2 * i + 1, 2 * i + 1)]
    assert sum(i < 20 for i in linked) >= 18 and len(linked) < 40
    assert all(f >> 1 == t >> 1 for f, t in roots.items())
    assert len({x.root for x in minhash.grouped(made).collect()}) == 40


def test_exact_pairs(spark):
    """Of short near copies of one text all similar pairs are among the exact ones, whichever root is largest."""
    import random

    r = random.Random(13)
    base = [f"w{r.randrange(900)}" for _ in range(60)]
    rows = []
    for i in range(240):
        w = list(base[: r.choice((60, 60, 52))])
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"v{r.randrange(5000)}"
        rows.append((i, " ".join(w)))
    rare = minhash.rare_keys(spark.createDataFrame(rows, "rep long, _text string"), 5, 0.8)
    sets = {i: minhash.shingles(minhash.split(t), 5) for i, t in rows}
    for merged in (0, 80):  # so many texts are of one root
        roots = {i: 0 if i < merged else i for i in sets}
        got = {tuple(p) for p in minhash.exact_pairs(rare.withColumn("root", F.when(F.col("rep") < merged, 0).otherwise(F.col("rep"))), 0.8).collect()}
        assert all(roots[a] != roots[b] for a, b in got)
        for a in sets:
            for b in range(a + 1, len(rows)):
                both = len(sets[a] & sets[b])
                if roots[a] != roots[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    assert (a, b) in got


def test_near_dedup(spark, docs, odd):
    """Texts at all similarities around 0.8, most of them far apart in SimHash."""
    import random

    r = random.Random(8)
    rows = []
    for _ in range(25):
        x = [f"w{r.randrange(3000)}" for _ in range(r.choice((30, 120, 400)))]
        for edits in (0, 0.01, 0.02, 0.02, 0.03, 0.05):
            y = [f"w{r.randrange(3000)}" if r.random() < edits else w for w in x]
            rows.append((len(rows), " ".join(y)))
            x = y if r.random() < 0.3 else x
    made = spark.createDataFrame([(*x, "en", "a", 0) for x in rows], SCHEMA)
    for df in (made, docs, odd):
        rows = texts(df)
        assert Counter(texts(corpus_pipeline.near_dedup(spark, df, SF))) == plain_near(rows)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, which):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(df).collect()
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.length, r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for d, t in texts(df):
        want[d].append([*coder.encode(t or "", add_special_tokens=False).ids, 0])
    assert set(parts) == set(want)
    for d, ids in want.items():
        # Rows of one id here have equal texts: each place of theirs comes once for each.
        assert all(x == ids[0] for x in ids)
        places = Counter(at for start, piece, n, whole in parts[d] for at in range(start, start + n))
        assert places == Counter({at: len(ids) for at in range(len(ids[0]))})
        assert all(piece == ids[0][start : start + n] and whole == len(ids[0]) for start, piece, n, whole in parts[d])
    total = 0
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
        total += at
    assert len(seqs) * 1024 - total < 2 * 1024


def test_packing_balance():
    """Every piece goes, longest first, to the cheapest sequence with room."""
    import random

    r = random.Random(10)
    for _ in range(200):
        lengths = [r.randrange(1, 65) for _ in range(r.randrange(1, 60))]
        bins = -(-sum(lengths) // 64)
        cost, used, cut = [0.0] * bins, [0] * bins, []
        for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
            n = lengths[p]
            room = [i for i in range(bins) if 64 - used[i] >= n]
            if room:
                i = min(room, key=lambda i: (cost[i], i))
                cut.append((p, 0, n, i, used[i]))
            else:
                at = 0
                for i in sorted((i for i in range(bins) if used[i] < 64), key=lambda i: (used[i], i)):
                    if take := min(n - at, 64 - used[i]):
                        cut.append((p, at, take, i, used[i]))
                        at += take
            for q, _, m, i, _ in cut[::-1]:
                if q != p:
                    break
                used[i] += m
                cost[i] += m + m * m / 64
        assert packing.balance(lengths, 64, 1.0, 1 / 64) == cut


def test_packing_white_space(spark):
    rows = [(1, " " * 1_500_000), (2, "a" + "\n" * 1_100_000 + "b"), (3, "c")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3] and all(r.n == r.whole for r in got)


def test_toxicity(spark, docs):
    got = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.predicted == r.toxic for r in rows)
    assert len(rows) > 50 and hit >= 0.93 * len(rows)


def test_segments():
    import random

    import numpy as np

    def plain(s, at=0):
        if not len(s):
            return []
        sums = [(sum(s[i:j]), -(j - i), -i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
        best = max(sums)
        if best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return [*plain(s[:i], at), (at + i, at + j, best[0]), *plain(s[j:], at + j)]

    r = random.Random(5)
    for _ in range(300):
        s = [r.choice([-7, -5, -3, 2, 4, 8]) + r.randint(0, 1000) / 1009 for _ in range(r.randint(0, 14))]
        got, want = toxicity.segments(np.array(s), 0.0), plain(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_ordinal(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = ordinal.op6_ordinal_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    assert all(r.p_good >= r.p_best and abs(r.expected_grade - r.p_good - r.p_best) < 1e-9 for r in rows)


def test_ordinal_held_out(spark):
    """Each fold of the labelled rows graded by a model of the other folds."""
    sf = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(3))
    rows = []
    for k in range(3):
        model = ordinal.fit(documents, labels.filter(fold != k), ordinal.three_grades(), 3)
        held = documents.join(labels.filter(fold == k), "doc_id")
        rows += ordinal.grade(held, model).join(labels, "doc_id").collect()
    assert len(rows) == labels.count()
    right = sum((r.tails[0] >= 0.5) == (r.quality == 1) for r in rows)
    of = {k: [r.expected_grade for r in rows if (0 if r.quality == 0 else 1 if r.toxic == 1 else 2) == k] for k in range(3)}
    mean = {k: sum(v) / len(v) for k, v in of.items()}
    print("held out:", right, len(rows), {k: (len(v), round(mean[k], 3)) for k, v in of.items()})
    assert right >= 0.95 * len(rows)
    assert mean[0] < mean[1] < mean[2]


def plain_vector(t):
    words = re.findall(r"[^\W_]+", t.lower())
    out = [0.0] * ordinal.DIM
    for w, c in Counter(words).items():
        h = xxhash.xxh64_intdigest(w, 42)
        out[h % (ordinal.DIM - ordinal.DENSE)] += (1 if h >> 63 else -1) * (1 + math.log(c))
    size = math.sqrt(sum(x * x for x in out)) or 1
    n, chars, lines = max(1, len(words)), max(1, len(t)), [x for x in t.split("\n") if x.strip()]
    out = [x / size for x in out]
    out[-ordinal.DENSE :] = [
        min(2, math.log1p(len(words)) / 4), len(set(words)) / n, sum(map(len, words)) / n / 8, sum(c.isupper() for c in t) / chars * 4,
        sum(c.isdigit() for c in t) / chars * 4, min(2, sum(c in "#*$%&|<>!" for c in t) / n * 4), len(set(lines)) / max(1, len(lines)), min(2, t.count(".") / n * 8),
    ]
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB É²1_.#! \n", max_size=80))
def test_ordinal_vector(t):
    at, x = ordinal.vector(t)
    got = [0.0] * ordinal.DIM
    for i, v in zip(at, x, strict=True):
        got[i] = v
    assert got == pytest.approx(plain_vector(t), abs=1e-12)
    assert all(x != 0) and len(set(at)) == len(at)


def test_ordinal_gradient():
    """The gradient against differences of the likelihood written out."""
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(["good", "bad", "fine", "odd", "Plain"], 6)) for _ in range(30)]
    made, y = [ordinal.vector(t) for t in texts], r.integers(0, 4, 30)
    row, at, x = np.repeat(np.arange(30), [len(a) for a, _ in made]), np.concatenate([a for a, _ in made]), np.concatenate([v for _, v in made])
    theta = r.normal(0, 0.5, ordinal.DIM + 3)

    def plain(theta):
        model, out = ordinal.Model(theta[: ordinal.DIM], ordinal.cuts(theta)), 0.0
        for (a, v), k in zip(made, y, strict=True):
            tails = [1.0, *model.tails(a, v), 0.0]
            out -= math.log(tails[k] - tails[k + 1])
        return out / 30 + 0.01 / 2 * (theta[: ordinal.DIM] ** 2).sum()

    value, gradient = ordinal.loss(theta, row, at, x, y, 4, 0.01)
    assert value == pytest.approx(plain(theta))
    assert (np.diff(ordinal.cuts(theta)) > 0).all()
    for i in [*np.unique(at)[:20], 5, *range(ordinal.DIM, ordinal.DIM + 3)]:
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert gradient[i] == pytest.approx((plain(theta + step) - plain(theta - step)) / 2e-5, abs=1e-6)


def test_secrets(spark, empty):
    rows = [(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'), (2, "internationalisationofdocuments and averyveryverylongword"), (3, 'api_key = "example_example_example"'), (4, None)]
    found = secrets.candidates(spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, source string"))
    assert {(r.doc_id, r.secret) for r in found.collect()} >= {(1, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")}
    got = secrets.op5_secret_scan(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    planted = sum(len(re.findall(r'token = "[0-9a-f]{40}"', r.text)) for r in docs)
    assert sum(r.reported for r in got) >= planted > 0
    assert secrets.scan(empty).count() == 0


def test_secrets_copies(spark):
    """Copies of one placeholder, far more than the sample takes, and a few secrets."""
    tokens = [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"' for i in range(30)]
    words = [f'password = "{w}{v}documentation"' for w in secrets.DICTIONARY[:20] for v in secrets.DICTIONARY[20:22]]
    rows = [(i, t, None) for i, t in enumerate(['api_key = "example_example_example"'] * 3000 + tokens + words)]
    found = secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    model = secrets.fit(secrets.weak_label(found), max_rows=50)
    assert model is not None
    got = secrets.judge(found, model).select("doc_id", "reported").collect()
    assert sorted(r.doc_id for r in got if r.reported) == list(range(3000, 3030))


def test_secrets_reviewed(spark, docs):
    """Findings reviewed apart from the features: each is labelled by what was put in
    its place. A forest of one half is held against the other."""
    import random
    import string

    r, names = random.Random(12), "connection settings renderer default handler storage backup region customer report widget".split()
    alnum, code = string.ascii_letters + string.digits, []
    kinds = {
        "hex": (1, lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40])))),
        "key": (1, lambda: "".join(r.choice(alnum) for _ in range(r.randrange(20, 44)))),
        "short": (1, lambda: "".join(r.choice(alnum + "!@$.%") for _ in range(r.randrange(8, 15)))),
        "camel": (0, lambda: r.choice(names) + "".join(r.choice(names).title() for _ in range(3))),
        "snake": (0, lambda: "_".join(r.choice(names) for _ in range(4))),
        "path": (0, lambda: "/".join(r.choice(names) for _ in range(4))),
        "dated": (0, lambda: f"{r.choice(names)}-{r.choice(names)}-20{r.randrange(10, 30)}-{r.randrange(1, 13):02d}"),
    }
    for i in range(700):
        label, make = kinds[kind := r.choice(list(kinds))]
        name = r.choice(["password", "token", "api_key"]) if kind == "short" or r.random() < 0.4 else r.choice(names)
        code.append((i, f'the {r.choice(names)} of a {r.choice(names)} is\n{name} = "{make()}"', "app/conf.py" if i % 3 else "web", kind, label))
    everything = docs.select("doc_id", "text", "source").union(spark.createDataFrame([(10**6 + i, t, p) for i, t, p, _, _ in code], "doc_id long, text string, source string"))
    found = secrets.candidates(everything).filter("doc_id >= 1000000")
    found = found.join(spark.createDataFrame([(10**6 + i, k, v) for i, _, _, k, v in code], "doc_id long, kind string, label int"), "doc_id").cache()
    assert found.count() == len(code)
    model = secrets.fit(found.filter("doc_id % 2 = 0"))
    held = secrets.judge(found.filter("doc_id % 2 = 1"), model).select("kind", "label", "reported").collect()
    hit, said, true = sum(x.label and x.reported for x in held), sum(x.reported for x in held), sum(x.label for x in held)
    print("held out:", hit, said, true, Counter((x.kind, x.reported) for x in held))
    assert hit >= 0.95 * said and hit >= 0.95 * true
    assert any(x.kind == "short" and x.reported for x in held)
    # Counts and bits by their definition.
    n = Counter(w for x in everything.collect() for w in re.findall(secrets.WORD, (x.text or "").lower()))
    assert {x.word: x.n for x in secrets.words(everything).collect()} == n
    pairs = Counter()
    for w, k in n.items():
        for pair in zip(w, w[1:], strict=False):
            pairs[pair] += k
    total = sum(n.values())
    for x in found.orderBy("doc_id").limit(40).collect():
        low = [c if c in secrets.LETTERS else None for c in x.secret.lower()]
        bits = [math.log2((27 + sum(pairs[a, z] for z in secrets.LETTERS)) / (1 + pairs[a, b])) for a, b in zip(low, low[1:], strict=False)]
        assert x.surprise == pytest.approx(sum(bits) / len(bits))
        parts = [w.lower() for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", x.secret)]
        assert x.known == pytest.approx(sum(len(w) for w in parts if len(w) > 3 and n[w] >= 3 and n[w] * 1_000_000 >= 2 * total) / len(x.secret))


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there, how are you?"), (1, 1, "assistant", "Fine, thanks."), (1, 2, "user", "> Hello there,  how ARE you?\nAs I said."), (1, 3, "user", "On Monday X wrote:\n> > Hello there, how are you?\n> Fine, thanks.\nGood."), (2, 0, "user", None), (None, None, None, None)]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 6
    assert (got[1, 2].parent, got[1, 2].clean, got[1, 2].quotes) == (0, "As I said.", True)
    assert (got[1, 3].parent, got[1, 3].clean, got[1, 3].n_quoted) == (1, "Good.", 2)
    assert [t for _, t in sorted((r.position, t) for (c, t), r in got.items() if c == 1)] == [0, 2, 1, 3]


def test_quotes_odd(spark):
    """Marks without end, an announcement that nothing follows, repeats, an empty table."""
    kind = "conv_id long, turn long, role string, text string, shared string"
    said = "On Monday the minister wrote:"
    rows = [(1, 0, "user", ">" * 50_000 + " x", "s"), (1, 1, "user", f"{said}\nnothing", "s"), (1, 2, "user", f"{said}\n\n> nothing\nyes", "s"), (1, 2, "user", f"{said}\n\n> nothing\nyes", "s"), (1, 3, "user", "word " * 100_000, None)]
    got = quotes.conversations(spark.createDataFrame(rows, kind)).collect()
    by = {r.turn: r for r in got}
    assert len(got) == 5 and sorted(r.position for r in got) == [1, 2, 3, 4, 5]
    assert (by[0].n_quoted, by[0].clean) == (1, "")
    assert by[1].clean == f"{said}\nnothing"
    assert (by[2].clean, by[2].parent, by[2].quotes, by[2].n_quoted) == ("yes", 1, True, 1)
    assert by[3].clean == ("word " * 100_000).strip()
    assert quotes.conversations(spark.createDataFrame([], kind)).count() == 0


def test_quotes_chains(spark):
    """Chains of replies that quote replies, of up to some 40 links."""
    import random

    r = random.Random(4)
    rows, paths = [(1, 0, "user", "a b"), (1, 1, "user", "c d"), (1, 2, "user", "> a b\ne f"), (1, 3, "user", "> e f\ng h"), (1, 4, "user", "> a b\ni j"), (1, 5, "user", "> g h\nk l")], {}
    for conv in (2, 3, 4):
        for turn in range(60):
            # Conversation 2 is one chain but for its plain turns.
            parent = None if turn < 2 or r.random() < 0.1 else turn - 2 if conv == 2 else r.randrange(turn)
            rows.append((conv, turn, "user", f"{'' if parent is None else f'> own line {conv} {parent}' + chr(10)}own line {conv} {turn}"))
            paths[conv, turn] = (*(paths[conv, parent] if parent is not None else ()), turn)
    r.shuffle(rows)
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    order = {c: [x.turn for x in sorted(got, key=lambda x: x.position) if x.conv_id == c] for c in (1, 2, 3, 4)}
    assert order[1] == [0, 2, 3, 5, 4, 1]
    for conv in (2, 3, 4):
        assert order[conv] == [t for _, t in sorted((p, t) for (c, t), p in paths.items() if c == conv)]


def test_quotes_sql(spark, tmp_path):
    """The given conversations as they are and with quotes of earlier turns put in, some
    nested, announced, split or of several turns, against SQL."""
    import random

    con = duck("/root/testdata/sf0.01")
    sql = quotes.ORACLE_SQL["op9_quotation_links"]
    same(quotes.op9_quotation_links(spark, "/root/testdata/sf0.01"), con, sql)
    r, said, rows = random.Random(3), defaultdict(list), []
    for c, t, role, text in con.sql("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn").fetchall():
        lines = [x.strip() + "." for x in text.split(".") if x.strip()]
        quoted = []
        for _ in range(r.choice([0, 1, 1, 2]) if said[c] else 0):
            old = r.choice(said[c]).split("\n")
            quoted += r.choice([[], ["On Monday someone wrote:"], ["Jemand schrieb:", ""]]) + [r.choice(["> ", ">", " >  "]) + x for x in old[: r.randrange(1, 6)]]
        at = r.randrange(len(lines) + 1)
        text = "\n".join([*lines[:at], *quoted, *lines[at:], *r.choice([[], ["On Tuesday nobody wrote:"], [""]])])
        said[c].append(text)
        rows.append((c, t, None if r.random() < 0.05 else role, None if r.random() < 0.05 else text))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = quotes.op9_quotation_links(spark, str(tmp_path))
    assert got.filter("quotes").count() > 100
    same(got, duck(str(tmp_path)), sql)


def test_quotes_long_conversation(spark, tmp_path):
    """One conversation with most rows, spread over ranges, beside short ones,
    null ids and turns that come several times, against SQL and in parts."""
    import random

    r, rows = random.Random(8), []
    for turn in range(3000):
        quoted = f"> line {r.randrange(turn)}\n" if turn and turn % 50 == 0 else ""
        rows.append((7, turn, r.choice(["user", "assistant", None]), f"{quoted}line {turn}"))
    rows += [(c, t, "user", f"short {c} {t}") for c in (1, 6, 8, 30) for t in range(3)]
    rows += [(8, 2, "user", x) for x in ("b", "a", "> q\na", "a", None)]
    r.shuffle(rows)
    kind = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, kind).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        same(quotes.op9_quotation_links(spark, str(tmp_path)), duck(str(tmp_path)), quotes.ORACLE_SQL["op9_quotation_links"])
        many = spark.createDataFrame([(None, None, "user", f"x{i % 9}") for i in range(2000)] + rows, kind)
        got = quotes.conversations(many).filter("conv_id IS NULL").collect()
        assert sorted(x.position for x in got) == list(range(1, 2001)) and not any(x.quotes or x.parent for x in got)
        turns = quotes.ranged(many.filter("conv_id = 7").select("conv_id", "turn"), F.col("turn"))
        sizes = [x["count"] for x in turns.groupBy("_part").count().collect()]
        assert len(sizes) > 8 and max(sizes) < 900
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(empty).count() == 0
    assert pii.find(empty).count() == 0
    assert simhash.near_copies(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert ordinal.grade(empty, ordinal.fit(empty, labels, F.col("quality"), 3)).count() == 0


def test_odd_rows_are_scored(spark, odd):
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == len(ODD)
    graded = ordinal.grade(odd, ordinal.fit(odd, labels, F.col("quality"), 3)).collect()
    assert len(graded) == len(ODD)
    by = defaultdict(list)
    for r in graded:
        by[r.doc_id].append((r.expected_grade, tuple(r.tails)))
    assert by[1] == by[2] and by[5][0] == by[5][1] and by[4][0][0] > by[2][0][0]
    assert all(0 <= b <= a <= 1 for v in by.values() for _, (a, b) in v)
    assert secrets.scan(odd).count() >= 1


def test_pipeline_stages_take_odd_rows(spark, odd, empty):
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            out.count()
            docs = start if name == "quality_rules" else out
