"""Collocations against SQL and against all phrases counted one by one."""

import re
from collections import Counter

import pytest

from compare import duck, same
from sparrowmill.llm import collocations

SCHEMA = "text string, lang string, phrase int, rank string"


def plain(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {k for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for lang, w in cand:
        a = f[lang, w]
        longer = [v for x, v in cand if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * f[lang, v] >= 100 * a for v in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top], 1))


def got(df):
    return sorted(tuple(r[c] for c in "lang rank phrase a l r n score".split()) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_collocations_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    df = collocations.op11_collocations(spark, folder)
    assert [t for _, t in df.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert df.count() > 20
    same(df, duck(folder), collocations.ORACLE_SQL["op11_collocations"])


def odd_rows():
    rows = [("The Cat sat on the mat. The cat sat, again\tthe cat sat on the mat!", "en")] * 6
    rows += [("É é É é\x0bcafé au lait\rcafé au lait; CAFÉ au lait", None), ("É é É é", "und"), (None, "en"), ("", None), (" \t\n", "en")] * 3
    rows += [("a\x01b c\x00d a\x01b c\x00d a\x01b", "x"), ("a a a a a a a a", "x"), ("new york new york new york times", "")] * 4
    rows += [("one two three four five six seven " * 50, "long"), ("w" * 70_000, "long")]
    return [(t, lang, i, "r") for i, (t, lang) in enumerate(rows)]


@pytest.mark.parametrize("crowded", [50_000, 6])
@pytest.mark.parametrize("least", [3, 6])
def test_collocations_odd_rows(spark, least, crowded):
    # With few pairs to a crowded slot most prefixes are split over tasks.
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(collocations.mine(df, least=least, crowded=crowded)) == plain(rows, least)
    assert got(collocations.mine(df, least=least, crowded=crowded, top=2)) == plain(rows, least, 2)


def test_collocations_parts(spark):
    import pandas as pd

    rows = odd_rows()
    b = pd.DataFrame([(lang or "und", t or "") for t, lang, *_ in rows], columns=["lang", "_text"])
    whole = {lang: Counter(data.replace(b".", b" . ").split()) for lang, data in collocations.parts(b)}
    cut = {lang: Counter() for lang in whole}
    for lang, data in collocations.parts(b, 10):
        cut[lang] += Counter(data.replace(b".", b" . ").split())
    assert cut == whole


def test_collocations_exact_numbers(spark):
    big = spark.createDataFrame([("x", "p q", 3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_001, 9_000_000_000_007)], "lang string, phrase string, a long, l long, r long, n long")
    div = "(CAST(1000 * a AS DECIMAL(19)) * CAST(n AS DECIMAL(19))) div (CAST(l AS DECIMAL(19)) * CAST(r AS DECIMAL(19)))"
    assert big.selectExpr(f"{div} AS s").first().s == 1000 * 3_000_000_000_000 * 9_000_000_000_007 // (4_000_000_000_000 * 5_000_000_000_001)


def test_collocations_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert got(collocations.mine(df)) == []
    assert got(collocations.mine(spark.createDataFrame([(None, None, 1, "")], SCHEMA))) == []
    with pytest.raises(ValueError):
        collocations.mine(df, crowded=70_000)
