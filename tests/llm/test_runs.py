"""Periodic runs against every period tried at every place."""

import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowmill.llm import runs

SF = "/root/testdata/sf0.001"


def plain_runs(w, exponent, least):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and (n := i - start + q) >= max(least, exponent * q):
                found.setdefault((start, n), q)
            i += i == start
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w, 4, 6)
    drop = {i for a, m, q in found for i in range(a + q, a + m)}
    a, m, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), a, m, q, 1000 * m // q if found else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


WORDS = st.lists(st.integers(0, 3), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS, st.integers(0, 8), WORDS).map(lambda x: x[0] + x[1] * x[2] + x[3]), max_size=4), st.sampled_from([(2, 2), (2, 7), (3, 5), (4, 6)]))
def test_runs_of(docs, at_least):
    assert runs.runs_of(docs, *at_least) == [plain_runs(w, *at_least) for w in docs]


def test_runs_copied_within_blocks():
    # The runs of the first half lie inside one block of the second and of the third.
    part = [1, 2] * 6 + [3, 4, 4, 4, 4, 4, 4, 4, 5] + [6, 7, 8] * 5 + [9]
    docs = [part * 3, [0] + part + [10] + part, part]
    assert runs.runs_of(docs, 4, 6) == [plain_runs(w, 4, 6) for w in docs]
    assert len(runs.runs_of(docs, 4, 6)[0]) == 9


def rows(df):
    return sorted((tuple(r[c] for c in "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()) for r in df.collect()), key=repr)


def test_runs_query(spark):
    got = rows(runs.op13_periodic_runs(spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((plain_row(*d) for d in docs), key=repr)
    assert got == want
    assert sum(r[1] > 0 for r in got) >= 5


@pytest.fixture(scope="module")
def odd(tmp_path_factory, spark):
    folder = str(tmp_path_factory.mktemp("odd"))
    many = [(i, f"start {'ha ' * (i % 9)}{'one two three ' * (i % 5)}end") for i in range(60)]
    texts = [(None, None), (None, "x " * 50), (20, None), (20, ""), (20, " \n\t "), (21, "a b " * 9 + "é"), (21, "a b " * 9 + "é"), (22, "la " * 5), (22, "la " * 6), (23, "w" * 100_000), *many]
    spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, runs int, _found int").write.parquet(f"{folder}/documents.parquet")
    return folder, texts


def test_runs_odd_rows(spark, odd):
    folder, texts = odd
    assert rows(runs.op13_periodic_runs(spark, folder)) == sorted((plain_row(*t) for t in texts), key=repr)


def test_runs_keep_other_columns(spark, odd):
    df = spark.read.parquet(f"{odd[0]}/documents.parquet")
    got = runs.find(df)
    assert got.columns == ["doc_id", "text", "_found", "runs", "collapsed"] and got.count() == df.count()
    row = got.filter("text = 'la la la la la la '").first()
    assert [tuple(r) for r in row.runs] == [(0, 6, 1)] and row.collapsed == "la" and row._found == 2
    assert runs.find(df.limit(0)).count() == 0


def test_runs_long_texts(spark):
    words = [str(i * i % 1009) for i in range(60_000)]
    long = {1: "ha " * 300_000, 2: " ".join((words * 5)[:250_000]), 3: "ab cd " * 9 + " ".join(map(str, range(200_000)))}
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.find(spark.createDataFrame(list(long.items()), "doc_id long, text string")).collect()}
    # i * i mod 1009 has period 1009.
    assert got[1] == [(0, 300_000, 1)] and got[3] == [(0, 18, 2)]
    assert got[2] == sorted([(0, 250_000, 60_000), *((60_000 * i, 60_000 if i < 4 else 10_000, 1009) for i in range(5))], key=lambda r: (r[0], r[2]))
