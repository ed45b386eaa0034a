"""What the text operators share: readers, written tables, word patterns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space is ASCII here; the rest makes words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of written tables: those of the innermost :func:`settled` come last.
_OPEN: ContextVar[list[str]] = ContextVar("open", default=[])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only
    on a single machine may it be unset, and a local one takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or f"file://{tempfile.gettempdir()}/sparrowmill"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage
    ends there, a lost executor costs no recomputation, unused columns are not
    read, and values that depend on the order of rows are fixed. The folder goes
    with :func:`release`, at the end of a :func:`settled` step, or with Spark."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparrowmill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    _OPEN.get().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Deletes the folders of written tables that nothing reads any more. Call
    it only after all that came from them has been written in turn: then no
    task, retried or not, goes back to them."""
    for t in tables:
        if (path := getattr(t, "_folder", None)) in _OPEN.get():
            _OPEN.get().remove(path)
            _delete(t.sparkSession, path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make()`` as a written table; all that was written on the
    way to them is deleted."""
    token = _OPEN.set([])
    try:
        out = written(make())
        for path in [p for p in _OPEN.get() if p != out._folder]:
            _delete(out.sparkSession, path)
    finally:
        _OPEN.reset(token)
    _OPEN.get().append(out._folder)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` has
    it, so that a caller's columns are never taken for an operator's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def identity(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits of hash of a row's id and text, null included, as two columns.
    Unlike row numbers they are the same in every run over a table, so rows are
    found again without keeping a copy of it."""
    both = [F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`")]
    told = [F.coalesce(c, F.lit("")) for c in both] + [c.isNull() for c in both]
    return [F.xxhash64(*told), F.xxhash64(F.lit(11), *told)]


def only(df: DataFrame, keep: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose identity is in ``keep (_h1, _h2)``. Texts shuffle
    once, by a key that copies under several ids do not share; rows repeated
    under one id do, and Spark splits such a partition at run time."""
    names = fresh(df, "_h1", "_h2")
    named = df.withColumns(dict(zip(names, identity(doc_id, text), strict=True)))
    return named.join(keep.select("_h1", "_h2").toDF(*names), names, "left_semi").drop(*names)


def one_each(df: DataFrame, keep: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each identity in ``keep (_h1, _h2, n)``, where ``n``
    says how many rows have it. Only those that several rows have are reduced."""
    out, again = only(df, keep.filter("n = 1"), doc_id, text), keep.filter("n > 1")
    if is_empty(again):
        return out
    names = fresh(df, "_h1", "_h2")
    rows = only(df, again, doc_id, text).withColumns(dict(zip(names, identity(doc_id, text), strict=True)))
    return out.union(rows.dropDuplicates(names).drop(*names))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add (any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def labelled(labels: DataFrame, value: Column, limit: int) -> DataFrame:
    """About ``limit`` labelled ids, or all if they are fewer, with ``value`` as
    ``label``: those with the lowest hashes, taken by a threshold and so without
    a sort. At 16 bytes a row, this bounds what is broadcast. Of an id with
    several labels the largest counts."""
    named = labels.select("doc_id", value.alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = limit / max(1, limit, named.count())
    return named if share == 1 else named.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
