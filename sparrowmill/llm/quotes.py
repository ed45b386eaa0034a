"""Quotation linking: replies joined to the messages that they quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.llm.common import is_empty, release, written
from sparrowmill.sources import table

# One class and no repeated group, so that a line of any number of marks is read without recursion.
MARKS = r"^[ \t>]*>[ \t]?"
HEADER = r"(?i)^\s*(on .{4,200} wrote:|[-_]{2,}\s*original message\s*[-_]{2,}|.{2,80} (schrieb|a écrit|escribió)\s?:)\s*$"


def level(line: Column) -> Column:
    """How many quote marks start a line."""
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def normal(line: Column) -> Column:
    """A line without quote marks, in lower case, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[\x20\x09-\x0D]+", " "))


def parts(text: Column) -> Column:
    """The lines of a text without those that only say whose words follow: a line
    like "on ... wrote:" with a line of a deeper level after it, or after a blank
    one. Without such a line after it, it is the author's own."""
    every = F.split(F.coalesce(text, F.lit("")), "\n")

    def announces(x, i):
        near, next_ = F.get(every, i + 1), F.get(every, i + 2)
        after = F.coalesce(F.when(near.rlike(r"^\s*$"), next_).otherwise(near), F.lit(""))
        return F.regexp_replace(x, MARKS, "").rlike(HEADER) & (level(after) > level(x))

    return F.filter(every, lambda x, i: ~announces(x, i))


def lines(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, hash)`` of each line with a word, once per message."""
    rows = messages.select("conv_id", "turn", F.explode(parts(F.col("text"))).alias("_l")).filter(F.col("_l").rlike(r"[^\s>]"))
    rows = rows.select("conv_id", "turn", level(F.col("_l")).alias("level"), normal(F.col("_l")).alias("_n"))
    return rows.select("conv_id", "turn", "level", F.xxhash64("_n").alias("hash")).distinct()


def links(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent, shared)``: for each message with quoted lines,
    the earlier message of its conversation in whose own lines the most of its
    shallowest quoted lines appear; of equals, the latest.

    A line's first and last own appearances are joined only to quoted lines, so
    a common line does not pair messages with one another."""
    rows = lines(messages)
    own = rows.filter("level = 0").select("conv_id", "hash", F.col("turn").alias("_from"))
    quoted = rows.filter("level > 0").select("conv_id", "hash", "turn", "level")
    # For every quoted line: the latest own appearance before the quoting turn.
    tagged = own.select("conv_id", "hash", F.col("_from").alias("turn"), F.lit(0).alias("level")).unionByName(quoted)
    wanted = quoted.select("conv_id", "hash").distinct()
    tagged = tagged.join(wanted, ["conv_id", "hash"], "left_semi")
    seen = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    tagged = tagged.withColumn("parent", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(seen))
    votes = tagged.filter("level > 0 AND parent IS NOT NULL").groupBy("conv_id", "turn", "parent").agg(F.count("*").alias("shared"), F.min("level").alias("_level"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("_level")).alias("l"), "shared", "parent")).alias("_b"))
    return best.select("conv_id", "turn", F.col("_b.parent").alias("parent"), F.col("_b.shared").alias("shared"))


def tour(found: DataFrame) -> DataFrame:
    """``(conv_id, turn, thread, left)`` for the turns of ``found (conv_id, turn,
    parent)`` and their parents: the turn that starts the thread, through all
    parents, and how many turns are left of the thread from this one on, a turn
    coming before the replies to it and replies by turn. This is the order by
    the path from the start, without paths, whose sizes add up to the square of
    a chain's length.

    A turn is entered, its replies are gone through, and it is left again
    (``up``). These steps are a list that ends where the start is left; each
    points to the next and then jumps along the pointers to the end. Only steps
    that have not reached it are joined, so no step is met twice in a round."""
    found = found.select("conv_id", "turn", "parent")
    turns = found.select("conv_id", "turn").union(found.select("conv_id", "parent")).distinct()
    siblings = found.withColumn("next", F.lead("turn").over(Window.partitionBy("conv_id", "parent").orderBy("turn")))
    first = found.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("first"))
    near = written(turns.join(siblings, ["conv_id", "turn"], "left").join(first, ["conv_id", "turn"], "left"))
    enter = near.select("conv_id", "turn", F.lit(False).alias("up"), F.coalesce("first", "turn").alias("to"), F.col("first").isNull().alias("to_up"), F.lit(1).cast("long").alias("left"), F.lit(False).alias("done"))
    leave = near.select("conv_id", "turn", F.lit(True), F.coalesce("next", "parent", "turn"), F.col("next").isNull(), F.lit(0).cast("long"), F.col("parent").isNull())
    steps = written(enter.union(leave))
    while not is_empty(steps.filter("NOT done")):
        far = steps.select("conv_id", F.col("turn").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("_to"), F.col("to_up").alias("_up"), F.col("left").alias("_left"), F.col("done").alias("_done"))
        jumped = steps.filter("NOT done").join(far, ["conv_id", "to", "to_up"])
        jumped = jumped.select("conv_id", "turn", "up", F.col("_to").alias("to"), F.col("_up").alias("to_up"), (F.col("left") + F.col("_left")).alias("left"), F.col("_done").alias("done"))
        before, steps = steps, written(steps.filter("done").union(jumped))
        release(before)
    return steps.filter("NOT up").select("conv_id", "turn", F.col("to").alias("thread"), "left")


def ranged(rows: DataFrame, *keys: Column) -> DataFrame:
    """``rows`` in ranges of ``conv_id`` and ``keys``, written, with the number
    of the range as ``_part``. A conversation of any length lies in as many
    ranges, one after the other, as it takes. Ranges come from a sample of the
    keys, so these must be short; equal rows stay together unless a key tells
    them apart."""
    return written(rows.repartitionByRange(F.col("conv_id").asc_nulls_first(), *keys).withColumn("_part", F.spark_partition_id()))


def _carried(parts: DataFrame, value: Column) -> DataFrame:
    """``parts (conv_id, _part, _x)`` with ``value`` over the earlier parts of the
    conversation, where there are any. Only a range's first conversation can
    have begun before it: this has less than a row for each range, and so can
    be broadcast."""
    return F.broadcast(parts.withColumn("_x", value).filter("_x IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_at"), "_x"))


def _with(rows: DataFrame, carried: DataFrame) -> DataFrame:
    return rows.join(carried, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_at")), "left").drop("_conv", "_at")


def preceding(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, before)`` for rows ``(conv_id, turn)``, each once: the
    turn before it in its conversation, which is not taken as a whole."""
    rows = ranged(turns, F.col("turn").asc_nulls_first())
    within = Window.partitionBy("conv_id", "_part").orderBy("turn")
    last = rows.groupBy("conv_id", "_part").agg(F.max("turn").alias("_x"))
    carried = _carried(last, F.lag("_x").over(Window.partitionBy("conv_id").orderBy("_part")))
    return _with(rows.withColumn("before", F.lag("turn").over(within)), carried).select("conv_id", "turn", F.coalesce("before", "_x").alias("before"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``position``, from 1 within each conversation under
    ``order``, which must tell all rows apart: numbers within each range plus
    the rows of its conversation in the ranges before."""
    rows = ranged(rows, *order)
    sizes = rows.groupBy("conv_id", "_part").agg(F.count("*").alias("_x"))
    carried = _carried(sizes, F.sum("_x").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order))
    return _with(rows.withColumn("_place", place), carried).withColumn("position", F.col("_place") + F.coalesce("_x", F.lit(0))).drop("_place", "_x", "_part")


def conversations(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, clean, clean_sha256, n_quoted, parent, quotes,
    position)``: every message without quoted lines and their headers, linked to
    the message that it answers (the one that it quotes, else the turn before)
    and numbered in reply order within its conversation.

    Reply order sorts by the turn that starts a thread - a message that quotes
    joins the thread of its parent, however long the chain - and within it by
    the path from there: each message is followed by the replies that quote it,
    these by turn. Null texts are empty and very long ones are read whole; a null
    role stays null; repeated rows all come out, those of one turn by role, by
    the digest of their text and by ``n_quoted``; a role is a short label, as
    its values are sampled to divide the rows; of messages with equally many
    shared lines the latest is quoted; rows with null conv_id or turn come out
    without a link and are numbered like those of any conversation; empty tables
    give no rows; other columns are not carried.

    Texts are written once and joined to their numbers; links and numbers are
    made on rows without texts, and no step takes a conversation in one task."""
    said = parts(F.col("text"))
    own = F.filter(said, lambda x: ~x.rlike(MARKS))
    n_quoted = F.size(F.filter(said, lambda x: x.rlike(MARKS))).cast("long")
    rows = messages.select("conv_id", "turn", "role", F.btrim(F.array_join(own, "\n"), F.lit(" \t\r\n")).alias("clean"), n_quoted.alias("n_quoted"))
    rows = written(rows.withColumns({"clean_sha256": F.sha2("clean", 256), "_id": F.monotonically_increasing_id()}))
    found = written(links(messages))
    linked = preceding(rows.filter("conv_id IS NOT NULL").select("conv_id", "turn").distinct()).join(found, ["conv_id", "turn"], "left")
    if is_empty(found):
        linked = linked.withColumns({"thread": F.col("turn"), "left": F.lit(None).cast("long")})
    else:
        linked = linked.join(tour(found), ["conv_id", "turn"], "left")
    narrow = rows.select("conv_id", "turn", "role", "clean_sha256", "n_quoted", "_id").join(linked, ["conv_id", "turn"], "left")
    # Turns that neither quote nor are quoted, and rows without a conversation, have met no thread.
    narrow = narrow.withColumn("thread", F.coalesce("thread", "turn"))
    order = [F.col("thread").asc_nulls_first(), F.desc("left"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.asc("clean_sha256"), F.asc("n_quoted"), F.asc("_id")]
    placed = numbered(narrow, *order).select("_id", F.coalesce("parent", "before").alias("parent"), F.col("shared").isNotNull().alias("quotes"), F.col("position").cast("long").alias("position"))
    return rows.join(placed, "_id").select("conv_id", "turn", "role", "clean", "clean_sha256", "n_quoted", "parent", "quotes", "position")


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversations(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "clean_sha256", "n_quoted", "parent", "quotes", "position")


QUERIES = {"op9_quotation_links": op9_quotation_links}
#: Compares passages by their words instead of hashes and sorts by whole paths,
#: which tables of any length would not bear.
ORACLE_SQL = {
    "op9_quotation_links": rf"""
WITH RECURSIVE msg AS MATERIALIZED (
  SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS every FROM conversations
), line AS (
  SELECT id, conv_id, turn, i, every[i] AS x, regexp_replace(every[i], '{MARKS}', '') AS bare,
    length(regexp_replace(regexp_extract(every[i], '{MARKS}'), '[^>]', '', 'g')) AS level,
    coalesce(CASE WHEN regexp_matches(every[i + 1], '^\s*$') THEN every[i + 2] ELSE every[i + 1] END, '') AS after
  FROM (SELECT *, unnest(range(1, len(every) + 1)) AS i FROM msg)
), said AS (
  SELECT id, conv_id, turn, i, x, level, trim(regexp_replace(lower(bare), '[\x20\x09-\x0D]+', ' ', 'g')) AS words FROM line
  WHERE NOT (regexp_matches(bare, '{HEADER}') AND length(regexp_replace(regexp_extract(after, '{MARKS}'), '[^>]', '', 'g')) > level)
), body AS (
  SELECT id, trim(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), ' ' || chr(9) || chr(13) || chr(10)) AS clean,
    count(*) FILTER (WHERE level > 0) AS n_quoted
  FROM said GROUP BY id
), passage AS (
  SELECT DISTINCT conv_id, turn, level, words FROM said WHERE regexp_matches(x, '[^\s>]')
), voted AS (
  SELECT q.conv_id, q.turn, q.level, max(o.turn) AS parent
  FROM passage q JOIN passage o ON o.conv_id = q.conv_id AND o.words = q.words AND o.level = 0 AND o.turn < q.turn
  WHERE q.level > 0 GROUP BY q.conv_id, q.turn, q.level, q.words
), votes AS (
  SELECT conv_id, turn, parent, count(*) AS shared, min(level) AS level FROM voted GROUP BY conv_id, turn, parent
), link AS (
  SELECT conv_id, turn, parent FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, shared DESC, parent DESC) = 1
), turns AS (
  SELECT t.conv_id, t.turn, lag(t.turn) OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS before, l.parent
  FROM (SELECT DISTINCT conv_id, turn FROM msg) t LEFT JOIN link l ON l.conv_id = t.conv_id AND l.turn = t.turn
), thread AS (
  SELECT conv_id, turn, [turn] AS path FROM turns WHERE parent IS NULL
  UNION ALL
  SELECT t.conv_id, t.turn, list_append(p.path, t.turn) FROM turns t JOIN thread p ON p.conv_id = t.conv_id AND p.turn = t.parent
)
SELECT m.conv_id, m.turn, m.role, sha256(coalesce(b.clean, '')) AS clean_sha256, coalesce(b.n_quoted, 0) AS n_quoted,
  coalesce(t.parent, t.before) AS parent, t.parent IS NOT NULL AS quotes,
  row_number() OVER (PARTITION BY m.conv_id ORDER BY p.path NULLS FIRST, m.role NULLS FIRST, sha256(coalesce(b.clean, '')), coalesce(b.n_quoted, 0)) AS position
FROM msg m LEFT JOIN body b ON b.id = m.id
LEFT JOIN turns t ON t.conv_id = m.conv_id AND t.turn = m.turn
LEFT JOIN thread p ON p.conv_id = m.conv_id AND p.turn = m.turn
""",
}
