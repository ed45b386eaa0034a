"""Named queries over a data folder, each with its SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.functions import discounted, exact, money, utc
from sparrowmill.operators import sessions, top_per_key
from sparrowmill.sources import table
from sparrowmill.streaming import session_windows, windowed_events


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and prices by return flag and line status."""
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("2001-06-30").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            money(F.sum(exact("l_quantity"))).alias("sum_qty"),
            money(F.sum(exact("l_extendedprice"))).alias("sum_base_price"),
            money(F.sum(discounted())).alias("sum_disc_price"),
            F.count("*").alias("n_lines"),
        )
    )


def revenue_by_nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted revenue by the customer's nation and the order's month. Lines
    are summed per order before the joins, so the wide side shuffles once."""
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(discounted()).alias("revenue"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        .agg(money(F.sum("revenue")).alias("revenue"), F.count("*").alias("n_orders"))
    )


def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per_key(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts and totals by segment and priority, with subtotals."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .rollup("c_mktsegment", "o_orderpriority")
        .agg(F.grouping_id().alias("level"), F.count("*").alias("n_orders"), money(F.sum(exact("o_totalprice"))).alias("total"))
    )


def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order in 2001."""
    recent = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return customer.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, split at pauses of over a day."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", utc("ts").alias("ts"))
    return (
        sessions(events, "user_id", "ts", "event_id", 86_400)
        .groupBy("user_id", "session")
        .agg(F.count("*").alias("n_events"), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))
    )


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value by day and type; the batch form of the stream."""
    return windowed_events(table(spark, sf_dir, "events"))


def sessions_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user by event time; the batch form of the stream."""
    return session_windows(table(spark, sf_dir, "events"), gap_seconds=86_400)


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each text that several have: their number and the first
    of them. Only digests and ids are shuffled, added up on both sides."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("text_sha256"), "doc_id")
    groups = docs.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs"))
    return groups.filter("n_docs > 1")


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the property ``k`` of their JSON text."""
    props = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").groupBy(props["k"].alias("k")).agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))


QUERIES = {f.__name__: f for f in (pricing_summary, revenue_by_nation_month, top_orders_per_customer, order_rollup, idle_customers, user_sessions, daily_events, sessions_by_window, exact_duplicates, event_properties)}

ORACLE_SQL = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, CAST(round(sum(CAST(l_quantity AS DECIMAL(18, 4))), 2) AS DOUBLE) AS sum_qty, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 4))), 2) AS DOUBLE) AS sum_base_price,
               CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))), 2) AS DOUBLE) AS sum_disc_price, count(*) AS n_lines
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-30' GROUP BY ALL""",
    "revenue_by_nation_month": """
        WITH o AS (SELECT l_orderkey, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS r FROM lineitem GROUP BY 1)
        SELECT n_name, strftime(o_orderdate, '%Y-%m') AS month, CAST(round(sum(r), 2) AS DOUBLE) AS revenue, count(*) AS n_orders
        FROM o JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "top_orders_per_customer": """
        SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
        FROM orders QUALIFY rank <= 3""",
    "order_rollup": """
        SELECT c_mktsegment, o_orderpriority, CAST(grouping(c_mktsegment, o_orderpriority) AS BIGINT) AS level, count(*) AS n_orders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 4))), 2) AS DOUBLE) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)""",
    "idle_customers": """
        SELECT c_custkey, c_name, c_mktsegment FROM customer
        WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')""",
    "user_sessions": """
        WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
        s AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 86400000000 THEN 1 ELSE 0 END)
                        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM p)
        SELECT user_id, session, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""",
    "daily_events": """
        SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n_events, CAST(round(sum(CAST(value AS DECIMAL(18, 4))), 2) AS DOUBLE) AS total_value FROM events GROUP BY 1, 2""",
    "sessions_by_window": """
        WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE ts IS NOT NULL),
        s AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 86400000000 THEN 1 ELSE 0 END)
                        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM p)
        SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events, CAST(round(sum(CAST(value AS DECIMAL(18, 4))), 2) AS DOUBLE) AS total_value
        FROM s GROUP BY user_id, session""",
    "exact_duplicates": """
        SELECT sha256(text) AS text_sha256, min(doc_id) AS first_id, count(*) AS n_docs FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "event_properties": """
        SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""",
}
