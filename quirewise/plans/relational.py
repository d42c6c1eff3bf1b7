"""Relational primitives over the star schema: the joins, groupings, windows and set operations the other plans are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirewise.runtime import table


def join_left(s: SparkSession, d: str) -> DataFrame:
    c, o = table(s, d, "customer"), table(s, d, "orders")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


def join_semi(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").join(table(s, d, "lineitem").filter("l_returnflag = 'R'"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


def join_anti(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def join_full(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return a.join(b, "k", "full").fillna(0)


def group_rollup(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


def group_cube(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def window_rank(s: SparkSession, d: str) -> DataFrame:
    """Top three orders of each customer: a top-k report."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_custkey", "o_orderkey", "rn")


def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("max_price"))


def set_operations(s: SparkSession, d: str) -> DataFrame:
    a, b, c = (table(s, d, "orders").filter(f"o_orderpriority LIKE '{k}%'").select("o_custkey") for k in (1, 2, 3))
    return a.intersect(b).exceptAll(c.distinct()).distinct()


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of users: a gap of half an hour ends one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("new", F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > 1_800_000_000).cast("int"), F.lit(1)))
    return x.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


QUERIES = {f.__name__: f for f in (join_left, join_semi, join_anti, join_full, group_rollup, group_cube, window_rank, pricing_summary, set_operations, event_sessions)}
SQL = {
    "join_left": "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "join_semi": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_full": "SELECT k, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) USING (k)",
    "group_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "group_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "window_rank": "SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, count(*) AS n, max(l_extendedprice) AS max_price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "set_operations": "SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '2%' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '3%'",
    "event_sessions": "SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2",
}
