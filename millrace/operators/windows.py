"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.registry import Tables, query

C = F.col


def by():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def row_number(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.row_number().over(by()).cast("long").alias("rn"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part")
def rank_dense(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"))


@query("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q FROM customer")
def ntile(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.ntile(4).over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")).cast("long").alias("q"))


@query("SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS cd FROM part")
def percent_cume(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_orderkey, 2, -1) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_lead(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(by()).alias("prev"), F.lead("o_orderkey", 2, -1).over(by()).alias("next2"))


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def first_last_nth(t: Tables) -> DataFrame:
    w = by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.first("o_orderkey").over(w).alias("f"), F.last("o_orderkey").over(w).alias("l"), F.nth_value("o_orderkey", 2).over(w).alias("n2"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM events")
def ignore_nulls(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(F.when(C("event_type") == "click", C("event_id")), ignorenulls=True).over(w).alias("c"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, count(*) OVER w AS n, max(o_totalprice) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_sum_rows(t: Tables) -> DataFrame:
    w = by().rowsBetween(Window.unboundedPreceding, 0)
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("s"), F.count("*").over(w).alias("n"), F.max("o_totalprice").over(w).alias("m"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a FROM orders")
def moving_avg_rows(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.avg("o_totalprice").over(by().rowsBetween(-2, 1)), 4).alias("a"))


@query("SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS BIGINT) AS s FROM part")
def range_frame(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.sum("p_size").over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 3)).alias("s"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def groups_frame(t: Tables) -> DataFrame:
    """A frame of peer groups: a range frame over the dense rank."""
    ranked = t.part.withColumn("dr", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")))
    return ranked.select("p_partkey", F.count("*").over(Window.partitionBy("p_brand").orderBy("dr").rangeBetween(-1, 1)).alias("n"))


@query("SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s FROM part")
def exclude_frame(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(-2, 2)
    others = F.when(F.count("*").over(w) > 1, F.sum("p_size").over(w) - C("p_size"))
    return t.part.select("p_partkey", others.alias("s"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def topn_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(C("o_totalprice").desc(), "o_orderkey")
    return t.orders.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey")


@query("SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS share FROM supplier")
def share_of_total(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.round(C("s_acctbal") / F.sum("s_acctbal").over(Window.partitionBy("s_nationkey")), 6).alias("share"))
