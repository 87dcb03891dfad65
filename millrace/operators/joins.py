"""Joins of every kind, as-of and range joins, and subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.registry import Tables, query

C = F.col


#: Types of times whose quantiles Spark can sketch; others aren't sliced.
SLICED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Slices of time at most.
SLICES = 32


def asof(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_time: str, right_time: str, op: str = ">=", tie: str | None = None) -> DataFrame:
    """Each left row (struct ``l``) with the right row (struct ``r``, null if none) of its key whose time is nearest among those for which left op right holds.

    Times are cut into slices of about as many right rows each, by a sketch of bounded size, and a key's rows of a slice are one group: a hot key
    is dealt over tasks. In a group both sides are one sorted run, without pairs; what earlier slices end with is carried over by one row for
    each key and slice. Null keys and times match nothing; of right rows of one time that with the greatest ``tie`` counts (any, without one).
    """
    forward, meets = op in (">=", ">"), op in (">=", "<=")
    names = [f"_k{i}" for i in range(len(keys))]
    tied = C(tie) if tie else F.lit(0)
    b = right.where(F.lit(True) if not keys else F.expr(" AND ".join(f"`{k}` IS NOT NULL" for _, k in keys))).where(C(right_time).isNotNull())
    b = b.select(F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("l"), F.struct("*").alias("r"), *(C(k).alias(n) for (_, k), n in zip(keys, names, strict=True)), C(right_time).alias("_t"), F.lit(0 if meets else 1).alias("_side"), tied.alias("_tie"))
    a = left.select(F.struct("*").alias("l"), F.lit(None).cast(b.schema["r"].dataType).alias("r"), *(C(k).alias(n) for (k, _), n in zip(keys, names, strict=True)), C(left_time).alias("_t"), F.lit(1 if meets else 0).alias("_side"), F.lit(None).cast(b.schema["_tie"].dataType).alias("_tie"))
    both = a.union(b)
    if isinstance(both.schema["_t"].dataType, SLICED):
        bounds = b.agg(F.percentile_approx("_t", [i / SLICES for i in range(1, SLICES)], 1000).alias("_bounds"))
        at = F.coalesce(bounds.scalar(), F.array().cast(bounds.schema["_bounds"].dataType))
        both = both.withColumn("_bounds", at).withColumn("_slice", F.size(F.filter("_bounds", lambda x: x <= C("_t")))).drop("_bounds")
    else:
        both = both.withColumn("_slice", F.lit(0))
    cell = [*names, "_slice"]
    order = [C("_t").asc_nulls_first() if forward else C("_t").desc_nulls_first(), C("_side"), C("_tie").asc_nulls_first()]
    run = Window.partitionBy(*cell).orderBy(*order)
    near = F.last("r", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0))
    runs = both.withColumn("_near", near).withColumn("_ends", F.lead(F.lit(True)).over(run).isNull())
    earlier = Window.partitionBy(*names).orderBy(C("_slice").asc() if forward else C("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.where("_ends").select(*cell, F.last("_near", ignorenulls=True).over(earlier).alias("_carried"))
    out = runs.where(C("l").isNotNull()).join(carried, cell, "left")
    return out.select("l", F.when(C("_t").isNotNull(), F.coalesce("_near", "_carried")).alias("r"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tie: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time (nulls if none); ``tie`` tells right rows of one time apart."""
    pairs = asof(left, right, [(k, k) for k in by], left_time, right_time, tie=tie)
    return pairs.select("l.*", *(C(f"r.{v}").alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, point: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Points with the ranges [low, high) that hold them, as an equi-join on buckets of a width instead of a nested loop."""
    p = points.withColumn("_bucket", F.floor(point / width))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    return p.join(r, "_bucket").where((point >= low) & (point < high)).drop("_bucket")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def inner_equi(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), C("o_custkey") == C("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
def left_outer(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 250000"), C("c_custkey") == C("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 8000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_outer(t: Tables) -> DataFrame:
    return t.supplier.where("s_acctbal > 8000").join(t.nation, C("s_nationkey") == C("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 8) b ON a.n_nationkey = b.n_nationkey")
def full_outer(t: Tables) -> DataFrame:
    a, b = t.nation.where("n_nationkey < 15").select(C("n_nationkey").alias("a")), t.nation.where("n_nationkey > 8").select(C("n_nationkey").alias("b"))
    return a.join(b, C("a") == C("b"), "full")


@query("SELECT r_name, n_name FROM region, nation")
def cross_small(t: Tables) -> DataFrame:
    return t.region.crossJoin(F.broadcast(t.nation)).select("r_name", "n_name")  # 5 by 25 rows at every scale


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 280000)")
def semi_exists(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 280000"), C("o_custkey") == C("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 60000)")
def anti_not_exists(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 60000"), C("o_custkey") == C("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def anti_not_in(t: Tables) -> DataFrame:
    few = t.supplier.where("s_acctbal > 5000").select("s_nationkey")
    return t.spark.sql("SELECT n_nationkey FROM {n} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {s})", n=t.nation, s=few)


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_join(t: Tables) -> DataFrame:
    a = t.nation.select(C("n_nationkey").alias("a"), C("n_regionkey").alias("ra"))
    b = t.nation.select(C("n_nationkey").alias("b"), C("n_regionkey").alias("rb"))
    return a.join(b, (C("ra") == C("rb")) & (C("a") < C("b"))).select("a", "b")


@query("SELECT o_orderkey, lo FROM orders JOIN (SELECT p_partkey * 4000.0::DOUBLE AS lo, p_partkey * 4000.0::DOUBLE + 2500 AS hi FROM part) ON o_totalprice >= lo AND o_totalprice < hi")
def range_join_buckets(t: Tables) -> DataFrame:
    ranges = t.part.selectExpr("p_partkey * 4000.0D lo", "p_partkey * 4000.0D + 2500 hi")
    return range_join(t.orders.select("o_orderkey", "o_totalprice"), ranges, C("o_totalprice"), C("lo"), C("hi"), 2500).select("o_orderkey", "lo")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey < b.s_suppkey")
def self_join(t: Tables) -> DataFrame:
    a, b = t.supplier.select("s_nationkey", C("s_suppkey").alias("a")), t.supplier.select("s_nationkey", C("s_suppkey").alias("b"))
    return a.join(b, "s_nationkey").where("a < b").select("a", "b")


@query("SELECT k, n, s FROM (SELECT n_nationkey AS k, n_name AS n FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_name AS s FROM supplier)")
def using_join(t: Tables) -> DataFrame:
    return t.nation.select(C("n_nationkey").alias("k"), C("n_name").alias("n")).join(t.supplier.select(C("s_nationkey").alias("k"), C("s_name").alias("s")), "k")


@query("SELECT r_name, p_brand, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE p_size < 20 GROUP BY r_name, p_brand")
def multiway_star(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, C("n_regionkey") == C("r_regionkey")).select("n_nationkey", "r_name")
    x = t.lineitem.join(t.part.where("p_size < 20"), C("l_partkey") == C("p_partkey"))  # what filters comes first
    x = x.join(t.orders, C("l_orderkey") == C("o_orderkey")).join(t.customer, C("o_custkey") == C("c_custkey")).join(places, C("c_nationkey") == C("n_nationkey"))
    return x.groupBy("r_name", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT p.event_id AS event_id, (SELECT c.event_id FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) AS click_id FROM events p WHERE p.event_type = 'purchase'")
def asof_last_click(t: Tables) -> DataFrame:
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'click'").select("user_id", C("ts").alias("click_ts"), C("event_id").alias("click_id"))
    return asof_join(left, right, ["user_id"], "ts", "click_ts", "click_id", ["click_id"]).select("event_id", "click_id")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)")
def scalar_subquery(t: Tables) -> DataFrame:
    return t.orders.crossJoin(F.broadcast(t.orders.agg(F.avg("o_totalprice").alias("m")))).where("o_totalprice > 1.5 * m").select("o_orderkey")  # one row


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_subquery(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT o_orderkey FROM {o} o WHERE o_totalprice = (SELECT max(o_totalprice) FROM {i} i WHERE i.o_custkey = o.o_custkey)", o=t.orders, i=t.orders)


@query("SELECT n_name, x.s_name AS s_name FROM nation, LATERAL (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) x")
def lateral_top1(t: Tables) -> DataFrame:
    best = t.supplier.groupBy("s_nationkey").agg(F.min_by("s_name", F.struct(-C("s_acctbal"), "s_suppkey")).alias("s_name"))
    return t.nation.join(best, C("s_nationkey") == C("n_nationkey")).select("n_name", "s_name")


@query("WITH a AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE total > 500000) SELECT c_name, round(total, 2) AS total FROM b JOIN customer ON o_custkey = c_custkey")
def cte_chain(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).where("total > 500000")
    return a.join(t.customer, C("o_custkey") == C("c_custkey")).select("c_name", F.round("total", 2).alias("total"))


@query("WITH RECURSIVE f(n, a, b) AS (SELECT 1, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT n, a FROM f")
def recursive_cte(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE f(n, a, b) AS (SELECT 1, 0L, 1L UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT n, a FROM f")
