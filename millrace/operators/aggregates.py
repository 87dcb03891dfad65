"""Aggregates and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.registry import Tables, query

C = F.col


def r(c, n: int = 4):
    return F.round(c, n)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS avg_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_by(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("avg_qty"), r(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT count(*) AS n, count(nullif(c_nationkey, 3)) AS k, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS debt FROM customer")
def count_star(t: Tables) -> DataFrame:
    return t.customer.agg(F.count("*").alias("n"), F.count(F.expr("nullif(c_nationkey, 3)")).alias("k"), F.count(F.when(C("c_acctbal") < 0, 1)).alias("debt"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, max(o_totalprice) AS m FROM orders WHERE o_orderkey < 0")
def global_empty(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey < 0").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"), F.max("o_totalprice").alias("m"))


@query("SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS s, round(avg(o_totalprice), 4) AS a, min(o_orderdate) AS lo, max(o_orderpriority) AS hi FROM orders GROUP BY o_orderstatus")
def sum_avg_min_max(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.sum("o_custkey").alias("s"), r(F.avg("o_totalprice")).alias("a"), F.min("o_orderdate").alias("lo"), F.max("o_orderpriority").alias("hi"))


@query("SELECT l_returnflag, round(stddev(l_quantity), 4) AS sd, round(stddev_pop(l_quantity), 4) AS sdp, round(stddev_samp(l_quantity), 4) AS sds, round(variance(l_quantity), 4) AS v, round(var_pop(l_quantity), 4) AS vp, round(var_samp(l_quantity), 4) AS vs FROM lineitem GROUP BY l_returnflag")
def stddev_var_all(t: Tables) -> DataFrame:
    q = "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(r(F.stddev(q)).alias("sd"), r(F.stddev_pop(q)).alias("sdp"), r(F.stddev_samp(q)).alias("sds"), r(F.variance(q)).alias("v"), r(F.var_pop(q)).alias("vp"), r(F.var_samp(q)).alias("vs"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, CAST(sum(DISTINCT user_id) AS BIGINT) AS s FROM events GROUP BY event_type")
def count_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.sum_distinct("user_id").alias("s"))


@query("SELECT l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS q, CAST(count(*) AS BIGINT) + 1 AS n1, CASE WHEN max(l_tax) > 0.05 THEN 'y' ELSE 'n' END AS taxed FROM lineitem GROUP BY l_linenumber")
def group_by_cast_agg(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linenumber").agg(F.sum("l_quantity").cast("long").alias("q"), (F.count("*") + 1).alias("n1"), F.when(F.max("l_tax") > 0.05, "y").otherwise("n").alias("taxed"))


@query("SELECT c_mktsegment, c_nationkey FROM customer GROUP BY 1, 2")
def group_without_agg(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT c_mktsegment, c_nationkey FROM {c} GROUP BY 1, 2", c=t.customer)


@query("SELECT p_size % 7 AS k, count(*) AS n FROM part GROUP BY p_size % 7")
def group_by_expr(t: Tables) -> DataFrame:
    return t.part.groupBy((C("p_size") % 7).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_all(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {o} GROUP BY ALL", o=t.orders)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 8")
def having(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 8")


@query("SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linenumber").distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t: Tables) -> DataFrame:
    first = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct(-C("o_totalprice"), "o_orderkey")).alias("f")
    return t.orders.groupBy("o_custkey").agg(first).select("o_custkey", "f.*")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::BIGINT AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
def grouping_sets(t: Tables) -> DataFrame:
    return t.orders.groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("long").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup(t: Tables) -> DataFrame:
    return t.nation.join(t.region, C("n_regionkey") == C("r_regionkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(sum(value) FILTER (WHERE user_id < 20), 4) AS few FROM events GROUP BY event_type")
def agg_filter(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_if(C("value") > 50).alias("high"), r(F.sum(F.when(C("user_id") < 20, C("value")))).alias("few"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_nationkey::VARCHAR, '-' ORDER BY n_nationkey DESC) AS keys FROM nation GROUP BY n_regionkey")
def string_agg_ordered(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.array_join(F.transform(F.sort_array(F.collect_list("n_nationkey"), asc=False), lambda x: x.cast("string")), "-").alias("keys"))


#: Groups of up to so many values are put in order as they are.
SMALL_GROUP = 100_000
#: Share of a group's rows that a bracket reaches to either side; the sketch errs by a quarter of it at most.
BRACKET = 4e-4


def exact_percentiles(df: DataFrame, by: str, wanted: dict[str, tuple[str, float, bool]]) -> DataFrame:
    """Exact percentiles of each group: name -> (column, share, whether to interpolate between neighbours). Nulls don't count; a group of nulls has null.

    A sketch of bounded size brackets each percentile of a large group; rows below a bracket are only counted, and of the few inside distinct values with
    their counts are put in order. Two passes, both aggregated before the shuffle; no task holds a large group's values.
    """
    shares = {name: [max(0.0, share - BRACKET), min(1.0, share + BRACKET)] for name, (_, share, _) in wanted.items()}
    sketch = df.groupBy(C(by).alias("_k")).agg(*(F.struct(F.count(c).alias("n"), F.percentile_approx(C(c).cast("double"), shares[name], 10_000).alias("e")).alias(name) for name, (c, _, _) in wanted.items()))
    parts = []
    for name, (_, share, between) in wanted.items():
        n = C(f"{name}.n")
        place = (n - 1) * F.lit(float(share)) if between else F.ceil(n * F.lit(float(share))) - 1.0
        large = n > SMALL_GROUP
        parts.append(F.struct(F.lit(name).alias("_w"), F.greatest(place, F.lit(0.0)).alias("_p"), F.when(large, C(f"{name}.e")[0]).alias("_low"), F.when(large, C(f"{name}.e")[1]).alias("_high")))
    edges = sketch.select(C("_k").alias("_ek"), F.inline(F.array(*parts)).alias("_ew", "_p", "_low", "_high"))
    values = F.array(*(F.struct(F.lit(name).alias("_w"), C(c).cast("double").alias("_x")) for name, (c, _, _) in wanted.items()))
    x = df.select(C(by).alias("_k"), F.inline(values).alias("_w", "_x")).where("_x IS NOT NULL")
    inside = x.join(edges, F.expr("_k <=> _ek AND _w = _ew")).where("_high IS NULL OR _x <= _high")
    slot = F.when(C("_low").isNull() | (C("_x") >= C("_low")), C("_x"))  # null: below the bracket
    counted = inside.groupBy("_k", "_w", "_p", slot.alias("_x")).agg(F.count("*").alias("_c"))
    end = F.sum("_c").over(Window.partitionBy("_k", "_w").orderBy(C("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    at = counted.withColumn("_end", end).groupBy("_k", "_w", "_p").agg(F.min(F.when(C("_end") > F.floor("_p"), C("_x"))).alias("_a"), F.min(F.when(C("_end") > F.ceil("_p"), C("_x"))).alias("_b"))
    value = F.when(C("_p") == F.floor("_p"), C("_a")).otherwise(C("_a") + (C("_b") - C("_a")) * (C("_p") - F.floor("_p")))
    found = at.groupBy(C("_k").alias("_own")).agg(*(F.max(F.when(C("_w") == name, value)).alias(f"_v_{name}") for name in wanted))
    return sketch.select("_k").join(found, F.expr("_k <=> _own"), "left").select(C("_k").alias(by), *(C(f"_v_{name}").alias(name) for name in wanted))


@query("SELECT l_returnflag, median(l_quantity) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, quantile_disc(l_quantity, 0.25) AS q1 FROM lineitem GROUP BY l_returnflag")
def median_percentile(t: Tables) -> DataFrame:
    wanted = {"med": ("l_quantity", 0.5, True), "p90": ("l_extendedprice", 0.9, True), "q1": ("l_quantity", 0.25, False)}
    return exact_percentiles(t.lineitem, "l_returnflag", wanted).select("l_returnflag", "med", r(C("p90")).alias("p90"), "q1")


@query("SELECT k, v FROM (SELECT l_returnflag AS k, l_linenumber AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1")
def mode_value(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(C("l_returnflag").alias("k"), C("l_linenumber").alias("v")).agg(F.count("*").alias("n"))
    return n.groupBy("k").agg(F.max_by("v", F.struct("n", -C("v"))).alias("v"))


@query("SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 4) AS c, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem GROUP BY l_linestatus")
def corr_covar_regr(t: Tables) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_linestatus").agg(r(F.corr(x, y)).alias("c"), r(F.covar_pop(x, y), 2).alias("cp"), r(F.covar_samp(x, y), 2).alias("cs"), r(F.regr_slope(y, x)).alias("slope"), r(F.regr_intercept(y, x), 2).alias("icpt"), r(F.regr_r2(y, x)).alias("r2"))


@query("SELECT p_brand, bool_and(p_size > 0) AS al, bool_or(p_size > 49) AS an, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx FROM part GROUP BY p_brand")
def bool_bit_aggs(t: Tables) -> DataFrame:
    s = C("p_size")
    return t.part.groupBy("p_brand").agg(F.bool_and(s > 0).alias("al"), F.bool_or(s > 49).alias("an"), F.bit_and(s).alias("ba"), F.bit_or(s).alias("bo"), F.bit_xor(s).alias("bx"))


@query("SELECT s_nationkey, arg_max(s_suppkey, s_acctbal) AS rich, arg_min(s_name, s_acctbal) AS poor FROM supplier GROUP BY s_nationkey")
def arg_max_min(t: Tables) -> DataFrame:
    return t.supplier.groupBy("s_nationkey").agg(F.max_by("s_suppkey", "s_acctbal").alias("rich"), F.min_by("s_name", "s_acctbal").alias("poor"))


@query("SELECT l_linestatus, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_linestatus")
def approx_distinct_small(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(F.approx_count_distinct("l_linenumber", 0.01).alias("n"))


@query("SELECT count(DISTINCT l_orderkey) AS exact, true AS near FROM lineitem")
def approx_distinct_error(t: Tables) -> DataFrame:
    """A test of tolerance: the sketch is within 5 % (five times its error) of the exact count, which the SQL gives; near has to be true."""
    x = t.lineitem.agg(F.count_distinct("l_orderkey").alias("exact"), F.approx_count_distinct("l_orderkey", 0.01).alias("a"))
    return x.select("exact", (F.abs(C("a") - C("exact")) <= 0.05 * C("exact")).alias("near"))


@query("SELECT l_returnflag, count(*) AS n, true AS near FROM lineitem GROUP BY l_returnflag")
def approx_percentile_rank(t: Tables) -> DataFrame:
    """A test of tolerance: the share of rows below the approximate median is within 2 % of a half; near has to be true. The sketch is of bounded size."""
    m = t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("m"))
    x = t.lineitem.join(F.broadcast(m), "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg((C("l_extendedprice") < C("m")).cast("double")).alias("below"))
    return x.select("l_returnflag", "n", (F.abs(C("below") - 0.5) < 0.02).alias("near"))


@query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS rn FROM events GROUP BY user_id) WHERE rn <= 5")
def frequent_items(t: Tables) -> DataFrame:
    """The most frequent values, counted exactly: partial counts by task, then the top five of them."""
    return t.events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(5)


@query("SELECT round(kurtosis_pop(l_quantity), 3) AS k, round(kurtosis(l_quantity), 3) AS ks FROM lineitem")
def kurtosis(t: Tables) -> DataFrame:
    """Excess kurtosis of the population, and corrected for a sample."""
    n, g = F.count("l_quantity").cast("double"), F.kurtosis("l_quantity")
    return t.lineitem.agg(r(g, 3).alias("k"), r((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6), 3).alias("ks"))


@query("SELECT l_linestatus, regr_count(l_tax, l_quantity)::BIGINT AS n, round(regr_avgx(l_tax, l_quantity), 4) AS ax, round(regr_avgy(l_tax, l_quantity), 6) AS ay, round(regr_sxx(l_tax, l_quantity) / count(*), 3) AS sxx, round(regr_syy(l_tax, l_quantity) / count(*), 6) AS syy, round(regr_sxy(l_tax, l_quantity) / count(*), 5) AS sxy FROM lineitem GROUP BY l_linestatus")
def regr_rest(t: Tables) -> DataFrame:
    y, x, n = "l_tax", "l_quantity", F.count("*")
    return t.lineitem.groupBy("l_linestatus").agg(F.regr_count(y, x).alias("n"), r(F.regr_avgx(y, x)).alias("ax"), r(F.regr_avgy(y, x), 6).alias("ay"), r(F.regr_sxx(y, x) / n, 3).alias("sxx"), r(F.regr_syy(y, x) / n, 6).alias("syy"), r(F.regr_sxy(y, x) / n, 5).alias("sxy"))


@query("SELECT round(skewness(l_quantity), 2) AS sk FROM lineitem")
def skewness(t: Tables) -> DataFrame:
    """The sample-corrected skewness."""
    n = F.count("l_quantity")
    return t.lineitem.agg(r(F.skewness("l_quantity") * F.sqrt(n * (n - 1)) / (n - 2), 2).alias("sk"))


@query("SELECT n_regionkey, any_value(r_name) AS any, first(n_name ORDER BY n_nationkey) AS f, last(n_name ORDER BY n_nationkey) AS l FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
def any_first_last(t: Tables) -> DataFrame:
    """Any value (a region has one name), and first and last by an order of their own."""
    x = t.nation.join(t.region, C("n_regionkey") == C("r_regionkey"))
    return x.groupBy("n_regionkey").agg(F.any_value("r_name").alias("any"), F.min_by("n_name", "n_nationkey").alias("f"), F.max_by("n_name", "n_nationkey").alias("l"))


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY l_returnflag")
def pivot(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(r(F.sum("l_quantity"), 2))
