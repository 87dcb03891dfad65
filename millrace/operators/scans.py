"""Scans, projections, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import Tables, query

C = F.col
O_SPARK = ("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def point_lookup_int(t: Tables) -> DataFrame:
    return t.orders.where(C("o_orderkey") == 42).select(*O_SPARK)


@query("SELECT c_custkey, c_nationkey, c_name FROM customer WHERE 'Customer#000000007' = c_name OR c_custkey = 11")
def point_lookup_str(t: Tables) -> DataFrame:
    return t.customer.where((F.lit("Customer#000000007") == C("c_name")) | (C("c_custkey") == 11)).select("c_custkey", "c_nationkey", "c_name")


@query("SELECT o_totalprice, o_custkey, o_orderkey FROM orders")
def project_reorder(t: Tables) -> DataFrame:
    return t.orders.select("o_totalprice", "o_custkey", "o_orderkey")


@query("SELECT * FROM nation")
def project_star(t: Tables) -> DataFrame:
    return t.nation


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND 300000 > o_totalprice")
def filter_lt_gt(t: Tables) -> DataFrame:
    return t.orders.where((C("o_totalprice") > 1000) & (C("o_totalprice") < 300000)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 12")
def filter_le_ge(t: Tables) -> DataFrame:
    return t.part.where((C("p_size") >= 10) & (C("p_size") <= 12)).select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def filter_ne(t: Tables) -> DataFrame:
    return t.orders.where(C("o_orderstatus") != "F").select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey FROM part WHERE NOT (p_size < 20 OR p_brand = 'Brand#1') AND (p_retailprice > 1000 OR p_size = 25)")
def filter_and_or_not(t: Tables) -> DataFrame:
    return t.part.where(~((C("p_size") < 20) | (C("p_brand") == "Brand#1")) & ((C("p_retailprice") > 1000) | (C("p_size") == 25))).select("p_partkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 5, 99)")
def filter_in(t: Tables) -> DataFrame:
    return t.nation.where(C("n_nationkey").isin(1, 3, 5, 99)).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (1, 3, 5)")
def filter_not_in(t: Tables) -> DataFrame:
    return t.nation.where(~C("n_nationkey").isin(1, 3, 5)).select("n_nationkey", "n_name")


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS b, ('z' < 'é')::BOOLEAN AS bytewise FROM customer WHERE (c_acctbal > 0) = true AND (c_mktsegment = 'BUILDING') = (c_nationkey > 10)")
def boolean_equality(t: Tables) -> DataFrame:
    """Booleans compared with each other, and text by its bytes."""
    b = C("c_mktsegment") == "BUILDING"
    return t.customer.where(((C("c_acctbal") > 0) == F.lit(True)) & (b == (C("c_nationkey") > 10))).select("c_custkey", b.alias("b"), (F.lit("z") < F.lit("é")).alias("bytewise"))


@query("SELECT n_nationkey FROM nation WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey < 0)")
def filter_in_empty(t: Tables) -> DataFrame:
    return t.nation.join(t.nation.where("n_nationkey < 0").select("n_name"), "n_name", "left_semi").select("n_nationkey")


_NULLS = "SELECT c_custkey, nullif(c_nationkey % 3, 0) AS k, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer"


@query(f"SELECT c_custkey, k FROM ({_NULLS}) WHERE k IS NULL OR seg IS NULL")
def filter_null(t: Tables) -> DataFrame:
    x = t.customer.selectExpr("c_custkey", "nullif(c_nationkey % 3, 0) k", "nullif(c_mktsegment, 'BUILDING') seg")
    return x.where(C("k").isNull() | C("seg").isNull()).select("c_custkey", "k")


@query(f"SELECT c_custkey, k, seg FROM ({_NULLS}) WHERE k IS NOT NULL AND NOT (k = 1)")
def filter_not_null(t: Tables) -> DataFrame:
    x = t.customer.selectExpr("c_custkey", "nullif(c_nationkey % 3, 0) k", "nullif(c_mktsegment, 'BUILDING') seg")
    return x.where(C("k").isNotNull() & ~(C("k") == 1))


@query(f"SELECT c_custkey FROM ({_NULLS}) WHERE k IS NOT DISTINCT FROM NULL AND seg IS DISTINCT FROM 'MACHINERY'")
def filter_distinct_from(t: Tables) -> DataFrame:
    x = t.customer.selectExpr("c_custkey", "nullif(c_nationkey % 3, 0) k", "nullif(c_mktsegment, 'BUILDING') seg")
    return x.where(C("k").eqNullSafe(None) & ~C("seg").eqNullSafe("MACHINERY")).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31' AND o_totalprice BETWEEN 1000 AND 200000")
def between(t: Tables) -> DataFrame:
    return t.orders.where(C("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-03-31").cast("timestamp_ntz")) & C("o_totalprice").between(1000, 200000)).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' AND p_brand LIKE 'Brand#_'")
def like(t: Tables) -> DataFrame:
    return t.part.where(C("p_name").like("%a%e%") & C("p_brand").like("Brand#_")).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%ING' AND c_name NOT ILIKE '%9'")
def ilike(t: Tables) -> DataFrame:
    return t.customer.where(C("c_mktsegment").ilike("b%ING") & ~C("c_name").ilike("%9")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0[1-4]7$')")
def regex(t: Tables) -> DataFrame:
    return t.customer.where(C("c_name").rlike("0[1-4]7$")).select("c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
def case_when(t: Tables) -> DataFrame:
    band = F.when(C("o_totalprice") < 50000, "low").when(C("o_totalprice") < 200000, "mid").otherwise("high")
    return t.orders.select("o_orderkey", band.alias("band"), F.when(C("o_orderstatus") == "F", 1).when(C("o_orderstatus") == "O", 2).alias("code"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, TRY_CAST(p_brand AS INTEGER) AS none, CAST(trunc(p_retailprice) AS BIGINT) AS whole, p_partkey + 1 AS next FROM part")
def cast_try_cast(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", C("p_size").cast("string").alias("size_text"), C("p_brand").try_cast("int").alias("none"), C("p_retailprice").cast("long").alias("whole"), (C("p_partkey") + 1).alias("next"))


@query("SELECT 1 AS one, 'a' AS a")
def select_literal(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(1).alias("one"), F.lit("a").alias("a"))


@query("SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(k, name)")
def values_rows(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, name string")


@query("SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_nationkey % 5, 0) AS k FROM customer) ORDER BY k DESC NULLS LAST, c_custkey LIMIT 300")
def order_multi_nulls(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey", "nullif(c_nationkey % 5, 0) k").orderBy(C("k").desc_nulls_last(), "c_custkey").limit(300)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 35")
def limit_offset(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").offset(35).limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(C("o_totalprice").desc(), "o_orderkey").limit(10)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(C("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(C("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 5000")
def intersect(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 0").select(C("c_nationkey").alias("k")).intersect(t.supplier.where("s_acctbal < 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t: Tables) -> DataFrame:
    return t.customer.select(C("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def except_(t: Tables) -> DataFrame:
    return t.nation.select(C("n_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal > 3000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t: Tables) -> DataFrame:
    return t.customer.select(C("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS nk, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_nationkey, s_name, s_acctbal FROM supplier")
def union_by_name(t: Tables) -> DataFrame:
    a = t.customer.select(C("c_name").alias("name"), C("c_nationkey").alias("nk"))
    return a.unionByName(t.supplier.select(C("s_acctbal").alias("bal"), C("s_nationkey").alias("nk"), C("s_name").alias("name")), allowMissingColumns=True).select("nk", "name", "bal")
