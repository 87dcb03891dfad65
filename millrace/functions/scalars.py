"""Scalar functions by family, in the names Spark has or as rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import Tables, query

C = F.col


@query("SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal)::BIGINT AS c, floor(s_acctbal)::BIGINT AS f, round(sqrt(abs(s_acctbal)), 6) AS sq, round(cbrt(s_acctbal), 6) AS cb, round(exp(s_suppkey % 5), 6) AS e, round(ln(s_suppkey + 1), 6) AS l, round(log2(s_suppkey + 1), 6) AS l2, round(log10(s_suppkey + 1), 6) AS l10, round(pow(s_suppkey % 7, 3), 4) AS p, sign(s_acctbal)::INT AS sg, greatest(s_suppkey, 50) AS g, least(s_suppkey, 50) AS le, round(atan2(s_acctbal, 100), 6) AS at, round(degrees(1.5) + radians(90.0) + pi(), 6) AS ang, factorial(5)::BIGINT AS fa, s_suppkey // 7 AS dv, s_suppkey % 7 AS md FROM supplier")
def math_fns(t: Tables) -> DataFrame:
    k, b = C("s_suppkey"), C("s_acctbal")
    return t.supplier.select("s_suppkey", F.abs(b).alias("a"), F.ceil(b).alias("c"), F.floor(b).alias("f"), F.round(F.sqrt(F.abs(b)), 6).alias("sq"), F.round(F.cbrt(b), 6).alias("cb"), F.round(F.exp(k % 5), 6).alias("e"), F.round(F.ln(k + 1), 6).alias("l"), F.round(F.log2(k + 1), 6).alias("l2"), F.round(F.log10(k + 1), 6).alias("l10"), F.round(F.pow(k % 7, F.lit(3)), 4).alias("p"), F.signum(b).cast("int").alias("sg"), F.greatest(k, F.lit(50)).alias("g"), F.least(k, F.lit(50)).alias("le"), F.round(F.atan2(b, F.lit(100)), 6).alias("at"), F.round(F.degrees(F.lit(1.5)) + F.radians(F.lit(90.0)) + F.pi(), 6).alias("ang"), F.factorial(F.lit(5)).alias("fa"), F.expr("s_suppkey div 7").alias("dv"), (k % 7).alias("md"))


@query("SELECT c_custkey, length(c_name) AS n, lower(c_name) AS lo, upper(c_mktsegment) AS up, trim('  ' || c_name || ' ') AS tr, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '-') AS rp, left(c_name, 4) AS le, right(c_name, 3) AS ri, substring(c_name, 3, 4) AS su, replace(c_name, '0', 'o') AS re, reverse(c_mktsegment) AS rv, repeat(left(c_name, 1), 3) AS rt, translate(c_mktsegment, 'AEI', 'aei') AS tl, split_part(c_name, '#', 2) AS sp, concat_ws('/', c_mktsegment, NULL, c_custkey::VARCHAR) AS cw, strpos(c_name, '#') AS po, ascii(c_name) AS asc_, chr(65) AS ch, levenshtein(c_mktsegment, 'BUILDING') AS lv, contains(c_name, '7') AS ct, starts_with(c_name, 'Cust') AS sw FROM customer")
def string_fns(t: Tables) -> DataFrame:
    n, m = C("c_name"), C("c_mktsegment")
    return t.customer.select("c_custkey", F.length(n).cast("long").alias("n"), F.lower(n).alias("lo"), F.upper(m).alias("up"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tr"), F.lpad(m, 12, "*").alias("lp"), F.rpad(m, 12, "-").alias("rp"), F.left(n, F.lit(4)).alias("le"), F.right(n, F.lit(3)).alias("ri"), F.substring(n, 3, 4).alias("su"), F.replace(n, F.lit("0"), F.lit("o")).alias("re"), F.reverse(m).alias("rv"), F.repeat(F.left(n, F.lit(1)), 3).alias("rt"), F.translate(m, "AEI", "aei").alias("tl"), F.split_part(n, F.lit("#"), F.lit(2)).alias("sp"), F.concat_ws("/", m, F.lit(None), C("c_custkey").cast("string")).alias("cw"), F.instr(n, "#").cast("long").alias("po"), F.ascii(n).alias("asc_"), F.char(F.lit(65)).alias("ch"), F.levenshtein(m, F.lit("BUILDING")).cast("long").alias("lv"), F.contains(n, F.lit("7")).alias("ct"), F.startswith(n, F.lit("Cust")).alias("sw"))


@query("SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', 'N') AS rr, regexp_extract(p_brand, '([A-Z])[a-z]+#([0-9]+)', 2) AS rx, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS n, regexp_matches(p_type, '^[A-Z]') AS ok FROM part")
def regex_fns(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.regexp_replace("p_brand", "[0-9]+", "N").alias("rr"), F.regexp_extract("p_brand", "([A-Z])[a-z]+#([0-9]+)", 2).alias("rx"), F.regexp_count("p_name", F.lit("[aeiou]")).alias("n"), F.regexp_like("p_type", F.lit("^[A-Z]")).alias("ok"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS mo, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, quarter(o_orderdate)::INT AS q, dayofyear(o_orderdate)::INT AS dy, strftime(o_orderdate, '%Y/%m') AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS dd, last_day(o_orderdate) AS ld, make_date(1999, 1, 2) AS md, epoch(o_orderdate)::BIGINT AS ep, o_orderdate + INTERVAL 1 MONTH AS nm FROM orders")
def date_fns(t: Tables) -> DataFrame:
    d = C("o_orderdate")
    return t.orders.select("o_orderkey", F.date_trunc("month", d).cast("timestamp_ntz").alias("mo"), F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.quarter(d).alias("q"), F.dayofyear(d).alias("dy"), F.date_format(d, "yyyy/MM").alias("s"), F.datediff(d, F.lit("1992-01-01").cast("date")).alias("dd"), F.last_day(d).alias("ld"), F.make_date(F.lit(1999), F.lit(1), F.lit(2)).alias("md"), F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01', o_orderdate)").alias("ep"), F.expr("o_orderdate + INTERVAL 1 MONTH").alias("nm"))


@query("SELECT vec_id, len(embedding)::INT AS n, list_max(embedding[1:4])::DOUBLE AS mx, list_min(embedding[1:4])::DOUBLE AS mn, list_contains([1, 2, label], 2) AS ct, list_position([5, label, 7], 7)::BIGINT AS ps, len(list_distinct([1, label, label]))::INT AS di, array_to_string([label, label + 1], '|') AS js, list_sort([3, label, 1])[1]::INT AS so, len(list_concat([label], [1, 2]))::INT AS cc, len(flatten([[1], [label, 2]]))::INT AS fl, list_sum(list_transform(range(1, 4), lambda x: x * label))::BIGINT AS tf FROM embeddings")
def array_fns(t: Tables) -> DataFrame:
    e, lab = C("embedding"), C("label")
    two = F.array(F.lit(1), F.lit(2))
    return t.embeddings.select("vec_id", F.size(e).alias("n"), F.array_max(F.slice(e, 1, 4)).cast("double").alias("mx"), F.array_min(F.slice(e, 1, 4)).cast("double").alias("mn"), F.array_contains(F.array(F.lit(1), F.lit(2), lab), 2).alias("ct"), F.array_position(F.array(F.lit(5), lab, F.lit(7)), 7).alias("ps"), F.size(F.array_distinct(F.array(F.lit(1), lab, lab))).alias("di"), F.array_join(F.array(lab.cast("string"), (lab + 1).cast("string")), "|").alias("js"), F.element_at(F.array_sort(F.array(F.lit(3), lab, F.lit(1))), 1).alias("so"), F.size(F.concat(F.array(lab), two)).alias("cc"), F.size(F.flatten(F.array(F.array(F.lit(1)), F.array(lab, F.lit(2))))).alias("fl"), F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda x: (x * lab).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("tf"))


@query("SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS part FROM nation")
def unnest(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.explode(F.split("n_name", "A")).alias("part"))


@query("SELECT n_nationkey, map(['k', 'r'], [n_nationkey, n_regionkey])['r'] AS r, cardinality(map(['k', 'r'], [n_nationkey, n_regionkey]))::INT AS n, {'a': n_name, 'b': n_regionkey}.a AS sa FROM nation")
def map_struct_fns(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("k"), C("n_nationkey"), F.lit("r"), C("n_regionkey"))
    return t.nation.select("n_nationkey", F.element_at(m, "r").alias("r"), F.size(F.map_keys(m)).alias("n"), F.struct(C("n_name").alias("a"), C("n_regionkey").alias("b"))["a"].alias("sa"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k')::BIGINT + 1 AS k1, json_extract_string(props, '$.missing') AS none FROM events")
def json_extract(t: Tables) -> DataFrame:
    p = F.from_json("props", "k long")
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), (p["k"] + 1).alias("k1"), F.get_json_object("props", "$.missing").alias("none"))


@query("SELECT event_id, json_array_length('[1, 2, {\"a\": [3]}]') ::BIGINT AS n, json_extract_string('{\"a\": {\"b\": [7, 8]}}', '$.a.b[1]') AS nested, to_json({'e': event_type, 'u': user_id})::VARCHAR AS j FROM events")
def json_more(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.json_array_length(F.lit('[1, 2, {"a": [3]}]')).cast("long").alias("n"), F.get_json_object(F.lit('{"a": {"b": [7, 8]}}'), "$.a.b[1]").alias("nested"), F.to_json(F.struct(C("event_type").alias("e"), C("user_id").alias("u"))).alias("j"))


@query("SELECT s_suppkey, sha1(s_name) AS s1, decode(encode(s_name)) AS d, decode(from_base64(base64(encode(s_name)))) AS b, length(uuid()::VARCHAR)::INT AS u FROM supplier")
def hash_more(t: Tables) -> DataFrame:
    n = C("s_name")
    return t.supplier.select("s_suppkey", F.sha1(n).alias("s1"), F.decode(F.encode(n, "UTF-8"), "UTF-8").alias("d"), F.unbase64(F.base64(n.cast("binary"))).cast("string").alias("b"), F.length(F.uuid()).alias("u"))


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(encode(c_name))) AS h, base64(encode(c_name)) AS b FROM customer")
def hash_fns(t: Tables) -> DataFrame:
    n = C("c_name")
    return t.customer.select("c_custkey", F.md5(n.cast("binary")).alias("m"), F.sha2(n, 256).alias("s"), F.lower(F.hex(n)).alias("h"), F.base64(n.cast("binary")).alias("b"))


@query("SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS c, ifnull(nullif(c_mktsegment, 'BUILDING'), 'none') AS i, CASE WHEN nullif(c_nationkey, 3) IS NULL THEN 'n' ELSE 'v' END AS v2, if(c_acctbal > 0, 1, 0) AS pos FROM customer")
def conditional_fns(t: Tables) -> DataFrame:
    k = F.nullif("c_nationkey", F.lit(3))
    return t.customer.select("c_custkey", F.coalesce(k, F.lit(-1)).alias("c"), F.ifnull(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("i"), F.nvl2(k, F.lit("v"), F.lit("n")).alias("v2"), F.when(C("c_acctbal") > 0, 1).otherwise(0).alias("pos"))


@query("SELECT s_suppkey, s_suppkey & 12 AS a, s_suppkey | 3 AS o, xor(s_suppkey, 5) AS x, s_suppkey << 2 AS l, s_suppkey >> 1 AS r, bit_count(s_suppkey)::INT AS b FROM supplier")
def bit_fns(t: Tables) -> DataFrame:
    k = C("s_suppkey")
    return t.supplier.select("s_suppkey", k.bitwiseAND(12).alias("a"), k.bitwiseOR(3).alias("o"), k.bitwiseXOR(5).alias("x"), F.shiftleft(k, 2).alias("l"), F.shiftright(k, 1).alias("r"), F.bit_count(k).alias("b"))
