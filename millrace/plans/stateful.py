"""Queries through the engine itself: tables are made from the driver's, changed by SQL, and read back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.engine import Engine, TenantSession
from millrace.errors import AlreadyExists, CommitConflict, Denied, EngineError, InvalidLiteral, NotFound, TooMany
from millrace.functions.vectors import _query, search_many
from millrace.plans.registry import Tables, query
from millrace.plans.rest import as_json, rest_delete, rest_error, rest_insert, rest_select, rest_update
from millrace.sources.files import fresh_dir
from millrace.streaming.buffer import Writer
from millrace.tenancy import FirstOf, StaticResolver, TokenResolver, signed


def _session(t: Tables) -> TenantSession:
    return Engine(t.spark, fresh_dir(t.spark, "engine")).session("acme")


def _customers(t: Tables, parts: int = 4) -> TenantSession:
    """A session with table c: id, name, seg (null for BUILDING), bal; in files of disjoint ids."""
    s = Engine(t.spark, fresh_dir(t.spark, "engine")).session("acme")
    s.execute("CREATE TABLE c (id BIGINT NOT NULL, name TEXT NOT NULL, seg TEXT, bal DOUBLE)")
    rows = t.customer.selectExpr("c_custkey id", "c_name name", "nullif(c_mktsegment, 'BUILDING') seg", "c_acctbal bal")
    s.write("c", rows.repartitionByRange(parts, "id"))
    return s


_C = "(SELECT c_custkey AS id, c_name AS name, nullif(c_mktsegment, 'BUILDING') AS seg, c_acctbal AS bal FROM customer)"


@query(f"SELECT id, name, seg, bal FROM {_C}")
def insert_select_back(t: Tables) -> DataFrame:
    return _customers(t).execute("SELECT id, name, seg, bal FROM c")


@query("SELECT * FROM (VALUES (1::BIGINT, 'O''Brien', NULL, 1.5::DOUBLE), (2, 'b', 'x', NULL), (3, 'c', NULL, -2)) v(id, name, seg, bal)")
def insert_values(t: Tables) -> DataFrame:
    s = _customers(t, 1)
    s.execute("DELETE FROM c")
    s.execute("INSERT INTO c VALUES (1, 'O''Brien', NULL, 1.5), (2, 'b', 'x', NULL)")
    s.execute("INSERT INTO c (bal, name, id) VALUES (-2, 'c', 3)")
    return s.execute("SELECT * FROM c")


@query(f"SELECT id, seg FROM {_C} WHERE NOT coalesce(id < 50 OR seg = 'MACHINERY', false)")
def delete_where(t: Tables) -> DataFrame:
    s = _customers(t)
    s.execute("DELETE FROM c WHERE id < 50 OR seg = 'MACHINERY'")
    return s.execute("SELECT id, seg FROM c")


@query(f"SELECT id, seg FROM {_C} WHERE NOT coalesce(NOT (seg = 'MACHINERY') AND id <> 3, false)")
def delete_null_semantics(t: Tables) -> DataFrame:
    s = _customers(t)
    s.execute("DELETE FROM c WHERE NOT (seg = 'MACHINERY') AND id <> 3")
    return s.execute("SELECT id, seg FROM c")


@query(f"SELECT id, CASE WHEN id BETWEEN 100 AND 120 THEN 'patched' ELSE name END AS name, bal FROM {_C}")
def update_where(t: Tables) -> DataFrame:
    s = _customers(t)
    s.execute("UPDATE c SET name = 'patched' WHERE id BETWEEN 100 AND 120")
    return s.execute("SELECT id, name, bal FROM c")


@query(f"SELECT id, 'all' AS seg, 0.0::DOUBLE AS bal FROM {_C}")
def update_all(t: Tables) -> DataFrame:
    s = _customers(t)
    s.execute("UPDATE c SET seg = 'all', bal = 0")
    return s.execute("SELECT id, seg, bal FROM c")


@query(f"SELECT 1::BIGINT AS version, count(*) AS n FROM {_C} UNION ALL SELECT 2, count(*) FROM {_C} WHERE id >= 10")
def time_travel(t: Tables) -> DataFrame:
    s = _customers(t)
    s.execute("DELETE FROM c WHERE id < 10")
    a, b = s.table("c", version=1), s.table("c", version=2)
    return a.selectExpr("1L version", "count(*) n").union(b.selectExpr("2L version", "count(*) n"))


@query("SELECT 'other' AS who, 1::BIGINT AS n")
def tenant_isolation(t: Tables) -> DataFrame:
    s = _customers(t)
    other = s.engine.session("other")
    other.execute("CREATE TABLE c (id BIGINT)")
    other.execute("INSERT INTO c VALUES (7)")
    return other.execute("SELECT 'other' AS who, count(*) AS n FROM c")


@query(f"SELECT id, name FROM {_C} UNION ALL SELECT 900000 + i, 'tail-' || i FROM range(1, 4) r(i)")
def wal_tail_union(t: Tables) -> DataFrame:
    """Rows of the log are seen at once: two entries are compacted, one is still in the tail."""
    s = _customers(t)
    s.append_log("c", [{"id": 900001, "name": "tail-1"}])
    s.append_log("c", [{"id": 900002, "name": "tail-2"}])
    s.compact("c")
    s.append_log("c", [{"id": 900003, "name": "tail-3"}])
    return s.execute("SELECT id, name FROM c")


@query(f"SELECT count(*) AS n, count(DISTINCT id) AS d FROM (SELECT id FROM {_C} UNION ALL SELECT 900000 + i FROM range(1, 6) r(i))")
def foreachbatch_compaction(t: Tables) -> DataFrame:
    s = _customers(t)
    for i in range(1, 6):
        s.append_log("c", [{"id": 900000 + i, "name": f"tail-{i}"}])
    s.compact("c")
    s.compact("c")
    s._log("c").truncate()
    return s.execute("SELECT count(*) AS n, count(DISTINCT id) AS d FROM c")


@query(f"SELECT id, name FROM {_C} WHERE bal > 1000 AND seg = 'MACHINERY' ORDER BY id LIMIT 25")
def prepared_params(t: Tables) -> DataFrame:
    s = _customers(t)
    handle, _ = s.prepare("SELECT id, name FROM c WHERE bal > $1 AND seg = $2 ORDER BY id LIMIT $3")
    return s.execute_bound(s.bind(handle, [1000.0, "MACHINERY", 25]))


@query(f"SELECT id, seg FROM {_C} WHERE bal >= 500 AND seg IN ('MACHINERY', 'AUTOMOBILE') ORDER BY seg DESC NULLS LAST, id NULLS LAST LIMIT 20 OFFSET 10")
def rest_filter_order_page(t: Tables) -> DataFrame:
    return rest_select(_customers(t).table("c"), "select=id,seg&bal=gte.500&seg=in.(MACHINERY,AUTOMOBILE)&order=seg.desc,id&limit=20&offset=10")


@query("SELECT table_name FROM (VALUES ('c'), ('d')) v(table_name)")
def show_tables(t: Tables) -> DataFrame:
    s = _customers(t, 1)
    s.execute("CREATE TABLE IF NOT EXISTS d (v vector(3), b BYTEA)")
    return s.execute("SHOW TABLES")


@query(f"SELECT id, name, seg, bal FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY bal DESC, id) AS rn FROM {_C}) WHERE rn <= 2")
def qualify_sql(t: Tables) -> DataFrame:
    return _customers(t).execute("SELECT id, name, seg, bal FROM c QUALIFY row_number() OVER (PARTITION BY seg ORDER BY bal DESC, id) <= 2 ORDER BY id")


@query(f"SELECT DISTINCT ON (seg) seg, id, bal FROM {_C} ORDER BY seg, bal DESC, id")
def distinct_on_sql(t: Tables) -> DataFrame:
    return _customers(t).execute("SELECT DISTINCT ON (seg) seg, id, bal FROM c ORDER BY seg, bal DESC, id")


@query(f"SELECT id FROM {_C} ORDER BY bal DESC, id LIMIT 7")
def fetch_first_sql(t: Tables) -> DataFrame:
    return _customers(t).execute("SELECT id FROM c ORDER BY bal DESC, id FETCH FIRST 7 ROWS ONLY")


def _events(t: Tables) -> TenantSession:
    s = _session(t)
    s.execute("CREATE TABLE e (id BIGINT NOT NULL, who BIGINT, ts TIMESTAMP, kind TEXT, value DOUBLE)")
    s.execute("CREATE TABLE k (id BIGINT NOT NULL, who BIGINT, ts TIMESTAMP)")
    s.write("e", t.events.selectExpr("event_id id", "user_id who", "CAST(ts AS TIMESTAMP) ts", "event_type kind", "value"))
    s.write("k", t.events.where("event_type = 'click'").selectExpr("event_id id", "user_id who", "CAST(ts AS TIMESTAMP) ts").dropDuplicates(["who", "ts"]))
    return s


_K = "(SELECT min(event_id) AS id, user_id AS who, ts FROM events WHERE event_type = 'click' GROUP BY user_id, ts)"
_E = "(SELECT event_id AS id, user_id AS who, ts, event_type AS kind FROM events)"


@query(f"SELECT e.id AS id, epoch_us(e.ts) - epoch_us(k.ts) AS micros FROM {_E} e ASOF JOIN {_K} k ON e.who = k.who AND e.ts >= k.ts WHERE e.kind = 'purchase'")
def asof_join_sql(t: Tables) -> DataFrame:
    return _events(t).execute("SELECT e.id AS id, unix_micros(CAST(e.ts AS TIMESTAMP)) - unix_micros(CAST(k.ts AS TIMESTAMP)) AS micros FROM e ASOF JOIN k ON e.who = k.who AND e.ts >= k.ts WHERE e.kind = 'purchase'")


@query(f"SELECT e.id AS id, epoch_us(k.ts) - epoch_us(e.ts) AS micros FROM {_E} e ASOF LEFT JOIN {_K} k ON e.who = k.who AND k.ts > e.ts")
def asof_left_next_sql(t: Tables) -> DataFrame:
    """The next click after each event, if there is one."""
    return _events(t).execute("SELECT e.id AS id, unix_micros(CAST(k.ts AS TIMESTAMP)) - unix_micros(CAST(e.ts AS TIMESTAMP)) AS micros FROM e ASOF LEFT JOIN k ON e.who = k.who AND k.ts > e.ts")


_FRAMES = """SELECT id, count(*) OVER (PARTITION BY seg ORDER BY floor(bal / 100) GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n,
 max(id) OVER (PARTITION BY seg ORDER BY floor(bal / 100) GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM {} WHERE id > 7"""


@query(_FRAMES.format(_C))
def groups_frame_sql(t: Tables) -> DataFrame:
    return _customers(t).execute(_FRAMES.format("c"))


_EXCLUDE = """SELECT id, count(bal) OVER (PARTITION BY seg ORDER BY id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS n,
 round(sum(bal) OVER (PARTITION BY seg ORDER BY id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW), 2) AS s,
 round(avg(bal) OVER (ORDER BY id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING EXCLUDE CURRENT ROW), 2) AS a,
 min(bal) OVER (PARTITION BY seg ORDER BY floor(bal / 100) GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS g,
 max(bal) OVER (PARTITION BY seg ORDER BY floor(bal / 100) GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS t FROM {}"""


@query(_EXCLUDE.format(_C))
def exclude_frame_sql(t: Tables) -> DataFrame:
    return _customers(t).execute(_EXCLUDE.format("c"))


@query(f"SELECT id, name, true AS fewer_files FROM {_C} WHERE id BETWEEN 20 AND 24 OR id = 3")
def pruned_select(t: Tables) -> DataFrame:
    """Files that can't hold rows of the condition aren't read: fewer_files says so."""
    s = _customers(t)
    out = s.execute("SELECT id, name FROM c WHERE id BETWEEN 20 AND 24 OR id = 3")
    read, all_ = s.files_read["c"]
    return out.selectExpr("id", "name", f"{read} < {all_} fewer_files")


@query("SELECT * FROM (VALUES ('a', 'bigint'), ('b', 'bigint'), ('c', 'double'), ('d', 'string'), ('e', 'boolean'), ('f', 'binary'), ('g', 'array<float>')) v(name, type)")
def type_mapper(t: Tables) -> DataFrame:
    s = _session(t)
    s.execute("CREATE TABLE k (a BIGINT, b INT, c DOUBLE PRECISION, d VARCHAR, e BOOLEAN, f BYTEA, g vector(3))")
    return t.spark.createDataFrame(s.execute("SELECT * FROM k").dtypes, "name string, type string")


@query("SELECT * FROM (VALUES ('duplicate table', '42704'), ('no such table', '42704'), ('no such column', '42704'), ('null in NOT NULL', '42601'), ('text for a number', '42601'), ('two statements', '42601'), ('copy', '42601'), ('view', '42601'), ('alter', '42601'), ('returning', '42601'), ('read a file', '42704'), ('expression in SET', '42601'), ('old head', '40001')) v(what, code)")
def errors_by_code(t: Tables) -> DataFrame:
    """Each refused statement with the SQLSTATE of its error; the table stays as it was, else no row is given."""
    s = _session(t)
    s.execute("CREATE TABLE k (id BIGINT NOT NULL, x TEXT)")
    s.execute("INSERT INTO k VALUES (1, 'p')")
    tries = {
        "duplicate table": "CREATE TABLE k (id BIGINT)", "no such table": "SELECT * FROM nowhere", "no such column": "UPDATE k SET y = 1", "null in NOT NULL": "INSERT INTO k VALUES (NULL, 'q')",
        "text for a number": "INSERT INTO k VALUES ('1', 'q')", "two statements": "SELECT 1; SELECT 2", "copy": "COPY k FROM 'x.csv'", "view": "CREATE VIEW w AS SELECT 1", "alter": "ALTER TABLE k ADD COLUMN z INT",
        "returning": "DELETE FROM k WHERE id = 1 RETURNING id", "read a file": f"SELECT * FROM parquet.`{t.sf_dir}/nation.parquet`", "expression in SET": "UPDATE k SET id = id + 1",
    }
    got = []
    for what, sql in tries.items():
        try:
            s.execute(sql)
        except EngineError as e:
            got.append((what, e.sqlstate))
    try:
        s.catalog.append(s.tenant, "k", 0, [])
    except EngineError as e:
        got.append(("old head", e.sqlstate))
    return t.spark.createDataFrame(got if s.execute("SELECT * FROM k").collect() == [(1, "p")] else [], "what string, code string")


@query("SELECT * FROM (VALUES (1::BIGINT, 2.0::DOUBLE, '00FF', true, 'a''b'), (2, 'NaN'::DOUBLE, NULL, false, ''), (3, 'Infinity'::DOUBLE, '', NULL, NULL)) v(id, x, b, ok, s)")
def literal_coercion(t: Tables) -> DataFrame:
    """Whole numbers as doubles, byte strings, and values that have no literal as bound parameters."""
    s = _session(t)
    s.execute("CREATE TABLE k (id BIGINT NOT NULL, x DOUBLE, b BYTEA, ok BOOLEAN, s TEXT)")
    s.execute(r"INSERT INTO k VALUES (1, 2, '\x00ff', true, 'a''b')")
    handle, _ = s.prepare("INSERT INTO k VALUES ($1, $2, $3, $4, $5)")
    s.execute_bound(s.bind(handle, [2, float("nan"), None, False, ""]))
    s.execute_bound(s.bind(handle, [3, float("inf"), b"", None, None]))
    return s.execute("SELECT id, x, hex(b) AS b, ok, s FROM k")


@query(f"SELECT id + 1000000 AS id, upper(name) AS name FROM {_C} WHERE bal > 5000")
def insert_select_sql(t: Tables) -> DataFrame:
    s = _customers(t)
    s.execute("CREATE TABLE d (id BIGINT NOT NULL, name TEXT, more DOUBLE)")
    s.execute("INSERT INTO d (id, name) SELECT id + 1000000, upper(name) FROM c WHERE bal > 5000")
    return s.execute("SELECT id, name FROM d WHERE more IS NULL")


@query(f"SELECT * FROM (VALUES (0::BIGINT, 'genesis', 0::BIGINT), (1, 'append', (SELECT count(*) FROM {_C})), (2, 'replace', (SELECT count(*) FROM {_C} WHERE id > 9))) v(id, operation, rows)")
def snapshots_list(t: Tables) -> DataFrame:
    s = _customers(t)
    s.execute("DELETE FROM c WHERE id <= 9")
    return s.snapshots("c").select("id", "operation", "rows")


@query(f"SELECT 'left' AS what, count(*) AS n FROM {_C} WHERE id > 9 UNION ALL SELECT 'old snapshot', 0 UNION ALL SELECT 'dropped table', 0 UNION ALL SELECT 'tenants', 1")
def vacuum_and_drop(t: Tables) -> DataFrame:
    """After a vacuum the head is whole and older snapshots are gone; dropped tables and tenants are gone."""
    s = _customers(t)
    s.execute("DELETE FROM c WHERE id <= 9")
    s.vacuum("c")
    got = [("left", s.execute("SELECT * FROM c").count())]
    s.execute("CREATE TABLE d (id BIGINT)")
    s.drop_table("d")
    for what, read in (("old snapshot", lambda: s.table("c", version=1)), ("dropped table", lambda: s.execute("SELECT * FROM d"))):
        try:
            read()
            got.append((what, 1))
        except NotFound:
            got.append((what, 0))
    s.engine.create_namespace("brief")
    s.engine.drop_tenant("brief")
    got.append(("tenants", len(s.catalog.tenants())))
    return t.spark.createDataFrame(got, "what string, n long")


@query("SELECT * FROM (VALUES ('parameter', 1, 'double'), ('parameter', 2, 'string'), ('parameter', 3, 'bigint'), ('id', 1, 'bigint'), ('name', 2, 'string')) v(what, place, type)")
def prepared_describe(t: Tables) -> DataFrame:
    s = _customers(t, 1)
    _, d = s.prepare("SELECT id, name FROM c WHERE bal > $1 AND seg = $2 ORDER BY id LIMIT $3")
    rows = [("parameter", i, k) for i, k in enumerate(d["param_types"], 1)] + [(c, i, k) for i, (c, k) in enumerate(d["columns"], 1)]
    return t.spark.createDataFrame(rows, "what string, place int, type string")


@query(f"SELECT id, name, seg FROM (SELECT id, name, CASE WHEN id < 30 THEN 'rest' ELSE seg END AS seg FROM {_C} WHERE id >= 5 UNION ALL SELECT 900001, 'new', NULL)")
def rest_changes(t: Tables) -> DataFrame:
    s = _customers(t)
    rest_insert(s, "c", '{"id": 900001, "name": "new"}')
    rest_update(s, "c", "id=lt.30", '{"seg": "rest"}')
    rest_delete(s, "c", "id=lt.5")
    return s.execute("SELECT id, name, seg FROM c")


@query("SELECT * FROM (VALUES (404, '42704'), (409, '42704'), (400, '42601'), (409, '40001'), (500, 'XX000')) v(status, code)")
def rest_errors(t: Tables) -> DataFrame:
    errors = [NotFound("x"), AlreadyExists("x"), InvalidLiteral("x"), CommitConflict("x"), ValueError("secret")]
    told = [rest_error(e) for e in errors]
    return t.spark.createDataFrame([(status, body["code"]) for status, body in told if body["message"] != "secret"], "status int, code string")


@query(f"SELECT '{{\"id\":' || id || ',\"seg\":' || coalesce('\"' || seg || '\"', 'null') || '}}' AS json FROM {_C} WHERE id <= 40")
def json_rows(t: Tables) -> DataFrame:
    return as_json(_customers(t, 1).execute("SELECT id, seg FROM c WHERE id <= 40"))


@query(f"SELECT count(*) + 40 AS n, count(*) + 40 AS d FROM {_C}")
def concurrent_appends(t: Tables) -> DataFrame:
    """Four writers append to one head; those that lose the race commit onto the next one, and no row is lost."""
    s = _customers(t, 1)

    def work(k: int) -> None:
        own = s.engine.session(s.tenant)
        own.write("c", t.spark.range(10).selectExpr(f"id + {900000 + 10 * k} id", "'w' name"))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    return s.execute("SELECT count(*) AS n, count(DISTINCT id) AS d FROM c")


@query("SELECT * FROM (VALUES (2::BIGINT, 7::BIGINT, 'b'), (3, 8, 'c')) v(_lsn, id, name)")
def log_since(t: Tables) -> DataFrame:
    """Entries after a number, while the entries up to it were compacted and truncated; the high-water mark is the last number."""
    s = _session(t)
    s.execute("CREATE TABLE k (id BIGINT NOT NULL, name TEXT)")
    for i, name in enumerate("abc"):
        s.append_log("k", [{"id": 6 + i, "name": name}])
    assert s._log("k").high_water() == 3
    return s._log("k").read_from(1)


@query("SELECT count(*) + 20 AS n, 1::BIGINT AS entries, 20::BIGINT AS told FROM (SELECT c_custkey FROM customer)")
def buffered_log(t: Tables) -> DataFrame:
    """Twenty callers' rows go into one entry; a query of the same engine writes out what waits and sees them."""
    s = _customers(t, 1)
    s.engine.keeper.writer(s.tenant, "c", lambda: Writer(s._log("c"), most_s=600), lambda: s.compact("c"), lambda: s._behind("c"))
    told = [s.buffer_log("c", [{"id": 900000 + i, "name": "w"}]) for i in range(20)]
    n = s.execute("SELECT count(*) AS n FROM c")
    return n.selectExpr("n", f"{len(s._log('c').numbers())}L entries", f"{sum(f.result(0) == 1 for f in told)}L told")


@query("SELECT * FROM (VALUES ('after use', 1::BIGINT, 0::BIGINT, 0::BIGINT), ('compacted', 1, 1, 0), ('idle', 0, 1, 1)) v(round, tables, compactions, evictions)")
def keeper_rounds(t: Tables) -> DataFrame:
    """The keeper compacts a tail when it is due and evicts a table that nobody uses, but not while rows wait."""
    s = _session(t)
    s.execute("CREATE TABLE k (id BIGINT NOT NULL)")
    now = [0.0]
    s.engine.keeper.clock = lambda: now[0]
    s.buffer_log("k", [{"id": 1}])
    got = []
    for at, what in ((1, "after use"), (31, "compacted"), (301, "idle")):
        now[0] = at
        s.engine.keeper.tick()
        x = s.engine.keeper.stats()
        got.append((what, x["tables"], x["compactions"], x["evictions"]))
    assert s.execute("SELECT count(*) AS n FROM k").first().n == 1 and x["failures"] == 0
    return t.spark.createDataFrame(got, "round string, tables long, compactions long, evictions long")


@query("SELECT * FROM (VALUES ('ana', 'north'), ('ben', 'south'), ('cy', NULL), ('dee', NULL), ('eve', NULL)) v(user, tenant)")
def user_resolution(t: Tables) -> DataFrame:
    """Users of a fixed list, then holders of signed tokens; a wrong secret, an expired and a forged token are denied."""
    key = b"k1"
    asked = {"ana": "pw", "ben": signed({"tenant": "south", "sub": "ben", "exp": 200}, key), "cy": "guess", "dee": signed({"tenant": "south", "exp": 50}, key), "eve": signed({"tenant": "south"}, b"k2")}
    who = FirstOf([StaticResolver({"ana": ("north", "pw"), "cy": ("north", "right")}), TokenResolver(key, clock=lambda: 100.0)])
    got = []
    for user, secret in asked.items():
        try:
            got.append((user, who.tenant(user, secret)))
        except Denied:
            got.append((user, None))
    return t.spark.createDataFrame(got, "user string, tenant string")


@query("SELECT 6 * count(*) AS rows, 2::BIGINT AS peak, true AS refused FROM nation")
def tenant_permits(t: Tables) -> DataFrame:
    """Six readers of one tenant with two permits: all get their rows, never more than two at a time; one that won't wait is refused."""
    s = Engine(t.spark, fresh_dir(t.spark, "engine"), most_jobs=2).session("acme")
    s.execute("CREATE TABLE k (id BIGINT)")
    s.write("k", t.nation.selectExpr("CAST(n_nationkey AS BIGINT) id"))
    with ThreadPoolExecutor(6) as pool:
        n = sum(pool.map(lambda _: len(s.engine.session("acme").fetch("SELECT id FROM k")), range(6)))
    refused = False
    with s.engine.permits.hold("acme"), s.engine.permits.hold("acme"):
        try:
            s.fetch("SELECT 1", wait_s=0.01)
        except TooMany:
            refused = True
    return t.spark.createDataFrame([(n, s.engine.permits.peak["acme"], refused)], "rows long, peak long, refused boolean")


@query("SELECT * FROM (VALUES ('same session', true), ('waited', true), ('refused', true)) v(what, held)")
def session_leases(t: Tables) -> DataFrame:
    """A leased session is one holder's: a second one waits for it, or is refused when it won't."""
    engine = Engine(t.spark, fresh_dir(t.spark, "engine"), most_a_tenant=1)
    got, first = [], engine.acquire("acme", "a")
    with ThreadPoolExecutor(1) as pool:
        with engine.lease("acme", "a") as held:
            got.append(("same session", held is first))
            later = pool.submit(lambda: engine.lease("acme", "b", 30).__enter__())
            try:
                with engine.lease("acme", "c", 0.05):
                    pass
            except TooMany:
                got.append(("refused", not later.done()))
        got.append(("waited", later.result(30).tenant == "acme"))
    return t.spark.createDataFrame(got, "what string, held boolean")


@query("SELECT id, name FROM (SELECT c_custkey AS id, c_name AS name, c_acctbal > 5000 AS rich FROM customer) WHERE rich = true AND name > 'Customer#000000100' OR rich = false AND name < 'a'")
def boolean_and_bytes(t: Tables) -> DataFrame:
    """Equality of booleans, and texts compared by their bytes: capitals are before small letters."""
    s = _session(t)
    s.execute("CREATE TABLE k (id BIGINT, name TEXT, rich BOOLEAN)")
    s.write("k", t.customer.selectExpr("c_custkey id", "c_name name", "c_acctbal > 5000 rich"))
    return s.execute("SELECT id, name FROM k WHERE rich = true AND name > 'Customer#000000100' OR rich = false AND name < 'a'")


@query("SELECT s FROM (VALUES ('z'), ('é'), ('Z'), ('日'), ('')) v(s) WHERE s > 'a' ORDER BY s")
def bytewise_text(t: Tables) -> DataFrame:
    s = _session(t)
    s.execute("CREATE TABLE k (s TEXT)")
    s.execute("INSERT INTO k VALUES ('z'), ('é'), ('Z'), ('日'), ('')")
    return s.execute("SELECT s FROM k WHERE s > 'a' ORDER BY s")


_Q = _query()
_QTEXT = "[" + ", ".join(map(repr, _Q)) + "]"
_QSQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _Q) + "]"


def _vectors(t: Tables) -> TenantSession:
    s = Engine(t.spark, fresh_dir(t.spark, "engine")).session("acme")
    s.execute("CREATE TABLE v (id BIGINT NOT NULL, e vector(64))")
    s.write("v", t.embeddings.selectExpr("vec_id id", "embedding e"))
    return s


@query("SELECT count(*) AS queries, true AS enough, 3::BIGINT AS metrics FROM embeddings WHERE vec_id % 500 = 0")
def vector_index_recall(t: Tables) -> DataFrame:
    """Of the ten nearest by a full scan the index finds 0.9 at least, averaged over stated queries, for each metric; the last write is indexed by itself. A row as near as the tenth is one of them."""
    s = Engine(t.spark, fresh_dir(t.spark, "engine")).session("acme")
    s.execute("CREATE TABLE v (id BIGINT NOT NULL, e vector(64))")
    s.write("v", t.embeddings.where("vec_id % 3 < 2").selectExpr("vec_id id", "embedding e").repartition(2, "id"))
    enough = 0
    asked = [[float(x) for x in r.embedding] for r in t.embeddings.where("vec_id % 500 = 0").collect()]
    for metric in ("l2", "cosine", "dot"):
        s.create_index("v", "e", metric)
    s.write("v", t.embeddings.where("vec_id % 3 = 2").selectExpr("vec_id id", "embedding e").coalesce(1))
    for metric in ("l2", "cosine", "dot"):
        far = search_many(s.table("v"), "e", asked, 10, metric, "id").groupBy("_query").agg(F.max("_distance").alias("far"))
        hit = s.vector_search_many("v", "e", asked, 10, metric).join(far, "_query").where("_distance <= far").select("_query", "id").distinct().count()
        enough += hit >= 0.9 * 10 * len(asked)
    return t.spark.createDataFrame([(len(asked), enough == 3, 3)], "queries long, enough boolean, metrics long")


@query("SELECT n, routed FROM (VALUES (5::BIGINT, true)) v(n, routed)")
def vector_index_routing(t: Tables) -> DataFrame:
    """ORDER BY distance LIMIT goes by the index once there is one; the nearest vector of a stored one is itself."""
    s = _vectors(t)
    s.create_index("v", "e")
    first = t.embeddings.orderBy("vec_id").limit(5).collect()
    n = sum(s.execute(f"SELECT id FROM v ORDER BY e <-> '[{', '.join(map(str, r.embedding))}]' LIMIT 1").first().id == r.vec_id for r in first)
    return t.spark.createDataFrame([(n, s.routed == len(first))], "n long, routed boolean")


@query(f"SELECT vec_id AS id FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_QSQL}), vec_id LIMIT 10")
def op_rewrite_l2(t: Tables) -> DataFrame:
    return _vectors(t).execute(f"SELECT id FROM v ORDER BY e <-> '{_QTEXT}', id LIMIT 10")


@query(f"SELECT vec_id AS id FROM embeddings ORDER BY -list_inner_product(embedding::DOUBLE[], {_QSQL}), vec_id LIMIT 10")
def op_rewrite_dot(t: Tables) -> DataFrame:
    return _vectors(t).execute(f"SELECT id FROM v ORDER BY e <#> '{_QTEXT}', id LIMIT 10 -- not a <-> here")


@query(f"SELECT vec_id AS id FROM embeddings WHERE list_cosine_distance(embedding::DOUBLE[], {_QSQL}) < 0.9")
def op_rewrite_cosine(t: Tables) -> DataFrame:
    return _vectors(t).execute(f"SELECT id FROM v WHERE e <=> '{_QTEXT}' < 0.9 AND '<=>' = '<=>'")


@query(f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {_QSQL}), 3) AS d FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_QSQL}) LIMIT 5")
def session_vector_search(t: Tables) -> DataFrame:
    return _vectors(t).vector_search("v", "e", _Q, 5).selectExpr("id", "round(_distance, 3) d")
