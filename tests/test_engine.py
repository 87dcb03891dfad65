"""State tests of the engine: what SQL twins cannot express."""

import numpy as np
import pytest

from millrace.catalog import DataFile
from millrace.engine import Engine, Rate
from millrace.errors import AlreadyExists, CommitConflict, InvalidIdent, InvalidLiteral, InvalidSchema, IsolationViolation, NotFound, Unsupported
from millrace.functions.vectors import search, search_many
from millrace.plans import catalogue, predicates, sqltext
from millrace.plans.rest import as_json, rest_delete, rest_insert, rest_select, rest_update
from millrace.sources.files import fresh_dir


@pytest.fixture
def engine(spark):
    return Engine(spark, fresh_dir(spark, "engine"))


@pytest.fixture
def stock(engine):
    """Seven articles, two without a colour."""
    s = engine.session("t1")
    s.execute("CREATE TABLE t (sku BIGINT NOT NULL, colour TEXT)")
    s.execute("INSERT INTO t VALUES (11, 'red'), (12, 'blue'), (13, NULL), (14, 'red'), (15, 'green'), (16, NULL), (17, 'blue')")
    return s


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_create_errors(engine):
    s = engine.session("t1")
    assert s.execute("CREATE TABLE t (id INT NOT NULL, v vector(3), b BYTEA, ok BOOL);").text == "CREATE TABLE"
    with pytest.raises(AlreadyExists):
        s.execute("CREATE TABLE t (id INT)")
    for bad in ("CREATE TABLE u (id UUID)", "CREATE TABLE u (v vector(0))", "CREATE TABLE u (a INT, A INT)"):
        with pytest.raises(InvalidSchema):
            s.execute(bad)
    for bad in ("CREATE TABLE u (id INT, PRIMARY KEY (id))", "DROP TABLE t", "SELECT 1; SELECT 2", ""):
        with pytest.raises(Unsupported):
            s.execute(bad)
    with pytest.raises(InvalidIdent):
        engine.session("no/slash")
    assert s.execute("SELECT * FROM t").count() == 0
    assert s.execute("SELECT * FROM t").columns == ["id", "v", "b", "ok"]


def test_insert_coercion(engine):
    s = engine.session("t1")
    s.execute("CREATE TABLE t (id BIGINT NOT NULL, x DOUBLE, b BYTEA, v vector(2), ok BOOLEAN, s TEXT)")
    assert s.execute(r"INSERT INTO t VALUES (-1, 2, '\x00ff', '[1, 2.5]', true, 'O''Brien')").text == "INSERT 0 1"
    s.execute("INSERT INTO t (v, id) VALUES (ARRAY[3, 4], 2)")
    got = rows(s.execute("SELECT id, x, hex(b), v, ok, s FROM t"))
    assert got == [(-1, 2.0, "00FF", [1.0, 2.5], True, "O'Brien"), (2, None, None, [3.0, 4.0], None, None)]
    for bad in ("(NULL, 1, NULL, NULL, NULL, NULL)", "('1', 1, NULL, NULL, NULL, NULL)", "(1, 'x', NULL, NULL, NULL, NULL)", r"(1, 1, '\x0', NULL, NULL, NULL)", "(1, 1, NULL, '[1]', NULL, NULL)", "(1, 1, NULL, NULL, 1, NULL)", "(1, 1, NULL, NULL, NULL, 5)", "(1, 2)"):
        with pytest.raises(InvalidLiteral):
            s.execute(f"INSERT INTO t VALUES {bad}")
    with pytest.raises(NotFound):
        s.execute("INSERT INTO t (nope) VALUES (1)")
    assert s.execute("INSERT INTO t (id, x) SELECT id + 10, x FROM t").rows == 2


def test_delete_and_update(stock):
    assert stock.execute("UPDATE t SET colour = 'grey' WHERE colour IS NULL OR sku > 16").text == "UPDATE 3"
    assert stock.execute("UPDATE t SET colour = NULL WHERE sku BETWEEN 14 AND 15").text == "UPDATE 2"
    assert stock.execute("DELETE FROM t WHERE colour <> 'grey'").text == "DELETE 2"
    assert rows(stock.execute("SELECT * FROM t").fillna("-")) == [(13, "grey"), (14, "-"), (15, "-"), (16, "grey"), (17, "grey")]
    assert stock.execute("DELETE FROM t WHERE sku % 2 = 1 AND length(coalesce(colour, '')) = 4").text == "DELETE 2"
    for bad in ("DELETE FROM t WHERE size > 3", "UPDATE t SET sku = sku * 2", "UPDATE t SET colour = 'x' WHERE sku = 16 RETURNING sku"):
        with pytest.raises((Unsupported, InvalidLiteral, NotFound)):
            stock.execute(bad)
    assert stock.execute("DELETE FROM t").text == "DELETE 3"
    assert stock.execute("SELECT * FROM t").count() == 0


@pytest.fixture
def readings(engine):
    """Three files of readings by day, whose days don't overlap; the middle one alone holds alarms, and the last one a day of its own."""
    s = engine.session("t1")
    s.execute("CREATE TABLE r (day BIGINT NOT NULL, level DOUBLE, state TEXT)")
    for first, alarms in ((0, 0), (40, 7), (80, 0)):
        s.write("r", engine.spark.range(first, first + 30).selectExpr("id day", "id / 4 level", f"if(id < {first + alarms}, 'alarm', 'calm') state").coalesce(1))
    return s


def test_changes_leave_files_alone_that_hold_no_row(readings):
    paths = [f.path for f in readings.catalog.load("t1", "r").files]
    assert readings.execute("UPDATE r SET state = 'seen' WHERE state = 'alarm' AND level >= 11").text == "UPDATE 3"
    after = [f.path for f in readings.catalog.load("t1", "r").files]
    assert len(after) == 3 and set(paths) & set(after) == {paths[0], paths[2]}
    assert readings.execute("DELETE FROM r WHERE day >= 80").text == "DELETE 30"  # a whole file, unread
    assert paths[0] in [f.path for f in readings.catalog.load("t1", "r").files] and readings.execute("SELECT * FROM r").count() == 60


def test_queries_read_only_files_that_may_hold_rows(readings):
    for where, files in (("day = 95", 1), ("day < 35", 1), ("level > 9.9 AND state = 'alarm'", 1), ("NOT (day < 75)", 1), ("day IN (3, 44)", 2), ("day = 200", 0), ("length(state) = 5", 3)):
        out = readings.execute(f"SELECT day, state FROM r WHERE {where} ORDER BY day LIMIT 100")
        want = sorted(map(tuple, readings.table("r").where(where).select("day", "state").collect()))
        assert rows(out) == want and readings.files_read["r"] == (files, 3) and len(out.inputFiles()) == files
    assert readings.execute("SELECT count(*) n FROM r").first().n == 90  # and the next query has all of them
    assert readings.execute("SELECT count(*) n FROM r a JOIN r b USING (day) WHERE a.day = 95").first().n == 1
    readings.append_log("r", [{"day": 95, "state": "late"}])
    assert readings.execute("SELECT count(*) n FROM r WHERE day = 95").first().n == 2


def test_snapshots_conflicts_and_vacuum(stock):
    before = stock.table("t", version=1)
    stock.execute("DELETE FROM t WHERE colour = 'red'")
    assert before.count() == 7 and stock.table("t").count() == 5
    assert [r.operation for r in stock.snapshots("t").orderBy("id").collect()] == ["genesis", "append", "replace"]
    head = stock.catalog.load("t1", "t")
    stock.catalog.append("t1", "t", head.id, [])
    with pytest.raises(CommitConflict):
        stock.catalog.append("t1", "t", head.id, [])
    with pytest.raises(CommitConflict):
        stock.catalog.replace("t1", "t", head.id + 1, {"gone.parquet"}, [])
    assert stock.vacuum("t") == 1 and stock.table("t").count() == 5
    with pytest.raises(NotFound):
        stock.table("t", version=1)


def test_manifests_are_created_once_and_whole(engine):
    path = f"{engine.root}/once/v1.json"
    assert engine.catalog.files.create(path, "first" * 1000) and not engine.catalog.files.create(path, "second")
    assert engine.catalog.files.read(path) == "first" * 1000 and [p for p, _, _ in engine.catalog.files.list(f"{engine.root}/once") if p.endswith(".tmp")] == []


def test_files_outside_of_the_tenant_are_refused(engine, stock):
    for k, path in enumerate((f"{engine.root}/tenants/t2/tables/t/data/x.parquet", f"{engine.root}/tenants/t1/tables/t/data/../../../../t2/x.parquet", f"/else{engine.catalog.table_dir('t1', 't')}/data/x.parquet")):
        name = f"bad{k}"
        stock.execute(f"CREATE TABLE {name} (a BIGINT)")
        stock.catalog.append("t1", name, 0, [DataFile(path.replace("/tables/t/", f"/tables/{name}/") if "t1/" in path and ".." not in path else path, 1, 1, {})])
        with pytest.raises(IsolationViolation):
            stock.catalog.load("t1", name)


def test_cached_manifests_are_bounded(engine, stock):
    engine.catalog.most_cached = 2
    for k in range(5):
        stock.append_log("t", [{"sku": 100 + k}])
        stock.compact("t")
    assert len(engine.catalog.cache) <= 2 and stock.execute("SELECT count(*) n FROM t").first().n == 12


def test_dialect_inside_of_queries(stock):
    q = "SELECT n FROM (SELECT colour, count(*) AS n FROM t GROUP BY colour QUALIFY rank() OVER (ORDER BY count(*) DESC, colour) <= 2) x"
    assert rows(stock.execute(q)) == [(2,), (2,)]
    assert rows(stock.execute("WITH w AS (SELECT DISTINCT ON (colour) colour, sku FROM t ORDER BY colour, sku DESC) SELECT sku FROM w WHERE colour IS NOT NULL")) == [(14,), (15,), (17,)]
    assert [r.sku for r in stock.execute("SELECT DISTINCT ON (coalesce(colour, '-')) sku FROM t ORDER BY coalesce(colour, '-') DESC, sku LIMIT 3").collect()] == [11, 15, 12]
    assert [r.sku for r in stock.execute("SELECT sku FROM t ORDER BY sku DESC FETCH FIRST ROW ONLY").collect()] == [17]
    assert [r.sku for r in stock.execute("SELECT sku, 'QUALIFY' AS w FROM t ORDER BY sku FETCH NEXT 2 ROWS ONLY").collect()] == [11, 12]
    with pytest.raises(Unsupported):
        stock.execute("SELECT sku FROM t UNION SELECT sku FROM t QUALIFY row_number() OVER (ORDER BY sku) = 1")


def test_isolation_and_drop(engine, stock):
    other = engine.session("t2")
    with pytest.raises(NotFound):
        other.execute("SELECT * FROM t")
    with pytest.raises((NotFound, Unsupported)):
        other.execute(f"SELECT * FROM parquet.`{engine.root}/tenants/t1/tables/t/data`")
    stock.drop_table("t")
    with pytest.raises(NotFound):
        stock.execute("SELECT * FROM t")
    engine.create_namespace("empty")
    assert engine.catalog.tenants() == ["empty", "t1"] and engine.session("empty").execute("SHOW TABLES").count() == 0
    engine.drop_tenant("t1")
    engine.drop_tenant("empty")
    assert engine.catalog.tenants() == []


def test_log(stock):
    assert stock.append_log("t", [{"sku": 18, "colour": "black"}, {"sku": 19}]) == 1
    assert stock.execute("SELECT count(*) n FROM t").first().n == 9
    assert stock.compact("t") == 1 and stock.compact("t") == 1
    assert stock.execute("SELECT count(*) n FROM t").first().n == 9
    log = stock._log("t")
    assert log.truncate() == 1 and log.high_water() == 1
    assert stock.append_log("t", [{"sku": 20, "colour": "white"}]) == 2
    assert rows(log.read_from(1)) == [(2, 20, "white")]
    assert stock.execute("DELETE FROM t WHERE sku > 17").text == "DELETE 3"
    assert stock.execute("SELECT count(*) n FROM t").first().n == 7
    with pytest.raises(InvalidLiteral):
        stock.append_log("t", [{"colour": "none"}])


def test_prepared(stock):
    h, info = stock.prepare("SELECT sku, colour FROM t WHERE sku >= $1 AND colour <> $2 LIMIT $3 -- $9 isn't one")
    assert info["param_types"] == ["bigint", "string", "bigint"] and info["columns"] == [("sku", "bigint"), ("colour", "string")]
    assert rows(stock.execute_bound(stock.bind(h, [14, "'; DROP", 10]))) == [(14, "red"), (15, "green"), (17, "blue")]
    assert stock.execute_bound(stock.bind(h, [11, "", 10]), max_rows=2).count() == 2
    i, info = stock.prepare("INSERT INTO t VALUES ($1, $2)")
    assert info["param_types"] == ["bigint", "string"]
    assert stock.execute_bound(stock.bind(i, [9, "é'$1"])).text == "INSERT 0 1"
    assert stock.execute("SELECT colour FROM t WHERE sku = 9").first().colour == "é'$1"
    with pytest.raises(InvalidLiteral):
        stock.bind(h, [1])
    stock.close_statement(h)
    with pytest.raises(NotFound):
        stock.bind(h, [1, "", 1])


def test_rest(stock):
    assert rest_insert(stock, "t", '[{"sku": 18, "colour": "black"}, {"sku": 19}]') == 2
    t = stock.table("t")
    assert [r.sku for r in rest_select(t, "sku=gt.13&colour=is.null&order=sku.desc&select=sku").collect()] == [19, 16]
    assert [r.sku for r in rest_select(t, "sku=in.(11,13,99)&order=sku&limit=1&offset=1").collect()] == [13]
    assert rest_update(stock, "t", "sku=eq.19", '{"colour": "white"}') == 1
    assert rest_delete(stock, "t", "sku=gte.18") == 2
    with pytest.raises(Unsupported):
        rest_delete(stock, "t", "")
    with pytest.raises(InvalidLiteral):
        rest_insert(stock, "t", '{"sku": {"a": 1}}')
    assert as_json(stock.table("t").where("sku = 13")).first().json == '{"sku":13,"colour":null}'


def test_vectors(engine):
    s = engine.session("t1")
    s.execute("CREATE TABLE v (id BIGINT, e vector(2))")
    s.execute("INSERT INTO v VALUES (1, '[0, 0]'), (2, '[3, 4]'), (3, NULL), (4, '[1, 0]')")
    assert [(r.id, r._distance) for r in s.vector_search("v", "e", [0.0, 0.0], 2).collect()] == [(1, 0.0), (4, 1.0)]
    got = s.execute("SELECT id, e <-> '[0,0]' AS l2, e <#> '[1,1]' AS ip, e <=> '[1,0]' AS cos FROM v WHERE id <= 2 ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 0.0, 1.0), (2, 5.0, -7.0, pytest.approx(0.4))]
    near = s.execute("SELECT id FROM v WHERE e IS NOT NULL ORDER BY L2_distance(e, '[3,3]') LIMIT 1")
    assert near.first().id == 2
    with pytest.raises(InvalidLiteral):
        s.vector_search("v", "e", [0.0], 2)
    with pytest.raises(Exception, match="dimension"):
        s.execute("SELECT e <-> '[1,2,3]' FROM v").collect()


def test_vector_index(engine):
    s = engine.session("t1")
    s.execute("CREATE TABLE v (id BIGINT NOT NULL, e vector(3))")
    grid = engine.spark.range(600).selectExpr("id", "array(float(id % 10), float(int(id / 10) % 10), float(int(id / 100))) e")
    s.write("v", grid.where("id < 400").repartition(2))
    assert s.create_index("v", "e") == 2 and s.create_index("v", "e") == 0
    s.write("v", grid.where("id >= 400").coalesce(1))  # indexed as it comes
    s.execute("INSERT INTO v VALUES (1000, NULL)")
    ask = "SELECT id, e FROM v ORDER BY e <-> '[3, 4, 5]' LIMIT 1"
    assert [r.id for r in s.execute(ask).collect()] == [543] and s.routed == 1
    assert [(r.id, r._distance) for r in s.vector_search("v", "e", [3.0, 4.0, 5.0], 1).collect()] == [(543, 0.0)]
    s.execute("DELETE FROM v WHERE id = 543")  # its file is another one now
    assert s.execute(ask).first().id in (443, 533, 542, 544, 553)
    s.append_log("v", [{"id": 2000, "e": [3.0, 4.0, 5.1]}])
    assert s.execute(ask).first().id == 2000 and s.routed == 3
    assert s.execute("SELECT count(*) n FROM v").first().n == 601
    for other in ("SELECT id FROM v WHERE id < 50 ORDER BY e <-> '[3, 4, 5]' LIMIT 1", "SELECT id FROM v ORDER BY e <=> '[3, 4, 5]' LIMIT 1", "SELECT id FROM v ORDER BY e <-> '[3, 4, 5]' DESC LIMIT 1"):
        s.execute(other).collect()
        assert s.routed == 3
    folder = s.catalog.table_dir("t1", "v")
    every = {r.id for r in s._candidates("v", "e", [0.0, 0.0, 0.0], 50, "l2", probes=1.0).collect()} - {2000}
    want = sorted(range(600), key=lambda i: ((i % 10) ** 2 + (i // 10 % 10) ** 2 + (i // 100) ** 2))
    far = lambda i: (i % 10) ** 2 + (i // 10 % 10) ** 2 + (i // 100) ** 2
    assert len(every) == 50 and max(map(far, every)) == far(want[49])  # all lists read: exact
    with pytest.raises(InvalidSchema):
        s.create_index("v", "id")
    engine.catalog.files.create(f"{folder}/index/later.json", '{"magic": "millrace-lists", "version": 99, "column": "e"}')
    with pytest.raises(InvalidSchema):
        s.execute(ask)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_vector_index_finds_the_nearest(engine, metric):
    """Vectors without groups, some of them tiny or zero, some copied: what the index finds is as near as what a full scan finds."""
    s = engine.session("t1")
    s.execute("CREATE TABLE v (id BIGINT NOT NULL, e vector(16))")
    x = np.random.default_rng(3).normal(size=(900, 16)).astype(np.float32)
    x[:3], x[3:6], x[6:30] = 0, x[3:6] * np.float32(1e-9), x[30]
    s.write("v", engine.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<float>").repartition(2, "id"))
    s.create_index("v", "e", metric)
    for i, k in [(5, 10), (30, 10), (31, 10), (32, 300), (0, 4), (33, 2000)]:
        q = [float(y) for y in x[i] * (3 if i == 31 else 1)]
        want = [r._distance for r in search(s.table("v"), "e", q, k, metric).collect()]
        got = s.vector_search("v", "e", q, k, metric).collect()
        assert [r._distance for r in got] == pytest.approx(want, abs=1e-12) and len({r.id for r in got}) == len(want)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_vector_search_many(engine, metric):
    """Many queries at once find what each finds alone, by the index, beside it and without one; a scan gives the doubles of the column forms."""
    s = engine.session("t1")
    s.execute("CREATE TABLE v (id BIGINT NOT NULL, e vector(16))")
    x = np.random.default_rng(4).normal(size=(700, 16)).astype(np.float32)
    x[:3], x[3:6], x[6:30] = 0, x[3:6] * np.float32(1e-9), x[30]
    frame = engine.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<float>")
    asked = [[float(y) for y in x[i]] for i in (5, 30, 31, 0, 699)]
    s.write("v", frame.where("id < 600").repartition(2, "id"))
    s.execute("INSERT INTO v VALUES (1000, NULL)")
    for step in ("no index", "index", "another file", "tail", "changed"):
        if step == "index":
            s.create_index("v", "e", metric)
        elif step == "another file":
            s._index_added = lambda *_: None  # a writer that doesn't index
            s.write("v", frame.where("id >= 600 and id < 690"))
        elif step == "tail":
            s.append_log("v", [{"id": i, "e": x[i].tolist()} for i in range(690, 700)])
        elif step == "changed":
            s.execute("DELETE FROM v WHERE id % 7 = 3")
        for k in (1, 10, 2000) if step == "tail" else (10,):
            got = s.vector_search_many("v", "e", asked, k, metric).collect()
            scan = search_many(s.table("v"), "e", asked, k, metric, "id").collect()
            for n, q in enumerate(asked):
                want = [(r.id, r._distance) for r in search(s.table("v"), "e", q, k, metric, "id").collect()]
                one = sorted((r._distance, r.id) for r in scan if r._query == n)
                assert [i for _, i in one] == [i for i, _ in want] or metric == "cosine"  # where the query's norm is summed in another way
                assert [d for d, _ in one] == pytest.approx([d for _, d in want], abs=1e-12)
                own = sorted((r._distance, r.id) for r in got if r._query == n)
                assert [d for d, _ in own] == [d for d, _ in one] and len({i for _, i in own}) == len(want)
    assert s.vector_search_many("v", "e", [], 5, metric).count() == 0 and search_many(s.table("v"), "e", [], 5, metric).count() == 0
    with pytest.raises(InvalidLiteral):
        s.vector_search_many("v", "e", [[0.0], asked[0]], 2, metric)


def test_recall_takes_as_many_jobs_for_more_queries(spark, tmp_path):
    """The queries go through index and table together: ten of them take the jobs that one takes."""
    x = np.random.default_rng(6).normal(size=(5000, 64)).astype(np.float32)
    jobs = []
    for rows in (500, 5000):
        folder = f"{tmp_path}/{rows}"
        spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x[:rows])], "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{folder}/embeddings.parquet")
        spark.sparkContext.setJobGroup(folder, "recall")
        got = catalogue.queries()["vector_index_recall"](spark, folder).first()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(folder)))
        assert tuple(got) == (rows // 500, True, 3)
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[1] < 1.5 * jobs[0]


def test_rewriting_skips_strings_and_comments():
    sql = "SELECT '<->', \"a<->b\" /* <-> */ FROM t -- <=>"
    assert sqltext.rewrite_vectors(sql) == sql
    assert sqltext.named_parameters("SELECT '$1', $2 -- $3") == ("SELECT '$1', :p2 -- $3", 2)
    assert sqltext.is_analytical("SELECT count(*) FROM t") and not sqltext.is_analytical("SELECT 'count(' FROM t")


def test_pruning_in_three_valued_logic():
    f = DataFile("p", 1, 10, {"a": {"min": 5, "max": 9, "nulls": 0}, "b": {"min": 5, "max": 9, "nulls": 2}, "c": {"min": None, "max": None, "nulls": 10}})
    expect = {
        "a > 9": "none", "a > 4": "all", "b > 4": "mixed", "NOT (b > 9)": "mixed", "NOT (a > 9)": "all", "NOT (a > 4)": "none",
        "c IS NULL": "all", "c = 1": "none", "NOT (c = 1)": "none", "a IN (1, 2)": "none", "a NOT IN (1, 2)": "all", "b NOT IN (1, 2)": "mixed",
        "a > 9 OR a = 7": "mixed", "upper(x) = 'A'": "mixed", "10 > a": "all", "a <> 3": "all", "a BETWEEN 5 AND 9": "all", "a = 'x'": "mixed",
    }
    assert {w: predicates.outcome(predicates.parse(w), f.stats()) for w in expect} == expect


def test_pool_and_rate(engine):
    a = engine.acquire("t1", "c1")
    assert engine.acquire("t1", "c1") is a
    engine.most_a_tenant = 1
    engine.acquire("t1", "c2")
    assert engine.acquire("t1", "c1") is not a
    r = Rate(at=0.0)
    assert not any(r.tick(i / 20) for i in range(20))
    assert any(r.tick(1 + i / 20) for i in range(60))
    assert r.tick(20) and not r.tick(30)
