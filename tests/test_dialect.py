"""Frames and as-of joins of the dialect, exact percentiles, buffered writers, and the folder form of stream tables."""

import random
import threading

import pytest

from millrace.engine import Engine
from millrace.errors import InvalidLiteral, Unsupported
from millrace.operators.aggregates import exact_percentiles
from millrace.operators.joins import asof
from millrace.plans.registry import Tables
from millrace.sources.files import fresh_dir
from millrace.streaming.buffer import Writer
from millrace.streaming.events import run_to_end, stream_of


@pytest.fixture
def session(spark):
    return Engine(spark, fresh_dir(spark, "engine")).session("t1")


def nearest(left, right, op):
    """Brute force: for each left (id, key, time) the right id, the greatest id of the nearest time."""
    out = {}
    for i, k, t in left:
        meets = {">=": lambda x: t >= x, ">": lambda x: t > x, "<=": lambda x: t <= x, "<": lambda x: t < x}[op]
        found = [(u, j) for j, kk, u in right if k is not None and t is not None and kk == k and u is not None and meets(u)]
        best = (max if op[0] == ">" else min)((u for u, _ in found), default=None)
        out[i] = max((j for u, j in found if u == best), default=None)
    return out


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_asof_against_brute_force(spark, op, kind):
    """A hot key, ties, equal times, repeated rows' keys, and nulls; times with and without slices."""
    rng = random.Random(5)
    time = (lambda: rng.choice([None, *(f"{rng.randrange(300):03d}" for _ in range(20))])) if kind == "string" else (lambda: rng.choice([None, *(rng.randrange(300) for _ in range(20))]))
    key = lambda: rng.choice([None, 1, 1, 1, 1, rng.randrange(2, 9)])
    left, right = [(i, key(), time()) for i in range(300)], [(1000 + i, key(), time()) for i in range(200)]
    a, b = spark.createDataFrame(left, f"id int, k int, t {kind}"), spark.createDataFrame(right, f"id int, k int, t {kind}")
    got = asof(a, b, [("k", "k")], "t", "t", op, tie="id").selectExpr("l.id a", "r.id b").collect()
    assert len(got) == 300 and {r.a: r.b for r in got} == nearest(left, right, op)
    none = asof(a, b.where("false"), [("k", "k")], "t", "t", op).where("r IS NOT NULL")
    assert none.count() == 0


def test_asof_deals_a_hot_key(spark):
    """One key's rows are in many groups."""
    a = spark.range(2000).selectExpr("1 k", "id t")
    plan = asof(a, a, [("k", "k")], "t", "t")
    assert plan.where("r.t = l.t").count() == 2000
    assert "_slice" in plan._jdf.queryExecution().toString().split("Exchange hashpartitioning(")[1][:60]


def test_dialect_refusals(session):
    session.execute("CREATE TABLE a (k BIGINT, t BIGINT)")
    session.execute("CREATE TABLE b (k BIGINT, t BIGINT)")
    for bad in (
        "SELECT * FROM a ASOF JOIN (SELECT * FROM b) c ON a.k = c.k AND a.t >= c.t",
        "SELECT * FROM a ASOF JOIN b ON a.k = b.k",
        "SELECT * FROM a ASOF FULL JOIN b ON a.k = b.k AND a.t >= b.t",
        "SELECT count(*) OVER (GROUPS 1 PRECEDING) FROM a",
        "SELECT list(t) OVER (ORDER BY t ROWS 1 PRECEDING EXCLUDE CURRENT ROW) FROM a",
        "SELECT sum(t) OVER (ORDER BY t GROUPS 1 PRECEDING) FROM a JOIN b USING (k)",
        "SELECT sum(t) OVER (ORDER BY t RANGE 1 PRECEDING EXCLUDE TIES) FROM a",
    ):
        with pytest.raises(Unsupported):
            session.execute(bad)


def test_asof_leaves_texts_alone(session):
    session.execute("CREATE TABLE a (k BIGINT, t BIGINT)")
    session.execute("INSERT INTO a VALUES (1, 5), (1, 9), (2, 7)")
    got = session.execute("SELECT x.t AS t, y.t AS u, 'p . q' AS s FROM a AS x ASOF LEFT JOIN a AS y USING (k, t) WHERE 'p . q' <> 'p.q' ORDER BY t").collect()
    assert [tuple(r) for r in got] == [(5, 5, "p . q"), (7, 7, "p . q"), (9, 9, "p . q")]
    assert session.execute("SELECT x.t AS t, y.t AS u FROM a x ASOF JOIN a y ON y.k = x.k AND y.t < x.t").collect() == [(9, 5)]


def test_frames_keep_what_they_stand_in(session):
    session.execute("CREATE TABLE a (k BIGINT, t BIGINT)")
    session.execute("INSERT INTO a VALUES (1, 10), (1, 10), (2, 20), (3, 30), (NULL, 40)")
    got = session.execute("SELECT *, sum(k) OVER (ORDER BY t GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM a x WHERE x.t < 40 ORDER BY t, s").collect()
    assert [tuple(r) for r in got] == [(1, 10, 2), (1, 10, 2), (2, 20, 4), (3, 30, 5)]
    inner = session.execute("SELECT max(n) AS m FROM (SELECT count(k) OVER (ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS n, 'GROUPS (' AS s FROM a)")
    assert inner.first().m == 2
    assert session.execute("SELECT 'ASOF JOIN' AS s, 'EXCLUDE GROUP' AS g").first() == ("ASOF JOIN", "EXCLUDE GROUP")
    alone = session.execute("SELECT sum(k) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND CURRENT ROW EXCLUDE CURRENT ROW) AS s FROM a").collect()
    assert [r.s for r in alone] == [None] * 5


def test_percentiles(spark):
    rng = random.Random(8)
    groups = {"a": [float(rng.randrange(50)) for _ in range(501)], "b": [2.5], "c": [], None: [3.0, 1.0]}
    rows = [(g, x) for g, xs in groups.items() for x in [*xs, None]]
    got = exact_percentiles(spark.createDataFrame(rows, "g string, x double"), "g", {"m": ("x", 0.5, True), "q": ("x", 0.25, False), "top": ("x", 1.0, True)}).collect()
    import numpy as np

    want = {g: (None,) * 3 if not xs else (float(np.percentile(xs, 50)), float(np.percentile(xs, 25, method="inverted_cdf")), max(xs)) for g, xs in groups.items()}
    assert {r.g: (r.m, r.q, r.top) for r in got} == want


def test_percentile_brackets(spark, monkeypatch):
    """With brackets for groups of any size above 3000."""
    from millrace.operators import aggregates

    monkeypatch.setattr(aggregates, "SMALL_GROUP", 3000)
    df = spark.range(20_000).selectExpr("'a' g", "CAST((id * 7919) % 20000 AS DOUBLE) x")
    got = exact_percentiles(df, "g", {"m": ("x", 0.5, True), "p": ("x", 0.9, True), "d": ("x", 0.1, False), "low": ("x", 0.0, True)}).first()
    assert (got.m, round(got.p, 6), got.d, got.low) == (9999.5, 17999.1, 1999.0, 0.0)


class Unsteady:
    """A log that fails at first."""

    def __init__(self, failures):
        self.failures, self.entries = failures, []

    def encode(self, rows):
        return [str(r) for r in rows]

    def append_lines(self, lines):
        if self.failures:
            self.failures -= 1
            raise OSError("no room")
        self.entries.append(list(lines))
        return len(self.entries)


def test_writer_keeps_rows_of_a_failed_flush():
    log = Unsteady(1)
    w = Writer(log, most_s=600)
    first = w.add([1, 2])
    with pytest.raises(OSError):
        w.flush()
    assert w.dirty and not first.done()
    second = w.add([3])
    assert w.flush() == 1 and log.entries == [["1", "2", "3"]] and (first.result(0), second.result(0)) == (1, 1)
    assert w.flush() is None and not w.dirty


def test_writer_flushes_by_time_and_size():
    timed = Writer(Unsteady(2), most_s=0.02)
    assert timed.add([1]).result(10) == 1  # tried again after two failures
    full = Writer(Unsteady(0), most_bytes=5, most_s=600)
    assert not full.add(["ab"]).done()
    assert full.add(["abc"]).result(0) == 1
    many = Writer(Unsteady(0), most_bytes=50, most_s=0.05)
    done = []
    threads = [threading.Thread(target=lambda i=i: done.append(many.add([i]))) for i in range(60)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(f.result(10) for f in done) and sorted(int(x) for e in many.log.entries for x in e) == list(range(60))


def test_buffered_rows_are_checked(session):
    session.execute("CREATE TABLE a (k BIGINT NOT NULL)")
    with pytest.raises(InvalidLiteral):
        session.buffer_log("a", [{"k": None}])
    session.buffer_log("a", [{"k": 4}])
    assert session.execute("SELECT k FROM a").collect() == [(4,)]


def test_stream_of_a_folder_of_part_files(spark, tmp_path):
    spark.sql("SELECT id event_id, timestamp_ntz'2024-01-01 00:00:00' ts FROM range(9)").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert run_to_end(stream_of(Tables(spark, f"file://{tmp_path}"), "events").select("event_id"), "append").count() == 9


def test_conditions_reach_the_scan(spark):
    """Row groups are left out by pushed conditions, and unread columns aren't in the schema."""
    from millrace.plans import catalogue

    plan = catalogue.queries()["filter_lt_gt"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "LessThan" in plan and "c_comment" not in plan
