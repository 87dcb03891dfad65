"""A few of the registered queries held against their SQL twins on the smallest tables, and the shape of the registry."""

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
SAMPLE = ["group_by", "asof_last_click", "range_join_buckets", "groups_frame", "exclude_frame", "session_windows", "except_all", "l2_topk", "distinct_on", "filter_distinct_from", "tumbling_counts", "union_by_name"]


def normal(rows):
    return sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = con.sql(f"SELECT {quoted} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert normal(df.select(*cols).collect()) == normal(want)


def test_every_query_has_its_twin():
    assert len(catalogue.queries()) > 120
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())
