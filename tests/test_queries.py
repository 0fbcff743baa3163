"""Every query with an oracle against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lodestar.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cell(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(registry.oracles()))
def test_query(spark, sf, con, name):
    want = con.sql(registry.oracles()[name])
    got = registry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    a = sorted(tuple(cell(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    b = sorted(tuple(cell(v) for v in r) for r in got.select(*columns).collect())
    assert a == b


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracles()])
def test_rows_only(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(registry.queries()) <= set(entry.queries())


def test_entity_resolution_compares_the_last_digits_of_long_keys(spark, sf, tmp_path):
    c = duckdb.connect()
    data = {"supplier": "SELECT 123456789::BIGINT AS s_suppkey, 3 AS s_nationkey UNION ALL SELECT 5, 3", "customer": "SELECT unnest([12345678, 12, 223456789, 323456789])::BIGINT AS c_custkey, 3 AS c_nationkey"}
    for t in ("supplier", "customer", "nation", "region"):
        c.sql(f"COPY ({data.get(t, f'SELECT * FROM {chr(39)}{sf}/{t}.parquet{chr(39)}')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = registry.queries()["entity_resolution"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(registry.oracles()["entity_resolution"]).fetchall())
