"""Every query with SQL against DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import duckdb
import pytest

from quillseek.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def normal(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    if name in catalogue.ORACLE:
        expected = duck.sql(catalogue.ORACLE[name])
        assert sorted(expected.columns) == columns
        assert normal(rows) == normal(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    import __spark_entry__ as driver

    found = driver.entry(spark).collect()
    assert 0 < len(found) <= 10 and found == sorted(found, key=lambda r: (r["score"], r["ref_index"]))
    assert set(driver.oracle_sql()) <= set(driver.queries())
