"""Every registered query with a SQL form against DuckDB, and every other one for rows and a schema."""

import importlib.util
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from folioscope.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in result.fetchall()) and (got or name == "outer_tables_dropped")


def test_entry(spark):
    assert {r.route for r in __spark_entry__.entry(spark).collect()} == {"native", "hybrid", "vlm"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators():
    """The entry module's guards are the only place that knows them."""
    assert importlib.util.find_spec("folioscope.plans.catalog") is not None
    for folder, _, files in os.walk(Path(catalog.__file__).parents[1]):
        if not folder.rstrip("/").endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in Path(folder, f).read_text(encoding="utf-8")
