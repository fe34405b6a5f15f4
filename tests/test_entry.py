"""Every registered query of the library's own against its SQL on the smallest tables, and the entry itself."""

import os

import pytest

import __spark_entry__
from marginalia.plans import legal, queries

QUERIES, ORACLES = queries.QUERIES | legal.QUERIES, queries.ORACLES | legal.ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def rows(table):
    """Rows as text, whatever the integer width."""
    table = table.select(sorted(table.column_names))
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r.values())) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert rows(got.toArrow()) == rows(db.execute(ORACLES[name]).to_arrow_table())
    else:
        # what has no SQL has a test of its own; here it must give rows, but for corrections, as the tables hold no partial quotations
        assert got.columns and (got.count() > 0 or name == "quote_corrections")


def test_title_search_asks_every_part(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    got = queries.title_search(spark, SF).collect()
    assert {r.query_id for r in got} == {r.p_partkey for r in part.select("p_partkey").collect()}
    names = {r.p_partkey: r.p_name for r in part.collect()}
    assert all(names[r.query_id] == names[r.article_id] for r in got if r["rank"] == 1)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
