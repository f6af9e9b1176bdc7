from __future__ import annotations

import os

import duckdb
import pytest

from keyloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.queries())
def test_query_against_sql(spark, db, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(map(repr, map(tuple, got.select(*columns).collect())))
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    assert sorted(db.sql(sql).columns) == columns
    assert rows == sorted(map(repr, db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Tables of 1203 suppliers, three of them of no nation, and 25 nations."""
    path = str(tmp_path_factory.mktemp("many"))
    spark.range(1203).selectExpr("id AS s_suppkey", "IF(id < 1200, CAST(id * id % 30 AS INT), NULL) AS s_nationkey").write.parquet(f"{path}/supplier.parquet")
    spark.range(25).selectExpr("CAST(id AS INT) AS n_nationkey").write.parquet(f"{path}/nation.parquet")
    return path


def test_self_check_of_more_than_500_rows(spark, many, monkeypatch):
    assert catalog.join_self_check(spark, many).collect() == [(True,)]
    real = catalog.digest.join_digest
    monkeypatch.setattr(catalog.digest, "join_digest", lambda r, s, *keys: real(r.where("s_nationkey > 0"), s, *keys))
    assert catalog.join_self_check(spark, many).collect() == [(False,)]


def test_verifier_of_more_than_500_rows(spark, many):
    got = catalog.join_verify_bruteforce(spark, many)
    con = duckdb.connect()
    for t in ("supplier", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{many}/{t}.parquet/*.parquet'")
    expected = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()['join_verify_bruteforce']})").fetchall()
    assert list(map(tuple, got.collect())) == expected
    assert expected[0][0] == str(sum(i * i % 30 < 25 for i in range(1200)))


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
