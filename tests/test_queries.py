"""Every query of the library's own operators against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.driver.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (bool, str)):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value) + 0.0:.9g}"
    return str(value)


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    found = got.collect()
    if name not in ORACLE_SQL:
        assert found
        return
    expected = oracle.execute(ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(found, got.columns) == rows(expected.fetchall(), columns)
