"""Room numbers beyond the 24,300 forms that drawings print: the rows of the SQL, whatever sign its keys end in."""

import os

import duckdb
import pytest

from plumbline.driver.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["X05_extracted_tables", "X08_room_tags"])
def test_keys_beyond_the_letters(spark, tmp_path, name):
    keys = [*range(40), *range(24_280, 24_320), *range(29_720, 29_760), *range(180_000, 180_040)]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE part AS SELECT * REPLACE (CAST(k AS BIGINT) AS p_partkey) FROM (SELECT *, row_number() OVER () AS n FROM '{SF}/part.parquet') JOIN (SELECT unnest({keys}) AS k, unnest(range(1, {len(keys) + 1})) AS n) USING (n)".replace("SELECT * REPLACE", "SELECT * EXCLUDE (n, k) REPLACE"))
    con.execute(f"COPY part TO '{tmp_path}/part.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    names = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert len(expected) >= len(keys) and sorted(tuple(r) for r in got.select(*names).collect()) == sorted(expected)
