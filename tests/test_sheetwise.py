"""Many small groups in whole batches: the rows of groupBy().applyInPandas, also across batches, with nulls, and in any order."""

import pandas as pd
import pytest

from plumbline.driver.queries import QUERIES
from plumbline.plans.scratch import sheetwise
from test_joins import grown


def telling():
    def told(frame):
        return pd.DataFrame([(frame["sheet"].iloc[0], len(frame), float(frame["v"].sum()), ",".join(sorted(frame["s"])))] if len(frame) != 2 else [], columns=["sheet", "n", "total", "names"])

    return told


@pytest.mark.parametrize("rows", [3, 10_000])
def test_groups_in_batches(spark, rows):
    df = spark.createDataFrame([(None if k == 4 else (1 << 60) + k, None if k == 3 else float(j), f"{j}") for k in range(9) for j in range(k)], "sheet long, v double, s string")
    schema = "sheet long, n long, total double, names string"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = sheetwise(df, telling(), schema, "sheet").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(str, got)) == sorted(map(str, df.groupBy("sheet").applyInPandas(telling(), schema).collect())) and len(got) == 7


def test_no_rows(spark):
    assert sheetwise(spark.createDataFrame([], "sheet long, v double, s string"), telling(), "sheet long, n long, total double, names string", "sheet").collect() == []


def test_notes_are_read_once(spark):
    """D14 joins what it read from its sheets: the plan holds no Python work, which two sides of the join would do again."""
    assert "MapInArrow" not in grown("D14_mixed_scales", spark)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in ("F24_view_scales", "X05_extracted_tables", "D16_cover_zones", "X26_rooms_from_labels", "X25_flooded_rooms", "X27_net_rooms", "X27_sealed_doorways", "X24_faces", "X15_symbol_sweep", "X23_wall_takeoff") if n in QUERIES])
def test_python_work_is_spread(spark, name):
    assert "REPARTITION_BY_NUM" in grown(name, spark)._jdf.queryExecution().executedPlan().toString()
