"""A folder for tables that a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; a local one only in a local session where that is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that goes by shuffle, never by broadcast: the planner takes rows that are exploded, or compress well, for a few MB, however many they are."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to several tasks a core, by keys: for Python work on rows that lie in one file, or that adaptive plans would merge into a few tasks because they are small."""
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def sheetwise(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *keys: str) -> DataFrame:
    """df.groupBy(keys).applyInPandas(run, schema) for many small groups: they come as runs of sorted rows, many in a batch, since a batch of its own for each costs more than its work."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, keys):
            begins = [*_begins(table, keys).tolist(), table.num_rows]
            clear = not any(c.null_count and not pa.types.is_floating(c.type) for c in table.columns)  # else a null would change the type of other groups' column
            frame = table.to_pandas() if clear else None
            found = [run(frame.iloc[a:b].reset_index(drop=True) if clear else table.slice(a, b - a).to_pandas()) for a, b in zip(begins, begins[1:])]
            found = [f for f in found if len(f)]
            if found:
                yield pa.RecordBatch.from_pandas(pd.concat(found, ignore_index=True), schema=wanted, preserve_index=False)

    wanted = to_arrow_schema(_parse_datatype_string(schema))
    return spread(df, *keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def sheetwise_rows(df: DataFrame, run: Callable[[pd.DataFrame], list[tuple]], schema: str, *keys: str) -> DataFrame:
    """sheetwise() for a run that gives rows and takes columns as they come: a frame for each group would cost more than its work."""
    wanted = to_arrow_schema(_parse_datatype_string(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, keys):
            begins, frame = [*_begins(table, keys).tolist(), table.num_rows], table.to_pandas()
            out = [row for a, b in zip(begins, begins[1:]) for row in run(frame.iloc[a:b])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*out), wanted)], schema=wanted)

    return spread(df, *keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def sheetwise_pairs(left: DataFrame, right: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], list[tuple]], schema: str, key: str) -> DataFrame:
    """run(left's rows, right's rows) of every key that left has, as rows of schema: what cogroup().applyInPandas() does, for many small groups that come in whole batches."""
    wanted = to_arrow_schema(_parse_datatype_string(schema))
    side = lambda df, n, here, there: df.select(key, F.lit(n).alias("side"), (F.struct("*") if n == 0 else F.lit(None).cast(here)).alias("a"), (F.struct("*") if n == 1 else F.lit(None).cast(there)).alias("b"))
    kinds = left.schema, right.schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, (key,)):
            table = table.combine_chunks()
            begins = np.append(_begins(table, (key,)), table.num_rows)
            mine = table["side"].to_numpy() == 0
            a, b = (pa.RecordBatch.from_struct_array(table[c].chunk(0).filter(pa.array(m))).to_pandas() for c, m in (("a", mine), ("b", ~mine)))
            until = np.append(0, np.cumsum(mine))[begins]
            out = []
            for i, j, p, q in zip(until, until[1:], begins - until, (begins - until)[1:]):
                if j > i:
                    out += run(a.iloc[i:j], b.iloc[p:q])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*out), wanted)], schema=wanted)

    rows = side(left, 0, *kinds).unionByName(side(right, 1, *kinds))
    return spread(rows, key).sortWithinPartitions(key, "side").mapInArrow(each, schema)


def _whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables that end where a group does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = _begins(pa.Table.from_batches([batch]), keys)
        if held and not _same(held[-1], batch, keys):
            yield pa.Table.from_batches(held)
            held = []
        last = int(begins[-1])
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _begins(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where groups begin in sorted rows; nulls are a group."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        code = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: tuple[str, ...]) -> bool:
    return all(a[k][a.num_rows - 1].as_py() == b[k][0].as_py() for k in keys)


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what several plans read is made once, and lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
