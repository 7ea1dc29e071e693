"""What the operators share: written tables that cut lineage, and Arrow columns as bytes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone already
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a local one, in a local session only (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession) -> str:
    """A folder of its own in the shared one, deleted when the program ends."""
    if not _written:
        atexit.register(_drop_written)
    path = f"{shared_dir(spark).rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so that a lost executor costs one stage at most."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that no plan will read any more; the others go when the program ends."""
    for df in tables:
        entry = (df.sparkSession, df.written_path)
        if entry in _written:
            _written.remove(entry)
            _delete(*entry)


#: Keys with more than one row in so many have a join of their own: there are no more such keys than this.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, side: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """rows joined to side, which has a row for each key, on key: the hot keys' rows meet a broadcast of at most HOT_SHARE rows and
    stay where they are, the others are shuffled. total: how many rows there are about, counted if it isn't said. rows are read
    several times, so they should be written or cheap."""
    counts = rows.groupBy(F.col(key).alias("hot_key")).agg(F.count("*").alias("hot_rows"))
    total = rows.count() if total is None else total
    hot = counts.where(F.col("hot_rows") * HOT_SHARE > total).select("hot_key")
    few = F.broadcast(hot)
    warm = rows.join(F.broadcast(side.join(few, F.col(key) == F.col("hot_key"), "left_semi")), key)
    cold = rows.join(few, F.col(key) == F.col("hot_key"), "left_anti").join(side, key)
    return warm.unionByName(cold)


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct, so that none of their names can clash with another's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(rows: pa.StructArray, names: list[str]) -> dict[str, pa.Array]:
    return dict(zip(names, rows.flatten()))


def ship(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package from wherever the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch to a Python worker: long texts make thousands of them large.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session sets a size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """Gives a worker's freed memory back to the system: the next stage may run in another worker of the same executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def texts(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null: empty), so that other columns, whatever their names, can't interfere."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def chunks(items: list[bytes], limit: int):
    """Slices of items of about limit bytes each, one item at least."""
    start = size = 0
    for i, item in enumerate(items):
        size += len(item)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(items):
        yield start, len(items)
