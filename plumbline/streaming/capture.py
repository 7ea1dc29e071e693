"""Streams: idempotent capture of labelled shapes, a gate on schema versions, presence by heartbeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Payload versions that are taken in, and what staleness means.
CURRENT_VERSION, BEATS, FLOOR_SECONDS = 2, 3, 600


def fingerprint(*labelled: Column) -> Column:
    """Content hash of what makes a capture: geometry, role, label, quantities; times and contributors left out."""
    return F.sha1(F.to_json(F.struct(*labelled), {"ignoreNullFields": "false"}))


def gate(payloads: DataFrame, version: Column) -> tuple[DataFrame, DataFrame]:
    """(taken in, turned away): this version and the one before it pass."""
    ok = F.coalesce(version.isin(CURRENT_VERSION, CURRENT_VERSION - 1), F.lit(False))
    return payloads.where(ok), payloads.where(~ok).withColumn("reason", F.lit("unsupported schema version"))


def captured(rows: DataFrame) -> DataFrame:
    """Rows of a stream or a table once per fingerprint (fp). On a stream the state isn't bounded on purpose: a watermark
    would let old duplicates in again. A long run keeps its fingerprints in a table instead, see append_unseen."""
    return rows.dropDuplicates(["fp"])


def append_unseen(path: str):
    """For foreachBatch: appends the rows whose fp the table at path lacks; a batch that is replayed adds nothing.

    The table lies in folders by the first two digits of fp, and a batch is held against the folders of its own rows only.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["fp"]).withColumn("fp_part", F.substring("fp", 1, 2)).persist()
        try:
            parts = [r["fp_part"] for r in fresh.select("fp_part").distinct().collect()]  # 256 at most for hex fingerprints
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target) and parts:
                banked = spark.read.schema("fp string, fp_part string").parquet(path).where(F.col("fp_part").isin(parts)).select("fp")
                new = fresh.join(banked, "fp", "left_anti")
            else:
                new = fresh
            new.repartition("fp_part").write.mode("append").partitionBy("fp_part").parquet(path)  # one file a folder, not one a task
        finally:
            fresh.unpersist()

    return add


def banked(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drains what a stream of rows with fp holds now into the table at path, and returns the table."""
    schema = stream.schema
    query: StreamingQuery = stream.writeStream.foreachBatch(append_unseen(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(path)


def jsonl(rows: DataFrame) -> DataFrame:
    """Captured rows as lines of JSON, empty fields left out: write them with .write.text()."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def mirror(rows: DataFrame, path: str) -> None:
    """A whole snapshot of a table at path, by renames: readers see the old one or the new one, never a part (between two renames, none)."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{end}") for end in ("", ".new", ".old"))
    rows.write.mode("overwrite").parquet(fresh.toString())
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{target} can't be moved aside")
    if not fs.rename(fresh, target):
        raise OSError(f"{fresh} can't become {target}")
    fs.delete(old, True)


def folded(journal: DataFrame) -> DataFrame:
    """A session's records after its journal (session_id, seq, op, id, payload), of a stream or a table: the last entry of each record, deletes among
    them (op 'delete'), so that a reader can drop them. On a stream run it in update mode: state is one entry a record."""
    last = journal.groupBy("session_id", "id").agg(F.max_by(F.struct("seq", "op", "payload"), "seq").alias("last"))
    return last.select("session_id", "id", "last.seq", "last.op", "last.payload")


def corpus_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("finish_tag", "origin_method").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def presence(beats: DataFrame, device: str, now: Column, every_seconds: float) -> DataFrame:
    """Each device's latest beat, stale after three missed beats but not before ten minutes."""
    latest = beats.groupBy(device).agg(F.max("ts").alias("last_seen"), F.max_by("state", "ts").alias("state"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_seen")
    return latest.withColumn("stale", age > F.lit(max(BEATS * every_seconds, FLOOR_SECONDS)))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The rows of a stream over what is there now, as a table."""
    query: StreamingQuery = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
