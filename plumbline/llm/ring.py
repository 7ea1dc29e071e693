"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A document's key is its text, so that equal texts go on together. The ring has SLOTS places; each shard stands at NODES of them.
A key starts at its own place and goes clockwise to the first shard that isn't full: a shard is full once it holds (1 + slack) of
an equal share of all bytes. Keys of more than 1/LARGE of a share come first, the largest before the others; there are at most
shards * LARGE of them, so the driver places them. All others come in 2**17 waves by further bits of their hash, and a shard
is closed after the wave that fills it. Which wave that is follows from a table of bytes by (coarse wave, arc) and, for
the coarse waves in which a shard fills, by (fine wave, arc): both bounded by constants, whatever the rows.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import shared

SLOTS = 1 << 16
NODES = 128
SLACK = 0.002
LARGE = 1024
COARSE, FINE = 256, 512
SCHEMA_LARGE = "large_name binary, large_counts array<long>, large_shards array<int>"


class Ring:
    """The shards' places. More shards add places and leave the others where they are."""

    def __init__(self, shards: int, nodes: int = NODES):
        placed: dict[int, int] = {}
        for shard in range(shards):
            for k in range(nodes):
                place = int(hashlib.md5(f"{shard}:{k}".encode()).hexdigest()[:4], 16)
                placed.setdefault(place, shard)  # of two shards at one place the elder stays
        self.shards, self.places = shards, sorted(placed)
        owners = [placed[p] for p in self.places]
        self.turns = []  # for each arc, all shards in the order in which a key meets them
        for i in range(len(owners)):
            met = dict.fromkeys(owners[i:] + owners[:i])
            self.turns.append([*met, *(s for s in range(shards) if s not in met)])

    def arc(self, slot: int) -> int:
        return bisect.bisect_left(self.places, slot) % len(self.places)

    def targets(self, closed: set[int]) -> np.ndarray:
        """Each arc's first open shard."""
        return np.array([next(s for s in turn if s not in closed) for turn in self.turns])


def slot_of(name: bytes) -> int:
    return int.from_bytes(name[:2], "big")


def wave_of(name: bytes) -> int:
    return int.from_bytes(name[4:8], "big") >> 15


def place_large(ring: Ring, groups: list[tuple[bytes, int, int]], full: int, load: list[int]) -> dict[bytes, list[tuple[int, int]]]:
    """{name: [(documents, shard)]} of groups (name, size of a document, documents), the largest first; load is added to.

    A group goes whole to the first shard clockwise that has room for it. If none has, its documents fill what room there is,
    clockwise; what has room nowhere goes, one document at a time, to the emptiest shard.
    """
    out = {}
    for name, size, n in sorted(groups, key=lambda g: (-g[1] * g[2], g[0])):
        turn = ring.turns[ring.arc(slot_of(name))]
        whole = next((s for s in turn if load[s] + size * n <= full), None)
        parts: list[tuple[int, int]] = []
        if whole is not None:
            parts, rest = [(n, whole)], 0
        else:
            rest = n
            for s in turn:
                k = max(0, min(rest, (full - load[s]) // size))
                if k:
                    parts.append((k, s))
                    rest -= k
        for k, s in parts:
            load[s] += k * size
        while rest:
            s = min(turn, key=load.__getitem__)
            parts.append((1, s))
            load[s] += size
            rest -= 1
        out[name] = parts
    return out


def close_waves(ring: Ring, coarse: np.ndarray, fine: Callable[[int], np.ndarray], full: int, load: list[int]) -> tuple[list[int], list[set[int]]]:
    """(waves after which shards close, the closed shards before the first, after the first and so on). coarse: bytes by coarse wave and arc; fine(w): by fine wave of w and arc."""
    closed = {s for s in range(ring.shards) if load[s] >= full}
    ends, states = [], [set(closed)]
    target = ring.targets(closed)

    def added(row: np.ndarray) -> list[int]:
        return [a + int(b) for a, b in zip(load, np.bincount(target, row, ring.shards))]

    for w in np.flatnonzero(coarse.sum(1)):
        after = added(coarse[w])
        if not any(after[s] >= full for s in range(ring.shards) if s not in closed):
            load[:] = after
            continue
        rows = fine(int(w))
        for k in np.flatnonzero(rows.sum(1)):
            load[:] = added(rows[k])
            now = {s for s in range(ring.shards) if load[s] >= full}
            if now != closed:
                ends.append(int(w) * FINE + int(k))
                states.append(now)
                closed = now
                if len(closed) < ring.shards:
                    target = ring.targets(closed)
    return ends, states


def _hex_long(name: Column, start: int, length: int) -> Column:
    return F.conv(F.hex(F.substring(name, start, length)), 16, 10).cast("long")


def _measured(docs: DataFrame, whole_rows: bool) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("name"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *([shared.packed(docs).alias("row")] if whole_rows else []))
    return shared.written(rows)


def _histogram(small: DataFrame, by: Column, height: int, arcs: int) -> np.ndarray:
    """Bytes by wave and arc: at most height * arcs rows, both constants."""
    rows = small.groupBy(by.alias("w"), "arc").agg(F.sum("bytes").alias("bytes")).toArrow()
    out = np.zeros((height, arcs))
    out[rows["w"].to_numpy(), rows["arc"].to_numpy()] = np.array([float(b) for b in rows["bytes"].to_pylist()])
    return out


def place(docs: DataFrame, shards: int = 8, slack: float = SLACK, large: int = LARGE, nodes: int = NODES, whole_rows: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of docs in one of `shards` shards of near equal bytes, with a gapless number in it.

    size is the text's UTF-8 bytes plus 1. Equal texts share a shard unless it is full (or they are more than a shard). No shard
    holds more than (1 + slack) of an equal share plus the keys of one wave, or plus one document that is larger than what room is left.
    Null text counts as empty; null and repeated doc_ids are documents like all others; empty docs give no rows. whole_rows:
    the column `row` holds all columns of docs. Rows equal in doc_id and text may swap their slots between runs.
    """
    rows = _measured(docs, whole_rows)
    spark = rows.sparkSession
    ring = Ring(shards, nodes)
    groups = shared.written(rows.groupBy("name", "size").agg(F.count("*").alias("n")).withColumn("bytes", F.col("size").cast("decimal(38,0)") * F.col("n")))
    total = int(groups.agg(F.sum("bytes")).first()[0] or 0)
    full = max(1, int(-(-total * (1 + slack) // shards)))
    least = total // (shards * large)
    big = [(bytes(r.name), r.size, r.n) for r in groups.where(F.col("bytes") > least).select("name", "size", "n").collect()]  # at most shards * large, their bytes add up to the total
    load = [0] * shards
    placed = place_large(ring, big, full, load)

    arcs = spark.createDataFrame([(s, ring.arc(s)) for s in range(SLOTS)], "slot_key int, arc int")
    slot = _hex_long(F.col("name"), 1, 2).cast("int")
    wave = F.shiftright(_hex_long(F.col("name"), 5, 4), 15).cast("int")
    small = groups.where(F.col("bytes") <= least).select("bytes", slot.alias("slot_key"), wave.alias("wave")).join(F.broadcast(arcs), "slot_key")
    coarse = _histogram(small, (F.col("wave") / FINE).cast("int"), COARSE, len(ring.places))
    ends, states = close_waves(ring, coarse, lambda w: _histogram(small.where((F.col("wave") / FINE).cast("int") == w), F.col("wave") % FINE, FINE, len(ring.places)), full, load)

    # range order: copies lie together, and even equal rows of one text are dealt over partitions
    keys = ["name", "doc_id", "tie"]
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = shared.written(ordered.drop("tie").withColumn("at", F.monotonically_increasing_id())).withColumn("pid", F.shiftright("at", 33))

    parts = [(bytearray(k), [n for n, _ in v], [s for _, s in v]) for k, v in placed.items()]
    heavy = F.broadcast(spark.createDataFrame(parts, SCHEMA_LARGE))
    split = [(bytearray(k),) for k, v in placed.items() if len(v) > 1]
    began = ordered.join(F.broadcast(spark.createDataFrame(split, "name binary")), "name", "left_semi").groupBy("name", "pid").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    before = Window.partitionBy("name").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    began = began.select("name", "pid", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_at")).alias("shift"))  # a row for each partition and split group

    table = [(i, a, int(t)) for i, closed in enumerate(states) if len(closed) < shards for a, t in enumerate(ring.targets(closed))]
    light = F.broadcast(spark.createDataFrame(table, "phase int, arc int, open_shard int"))
    phase = sum([(F.col("wave") > e).cast("int") for e in ends], F.lit(0)).cast("int")
    met = ordered.withColumn("slot_key", slot).withColumn("wave", wave).withColumn("phase", phase).join(F.broadcast(arcs), "slot_key").join(light, ["phase", "arc"], "left")
    met = met.join(heavy, F.col("name") == F.col("large_name"), "left").join(began, ["name", "pid"], "left")
    rank = F.col("at") + F.coalesce(F.col("shift"), -F.col("at"))
    sums = F.transform(F.sequence(F.lit(1), F.size("large_counts")), lambda k: F.aggregate(F.slice("large_counts", 1, k), F.lit(0).cast("long"), lambda a, b: a + b))
    within = F.least(F.size(F.filter(sums, lambda c: c <= rank)), F.size("large_shards") - 1)
    shard = F.when(F.col("large_name").isNotNull(), F.get("large_shards", within)).otherwise(F.col("open_shard"))
    dealt = shared.written(met.select("doc_id", "size", "text_crc32", *(["row"] if whole_rows else []), "at", "pid", shard.cast("int").alias("shard")))

    counts = dealt.groupBy("pid", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("pid", "shard").orderBy("at"))
    return dealt.withColumn("number", number).join(offsets, ["pid", "shard"]).select("doc_id", "size", "text_crc32", *(["row"] if whole_rows else []), "shard", (F.col("offset") + F.col("number") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, rows_a_file: int = 100_000, **options: float) -> None:
    """All columns of docs as Parquet, a folder for each shard (shard=0, ...), rows by slot. Columns called shard or slot are replaced."""
    dealt = place(docs, shards, whole_rows=True, **options)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    rows = dealt.select(*kept, "shard", "slot").withColumn("file", F.floor(F.col("slot") / rows_a_file))
    rows.repartition("shard", "file").sortWithinPartitions("shard", "slot").drop("file").write.partitionBy("shard").parquet(path)


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(from_shard, to_shard, documents, bytes): what lies elsewhere in the second of two results of place over documents of distinct doc_id."""
    pairs = before.select("doc_id", "size", F.col("shard").alias("from_shard")).join(after.select("doc_id", F.col("shard").alias("to_shard")), "doc_id")
    return pairs.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("documents"), F.sum("size").alias("bytes"))
