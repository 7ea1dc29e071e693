"""URL rules by a cascade of Bloom filters.

The universe is every key that a url of the corpus can look up: each suffix of its host with each prefix of its path as
long as some rule's path. The first level encodes the listed keys; the second the universe's keys that pass the first
without being listed; the third the listed keys that pass the second, and so on until a level lets none through. A key
of the universe is listed exactly if it fails first at an even level: membership is exact without a join.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared

#: Chance of a false positive at the first level and at the others, and bytes up to which a level may be broadcast.
FIRST_RATE, LATER_RATE, MOST_BYTES = 0.01, 0.5, 256 << 20
MOST_LEVELS = 64


def key_hash(key: bytes, level: int) -> tuple[int, int]:
    digest = hashlib.blake2b(key, digest_size=16, salt=level.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1


@dataclass
class Level:
    number: int
    bits: int
    hashes: int
    data: np.ndarray

    @classmethod
    def sized(cls, number: int, keys: int, rate: float) -> Level:
        bits = max(64, 8 * math.ceil(keys * -math.log(rate) / math.log(2) ** 2 / 8))
        if bits // 8 > MOST_BYTES:
            raise ValueError(f"level {number} needs {bits // 8} bytes; split the listed keys by hash and build a cascade for each part")
        return cls(number, bits, max(1, round(-math.log2(rate))), np.zeros(bits // 8, np.uint8))

    def places(self, key: bytes) -> list[int]:
        a, b = key_hash(key, self.number)
        return [(a + i * b) % (1 << 64) % self.bits for i in range(self.hashes)]

    def add(self, key: bytes) -> None:
        for p in self.places(key):
            self.data[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: bytes) -> bool:
        return all(self.data[p >> 3] >> (p & 7) & 1 for p in self.places(key))


class Cascade:
    """Exact for the keys of the universe it was built over."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def __contains__(self, key: bytes) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def _filled(keys: DataFrame, level: Level) -> Level:
    """The level with all keys: each task fills a filter of its own, filters are merged by pieces in Spark, and the driver gets each piece once."""
    piece = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Level(level.number, level.bits, level.hashes, np.zeros_like(level.data))
        for batch in batches:
            for key in batch["key"].to_pylist():
                own.add(key)
        used = [k for k in range(0, len(own.data), piece) if own.data[k : k + piece].any()]
        yield pa.record_batch({"piece": pa.array(used, pa.int64()), "data": pa.array([own.data[k : k + piece].tobytes() for k in used], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        data = np.bitwise_or.reduce([np.frombuffer(d.as_py(), np.uint8) for d in table["data"]])
        return pa.table({"piece": table["piece"].slice(0, 1), "data": pa.array([data.tobytes()], pa.binary())})

    for row in keys.select("key").mapInArrow(run, "piece long, data binary").groupBy("piece").applyInArrow(merged, "piece long, data binary").toLocalIterator():
        part = np.frombuffer(row["data"], np.uint8)
        level.data[row["piece"] : row["piece"] + len(part)] |= part
    return level


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed, universe: (key binary). Null keys are no keys; a listed key outside the universe is encoded too."""
    inside = listed.where("key IS NOT NULL").select("key").distinct()
    outside = universe.where("key IS NOT NULL").select("key").distinct().join(inside, "key", "left_anti")
    levels: list[Level] = []
    sides = [inside, outside]
    n = inside.count()
    while n and len(levels) < MOST_LEVELS:
        k = len(levels)
        levels.append(_filled(sides[k % 2], Level.sized(k, n, FIRST_RATE if k == 0 else LATER_RATE)))
        level = levels[-1]

        def passing(batches: Iterator[pa.RecordBatch], level: Level = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch({"key": pa.array([x for x in batch["key"].to_pylist() if x in level], pa.binary())})

        sides[1 - k % 2] = sides[1 - k % 2].mapInArrow(passing, "key binary")
        n = sides[1 - k % 2].count()
    if n:
        raise ValueError("the cascade doesn't end")
    return Cascade(levels)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; null, or no ://: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def lookup_keys(host: str, path: str, lengths: list[int], labels: list[int]) -> list[str]:
    """Keys that a url looks up, as host then path, longest first (ties: the longer host): a rule's host has as many labels as some of `labels`,
    so no other end of the url's host is made, however long it is."""
    last = host.rsplit(".", max(labels, default=0))
    hosts = [".".join(last[-n:]) for n in labels if n <= len(last)]
    keys = {h + path[:n] for h in hosts if h for n in lengths if n <= len(path) and path[:1] == "/"}
    return sorted(keys, key=lambda k: (-len(k), -k.index("/")))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], fallback: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; rules: (allow or block, host/path).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins. Where none fits,
    the cascade says that no key of the url is listed, and the verdict is fallback. Repeated rows and null ids keep rows
    of their own, an empty table gives none; a null url, or one without ://, has neither host nor path and no rule.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    lengths, labels = sorted({len(r) - r.index("/") for _, r in rules}), sorted({r[: r.index("/")].count(".") + 1 for _, r in rules})
    spark = pages.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {k.encode() for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist()) for k in lookup_keys(h, p, lengths, labels)}
            yield pa.record_batch({"key": pa.array(list(keys), pa.binary())})

    universe = shared.written(parsed.select("host", "path").mapInArrow(keyed, "key binary").distinct())
    verdicts = {}
    for verdict in ("block", "allow"):
        listed = spark.createDataFrame([(bytearray(r.encode()),) for v, r in rules if v == verdict], "key binary")
        verdicts[verdict] = build_cascade(listed, universe)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for batch in batches:
            found, said = [], []
            for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist()):
                rule, verdict = None, fallback
                for key in lookup_keys(h, p, lengths, labels):
                    if key not in known:
                        if len(known) > 500_000:
                            known.clear()
                        known[key] = next((v for v, cascade in verdicts.items() if key.encode() in cascade), None)
                    if known[key]:
                        rule, verdict = key, known[key]
                        break
                found.append(rule)
                said.append(verdict)
            yield pa.record_batch({**{n: batch[n] for n in ("page_id", "host", "path")}, "rule": pa.array(found, pa.string()), "verdict": pa.array(said, pa.string())})

    return parsed.mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string")


#: The rules of the query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
