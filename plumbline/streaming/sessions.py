"""Sessions and devices with state of their own on a stream: a journal that can be undone, and presence that ends without a new beat.

State is kept by key in RocksDB, so it isn't bounded by memory. A journal keeps its last TAIL entries as they came; what is older is folded into records and
can't be undone any more. Replayed batches and late rows change nothing that in-order rows wouldn't have given, as far back as the tail goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.streaming.capture import BEATS, FLOOR_SECONDS

#: Entries of a session that an undo or a late row can reach.
TAIL = 1000
ENTRY, CHANGE = "seq long, op string, id string, payload string", "session_id string, id string, seq long, op string, payload string, version long"
BEAT, SEEN = "at long, ts timestamp, state string", "device string, last_seen timestamp, state string, stale boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def effective(entries: list[tuple[int, str, str | None, str | None]]) -> list[tuple[int, str, str | None, str | None]]:
    """What is left of entries (seq, op, id, payload) in order: each undo takes away the last payload (a number, 1 if none) entries that are still there."""
    left: list[tuple] = []
    for e in entries:
        if e[1] == "undo":
            n = int(e[3]) if e[3] else 1
            left = left[: max(0, len(left) - n)]
        else:
            left.append(e)
    return left


class Journal(StatefulProcessor):
    """Sets, deletes and undoes of one session; gives the records that a batch changed, each with the session's count of batches as its version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", "horizon long, version long")
        self.tail = handle.getListState("tail", ENTRY)
        self.records = handle.getMapState("records", "id string", "seq long, payload string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        horizon, version = self.meta.get() if self.meta.exists() else (-(1 << 62), 0)
        before = [tuple(e) for e in self.tail.get()]
        every = {e[0]: e for e in before}
        for frame in rows:
            for e in frame[["seq", "op", "id", "payload"]].itertuples(index=False, name=None):
                e = (int(e[0]), *(None if v is None or v != v else str(v) for v in e[1:]))
                if e[0] > horizon:
                    every.setdefault(e[0], e)
        if len(every) == len(before):
            return
        entries = [every[s] for s in sorted(every)]
        shown = self._shown(effective(before), {e[2] for e in entries})
        now = self._shown(effective(entries), set(shown))
        if len(entries) > TAIL:  # fold what no undo in the tail can reach any more
            old, entries = entries[:-TAIL], entries[-TAIL:]
            kept = {e[0] for e in effective([*old, *entries])}
            reach = [e for e in old if e[0] in kept and e[1] != "undo"]
            for e in reach:
                if e[1] == "delete":
                    if self.records.containsKey((e[2],)):
                        self.records.removeKey((e[2],))
                else:
                    self.records.updateValue((e[2],), (e[0], e[3]))
            horizon = old[-1][0]
        self.tail.put(entries)
        self.meta.update((horizon, version + 1))
        changed = [(str(key[0]), i, seq, op, payload, version + 1) for i, (seq, op, payload) in now.items() if shown[i] != now[i]]
        yield pd.DataFrame(changed, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def _shown(self, left: list[tuple], ids: set[str | None]) -> dict[str | None, tuple]:
        """(seq, op, payload) of each record: set, delete, or none where nothing is known of it."""
        out = {}
        for i in ids - {None}:
            folded = tuple(self.records.getValue((i,))) if self.records.containsKey((i,)) else None
            out[i] = (folded[0], "set", folded[1]) if folded else (None, "none", None)
        for seq, op, i, payload in left:
            if i in out:
                out[i] = (seq, op, payload if op == "set" else None)
        return out

    def close(self) -> None:
        pass


class Presence(StatefulProcessor):
    """One device's latest beat; a timer says when it is stale, and a later one forgets it."""

    def __init__(self, limit_ms: int, forget_ms: int) -> None:
        self.limit_ms, self.forget_ms = limit_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", BEAT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        best = before = tuple(self.last.get()) if self.last.exists() else None
        for frame in rows:
            for at, ts, state in frame[["at", "ts", "state"]].dropna(subset=["at"]).itertuples(index=False, name=None):
                if best is None or at > best[0]:
                    best = (int(at), pd.Timestamp(ts).to_pydatetime(), state)
        if best is None or (before and best[0] == before[0]):
            return  # nothing new: replayed or late beats
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best[0] + self.limit_ms)
        self.handle.registerTimer(best[0] + self.forget_ms)
        self.last.update(best)
        yield pd.DataFrame([(str(key[0]), best[1], best[2], False)], columns=["device", "last_seen", "state", "stale"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        at, ts, state = self.last.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= at + self.forget_ms:
            self.last.clear()
        yield pd.DataFrame([(str(key[0]), ts, state, True)], columns=["device", "last_seen", "state", "stale"])

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> None:
    """State that these processors need lies in RocksDB; a session that names a provider of its own keeps it."""
    if spark.conf.get(PROVIDER, "HDFSBackedStateStoreProvider").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def journals(stream: DataFrame) -> DataFrame:
    """Changes (session_id, id, seq, op, payload, version) of records from a stream of (session_id, seq, op: set, delete or undo, id, payload). op is none where nothing is left of a
    record. Entries of one session are told apart by seq; entries without one, or without a session, are left out; the record with id null isn't one."""
    stateful(stream.sparkSession)
    rows = stream.where("session_id IS NOT NULL AND seq IS NOT NULL").select(*[F.col(c).cast(t).alias(c) for c, t in (("session_id", "string"), ("seq", "long"), ("op", "string"), ("id", "string"), ("payload", "string"))])
    return rows.groupBy("session_id").transformWithStateInPandas(Journal(), CHANGE, "Update", "None")


def records(changes: DataFrame) -> DataFrame:
    """The records that changes leave: the last of each, deleted and undone ones not."""
    last = changes.groupBy("session_id", "id").agg(F.max_by(F.struct("seq", "op", "payload"), "version").alias("last"))
    return last.where("last.op = 'set'").select("session_id", "id", "last.seq", "last.payload")


def expiring_presence(beats: DataFrame, every_seconds: float, late: str = "1 minute", forget_seconds: float = 86_400) -> DataFrame:
    """(device, last_seen, state, stale) from a stream of beats (device, ts, state): a row for each new latest beat, and one with stale once the watermark (so late behind the newest beat
    of all) has passed BEATS missed ones, or FLOOR_SECONDS; nothing need come from the device for that. After forget_seconds its state goes."""
    stateful(beats.sparkSession)
    limit = int(max(BEATS * every_seconds, FLOOR_SECONDS) * 1000)
    rows = beats.where("device IS NOT NULL").select(F.col("device").cast("string").alias("device"), F.col("ts").cast("timestamp").alias("ts"), F.col("state").cast("string").alias("state")).withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("device").transformWithStateInPandas(Presence(limit, max(limit, int(forget_seconds * 1000))), SEEN, "Update", "EventTime")
