"""Journals and presence over several micro-batches, with replays and late rows."""

import datetime as dt
import random

import pytest

from plumbline.streaming import capture, sessions


def batches(spark, tmp_path, name, schema, files):
    """A stream of one file a batch, in the order given."""
    import os
    import time

    for k, rows in enumerate(files):
        path = f"{tmp_path}/{name}-raw-{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        part = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/{name}", exist_ok=True)
        os.rename(f"{path}/{part}", f"{tmp_path}/{name}/{k}.parquet")
        os.utime(f"{tmp_path}/{name}/{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def test_undoes_take_the_last_entries():
    e = lambda *x: (*x, *[None] * (4 - len(x)))
    assert sessions.effective([e(1, "set", "a", "1"), e(2, "set", "b", "2"), e(3, "undo"), e(4, "set", "c", "3"), e(5, "undo", None, "2")]) == []
    assert sessions.effective([e(1, "undo"), e(2, "set", "a", "1")]) == [e(2, "set", "a", "1")]


def test_journals_over_batches(spark, tmp_path):
    """Three batches with replays of earlier entries and rows that come a batch late: the same records as in order."""
    r = random.Random(1)
    every = []
    for s in ("x", "y", "z"):
        for seq in range(60):
            op = r.choice(["set", "set", "set", "delete", "undo"])
            every.append((s, seq, op, None if op == "undo" else f"r{r.randrange(6)}", str(r.randrange(1, 4)) if op == "undo" else f"v{seq}"))
    files = [[], [], []]
    for e in every:
        k = min(2, e[1] // 20)
        files[min(2, k + (r.random() < 0.15))].append(e)  # some a batch late
    files[1] += r.sample(files[0], 10)
    files[2] += r.sample(files[1], 15) + [(None, 1, "set", "a", "b"), ("x", None, "set", "a", "b")]
    for f in files:
        r.shuffle(f)
    stream = batches(spark, tmp_path, "journal", "session_id string, seq long, op string, id string, payload string", files)
    got = {(x.session_id, x.id): (x.seq, x.payload) for x in sessions.records(capture.drained(sessions.journals(stream), "journal_changes", "update")).collect()}
    want = {}
    for s in ("x", "y", "z"):
        for seq, op, i, payload in sessions.effective([e[1:] for e in every if e[0] == s]):
            want.pop((s, i), None)
            if op == "set":
                want[s, i] = (seq, payload)
    assert got == want and want


def test_presence_ends_without_a_beat(spark, tmp_path):
    t = lambda minutes: dt.datetime(2024, 1, 1, 8) + dt.timedelta(minutes=minutes)
    files = [
        [("a", t(0), "on"), ("b", t(1), "on"), ("c", t(2), "on"), (None, t(1), "on"), ("d", None, "on")],
        [("a", t(8), "busy"), ("a", t(0), "on"), ("c", t(9), "on"), ("b", t(1), "on")],  # a replay and an old beat among them
        [("a", t(17), "busy"), ("e", t(25), "on")],  # b's and c's silence shows: the watermark is at 24
        [("e", t(26), "on")],
    ]
    stream = batches(spark, tmp_path, "beats", "device string, ts timestamp, state string", files)
    rows = capture.drained(sessions.expiring_presence(stream, 60), "presence_rows", "update").collect()
    seen = {}
    for x in rows:
        seen.setdefault(x.device, []).append((x.last_seen, x.state, x.stale))
    assert [s[0] for s in seen["a"] if not s[2]] == [t(0), t(8), t(17)] and ("c" in seen and seen["c"][-1] == (t(9), "on", True))
    assert seen["b"] == [(t(1), "on", False), (t(1), "on", True)] and not any(s[2] for s in seen["a"]) and "d" not in seen


def test_empty_streams(spark, tmp_path):
    stream = batches(spark, tmp_path, "none", "session_id string, seq long, op string, id string, payload string", [[]])
    assert capture.drained(sessions.journals(stream), "no_changes", "update").count() == 0


@pytest.mark.parametrize("n", [5])
def test_old_entries_are_folded(spark, tmp_path, monkeypatch, n):
    """Beyond the tail entries are records that can't be undone; an entry as old as that comes too late."""
    files = [[("s", k, "set", f"r{k % 3}", f"v{k}") for k in range(sessions.TAIL + n)], [("s", -5, "set", "r9", "late"), ("s", 10**6, "undo", None, str(sessions.TAIL + n))]]
    stream = batches(spark, tmp_path, "long", "session_id string, seq long, op string, id string, payload string", files)
    got = {x.id: x.payload for x in sessions.records(capture.drained(sessions.journals(stream), "long_changes", "update")).collect()}
    assert got == {f"r{k % 3}": f"v{k}" for k in range(n)}
