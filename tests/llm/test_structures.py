"""Shards, codebooks and repaired conversations against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import dialogue, lloyd, ring

# -- the ring -----------------------------------------------------------------------------------------------------------


def plain_ring(docs, shards, slack, large):
    """Shard -> how many of which key, by a loop over keys."""
    groups = Counter((hashlib.md5((t or "").encode()).digest(), len((t or "").encode()) + 1) for _, t in docs)
    at = ring.Ring(shards)
    total = sum(size * n for (_, size), n in groups.items())
    full, least, load, out = math.ceil(total * (1 + slack) / shards), total // (shards * large), [0] * shards, defaultdict(Counter)
    big = [(name, size, n) for (name, size), n in groups.items() if size * n > least]
    for name, parts in ring.place_large(at, big, full, load).items():
        for n, s in parts:
            out[s][name] += n
    closed = {s for s in range(shards) if load[s] >= full}
    waves = defaultdict(list)
    for (name, size), n in groups.items():
        if size * n <= least:
            waves[ring.wave_of(name)].append((name, size * n))
    for w in sorted(waves):
        for name, b in waves[w]:
            s = next(s for s in at.turns[at.arc(ring.slot_of(name))] if s not in closed)
            load[s] += b
            out[s][name] += groups[(name, next(z for nm, z in groups if nm == name))]
        closed = {s for s in range(shards) if load[s] >= full}
    return out, load, full


def sharded(spark, docs, **options):
    return ring.place(spark.createDataFrame(docs, "doc_id long, text string, shard string"), **options).collect()


@pytest.mark.parametrize("large", [1024, 2])
def test_ring(spark, large):
    r = random.Random(4)
    texts = [None, "", "é" * 50, *["copy " * 9] * 300, *["x" * r.randrange(1, 400) for _ in range(100)], *[f"{k} " * r.randrange(1, 60) for k in range(1500)]]
    docs = [(k if k % 50 else None, t, "s") for k, t in enumerate(texts)] + [(7, "twice", "s")] * 2
    got = sharded(spark, docs, large=large, slack=0.01)
    want, load, full = plain_ring([(d, t) for d, t, _ in docs], 8, 0.01, large)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in docs)
    slots, bytes_of = defaultdict(list), Counter()
    for x in got:
        slots[x.shard].append(x.slot)
        bytes_of[x.shard] += x.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert [bytes_of[s] for s in range(8)] == load
    names = {zlib.crc32((t or "").encode()): hashlib.md5((t or "").encode()).digest() for _, t, _ in docs}
    have = defaultdict(Counter)
    for x in got:
        have[x.shard][names[x.text_crc32]] += 1
    assert have == want
    if large == 1024:
        assert max(load) <= full + 100 and min(load) >= full / 1.01 * 0.93


def test_ring_with_a_hot_text_and_another_shard(spark):
    docs = [(k, "hot text", None) for k in range(1000)] + [(1000 + k, f"text {k} " * 5, None) for k in range(600)]
    load = Counter()
    for x in sharded(spark, docs):
        load[x.shard] += x.size
    assert max(load.values()) - min(load.values()) < 0.03 * sum(load.values()) / 8
    df = spark.createDataFrame(docs, "doc_id long, text string, x string")
    loose = [ring.place(df.where("doc_id >= 1000"), n, slack=0.25) for n in (8, 9)]
    away = ring.moved(*loose).collect()
    assert sum(r.documents for r in away if r.to_shard == 8) > 30 and sum(r.documents for r in away) < 600 * 0.35
    assert sharded(spark, []) == []
    one = sharded(spark, [(None, None, None)])
    assert [(r.size, r.text_crc32, r.slot) for r in one] == [(1, 0, 0)]


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k % 40}", k) for k in range(200)], "doc_id long, text string, slot int")
    ring.write_shards(df, f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(k, f"t{k % 40}") for k in range(200)]
    assert all(sorted(r.slot for r in back if r.shard == s) == list(range(sum(r.shard == s for r in back))) for s in range(4))


# -- codebooks ----------------------------------------------------------------------------------------------------------


def plain_codes(rows):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8
    whole = [[math.floor(Fraction(x) * 4096) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    d, order = width // 8, sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [*kept[k][1]]))
    books, codes, errors = [], [[] for _ in kept], [0] * len(kept)
    for p in range(8):
        parts = [tuple(v[p * d : (p + 1) * d]) for v in whole]
        book = [parts[k] for k in order[:16]]
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        near = lambda x: min(range(len(book)), key=lambda e: (far(x, book[e]), e))  # noqa: B023, E731
        for _ in range(6):
            mine = defaultdict(list)
            for x in parts:
                mine[near(x)].append(x)
            book = [tuple(sum(c) // len(mine[e]) for c in zip(*mine[e])) if mine[e] else b for e, b in enumerate(book)]
        for k, x in enumerate(parts):
            codes[k].append(near(x))
            errors[k] += far(x, book[near(x)])
        books.append(book)
    sums = Counter()
    for k, e in enumerate(errors):
        sums[kept[k][2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda v: v if v < 1 << 63 else None
    return Counter((kept[k][0], "".join(f"{c:02x}" for c in codes[k]), fits(errors[k]), fits(sums[kept[k][2]]), digest) for k in range(len(kept)))


@pytest.mark.parametrize("kind", ["plain", "grid", "odd", "huge", "few", "none"])
def test_codes(spark, kind):
    g = np.random.default_rng(3)
    if kind == "plain":
        rows = [(i, v, i % 5) for i, v in enumerate(g.standard_normal((700, 32)).tolist())]
    elif kind == "grid":  # ties everywhere, and one vector most rows
        rows = [(i, (g.integers(0, 3, 16) / 4096).tolist(), None if i % 3 else 1) for i in range(400)] + [(1000 + i, [1 / 4096] * 16, 2) for i in range(500)]
    elif kind == "odd":
        rows = [(i, g.standard_normal(12 + i % 3).tolist(), 1) for i in range(60)] + [(3, None, 1), (4, [None] * 12, 1), (5, [math.nan] * 12, 1), (6, [math.inf] * 12, 1), (None, [0.5] * 12, None), (2, [0.5] * 12, None), (9, [], 1), (2, [0.5] * 12, None)]
    elif kind == "huge":
        rows = [(i, (g.standard_normal(8) * 10.0 ** (i % 40)).tolist(), i % 2) for i in range(80)]
    else:
        rows = [(5, [0.1] * 8, None), (4, [-0.1] * 8, 3)] if kind == "few" else [(1, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in lloyd.report(df).collect())
    assert got == plain_codes(rows)


def test_filtering_assigns_subtrees():
    """Clustered points: most are assigned by nodes, and all as a full search does."""
    g = np.random.default_rng(1)
    points = np.unique((g.integers(0, 16, (4000, 1)) * 5000 + g.integers(0, 300, (4000, 4))).astype(np.int64), axis=0)
    book = np.array([[k * 5000 + 150] * 4 for k in range(16)])
    tree = lloyd.Tree(points, np.ones(len(points), np.int64))
    looked = sum(len(at) for at, _, single in tree.filtered(book) if single)
    want = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert looked < len(points) / 4 and (tree.nearest(book) == want).all()
    assert (tree.totals(book)[1] == np.bincount(want, minlength=16)).all()


# -- conversations ------------------------------------------------------------------------------------------------------


def plain_repair(rows):
    """The report's columns by a table over (turn, state) with whole edit lists; rows: (turn, role, text) in order."""
    seen, kinds = set(), []
    blank = duplicate = truncated = 0
    for _, role, text in rows:
        solid = text.strip("\t\n\v\f\r ")
        fault = ""
        if not solid:
            blank, fault = blank + 1, "x"
        elif (role, text) in seen:
            duplicate, fault = duplicate + 1, "x"
        elif solid[-1] not in ".!?":
            truncated, fault = truncated + 1, "t"
        seen.add((role, text))
        kinds.append(fault)
    ok = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(ways):
        for _ in range(4):
            for state, (c, e, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    to = ok.get((state, role[0]))
                    if to is not None and ((c + 2, e + "I") < ways[to][:2] if to in ways else True):
                        ways[to] = (c + 2, e + "I", [*lines, f"{role}:"])
        return ways

    ways = {0: (0, "", [])}
    for (_, role, text), fault in zip(rows, kinds):
        after = {}

        def put(to, way):
            if to is not None and (to not in after or way[:2] < after[to][:2]):  # noqa: B023
                after[to] = way  # noqa: B023

        for state, (c, e, lines) in inserted(ways).items():
            put(state, (c + 3, e + "D", lines))
            if fault != "x":
                extra = fault == "t"
                put(ok.get((state, role[:1])), (c + extra, e + "K", [*lines, f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    put(ok.get((state, new[0])), (c + 2 + extra, e + "R", [*lines, f"{new}:{text}"]))
        ways = after
    cost, audit, lines = min(w for s, w in inserted(ways).items() if s in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if harm == 1 else text.translate({ord(c): None for c in ".!?"}) if harm == 2 else text
        if harm:
            by[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {conv: plain_repair(sorted(mine, key=key)) for conv, mine in by.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def talk(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ünknown"]
    texts = ["Yes.", "No", "Why?\n", " ", "", None, "end ", "So. it goes!\t", "a b"]
    return [(r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"{seed} {r.random()}" + r.choice([".", "", "? "])) for _ in range(n)]


def conversations():
    rows = [(c, t if c % 7 else t * 2, role, text) for c in range(60) for t, (role, text) in enumerate(talk(c, c % 13))]
    rows += [(None, None if t % 2 else t, role, text) for t, (role, text) in enumerate(talk(99, 9))]
    rows += [(500, t // 2, role, text) for t, (role, text) in enumerate(talk(500, 400))]
    rows += [(501, None, "user", "same words.")] * 300
    return rows


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_conversations(spark, partitions):
    """40 partitions cut the long conversations, and the equal rows of one, into many pieces."""
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("x")).withColumn("at", F.lit(0)).repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in dialogue.damage_and_repair(df).collect()}
        fixed = dialogue.repair(df)
        edits, report = fixed.edits(whole=False).orderBy("conv_id", "at", "seq").collect(), {r.conv_id: r for r in fixed.report.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_damage(rows)
    letters = defaultdict(str)
    initials = defaultdict(str)
    for e in edits:
        letters[e.conv_id] += e.edit
        initials[e.conv_id] += "" if e.edit == "D" else e.role[0]
    assert {c: r.audit for c, r in report.items()} == dict(letters)
    assert all(re.fullmatch("(s?(ua)+)?", s) for s in initials.values())


def test_conversations_without_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.damage_and_repair(df).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    r = dialogue.damage_and_repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], df.schema)).collect()
    assert [tuple(x) for x in r] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_matrices_are_associative():
    r = random.Random(0)
    kinds = [i + f for i in "sua-" for f in ("", "t", "x")]
    for _ in range(30):
        mine = [r.choice(kinds) for _ in range(9)]
        left = dialogue.UNIT
        for k in mine:
            left = dialogue.times(left, dialogue.turn_matrix(k))
        assert left == dialogue.of_turns(mine)
