"""Repair of conversation structure by a scan of min-plus matrices.

Roles, by their initials, must read `(s?(ua)+)?`. The automaton has four states: 0 nothing yet, 1 after s, 2 after u, 3 after a; it
may end in 0 and 3. A turn is a 4x4 matrix whose element (i, j) is the cheapest way (cost, audit) from state i to j over that
turn: inserted turns first (the insert closure), then Keep, Rerole or Delete. Elements are added by the least (cost, audit)
and multiplied by adding costs and joining audits. Two audits of one element and one cost have equally many letters for turns and
inserts, so none is the beginning of another, and the order of strings survives joining: the product is associative.
Conversations are cut wherever the range sort cuts them; pieces are multiplied within a task by a balanced tree, and
across tasks by rounds of a tree of fan-in FAN.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared

INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Pieces of a conversation that one task multiplies in a round.
FAN = 16
#: Turns whose product is remembered by their kinds.
BLOCK = 4
FRESH, ENDS = 0, (0, 3)
#: Where a role's initial leads from each state; None: not allowed there.
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ROLES = {2: "user", 3: "assistant"}
NEXT = (2, 2, 3, 2)  # where an inserted or reroled turn leads: each state allows one of user and assistant

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]


def _least(found: list[tuple[int, str]]) -> Element:
    return min(found) if found else None


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(_least([(x[0] + y[0], x[1] + y[1]) for k in range(4) if (x := row[k]) and (y := b[k][j])]) for j in range(4)) for row in a)


UNIT: Matrix = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))


def _closure() -> Matrix:
    """Any number of inserted turns: beyond three a state would come back at a higher cost."""
    one = tuple(tuple((INSERT, "I") if NEXT[i] == j else None for j in range(4)) for i in range(4))
    out, power = UNIT, UNIT
    for _ in range(3):
        power = times(power, one)
        out = tuple(tuple(_least([e for e in (x, y) if e]) for x, y in zip(p, q)) for p, q in zip(out, power))
    return out


CLOSURE = _closure()


@lru_cache(maxsize=64)
def turn_matrix(kind: str) -> Matrix:
    """kind: the role's initial and the fault: '' none, 't' truncated, 'x' must go."""
    initial, fault = kind[0], kind[1:]
    extra = TRUNCATED if fault == "t" else 0
    rows: list[list[Element]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        ways: list[tuple[int, int, str]] = [(i, DELETE, "D")]
        if fault != "x":
            ways.append((NEXT[i], REROLE + extra, "R"))
            if initial in STEP and STEP[initial][i] is not None:
                ways.append((STEP[initial][i], extra, "K"))
        for j in {w[0] for w in ways}:
            rows[i][j] = _least([(c, e) for k, c, e in ways if k == j])
    return times(CLOSURE, tuple(map(tuple, rows)))


@lru_cache(maxsize=20_000)
def _block(kinds: tuple[str, ...]) -> Matrix:
    return product([turn_matrix(k) for k in kinds])


def product(parts: list[Matrix]) -> Matrix:
    """The product in order, by a balanced tree: audits are copied once a level."""
    while len(parts) > 1:
        parts = [times(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else UNIT


def of_turns(kinds: list[str]) -> Matrix:
    return product([_block(tuple(kinds[k : k + BLOCK])) for k in range(0, len(kinds), BLOCK)])


def finished(whole: Matrix) -> tuple[int, str]:
    """The cheapest way from nothing to an end, turns inserted after the last one included."""
    last = times(whole, CLOSURE)
    return min(e for j in ENDS if (e := last[FRESH][j]))


def flat(m: Matrix) -> tuple[list[int | None], list[str | None]]:
    return [e[0] if e else None for row in m for e in row], [e[1] if e else None for row in m for e in row]


def unflat(costs: list[int | None], audits: list[str | None]) -> Matrix:
    e = [None if c is None else (int(c), a) for c, a in zip(costs, audits)]
    return tuple(tuple(e[4 * i : 4 * i + 4]) for i in range(4))


# -- turns in order -----------------------------------------------------------------------------------------------------

ORDER = ["conv_id", "turn", "role", "head", "name", "tie"]
SPACE = "\t\n\v\f\r "


def in_order(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) written in order, with blank, truncated, name (of role and text) and `at`, an order of rows over all partitions.

    Order: conv_id, turn (nulls first), role, the text's first 100 characters, then the MD5 of role and text; rows equal in all of
    these are the same to every result. The range sort cuts anywhere, within equal rows too.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("tie"))
    rows = rows.withColumns({"head": F.substring("text", 1, 100), "name": F.unhex(F.md5(F.concat(F.col("role"), F.lit("\n"), F.col("text"))))})
    solid = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv_id", "turn", "role", "text", "name", solid.alias("solid"), F.monotonically_increasing_id().alias("at"))
    return shared.written(ordered.select("conv_id", "turn", "role", "text", "name", (F.col("solid") == "").alias("blank"), (~F.col("solid").isin("", ".", "!", "?")).alias("truncated"), "at"))


def _first_seen(rows: DataFrame) -> DataFrame:
    """at of the rows whose role and text their conversation hasn't had before."""
    return rows.where("NOT blank").groupBy("conv_id", "name").agg(F.min("at").alias("first_at")).select("first_at")


SEGMENT = "conv_id long, pid long, first_at long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, distinct_turns long, edge boolean, cost long, audit string, costs array<long>, audits array<string>"
SUMS = ("turns", "blank", "duplicate", "truncated")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[dict], bool]]:
    """(partition, conversation, rows, whether another conversation of the partition lies before) in order. Rows of one piece are held, no more than the range sort put into a partition."""
    now, held, first = None, [], True
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["pid"], r["conv_id"])
            if key != now:
                if held:
                    yield (*now, held, first)
                    first = now[0] != key[0]
                now, held = key, []
            held.append(r)
    if held:
        yield (*now, held, first)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of a conversation; the first and the last of a partition are edges, which may go on beyond it."""
    out, waiting = [], None
    for pid, conv, rows, first in _pieces(batches):
        if waiting:
            waiting["edge"] |= waiting["pid"] != pid
            out.append(waiting)
        kinds = [(r["role"][0] if r["role"][:1] in STEP else "-") + ("x" if r["blank"] or r["duplicate"] else "t" if r["truncated"] else "") for r in rows]
        initials = [r["role"][:1] for r in rows]
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        m = of_turns(kinds)
        cost, audit = finished(m)
        costs, audits = flat(m)
        waiting = {
            "conv_id": conv, "pid": pid, "first_at": rows[0]["at"], "turns": len(rows), "blank": sum(r["blank"] for r in rows), "duplicate": sum(r["duplicate"] for r in rows), "truncated": sum(r["truncated"] and not r["duplicate"] for r in rows),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "first_initial": initials[0], "last_initial": initials[-1],
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "distinct_turns": len(set(turns)), "edge": first, "cost": cost, "audit": audit, "costs": costs, "audits": audits,
        }
        if len(out) >= 2000:
            yield _batch(out, SEGMENT)
            out = []
    if waiting:
        out.append(waiting | {"edge": True})
    if out:
        yield _batch(out, SEGMENT)


KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([(c, KINDS[t]) for c, t in (x.split() for x in schema.split(", "))]))


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring pieces as one; associative."""
    out = a | {k: a[k] + b[k] for k in SUMS}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last_initial"] + b["first_initial"] not in ("su", "ua", "au"))
    out["last_initial"] = b["last_initial"]
    out["distinct_turns"] = a["distinct_turns"] + b["distinct_turns"] - (a["last_turn"] is not None and a["last_turn"] == b["first_turn"])
    out["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    out["last_turn"] = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    out["costs"], out["audits"] = flat(times(unflat(a["costs"], a["audits"]), unflat(b["costs"], b["audits"])))
    out["cost"], out["audit"] = finished(unflat(out["costs"], out["audits"]))
    return out


def _round(key: tuple, table: pa.Table) -> pa.Table:
    rows = sorted(table.select([c.split()[0] for c in SEGMENT.split(", ")]).to_pylist(), key=lambda r: r["pid"])
    while len(rows) > 1:
        rows = [joined(*rows[k : k + 2]) if k + 1 < len(rows) else rows[k] for k in range(0, len(rows), 2)]
    return pa.Table.from_batches([_batch(rows, SEGMENT)])


def _tree(edges: DataFrame, most: int) -> DataFrame:
    """Each conversation of `edges` as one piece. most: the largest partition number."""
    width = 1
    while width <= most:
        width *= FAN
        edges = edges.groupBy("conv_id", F.floor(F.col("pid") / width)).applyInArrow(_round, SEGMENT)
    return edges


SLICE = "conv_id long, pid long, first_at long, audit string, state int"


def _slices(key: tuple, table: pa.Table) -> pa.Table:
    """The whole audit cut into those of the pieces, with the state in which each begins: the one whose element is the cut."""
    rows = sorted(table.to_pylist(), key=lambda r: r["pid"])
    whole, state, start, out = rows[0]["whole"], FRESH, 0, []
    for k, r in enumerate(rows):
        end, left = start, r["turns"]
        while left:
            left -= whole[end] != "I"
            end += 1
        piece = whole[start : len(whole) if k == len(rows) - 1 else end]
        out.append({"conv_id": r["conv_id"], "pid": r["pid"], "first_at": r["first_at"], "audit": piece, "state": state})
        m = unflat(r["costs"], r["audits"])
        state = next(j for j in range(4) if m[state][j] and m[state][j][1] == whole[start:end])
        start = end
    return pa.Table.from_batches([_batch(out, SLICE)])


# -- the operator -------------------------------------------------------------------------------------------------------

REPORT = ["conv_id", "turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
EDITED = "conv_id long, at long, seq int, edit string, role string, text string"


class Repaired:
    """report: a row for each conversation that has turns. edits(): every turn with its edit, inserted ones in place."""

    def __init__(self, turns: DataFrame):
        self.rows = in_order(turns)
        rows = self.rows.select("conv_id", "turn", "role", "name", "blank", "truncated", "at")
        seen = _first_seen(rows)
        thin = rows.drop("name").join(seen, F.col("at") == F.col("first_at"), "left").withColumn("duplicate", ~F.col("blank") & F.col("first_at").isNull()).withColumn("pid", F.shiftright("at", 33)).drop("first_at")
        self.segments = shared.written(thin.repartition("pid").sortWithinPartitions("at").mapInArrow(_segments, SEGMENT))
        inner, edges = self.segments.where("NOT edge"), self.segments.where("edge")
        most = edges.agg(F.max("pid")).first()[0]
        self.edges = edges
        self.whole = shared.written(_tree(edges, most or 0))
        every = inner.unionByName(self.whole)
        gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct_turns"), F.lit(0)).alias("gaps")
        self.report = every.withColumn("gaps", gaps).select(*REPORT)

    def edits(self, whole: bool = True) -> DataFrame:
        """(conv_id, at, seq, edit, role, text): K, R, D and I turns in order of (at, seq), sorted so within partitions.

        whole: a conversation's rows are dealt to one task, which streams through them; otherwise to as many as it has pieces.
        """
        ends = self.whole.select(F.col("conv_id").alias("whole_id"), F.col("audit").alias("whole"))
        cut = self.edges.drop("audit").join(ends, F.col("conv_id").eqNullSafe(F.col("whole_id"))).drop("whole_id")
        slices = self.segments.where("NOT edge").select("conv_id", "pid", "first_at", "audit", F.lit(FRESH).alias("state")).unionByName(cut.groupBy("conv_id").applyInArrow(_slices, SLICE))
        heads = slices.select("conv_id", "pid", F.col("first_at").alias("at"), F.lit(0).alias("is_turn"), "audit", "state", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        turns = self.rows.select("conv_id", F.shiftright("at", 33).alias("pid"), "at", F.lit(1).alias("is_turn"), F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("state"), "role", "text")
        keys = ["conv_id"] if whole else ["pid"]
        both = heads.unionByName(turns).repartition(*keys).sortWithinPartitions(*(["conv_id"] if whole else []), "at", "is_turn")
        return both.mapInArrow(_edited, EDITED)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, place, state, at = "", 0, FRESH, 0

    for batch in batches:
        out: list[dict] = []
        for r in batch.select(["conv_id", "at", "is_turn", "audit", "state", "role", "text"]).to_pylist():
            seq = 0
            if not r["is_turn"]:
                letters, place, state = r["audit"], 0, r["state"]
                continue

            def inserts() -> None:
                nonlocal place, state, seq
                while place < len(letters) and letters[place] == "I":
                    state = NEXT[state]
                    out.append({"conv_id": r["conv_id"], "at": r["at"], "seq": seq, "edit": "I", "role": ROLES[state], "text": ""})
                    place += 1
                    seq += 1

            inserts()
            edit, role = letters[place], r["role"]
            place += 1
            if edit == "R":
                state = NEXT[state]
                role = ROLES[state]
            elif edit == "K":
                state = STEP[role[0]][state]
            out.append({"conv_id": r["conv_id"], "at": r["at"], "seq": seq, "edit": edit, "role": role, "text": r["text"]})
            seq += 1
            if "I" == letters[place : place + 1] and place + _run(letters, place) == len(letters):
                inserts()  # after a conversation's last turn
        if out:
            yield _batch(out, EDITED)


def _run(letters: str, place: int) -> int:
    """How many inserts stand at this place."""
    n = 0
    while place + n < len(letters) and letters[place + n] == "I":
        n += 1
    return n


def repair(turns: DataFrame) -> Repaired:
    """Repairs conversations (conv_id, turn, role, text); other columns don't matter.

    A null role or text is one space; a null turn comes first and leaves no gap; a null conv_id is a conversation of its own. A blank
    turn has nothing but white space, a duplicate has role and text of an earlier turn, a truncated one doesn't end in . ! or ?;
    only the first of these counts. Blank and duplicate turns are deleted. Roles that begin with other letters than s, u or a can
    only be reroled or deleted. An empty table gives empty results.
    """
    return Repaired(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by crc32(`conv_id:turn`) % 20: 0 goes, 1 has no text, 2 no end marks, 3 comes twice, 4 is the user's."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


DIGEST = "conv_id long, repaired_sha256 string"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, a batch at a time: no conversation is held."""
    now, digest, lines, begun = None, None, 0, False
    for batch in batches:
        out = []
        for conv, edit, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "edit", "role", "text"))):
            if not begun or conv != now:
                if begun:
                    out.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
                now, digest, lines, begun = conv, hashlib.sha256(), 0, True
            if edit != "D":
                digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
                lines += 1
        if out:
            yield _batch(out, DIGEST)
    if begun:
        yield _batch([{"conv_id": now, "repaired_sha256": digest.hexdigest()}], DIGEST)


def digests(repaired: Repaired) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns left and inserted, as `role:text` lines. SHA-256 of a text is sequential: one task streams through a conversation."""
    return repaired.edits().mapInArrow(_hashed, DIGEST)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """The report and digest of every conv_id of the undamaged rows; one without rows after the damage has zeros, no audit and the hash of nothing."""
    fixed = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    same = lambda c: F.col("id").eqNullSafe(F.col(c))
    out = ids.join(fixed.report.withColumnRenamed("conv_id", "report_id"), same("report_id"), "left").join(digests(fixed).withColumnRenamed("conv_id", "digest_id"), same("digest_id"), "left")
    zero: Callable[[str], Column] = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    numbers = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
