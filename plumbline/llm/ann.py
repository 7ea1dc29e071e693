"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes nearest on the unit sphere: rows are scaled by the greatest norm and given one more
component that makes them unit vectors, queries are scaled to unit length. Each table hashes by projections whose number
grows with the logarithm of the rows, cut into SLOTS slots floor((a.x + b) / w). A query visits a table's cells in the
order of the estimated chance that they hold its near neighbours until those chances add up to a share; the share is the
one at which the true neighbours of MEASURED queries, found among all rows, are found with the target recall. Candidates
of all tables are scored exactly and merged. Equal vectors are indexed once, with their least ids.

Index rows lie in parts, a few parts make a group. A query's vector travels once to each group that holds a cell it
visits, with the list of its parts there; a task holds one group's rows and streams the queries past them in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import shared

TABLES, SLOTS, TARGET = 4, 3, 0.95
#: Projections of a table: so many that a cell has ROWS_IN_CELL rows, within these bounds (at most 3**11 cells are enumerated).
LEAST_WIDE, MOST_WIDE, ROWS_IN_CELL = 8, 11, 16
#: Rows that projections are fitted on, and those of them whose neighbours among all rows give the expected nearness.
SAMPLE, MEASURED = 2048, 200
#: Index rows in a part, most parts in a group, and queries in a block.
PART_ROWS, GROUP_PARTS, QUERY_BLOCK = 4096, 8, 256
#: Cells times queries whose chances are held at a time, and queries whose results a task holds before it hands them on.
MOST_CHANCES, MOST_HELD = 1 << 21, 10_000
_SEED = 97
_normal = np.vectorize(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))), otypes=[float])


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists of one length, none null."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def wide_for(rows: int) -> int:
    return min(MOST_WIDE, max(LEAST_WIDE, math.ceil(math.log(max(rows, 1) / ROWS_IN_CELL, SLOTS))))


class Tables:
    """Projections, cuts, and the chances of cells."""

    def __init__(self, sample: np.ndarray, greatest: float, near: float, lift: float, wide: int = LEAST_WIDE) -> None:
        random = np.random.default_rng(_SEED)
        self.wide = wide
        self.greatest, self.near, self.share = greatest, min(max(near, 0.0), 0.999), 1.0
        self.lift = min(lift, math.sqrt(max(0.0, 0.999 - self.near**2)))  # the neighbours' added component
        self.planes = random.standard_normal((TABLES, sample.shape[1] + 1, wide))
        projected = np.einsum("nd,tdk->tnk", self.lifted(sample), self.planes)
        spread = np.maximum(projected.std(1), 1e-9)
        self.width = 0.86 * spread  # w: three slots of about equal shares
        self.shift = self.width / 2 - projected.mean(1)  # b

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        rows = rows / self.greatest
        return np.column_stack([rows, np.sqrt(np.maximum(1 - (rows * rows).sum(1), 0))])

    def cells(self, rows: np.ndarray) -> np.ndarray:
        """(table, row): the cell of each row."""
        at = np.floor((np.einsum("nd,tdk->tnk", self.lifted(rows), self.planes) + self.shift[:, None]) / self.width[:, None])
        slot = np.clip(at + 1, 0, SLOTS - 1).astype(np.int64)
        return (slot * SLOTS ** np.arange(self.wide)).sum(2)

    def slot_chances(self, queries: np.ndarray) -> np.ndarray:
        """(table, query, slot, projection): chances that a near neighbour's projection falls into the slot."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        projected = np.einsum("nd,tdk->tnk", np.column_stack([unit, np.zeros(len(unit))]), self.planes)
        edge = (np.arange(SLOTS - 1)[:, None] * self.width[:, None] - self.shift[:, None])[:, None]
        mean = self.near * projected[:, :, None] + self.lift * self.planes[:, None, None, -1]
        below = _normal((edge - mean) / math.sqrt(1 - self.near**2 - self.lift**2))
        ends = np.ones_like(below[:, :, :1])
        return np.diff(np.concatenate([0 * ends, below, ends], 2), axis=2)

    def calibrate(self, queries: np.ndarray, asked: np.ndarray, neighbours: np.ndarray) -> None:
        """Sets the share of chances at which the target recall of (queries[asked[i]], neighbours[i]) is reached."""
        slots, cells, every = self.slot_chances(queries), self.cells(neighbours), np.arange(SLOTS**self.wide)
        needed = np.ones(len(asked))
        step = max(1, MOST_CHANCES // len(every))
        for t in range(TABLES):
            for first in range(0, len(queries), step):
                chance = self.cell_chances(slots[t][first : first + step], every)
                order = np.argsort(-chance, axis=1, kind="stable")
                mass = np.cumsum(np.take_along_axis(chance, order, 1), 1)
                mine = np.flatnonzero((asked >= first) & (asked < first + step))
                who = asked[mine] - first
                place = np.argsort(order, axis=1)[who, cells[t][mine]]
                needed[mine] = np.minimum(needed[mine], np.where(place > 0, mass[who, place - 1], 0.0))
        self.share = float(np.quantile(needed, TARGET, method="higher")) + 1e-9

    @staticmethod
    def cell_chances(slot: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """(query, cell) of one table's slot chances."""
        out = np.ones((len(slot), len(cells)))
        for k in range(slot.shape[2]):
            out *= slot[:, :, k][:, cells // SLOTS**k % SLOTS]
        return out


class Directory:
    """How many rows each cell holds, and the parts its rows lie in: cells share parts, a hot cell has several."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts  # (table, cell)
        self.first, self.parts = np.zeros_like(counts), np.maximum(1, -(-counts // PART_ROWS))
        part = 0
        for t in range(len(counts)):
            filled = 0
            for cell in np.flatnonzero(counts[t]):
                n = counts[t, cell]
                if filled and filled + n > PART_ROWS:
                    part, filled = part + 1, 0
                self.first[t, cell] = part
                filled += n
                if self.parts[t, cell] > 1:
                    part, filled = part + self.parts[t, cell], 0
            part += 1


def _top(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the most greatest finite scores, ties to the smaller id."""
    if len(score) > most:
        least = -np.partition(-score, most - 1)[most - 1]
        at = np.flatnonzero((score >= least) & (score > -np.inf))
    else:
        at = np.flatnonzero(score > -np.inf)
    return at[np.lexsort((ids[at], -score[at]))][:most]


def _dots(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.einsum("qd,nd->qn", queries, rows)  # sums in one order, whatever the shapes


def _measured(sample: np.ndarray, ids: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vid, rows = np.array(batch["vid"]), matrix(batch["vec"])
            norm = float(np.linalg.norm(rows, axis=1).max())
            score = _dots(sample, rows)
            number, found, which = [], [], []
            for i in range(len(sample)):
                score[i][vid == ids[i]] = -np.inf
                at = _top(score[i], vid, most)
                number += [i] * len(at)
                found += score[i][at].tolist()
                which += at.tolist()
            vec = batch["vec"].take(pa.array([*which, None], pa.int64()))
            yield pa.record_batch({"i": pa.array([*number, -1], pa.int64()), "score": pa.array([*found, norm], pa.float64()), "vec": vec})

    return run


def _celled(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((TABLES, SLOTS**tables.wide), np.int64)
        for batch in batches:
            if batch.num_rows:
                for t, cells in enumerate(tables.cells(matrix(batch["vec"]))):
                    counts[t] += np.bincount(cells, minlength=SLOTS**tables.wide)
        t, cell = np.nonzero(counts)
        yield pa.record_batch({"t": pa.array(t), "cell": pa.array(cell), "n": pa.array(counts[t, cell])})

    return run


_PLACED = "grp long, kind int, part long, t int, vid long, cell long, vec array<double>, ids array<long>, parts array<long>, cuts array<double>"


def _placed(n: int, kind: int, vec: pa.Array, vid: pa.Array, **columns) -> pa.RecordBatch:
    types = {"grp": pa.int64(), "part": pa.int64(), "t": pa.int32(), "cell": pa.int64(), "ids": pa.list_(pa.int64()), "parts": pa.list_(pa.int64()), "cuts": pa.list_(pa.float64())}
    made = {c: pa.nulls(n, kind_) if columns.get(c) is None else columns[c].cast(kind_) if isinstance(columns[c], pa.Array) else pa.array(columns[c], kind_) for c, kind_ in types.items()}
    made |= {"kind": pa.array(np.full(n, kind, np.int32)), "vid": vid, "vec": vec}
    return pa.record_batch({c.split()[0]: made[c.split()[0]] for c in _PLACED.split(", ")})


def _indexed(tables: Tables, directory: Directory, group_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vid = np.array(batch["vid"])
            salt = (vid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for t, cells in enumerate(tables.cells(matrix(batch["vec"]))):
                part = directory.first[t, cells] + (salt % directory.parts[t, cells].astype(np.uint64)).astype(np.int64)
                yield _placed(len(vid), 0, batch["vec"], batch["vid"], grp=part // group_parts, part=part, t=np.full(len(vid), t, np.int32), cell=cells, ids=batch["ids"])

    return run


def _probing(tables: Tables, directory: Directory, least: int, group_parts: int):
    """Each query once for each group that it visits, with its parts there and the least chance of a visited cell."""
    every = np.arange(SLOTS**tables.wide)
    step = max(1, min(QUERY_BLOCK, MOST_CHANCES // len(every)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                slots = tables.slot_chances(matrix(batch["vec"]))
                visits: list[dict[int, tuple[list, list]]] = [{} for _ in range(batch.num_rows)]
                for t in range(TABLES):
                    chance = tables.cell_chances(slots[t], every)
                    order = np.argsort(-chance, axis=1, kind="stable")
                    mass = np.cumsum(np.take_along_axis(chance, order, 1), 1)
                    rows = np.cumsum(directory.counts[t][order], 1)
                    stop = np.maximum((mass < tables.share).sum(1), (rows < min(least, rows[0, -1])).sum(1))
                    stop = np.minimum(stop, len(every) - 1)
                    for q in range(batch.num_rows):
                        lowest = chance[q, order[q, stop[q]]]
                        cells = np.flatnonzero((chance[q] >= lowest) & (directory.counts[t] > 0))
                        first, many = directory.first[t, cells], directory.parts[t, cells]
                        parts = np.unique(np.concatenate([first, *[f + np.arange(1, m) for f, m in zip(first[many > 1], many[many > 1])]])) if len(cells) else np.zeros(0, np.int64)
                        for part in parts.tolist():
                            listed, cuts = visits[q].setdefault(part // group_parts, ([], []))
                            listed.append(part)
                            cuts.append(lowest)
                row = pa.array([q for q, mine in enumerate(visits) for _ in mine], pa.int64())
                groups = [(g, *mine[g]) for mine in visits for g in mine]
                yield _placed(len(row), 1, batch["vec"].take(row), batch["vid"].take(row), grp=[g for g, _, _ in groups], parts=[x for _, x, _ in groups], cuts=[x for _, _, x in groups])

    return run


class _Group:
    """A group's index rows, by part and cell."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        part, t, cell, vid = (np.concatenate([np.array(b[c]) for b in batches]) for c in ("part", "t", "cell", "vid"))
        order = np.lexsort((vid, cell, part))
        part, t, self.cell, self.vid = part[order], t[order], cell[order], vid[order]
        self.x = np.concatenate([matrix(b["vec"]) for b in batches])[order]
        ids = [x for b in batches for x in b["ids"].to_pylist()]
        self.ids = [ids[i] for i in order]
        self.least_id = np.array([x[0] for x in self.ids])
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        self.parts = {int(part[a]): (int(t[a]), a, b) for a, b in zip(first, np.append(first[1:], len(part)))}

    def search(self, tables: Tables, queries: pa.RecordBatch, most: int, best: dict[int, list[tuple]]) -> None:
        q, names = matrix(queries["vec"]), queries["vid"].to_pylist()
        slots = tables.slot_chances(q)
        asked: dict[int, tuple[list, list]] = {}
        for i, (parts, cuts) in enumerate(zip(queries["parts"].to_pylist(), queries["cuts"].to_pylist())):
            for part, cut in zip(parts, cuts):
                who, least = asked.setdefault(part, ([], []))
                who.append(i)
                least.append(cut)
        for part, (who, least) in asked.items():
            if part not in self.parts:
                continue
            t, a, b = self.parts[part]
            distinct, start = np.unique(self.cell[a:b], return_index=True)
            end = np.append(start[1:], b - a)
            visits = Tables.cell_chances(slots[t][who], distinct) >= np.array(least)[:, None] * (1 - 1e-12)
            score = np.full((len(who), b - a), -np.inf)
            mine = q[who]
            for c in range(len(distinct)):
                at = np.flatnonzero(visits[:, c])
                if len(at):
                    score[at, start[c] : end[c]] = _dots(mine[at], self.x[a + start[c] : a + end[c]])
            for i, row in enumerate(who):
                found = best.setdefault(names[row], [])
                found += [(-score[i, k], self.least_id[a + k], self.vid[a + k], self.ids[a + k]) for k in _top(score[i], self.least_id[a:b], most)]
                if len(found) > 4 * most:
                    best[names[row]] = leading(found, most)


def leading(found: list[tuple], most: int) -> list[tuple]:
    """The nearest of what was found for a query, each vector once."""
    out: dict[int, tuple] = {}
    for x in sorted(found, key=lambda x: x[:3]):
        out.setdefault(x[2], x)
        if len(out) == most:
            break
    return list(out.values())


def _searched(tables: Tables, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, group = None, [], None
        best: dict[int, list[tuple]] = {}  # one result for a query from all groups of this task

        def made() -> pa.RecordBatch:
            out = [(q, x[2], -x[0], x[3]) for q, found in best.items() for x in leading(found, most)]
            q, vid, score, ids = zip(*out) if out else ([], [], [], [])
            return pa.record_batch({"q": pa.array(q, pa.int64()), "vid": pa.array(vid, pa.int64()), "score": pa.array(score, pa.float64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

        for batch in batches:
            grp, kind = np.array(batch["grp"]), np.array(batch["kind"])
            cut = np.flatnonzero(np.append(True, (grp[1:] != grp[:-1]) | (kind[1:] != kind[:-1]))) if len(grp) else np.zeros(0, np.int64)
            for a, b in zip(cut, np.append(cut[1:], len(grp))):
                if grp[a] != now:
                    now, rows, group = grp[a], [], None
                if kind[a] == 0:  # a group's rows come before its queries
                    rows.append(batch.slice(a, b - a))
                    continue
                if rows:
                    group, rows = _Group(rows), []
                for at in range(a, b, QUERY_BLOCK) if group else ():
                    group.search(tables, batch.slice(at, min(QUERY_BLOCK, b - at)), most, best)
                    if len(best) > MOST_HELD:
                        yield made()
                        best.clear()
        yield made()

    return run


def nearest(vectors: DataFrame, is_query: Column, top: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's top other rows by inner product, ties to the smaller vec_id.

    vectors: (vec_id, embedding). Rows whose vector is null, empty, zero, holds null or non-finite components, or is of
    another length than most (ties: the shorter) take no part, nor do those without vec_id. A vec_id that repeats counts
    as one row for each distinct vector it has. Other columns are not read; an empty table gives no rows.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == lengths["d"]).select("vec_id", "asks", F.transform("embedding", lambda x: x + 0.0).alias("vec"))
    numbered = rows.select("vec", "vec_id").withColumn("k", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("k") <= top + 1)
    distinct = numbered.groupBy("vec").agg(F.array_distinct(F.array_sort(F.collect_list("vec_id"))).alias("ids"))  # top + 1 at most
    distinct = shared.written(distinct.select(F.col("ids")[0].alias("vid"), "vec", "ids").withColumn("vid", F.xxhash64("vid", "vec")))
    asking = shared.written(rows.where("asks").select(F.col("vec_id").alias("query_id"), "vec").distinct().join(distinct.select("vec", F.col("vid").alias("q")), "vec").select("query_id", "q"))
    sample = distinct.orderBy(F.hash("vid"), "vid").limit(SAMPLE).collect()
    some, ids = np.array([r["vec"] for r in sample]), np.array([r["vid"] for r in sample])
    measured = distinct.mapInArrow(_measured(some[:MEASURED], ids[:MEASURED], top), "i long, score double, vec array<double>")
    measured = shared.written(measured)
    greatest = measured.where("i = -1").agg(F.max("score")).first()[0]
    nth = measured.where("i >= 0").withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score")))).where(F.col("k") <= top)
    nth = nth.collect()  # MEASURED * top rows at most
    near = lift = 0.0
    if nth:
        asked, found = np.array([r["i"] for r in nth]), np.array([r["vec"] for r in nth])
        scaled = np.array([r["score"] for r in nth]) / np.linalg.norm(some[asked], axis=1) / greatest
        near, lift = float(np.median(scaled)), float(np.sqrt(np.maximum(1 - ((found / greatest) ** 2).sum(1), 0)).mean())
    tables = Tables(some, greatest, near, lift, wide_for(distinct.count()))
    if nth:
        tables.calibrate(some[:MEASURED], asked, found)
    counts = np.zeros((TABLES, SLOTS**tables.wide), np.int64)
    for r in distinct.mapInArrow(_celled(tables), "t long, cell long, n long").groupBy("t", "cell").agg(F.sum("n").alias("n")).collect():  # a row for each cell at most
        counts[r["t"], r["cell"]] = r["n"]
    directory = Directory(counts)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = int((directory.first + directory.parts).max())
    group_parts = min(GROUP_PARTS, max(1, parts // (4 * tasks)))  # a few groups a task at least
    index = distinct.mapInArrow(_indexed(tables, directory, group_parts), _PLACED)
    probes = distinct.join(asking.select(F.col("q").alias("vid")).distinct(), "vid", "left_semi").mapInArrow(_probing(tables, directory, 2 * top + 1, group_parts), _PLACED)
    met = index.unionByName(probes).repartition("grp").sortWithinPartitions("grp", "kind", "part", "vid").mapInArrow(_searched(tables, top + 1), "q long, vid long, score double, ids array<long>")
    best = met.dropDuplicates(["q", "vid"]).withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("k") <= top + 1)
    best = shared.written(best.select("q", "score", "ids"))
    named = asking.join(best, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    one = named.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
