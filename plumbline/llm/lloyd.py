"""Product quantisation by Lloyd's rounds with filtering.

Vectors become integers and are cut into parts. Every chunk of a partition builds, for each part position, a kd-tree over the distinct
parts it holds; nodes keep bounding box, sums and counts. In a round a node takes its parent's candidate entries, finds the one
nearest to its box's middle, and strikes each entry that is farther from every point of the box; a node with one entry left
is assigned whole from its sums. Trees are built once, written, and read in every round; what leaves a task are sums and counts by
entry. All is exact in integers, ties included: equal distances go to the lower index.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a chunk: what a task holds, with its trees, at a time.
CHUNK = 8192
#: Points of a leaf.
LEAF = 8
#: Squared distances of parts whose components are within this, over its width, fit into 64 bits; beyond, Python's integers count.
SAFE = 1 << 58


def to_integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) exactly: 64-bit where a part's squared distances fit, else Python's integers."""
    if not x.size or np.abs(x).max() < 2.0**40:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[int(Fraction(v) * SCALE // 1) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def exact(points: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if no sum of squares can overflow, else as Python's."""
    top = max((int(abs(a).max()) for a in (points, codebook) if a.size), default=0)
    kind = np.int64 if 8 * max(1, points.shape[1]) * top * top < 8 * SAFE else object
    return points.astype(kind), codebook.astype(kind)


class Tree:
    """A kd-tree over distinct points with their counts, nodes in breadth-first order; leaves hold up to LEAF points."""

    def __init__(self, points: np.ndarray, counts: np.ndarray):
        order, ranges, children = np.arange(len(points)), [(0, len(points))], []
        i = 0
        while i < len(ranges):
            a, b = ranges[i]
            mine = order[a:b]
            if b - a > LEAF:
                spread = points[mine].max(0) - points[mine].min(0)
                by = points[mine, int(np.argmax(spread))]
                middle = (b - a) // 2
                order[a:b] = mine[np.argsort(by, kind="stable") if by.dtype == object else np.argpartition(by, middle)]
                children.append(len(ranges))
                ranges += [(a, a + middle), (a + middle, b)]
            else:
                children.append(-1)
            i += 1
        self.order, self.children, self.ranges = order, np.array(children), np.array(ranges).reshape(-1, 2)
        self.points, self.counts = points[order], counts[order]
        starts, kept = self.ranges[:, 0], self.points * self.counts[:, None]
        sums = np.concatenate([kept[:1] * 0, np.cumsum(kept, axis=0)])
        heads = np.concatenate([[0], np.cumsum(self.counts)])
        self.sums, self.n = sums[self.ranges[:, 1]] - sums[starts], heads[self.ranges[:, 1]] - heads[starts]
        self.low = np.array([self.points[a:b].min(0) for a, b in ranges]).reshape(len(ranges), -1)
        self.high = np.array([self.points[a:b].max(0) for a, b in ranges]).reshape(len(ranges), -1)

    def filtered(self, codebook: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(nodes, their entry, False) for subtrees assigned whole, and (points, their entry, True) for those of undecided leaves."""
        every = np.arange(len(codebook))
        nodes, alive = np.zeros(1, int), np.ones((1, len(codebook)), bool)
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            middle = low + high  # twice the middle: distances to it stay in integers
            away = ((2 * codebook[None] - middle[:, None]) ** 2).sum(2)
            best = _first_least(away, alive)
            mine = codebook[best]
            toward = codebook[None] - mine[:, None]
            corner = np.where(toward > 0, high[:, None], low[:, None])  # the box's point most in favour of the other entry
            gain = (toward * (codebook[None] + mine[:, None] - 2 * corner)).sum(2)
            alive &= (gain < 0) | ((gain == 0) & (every[None] < best[:, None])) | (every[None] == best[:, None])
            single = alive.sum(1) == 1
            yield nodes[single], np.argmax(alive[single], 1), False
            leaf = ~single & (self.children[nodes] < 0)
            if leaf.any():
                ranges = self.ranges[nodes[leaf]]
                sizes = ranges[:, 1] - ranges[:, 0]
                at = np.repeat(ranges[:, 0] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                yield at, _first_least(((self.points[at][:, None] - codebook[None]) ** 2).sum(2), np.repeat(alive[leaf], sizes, 0)), True
            go = ~single & (self.children[nodes] >= 0)
            nodes, alive = np.concatenate([self.children[nodes[go]], self.children[nodes[go]] + 1]), np.concatenate([alive[go]] * 2)

    def totals(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, counts) of the points nearest to each entry."""
        sums, counts = np.zeros(codebook.shape, self.points.dtype), np.zeros(len(codebook), np.int64)
        for at, entry, single in self.filtered(codebook):
            np.add.at(sums, entry, self.points[at] * self.counts[at, None] if single else self.sums[at])
            np.add.at(counts, entry, self.counts[at] if single else self.n[at])
        return sums, counts

    def nearest(self, codebook: np.ndarray) -> np.ndarray:
        """The entry of each point, points in the order given."""
        out = np.zeros(len(self.points), int)
        for at, entry, single in self.filtered(codebook):
            for k, e in [] if single else zip(at, entry):
                out[self.order[slice(*self.ranges[k])]] = e
            if single:
                out[self.order[at]] = entry
        return out

    def exactly(self, codebook: np.ndarray) -> np.ndarray:
        """codebook in the numbers that tree and codebook both need; the tree's change to Python's integers if they must."""
        points, codebook = exact(self.points, codebook)
        if points.dtype != self.points.dtype:
            self.points, self.low, self.high, self.sums = points, self.low.astype(object), self.high.astype(object), self.sums.astype(object)
        return codebook.astype(self.points.dtype)


def _first_least(away: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Of each row, the first entry alive of the least distance."""
    least = np.where(alive, away, away.max(initial=0) + 1 if away.size else 0)
    return np.argmin(least, 1)


# -- Spark --------------------------------------------------------------------------------------------------------------

TREES = "ids array<long>, labels array<string>, trees binary"


def _planted(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of rows with their trees: for each part position the tree and each row's point in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunk() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            vectors = np.zeros((rows.num_rows, width))
            column = rows["vector"].combine_chunks()
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
            inside = np.arange(width)[None] < sizes[:, None]
            vectors[inside] = column.flatten().to_numpy(zero_copy_only=False)
            numbers, trees = to_integers(vectors), []
            for part in np.split(numbers, PARTS, 1):
                points, point, counts = _distinct(part)
                trees.append((Tree(points, counts), point))
            return pa.RecordBatch.from_pydict({"ids": [rows["id"].to_pylist()], "labels": [rows["label"].to_pylist()], "trees": [pickle.dumps(trees)]}, pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("trees", pa.binary())]))

        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                held.append(batch.slice(start, CHUNK))
                if sum(b.num_rows for b in held) >= CHUNK:
                    yield chunk()
                    held = []
        if held:
            yield chunk()

    return run


def _distinct(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, each row's place among them, how often each occurs)."""
    if part.dtype != object and part.shape[1]:
        points, point, counts = np.unique(part, axis=0, return_inverse=True, return_counts=True)
        return points, point.reshape(-1), counts
    places: dict[tuple, int] = {}
    point = np.array([places.setdefault(tuple(row), len(places)) for row in part.tolist()])
    points = np.array(list(places), dtype=part.dtype).reshape(len(places), part.shape[1])
    return points, point, np.bincount(point)


def _summed(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums and counts of a task's chunks by part and entry, in decimal digits: no sum is too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch["trees"]:
                got = [tree.totals(tree.exactly(book)) for (tree, _), book in zip(pickle.loads(blob.as_py()), books)]
                got = [(s.astype(object), n) for s, n in got]
                total = got if total is None else [(a + s, b + n) for (a, b), (s, n) in zip(total, got)]
        if total is not None:
            rows = [(p, e, str(n[e]), [str(v) for v in s[e]]) for p, (s, n) in enumerate(total) for e in range(len(n)) if n[e]]
            yield pa.RecordBatch.from_pydict(dict(zip(("part", "entry", "n", "sums"), map(list, zip(*rows)))), SUMS_ARROW)

    return run


SUMS = "part int, entry int, n string, sums array<string>"
SUMS_ARROW = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.string()), ("sums", pa.list_(pa.string()))])


def _added(table: pa.Table) -> pa.Table:
    """The rows of one part and entry, one from each task at most, as one."""
    n = sum(int(v) for v in table["n"].to_pylist())
    sums = [str(sum(int(v) for v in column)) for column in zip(*table["sums"].to_pylist())]
    return pa.Table.from_pydict({"part": [table["part"][0].as_py()], "entry": [table["entry"][0].as_py()], "n": [str(n)], "sums": [sums]}, SUMS_ARROW)


def _coded(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, blob in zip(*(batch[c].to_pylist() for c in ("ids", "labels", "trees"))):
                codes, error = np.zeros((len(ids), PARTS), int), np.zeros(len(ids), object)
                for p, ((tree, point), book) in enumerate(zip(pickle.loads(blob), books)):
                    book = tree.exactly(book)
                    entry = tree.nearest(book)
                    points = np.empty_like(tree.points)
                    points[tree.order] = tree.points
                    codes[:, p] = entry[point]
                    error += ((points - book[entry]) ** 2).sum(1).astype(object)[point] if points.shape[1] else 0
                digits = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "label": labels, "code": digits, "error": [str(e) for e in error]}, CODED_ARROW)

    return run


CODED_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.string())])


class Compressed:
    """codes: (vec_id, label, code, error) with error as a decimal; codebooks: of each part an array of its entries."""

    def __init__(self, codes: DataFrame, codebooks: list[np.ndarray]):
        self.codes, self.codebooks = codes, codebooks

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.codebooks for entry in book for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> Compressed:
    """Codes of vectors (vec_id, `vector`, label) in PARTS parts by codebooks of ENTRIES entries.

    Vectors that are null or hold null, NaN or infinite components go; they have no row. Components are floored to 1/SCALE. A codebook starts
    as the parts of the ENTRIES rows of least vec_id (null ids last, ties by vector), fewer if there are fewer rows. A vector shorter than the
    longest, filled up to a multiple of PARTS, counts as ending in zeros. Errors of more than 64 bits are exact too (decimal digits).
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & finite)
    spark = rows.sparkSession
    shared.bounded_batches(spark)
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    start = to_integers(np.array([[*r.vector, *[0.0] * (width - len(r.vector))] for r in first]).reshape(len(first), width))
    books = np.split(start, PARTS, 1)
    trees = shared.written(rows.mapInArrow(_planted(width), TREES))
    for _ in range(rounds if first else 0):
        new = [book.astype(object) for book in books]
        sums = trees.select("trees").mapInArrow(_summed(books), SUMS).groupBy("part", "entry").applyInArrow(_added, SUMS)
        for r in sums.collect():  # PARTS * ENTRIES rows at most
            new[r.part][r.entry] = [int(v) // int(r.n) for v in r.sums]
        books = [_narrow(book) for book in new]
    codes = trees.mapInArrow(_coded(books), "vec_id long, label string, code string, error string")
    return Compressed(codes, books)


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if not book.size or abs(book).max() < 1 << 62 else book


def report(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); label_error adds up the errors of equal labels, null labels together. Numbers that don't fit a long are null."""
    done = compress(vectors, vector)
    codes = shared.written(done.codes.withColumn("key", F.concat(F.when(F.col("label").isNull(), "null").otherwise("label:"), F.coalesce("label", F.lit("")))))
    sums = shared.written(codes.groupBy("key").agg(F.sum(F.col("error").try_cast("decimal(38,0)")).try_cast("long").alias("label_error")))
    joined = shared.join_hot(codes, sums, "key")
    return joined.select("vec_id", "code", F.col("error").try_cast("long").alias("error"), "label_error", F.lit(done.digest()).alias("codebooks_sha256"))
