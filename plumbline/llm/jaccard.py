"""Joining documents by the Jaccard similarity of their word shingles, through a MinHash LSH forest.

A document's shingle set is signed by TREES keys of DEPTH MinHash values each: the keys of a tree, sorted, are a prefix
trie, and a prefix of it is a bucket of neighbouring keys. Matching begins with the whole keys of FIRST_TREES trees: every member
of a bucket meets the bucket's first. From the similarities of those pairs, and the chance that a pair of such a similarity shares a
prefix of that length in some tree, follows how many pairs were missed; prefixes are shortened until that is within the
target recall. Verified links are judged the same way at the end, and shorten further if they must. So a corpus whose
pairs are close stops at long prefixes, and one with many pairs at the threshold goes down to short ones.

Members whose signatures agree with their bucket's first (within SIGMAS standard deviations of the threshold) form
groups with it; the pairs of a group are verified once, block against block, whatever number of buckets they share. A
pair of two groups is owned by one bucket, the first tree's that holds both, and looked at there: signatures first, then
shingle sets, exactly. Buckets within one group, and buckets of the same members as an earlier tree's, have nothing left
to do. Only sums, a spanning forest of the links and a histogram leave a task. Documents with one shingle set are a class
that is signed and verified once, and stands for all its copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared
from plumbline.llm.components import components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.9999
#: Trees whose whole keys are matched to judge how far prefixes must be shortened; all are from there on.
FIRST_TREES = 8
SIGMAS = 6
#: Members in a block: they grow with the root of their group or bucket, within these bounds; two blocks meet in a task.
LEAST_BLOCK, MOST_BLOCK = 128, 1024
#: Similarities of verified links are counted in bins of a thousandth.
BINS = 1000
_SEED = 1789


def expected_recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def estimated_recall(found: dict[float, int], depth: int, similarity: float, trees: int = TREES, at: int | None = None, seen: int | None = None) -> float:
    """The share of all links that prefixes of depth at (default: depth) find, judged by how many of each similarity prefixes of depth found
    in seen (default: all) trees.

    Each link found stands for 1 / its chance of being found; one more at the threshold is taken to have gone unseen.
    """
    every = {s: n / expected_recall(s, depth, seen or trees) for s, n in found.items()}
    missed = sum(n * (1 - expected_recall(s, at or depth, trees)) for s, n in every.items()) + 1 - expected_recall(similarity, at or depth, trees)
    return 1 - missed / max(1.0, sum(every.values()))


def shortened(found: dict[float, int], depth: int, similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, seen: int | None = None) -> int:
    """The longest prefix, of depth at most, with the target recall by estimated_recall()."""
    return next((d for d in range(depth, 1, -1) if estimated_recall(found, depth, similarity, trees, d, seen) >= recall), 1)


def least_agreeing(similarity: float, values: int = TREES * DEPTH) -> int:
    """Signature values on which a pair at the threshold agrees at least, but for SIGMAS standard deviations."""
    return max(1, int(values * similarity - SIGMAS * (values * similarity * (1 - similarity)) ** 0.5))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of all runs of five words, A-Z lower-cased; a shorter text's words are one shingle, none if it has none."""
    words = text.lower().split()
    if len(words) <= SHINGLE_WORDS:
        return np.frombuffer(blake2b(b" ".join(words), digest_size=8).digest(), np.uint64).copy() if words else np.zeros(0, np.uint64)
    codes: dict[bytes, int] = {}
    for w in set(words):
        codes[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
    return combine(np.array([codes[w] for w in words], np.uint64))


def combine(word: np.ndarray) -> np.ndarray:
    n = len(word) - SHINGLE_WORDS + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


class _Shingler:
    """shingles() with words' hashes kept from text to text."""

    class _Codes(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = code = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
            return code

    def __init__(self, most: int = 200_000) -> None:
        self.codes, self.most = self._Codes(), most

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(words) <= SHINGLE_WORDS:
            return shingles(text)
        if len(self.codes) > self.most:
            self.codes.clear()
        return combine(np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words)))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """forest: the keys of all trees one after the other, 16 bits for each value, so that keys sort as their values do."""
    random, many = np.random.default_rng(_SEED), TREES * DEPTH
    factor = (random.integers(1, 2**32, many, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
    offset = random.integers(0, 2**32, many, dtype=np.uint64).astype(np.uint32)[:, None]

    def forest(found: np.ndarray) -> bytes:
        low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
        least = np.full(many, 2**32 - 1, np.uint32)
        for at in range(0, len(low), 2048):
            part = low[None, at : at + 2048] * factor + offset
            part ^= high[None, at : at + 2048]
            part *= np.uint32(0x85EBCA6B)
            part ^= part >> np.uint32(15)
            np.minimum(least, part.min(axis=1), out=least)
        least ^= least >> np.uint32(16)  # a minimum's upper half alone would often be 0
        return (least & np.uint32(0xFFFF)).astype(">u2").tobytes()

    shingler = _Shingler()
    for batch in batches:
        found = [shingler(t) for t in shared.as_bytes(batch["text"])]
        keys = [blake2b(f.tobytes(), digest_size=16).digest() if len(f) else None for f in found]
        forests = [forest(f) if len(f) else None for f in found]
        yield pa.record_batch({"doc_id": batch["doc_id"], "class_key": pa.array(keys, pa.binary()), "n": pa.array([len(f) for f in found], pa.int64()), "forest": pa.array(forests, pa.binary())})
    del shingler
    shared.release()


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = _Shingler()
    for batch in batches:
        found = [shingler(t).tobytes() for t in shared.as_bytes(batch["text"])]
        keys = [blake2b(f, digest_size=16).digest() for f in found]
        yield pa.record_batch({"held_rep": batch["rep"], "held_key": pa.array(keys, pa.binary()), "shingles": pa.array(found, pa.binary())})
    del shingler
    shared.release()


def common(a: list[np.ndarray], b: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of all of a with all of b, by products of their incidence matrices."""
    if len(a) == 1 or len(b) == 1:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], np.int64)
    shared_by = np.concatenate([*a, *b])
    values, where = np.unique(shared_by, return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    out = np.zeros((len(a), len(b)))
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    for at in range(0, len(values), width):
        lo, hi = np.searchsorted(where, [at, at + width])
        part = np.zeros((len(a) + len(b), min(width, len(values) - at)), np.float32)
        part[owner[lo:hi], where[lo:hi] - at] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return np.rint(out).astype(np.int64)


def _keys(forests: list[bytes]) -> np.ndarray:
    """(row, tree, place): the signature values."""
    return np.array([np.frombuffer(f, ">u2") for f in forests]).astype(np.uint16).reshape(len(forests), TREES, DEPTH)


class _Block:
    """Members of a block: their class keys, groups, signatures and, where pairs are verified, ids, copies and shingle sets."""

    def __init__(self, rows: list[dict]) -> None:
        self.member, self.rep = [r["member"] for r in rows], [r.get("rep") for r in rows]
        self.group = np.array([r["grp"] for r in rows], np.int64)
        self.keys = _keys([r["forest"] for r in rows])
        self.copies = np.array([r.get("copies", 1) for r in rows], np.int64)
        self.sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows] if rows and "shingles" in rows[0] else []


def _agreeing(a: _Block, b: _Block, tree: int, depth: int) -> np.ndarray:
    """How many signature values agree, for the pairs that a task owns; -1 for others.

    A group's task (tree -1) owns all its pairs. A bucket's owns those of two groups that share its tree's prefix and no
    earlier tree's.
    """
    agree = np.zeros((len(a.rep), len(b.rep)), np.int16)
    owned = np.ones(agree.shape, bool) if tree < 0 else a.group[:, None] != b.group[None, :]
    for t in range(TREES):
        same = a.keys[:, None, t] == b.keys[None, :, t]
        agree += same.sum(2, dtype=np.int16)
        if t <= tree:
            prefix = same[:, :, :depth].all(2)
            owned &= prefix if t == tree else ~prefix
    agree[~owned] = -1
    return agree


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows that agree in the named columns, after their values."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[n] for n in names)
            if now != key and rows:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


_TASK = ("tree", "label", "i", "j")
_MEMBERS = "tree int, label long, i int, j int, first boolean, member binary, grp long"


def _pairs_of(key: tuple, rows: list[dict], depth: int, least: int) -> tuple[_Block, _Block, np.ndarray] | None:
    """The blocks of a task and what _agreeing() says of their pairs, each pair once; -1 where it is less than least."""
    tree, _, i, j = key
    a = _Block([r for r in rows if r["first"]])
    b = a if i == j else _Block([r for r in rows if not r["first"]])
    if not a.rep or not b.rep or len(rows) < 2:
        return None
    agree = _agreeing(a, b, tree, depth)
    if i == j:
        agree[np.tril_indices(len(a.rep))] = -1
    agree[agree < least] = -1
    return a, b, agree


def _led(least: int):
    """The pairs (h, lead) of members and their buckets' firsts whose signatures agree well enough, with how many values do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_keys(batch["forest"].to_pylist()) == _keys(batch["lead_forest"].to_pylist())).sum((1, 2)).astype(np.int32) if batch.num_rows else np.zeros(0, np.int32)
            keep = pa.array(agree >= least)
            yield pa.record_batch({"h": batch["h"].filter(keep), "lead": batch["lead"].filter(keep), "agree": pa.array(agree).filter(keep)})

    return run


def _left_over(depth: int, least: int):
    """The members of buckets' tasks that have a pair to verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64())

        def made() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)], [c.split()[0] for c in _MEMBERS.split(", ")])

        for key, rows in _runs(batches, _TASK):
            found = _pairs_of(key, rows, depth, least)
            if found is None:
                continue
            a, b, agree = found
            hit = agree >= 0
            if key[2] == key[3]:
                out += [(*key, True, a.member[k], int(a.group[k])) for k in np.flatnonzero(hit.any(1) | hit.any(0))]
            else:
                out += [(*key, True, a.member[k], int(a.group[k])) for k in np.flatnonzero(hit.any(1))] + [(*key, False, b.member[k], int(b.group[k])) for k in np.flatnonzero(hit.any(0))]
            if len(out) > 50_000:
                yield made()
                out.clear()
        yield made()

    return run


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    left, edges = linked.any(1), []
    for start in np.flatnonzero(left):
        if not left[start]:
            continue
        left[start], frontier = False, [int(start)]
        while frontier:
            i = frontier.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            edges += [(i, int(j)) for j in new]
            frontier += new.tolist()
    return edges


def _linked(a: _Block, b: _Block, agree: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of a task's pairs are links, exactly, and the links' similarities."""
    at = np.argwhere(agree >= 0)
    if len(at) <= 2 * (len(a.rep) + len(b.rep)):
        met = np.zeros(agree.shape, np.int64)
        for i, j in at:
            met[i, j] = len(np.intersect1d(a.sets[i], b.sets[j], assume_unique=True))
    else:
        met = common(a.sets, b.sets)
    size = np.array([len(x) for x in a.sets])[:, None] + np.array([len(x) for x in b.sets])[None, :]
    linked = (agree >= 0) & (met >= similarity * (size - met) - 1e-9)
    return linked, (met / np.maximum(size - met, 1))[linked]


class _Found:
    """What a Spark task has found: links of each member, and edges that join members not yet joined here."""

    def __init__(self) -> None:
        self.links: dict[bytes, int] = {}
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []
        self.bins = np.zeros(BINS + 1, np.int64)

    def _root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, a: _Block, b: _Block, linked: np.ndarray, similarity: np.ndarray) -> None:
        alone, n = a is b, len(a.rep)
        if alone:
            members, names, copies, both = a.member, a.rep, a.copies, linked | linked.T
        else:
            members, names, copies = a.member + b.member, a.rep + b.rep, np.append(a.copies, b.copies)
            both = np.zeros((len(names), len(names)), bool)
            both[:n, n:], both[n:, :n] = linked, linked.T
        sums = both @ copies
        for k in np.flatnonzero(sums):
            self.links[members[k]] = self.links.get(members[k], 0) + int(sums[k])
        for i, j in _spanning(both):
            x, y = self._root(names[i]), self._root(names[j])
            if x != y:
                self.parent[x] = y
                self.edges.append((names[i], names[j]))
        self.bins += np.bincount(np.rint(similarity * BINS).astype(np.int64), minlength=BINS + 1)

    def rows(self) -> pa.RecordBatch:
        out = [(m, None, n, None) for m, n in self.links.items()] + [(None, a, 0, b) for a, b in self.edges] + [(None, None, int(self.bins[k]), int(k)) for k in np.flatnonzero(self.bins)]
        m, a, n, b = zip(*out) if out else ((), (), (), ())
        return pa.record_batch({"member": pa.array(m, pa.binary()), "rep": pa.array(a, pa.int64()), "links": pa.array(n, pa.int64()), "other": pa.array(b, pa.int64())})


#: Members whose links a Spark task holds before it hands them on.
MOST_HELD = 200_000


def _verified(depth: int, similarity: float):
    least = least_agreeing(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found()
        for key, rows in _runs(batches, _TASK):
            once = {(r["first"], r["member"]): r for r in rows}  # a doc_id that repeats with one text is one member
            pairs = _pairs_of(key, list(once.values()), depth, least)
            if pairs is None:
                continue
            a, b, agree = pairs
            found.add(a, b, *_linked(a, b, agree, similarity))
            if len(found.links) > MOST_HELD:
                yield found.rows()
                found = _Found()
        yield found.rows()
        shared.release()

    return run


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, class_key, n, forest) of each row: its class, its count of shingles, and its keys in all trees."""
    return shared.texts(docs).mapInArrow(_signed, "doc_id long, class_key binary, n long, forest binary")


def _in_blocks(members: DataFrame, m: str) -> DataFrame:
    """members of groups or buckets of m, once for each block pair (i, j) that their block is in; first: theirs is block i."""
    size = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(4 * F.sqrt(m)).cast("int")))
    dealt = members.withColumn("blocks", F.ceil(F.col(m) / size).cast("int")).withColumn("block", F.pmod(F.xxhash64(F.lit(9), "member"), F.col("blocks")).cast("int"))
    b = F.col("block")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(b, k).alias("i"), F.greatest(b, k).alias("j"), (b <= k).alias("first")))
    return dealt.withColumn("p", F.explode(pairs)).select("*", "p.i", "p.j", "p.first").drop("blocks", "block", "p", m)


class Forest:
    """The tries of one representative of each class (member, rep, copies, forest), matched by shorter and shorter prefixes."""

    def __init__(self, reps: DataFrame, similarity: float, recall: float) -> None:
        self.reps = reps.withColumn("h", F.xxhash64("member"))
        self.similarity, self.recall, self.depth = similarity, recall, DEPTH

    def nodes(self, trees: int = TREES) -> DataFrame:
        """(h, tree, label) of every member's prefix in the first trees."""
        key = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(F.substring("forest", t * (2 * DEPTH) + 1, F.lit(2 * self.depth))))
        return self.reps.select("h", F.posexplode(key).alias("tree", "label"))

    def leads(self, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
        """(h, lead, agree): members and the firsts of their buckets that may be links, each pair once; and (tree, label, h, lead) of the
        nodes whose bucket has several members, which are few beside the others."""
        nodes = self.nodes(trees)
        buckets = nodes.groupBy("tree", "label").agg(F.count("*").alias("m"), F.min("h").alias("lead")).where("m > 1").drop("m")
        held = shared.written(nodes.join(buckets, ["tree", "label"]))
        pairs = shared.written(held.where("h <> lead").select("h", "lead").distinct())
        beside = shared.join_hot(pairs, self.reps.select(F.col("h").alias("lead"), F.col("forest").alias("lead_forest")), "lead")
        both = beside.join(self.reps.select("h", "forest"), "h").select("h", "lead", "forest", "lead_forest")
        return shared.written(both.mapInArrow(_led(least_agreeing(self.similarity)), "h long, lead long, agree int")), held

    def shorten(self, found: dict[float, int], recall: float | None = None, seen: int | None = None) -> bool:
        """Goes to the depth that the similarities found (in seen trees) ask for; False if that is this one."""
        depth = shortened(found, self.depth, self.similarity, recall or self.recall, seen=seen)
        shorter, self.depth = depth < self.depth, depth
        return shorter

    def tasks(self, leads: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(tree, label, m, member, grp) of groups (tree -1), whose members are all verified, and (tree, label, m, h, grp) of the buckets that
        hold several groups."""
        joined = shared.written(components(leads.select(F.col("h").alias("a"), F.col("lead").alias("b")))).withColumnRenamed("node", "h")
        sizes = joined.groupBy("root").agg(F.count("*").alias("m"))
        mine = self.reps.select("member", "h").join(joined, "h")
        in_groups = shared.join_hot(shared.written(mine), sizes, "root").select("member", "m", F.col("root").alias("grp"), F.lit(-1).alias("tree"), F.col("root").alias("label"))
        nodes = shared.written(held.drop("lead").join(joined, "h", "left").withColumn("grp", F.coalesce("root", "h")).drop("root"))
        alike = [F.bit_xor(F.xxhash64(F.lit(k), "h")).alias(f"x{k}") for k in (1, 2)]
        mixed = nodes.groupBy("tree", "label").agg(F.count("*").alias("m"), F.min("grp").alias("low"), F.max("grp").alias("high"), *alike).where("low <> high")
        own = shared.written(mixed.groupBy("m", "x1", "x2").agg(F.min(F.struct("tree", "label")).alias("b")).select("b.tree", "b.label", "m"))  # of buckets of the same members the first tree's
        return in_groups, nodes.join(own, ["tree", "label"])

    def left_over(self, buckets: DataFrame) -> DataFrame:
        """Members of buckets' block pairs that have a pair to verify, by their signatures."""
        signed = _in_blocks(buckets.join(self.reps.select("h", "member", "forest"), "h").drop("h"), "m").repartition(*_TASK).sortWithinPartitions(*_TASK)
        return signed.mapInArrow(_left_over(self.depth, least_agreeing(self.similarity)), _MEMBERS)

    def links(self, docs: DataFrame) -> tuple[DataFrame, dict[str, float]]:
        """(member, rep, links, other) of all verified links, and a report: depth, links between classes, estimated recall.

        Rows with a member say how many links it has; those with rep and other join two classes' representatives.
        """
        seen = FIRST_TREES
        while True:
            leads, held = self.leads(seen)
            near = leads.where(F.col("agree") >= self.similarity * TREES * DEPTH).groupBy("agree").count().collect()  # a row for each count of agreeing values
            # signatures only estimate: a closer target, so that verified links seldom ask for another round
            if self.shorten({r["agree"] / (TREES * DEPTH): r["count"] for r in near}, 1 - (1 - self.recall) / 8, seen) or seen < TREES:
                leads, held = self.leads()
            seen = TREES
            groups, buckets = self.tasks(leads, held)
            found = shared.written(self.verified(shared.written(groups), shared.written(self.left_over(buckets)), docs))
            bins = found.where("member IS NULL AND rep IS NULL").groupBy("other").agg(F.sum("links").alias("n")).collect()  # a row for each bin
            exact = {r["other"] / BINS: r["n"] for r in bins}
            if not self.shorten(exact):
                return found.where("member IS NOT NULL OR rep IS NOT NULL"), {"depth": self.depth, "links": sum(exact.values()), "estimated_recall": estimated_recall(exact, self.depth, self.similarity)}

    def verified(self, groups: DataFrame, rest: DataFrame, docs: DataFrame) -> DataFrame:
        needed = groups.select("member").unionByName(rest.select("member")).distinct()
        known = shared.written(self.reps.join(needed, "member", "left_semi").drop("h"))
        ids = known.select(F.col("rep").alias("needed_rep")).distinct()
        few = known.count() <= MOST_BROADCAST
        text = shared.texts(docs).join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), F.col("doc_id") == F.col("needed_rep"), "left_semi")
        held = text.select(F.col("doc_id").alias("rep"), "text").mapInArrow(_with_shingles, "held_rep long, held_key binary, shingles binary")
        full = shared.written(known.join(held, (F.col("rep") == F.col("held_rep")) & (F.col("member") == F.col("held_key"))).select("member", "rep", "copies", "forest", "shingles"))
        every = _in_blocks(groups.join(full, "member"), "m").unionByName(rest.join(full, "member"))
        return every.repartition(*_TASK).sortWithinPartitions(*_TASK, "member").mapInArrow(_verified(self.depth, self.similarity), "member binary, rep long, links long, other long")


#: Ids of documents with candidates up to which they are broadcast to the scan of the texts (8 bytes each).
MOST_BROADCAST = 2_000_000


def _representatives(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_key, rep, copies) of each class, and its representative's row: (member, rep, copies, forest)."""
    some = signed.where("class_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = shared.written(some.groupBy("class_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = shared.join_hot(some.select("class_key", "doc_id", "forest"), classes, "class_key").where("doc_id = rep").select("rep", "copies", F.col("class_key").alias("member"), "forest")
    return classes, shared.written(reps.dropDuplicates(["member"]))


def link_report(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> dict[str, float]:
    """The depth that the tries were shortened to, links between classes, and the recall estimated from their similarities."""
    _, reps = _representatives(shared.written(signatures(docs)))
    return Forest(reps, similarity, recall).links(docs)[1]


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links, n_shingles): a row for each row of docs.

    copy_id: the least doc_id with the same shingle set; class_id: the least doc_id that a chain of pairs of at least the
    given similarity reaches; n_links: rows at least that similar, itself left out, copies counted. A text without words
    (null, empty) has no partner: its ids are its own and n_links is 0. Texts of up to five words have one shingle. Rows
    without doc_id take no part: all their columns but n_shingles are null or 0. A doc_id that repeats with equal texts is
    a copy of itself; with other texts, each row is judged by its own, and the class ids may tie them together. Other
    columns of docs are not read; an empty table gives no rows.
    """
    signed = shared.written(signatures(docs))
    classes, reps = _representatives(signed)
    found, _ = Forest(reps, similarity, recall).links(docs)
    joined = components(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "linked_rep", "root": "class_id"})
    links = found.where("member IS NOT NULL").groupBy("member").agg(F.sum("links").alias("links"))
    per_class = classes.join(joined, F.col("rep") == F.col("linked_rep"), "left").join(links, F.col("class_key") == F.col("member"), "left")
    per_class = per_class.select("class_key", F.col("rep").alias("copy_id"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = F.col("class_key").isNull() | F.col("doc_id").isNull()
    out = shared.join_hot(signed.where(~alone).select("doc_id", "class_key", "n"), shared.written(per_class), "class_key").select("doc_id", "class_id", "copy_id", F.col("n_links").cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
    return out.unionByName(signed.where(alone).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles")))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows whose class has a lesser doc_id; of rows equal in id and text, one stays.

    Null ids and texts without words (null, empty) stay; an empty table stays empty. Columns may have any names.
    """
    judged = near_duplicates(docs, similarity).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    gone = judged.where("doc_id <> class_id").select("doc_id")
    row = docs.select(shared.packed(docs).alias("row"))
    gone = gone.hint("shuffle_hash")
    kept = row.join(gone, F.col("row.doc_id") == gone["doc_id"], "left_anti")
    if not docs.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").isEmpty():
        some = kept.where("row.doc_id IS NOT NULL").withColumns({"id": F.col("row.doc_id"), "words": F.col("row.text")}).dropDuplicates(["id", "words"]).select("row")
        kept = some.unionByName(kept.where("row.doc_id IS NULL"))
    return kept.select("row.*")
