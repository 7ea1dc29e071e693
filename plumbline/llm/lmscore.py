"""Language-model scores of whole documents by context mixing, with a unigram base beside them.

Texts are normalised to their words, A-Z lower-cased, with a space between and a line end after: the bytes that the
mixture predicts are the very tokens that the base counts. Words and byte windows are counted over all training
documents in column blobs, one for each batch of texts and bucket, so that Spark moves blobs and not words.

A window's bucket follows from its last three context bytes, so all its longer contexts lie in its bucket: a task builds
the tables of one bucket, scores each distinct window of the corpus once, and the scores go back to the batches that
have it, as the words' counts do. Contexts of up to two bytes are gathered (2**24 places at most). The mixer is fitted to
all training windows, each as often as it occurs: a round adds up every bucket's sums. Buckets are a multiple of
spark.sql.shuffle.partitions: nothing but the rounds' sums (of fixed size) and those short contexts reaches the driver, and
no table is held whole anywhere, however much there is to learn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared
from plumbline.llm.mixture import DENSE, ORDERS, ROUNDS, WINDOW, Checked, Dense, Mixer, contexts, log10, neighbourhood, windows

#: Bytes of text in a batch.
BATCH_BYTES = 8 << 20
#: Windows of a bucket that are held unmerged.
UNMERGED = 4 << 20
END = b"\n"
_ROWS = "kind string, bucket long, batch long, a binary, b binary, c binary"
_LONG = [o for o in ORDERS if o > DENSE]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 == 0


def normalised(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + END


def planes(values: np.ndarray) -> bytes:
    """Numbers by their bytes' places, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def ascending(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers by their steps."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def unascending(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def _row(kind: str, bucket: int, batch: int, a: bytes = b"", b: bytes = b"", c: bytes = b"") -> pa.RecordBatch:
    return pa.record_batch({"kind": [kind], "bucket": pa.array([bucket], pa.int64()), "batch": pa.array([batch], pa.int64()), "a": pa.array([a], pa.binary()), "b": pa.array([b], pa.binary()), "c": pa.array([c], pa.binary())})


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of normalised texts: a: zstd of the texts, b: their sizes, c: their ids, the first with null flags."""
    packer, number = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 32
    for batch in batches:
        docs = shared.as_bytes(batch["text"])
        for a, b in shared.chunks(docs, BATCH_BYTES):
            texts = [normalised(d) for d in docs[a:b]]
            ids = batch["doc_id"].slice(a, b - a)
            filled = np.array([-1 if x is None else x for x in ids.to_pylist()], np.int64)
            nulls = np.array([x is None for x in ids.to_pylist()], np.uint8)
            yield _row("d", -1, number, packer.compress(b"".join(texts)), np.array([len(t) for t in texts], np.int64).tobytes(), filled.tobytes() + nulls.tobytes())
            number += 1


class _Batch:
    """A batch's texts, unpacked."""

    def __init__(self, a: bytes, b: bytes, c: bytes) -> None:
        self.sizes = np.frombuffer(b, np.int64)
        n = len(self.sizes)
        self.data = zstandard.ZstdDecompressor().decompress(a)
        nulls = np.frombuffer(c, np.uint8, n, 8 * n)
        self.ids = [None if null else int(x) for x, null in zip(np.frombuffer(c, np.int64, n), nulls)]
        self.ends = np.cumsum(self.sizes)
        self.held = np.array([held_out(x) for x in self.ids], bool)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each distinct token, sorted; index into them of each token; tokens of each text)."""
        data = np.frombuffer(self.data, np.uint8)
        space, end = data == 32, data == END[0]
        begins = end.copy()  # a text's end is a token, and one begins after each end and each space
        begins[1:] |= space[:-1] | end[:-1]
        begins[:1] = True
        letters = np.cumsum(~space)
        starts = np.append(letters[begins] - 1, len(data) - np.count_nonzero(space)).astype(np.int64)
        tokens = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data[~space])]).dictionary_encode()
        codes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens.dictionary.to_pylist()), np.uint64, len(tokens.dictionary))
        order = np.argsort(codes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return codes[order], place[tokens.indices.to_numpy()], np.diff(np.cumsum(begins)[self.ends - 1], prepend=0)

    def windows(self) -> np.ndarray:
        """The windows of all bytes of all texts, each text begun after zero bytes."""
        pad = WINDOW - 1
        parts = []
        for end, size in zip(self.ends, self.sizes):
            parts += [bytes(pad), self.data[end - size : end]]
        every = windows(np.frombuffer(b"".join(parts), np.uint8))
        keep = np.ones(len(every), bool)  # those that end in the padding between texts aren't texts' bytes
        keep[(np.cumsum(self.sizes + pad)[:-1, None] - pad + np.arange(pad)).ravel()] = False
        return every[keep]

    def distinct(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct windows by bucket, then value; where each bucket starts; how often each occurs in training texts)."""
        every, held = self.windows(), np.repeat(self.held, self.sizes)
        trained = np.sort(every[~held])
        first = np.flatnonzero(np.append(True, trained[1:] != trained[:-1])) if len(trained) else np.zeros(0, np.int64)
        found = _once(np.sort(np.concatenate([trained[first], every[held]])))
        times = np.zeros(len(found), np.uint32)
        times[np.searchsorted(found, trained[first])] = np.diff(first, append=len(trained))
        order, starts = _dealt(found, buckets)
        return found[order], starts, times[order]

    def asked(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct windows by bucket, then value; where each bucket starts)."""
        found = _once(np.sort(self.windows()))
        order, starts = _dealt(found, buckets)
        return found[order], starts

    def scored(self, buckets: int, scores: np.ndarray) -> np.ndarray:
        """Each byte's score, from those of the distinct windows by bucket, then value."""
        every = self.windows()
        if not len(every):
            return np.zeros(0)
        bits = np.uint64(max(1, len(every) - 1).bit_length())
        mixed = every * np.uint64(0x9E3779B97F4A7C15) >> bits << bits | np.arange(len(every), dtype=np.uint64)  # sorts faster than places by windows
        mixed.sort()
        by = (mixed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        mixed >>= bits
        new = np.append(True, mixed[1:] != mixed[:-1])
        if np.count_nonzero(new) != len(scores):  # two windows whose mixed bits are the same
            by = np.argsort(every)
            ordered = every[by]
            new = np.append(True, ordered[1:] != ordered[:-1])
        found = every[by[new]]
        rank = np.argsort(found)
        order, _ = _dealt(found[rank], buckets)
        each = np.empty(len(order))
        each[rank[order]] = scores
        out = np.empty(len(every))
        out[by] = np.repeat(each, np.diff(np.flatnonzero(new), append=len(every)))
        return out


def _once(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def _dealt(found: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of sorted windows by bucket, then value; where each bucket starts in it)."""
    bucket = bucket_of(neighbourhood(found), buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def bucket_of(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _counted(buckets: int, kinds: str):
    """Each batch's distinct words (t) and windows (w) with their training counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, a, b, c in zip(*(rows[x].to_pylist() for x in ("batch", "a", "b", "c"))):
                batch = _Batch(a, b, c)
                if "t" in kinds:
                    codes, index, counts = batch.words()
                    trained = np.bincount(index[np.repeat(~batch.held, counts)], minlength=len(codes)).astype(np.uint32)
                    cut = np.searchsorted(bucket_of(codes, buckets), np.arange(buckets + 1))
                    for k in np.flatnonzero(cut[1:] > cut[:-1]):
                        x, y = cut[k], cut[k + 1]
                        yield _row("t", int(k), number, ascending(codes[x:y]), planes(trained[x:y]))
                window, cut, *times = batch.distinct(buckets) if "t" in kinds else batch.asked(buckets)
                for k in np.flatnonzero(cut[1:] > cut[:-1]):
                    x, y = cut[k], cut[k + 1]
                    yield _row("w", int(k), number, ascending(window[x:y]), planes(times[0][x:y]) if times else b"")
        shared.release()

    return run


def _runs(batches: Iterator[pa.RecordBatch], same: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Each run of rows that agree in the given columns; its rows are read as they are asked for."""
    rows = (row for batch in batches for row in batch.to_pylist())
    ahead = next(rows, None)
    while ahead is not None:
        key = tuple(ahead[c] for c in same)

        def mine() -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and tuple(ahead[c] for c in same) == key:
                row, ahead = ahead, next(rows, None)
                yield row

        run = mine()
        yield key, run
        for _ in run:  # what was not asked for
            pass


def _summed(rows: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of the columns beside them, merged whenever UNMERGED have come together."""
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        key, *columns = (np.concatenate(x) for x in zip(*held))
        by = np.argsort(key, kind="stable")  # of sorted runs
        key = key[by]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return key[first], *(np.add.reduceat(c[by], first) if len(first) else c for c in columns)

    size = least = 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size > least + UNMERGED:
            held = [merged()]
            size = least = len(held[0][0])
    return merged() if held else ()


def _merged(shards: int):
    """Of each bucket: its words' sums, back to the batches (c); its windows with their counts (x); shorter contexts (n)."""

    def words(bucket: int, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        asked = [(r["batch"], unascending(r["a"]), unplanes(r["b"], np.uint32).astype(np.int64)) for r in rows]
        distinct, sums = _summed((codes, n) for _, codes, n in asked)
        yield _row("v", bucket, int(np.count_nonzero(sums)), np.int64(sums.sum()).tobytes())
        for batch, codes, _ in asked:
            yield _row("c", bucket, batch, planes(sums[np.searchsorted(distinct, codes)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), rows in _runs(batches, ("kind", "bucket")):
            if kind == "t":
                yield from words(bucket, rows)
                continue
            window, times = _summed((unascending(r["a"]), unplanes(r["b"], np.uint32).astype(np.int64)) for r in rows)
            yield _row("x", bucket, -1, ascending(window), planes(times))
            trained = times > 0
            window, times = window[trained], times[trained]
            for order in range(1, DENSE + 1):
                place, zero, one = contexts(window, times, order)
                shard = (place >> np.uint64(8)) % np.uint64(shards)
                for k in np.unique(shard):
                    mine = shard == k
                    yield _row("n", (order << 32) + int(k), bucket, ascending(place[mine]), planes(zero[mine]), planes(one[mine]))
        shared.release()

    return run


def _shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's short contexts with their counts over all buckets."""
    for (shard,), rows in _runs(batches, ("bucket",)):
        place, zero, one = _summed((unascending(r["a"]), unplanes(r["b"], np.int64), unplanes(r["c"], np.int64)) for r in rows)
        yield _row("m", shard, -1, ascending(place), planes(zero), planes(one))


def _dense(merged: DataFrame) -> list[Dense]:
    """The tables of the dense orders."""
    pieces = shared.written(merged.where("kind = 'n'").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shorter, _ROWS))
    out = [Dense(order) for order in range(1, DENSE + 1)]
    for r in pieces.toLocalIterator():  # 2**24 places at most
        out[(r["bucket"] >> 32) - 1].add(unascending(r["a"]).astype(np.int64), unplanes(r["b"], np.int64), unplanes(r["c"], np.int64))
    shared.drop(pieces)
    return out


def _told(dense, mixer: Mixer, mapping: bool):
    """The mixer's sums over all training windows of a task's buckets, a row for each position of a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, rows in _runs(batches, ("bucket",)):
            for r in rows:
                window, times = unascending(r["a"]), unplanes(r["b"], np.int64)
                window, times = window[times > 0], times[times > 0]
                tables = [*dense.value, *(Checked(window, times, order) for order in _LONG)]
                total = total + mixer.sums(window, times, lambda w: lambda i, _, node: tables[i].counts(w, node), mapping)  # noqa: B023
        if not isinstance(total, int):
            for position, sums in enumerate(total):
                yield _row("g", position, -1, planes(sums))
        shared.release()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (position,), rows in _runs(batches, ("bucket",)):
        yield _row("g", position, -1, sum(unplanes(r["a"], np.int64) for r in rows).tobytes())


def _fitted(held: DataFrame, dense) -> Mixer:
    """The mixer, fitted to all training windows; held: the buckets' windows with their counts."""
    mixer = Mixer()
    for k in range(ROUNDS + 1):
        told = held.mapInArrow(_told(dense, mixer, k == ROUNDS), _ROWS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_added, _ROWS)
        sums = [np.frombuffer(r["a"], np.int64) for r in sorted(told.select("bucket", "a").collect(), key=lambda r: r["bucket"])]  # 8 rows
        if sums:
            (mixer.remap if k == ROUNDS else mixer.step)(np.stack(sums))
    return mixer


def _window_scores(dense, mixer: Mixer):
    """Each bucket's windows are scored once, and go to the batches that have them, in the order they were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in _runs(batches, ("bucket",)):
            held = next(rows)  # the bucket's own row comes first: its batch is -1
            window, times = unascending(held["a"]), unplanes(held["b"], np.int64)
            score = log10(mixer, [*dense.value, *(Checked(window, times, order) for order in _LONG)], window).astype(np.float32)
            for r in rows:
                yield _row("p", bucket, r["batch"], planes(score[np.searchsorted(window, unascending(r["a"]))]))
        shared.release()

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _scored(buckets: int, total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, ("batch",)):
            parts: dict[str, list] = {"c": [], "d": [], "p": []}
            for r in rows:
                parts[r["kind"]].append((r["bucket"], r["a"], r["b"], r["c"]))
            batch = _Batch(*parts["d"][0][1:])
            count = np.concatenate([unplanes(a, np.int64) for _, a, _, _ in sorted(parts["c"])])
            _, index, tokens = batch.words()
            starts = np.cumsum(tokens) - tokens
            each = np.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
            base = np.add.reduceat(each[index], starts)
            known = np.add.reduceat((count > 0).astype(np.int64)[index], starts)
            scores = np.concatenate([unplanes(a, np.float32) for _, a, _, _ in sorted(parts["p"])]).astype(float)
            score = np.add.reduceat(batch.scored(buckets, scores), batch.ends - batch.sizes)
            n = len(tokens)
            yield pa.record_batch({
                "doc_id": pa.array(batch.ids, pa.int64()), "held_out": pa.array(batch.held), "n_tokens": pa.array(tokens), "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, total)),
                "base_score": pa.array(base), "score": pa.array(score), "n_bytes": pa.array(batch.sizes), "bits_per_byte": pa.array(-score / np.log10(2) / batch.sizes),
            })
        shared.release()

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """Each row's base and model log10 probabilities, from all training rows (crc32 of doc_id modulo 10 not 0).

    A null or empty text is its end alone. A null doc_id counts as the text '' (held out). Repeated rows count as often
    as they occur. An empty table gives no rows; if no row trains, all counts are 0. Other columns are not read.
    """
    spark = docs.sparkSession
    batched = shared.written(shared.texts(docs).mapInArrow(_batched, _ROWS))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = batched.mapInArrow(_counted(buckets, "tw"), _ROWS).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "batch")
    merged = shared.written(keyed.mapInArrow(_merged(64), _ROWS))
    total = distinct = 0
    for row in merged.where("kind = 'v'").select(F.col("batch").alias("distinct"), "a").toLocalIterator():  # two numbers for each bucket
        total, distinct = total + int(np.frombuffer(row["a"], np.int64)[0]), distinct + row["distinct"]
    held = merged.where("kind = 'x'")
    dense = spark.sparkContext.broadcast(_dense(merged))
    mixer = _fitted(held, dense)
    asked = held.unionByName(batched.mapInArrow(_counted(buckets, "w"), _ROWS))
    scores = asked.repartition("bucket").sortWithinPartitions("bucket", "batch").mapInArrow(_window_scores(dense, mixer), _ROWS)
    rows = batched.unionByName(merged.where("kind = 'c'")).unionByName(scores)
    return rows.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(_scored(buckets, total, distinct), _RESULT)
