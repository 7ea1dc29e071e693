"""Packing along a space-filling curve.

Each document's tokens are counted into a hashed vector, which a fixed random matrix projects to a few dimensions; the
projection's cell gives a Hilbert key. Documents are range-sorted by (key, doc_id) and laid end to end into sequences
of a fixed length, so that documents that share vocabulary share sequences. What is left at a partition's end is cut
into power-of-two sequences, which need no padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plumbline.llm import shared
from plumbline.llm.wordtok import word_tokenizer

BUCKETS, SEED = 512, 20240611
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer coordinates (below 2**bits), as int64."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations from the coarsest level on
        q, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[-1] & (1 << level)) != 0, flip ^ ((1 << level) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> bit) & 1)
    return key


class Curve:
    """Hilbert keys of documents from their token ids."""

    def __init__(self, vocabulary: int, dims: int, bits: int) -> None:
        random = np.random.default_rng(SEED)
        self.bucket = random.integers(0, BUCKETS, vocabulary + 1)
        self.sign = random.choice(np.array([-1.0, 1.0]), vocabulary + 1)
        self.project = random.standard_normal((BUCKETS, dims))
        self.bits = bits

    def keys(self, documents: list[np.ndarray]) -> np.ndarray:
        hashed = np.zeros((len(documents), BUCKETS))
        for row, ids in zip(hashed, documents):
            row += np.bincount(self.bucket[ids], weights=self.sign[ids], minlength=BUCKETS)
        hashed = np.sign(hashed) * np.log1p(np.abs(hashed))
        norm = np.linalg.norm(hashed, axis=1, keepdims=True)
        at = (hashed / np.where(norm == 0, 1, norm)) @ self.project  # about standard normal in each dimension
        share = 0.5 * (1 + np.tanh(at * math.sqrt(2 / math.pi)))
        return hilbert_key(np.minimum(share * (1 << self.bits), (1 << self.bits) - 1).astype(np.int64), self.bits)


def _tokenised(path: str, end_id: int, dims: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        curve = Curve(tokenizer.vocabulary_size, dims, bits)
        end = np.array([end_id], tokenizer.dtype).tobytes()
        for batch in batches:
            docs = shared.as_bytes(batch["text"])
            for a, b in shared.chunks(docs, 2 << 20):
                ids = [x + end for x in tokenizer.encode(docs[a:b])]
                keys = curve.keys([np.frombuffer(x, tokenizer.dtype) for x in ids])
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(a, b - a), "hilbert": pa.array(keys), "ids": pa.array(ids, pa.binary()), "width": pa.array([tokenizer.dtype.itemsize] * len(ids), pa.int32())})
        shared.release()

    return run


def _packed(seq_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        room = seq_len  # what the open sequence still holds
        number = 0
        held: list[tuple] = []  # pieces of the open sequence, which may be the partition's last

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 8
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

        def piece(doc_id, start: int, ids: bytes, width: int, total: int, at: int, length: int) -> tuple:
            whole = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            return doc_id, start, len(ids) // width, zlib.crc32(whole), total, (partition << 32) + number, at, length

        for batch in batches:
            out = []
            for doc_id, ids, width in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), batch["width"].to_pylist()):
                total, start = len(ids) // width, 0
                while start < total:
                    n = min(room, total - start)
                    held.append((doc_id, start, ids[start * width : (start + n) * width], width, total, seq_len - room))
                    start, room = start + n, room - n
                    if not room:
                        out += [piece(*p, seq_len) for p in held]
                        held, room, number = [], seq_len, number + 1
            yield emit(out)
        out, left = [], seq_len - room
        size, filled = 1 << (left.bit_length() - 1) if left else 0, 0
        for doc_id, start, ids, width, total, _ in held:  # the rest: sequences of falling powers of two
            n, at = len(ids) // width, 0
            while at < n:
                take = min(size - filled, n - at)
                out.append(piece(doc_id, start + at, ids[at * width : (at + take) * width], width, total, filled, size))
                at, filled = at + take, filled + take
                if filled == size:
                    left, filled, number = left - size, 0, number + 1
                    size = 1 << (left.bit_length() - 1) if left else 0
        yield emit(out)

    return run


def pack_along_curve(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, dims: int = 4, bits: int = 12) -> DataFrame:
    """Pieces of documents in sequences of seq_len tokens; each id of each document lies in exactly one piece.

    A null or empty text is one token, the end. Repeated rows and ids are packed as documents of their own; ties of the
    Hilbert key are broken by doc_id (null first), then by the ids, so a group of copies of any size spreads over
    partitions. An empty table gives no pieces. Other columns of docs are not read. Sequences are at most seq_len long,
    whose pieces' offsets have no gap; one that is shorter has a power of two of tokens.
    """
    columns = shared.texts(docs)
    tokens = shared.written(columns.mapInArrow(_tokenised(tokenizer_path, end_id, dims, bits), "doc_id long, hilbert long, ids binary, width int"))
    order = ["hilbert", "doc_id"]
    return tokens.repartitionByRange(*order).sortWithinPartitions(*order, "ids").mapInArrow(_packed(seq_len), PIECES)
