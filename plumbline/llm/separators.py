"""Document lengths of flat token files that have no index.

A file is a run of little-endian ids in which each document ends with a separator id. Files are read in byte ranges, so
that a large one is spread over tasks; blocks are searched for the separator by vector comparison, each on its own, and
documents that cross blocks are stitched by a two-level prefix scan over the blocks' summaries, never over their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import shared
from plumbline.llm.wordtok import word_tokenizer

#: Ids in a block, blocks in a byte range that a task reads at a time, and blocks in a group of the prefix scan's lower level.
BLOCK_IDS, RANGE_BLOCKS, GROUP_BLOCKS = 1 << 16, 64, 64
BLOCKS = "file string, block long, ids binary"


def _file(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def _cut(file: str, first: int, data: bytes, step: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(data), step):
        yield pa.record_batch({"file": [file], "block": pa.array([first + k // step], pa.int64()), "ids": pa.array([data[k : k + step]], pa.binary())})


def read_blocks(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """Blocks of all flat files under path, of any length, as rows (file, block, ids). A file without ids has no rows.

    A table of byte ranges (file, offset, length) is dealt to the tasks, which read their ranges alone. Where pyarrow
    doesn't know the storage, Spark's own reader fetches whole files, which then may have 2 GB each and no more.
    """
    step = block_ids * width
    files = spark.read.format("binaryFile").load(path)
    some = files.select("path").first()
    try:
        _file(some["path"] if some else "file:/")
    except pa.ArrowInvalid:  # storage that pyarrow doesn't know
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                    yield from _cut(file, 0, content, step)

        return files.select("path", "content").mapInArrow(whole, BLOCKS)
    span = step * range_blocks
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(span).cast("long")))
    ranges = files.where("length > 0").select("path", "length", at.alias("offset"))
    ranges = ranges.select("path", "offset", F.least(F.lit(span), F.col("length") - F.col("offset")).alias("length"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, length in zip(*(batch[c].to_pylist() for c in ("path", "offset", "length"))):
                system, name = _file(file)
                with system.open_input_file(name) as f:
                    f.seek(offset)
                    yield from _cut(file, offset // step, f.read(length), step)

    return ranges.repartition(tasks, "path", "offset").mapInArrow(run, BLOCKS)


def write_flat_files(docs: DataFrame, path: str, tokenizer_path: str, separator: int) -> None:
    """Flat files under path, one for each partition of docs in its order: a text's ids (null: none), then the separator.

    A text may spell the separator's own token; such ids would end its document early and are left out of it.
    Spark's text writer commits the files: a document is a line of raw bytes, and the separator's bytes end the line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        end = np.array([separator], tokenizer.dtype)[0]
        for batch in batches:
            texts = shared.as_bytes(batch["text"])
            for a, b in shared.chunks(texts, 4 << 20):
                lines = []
                for x in tokenizer.encode(texts[a:b]):
                    ids = np.frombuffer(x, tokenizer.dtype)
                    lines.append(ids[ids != end].tobytes() if (ids == end).any() else x)
                yield pa.record_batch({"value": pa.array(lines, pa.binary())})

    end = np.array([separator], word_tokenizer(tokenizer_path).dtype).tobytes().decode("latin-1")
    lines = shared.texts(docs).select("text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", end).option("compression", "none").text(path)


def _search(separator: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.frombuffer(x or b"", f"<u{width}") == separator).astype(np.int64) for x in batch["ids"].to_pylist()]
            sizes = [len(x or b"") // width for x in batch["ids"].to_pylist()]
            yield pa.record_batch({"file": batch["file"], "block": batch["block"], "size": pa.array(sizes, pa.int64()), "ends": pa.array([x.tolist() for x in found], pa.list_(pa.int64()))})

    return run


def scan_separators(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, document, start, length, closed) of every document: its ordinal in the file, first id and count of ids.

    blocks: (file, block, ids), all blocks of a file but the last of one size, no block twice. The length counts the
    separator. Ids after the last separator are a document that isn't closed. Two separators in a row hold a document of
    length 1 (an empty text). A block without separators, or that is empty or null, only carries its ids on; a file
    without ids has no documents. Blocks without file or number have no place and are left out; an empty table gives no
    rows. Other columns of blocks are not read.
    """
    columns = blocks.select(F.col("file").cast("string").alias("file"), F.col("block").cast("long").alias("block"), "ids").where("file IS NOT NULL AND block IS NOT NULL")
    searched = shared.written(columns.mapInArrow(_search(separator, width), "file string, block long, size long, ends array<long>"))
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    each = searched.select("file", "block", "size", F.size("ends").cast("long").alias("n"), last.alias("last"), F.floor(F.col("block") / GROUP_BLOCKS).alias("group"))
    # upper level: a row for each group of blocks
    groups = each.groupBy("file", "group").agg(F.sum("size").alias("g_size"), F.sum("n").alias("g_n"), F.max("block").alias("g_last_block"))
    before = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "group", F.coalesce(F.sum("g_size").over(before), F.lit(0)).alias("g_at"), F.coalesce(F.sum("g_n").over(before), F.lit(0)).alias("g_docs"), (F.max("group").over(Window.partitionBy("file")) == F.col("group")).alias("g_final"), "g_last_block")
    # lower level: within a group
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.join(groups, ["file", "group"]).select(
        "file", "block", "group", "size", "n", "g_final", "g_last_block",
        (F.col("g_at") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("at"),
        (F.col("g_docs") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("docs"), "last",
    )
    open_in = F.max(F.col("at") + F.col("last") + 1).over(inside)  # where the document open at the block's start began, if in this group
    placed = placed.withColumn("open_in", open_in)
    tails = placed.groupBy("file", "group").agg(F.max(F.col("at") + F.col("last") + 1).alias("g_open"))
    tails = tails.select("file", "group", F.max("g_open").over(before).alias("open_before"))
    ready = placed.join(tails, ["file", "group"]).select("file", "block", "size", "at", "docs", "g_final", "g_last_block", F.coalesce("open_in", "open_before", F.lit(0)).alias("open_at"))
    joined = searched.select("file", "block", "ends").join(ready, ["file", "block"])
    ends = F.transform("ends", lambda e: e + F.col("at"))
    starts = F.concat(F.array("open_at"), F.transform(ends, lambda e: e + 1))
    final = F.col("g_final") & (F.col("block") == F.col("g_last_block"))
    stop = F.col("at") + F.col("size") - 1
    rest = F.when(final & (F.element_at(starts, -1) <= stop), F.array(stop)).otherwise(F.array().cast("array<bigint>"))
    pieces = F.zip_with(F.slice(starts, F.lit(1), F.size(F.concat(ends, rest))), F.concat(ends, rest), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    out = joined.select("file", "docs", F.size("ends").alias("n"), F.posexplode(pieces).alias("k", "piece"))
    return out.select("file", (F.col("docs") + F.col("k")).alias("document"), F.col("piece.start").alias("start"), (F.col("piece.end") - F.col("piece.start") + 1).alias("length"), (F.col("k") < F.col("n")).alias("closed"))
