"""Helpers the corpus operators share: shared-folder tables, words, document identity."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one step of a task works on at a time.
SLICE_BYTES = 6_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a session in one process takes a temporary folder; on
    a cluster that would be another one on each machine, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("framelake.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("framelake.scratch", folder)
    return folder.rstrip("/")


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/framelake-{uuid.uuid4().hex}/{label}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_table_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys whose rows are settled by a broadcast, at most: each holds more than one in HEAVY of all rows.
HEAVY = 1024


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """left joined to right, which has one row for each of left's keys and, in `count`, its rows in left.

    Keys with more than total / HEAVY rows, of which there are fewer than HEAVY,
    are broadcast, so that a hot key's rows stay where they are; only the rest
    are shuffled.  No key is null.
    """
    heavy = F.col(count) * HEAVY > total
    named = right.where(heavy).drop(count).withColumn("__fl_heavy", F.lit(True))
    near = left.join(F.broadcast(named.limit(HEAVY)), keys, "left")
    rest = near.where("__fl_heavy is null").select(*left.columns).join(right.where(~heavy).drop(count), keys)
    return near.where("__fl_heavy").drop("__fl_heavy").unionByName(rest)


def in_parts(rows: DataFrame, keys: list[Column], label: str) -> DataFrame:
    """rows in order of the keys, written once as parts of a bounded size, with their part's number."""
    return materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()), label)


def running(parts: DataFrame, keys: list[Column], column: Column, into: str) -> DataFrame:
    """The sum of the column over all rows that come before in the order of the keys; parts as made by in_parts.

    A task sees one part; what comes before a part is summed over one row for each part.
    """
    totals = parts.groupBy("part").agg(F.sum(column).alias("__fl_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("__fl_n").over(before), F.lit(0)).alias("__fl_base"))
    within = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("__fl_place", F.coalesce(F.sum(column).over(within), F.lit(0)))
    return placed.join(F.broadcast(bases), "part").withColumn(into, F.col("__fl_base") + F.col("__fl_place")).drop("__fl_base", "__fl_place")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs named by kept(doc_id, text_hash), one for each pair, with the columns of docs.

    text_hash is xxhash64 of the text as it stands.  The window's limit is
    applied before its shuffle, so repeated rows never meet in one task, and the
    join keeps its partitioning, so that texts are shuffled once.
    """
    key = "__fl_key"
    # Hashes are never null, and must be seen so on both sides: keys of unlike types would be cast and shuffled again.
    named = kept.select(F.struct("doc_id", F.coalesce("text_hash", F.lit(0).cast("long")).alias("hash")).alias(key)).distinct()
    marked = docs.withColumn(key, F.struct("doc_id", text_hash("text").alias("hash")))
    first = marked.withColumn("__fl_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))).where("__fl_rank = 1")
    return first.join(named, key).select(*[F.col(f"`{c}`") for c in docs.columns])


def text_hash(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that each holds about `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, size = batch.schema.get_field_index(column), 0
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            size = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, size + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, end to end, and the rows' n + 1 offsets; nulls are empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    column = pa.concat_arrays([column])  # drops a slice's offset
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array, lower: bool = True, between: np.ndarray = _SPACE) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each row: row offsets into the words, the words, their byte starts and ends in the row block.

    between tells which bytes part words, if not white space; none beyond ASCII.
    """
    data, rows = text_bytes(column)
    if lower:
        data = _LOWER[data]
    space = between[data]
    first = ~space
    last = first.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    if len(data):
        first[1:] &= space[:-1] | edge[1:-1]
        last[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    body = np.ascontiguousarray(data[~space])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(body))
    return np.searchsorted(starts, rows), words, starts, ends


def coded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row offsets into the words, each word's code, and the distinct words by code."""
    offsets, words, _, _ = split_words(column)
    coded = words.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hashes that do not depend on the process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n word hashes; the k-th stands for words k to k + n - 1."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mix64(codes[i : len(codes) - n + 1 + i] + np.uint64(i + 1))
    return mix64(total)


def segment_ids(offsets: np.ndarray) -> np.ndarray:
    """The row of each item, from n + 1 offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, end to end."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
