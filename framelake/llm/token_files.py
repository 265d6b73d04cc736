"""Token-ID output in patched frame-of-reference blocks.

Documents are range-partitioned by id and sorted, encoded, and cut at document
borders into segments.  A segment's ids are written in blocks of BLOCK ids: the
block's minimum is subtracted, the rest packed at the width that the given
percentile of values needs, and the values that do not fit are kept whole in an
exception list.  An index gives each block's first byte, so one block can be
read by itself.  Segments are rows of a Parquet table, so any store that Spark
writes to will do, and Spark's commit protocol covers lost tasks.

A block is, little-endian: u32 minimum, u16 ids, u8 width, u8 zero, u16
exceptions, u16 zero, the packed ids (most significant bit first, padded to a
byte), the exceptions' u16 positions, then their u32 values.

Null texts count as empty: such a document is the end id alone.  Null ids come
first; rows with the same id are ordered by their text's hash and each is
written.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import slices
from .packing import with_end
from .tokens import Encoder, default_path

BLOCK, PERCENTILE, END_ID = 256, 90, 0
_HEAD = np.dtype([("low", "<u4"), ("n", "<u2"), ("width", "u1"), ("_", "u1"), ("patches", "<u2"), ("__", "<u2")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as bits end to end, most significant first, padded to a byte: eight values are width bytes."""
    rows, n = values.shape
    groups = -(-n // 8)
    eight = np.zeros((rows, groups * 8), np.uint32)
    eight[:, :n] = values
    columns = np.ascontiguousarray(eight.reshape(-1, 8).T)
    out = np.zeros((width, rows * groups), np.uint8)
    for k in range(8):
        for byte in range(k * width // 8, ((k + 1) * width + 7) // 8):
            up = 8 * (byte + 1) - (k + 1) * width
            out[byte] |= (columns[k] << np.uint32(up) if up >= 0 else columns[k] >> np.uint32(-up)).astype(np.uint8)
    return np.ascontiguousarray(out.T).reshape(rows, -1)[:, : (n * width + 7) // 8]


def _unpack(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    """The n values in each row of _pack."""
    rows, groups = len(packed), -(-n // 8)
    eight = np.zeros((rows, groups * width), np.uint8)
    eight[:, : packed.shape[1]] = packed
    columns = np.ascontiguousarray(eight.reshape(-1, width).T).astype(np.uint32)
    out = np.zeros((8, rows * groups), np.uint32)
    for k in range(8):
        for byte in range(k * width // 8, ((k + 1) * width + 7) // 8):
            up = 8 * (byte + 1) - (k + 1) * width
            out[k] |= columns[byte] >> np.uint32(up) if up >= 0 else columns[byte] << np.uint32(-up)
    out &= np.uint32((1 << width) - 1)
    return np.ascontiguousarray(out.T).reshape(rows, -1)[:, :n]


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The packed blocks of ids (unsigned 32-bit) and each block's first byte."""
    ids = np.asarray(ids, np.uint32)
    count = -(-len(ids) // block)
    if not count:
        return b"", np.zeros(0, np.int64)
    sizes = np.full(count, block)
    sizes[-1] = len(ids) - (count - 1) * block
    grid = np.full(count * block, ids[-1], np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(count, block)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    kth = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    at = np.partition(rest, kth, axis=1)[:, kth].astype(np.float64)
    width = np.ceil(np.log2(at + 1)).astype(np.int64)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    over.reshape(-1)[len(ids) :] = False
    patches = over.sum(axis=1)
    payload = (sizes * width + 7) // 8
    lengths = _HEAD.itemsize + payload + 6 * patches
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    head = np.zeros(count, _HEAD)
    head["low"], head["n"], head["width"], head["patches"] = low, sizes, width, patches
    out[(starts[:, None] + np.arange(_HEAD.itemsize)).reshape(-1)] = head.view(np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero((width == w) & (sizes == block))
        tail = np.flatnonzero((width == w) & (sizes < block))
        for some in (rows, tail):
            if len(some):
                n = int(sizes[some[0]])
                packed = _pack(rest[some, :n] & np.uint32((1 << int(w)) - 1), int(w))
                out[(starts[some, None] + _HEAD.itemsize + np.arange(packed.shape[1])).reshape(-1)] = packed.reshape(-1)
    if patches.any():
        b, place = np.nonzero(over)
        k = common.runs(patches)
        base = (starts + _HEAD.itemsize + payload)[b]
        out[((base + 2 * k)[:, None] + np.arange(2)).reshape(-1)] = place.astype("<u2").view(np.uint8)
        out[((base + 2 * patches[b] + 4 * k)[:, None] + np.arange(4)).reshape(-1)] = rest[b, place].astype("<u4").view(np.uint8)
    return out.tobytes(), starts


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at `starts`."""
    raw, starts = np.frombuffer(data, np.uint8), np.asarray(starts, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    head = raw[(starts[:, None] + np.arange(_HEAD.itemsize)).reshape(-1)].view(_HEAD)
    sizes, width, patches = (head[n].astype(np.int64) for n in ("n", "width", "patches"))
    payload = (sizes * width + 7) // 8
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    for w, n in {(int(a), int(b)) for a, b in zip(width, sizes, strict=True)}:
        some = np.flatnonzero((width == w) & (sizes == n))
        if w:
            packed = raw[(starts[some, None] + _HEAD.itemsize + np.arange((n * w + 7) // 8))]
            out[(first[some, None] + np.arange(n)).reshape(-1)] = _unpack(packed, n, w).reshape(-1)
    if patches.any():
        b = np.repeat(np.arange(len(starts)), patches)
        k = common.runs(patches)
        base = (starts + _HEAD.itemsize + payload)[b]
        place = raw[((base + 2 * k)[:, None] + np.arange(2)).reshape(-1)].view("<u2")
        out[first[b] + place] = raw[((base + 2 * patches[b] + 4 * k)[:, None] + np.arange(4)).reshape(-1)].view("<u4")
    return out + np.repeat(head["low"], sizes)


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID, block: int = BLOCK, percentile: float = PERCENTILE, tokenizer_path: str | None = None) -> None:
    """Write the segments of all documents, in ascending doc_id order, to a Parquet table at path.

    A row: shard and segment (together the order), first (ids before it in its
    shard), payload, block_starts, and doc_ids with doc_tokens for each document.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("first", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("block_starts", T.ArrayType(T.LongType())), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("doc_tokens", T.ArrayType(T.LongType()))])
    vocabulary = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, segment, first = Encoder.of(vocabulary), TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches):
            flat, offsets = with_end(*encoder.encode(batch.column(1)), end_id)
            payload, starts = pack_blocks(flat, block, percentile)
            row = [[shard], [segment], [first], [payload]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.int64()), pa.array(row[3], pa.binary()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(starts), batch.column(0), pa.array(np.diff(offsets))))], names=schema.names)
            segment, first = segment + 1, first + len(flat)

    keyed = docs.select("doc_id", "text", common.text_hash("text").alias("order_hash"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = keyed.repartitionByRange(parts, "doc_id", "order_hash").sortWithinPartitions("doc_id", "order_hash")
    ordered.select("doc_id", "text").mapInArrow(run, schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document from the files alone: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    totals = files.select("shard", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # One row a shard: a task's totals, not its documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = T.StructType([T.StructField("doc_id", files.schema["doc_ids"].dataType.elementType), T.StructField("shard", T.LongType()), T.StructField("local", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, payload, starts = (batch.column(k)[i].as_py() for k in range(4))
                ids, counts = unpack_blocks(payload, starts).astype("<u4"), batch.column(5)[i].values.to_numpy()
                ends = np.cumsum(counts)
                raw = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(4)[i].values, pa.array(np.full(len(counts), shard)), pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=schema.names)

    docs = files.select("shard", "first", "payload", "block_starts", "doc_ids", "doc_tokens").mapInArrow(run, schema)
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_table_path(spark, "token_files")
    write_token_files(common.documents(spark, sf_dir), path)
    return read_token_files(spark, path)
