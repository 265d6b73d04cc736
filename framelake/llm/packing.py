"""Packing by power-of-two decomposition.

Each document's ids (with an end id) are cut into as many full sequences as fit
and then into pieces whose lengths are the set bits of what is left.  Every
piece is a sequence of its own, of a power-of-two length: nothing is padded and
no sequence crosses documents.  Pieces of equal length form a bucket, from
which batches of one shape are drawn.

The job is one pass over the documents with no shuffle: a piece's sequence id
is its bucket, its task and its rank there, so tasks need not wait for another.

Null texts count as empty: such a document is the end id alone.  Repeated rows
and repeated or null ids are packed one by one.  An empty table gives no rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .common import slices
from .tokens import Encoder, default_path

MAX_LENGTH, END_ID = 2048, 1
#: Bytes of text a task encodes at a time: less than elsewhere, for ids and caches stand beside it.
PACK_BYTES = 3_000_000
#: Pretokens a packing task remembers.
PACK_CACHE = 250_000
#: The same two in the pipeline, whose workers have run its other stages before and still hold what those took.
STAGE_BYTES, STAGE_CACHE = 1_500_000, 100_000


def with_end(flat: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' ids with end_id after each row."""
    out = np.insert(flat, offsets[1:], end_id).astype("<u4")
    return out, offsets + np.arange(len(offsets))


def decompose(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of each piece: full ones first, then set bits from the highest."""
    bits = most.bit_length() - 1
    full = lengths // most
    left = lengths - full * most
    rows = np.repeat(np.arange(len(lengths)), full)
    parts = [(rows, common.runs(full) * most, np.full(len(rows), most, np.int64))]
    done = full * most
    for b in range(bits - 1, -1, -1):
        has = np.flatnonzero(left >> b & 1)
        parts.append((has, done[has], np.full(len(has), 1 << b, np.int64)))
        done[has] += 1 << b
    row, start, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, row))
    return row[order], start[order], length[order]


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, end_id: int = END_ID, tokenizer_path: str | None = None, with_ids: bool = True, slice_bytes: int = PACK_BYTES, cache: int = PACK_CACHE) -> DataFrame:
    """One row for each piece, which is a whole sequence.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset (always 0),
    bucket (log2 of the length), ids_crc32 and, unless with_ids is off, ids.
    max_length must be a power of two.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    id_type = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", id_type)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("bucket", T.IntegerType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(path, cache), TaskContext.get().partitionId()
        ranks = np.zeros(max_length.bit_length(), np.int64)
        for batch in slices(batches, most=slice_bytes):
            flat, offsets = with_end(*encoder.encode(batch.column(1)), end_id)
            tokens = np.diff(offsets)
            row, start, length = decompose(tokens, max_length)
            bucket = np.log2(length).astype(np.int64)
            rank = np.zeros(len(row), np.int64)
            for b in np.unique(bucket):
                at = bucket == b
                rank[at] = ranks[b] + np.arange(at.sum())
                ranks[b] += at.sum()
            begin, raw = (offsets[row] + start) * 4, memoryview(flat.view(np.uint8))
            crc = np.fromiter((zlib.crc32(raw[b : b + n]) for b, n in zip(begin.tolist(), (length * 4).tolist(), strict=True)), np.int64, len(row))
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc), pa.array(tokens[row])]
            columns += [pa.array(bucket << 58 | task << 36 | rank), pa.array(np.zeros(len(row), np.int64)), pa.array(bucket.astype(np.int32))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(offsets[row] + start, offsets[-1]).astype(np.int32)), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces as Parquet with one folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces with their ids."""
    return pack(docs, slice_bytes=STAGE_BYTES, cache=STAGE_CACHE)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir), with_ids=False)
