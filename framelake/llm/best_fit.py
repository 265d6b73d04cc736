"""Best-fit packing with certified repacking.

A document's ids (with an end id) stay whole where they fit into a sequence; a
longer one is cut into full sequences, which are bins of their own, and a
shorter first piece.  The rest is bin packing of integer lengths:

* pieces are dealt over partitions of a bounded number of pieces, and each
  partition is packed by best-fit decreasing;
* lower bounds from dual-feasible functions tell the least number of bins that
  any packing of the partition's pieces has.  A partition whose number equals
  its bound is certified and can only lose what its bound was rounded up by, so
  it keeps all bins but its emptiest;
* a partition with a gap keeps its full bins, and gives up the documents of all
  others.  What is given up is dealt anew over as many partitions as it needs and
  packed by best-fit decreasing again, until one partition holds all that is
  left, or a round no longer helps.  A last partition that still has a gap takes as many
  settled bins back in and tries again; the better packing stays.

Only piece rows of some 60 bytes are shuffled, never texts or ids; a partition
has at most about PART_PIECES of them, however many copies a document has.
`bound_of` gives the bound of all pieces together, from their numbers by length.

Null texts count as empty: such a document is the end id alone.  Texts of any
length are read whole, a few megabytes at a time; one that is longer stands
alone.  Repeated rows and repeated or null ids are packed one by one.  An empty
table gives no rows.  Columns other than doc_id and text are not read, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .packing import with_end
from .tokens import Encoder, default_path

MAX_LENGTH, END_ID = 2048, 0
#: Pretokens a task remembers.
CACHE = 450_000
#: Pieces of a partition, about; rounds of exchange at most; tries of a last partition with a gap.
PART_PIECES, ROUNDS, TRIES = 131_072, 12, 4
#: A round that saves a smaller share of the sequences it repacks is followed by the last one.
HELPED = 0.001


def cut(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of each piece: the first takes what full pieces leave."""
    pieces = np.maximum(-(-lengths // most), 1)
    row, piece = np.repeat(np.arange(len(lengths)), pieces), common.runs(pieces)
    first = lengths - (pieces - 1) * most
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * most)
    return row, piece, start, np.where(piece == 0, first[row], most)


def cut_documents(docs: DataFrame, max_length: int = MAX_LENGTH, end_id: int = END_ID, tokenizer_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 and, unless with_ids is off, ids of each piece."""
    fields = [T.StructField("uid", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = Encoder.of(path, CACHE), TaskContext.get().partitionId() << 36
        for batch in common.slices(batches, most=common.SLICE_BYTES):
            flat, offsets = with_end(*encoder.encode(batch.column(1)), end_id)
            row, piece, start, length = cut(np.diff(offsets), max_length)
            begin, raw = (offsets[row] + start) * 4, memoryview(flat.view(np.uint8))
            crc = np.fromiter((zlib.crc32(raw[b : b + n]) for b, n in zip(begin.tolist(), (length * 4).tolist(), strict=True)), np.int64, len(row))
            columns = [pa.array(made + np.arange(len(row))), batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(offsets[row] + start, offsets[-1]).astype(np.int32)), pa.array(flat.astype(np.int32))))
            made += len(row)
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The least number of bins, by dual-feasible functions of the lengths; counts[n] pieces have length n.

    Three families: Martello and Toth's, for each threshold; the rounding
    functions u(k); and Fekete and Schepers's, which count how many pieces of a
    threshold a bin's rest can hold.  All sums are exact integers.
    """
    size = np.flatnonzero(counts).astype(np.int64)
    number = counts[size].astype(np.int64)
    if not len(size):
        return 0
    best = -(-int((size * number).sum()) // capacity)
    for k in range(1, 101):
        whole = (k + 1) * size % capacity == 0
        value = np.where(whole, size * k, (k + 1) * size // capacity * capacity)  # in parts of k * capacity
        best = max(best, -(-int((value * number).sum()) // (k * capacity)))
    for low in size[size <= capacity // 2].tolist():
        kept = np.where(size > capacity - low, capacity, np.where(size < low, 0, size))
        best = max(best, -(-int((kept * number).sum()) // capacity))
        slots = capacity // low
        value = np.where(2 * size > capacity, 2 * (slots - (capacity - size) // low), np.where(2 * size == capacity, slots, 2 * (size // low)))
        best = max(best, -(-int((np.where(size < low, 0, value) * number).sum()) // (2 * slots)))
    big = int(number[2 * size > capacity].sum())
    return max(best, big)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the bins' fills; lengths fall.

    Lengths are integers, so bins wait in a stack for each rest, and a bit mask
    names the rests that are there: the tightest bin is one bit operation away.
    Equal pieces go into equal bins many at a time.
    """
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    waiting: dict[int, list[np.ndarray]] = {}
    mask = made = at = 0
    fills: list[np.ndarray] = []

    def put(rest: int, bins: np.ndarray) -> None:
        nonlocal mask
        if len(bins):
            waiting.setdefault(rest, []).append(bins)
            mask |= 1 << rest

    def fill(bins: np.ndarray, rest: int, size: int, each: int) -> None:
        nonlocal at
        stop = at + len(bins) * each
        bin_of[at:stop] = np.repeat(bins, each)
        offset[at:stop] = capacity - rest + np.tile(np.arange(each) * size, len(bins))
        at = stop
        put(rest - each * size, bins)

    sizes, first = np.unique(-lengths, return_index=True)
    for size, left in zip((-sizes).tolist(), np.diff(np.append(first, len(lengths))).tolist(), strict=True):
        while left:
            if found := mask >> size:
                rest = size + (found & -found).bit_length() - 1
                bins = waiting[rest].pop()
                if not waiting[rest]:
                    mask ^= 1 << rest
            else:
                rest = capacity
                bins = made + np.arange(-(-left // (capacity // size)))
                made += len(bins)
            each = rest // size
            full = min(len(bins), left // each)
            fill(bins[:full], rest, size, each)
            left -= full * each
            if left and full < len(bins):
                fill(bins[full : full + 1], rest, size, left)
                left, full = 0, full + 1
            if rest < capacity:
                put(rest, bins[full:])
    fills = np.zeros(made, np.int64)
    np.add.at(fills, bin_of, lengths)
    return bin_of, offset, fills


def retried(lengths: np.ndarray, capacity: int, bound: int, packed: tuple[np.ndarray, np.ndarray, np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A better packing, if one is found, of a last partition with a gap.

    Its open bins' pieces are packed again with those of as many bins drawn from the full ones, for
    best-fit decreasing leaves the largest rests to what it packs last.
    """
    random = np.random.default_rng(seed)
    for _ in range(TRIES):
        bin_of, offset, fills = packed
        if len(fills) <= bound:
            break
        opened = fills < capacity
        full = np.flatnonzero(~opened)
        opened[random.choice(full, min(len(full), int(opened.sum())), replace=False)] = True
        again = np.flatnonzero(opened[bin_of])
        new_bin, new_offset, new_fills = best_fit_decreasing(lengths[again], capacity)
        if len(new_fills) > opened.sum():
            continue
        number = np.cumsum(~opened) - 1
        bin_of, offset = number[bin_of], offset.copy()
        bin_of[again], offset[again] = new_bin + (~opened).sum(), new_offset
        packed = bin_of, offset, np.concatenate([fills[~opened], new_fills])
    return packed


def packer(columns: list[str], capacity: int, turn: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs one partition's pieces; `done` tells which stay, all of them in the last round."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        lengths, uid = table.column("length").to_numpy(), table.column("uid").to_numpy()
        order = np.lexsort((uid, -lengths))
        lengths, table = lengths[order], table.take(pa.array(order)).select(columns)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        packed = best_fit_decreasing(lengths, capacity)
        if last:
            packed = retried(lengths, capacity, bound, packed, turn)
        bin_of, offset, fills = packed
        done = np.ones(len(fills), bool) if last else fills == capacity
        if not last and len(fills) == bound:
            done[:] = True
            done[np.argmin(fills)] = fills.min() == capacity
        more = {"sequence_id": (turn << 57 | part << 32 | bin_of) * 2, "offset": offset, "round": np.full(len(bin_of), turn, np.int32), "done": done[bin_of]}
        for name, values in more.items():
            table = table.append_column(name, pa.array(values))
        return table

    return run


def pack(pieces: DataFrame, max_length: int = MAX_LENGTH, part_pieces: int = PART_PIECES) -> DataFrame:
    """pieces (a written table as of cut_documents) with sequence_id and offset in it, and the round that settled each."""
    full = pieces.where(F.col("length") == max_length).withColumns({"sequence_id": F.col("uid") * 2 + 1, "offset": F.lit(0).cast("long"), "round": F.lit(-1)})
    loose = pieces.where(F.col("length") < max_length).drop("ids")
    columns = loose.columns
    settled: list[DataFrame] = []
    count = loose.count()
    parts = -(-count // part_pieces)
    opened, last = None, False
    for turn in range(ROUNDS):
        if not count:
            break
        last = last or parts == 1 or turn == ROUNDS - 1
        shape = T.StructType([*loose.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("round", T.IntegerType()), T.StructField("done", T.BooleanType())])

        dealt = loose.withColumn("part", F.expr(f"pmod(xxhash64(uid, {turn}), {parts})"))
        packed = common.materialize(dealt.groupBy("part").applyInArrow(packer(columns, max_length, turn, last), shape), f"packed-{turn}")
        settled.append(packed.where("done").drop("done"))
        if last:
            break
        # What was given up: its pieces and sequences, and the sequences that this round made of all it had.
        sequences = packed.groupBy("sequence_id").agg(F.first("done").alias("done"), F.count("*").alias("n"))
        made, left, kept = sequences.agg(F.count("*"), F.count_if(~F.col("done")), F.coalesce(F.sum(F.when(~F.col("done"), F.col("n"))), F.lit(0))).first()
        last = opened is not None and made > opened * (1 - HELPED)
        opened, count, loose = left, kept, packed.where("not done").select(*columns)
        parts = min(-(-count // part_pieces), parts)
    out = full.drop("ids")
    for rows in settled:
        out = out.unionByName(rows)
    return out if "ids" not in pieces.columns else out.join(pieces.select("uid", "ids"), "uid")


def bound_of(pieces: DataFrame, max_length: int = MAX_LENGTH) -> int:
    """The least number of sequences that any packing of the pieces has; reads one row for each length."""
    found = pieces.groupBy("length").count().collect()
    counts = np.zeros(max_length + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    return int(counts[max_length]) + lower_bound(np.append(counts[:max_length], 0), max_length)


def best_fit(docs: DataFrame, max_length: int = MAX_LENGTH, end_id: int = END_ID, tokenizer_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, round and, unless with_ids is off, ids."""
    pieces = common.materialize(cut_documents(docs, max_length, end_id, tokenizer_path, with_ids), "pieces")
    return pack(pieces, max_length).drop("uid")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(common.documents(spark, sf_dir), with_ids=False)
