"""Exact top-k search with block-at-a-time pruning.

Vectors are quantised to integers and cut into blocks, each with its forward
index (ids and integer rows) and its terms' largest and least values.  Rows are
range-partitioned by their nearest pivot first, so that blocks are alike inside
and their bounds tight.  A query's blocks are taken by falling bound, the sum
over terms of the most that the query's value can score with the block, until
the bound falls below the k-th score so far, which starts from a scored sample.

Whole ranges are pruned before any row is shipped.  A query first searches the
range it lies in itself, which raises its k-th score; then it is bounded
against every range's largest and least values, a block of ranges' summaries
against a set of queries at a time, and goes only where its bound reaches.  A
range's rows go only to the sets of queries that have any left for it.  A tile
of (range, set of queries) is bounded, and a query's best of each range are
merged by an aggregation that keeps k rows a task.

Vectors that are null or hold null or non-finite components take no part, nor
do empty ones; shorter vectors count as padded with zeros, and very long ones
are taken whole.  A component or score beyond 64 bits is an error.  Of equal
scores the smaller id comes first.  Rows with a null id are no queries or
candidates.  Repeated rows are candidates one by one; a query is left out by
its id, and a repeated query is searched once.  An empty table gives no rows.
Columns other than vec_id and embedding are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE, K, BLOCK_ROWS = 256, 5, 256
#: Rows of a range, queries of a set, pivots, scored sample rows, and ranges bounded at a time, about.
RANGE_ROWS, SET_QUERIES, PIVOTS, SEEDS, RANGES_AT_ONCE = 16_384, 2_048, 64, 2_048, 4_096


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the integer vectors of the rows that take part."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    value = lambda x: F.when(F.abs(scale * x.cast("double")) < 2.0**63, F.floor(F.lit(scale) * x.cast("double")).cast("long")).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return vectors.where(F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", value).alias("q"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), common.runs(lengths)] = flat
    return out


def product(a: np.ndarray, b: np.ndarray, cut: bool = False) -> np.ndarray:
    """Exact integer products: by floats where every sum is below 2**53, by Python's integers where one may pass 64 bits.

    What does not fit into 64 bits is an error, or cut to what fits.
    """
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return np.einsum("ij,kj->ik", a, b)
    found = a.astype(object) @ b.astype(object).T
    return (np.clip(found, -(2**63), 2**63 - 1) if cut else found).astype(np.int64)


def reached(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that each query can score within each pair of largest and least values."""
    return product(np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]), np.hstack([high, low]), cut=True)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_tile(block_ids: list[np.ndarray], blocks: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's best k of the tile's blocks, by falling bounds."""
    high, low = (np.array([f(axis=0) for f in (getattr(b, m) for b in blocks)]) for m in ("max", "min"))
    bounds = reached(queries, high, low)
    for i, (query, own, floor) in enumerate(zip(queries, query_ids.tolist(), floors.tolist(), strict=True)):
        kth, ids, scores = floor, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.argsort(-bounds[i], kind="stable"):
            if kth is not None and bounds[i, b] < kth:
                break
            found = product(query[None, :], blocks[b])[0]
            keep = block_ids[b] != own
            if kth is not None:
                keep &= found >= kth
            ids, scores = best(np.concatenate([ids, block_ids[b][keep]]), np.concatenate([scores, found[keep]]), k)
            if len(scores) == k:
                kth = max(int(scores[-1]), kth) if kth is not None else int(scores[-1])
        yield own, ids, scores


def top_k(vectors: DataFrame, query_every: int, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best partners of each row whose vec_id is divisible by query_every: query_id, rank, vec_id, score."""
    rows = common.materialize(quantised(vectors, scale), "vectors")
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    # A bounded sample, by hash of the id, gives the pivots and the first k-th scores.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toArrow()
    seed_ids = sample.column("vec_id").to_numpy().astype(np.int64)
    seeds = matrix(sample.column("q").combine_chunks(), width) if len(seed_ids) else np.zeros((0, width), np.int64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = seeds[:PIVOTS].astype(np.float64)
        for b in batches:
            x = matrix(b.column(1), width).astype(np.float64)
            at = np.argmin((pivots**2).sum(1)[None, :] - 2 * x @ pivots.T, axis=1) if len(pivots) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=["vec_id", "q", "pivot"])

    ranges = max(1, -(-count // RANGE_ROWS))
    ranged = rows.mapInArrow(nearest, "vec_id long, q array<long>, pivot int").repartitionByRange(ranges, "pivot", "vec_id").sortWithinPartitions("pivot", "vec_id").withColumn("part", F.spark_partition_id())
    placed = common.materialize(ranged, "placed")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, x = b.column(0).to_numpy(), matrix(b.column(1), width)
            for p in np.unique(part):
                rows_ = x[part == p]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(width, p, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(rows_.max(axis=0)), pa.array(rows_.min(axis=0))], names=["part", "at", "high", "low"])

    pieces = placed.select("part", "q").mapInArrow(summarise, "part int, at int, high long, low long").groupBy("part", "at").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    ends = F.sort_array(F.collect_list(F.struct("at", "high", "low")))  # one entry for each term
    summaries = pieces.groupBy("part").agg(ends.alias("e")).select("part", F.col("e.high").alias("high"), F.col("e.low").alias("low"))
    summaries = common.materialize(summaries, "summaries")
    last_part = summaries.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]

    none = np.iinfo(np.int64).min

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            scores = product(matrix(b.column(1), width), seeds)
            scores[ids[:, None] == seed_ids[None, :]] = none
            at = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), none)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["vec_id", "q", "part", "floor"])

    # Neighbouring ranges' queries make a set, so that a set is alike inside too.
    per_set = max(1, SET_QUERIES * query_every // RANGE_ROWS)
    asked = placed.where(F.col("vec_id") % query_every == 0).select("vec_id", "q", "part").dropDuplicates(["vec_id"])
    queries = common.materialize(asked.mapInArrow(floors, "vec_id long, q array<long>, part int, floor long"), "queries")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        if left.num_rows and right.num_rows:
            ids, q = left.column("vec_id").to_numpy(), matrix(left.column("q").combine_chunks(), width)
            order = np.lexsort((ids, left.column("pivot").to_numpy()))
            cut = [order[i : i + block_rows] for i in range(0, len(order), block_rows)]
            floor = right.column("floor").to_numpy().astype(object)
            floor[floor == none] = None
            for own, a, s in search_tile([ids[c] for c in cut], [q[c] for c in cut], matrix(right.column("q").combine_chunks(), width), right.column("vec_id").to_numpy(), floor, k):
                for column, values in zip(found, (np.full(len(a), own), a, s), strict=True):
                    column.append(values)
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), found, strict=True)})

    shape = "query_id long, vec_id long, score long"
    home = common.materialize(placed.groupBy("part").cogroup(queries.groupBy("part")).applyInArrow(tile, shape), "home")
    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "kth")
    raised = queries.join(kth, "vec_id", "left").select("vec_id", "q", F.col("part").alias("home"), F.greatest("floor", F.coalesce("kth", "floor")).alias("floor"), F.expr(f"part div {per_set}").cast("int").alias("query_set"))

    def reach(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ranges other than its own that a query's bound reaches."""
        query = part = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            q = matrix(left.column("q").combine_chunks(), width)
            high, low = (matrix(right.column(n).combine_chunks(), width) for n in ("high", "low"))
            bounds = reached(q, high, low)
            parts = right.column("part").to_numpy()
            query, at = np.nonzero((bounds >= left.column("floor").to_numpy()[:, None]) & (parts[None, :] != left.column("home").to_numpy()[:, None]))
            part = parts[at]
        return left.take(pa.array(query)).append_column("part", pa.array(part.astype(np.int32))).select(["query_set", "part", "vec_id", "q", "floor"])

    groups_of = F.expr(f"part div {RANGES_AT_ONCE}")
    sent = raised.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(last_part // RANGES_AT_ONCE))))
    shown = summaries.withColumn("g", groups_of.cast("int")).withColumn("query_set", F.explode(F.sequence(F.lit(0), F.lit(last_part // per_set))))
    left_over = sent.groupBy("query_set", "g").cogroup(shown.groupBy("query_set", "g")).applyInArrow(reach, "query_set int, part int, vec_id long, q array<long>, floor long")
    left_over = common.materialize(left_over, "reach")
    wanted = left_over.select(F.col("part").alias("to_part"), F.col("query_set").alias("to_set")).distinct()
    shipped = placed.join(wanted, F.col("part") == F.col("to_part")).select("part", F.col("to_set").alias("query_set"), "vec_id", "q", "pivot")
    keys = ("part", "query_set")
    away = shipped.groupBy(*keys).cogroup(left_over.groupBy(*keys)).applyInArrow(tile, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query_every=50)


ORACLE = {
    "op5_topk_search": """
with v as (select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as q from embeddings
           where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len(embedding) > 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)]) as bigint) as score
      from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
}
