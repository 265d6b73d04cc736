"""Vectors of detections: clusters, principal components, balanced and uncertain samples for training.

Vectors are never shuffled: tasks send sums of the size of a model, which is
clusters or components times dimensions.  Rows without a vector, or with a null
or non-finite component, take no part; all others have the same length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import order_statistics

#: Rounds of parallel seeding, and candidates of a round for each cluster, about; summands of one sum.
SEED_ROUNDS, OVERSAMPLED, FAN_IN = 4, 2, 32


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and v, the vectors that take part, as doubles."""
    whole = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)
    return vectors.where(whole).select(key, F.col(vector).cast("array<double>").alias("v"))


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    lengths = np.diff(np.asarray(column.offsets))
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of unlike lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, the first of equal ones, and its squared distance."""
    at = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
    return at, ((x - centres[at]) ** 2).sum(1)


def assigned(x: DataFrame, centres: np.ndarray) -> DataFrame:
    """x (key, v) with cluster and distance, the squared one."""
    key, kind = x.dtypes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, far = nearest(rows_of(b.column(1)), centres)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32)), pa.array(far)], names=[key, "v", "cluster", "distance"])

    return x.mapInArrow(run, f"`{key}` {kind}, v array<double>, cluster int, distance double")


def lloyd_step(x: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """New centres, sizes and the old centres' inertia; an empty cluster keeps its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, inertia = np.zeros_like(centres), np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for b in batches:
            if b.num_rows:
                rows = rows_of(b.column(1))
                at, far = nearest(rows, centres)
                np.add.at(sums, at, rows)
                sizes += np.bincount(at, minlength=len(centres))
                inertia += np.bincount(at, far, minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(np.full(len(centres), TaskContext.get().partitionId())), pa.array(list(sums)), pa.array(sizes), pa.array(inertia)], names=["at", "task", "sums", "n", "inertia"])

    total = summed(x.mapInArrow(run, "at int, task long, sums array<double>, n long, inertia double"))
    sums, sizes, inertia = centres.copy(), np.zeros(len(centres), np.int64), 0.0
    for r in total.collect():  # a row for each cluster
        sizes[r["at"]], inertia = r["n"], inertia + r["inertia"]
        if r["n"]:
            sums[r["at"]] = np.array(r["sums"]) / r["n"]
    return sums, sizes, inertia


def summed(parts: DataFrame) -> DataFrame:
    """Tasks' rows (at, task, sums, n, inertia) summed for each `at`, in two steps of bounded groups."""

    def add(t: pa.Table) -> pa.Table:
        sums = rows_of(t.column("sums").combine_chunks()).sum(axis=0)
        return pa.table({"at": t.column("at").slice(0, 1), "task": pa.array([0]), "sums": pa.array([sums]), "n": pa.array([pa.compute.sum(t.column("n")).as_py()]), "inertia": pa.array([float(np.sort(t.column("inertia").to_numpy()).sum())])})

    shape = "at int, task long, sums array<double>, n long, inertia double"
    groups = parts.withColumn("task", F.col("task") % FAN_IN)
    return groups.groupBy("at", "task").applyInArrow(add, shape).groupBy("at").applyInArrow(add, shape)


def uniform(key: str, *salt: object) -> Column:
    """A number of 0 to 1 for each key that does not change between runs."""
    return F.shiftrightunsigned(F.xxhash64(key, *map(F.lit, salt)), 11) / float(1 << 53)


def seeds(x: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k first centres by parallel seeding: rounds that draw rows by their squared distance to what was drawn, then k of those by weight.

    What is collected is about SEED_ROUNDS * OVERSAMPLED * k rows.
    """
    key = x.columns[0]
    rng = np.random.default_rng(seed)
    first = x.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    drawn = np.array([first[0]["v"]])
    for turn in range(SEED_ROUNDS):
        far = assigned(x, drawn)
        cost = far.agg(F.coalesce(F.sum("distance"), F.lit(0.0))).first()[0]
        if cost == 0:
            break
        found = far.where(uniform(key, seed, turn) * cost < F.lit(float(OVERSAMPLED * k)) * F.col("distance")).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(4 * OVERSAMPLED * k).collect()
        if found:
            drawn = np.concatenate([drawn, [r["v"] for r in found]])
    weights = lloyd_step(x, drawn)[1].astype(np.float64)
    chosen = [int(np.argmax(weights))]
    while len(chosen) < min(k, len(drawn)):
        far = nearest(drawn, drawn[chosen])[1] * weights
        if far.sum() == 0:
            break
        chosen.append(int(rng.choice(len(drawn), p=far / far.sum())))
    return drawn[chosen]


def kmeans(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", rounds: int = 20, tolerance: float = 1e-6, seed: int = 0) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Rows with their cluster and squared distance, the centres, and the inertia before each round, which never rises."""
    x = usable(vectors, key, vector)
    centres, inertias = seeds(x, k, seed), []
    for _ in range(rounds if len(centres) else 0):
        new, _, inertia = lloyd_step(x, centres)
        inertias.append(inertia)
        if len(inertias) > 1 and inertias[-2] - inertia <= tolerance * inertias[-2]:
            break
        centres = new
    if not len(centres):
        kind = dict(x.dtypes)[key]
        return x.sparkSession.createDataFrame([], f"`{key}` {kind}, cluster int, distance double"), centres, inertias
    return assigned(x, centres).drop("v"), centres, inertias


def moments(x: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, their mean and covariance (over n), from one d x d sum for each task."""
    width = x.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    pivot = np.array(x.orderBy(x.columns[0]).limit(1).collect()[0]["v"]) if width else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = np.zeros((width + 1, width)), 0
        for b in batches:
            if b.num_rows:
                rows = rows_of(b.column(1)) - pivot  # near the mean, so that little is lost by subtraction
                gram[:width] += rows.T @ rows
                gram[width] += rows.sum(axis=0)
                n += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(np.full(width + 1, TaskContext.get().partitionId())), pa.array(list(gram)), pa.array(np.full(width + 1, n)), pa.array(np.zeros(width + 1))], names=["at", "task", "sums", "n", "inertia"])

    gram, n = np.zeros((width + 1, width)), 0
    if width:
        for r in summed(x.mapInArrow(run, "at int, task long, sums array<double>, n long, inertia double")).collect():  # d + 1 rows
            gram[r["at"]], n = r["sums"], r["n"]
    mean = gram[width] / max(n, 1)
    return n, mean + pivot, gram[:width] / max(n, 1) - np.outer(mean, mean)


def principal_components(vectors: DataFrame, components: int, key: str = "vec_id", vector: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances, falling, unit directions (a row each, the largest entry positive), and the mean."""
    _, mean, covariance = moments(usable(vectors, key, vector))
    values, axes = np.linalg.eigh(covariance) if len(mean) else (np.zeros(0), np.zeros((0, 0)))
    values, axes = values[::-1][:components], axes.T[::-1][:components]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]) if len(axes) else np.zeros(0)
    return values, axes * signs[:, None], mean


def projected(vectors: DataFrame, axes: np.ndarray, mean: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and the coordinates along the axes."""
    x = usable(vectors, key, vector)
    kind = dict(x.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list((rows_of(b.column(1)) - mean) @ axes.T))], names=[key, "coordinates"])

    return x.mapInArrow(run, f"`{key}` {kind}, coordinates array<double>")


def hashed_order(key: str, seed: int = 0) -> Column:
    """A 52-bit number for each key, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")).cast("binary")), 1, 13), 16, 10).cast("long")


def balanced(rows: DataFrame, by: str, size: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly `size` rows of each class, or all of a smaller one: those whose keys hash least, ties by key.

    The class's threshold is found by counting, so that no class is sorted or
    gathered; only rows that share the threshold are ranked.
    """
    x = rows.withColumns({"__fl_h": hashed_order(key, seed), "__fl_k": F.struct(by)})
    values = x.select(F.col("__fl_k").alias("k"), F.col("__fl_h").cast("double").alias("v"))
    ranks = values.groupBy("k").agg((F.least(F.count("*"), F.lit(size)) - 1).alias("rank"))
    limits = order_statistics(values, ranks).select(F.col("k").alias("__fl_k"), F.col("v").try_cast("long").alias("__fl_limit"))
    near = x.join(limits, "__fl_k").where(F.col("__fl_h") <= F.col("__fl_limit"))
    below = near.where(F.col("__fl_h") < F.col("__fl_limit"))
    taken = below.groupBy("__fl_k").agg(F.count("*").alias("__fl_taken"))
    edge = near.where(F.col("__fl_h") == F.col("__fl_limit")).join(taken, "__fl_k", "left")
    place = F.row_number().over(Window.partitionBy("__fl_k").orderBy(key)) + F.coalesce("__fl_taken", F.lit(0))
    return below.select(*rows.columns).unionByName(edge.withColumn("__fl_place", place).where(F.col("__fl_place") <= size).select(*rows.columns))


def most_uncertain(scored: DataFrame, scores: str, k: int, key: str) -> DataFrame:
    """The k rows whose two best scores lie nearest to each other, with that margin; ties by key.  Rows with fewer than two scores are left out."""
    best = F.sort_array(scores, asc=False)
    x = scored.where(F.size(scores) > 1).withColumn("margin", F.get(best, F.lit(0)) - F.get(best, F.lit(1)))
    return x.where("margin is not null").orderBy("margin", key).limit(k)
