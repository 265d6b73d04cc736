"""Streams that keep state for each key: frame windows in index order, workers' liveness, and the stored status projection.

Frames and heartbeats are kept by Spark's arbitrary-state operator, which
checkpoints its state with the stream; each key's state is a few open windows
or one time.  The projection is a table of small folds, one for each
micro-batch, so that a batch that is run again writes what it wrote before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framelake.sources.shared import new_folder

#: State with several values for each key needs this provider; it is part of Spark.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Files of a step, each of which a micro-batch reads in parts.
FILES = 8


def replayed(steps: list[DataFrame], key: str | None = None) -> DataFrame:
    """A stream that gets the steps' rows one step after the other, from files of the shared folder.

    A micro-batch reads one step: all steps have the same number of files, some
    of them empty, so that the number of micro-batches does not grow with the rows.
    """
    spark, folder = steps[0].sparkSession, new_folder(steps[0].sparkSession)
    empty = spark.createDataFrame([], steps[0].schema)
    written = 0
    for step in steps:
        (step.repartition(FILES, key) if key else step.repartition(FILES)).write.mode("append").parquet(folder)
        files = len(spark.read.schema(steps[0].schema).parquet(folder).inputFiles())
        for _ in range(written + FILES - files):
            empty.write.mode("append").parquet(folder)
        written += FILES
    return spark.readStream.schema(steps[0].schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def in_steps(rows: DataFrame, order: str, steps: int) -> list[DataFrame]:
    """rows cut into ranges of a number or time of equal width."""
    at = F.col(order).cast("double")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [rows]
    edge = lambda i: low + (high - low) * i / steps
    return [rows.where((at >= edge(i)) & (at < edge(i + 1) if i < steps - 1 else at <= high)) for i in range(steps)]


class FrameWindows(StatefulProcessor):
    """Mean frame and mean profile of an asset's windows, frame by frame in index order.

    An asset's first frame sets its nominal size.  A window is given once a
    frame lies past its end, or at the row that ends the asset, if some frame
    is nearest to its centre; no window stays after that.  A frame whose index
    does not rise is an error, or, if not strict, a row of kind 'disorder', and
    is left out.
    """

    SCHEMA = "asset_id {0}, kind string, centre long, width int, height int, background array<int>, frames long, profile array<double>, profile_frames long, frame_index long, previous long"
    COLUMNS = ["asset_id", "kind", "centre", "width", "height", "background", "frames", "profile", "profile_frames", "frame_index", "previous"]

    def __init__(self, stride: int, width: int, axis: int, strict: bool) -> None:
        if stride < 1 or width < 1 or stride % 2 == 0 or width % 2 == 0:
            raise ValueError("stride and width must be positive odd numbers")
        self.stride, self.reach, self.half, self.axis, self.strict = stride, width // 2, stride // 2, axis, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.asset = handle.getValueState("asset", "frame_index long, width int, height int")
        self.windows = handle.getMapState("windows", "centre long", "total binary, frames long, profile binary, values long, profile_frames long, wanted boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # The rows of one asset in one micro-batch; their order is theirs, not the shuffle's.
        batch = pd.concat(rows).sort_values("arrival", kind="stable")
        last, width, height = self.asset.get() if self.asset.exists() else (None, None, None)
        open_ = {k[0]: [np.frombuffer(v[0]).copy(), v[1], np.frombuffer(v[2]).copy(), v[3], v[4], v[5]] for k, v in self.windows.iterator()}
        stored, out = set(open_), []
        if batch["pixels"].isna().all() and not batch["ended"].any():
            last, out = self.ordered(key[0], batch["frame_index"].to_numpy(np.int64), last)
            batch = batch.iloc[:0]
        for row in batch.itertuples(index=False):
            if row.ended:
                out += [self.given(key[0], c, width, height, w) for c, w in sorted(open_.items()) if w[5]]
                open_, last, width, height = {}, None, None, None
                continue
            index = int(row.frame_index)
            if last is not None and index <= last:
                if self.strict:
                    raise ValueError(f"frames must arrive in increasing frame-index order: {index} after {last} in asset {key[0]}")
                out.append((key[0], "disorder", None, None, None, None, None, None, None, index, last))
                continue
            last = index
            if row.pixels is None:
                continue
            frame = np.asarray(row.pixels, np.float64).reshape(int(row.height), int(row.width))
            if width is None:
                width, height = int(row.width), int(row.height)
            self.add(open_, index, frame, width, height)
            for centre in [c for c, w in open_.items() if index > c + self.reach and (w[5] or index > c + self.half)]:
                window = open_.pop(centre)
                if window[5]:
                    out.append(self.given(key[0], centre, width, height, window))
        self.keep(open_, stored, last, width, height)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def ordered(self, asset: Any, index: np.ndarray, last: int | None) -> tuple[int, list[tuple]]:
        """The last index taken after frames whose order alone counts, and those that do not rise."""
        before = np.maximum.accumulate(np.concatenate([[np.iinfo(np.int64).min if last is None else last], index]))[:-1]
        wrong = index <= before
        wrong[:1] &= last is not None
        if self.strict and wrong.any():
            at = int(np.argmax(wrong))
            raise ValueError(f"frames must arrive in increasing frame-index order: {index[at]} after {before[at]} in asset {asset}")
        out = [(asset, "disorder", *[None] * 7, i, p) for i, p in zip(index[wrong].tolist(), before[wrong].tolist(), strict=True)]
        return max(int(index.max()), int(before[-1])), out

    def add(self, open_: dict[int, list], index: int, frame: np.ndarray, width: int, height: int) -> None:
        across = frame.shape[1 - self.axis]
        own = (index + self.half) // self.stride * self.stride
        first, stop = math.ceil((index - self.reach) / self.stride), (index + self.reach) // self.stride + 1
        for centre in {own, *range(max(0, first) * self.stride, stop * self.stride, self.stride)}:
            window = open_.setdefault(centre, [np.zeros(width * height), 0, np.zeros((height, width)[1 - self.axis]), 0, 0, False])
            window[5] |= centre == own
            if abs(index - centre) > self.reach:
                continue
            if frame.shape == (height, width):
                window[0] += frame.reshape(-1)
                window[1] += 1
            if across == len(window[2]):
                window[2] += frame.sum(axis=self.axis)
                window[3] += frame.shape[self.axis]
                window[4] += 1

    def given(self, asset: Any, centre: int, width: int, height: int, window: list) -> tuple:
        total, frames, profile, values, profile_frames, _ = window
        mean = np.rint(total / frames).astype(np.int32) if frames else None
        return asset, "window", centre, width, height, mean, frames, profile / values if values else None, profile_frames, None, None

    def keep(self, open_: dict[int, list], stored: set[int], last: int | None, width: int | None, height: int | None) -> None:
        for centre in stored - set(open_):
            self.windows.removeKey((centre,))
        for centre, (total, frames, profile, values, profile_frames, wanted) in open_.items():
            self.windows.updateValue((centre,), (total.tobytes(), frames, profile.tobytes(), values, profile_frames, bool(wanted)))
        if last is None:
            self.asset.clear()
        else:
            self.asset.update((last, width, height))

    def close(self) -> None:
        pass


def frame_windows(frames: DataFrame, stride: int, width: int, axis: int = 0, strict: bool = True) -> DataFrame:
    """A stream of frames (asset_id, arrival, frame_index, width, height, pixels, ended) to rows of FrameWindows.SCHEMA.

    The order within an asset is that of arrival, a number that rises from one
    micro-batch to the next.  A row with `ended` closes its asset's windows;
    null pixels are frames whose order alone counts.
    """
    schema = FrameWindows.SCHEMA.format(dict(frames.dtypes)["asset_id"])
    rows = frames.select("asset_id", "arrival", "frame_index", "width", "height", "pixels", "ended")
    return rows.groupBy("asset_id").transformWithStateInPandas(FrameWindows(stride, width, axis, strict), schema, "Append", "None")


def with_ends(frames: DataFrame) -> DataFrame:
    """A row for each asset that ends it, after all its frames."""
    last = frames.groupBy("asset_id").agg((F.max("arrival") + 1).alias("arrival"))
    return last.select(*[F.col(c) if c in last.columns else F.lit(c == "ended").cast(t) if t == "boolean" else F.lit(None).cast(t).alias(c) for c, t in frames.dtypes]).toDF(*frames.columns)


class Liveness(StatefulProcessor):
    """When a worker comes online and, two intervals after its last beat, goes offline.

    Beats may arrive in any order within the watermark's delay: they wait in
    state until it has passed them, and are then taken in order of their time.
    """

    COLUMNS = ["worker_id", "ms", "online"]

    def __init__(self, interval_ms: int) -> None:
        self.silence = 2 * interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.worker = handle.getValueState("worker", "last_ms long, online boolean")
        self.waiting = handle.getValueState("waiting", "ms binary")

    def beats(self) -> np.ndarray:
        """The times of the beats that wait, rising."""
        return np.frombuffer(self.waiting.get()[0], np.int64) if self.waiting.exists() else np.zeros(0, np.int64)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        beats = np.unique(np.concatenate([r["ms"].to_numpy(np.int64) for r in rows]))
        self.waiting.update((np.union1d(self.beats(), beats).tobytes(),))
        self.handle.registerTimer(int(beats[-1]))
        yield pd.DataFrame([], columns=self.COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last, online = self.worker.get() if self.worker.exists() else (None, False)
        waiting, out = self.beats(), []
        due = waiting[waiting <= now]
        if len(due):
            self.waiting.update((waiting[len(due) :].tobytes(),))
            # A worker that is offline has no last beat that could still end.
            first = [] if online else [int(due[0])]
            out += [(key[0], ms, True) for ms in first]
            taken = np.concatenate([[last], due]) if online else due
            for at in np.flatnonzero(np.diff(taken) > self.silence).tolist():
                out += [(key[0], int(taken[at]) + self.silence, False), (key[0], int(taken[at + 1]), True)]
            last, online = int(due[-1]), True
        if online and last + self.silence <= now:
            out.append((key[0], last + self.silence, False))
            online = False
        elif online and len(due):
            self.handle.registerTimer(last + self.silence)
        if last is not None:
            self.worker.update((last, online))
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def liveness(beats: DataFrame, interval_seconds: int, delay: str) -> DataFrame:
    """A stream of beats (worker_id, ts) to transitions (worker_id, ms, online)."""
    kind = dict(beats.dtypes)["worker_id"]
    x = beats.withWatermark("ts", delay).select("worker_id", "ts", F.unix_millis("ts").alias("ms"))
    return x.groupBy("worker_id").transformWithStateInPandas(Liveness(interval_seconds * 1000), f"worker_id {kind}, ms long, online boolean", "Append", "EventTime")


#: A stage's name in changes, and the prefix of its columns in the projection.
STAGES = {"preprocess_frames": "preprocessing", "segment": "candidate_detection", "roi_refinement": "roi_refinement"}
COUNTS = ("candidate_detection_count", "refined_detection_count", "unrefined_candidate_count")


def folded(changes: DataFrame) -> DataFrame:
    """Changes (frame_id, stage, status, job_id, at, id and, if known, the counts) as one row for each frame and stage; the last one by (at, id) holds.

    A change sets its stage's status, job and completed time, which is the
    change's own where it tells of success and none else; a count is set by the
    last change that has it.  Folds of folds are folds, see `refolded`.
    """
    when = F.struct("at", "id")
    done = F.when(F.col("status") == "succeeded", F.col("at"))
    counts = [F.when(F.col(c).isNotNull(), F.struct("at", "id", F.greatest(F.col(c), F.lit(0)).alias("n"))).alias(c) for c in COUNTS]
    return refolded(changes.where(F.col("stage").isin(*STAGES)).select("frame_id", "stage", when.alias("seen"), F.struct("status", "job_id", done.alias("completed_at")).alias("last"), *counts))


def refolded(folds: DataFrame) -> DataFrame:
    return folds.groupBy("frame_id", "stage").agg(F.max("seen").alias("seen"), F.max_by("last", "seen").alias("last"), *[F.max(c).alias(c) for c in COUNTS])


class Projection:
    """The status of frames by stage as a table of the shared folder, kept current by a stream of changes.

    Micro-batch n writes its fold as delta/batch=n, over what is there: a batch
    that is run again changes nothing.  Every few batches the folds so far are
    merged into base/upto=n, which is written whole from its predecessor and
    the deltas between, so that too can be repeated.  Readers take the newest
    base and the deltas after it; a batch costs its own size, not the table's.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: DataFrame, every: int = 8) -> None:
        self.spark, self.folder, self.every = spark, folder, every
        self.shape = folded(schema.limit(0)).schema
        empty = spark.createDataFrame([], self.shape)
        for path in ("delta/batch=-1", "base/upto=-1"):
            empty.write.mode("ignore").parquet(f"{folder}/{path}")

    def write(self, changes: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        folded(changes).write.mode("overwrite").parquet(f"{self.folder}/delta/batch={batch_id}")
        if batch_id % self.every == self.every - 1:
            self.folds(batch_id).write.mode("overwrite").parquet(f"{self.folder}/base/upto={batch_id}")

    def folds(self, before: int | None = None) -> DataFrame:
        """All folds merged; those of bases below `before`, if given, and of batches up to it."""
        base, delta = (self.spark.read.schema(self.shape).option("basePath", f"{self.folder}/{n}").parquet(f"{self.folder}/{n}").withColumn("n", F.col(p).cast("long")) for n, p in (("base", "upto"), ("delta", "batch")))
        if before is not None:
            base, delta = base.where(F.col("n") < before), delta.where(F.col("n") <= before)
        # An older base would do as well, with more deltas.
        newest = base.agg(F.coalesce(F.max("n"), F.lit(-1))).first()[0]
        return refolded(base.where(F.col("n") == newest).select(*self.shape.names).unionByName(delta.where(F.col("n") > newest).select(*self.shape.names)))

    def frames(self, known: DataFrame | None = None) -> DataFrame:
        """One row for each frame of `known`, or each with a change: status, job and completed time of each stage, the counts and the time of the last change."""
        columns: list[Column] = []
        for stage, prefix in STAGES.items():
            own = F.max(F.when(F.col("stage") == stage, F.col("last")))
            columns += [F.coalesce(own["status"], F.lit("unknown")).alias(f"{prefix}_status"), own["job_id"].alias(f"{prefix}_job_id"), own["completed_at"].alias(f"{prefix}_completed_at")]
        columns += [F.coalesce(F.max(c)["n"], F.lit(0)).alias(c) for c in COUNTS]
        out = self.folds().groupBy("frame_id").agg(*columns, F.max("seen.at").alias("updated_at"))
        if known is None:
            return out
        default = {f"{p}_status": "unknown" for p in STAGES.values()} | {c: 0 for c in COUNTS}
        return known.select("frame_id").join(out, "frame_id", "left").fillna(default)


def run_state(stream: DataFrame) -> DataFrame:
    """Drive a stream with keyed state over all that is there; its rows as a table of the shared folder."""
    from .streams import run_once

    spark, (name, store) = stream.sparkSession, STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        return run_once(stream, "append")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drive a stream into a foreachBatch function over all that is there."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
