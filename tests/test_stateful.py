"""Streams with state: windows by frame index, order of frames, workers that go silent, and a projection that may be replayed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import jobs
from framelake.operators import raster as r
from framelake.sources.shared import new_folder
from framelake.streaming import stateful as sf
from framelake.streaming import streams as st

FRAMES = "asset_id long, arrival long, frame_index long, width int, height int, pixels array<int>, ended boolean"


def frame(asset, index, shape, value, arrival=None):
    return (asset, index if arrival is None else arrival, index, shape[1], shape[0], [value] * (shape[0] * shape[1]), False)


def windows(spark, steps, *how, **more):
    stream = sf.frame_windows(sf.replayed([spark.createDataFrame(s, FRAMES) for s in steps], "asset_id"), *how, **more)
    return sf.run_state(stream)


def test_windows_of_the_fixture(spark):
    """Frame 4 is a partial one: it feeds the profile, not the mean frame."""
    rows = [frame(1, i + 1, (1, 2) if i == 3 else (2, 2), v) for i, v in enumerate([10, 20, 40, 200, 80])]
    ends = [(1, 99, None, None, None, None, True)]
    for steps in ([rows, ends], [rows[:2], rows[2:4], rows[4:], ends], [[x] for x in [*rows, *ends]]):
        got = {w["centre"]: (w["background"], w["frames"], w["profile"], w["profile_frames"]) for w in windows(spark, steps, 3, 3).collect()}
        assert got == {0: ([10] * 4, 1, [10, 10], 1), 3: ([30] * 4, 2, [64, 64], 3), 6: ([80] * 4, 1, [80, 80], 1)}


def test_open_windows_wait_for_the_end(spark):
    rows = [frame(7, i, (2, 3), i) for i in range(1, 12)]
    assert sorted(w["centre"] for w in windows(spark, [rows[:6], rows[6:]], 3, 3).collect()) == [0, 3, 6, 9]
    assert windows(spark, [rows[:1]], 3, 3).count() == 0


def test_windows_equal_the_batch_form(spark):
    rng = np.random.default_rng(5)
    rows = [(a, i, i, 4, 3, rng.integers(0, 256, 12).tolist(), False) for a in range(3) for i in range(2, 40)]
    ends = [(a, 99, None, None, None, None, True) for a in range(3)]
    got = {(w["asset_id"], w["centre"]): w["background"] for w in windows(spark, [[x for x in rows if x[1] % 40 // 10 == k] for k in range(4)] + [ends], 5, 9).collect()}
    batch = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "frame_id long, " + FRAMES)
    want = {(w["asset_id"], w["centre"]): w["background"] for w in r.mean_backgrounds(batch, 5, 9).collect()}
    assert got == {k: v for k, v in want.items() if k[1] <= 40}


def test_order_is_checked_over_micro_batches(spark):
    steps = [[frame(1, 2, (2, 2), 0)], [frame(2, 1, (2, 2), 0)], [frame(1, 1, (2, 2), 0, arrival=5), frame(1, 3, (2, 2), 0, arrival=6), frame(1, 3, (2, 2), 0, arrival=7)]]
    with pytest.raises(Exception, match="increasing frame-index order: 1 after 2 in asset 1"):
        windows(spark, steps, 3, 3).collect()
    found = windows(spark, steps, 3, 3, strict=False).where("kind = 'disorder'").select("asset_id", "frame_index", "previous").collect()
    assert sorted(map(tuple, found)) == [(1, 1, 2), (1, 3, 3)]
    with pytest.raises(ValueError, match="odd"):
        sf.FrameWindows(2, 3, 0, True)


def test_workers_go_silent_and_come_back(spark):
    beats = [(1, 0), (1, 20), (1, 300), (2, 30), (2, 55), (2, 90), (2, 119), (9, 5000)]
    df = spark.createDataFrame(beats, "worker_id long, s long").select("worker_id", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"), "s")
    steps = [df.where(f"s between {a} and {b}").drop("s") for a, b in ((0, 60), (61, 120), (121, 400), (401, 9000))]
    got = sf.run_state(sf.liveness(sf.replayed(steps), 15, "100 seconds")).where("worker_id < 9").collect()
    assert sorted((g["worker_id"], g["ms"] // 1000 - 1_000_000, g["online"]) for g in got) == [(1, 0, True), (1, 50, False), (1, 300, True), (1, 330, False), (2, 30, True), (2, 85, False), (2, 90, True), (2, 149, False)]


def test_overview_counts_workers(spark):
    sessions = spark.sql("select * from values ('a', timestamp '2024-01-01 00:00:31', 'working'), ('b', timestamp '2024-01-01 00:00:29', 'working'), ('c', timestamp '2024-01-01 00:01:00', 'idle') as t(worker_id, last_heartbeat, status)")
    queue = spark.sql("select * from values (1, 'queued'), (2, 'queued'), (3, 'failed') as t(job_id, status)")
    got = jobs.status_overview(queue, sessions, F.lit("2024-01-01 00:01:00").cast("timestamp"), 15)
    assert {tuple(x) for x in got.collect()} == {("queue", "queued", 2), ("queue", "failed", 1), ("workers", "total", 3), ("workers", "online", 2), ("workers", "busy", 2)}


CHANGES = "frame_id long, stage string, status string, job_id string, at timestamp, id long, candidate_detection_count long, refined_detection_count long, unrefined_candidate_count long"


def changes(spark, rows):
    rows = [(f, s, v, j, i, *([None] * 3 if c is None else [c, None, None])) for f, s, v, j, i, c in rows]
    df = spark.createDataFrame(rows, CHANGES.replace("at timestamp, id long", "id long"))
    return df.withColumn("at", F.timestamp_seconds("id")).select("frame_id", "stage", "status", "job_id", "at", "id", "candidate_detection_count", "refined_detection_count", "unrefined_candidate_count")


def test_replayed_batches_change_nothing(spark):
    batches = [
        [(1, "segment", "queued", "a", 1, None), (1, "segment", "succeeded", "a", 2, 5), (2, "preprocess_frames", "failed", "b", 3, None)],
        [(1, "segment", "queued", "c", 4, None), (2, "roi_refinement", "working", "d", 5, None)],
        [(3, "segment", "succeeded", "e", 6, 0)],
        [(1, "segment", "working", "c", 3, -4)],  # late
    ]
    tables = []
    for repeat in (False, True):
        projection = sf.Projection(spark, new_folder(spark), changes(spark, batches[0]), every=2)
        for i, rows in enumerate(batches):
            projection.write(changes(spark, rows), i)
            if repeat:  # the last two batches again, as after a lost commit
                for k in range(max(0, i - 1), i + 1):
                    projection.write(changes(spark, batches[k]), k)
        tables.append({x["frame_id"]: x.asDict() for x in projection.frames(spark.range(1, 5).withColumnRenamed("id", "frame_id")).collect()})
    assert tables[0] == tables[1]
    one, two, three, four = (tables[0][i] for i in range(1, 5))
    assert (one["candidate_detection_status"], one["candidate_detection_job_id"], one["candidate_detection_completed_at"], one["candidate_detection_count"]) == ("queued", "c", None, 0)
    assert (two["preprocessing_status"], two["roi_refinement_status"], two["roi_refinement_job_id"], two["candidate_detection_status"]) == ("failed", "working", "d", "unknown")
    assert three["candidate_detection_completed_at"].second == 6 and four["preprocessing_status"] == "unknown" and four["updated_at"] is None
    whole = sf.Projection(spark, new_folder(spark), changes(spark, batches[0]))
    whole.write(changes(spark, [x for b in batches for x in b]), 0)
    assert {x["frame_id"]: x.asDict() for x in whole.frames(spark.range(1, 5).withColumnRenamed("id", "frame_id")).collect()} == tables[0]


def test_hopping_means_come_from_the_stream_alone(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0)
    empty = st.run_once(st.hopping_mean(st.ended(sf.replayed([events.withColumn("ts", F.col("ts").cast("timestamp"))]), events, "1 day"), "75 minutes", "25 minutes", "10 minutes"), "append")
    assert empty.count() == 0


def test_streams_read_tables_of_many_files(spark, tmp_path):
    """A table may be one file or a folder of files."""
    from framelake.plans import QUERIES

    for name, column in (("embeddings", "vec_id"), ("events", "event_id")):
        given = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        given.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        assert given.count() == st.run_once(st.table_stream(spark, str(tmp_path), name), "append").select(column).distinct().count()
    rows = lambda d: sorted(map(tuple, QUERIES["stream_frames_stored"](spark, d).collect()))
    assert rows(str(tmp_path)) == rows("/root/testdata/sf0.001") != []


def test_a_step_is_one_micro_batch(spark):
    """However many keys and files a step has."""
    steps = [spark.range(100 * k, 100 * k + n).repartition(16) for k, n in enumerate((90, 1, 50))]
    seen = {}
    for keyed in (None, "id"):
        sf.run_batches(sf.replayed(steps, keyed), lambda b, n: seen.update({n: (b.count(), (b.agg(F.min("id")).first()[0] or 0) // 100)}), f"{new_folder(spark)}/checkpoint")
        assert [seen[n] for n in sorted(seen)] == [(90, 0), (1, 1), (50, 2)]
        seen.clear()
