"""Snapshots, work plans, assignments, loads, tiles, routines and folders, on literals."""

import pytest
from pyspark.sql import functions as F

from framelake.operators import blobs, hooks, ingest, jobs, maintain, refine, status
from framelake.operators import raster as r


def rows_of(df):
    return {tuple(x) for x in df.collect()}


def test_fresh_snapshots_stay(spark):
    at = "timestamp '2024-01-0{} 00:00:00'".format
    old = spark.sql(f"select * from values ('fresh', 3, 'a', {at(3)}, {at(2)}), ('stale', 3, 'a', {at(1)}, {at(2)}), ('same', 3, 'now', {at(1)}, {at(2)}), ('never', 0, null, cast(null as timestamp), {at(2)}), ('none', 1, null, {at(3)}, {at(1)}) as t(project_id, version, summary, generated_at, updated_at)")
    new = spark.createDataFrame([(p, "now") for p in ("fresh", "stale", "same", "never", "other")], "project_id string, summary string")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    got = {x["project_id"]: (x["version"], x["summary"], x["generated_at"] and x["generated_at"].month) for x in status.refreshed(old, new, now).collect()}
    assert got == {"fresh": (3, "a", 1), "stale": (4, "now", 2), "same": (3, "now", 2), "never": (1, "now", 2), "none": (1, None, 1), "other": (1, "now", 2)}


def test_work_plan_of_the_fixture(spark):
    units = spark.createDataFrame([("b", 1, 7, "r2"), ("a", 1, 7, "r2"), ("c", 2, 7, "r1"), ("d", 2, None, None)], "frame_id string, asset_id int, run_id int, payload_ref string")
    plan = status.work_plan(units, "frame_id", [F.coalesce("payload_ref", F.lit(""))], 2)
    made = {x["batch"]: (x["units"], x["asset_id"], x["run_id"], x["ids"]) for x in status.planned_jobs(plan, "frame_id").collect()}
    assert made == {0: (2, 2, 7, ["d", "c"]), 1: (2, 1, 7, ["a", "b"])}
    assert tuple(status.plan_report(plan, "frame_id", 3).first()) == (4, 2, 2, ["d", "c", "a"])
    assert tuple(status.plan_report(plan.where("false"), "frame_id").first()) == (0, 0, None, [])
    now = spark.createDataFrame([("a", "queued"), ("b", "failed"), ("c", None)], "frame_id string, s string")
    assert {x["frame_id"]: x["eligible"] for x in status.still_eligible(units, now, "frame_id", "s", ["unknown", "failed"]).collect()} == {"a": False, "b": True, "c": False, "d": False}


def test_assignments_leave_the_rest(spark):
    old = spark.createDataFrame([(1, "x", "old"), (2, "y", None)], "id int, n string, ref string")
    new = spark.createDataFrame([(1, None, 5), (2, "new", 6), (3, "no", 7)], "id int, ref string, extra int")
    assert rows_of(maintain.assigned(old, new, "id")) == {(1, "x", "old", 5), (2, "y", "new", 6)}


def test_loads_resolve_their_keys(spark):
    store = spark.createDataFrame([("k1", "p1"), ("k2", "p2")], "key string, payload string")
    frames = spark.createDataFrame([(1, "k1", None, "{}", "k2"), (2, None, "k2", '{"payload_ref":"k1"}', None), (3, None, None, None, None)], "id int, payload_ref string, preprocessed_payload_ref string, metadata string, background_payload_ref string")
    load = lambda kind: {x["id"]: (x["payload"], x["background_payload"]) for x in blobs.loaded(frames, store, kind).collect()}
    assert load("original") == {1: ("p1", "p2"), 2: ("p1", None), 3: (None, None)}
    assert load("preprocessed") == {1: (None, "p2"), 2: ("p2", None), 3: (None, None)}
    with pytest.raises(Exception, match="no payload under key k2"):
        blobs.loaded(frames, store.where("key = 'k1'")).collect()
    with pytest.raises(ValueError, match="unknown payload kind"):
        blobs.loaded(frames, store, "mask")


def test_tiles_of_the_fixture(spark):
    """A region of five rows and six columns at (10, 18) in its frame."""
    roi = spark.createDataFrame([(1, 6, 5, list(range(30)), [1] * 30, 10, 18)], "frame_id int, width int, height int, pixels array<int>, mask array<int>, crop_x int, crop_y int")
    got = sorted((x["tile_x"], x["tile_y"], x["frame_x"], x["frame_y"], x["tile_w"], x["tile_h"], x["pixels"][0], sum(x["mask"])) for x in refine.tiles(roi, 4, 0.5).collect())
    assert [g[:6] for g in got] == [(0, 0, 10, 18, 4, 4), (0, 1, 10, 19, 4, 4), (2, 0, 12, 18, 4, 4), (2, 1, 12, 19, 4, 4)]
    assert [g[6] for g in got] == [0, 6, 2, 8] and all(g[7] == 16 for g in got)


def test_two_schedules(spark):
    frames = spark.createDataFrame([(i, 1, i, 2, 2, [i] * 4) for i in range(1, 9)], "frame_id long, asset_id long, frame_index long, width int, height int, pixels array<int>")
    got = {x["frame_id"]: (x["background_centre"], x["profile_centre"]) for x in r.window_assignments(frames, r.mean_backgrounds(frames, 5, 5), r.mean_profiles(frames.where("frame_id < 5"), 3, 1), 5, 3).collect()}
    assert got[2] == (0, 3) and got[3] == (5, 3) and got[8] == (10, None)


def test_routines_with_measures(spark):
    stages = hooks.Stages()
    stages.register("a")(lambda x: hooks.Result(x.where("id % 2 = 0"), {"rows": F.count("*"), "most": F.max("id")}, {"odd": x.where("id % 2 = 1")}))
    stages.register("b")(lambda x: x)
    out, seen, artifacts = stages.run_measured("a", spark.range(10))
    assert out.count() == 5 and seen.get == {"rows": 5, "most": 8} and artifacts["odd"].count() == 5
    assert stages.run("a", spark.range(4)).count() == 2 and stages.run_measured("b", spark.range(3))[1:] == (None, {})


def test_report_head(spark):
    logs = spark.sql("select * from values (timestamp '1970-01-01 00:00:01', 'error', 1.0), (timestamp '1970-01-01 00:00:02', 'info', cast(null as double)) as t(created_at, level, duration_ms)")
    queue = spark.sql("select * from values ('failed', timestamp '1970-01-01 00:00:01', timestamp '1970-01-01 00:00:01'), ('queued', null, null) as t(status, started_at, finished_at)")
    got = dict(tuple(x) for x in jobs.report_overview(logs, queue, asset=spark.range(3)).collect())
    assert got == {"first_log_at": 1_000_000, "last_log_at": 2_000_000, "log_count": 2, "timed_log_count": 1, "error_log_count": 1, "warning_log_count": 0, "job_count": 2, "succeeded_jobs": 0, "failed_jobs": 1, "queued_jobs": 1, "timed_jobs": 1, "asset_count": 3}


def test_hashes_of_a_large_folder_in_chunks(spark):
    rows = [(f"/x/{i:03}.png", 1, f"{i}".encode()) for i in range(50)] + [("/y/a.png", 1, b"z")]
    files = spark.createDataFrame(rows, "path string, length long, content binary").repartition(4)
    whole = {x["path"]: x["content_hash"] for x in ingest.content_profiles(files).collect()}
    small = {x["path"]: x["content_hash"] for x in ingest.content_profiles(files, 3).collect()}
    assert whole["/y"] == small["/y"] and whole["/x"] != small["/x"]
    again = {x["path"]: x["content_hash"] for x in ingest.content_profiles(files.repartition(7), 3).collect()}
    assert again == small
    other = spark.createDataFrame([*rows[:49], ("/x/049.png", 1, b"other")], "path string, length long, content binary")
    assert ingest.content_profiles(other, 3).first()["content_hash"] != small["/x"]


def test_frames_without_a_reference_are_spread(spark):
    """They carry payloads, and must not meet in the one task of null keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store = spark.createDataFrame([("k1", "p1")], "key string, payload string")
        frames = spark.range(4000).selectExpr("id", "'k1' as payload_ref", "'{}' as metadata", "cast(null as string) as background_payload_ref")
        got = blobs.loaded(frames, store).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("part").count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000 and got.where("background_payload is not null or payload <> 'p1'").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_affected_frames_are_dealt_before_they_are_made_distinct(spark):
    """Frames named twice, by the job and through detections; a share of the rows for each task, and no task that makes a scan's rows distinct."""
    jobs_of = spark.createDataFrame([(1, '{"frame_ids":["7","7","8"]}'), (1, '{"detection_ids":["a","b","b"]}'), (2, '{"detection_ids":["c","none"]}'), (3, "{}")], "job_id long, payload string")
    found = spark.createDataFrame([("a", 7), ("b", 9), ("c", 7)], "detection_id string, frame_id long")
    want = {(1, "7"), (1, "8"), (1, "9"), (2, "7")}
    for parts in (None, 5):
        got = maintain.affected_frames(jobs_of, found, parts)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    scattered = got.select("job_id", F.spark_partition_id().alias("p")).groupBy().agg(F.count_distinct("p")).first()[0]
    assert got.rdd.getNumPartitions() == 5 and scattered > 1


def test_partitions_follow_the_rows(spark, tmp_path, monkeypatch):
    from framelake.sources import tables

    spark.range(1000).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    assert tables.parts(spark, str(tmp_path), "orders") == 21
    assert tables.parts(spark, str(tmp_path), "orders", "orders") == 41
    monkeypatch.setattr(tables, "TASK_ROWS", 5000)
    assert tables.parts(spark, str(tmp_path), "orders") == spark.sparkContext.defaultParallelism
