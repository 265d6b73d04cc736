"""Literal cases of the catalogue's operators, and sizes at which a wrong plan shows."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from framelake.operators import blobs, catalog, exports, hooks, ingest, jobs, search, status
from framelake.sources.shared import new_folder
from framelake.streaming import streams


@pytest.mark.parametrize("rows, size", [(2_000_000, 1000), (10, 4), (0, 5)])
def test_work_batches_number_every_row_once(spark, rows, size):
    x = spark.range(rows).select((F.xxhash64("id") % 1_000_003).alias("ref"), "id")
    out = status.work_batches(x, ["ref", "id"], size)
    got = out.agg(F.count("*"), F.countDistinct("unit"), F.min("unit"), F.max("unit")).first()
    assert tuple(got) == ((rows, rows, 0, rows - 1) if rows else (0, 0, None, None))
    full = out.groupBy("batch").agg(F.count("*").alias("n")).where(f"n <> {size}").collect()
    assert [r["n"] for r in full] == ([rows % size] if rows % size else [])
    later = out.select("unit", F.struct("ref", "id").alias("k"))
    assert later.join(later.select((F.col("unit") + 1).alias("unit"), F.col("k").alias("before")), "unit").where("before >= k").count() == 0


def test_names_tell_their_time(spark):
    cases = {
        "cam 2025-10-01 12-30-45.123.avi": "2025-10-01 12:30:45.123000", "2025-10-01T12:30:45.avi": "2025-10-01 12:30:45.000000",
        "x_2025-10-01-12-30-45.123456789.avi": "2025-10-01 12:30:45.123456", "20251001_123045.avi": None, "": None, None: None,
    }
    got = {r["n"]: r["t"] for r in spark.createDataFrame([(n,) for n in cases], "n string").select("n", catalog.filename_timestamp(F.col("n")).alias("t")).collect()}
    assert got == cases


def test_relationships_of_real_metadata(spark):
    cases = {
        "{}": "one_to_one", None: "one_to_one", '{"consumed_candidate_detection_ids":[]}': "one_to_one",
        '{"split_from_candidate_detection_id":"a"}': "split_child", '{"consumed_candidate_detection_ids":["b"]}': "merge_keeper",
        '{"split_from_candidate_detection_id":"a","consumed_candidate_detection_ids":["b"]}': "many_to_many",
    }
    got = {r["m"]: r["k"] for r in spark.createDataFrame([(m,) for m in cases], "m string").select("m", jobs.refinement_relationship(F.col("m")).alias("k")).collect()}
    assert got == cases


def test_other_bytes_under_a_key_are_a_conflict(spark):
    store = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, payload string")
    new = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "x"), ("k3", "c"), ("k4", "d"), ("k4", "e")], store.schema)
    assert {r["key"]: r["action"] for r in blobs.put(new, store).collect()} == {"k1": "kept", "k2": "conflict", "k3": "stored", "k4": "conflict"}
    with pytest.raises(Exception, match="other bytes are stored under key k"):
        blobs.put_or_raise(new, store).collect()


def test_jobs_of_asset_or_run_count_once(spark):
    assets = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "asset_id string, run_id int")
    made = spark.createDataFrame([(1, "a", 1, "queued", "s", 5), (2, "a", None, "failed", "s", 9), (3, None, 1, "paused", "t", 7), (4, "b", 2, "done", "u", 1)], "job_id int, asset_id string, run_id int, status string, stage string, updated_at int")
    got = {r["asset_id"]: (r["job_count"], r["latest_job_status"]) for r in exports.job_summaries(assets, made).collect()}
    assert got == {"a": (3, "failed"), "b": (3, "paused"), "c": (1, "done")}


def test_values_are_rendered_by_type(spark):
    x = spark.sql("select cast(1.50 as decimal(9,2)) as d, timestamp_ntz '2024-01-02 03:04:05' as t, date '2024-01-02' as e, cast('ab' as binary) as b, true as f, named_struct('z', 1, 'a', array('q')) as s, array(1, 2) as l, 'x' as c")
    parts = spark.sql("select timestamp_ntz '2024-01-02 03:04:05.678' as t, timestamp '2024-01-02 03:04:05' as z, timestamp '2024-01-02 03:04:05.000009' as y")
    assert tuple(exports.rendered(parts).first()) == ("2024-01-02 03:04:05.678000", "2024-01-02 03:04:05+00:00", "2024-01-02 03:04:05.000009+00:00")
    assert tuple(exports.rendered(x).first()) == (1.5, "2024-01-02 03:04:05", "2024-01-02", "YWI=", 1, '{"a":["q"],"z":1}', "[1,2]", "x")


def test_tables_are_exported_and_counted(spark):
    a, b = spark.range(5), spark.createDataFrame([("x,1", 2)], "n string, v int")
    for form in exports.FORMATS:
        path = new_folder(spark)
        assert {r["table"]: r["rows"] for r in exports.export_tables({"a": a, "b": b}, path, form).collect()} == {"a": 5, "b": 1}
    for wrong in ({"a": a}, {}):
        with pytest.raises(ValueError, match="export"):
            exports.export_tables(wrong, new_folder(spark), "xlsx" if wrong else "csv")


def test_clamps_pages_and_orders(spark):
    assert [search.clamp(v, search.STATUS_LIMITS, 1000) for v in (None, 0, 5, 10**9)] == [1000, 1, 5, 10_000]
    assert search.clamp(None, search.EXPORT_LIMITS, search.EXPORT_DEFAULT) == 10_000
    page = lambda limit, n: spark.range(n).agg(F.count("*").alias("n")).select(*search.page_metadata(limit, 10, F.col("n"))).first()
    assert [page(*x)["next_offset"] for x in ((5, 5), (5, 4), (None, 5), (0, 5))] == [15, None, None, None]
    rows = spark.range(6).select("id")
    assert [search.next_cursor(rows, ["id"], k).first()["next_cursor"] for k in (6, 7)] == ["5", None]
    picked = {r["id"] for seed in range(3) for r in search.sample(spark.range(1000), 5, seed).collect()}
    assert len(picked) > 5
    with pytest.raises(ValueError, match="unknown statuses: lost"):
        status.known_statuses(["queued", "lost"], ["queued"])


def test_frames_out_of_order_are_found(spark):
    x = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 6), (1, 4, 2), (2, 1, 9)], "asset_id int, arrival int, frame_index long")
    assert [(r["arrival"], r["previous"]) for r in streams.order_violations(x).orderBy("arrival").collect()] == [(3, 6), (4, 6)]
    with pytest.raises(Exception, match="does not rise"):
        streams.in_order_or_raise(x).collect()
    assert streams.in_order_or_raise(x.where("arrival <= 2")).count() == 3


def test_stages_and_models(spark):
    stages = hooks.Stages()
    stages.register("a")(lambda x: x.withColumn("y", F.col("id") + 1))
    assert stages.run("a", spark.range(1)).first()["y"] == 1
    with pytest.raises(ValueError, match="already"):
        stages.register("a")(lambda x: x)
    with pytest.raises(KeyError, match="no routine"):
        stages.run("b", spark.range(1))
    with pytest.raises(NotImplementedError):
        hooks.classify(spark.range(1), None, [], "m")
    import numpy as np

    x = np.arange(16).reshape(1, 2, 4, 2)
    assert (hooks.identity_model(x) == x[..., 1]).all()
    assert (hooks.callable_model(lambda t: t[..., 0] * 2)(x) == x[..., 0] * 2).all()


def png(path, pixels):
    """A minimal image file of rows of gray or (red, green, blue) values."""
    gray = isinstance(pixels[0][0], int)
    raw = b"".join(b"\0" + bytes(row if gray else [v for p in row for v in p]) for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0 if gray else 2, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folders_become_gray_frames(spark, tmp_path):
    png(tmp_path / "B.png", [[0, 50, 255], [1, 2, 3]])
    png(tmp_path / "a.png", [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (10, 20, 30)]])
    (tmp_path / "broken.png").write_bytes(b"none")
    got = {r["path"].rsplit("/", 1)[1]: (r["frame_index"], r["width"], r["height"], r["pixels"]) for r in ingest.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (1, 2, 2, [76, 150, 29, 18]), "B.png": (2, 3, 2, [0, 50, 255, 1, 2, 3])}


def test_content_hashes_tell_contents_apart(spark, tmp_path):
    for n, data in (("a/x 2024-01-02T03-04-05.png", b"1"), ("a/y.png", b"2"), ("b/x.png", b"1"), ("b/y.png", b"3")):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(data)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length", "content")
    got = {r["path"][-1]: (r["content_hash"], r["captured_at"]) for r in ingest.content_profiles(files).collect()}
    assert got["a"][0] != got["b"][0] and got["b"][1] is None
    assert got["a"][1] is None or got["a"][1].startswith("2024-01-02 03:04:05")


def exchanges(df):
    """The columns that each shuffle of the plan deals by."""
    import contextlib
    import io
    import re

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return re.findall(r"hashpartitioning\(([^)]*)\)", out.getvalue())


def test_last_results_by_window(spark):
    """Ties go to the larger id, results without a row, without a key and rows without a result are in order."""
    from framelake.operators import catalog

    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, None, 7), (3, "d", 8), (3, "d", 9)], "frame_id long, detection_id string, area int")
    found = spark.createDataFrame([(1, "a", 3, "r1", None), (1, "a", 3, "r2", "m"), (1, "a", None, "r9", "m"), (1, "x", 9, "r3", "m"), (2, None, 9, "r4", "m"), (3, "d", None, None, "n")], "frame_id long, detection_id string, at int, refined_id string, method string")
    got = catalog.with_latest(rows, found, "frame_id", "detection_id", ["at", "refined_id"], ["refined_id", "method"])
    assert got.columns == ["frame_id", "detection_id", "area", "refined_id", "method"]
    assert sorted(map(str, got.collect())) == sorted(map(str, [*spark.createDataFrame([(1, "a", 5, "r2", "m"), (1, "b", 6, None, None), (2, None, 7, None, None), (3, "d", 8, None, "n"), (3, "d", 9, None, "n")], got.schema).collect()]))


def test_regions_are_dealt_by_frame_alone(spark):
    from framelake.plans import QUERIES

    by = exchanges(QUERIES["export_roi_metadata"](spark, "/root/testdata/sf0.001"))
    assert any("l_orderkey" in x for x in by) and not any("detection_id" in x for x in by)


def test_full_regions_are_dealt_by_frame_alone(spark):
    """Neither detections nor their refinements cross the network by detection, and no detection by asset or run."""
    from framelake.plans import QUERIES

    # As for tables that are too large to be broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by = exchanges(QUERIES["export_roi_metadata_full"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("l_orderkey" in x for x in by) and not any("detection_id" in x for x in by)
