"""Small worked examples of the frame work, as literal frames."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import raster as r
from framelake.operators import refine


def frames(spark, *arrays, index=None):
    rows = [(i + 1, 1, (index or range(1, len(arrays) + 1))[i], a.shape[1], a.shape[0], [int(v) for v in a.reshape(-1)]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "frame_id long, asset_id int, frame_index long, width int, height int, pixels array<int>")


def mask(df, name="mask"):
    return np.array(df.orderBy("frame_id").first()[name])


RAMP = np.arange(256).reshape(16, 16)


def test_manual_threshold_is_strict(spark):
    got = mask(frames(spark, RAMP).withColumn("mask", r.mask_above(F.lit(127))))
    assert (got == np.where(np.arange(256) > 127, 255, 0)).all()


def test_capped_otsu(spark):
    level = r.otsu(frames(spark, RAMP), cap=100).first()["threshold"]
    assert level == 100


def test_bounded_otsu_rejects_too_much_foreground(spark):
    a = np.full((12, 12), 20)
    a[2:10, 2:10] = 80
    assert not mask(r.bounded_otsu(frames(spark, a), 50, 0.1)).any()


def test_hysteresis_keeps_the_weak_part_of_a_strong_block(spark):
    a = np.full((24, 24), 20)
    a[8:16, 8:16] = 40
    a[10:14, 10:14] = 80
    got = mask(r.per_frame(frames(spark, a), r.hysteresis(30, 60))).reshape(24, 24)
    assert (got == np.where(a >= 30, 255, 0)).all()


def test_mask_chain_gives_one_region(spark):
    a = np.zeros((8, 8), int)
    a[2:4, 2:4] = 255
    a[6, 6] = 255
    got = r.regions(frames(spark, a), r.augment([r.remove_small(2), r.morph("dilate")])).collect()
    assert [(x["bbox_x"], x["bbox_y"], x["bbox_w"], x["bbox_h"]) for x in got] == [(1, 1, 4, 4)]


def test_fill_holes_and_border():
    a = np.zeros((6, 6), int)
    a[1:5, 1:5] = 255
    a[2:4, 2:4] = 0
    assert (r.fill_holes(a)[1:5, 1:5] == 255).all() and r.fill_holes(a)[0, 0] == 0
    b = np.zeros((5, 5), int)
    b[0, 0] = b[2, 2] = 255
    assert r.clear_border(b).sum() == 255


def test_mean_windows(spark):
    values, shapes = (10, 20, 40, 200, 80), [(2, 2), (2, 2), (2, 2), (1, 2), (2, 2)]
    x = frames(spark, *[np.full(s, v) for v, s in zip(values, shapes, strict=True)])
    got = {row["centre"]: row["background"] for row in r.mean_fields(x, 3, 3).where("pos = 0").collect()}
    assert got == {0: 10, 3: 30, 6: 80}
    assigned = {row["frame_id"]: row["centre"] for row in r.window_assignment(x, r.mean_backgrounds(x, 3, 3), 3).where("has_window").collect()}
    assert [assigned[i] for i in (2, 3, 4)] == [3, 3, 3]
    rows = {row["x"]: row["profile"] for row in r.profiles(x, 3, 3, axis=1).where("centre = 0").collect()}
    assert rows == {0: 10, 1: 10}


@pytest.mark.parametrize("field, expected", [(0.5, 255), (1.0, 255), (200.0, 127), (300.0, 100)])
def test_bounded_division(spark, field, expected):
    got = spark.range(1).select(r.divide(F.lit(100), F.lit(field), 1.0, 250.0).alias("v")).first()["v"]
    assert got == expected


def test_tiles_cover_and_merge(spark):
    a = np.zeros((6, 5), int)
    a[1:4, 1:4] = 255
    df = frames(spark, a)
    tiles = refine.tiles(df, 4, 0.5)
    assert sorted((x["tile_x"], x["tile_y"]) for x in tiles.collect()) == [(0, 0), (0, 2), (1, 0), (1, 2)]
    got = refine.merge_tiles(refine.predict(tiles, lambda x: x, 4), 4).collect()
    assert {(x["x"], x["y"]) for x in got} == {(x, y) for x in range(1, 4) for y in range(1, 4)}


def test_reconcile_consumes_the_contained_region(spark):
    rois = spark.createDataFrame([(1, "a", 0, 0, 4, 4), (1, "b", 1, 1, 2, 2), (2, "c", 1, 1, 2, 2)], "frame_id int, detection_id string, bbox_x int, bbox_y int, bbox_w int, bbox_h int")
    got = {x["detection_id"]: (x["keeper_id"], x["consumed"]) for x in refine.reconcile(rois).collect()}
    assert got == {"a": ("a", False), "b": ("a", True), "c": ("c", False)}


def plain_label(mask, connectivity):
    """Components by flooding, one after another."""
    out, n = np.zeros(mask.shape, int), 0
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (connectivity == 8 or not dy * dx)]
    for y, x in np.argwhere(mask > 0):
        if not out[y, x]:
            n, todo = n + 1, [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] > 0 and not out[a, b]:
                    out[a, b] = n
                    todo += [(a + dy, b + dx) for dy, dx in near]
    return out


def test_labels_equal_flooding():
    rng = np.random.default_rng(4)
    for _ in range(120):
        m = (rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.random()) * 255
        for connectivity in (4, 8):
            assert (r.label(m, connectivity) == plain_label(m, connectivity)).all()


def test_labels_of_a_long_snake_are_quick():
    m = np.zeros((401, 401), int)
    m[::2] = 1
    m[1::4, -1] = 1
    m[3::4, 0] = 1
    began = time.time()
    assert r.label(m, 4).max() == 1 and time.time() - began < 2


def test_preprocess_chain_of_the_fixture(spark):
    a = np.full((4, 4), 20)
    a[1:3, 1:3] = 80
    m = (a > 20) * 255
    x = frames(spark, a).withColumn("mask", F.array(*[F.lit(int(v)) for v in m.reshape(-1)])).withColumn("background_level", F.lit(10.0))
    got = r.preprocess(x).first()
    assert got["steps"] == "mask,background_correction,invert_intensity"
    pixels = np.array(got["pixels"]).reshape(4, 4)
    assert pixels[0, 0] == 255 and pixels[1, 1] == 0


@pytest.mark.parametrize("box", [(0, 0, 5, 1), (-1, 0, 1, 1), (0, 0, 0, 1), (3, 3, 2, 2), (1, None, 1, 1)])
def test_crops_outside_the_frame_are_errors(box):
    with pytest.raises(ValueError, match="crop"):
        r.crop_bounds(4, 4, box)


def test_crop_takes_mask_profile_and_background_along(spark):
    a = np.arange(20).reshape(4, 5) + 100
    x = frames(spark, a).withColumn("background", F.array(*[F.lit(int(v)) for v in (a * 2).reshape(-1)])).withColumn("background_width", F.lit(5))
    got = r.preprocess(x, crop=(1, 1, 3, 2), invert_intensity=False).first()
    assert (got["width"], got["height"], got["bbox_x"], got["bbox_y"], got["steps"]) == (3, 2, 1, 1, "crop,background_correction") and set(got["pixels"]) == {127}
    p = frames(spark, a).withColumn("profile", F.array(*[F.lit(float(v)) for v in (50, 100, 200, 400, 800)]))
    got = r.preprocess(p, crop=(1, 0, 2, 1), invert_intensity=False, high=300.0).first()
    assert got["steps"] == "crop,flatfield" and got["pixels"] == [int(101 * 255 / 100) if 101 * 255 / 100 < 255 else 255, int(102 * 255 / 200)]


def test_dispatch_and_ensembles():
    a = np.zeros((6, 6), int)
    a[1:3, 1:3], a[4, 4] = 200, 90
    assert (r.thresholder("manual", threshold=100)(a) == (a > 100) * 255).all()
    assert (r.thresholder("manual_or_otsu", manual={"threshold": 127})(a) == np.maximum((a > 127) * 255, r.thresholder("otsu")(a))).all()
    with pytest.raises(ValueError, match="unknown threshold"):
        r.thresholder("canny")
    flat = np.full((9, 9), 50)
    assert not r.thresholder("adaptive_gaussian", block_size=3, c=0)(flat).any() and r.thresholder("adaptive_gaussian", block_size=3, c=1)(flat).all()


def test_detection_records(spark):
    a = np.zeros((8, 8), int)
    a[2:5, 3:7] = 100
    a[3, 4] = 0
    a[7, 0] = 60
    x = frames(spark, a).withColumn("bbox_x", F.lit(10)).withColumn("bbox_y", F.lit(20))
    got = r.detections(x, lambda p: (p > 50) * 255, padding=2).orderBy("roi_index").collect()
    assert [(g["area"], g["bbox_x"], g["bbox_y"], g["bbox_w"], g["bbox_h"]) for g in got] == [(11, 3, 2, 4, 3), (1, 0, 7, 1, 1)]
    assert (got[0]["crop_bbox_x"], got[0]["crop_bbox_y"], got[0]["crop_bbox_w"], got[0]["crop_bbox_h"], got[0]["source_x"], got[0]["source_y"]) == (1, 0, 7, 7, 13, 22)
    assert (np.array(got[0]["mask"]).reshape(7, 7) == (a[0:7, 1:8] > 50) * 255).all() and (np.array(got[0]["roi"]).reshape(7, 7) == a[0:7, 1:8]).all()
    filled = r.detections(x, lambda p: (p > 50) * 255, external=True).orderBy("roi_index").first()
    assert filled["area"] == 12
    assert r.segment_preview(x, 1, method="manual", options={"threshold": 50}, preprocessed=True).count() == 1
    line = r.boxes(np.array([[1] * 12]))
    assert line["major_axis_length"][0] > 10 * line["minor_axis_length"][0] > 0


def test_mask_crops_and_packed_arrays(spark):
    m = np.array([[1, 2], [3, 4]])
    assert r.mask_in_crop(m, (2, 3), (3, 2, 3, 3)).tolist() == [[0, 0, 0], [2, 0, 0], [4, 0, 0]]
    assert not r.mask_in_crop(m, (2, 3), (9, 9, 1, 1)).any()
    a = np.array([[0, 1, 65535], [7, 8, 9]])
    packed = r.pack_arrays(frames(spark, a), "uint16")
    row = packed.first()
    assert row["shape"] == [2, 3] and bytes(row["payload"]) == a.astype("<u2").tobytes()
    assert r.unpack_arrays(packed).first()["pixels"] == a.reshape(-1).tolist()
    with pytest.raises(ValueError, match="element type"):
        r.pack_arrays(packed, "object")


def test_reconciliation_of_masks_and_links(spark):
    big, small = np.full((4, 4), 255), np.full((2, 2), 255)
    rows = [(1, "a", 0, 0, 4, 4, big.reshape(-1).tolist()), (1, "b", 1, 1, 2, 2, small.reshape(-1).tolist()), (2, "c", 1, 1, 2, 2, small.reshape(-1).tolist())]
    rois = spark.createDataFrame(rows, "frame_id int, detection_id string, bbox_x int, bbox_y int, bbox_w int, bbox_h int, mask array<int>")
    done = refine.reconcile(rois)
    assert {x["detection_id"]: (x["keeper_id"], x["consumed"]) for x in done.collect()} == {"a": ("a", False), "b": ("a", True), "c": ("c", False)}
    links = {x["keeper_id"]: (x["consumed_candidate_detection_ids"], x["consumed_count"]) for x in refine.consumed_links(done).collect()}
    assert links == {"a": (["b"], 1), "c": ([], 0)}


def test_grid_reconciliation_equals_all_pairs():
    rng = np.random.default_rng(6)
    for _ in range(20):
        found = [dict(id=i, order=i, x=int(x), y=int(y), w=int(w), h=int(h), area=int(w * h), mask=None) for i, (x, y, w, h) in enumerate(zip(*rng.integers(0, 300, (2, 60)), *rng.integers(1, 90, (2, 60)), strict=True))]
        kept, want = [], {}
        for q in sorted(found, key=lambda q: (-q["area"], q["order"])):
            both = [(k, refine.shared_area(q, k)) for k in kept]
            by = next((k for k, n in both if n and (n >= 0.5 * (q["area"] + k["area"] - n) or n >= 0.8 * min(q["area"], k["area"]))), None)
            want[q["id"]] = by["id"] if by else None
            if by is None:
                kept.append(q)
        assert {q["id"]: k["id"] if k else None for q, k, _ in refine.consume(found)} == want


def test_refinement_grows_splits_and_reconciles(spark):
    a = np.zeros((24, 24), int)
    a[4:20, 4:16] = 200  # the target, of which the candidate's crop sees a part
    a[21, 21] = 200
    rows = [(1, "p", 6, 6, 6, 6, [255] * 36), (1, "q", 20, 20, 4, 4, [255] * 16), (1, "none", 0, 0, 3, 3, [255] * 9)]
    found = spark.createDataFrame(rows, "frame_id long, detection_id string, crop_bbox_x int, crop_bbox_y int, crop_bbox_w int, crop_bbox_h int, mask array<int>")
    level = lambda t: (t[..., 0] > 0.5) * 1.0
    got = {x["detection_id"]: x for x in refine.refine_detections(frames(spark, a), found, level, tile=8, overlap=0.5, expansion=4, iterations=5, residual_generations=0).collect()}
    assert set(got) == {"p", "q"}  # an empty refinement is dropped
    p = got["p"]
    assert (p["bbox_x"], p["bbox_y"], p["bbox_w"], p["bbox_h"], p["area"], p["touches_edge"]) == (4, 4, 12, 16, 192, False) and p["growths"] > 0 and (p["min_gray"], p["mean_gray"]) == (200, 200.0)
    split = lambda t: (t[..., 0] > 0.5) * (t[..., 1] > 0) * 1.0
    b = np.zeros((8, 8), int)
    b[:, 0:3] = 250
    b[2:4, 5:7] = 100
    whole = spark.createDataFrame([(1, "w", 0, 0, 8, 8, [255 if v else 0 for v in b.reshape(-1)])], found.schema)
    both = {x["detection_id"]: (x["candidate_detection_id"], x["area"]) for x in refine.refine_detections(frames(spark, b), whole, split, tile=8, residual_generations=1).collect()}
    assert both == {"w": ("w", 24)}  # the child's refinement is empty by this model
    lower = lambda t: (t[..., 1] > 0) * (t[..., 0] > (0.5 if t[..., 0].max() > 0.5 and (t[..., 1] > 0).sum() > 10 else 0.2)) * 1.0
    child = {x["detection_id"]: (x["candidate_detection_id"], x["generation"], x["area"]) for x in refine.refine_detections(frames(spark, b), whole, lower, tile=8, residual_generations=1).collect()}
    assert child == {"w": ("w", 0, 24), "w:residual:1:1": ("w", 1, 4)}


def test_links_carry_their_measures(spark):
    rois = spark.createDataFrame([(1, "big", 0, 0, 4, 4), (1, "small", 1, 1, 2, 2), (1, "half", 2, 0, 4, 4), (2, "alone", 0, 0, 4, 4)], "frame_id long, detection_id string, bbox_x int, bbox_y int, bbox_w int, bbox_h int")
    got = {x["detection_id"]: x.asDict() for x in refine.reconcile(rois).collect()}
    assert (got["small"]["keeper_id"], got["small"]["shared_area"], got["small"]["iou"], got["small"]["containment"], got["small"]["keeper_containment"]) == ("big", 4, 0.25, 1.0, 0.25)
    assert not got["half"]["consumed"] and not got["alone"]["consumed"] and got["alone"]["shared_area"] is None
    links = {x["keeper_id"]: x for x in refine.consumed_links(refine.reconcile(rois)).collect()}
    assert links["big"]["consumed"][0]["iou"] == 0.25 and links["half"]["consumed"] == []
    twice = refine.reconcile(rois.unionByName(rois.where("detection_id = 'big'")))
    assert sorted(x["consumed"] for x in twice.where("detection_id = 'big'").collect()) == [False, True] and twice.count() == 5


@pytest.mark.parametrize("masks", [False, True])
def test_reconciliation_equals_one_after_the_other(spark, masks):
    """Grid pairs decide as the greedy walk over a frame does, in a frame with many regions and in small ones."""
    rng = np.random.default_rng(17)
    rows, want = [], {}
    for f in range(12):
        found = []
        for i in range(250 if f == 0 else int(rng.integers(1, 12))):
            w, h = (int(v) for v in rng.integers(1, 90, 2))
            x, y = (int(v) for v in rng.integers(0, 200, 2))
            mask = (rng.random((h, w)) < 0.8) * 255 if masks and rng.random() < 0.8 else None
            area = w * h if mask is None else int(np.count_nonzero(mask))
            if i == 3:
                x, y, w, h, mask = (found[0][k] for k in ("x", "y", "w", "h", "mask"))  # the same region twice
                area = found[0]["area"]
            found.append({"id": f"{f}-{i}", "order": f"{f}-{i}", "area": area, "x": x, "y": y, "w": w, "h": h, "mask": mask})
            rows.append((f, f"{f}-{i}", x, y, w, h, None if mask is None else mask.reshape(-1).tolist()))
        want |= {r_["id"]: ((k or r_)["id"], both if k else None) for r_, k, both in refine.consume(found)}
    rois = spark.createDataFrame(rows, "frame_id long, detection_id string, bbox_x int, bbox_y int, bbox_w int, bbox_h int, mask array<int>").repartition(4)
    got = {x["detection_id"]: (x["keeper_id"], x["shared_area"]) for x in refine.reconcile(rois if masks else rois.drop("mask")).collect()}
    assert got == want and any(k != v[0] for k, v in want.items())


def test_background_divide_gives_each_pixel(spark):
    """A row for each pixel of each frame that has a window, none folded into a sum."""
    from framelake.plans import QUERIES

    got = QUERIES["background_divide"](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == ["frame_id", "pos", "v"]
    assert {r["n"] for r in got.groupBy("frame_id").count().withColumnRenamed("count", "n").select("n").distinct().collect()} == {64}
