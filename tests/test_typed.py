"""Element types, borders, method names, typed merges and copies, on literals."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import maintain, scalars, stencils, typed
from framelake.operators import raster as r

FRAME = "frame_id long, asset_id long, width int, height int, pixels array<double>"


def frames(spark, *arrays):
    return spark.createDataFrame([(i, 0, a.shape[1], a.shape[0], [float(v) for v in a.reshape(-1)]) for i, a in enumerate(arrays)], FRAME)


@pytest.mark.parametrize("dtype,values", [("float32", [0.25, 0.75, -3.5, 1e30]), ("float64", [0.1, -1e300, 2.0, 5e-324]), ("uint16", [0, 1, 65535, 300]), ("int16", [-32768, 32767, 0, 5]), ("int32", [-(2**31), 2**31 - 1, 0, 9]), ("uint8", [0, 255, 7, 8])])
def test_packed_arrays_come_back(spark, dtype, values):
    a = np.array(values, dtype).reshape(2, 2)
    x = r.with_data(frames(spark, a), dtype)
    assert (typed.decoded(x.first()["data"].asDict()) == a).all()
    assert r.values(x).first()["pixels"] == a.astype(float).reshape(-1).tolist()
    packed = r.pack_arrays(frames(spark, a), dtype)
    assert r.unpack_arrays(packed).first()["pixels"] == a.astype(float).reshape(-1).tolist()


def test_values_that_do_not_fit_are_errors(spark):
    x = r.with_data(frames(spark, np.array([[0.25, 0.75]])), "float32")
    with pytest.raises(Exception, match="cannot hold"):
        r.values(x, "int").collect()
    short = x.withColumn("data", F.struct("data.dtype", F.array(F.lit(3), F.lit(2)).alias("shape"), "data.payload"))
    with pytest.raises(Exception, match="reshape"):
        r.values(short).collect()
    with pytest.raises(ValueError, match="unknown element type"):
        r.with_data(frames(spark, np.zeros((1, 1))), "object")


def test_inversion_by_type(spark):
    for dtype, values, want in (("uint8", [0, 200], [255, 55]), ("uint16", [0, 65000], [65535, 535]), ("int16", [0, 5], [32767, 32762]), ("float32", [0.5, 2.0], [1.5, 0.0])):
        done = r.preprocess(r.with_data(frames(spark, np.array([values])), dtype))
        assert r.values(done).first()["pixels"] == want and done.first()["data"]["dtype"] == dtype
    nan = typed.inverted(np.array([[np.nan, 3.0, 1.0]], np.float32), np.dtype("float32"))
    assert np.isnan(nan[0, 0]) and nan[0, 1:].tolist() == [0, 2]
    assert r.preprocess(frames(spark, np.array([[0, 200]])).withColumn("pixels", F.col("pixels").cast("array<int>"))).first()["pixels"] == [255, 55]


def test_division_keeps_the_type(spark):
    x = r.with_data(frames(spark, np.array([[100, 60000]])), "uint16").withColumn("background_level", F.lit(200.0))
    assert r.values(r.preprocess(x, invert_intensity=False)).first()["pixels"] == [127, 65535]
    y = r.with_data(frames(spark, np.array([[1.0, 3.0]])), "float32").withColumn("background_level", F.lit(2.0))
    assert r.values(r.preprocess(y, invert_intensity=False)).first()["pixels"] == [127.5, 382.5]


def test_thresholds_see_stretched_bytes(spark):
    x = r.with_data(frames(spark, np.array([[0.0, 0.5, 1.0, 0.49]])), "float32")
    assert r.per_frame(x, r.thresholder("manual", threshold=126)).first()["mask"] == [0, 255, 255, 0]
    assert typed.as_bytes(np.array([[10, 1010, 510]], np.uint16)).tolist() == [[0, 255, 128]]
    assert not typed.as_bytes(np.full((2, 2), 7.5)).any()
    assert r.otsu(r.with_data(frames(spark, np.array([[0, 0, 60000, 60000]])), "uint16")).first()["threshold"] == 0.0


def slow_gradients(a, smooth, slope):
    """Plain sums over a mirrored frame."""
    k = max(len(smooth), len(slope)) // 2
    p = np.pad(a.astype(int), k, mode="reflect")
    out = np.zeros(a.shape, int)
    for y, x in np.ndindex(a.shape):
        gx = gy = 0
        for i, s in enumerate(smooth):
            for j, d in enumerate(slope):
                gx += s * d * p[y + k + i - len(smooth) // 2, x + k + j - len(slope) // 2]
                gy += s * d * p[y + k + j - len(slope) // 2, x + k + i - len(smooth) // 2]
        out[y, x] = gx * gx + gy * gy
    return out


@pytest.mark.parametrize("size,smooth,slope", [(1, [1], [-1, 0, 1]), (3, [1, 2, 1], [-1, 0, 1]), (5, [1, 4, 6, 4, 1], [-1, -2, 0, 2, 1])])
def test_gradients_mirror_at_the_border(size, smooth, slope):
    a = np.random.default_rng(size).integers(0, 256, (7, 9))
    assert (stencils.gradients(a, size) == slow_gradients(a, smooth, slope)).all()
    ramp = np.tile(np.arange(8) * 10, (6, 1))
    assert (stencils.gradients(ramp)[:, [0, -1]] == 0).all() and (stencils.gradients(ramp)[:, 1:-1] == 6400).all()
    assert (stencils.gradients(np.full((1, 1), 9)) == 0).all()


def test_step_frame_of_the_fixture():
    a = np.full((24, 24), 20)
    a[8:16, 8:16], a[10:14, 10:14] = 40, 80
    weak, edges = r.thresholder("hysteresis", low=30, high=60)(a), r.thresholder("sobel_edges", percentile=80)(a)
    assert (weak[8:16, 8:16] == 255).all() and np.count_nonzero(weak) == 64
    assert np.count_nonzero(edges) and set(np.unique(edges)) <= {0, 255}
    assert np.count_nonzero(r.thresholder("hysteresis")(a)) == 64  # by default from 80 on
    assert np.count_nonzero(r.thresholder("hysteresis", high=81)(a)) == 0


@pytest.mark.parametrize("block", [3, 5, 7, 9])
def test_bell_blocks(block):
    a = np.random.default_rng(block).integers(0, 256, (10, 11))
    w = {3: [1, 2, 1], 5: [1, 4, 6, 4, 1], 7: [1, 3.5, 7, 9, 7, 3.5, 1]}.get(block)
    if w is None:
        w = np.exp(-((np.arange(9) - 4) ** 2) / (2 * (0.3 * (4 - 1) + 0.8) ** 2))
    w = np.array(w) / np.sum(w)
    p = np.pad(a.astype(float), block // 2, mode="edge")
    mean = np.array([[(p[y : y + block, x : x + block] * np.outer(w, w)).sum() for x in range(11)] for y in range(10)])
    close = np.abs(mean - np.floor(mean) - 0.5) < 1e-9
    got = r.thresholder("adaptive_gaussian", block_size=block, c=1.2)(a)
    assert ((got == (a > np.rint(mean) - 2) * 255) | close).all()
    assert (r.thresholder("adaptive_mean", block_size=max(block - 1, 3), c=2)(a) == r.thresholder("adaptive_mean", block_size=block, c=1.5)(a)).all()


def test_method_names_and_defaults():
    a = np.full((10, 10), 10)
    a[2:5, 2:5] = 35
    assert not r.thresholder("percentile_background")(a).any() and not r.thresholder("bounded-otsu")(a).any()
    assert r.thresholder("bounded_otsu", min_contrast=20)(a).any()
    assert not r.thresholder("bounded_otsu", min_contrast=0, max_foreground=0.05)(a).any()
    assert np.count_nonzero(r.thresholder("bounded_otsu", min_contrast=-20, cap=5)(a)) == 0  # all is foreground, which is too much
    assert (r.thresholder("auto")(a) == r.thresholder("otsu")(a)).all() and (r.thresholder("auto", threshold=30)(a) == (a > 30) * 255).all()
    for name in ("manual", "canny"):
        with pytest.raises(ValueError):
            r.thresholder(name)
    with pytest.raises(ValueError, match="at least 3"):
        r.thresholder("adaptive_mean", block_size=2)


def test_gray_weights(spark):
    rows = [(0, 0, 0), (255, 255, 255), (10, 20, 30), (255, 0, 0), (0, 255, 0), (0, 0, 255), (1, 2, 250)]
    got = [x["g"] for x in spark.createDataFrame(rows, "b int, g int, r int").select(scalars.gray("b", "g", "r").alias("g")).collect()]
    assert got == [0, 255, 22, 29, 150, 76, 76]


def test_merges_keep_types(spark):
    one = '{"a":1,"n":{"k":2},"t":true,"l":[1,"x",null],"f":2.5,"u":null}'
    x = spark.createDataFrame([(one, None), (one, "{}"), (one, '{"n":{"z":1},"t":null}'), ("[1]", '{"q":"5"}'), ("broken", None)], "a string, b string")
    got = [json.loads(r_["m"]) for r_ in x.select(scalars.merged_json("a", "b").alias("m")).collect()]
    kept = {k: v for k, v in json.loads(one).items() if v is not None}
    assert got == [kept, kept, {k: v for k, v in (kept | {"n": {"z": 1}}).items() if k != "t"}, {"q": "5"}, {}]
    whole = x.select(scalars.merged_json("a", "b", strip_nulls=False).alias("m")).first()["m"]
    assert json.loads(whole) == json.loads(one)


def test_settings_merge_by_section(spark):
    cases = [
        ('{"storage":{"frame":{"encoding":"raw","quality":80}},"x":1}', '{"storage":{"frame":{"quality":90}},"y":2}', {"storage": {"frame": {"encoding": "raw", "quality": 90}}, "x": 1}),
        ('{"x":1}', '{"storage":{"roi":{"encoding":"png"},"other":{"a":1}}}', {"storage": {"roi": {"encoding": "png"}}, "x": 1}),
        ('{"storage":{"frame":7,"z":true}}', '{"storage":{"frame":{"quality":1}}}', {"storage": {"frame": {"quality": 1}, "z": True}}),
        ('{"storage":{"frame":{"a":1}}}', '{"storage":5}', {"storage": {"frame": {"a": 1}}}),
        (None, None, {}),
    ]
    x = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = [json.loads(r_["m"]) for r_ in x.select(scalars.merged_settings("a", "b").alias("m")).collect()]
    assert got == [want for *_, want in cases]


def test_copies_of_frames(spark):
    schema = "frame_id long, asset_id long, frame_index int, parent_frame_id long, payload_ref string, metadata string"
    old = spark.createDataFrame([(1, 1, 1, None, "p1", '{"k":5}'), (2, 1, 2, None, "p2", None), (3, 2, 1, None, "p3", "{}"), (4, 2, 2, None, "p4", "{}")], schema)
    first = maintain.sandbox_copy(old, old.where("frame_id in (1, 2, 3)"), "crop")
    both = old.unionByName(first)
    second = maintain.sandbox_copy(both, both.where("frame_id <> 4"), "mask")
    rows = {x["frame_id"]: (x["asset_id"], x["frame_index"], x["parent_frame_id"], x["payload_ref"], json.loads(x["metadata"])["live_preview"]["source_frame_id"]) for x in both.unionByName(second).where("frame_id > 4").collect()}
    assert rows == {5: (1, -1, 1, "p1", "1"), 6: (1, -2, 2, "p2", "2"), 7: (2, -1, 3, "p3", "3"), 8: (1, -3, 1, "p1", "1"), 9: (1, -4, 2, "p2", "2"), 10: (2, -2, 3, "p3", "3")}
    assert json.loads(first.where("frame_id = 5").first()["metadata"])["k"] == 5
    assert both.unionByName(second).groupBy("asset_id", "frame_index").count().where("count > 1").count() == 0
