"""Frame work: corrections, thresholds, neighbourhood filters, components.

Frames are rows with width, height and pixels (array of int, row by row).  Work
on one frame is an array expression or NumPy on Arrow batches, frame by frame,
with no shuffle; only where frames meet, as in a window's mean, are they summed
within their task first and then by one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .stencils import beyond, bell, gradients, odd, separable
from .typed import DATA, as_bytes, decoded, encoded, inverted, limited, little, values, with_data


def pixels(frames: DataFrame) -> DataFrame:
    """One row a pixel: frame_id, asset_id, frame_index, at, x, y, v."""
    x = frames.select("frame_id", "asset_id", "frame_index", "width", F.posexplode("pixels").alias("pos", "v"))
    return x.select("frame_id", "asset_id", "frame_index", "pos", (F.col("pos") % F.col("width")).alias("x"), F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), "v")


def mask_above(threshold: Column) -> Column:
    """255 where a pixel is above the threshold, else 0."""
    return F.transform("pixels", lambda v: F.when(v > threshold, 255).otherwise(0))


def median_of(column: str = "pixels", q: float = 0.5) -> Column:
    """The interpolated quantile of an array."""
    s, n = F.array_sort(column), F.size(column)
    at = (n - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.element_at(s, low + 1), F.element_at(s, F.least(low + 2, n))
    return a + (b - a) * (at - low)


def otsu_level(a: np.ndarray) -> float:
    """The level that parts a histogram with most variance between classes; the lowest of equal ones."""
    n = np.bincount(np.asarray(a).reshape(-1).astype(np.int64))
    n0, s0 = np.cumsum(n), np.cumsum(n * np.arange(len(n)))
    # Integers up to the division, so that ties are ties.
    d = (s0 * n0[-1] - s0[-1] * n0).astype(np.float64)
    parts = n0 * (n0[-1] - n0)
    between = np.where(parts > 0, d * d / np.maximum(parts, 1), 0.0)
    seen = np.flatnonzero(n)
    return float(seen[np.argmax(between[seen])])


def otsu(frames: DataFrame, cap: float | None = None) -> DataFrame:
    """frame_id and the frame's Otsu threshold, at most `cap`."""
    level = lambda a: otsu_level(as_bytes(a)) if cap is None else min(otsu_level(as_bytes(a)), float(cap))
    return frame_rows(frames.select("frame_id", *pixel_columns(frames)), lambda r: [(r["frame_id"], level(r["pixels"]))], f"frame_id {dict(frames.dtypes)['frame_id']}, threshold double")


def bounded_otsu_mask(min_contrast: float, max_foreground: float, cap: float | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Otsu, at most cap, but kept min_contrast above the median; a mask with too much foreground is empty."""
    def f(a: np.ndarray) -> np.ndarray:
        level, background = otsu_level(a), float(np.median(a))
        level = level if cap is None else min(level, float(cap))
        if level - background < min_contrast:
            level = min(255.0, background + min_contrast)
        mask = (a > level) * 255
        return mask * 0 if np.count_nonzero(mask) / mask.size > max_foreground else mask

    return f


def bounded_otsu(frames: DataFrame, min_contrast: float, max_foreground: float, cap: float | None = None) -> DataFrame:
    return per_frame(frames, bounded_otsu_mask(min_contrast, max_foreground, cap))


def percentile_background(frames: DataFrame, q: float, min_contrast: float) -> DataFrame:
    x = frames.withColumn("threshold", F.least(F.lit(255.0), median_of(q=q) + min_contrast))
    return x.withColumn("mask", mask_above(F.col("threshold")))


def divide(v: Column, field: Column, low: float = 1.0, high: float | None = None) -> Column:
    """v over the bounded field, times 255, cut to 0..255 and truncated; a field below low counts as 0, above high as 255; where it is 0 the result is 255."""
    bounded = F.when(field < low, F.lit(0.0))
    bounded = (bounded.when(field > high, F.lit(255.0)) if high is not None else bounded).otherwise(field.cast("double"))
    return F.when(bounded == 0, 255).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v * 255 / bounded)).cast("int"))


def bounded_field(field: np.ndarray, low: float = 1.0, high: float | None = None) -> np.ndarray:
    """A field below low counts as 0, above high as 255."""
    if low < 0 or (high is not None and high < low):
        raise ValueError("the field's least value must be at least 0 and at most its largest")
    field = np.where(field < low, 0.0, field)
    return np.where(field > high, 255.0, field) if high is not None else field


def divided(a: np.ndarray, field: np.ndarray | float, low: float = 1.0, high: float | None = None, kind: np.dtype | None = None) -> np.ndarray:
    """divide for whole frames, by a field of the frame's shape, a row, a column or a number; the result is of the frame's element type."""
    field = np.asarray(bounded_field(np.asarray(field, np.float64), low, high))
    out = np.ones(np.broadcast_shapes(a.shape, field.shape)) * 255
    np.divide(a * 255.0, field, out=out, where=field != 0)
    return limited(out, kind)


def flatfield(frames: DataFrame, q: float, axis: int = 0, low: float = 1.0, high: float | None = None) -> DataFrame:
    """Each pixel over its column's (axis 0) or row's (axis 1) quantile within the frame."""
    return per_frame(frames, lambda a: divided(a, np.quantile(a, q, axis=axis, keepdims=True), low, high), "pixels")


def invert(column: str = "pixels", top: int = 255) -> Column:
    return F.transform(column, lambda v: top - v)


def crop_mask(frames: DataFrame, left: int, top: int, right: int, bottom: int, fill: int) -> DataFrame:
    """Pixels outside the box set to fill."""
    inside = lambda i: (i % F.col("width") >= left) & (i % F.col("width") < right) & (F.floor(i / F.col("width")) >= top) & (F.floor(i / F.col("width")) < bottom)
    return frames.withColumn("pixels", F.transform("pixels", lambda v, i: F.when(inside(i), v).otherwise(fill)))


def area_means(a: np.ndarray, k: int) -> np.ndarray:
    """Means of k x k cells; cells at the right and lower edge may be smaller."""
    at_y, at_x = np.arange(0, a.shape[0], k), np.arange(0, a.shape[1], k)
    sums = np.add.reduceat(np.add.reduceat(a.astype(np.float64), at_y, 0), at_x, 1)
    return sums / np.outer(np.diff(np.append(at_y, a.shape[0])), np.diff(np.append(at_x, a.shape[1])))


def preview(frames: DataFrame, k: int) -> DataFrame:
    """Means of k x k cells: frame_id, px, py, v."""
    rows = lambda r: [(r["frame_id"], int(x), int(y), float(m[y, x])) for m in [area_means(r["pixels"], k)] for y, x in np.ndindex(m.shape)]
    return frame_rows(frames.select("frame_id", *pixel_columns(frames)), rows, f"frame_id {dict(frames.dtypes)['frame_id']}, px int, py int, v double")


def metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference measures of frames paired by pair_id: MSE, MAE, largest, PSNR (null if equal), whole-image SSIM."""
    x = F.zip_with("a", "b", lambda p, q: p - q)
    j = a.select("pair_id", F.col("pixels").alias("a")).join(b.select("pair_id", F.col("pixels").alias("b")), "pair_id")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    n = F.size("a")
    mse = total(F.transform(x, lambda d: d * d)) / n
    mu_a, mu_b = total("a") / n, total("b") / n
    var_a, var_b = total(F.transform("a", lambda v: v * v)) / n - mu_a * mu_a, total(F.transform("b", lambda v: v * v)) / n - mu_b * mu_b
    cov = total(F.zip_with("a", "b", lambda p, q: p * q)) / n - mu_a * mu_b
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ssim = (2 * mu_a * mu_b + c1) * (2 * cov + c2) / ((mu_a * mu_a + mu_b * mu_b + c1) * (var_a + var_b + c2))
    return j.select("pair_id", F.round(mse, 6).alias("mse"), F.round(total(F.transform(x, F.abs)) / n, 6).alias("mae"), F.array_max(F.transform(x, F.abs)).alias("max_abs"), F.when(mse > 0, F.round(20 * F.log10(255 / F.sqrt(mse)), 6)).alias("psnr"), F.round(ssim, 6).alias("ssim"))


def nominal_geometry(frames: DataFrame) -> DataFrame:
    """The most frequent size of an asset's frames, the larger area of equal ones."""
    n = frames.groupBy("asset_id", "width", "height").agg(F.count("*").alias("n"))
    return n.groupBy("asset_id").agg(F.max_by(F.struct("width", "height"), F.struct("n", F.col("width") * F.col("height"), "width")).alias("g")).select("asset_id", "g.width", "g.height")


def centre(index: Column, stride: int) -> Column:
    return (F.floor((index + stride // 2) / stride) * stride).cast("long")


def to_centres(frames: DataFrame, stride: int, width: int) -> DataFrame:
    """Each frame once for each window centre that it feeds, by equi-join keys instead of a range join."""
    low = F.greatest(F.ceil((F.col("frame_index") - F.lit(width) / 2) / stride), F.lit(0)).cast("long")
    high = F.floor((F.col("frame_index") + F.lit(width) / 2) / stride).cast("long")
    return frames.withColumn("centre", F.explode(F.sequence(low, high))).withColumn("centre", F.col("centre") * stride)


def window_sums(frames: DataFrame, values: Callable[[np.ndarray], tuple[np.ndarray, int]], stride: int, width: int) -> DataFrame:
    """(asset_id, centre, total, n, frames): values of an asset's frames and their weight, summed over each window.

    Frames are summed within their task before they meet, so that a task sends
    one row for each window it holds frames of.
    """
    kinds = dict(frames.dtypes)
    schema = f"asset_id {kinds['asset_id']}, centre long, total array<double>, n long, frames long"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple, list] = {}
            for asset, index, w, h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                total, n = values(p.values.to_numpy().reshape(h, w))
                for c in range(max(0, -int(-(index - width / 2) // stride)), int((index + width / 2) // stride) + 1):
                    known = sums.get((asset, c * stride))
                    sums[asset, c * stride] = [total.astype(np.float64), n, 1] if known is None else [known[0] + total, known[1] + n, known[2] + 1]
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], b.column(0).type), pa.array([k[1] for k in sums], pa.int64()), pa.array([v[0] for v in sums.values()], pa.list_(pa.float64())), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in (1, 2))], names=["asset_id", "centre", "total", "n", "frames"])

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([x.values.to_numpy() for x in t.column("total")], axis=0)
        out = t.slice(0, 1).drop_columns(["total", "n", "frames"])
        out = out.append_column("total", pa.array([total], pa.list_(pa.float64())))
        return out.append_column("n", pa.array([sum(t.column("n").to_pylist())], pa.int64())).append_column("frames", pa.array([sum(t.column("frames").to_pylist())], pa.int64()))

    parts = frames.select("asset_id", "frame_index", "width", "height", "pixels").mapInArrow(partial, schema)
    return parts.groupBy("asset_id", "centre").applyInArrow(add, schema)


def mean_backgrounds(frames: DataFrame, stride: int, width: int) -> DataFrame:
    """Mean frame of each asset's windows over its frames of nominal size, rounded half to even: asset_id, centre, width, height, background, frames."""
    nominal = nominal_geometry(frames)
    whole = frames.join(nominal, ["asset_id", "width", "height"], "left_semi")
    means = window_sums(whole, lambda a: (a.reshape(-1), 1), stride, width)
    mean = F.transform("total", lambda v: F.rint(v / F.col("n")).cast("int")).alias("background")
    return means.select("asset_id", "centre", mean, "frames").join(nominal, "asset_id")


def mean_fields(frames: DataFrame, stride: int, width: int) -> DataFrame:
    """The same, one row a pixel: asset_id, centre, pos, background, frames."""
    return mean_backgrounds(frames, stride, width).select("asset_id", "centre", F.posexplode("background").alias("pos", "background"), "frames")


def mean_profiles(frames: DataFrame, stride: int, width: int, axis: int = 0) -> DataFrame:
    """Mean of each column (axis 0) or row (axis 1) over an asset's windows, weighted by pixels; frames may be shorter along the axis, but are as long across it as the nominal size."""
    across = "width" if axis == 0 else "height"
    fitting = frames.join(nominal_geometry(frames).select("asset_id", across), ["asset_id", across], "left_semi")
    sums = window_sums(fitting, lambda a: (a.sum(axis=axis), a.shape[axis]), stride, width)
    return sums.select("asset_id", "centre", F.transform("total", lambda v: v / F.col("n")).alias("profile"), "frames")


def profiles(frames: DataFrame, stride: int, width: int, axis: int = 0) -> DataFrame:
    """The same, one row for each column or row: asset_id, centre, x, profile."""
    return mean_profiles(frames, stride, width, axis).select("asset_id", "centre", F.posexplode("profile").alias("x", "profile"))


def missing_windows(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Windows still to be made: those without one of the same asset, centre, stride, width and frame size."""
    return wanted.join(existing, ["asset_id", "centre", "stride", "window", "width", "height"], "left_anti")


def window_assignment(frames: DataFrame, windows: DataFrame, stride: int) -> DataFrame:
    """Each frame with its window's centre, and whether the window exists."""
    x = frames.select("frame_id", "asset_id", "frame_index", centre(F.col("frame_index"), stride).alias("centre"))
    return x.join(windows.select("asset_id", "centre").distinct().withColumn("has_window", F.lit(True)), ["asset_id", "centre"], "left").withColumn("has_window", F.coalesce("has_window", F.lit(False)))


def per_frame(frames: DataFrame, function: Callable[[np.ndarray], np.ndarray], into: str = "mask") -> DataFrame:
    """A NumPy function of the 2-D frame, applied to Arrow batches: frame_id, asset_id, width, height and the result."""
    types = dict(frames.dtypes)
    rows = lambda r: [(r["frame_id"], r["asset_id"], r["pixels"].shape[1], r["pixels"].shape[0], function(r["pixels"]).reshape(-1).astype(np.int32))]
    return frame_rows(frames.select("frame_id", "asset_id", *pixel_columns(frames)), rows, f"frame_id {types['frame_id']}, asset_id {types['asset_id']}, width int, height int, {into} array<int>")


def pixel_columns(frames: DataFrame) -> list[str]:
    """The columns that hold a frame's pixels: `data`, a packed array of any element type, where there is one, or width, height and pixels."""
    return ["data"] if "data" in frames.columns else ["width", "height", "pixels"]


def frame_rows(frames: DataFrame, rows: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Any rows made from each frame in Arrow batches; array columns come as NumPy arrays, pixels and masks in the frame's shape.

    Frames with a `data` column (see framelake.operators.typed) have their
    pixels, width and height from it, in its element type.
    """
    types = T.StructType.fromDDL(schema)
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(types)
        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                row = {}
                for n, c in zip(names, b.columns, strict=True):
                    v = c[i]
                    row[n] = (np.array(v.values) if v.is_valid else None) if pa.types.is_list(c.type) else v.as_py()
                if row.get("data") is not None:
                    row["pixels"] = decoded(row["data"])
                    row["height"], row["width"] = row["pixels"].shape
                for n in ("pixels", "mask"):
                    if row.get(n) is not None and row[n].size == row["width"] * row["height"]:
                        row[n] = row[n].reshape(row["height"], row["width"])
                out.extend(rows(row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return frames.mapInArrow(run, types)


def window_assignments(frames: DataFrame, backgrounds: DataFrame, profiles: DataFrame, background_stride: int, profile_stride: int) -> DataFrame:
    """Each frame with its background's and its profile's window, on schedules of their own: frame_id, asset_id, and a centre of each, null where there is no such window."""
    one = lambda windows, stride, into: window_assignment(frames, windows, stride).select("frame_id", "asset_id", F.when(F.col("has_window"), F.col("centre")).alias(into))
    profile = one(profiles, profile_stride, "profile_centre").drop("asset_id")
    return one(backgrounds, background_stride, "background_centre").join(profile, "frame_id")


def shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a moved so that each place holds its neighbour at (dy, dx), borders repeated."""
    ys, xs = (beyond(np.arange(n) + d, n, "repeat") for n, d in zip(a.shape, (dy, dx), strict=True))
    return a[ys][:, xs]


def window_of(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def adaptive_mean(block: int, c: float) -> Callable[[np.ndarray], np.ndarray]:
    """255 where a pixel is above its block's rounded mean less c, which counts as the next whole number; borders are repeated."""
    size = odd(int(block), 3)
    ones = np.ones(size, np.int64)

    def f(a: np.ndarray) -> np.ndarray:
        mean = np.rint(separable(a.astype(np.int64), ones, ones, "repeat") / size**2)
        return (a > mean - math.ceil(c)) * 255

    return f


def adaptive_gaussian(block: int, c: float) -> Callable[[np.ndarray], np.ndarray]:
    """The same with a mean weighted by a bell curve."""
    weights = bell(odd(int(block), 3))

    def f(a: np.ndarray) -> np.ndarray:
        mean = np.rint(separable(a.astype(np.float64), weights, weights, "repeat"))
        return (a > mean - math.ceil(c)) * 255

    return f


def sobel(threshold: float | None = None, percentile: float = 90, kernel_size: int = 3) -> Callable[[np.ndarray], np.ndarray]:
    """255 where the gradient reaches a fixed level or, without one, the percentile of the frame's."""
    size = odd(int(kernel_size), 1)

    def f(a: np.ndarray) -> np.ndarray:
        squared = gradients(a, size)
        if threshold is not None:
            return (squared >= threshold * threshold) * 255
        lengths = np.sqrt(squared)
        return (lengths >= np.percentile(lengths, percentile)) * 255

    return f


def morph(kind: str, size: int = 3, times: int = 1) -> Callable[[np.ndarray], np.ndarray]:
    """dilate, erode, open or close with a square of that size."""
    def once(a: np.ndarray, pick: Callable) -> np.ndarray:
        for _ in range(times):
            a = pick([shifted(a, *o) for o in window_of(size)], axis=0)
        return a

    steps = {"dilate": [np.max], "erode": [np.min], "open": [np.min, np.max], "close": [np.max, np.min]}[kind]

    def f(a: np.ndarray) -> np.ndarray:
        for pick in steps:
            a = once(a, pick)
        return a

    return f


def label(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Components of the non-zero pixels, numbered from 1 by their first pixel.

    The first pass joins runs of a row to those they touch in the row above, in
    a forest; the second gives each run its tree's number.  Linear in pixels.
    """
    h, w = mask.shape
    edge = np.zeros((h, w + 2), np.int8)
    edge[:, 1:-1] = mask > 0
    turn = np.diff(edge, axis=1)
    rows, starts = np.nonzero(turn == 1)
    ends = np.nonzero(turn == -1)[1]
    parent, near = list(range(len(rows))), 1 if connectivity == 8 else 0

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first, s, e = np.searchsorted(rows, np.arange(h + 1)).tolist(), starts.tolist(), ends.tolist()
    for r in range(1, h):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if s[i] < e[j] + near and s[j] < e[i] + near:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    out = np.zeros(h * w, np.int64)
    if len(rows):
        number = np.unique([root(i) for i in range(len(rows))], return_inverse=True)[1] + 1
        n = ends - starts
        out[np.repeat(rows * w + starts - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.repeat(number, n)
    return out.reshape(h, w)


def hysteresis(low: float, high: float, connectivity: int = 8) -> Callable[[np.ndarray], np.ndarray]:
    """Weak components that hold a strong pixel."""
    def f(a: np.ndarray) -> np.ndarray:
        parts = label(a >= low, connectivity)
        return np.isin(parts, np.setdiff1d(parts[a >= high], 0)) * 255

    return f


def remove_small(least: int, connectivity: int = 8) -> Callable[[np.ndarray], np.ndarray]:
    def f(a: np.ndarray) -> np.ndarray:
        parts = label(a, connectivity)
        return np.where((np.bincount(parts.reshape(-1)) >= least)[parts], a, 0)

    return f


def fill_holes(a: np.ndarray) -> np.ndarray:
    """Background that the top left pixel's background does not reach becomes foreground."""
    parts = label(a == 0, 4)
    return np.where((a > 0) | (parts != parts[0, 0]), 255, 0) if a[0, 0] == 0 else np.where(a >= 0, 255, 0)


def clear_border(a: np.ndarray) -> np.ndarray:
    parts = label(a, 8)
    edge = np.unique(np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]]))
    return np.where(np.isin(parts, edge), 0, a)


def augment(steps: list[Callable[[np.ndarray], np.ndarray]]) -> Callable[[np.ndarray], np.ndarray]:
    """Mask steps in order."""
    def f(a: np.ndarray) -> np.ndarray:
        for s in steps:
            a = s(a)
        return a

    return f


def fill_enclosed(a: np.ndarray) -> np.ndarray:
    """Every hole filled: background that no edge of the frame reaches becomes foreground."""
    parts = label(a == 0, 4)
    outside = np.unique(np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]]))
    return np.where((a > 0) | ~np.isin(parts, outside), 255, 0)


def boxes(labels: np.ndarray) -> dict[str, np.ndarray]:
    """Box, area and axis lengths of each labelled component, in order of the labels.

    Axes are those of the ellipse with the component's second moments, or the
    box's longer and shorter side for components of under five pixels.
    """
    n = int(labels.max(initial=0))
    y, x = np.nonzero(labels)
    at = labels[y, x] - 1
    low, high = np.full((2, n), 2**31), np.full((2, n), -1)
    for k, v in enumerate((x, y)):
        np.minimum.at(low[k], at, v)
        np.maximum.at(high[k], at, v)
    area = np.bincount(at, minlength=n)
    mean = [np.bincount(at, v, n) / np.maximum(area, 1) for v in (x, y)]
    dx, dy = x - mean[0][at], y - mean[1][at]
    # A pixel is a square of its own: a twelfth of its side's square goes to each variance.
    xx, yy, xy = (np.bincount(at, v, n) / np.maximum(area, 1) for v in (dx * dx, dy * dy, dx * dy))
    xx, yy = xx + 1 / 12, yy + 1 / 12
    spread = np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
    width, height = high[0] - low[0] + 1, high[1] - low[1] + 1
    major, minor = (4 * np.sqrt(np.maximum((xx + yy) / 2 + sign * spread, 0)) for sign in (1, -1))
    few = area < 5
    return {"bbox_x": low[0], "bbox_y": low[1], "bbox_w": width, "bbox_h": height, "area": area, "major_axis_length": np.where(few, np.maximum(width, height), major), "minor_axis_length": np.where(few, np.minimum(width, height), minor)}


def gray_statistics(labels: np.ndarray, gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and mean gray value of each component."""
    n = int(labels.max(initial=0))
    on = labels > 0
    low = np.full(n, 2**31)
    np.minimum.at(low, labels[on] - 1, gray[on])
    return low, np.bincount(labels[on] - 1, gray[on], n) / np.maximum(np.bincount(labels[on] - 1, minlength=n), 1)


def mask_in_crop(mask: np.ndarray, at: tuple[int, int], crop: tuple[int, int, int, int]) -> np.ndarray:
    """A mask whose corner lies at `at`, as the crop (x, y, w, h) sees it; what the crop does not cover is lost, the rest is 0."""
    if crop[2] < 1 or crop[3] < 1:
        raise ValueError("a crop has at least one pixel")
    out = np.zeros((crop[3], crop[2]), mask.dtype)
    x0, y0 = max(crop[0], at[0]), max(crop[1], at[1])
    x1, y1 = min(crop[0] + crop[2], at[0] + mask.shape[1]), min(crop[1] + crop[3], at[1] + mask.shape[0])
    if x1 > x0 and y1 > y0:
        out[y0 - crop[1] : y1 - crop[1], x0 - crop[0] : x1 - crop[0]] = mask[y0 - at[1] : y1 - at[1], x0 - at[0] : x1 - at[0]]
    return out


DETECTION = "roi_index int, bbox_x int, bbox_y int, bbox_w int, bbox_h int, crop_bbox_x int, crop_bbox_y int, crop_bbox_w int, crop_bbox_h int, source_x int, source_y int, area long, major_axis_length double, minor_axis_length double, min_gray int, mean_gray double, roi array<int>, mask array<int>"


def detections(frames: DataFrame, mask: Callable[[np.ndarray], np.ndarray], connectivity: int = 8, padding: int = 0, external: bool = False, payloads: bool = True, keep: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None, most: int | None = None) -> DataFrame:
    """A row for each component of each frame's mask, in one pass over the frames.

    Boxes are the frame's own; crops are boxes grown by the padding and cut to
    the frame; source_x and source_y add the frame's bbox_x and bbox_y, if it
    has them.  `external` fills holes first, so that a component is its outer
    contour; `keep` tells which components count, by their boxes; at most
    `most` of a frame are given.  Without payloads roi and mask are null.
    """
    kinds = dict(frames.dtypes)
    offsets = [F.col(c) if c in kinds else F.lit(0).alias(c) for c in ("bbox_x", "bbox_y")]

    def rows(r: dict) -> list[tuple]:
        a = r["pixels"]
        m = mask(a)
        labels = label(fill_enclosed(m) if external else m, connectivity)
        found = boxes(labels)
        low, mean = gray_statistics(labels, a)
        chosen = np.arange(len(low)) if keep is None else np.flatnonzero(keep(found))
        out = []
        for index, i in enumerate(chosen[:most].tolist(), 1):
            x, y, w, h = (int(found[k][i]) for k in ("bbox_x", "bbox_y", "bbox_w", "bbox_h"))
            cx, cy = max(0, x - padding), max(0, y - padding)
            cw, ch = min(a.shape[1], x + w + padding) - cx, min(a.shape[0], y + h + padding) - cy
            roi = own = None
            if payloads:
                roi = a[cy : cy + ch, cx : cx + cw].reshape(-1)
                own = mask_in_crop((labels[y : y + h, x : x + w] == i + 1) * 255, (x, y), (cx, cy, cw, ch)).reshape(-1)
            out.append((r["frame_id"], index, x, y, w, h, cx, cy, cw, ch, r["bbox_x"] + x, r["bbox_y"] + y, int(found["area"][i]), float(found["major_axis_length"][i]), float(found["minor_axis_length"][i]), int(low[i]), float(mean[i]), roi, own))
        return out

    return frame_rows(frames.select("frame_id", *pixel_columns(frames), *offsets), rows, f"frame_id {kinds['frame_id']}, {DETECTION}")


def regions(frames: DataFrame, mask: Callable[[np.ndarray], np.ndarray], connectivity: int = 8) -> DataFrame:
    """Components of each frame's mask with box, area and gray values."""
    x = detections(frames, mask, connectivity, payloads=False)
    return x.select("frame_id", F.col("roi_index").alias("label"), "bbox_x", "bbox_y", "bbox_w", "bbox_h", "area", "min_gray", F.round("mean_gray", 6).alias("mean_gray"))


def manual(threshold: float | None = None) -> Callable[[np.ndarray], np.ndarray]:
    if threshold is None:
        raise ValueError("the manual method needs a threshold")
    return lambda a: (a > threshold) * 255


def automatic(threshold: float | None = None, cap: float | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Manual where a threshold is given, else Otsu."""
    return manual(threshold) if threshold is not None else METHODS["otsu"](cap)


#: Threshold methods by name: each takes options and gives a function of the frame.  The defaults are fixed values.
METHODS: dict[str, Callable[..., Callable[[np.ndarray], np.ndarray]]] = {
    "auto": automatic,
    "manual": manual,
    "otsu": lambda cap=None: lambda a: (a > (otsu_level(a) if cap is None else min(otsu_level(a), cap))) * 255,
    "bounded_otsu": lambda min_contrast=50, max_foreground=0.9, cap=None: bounded_otsu_mask(min_contrast, max_foreground, cap),
    "percentile_background": lambda percentile=50, min_contrast=50: lambda a: (a > min(255.0, np.percentile(a, percentile) + min_contrast)) * 255,
    "adaptive_mean": lambda block_size=31, c=5: adaptive_mean(block_size, c),
    "adaptive_gaussian": lambda block_size=31, c=5: adaptive_gaussian(block_size, c),
    "hysteresis": lambda low=30, high=80, connectivity=8: hysteresis(low, high, connectivity),
    "sobel_edges": sobel,
    "sobel": sobel,
}


def thresholder(method: str | Callable[[np.ndarray], np.ndarray], **options: object) -> Callable[[np.ndarray], np.ndarray]:
    """The named method with its options, or a function as it stands; frames of other types than bytes are scaled to these first.

    Two methods may be joined by _or_ and _and_, each with its options under its
    name: thresholder("manual_or_otsu", manual={"threshold": 90}).
    """
    if callable(method):
        return method
    name = method.lower().replace("-", "_")
    for word, join in (("_or_", np.maximum), ("_and_", np.minimum)):
        if name not in METHODS and word in name:
            first, second = (thresholder(m, **options.get(m, {})) for m in name.split(word, 1))
            return lambda a: join(first(a), second(a))
    if name not in METHODS:
        raise ValueError(f"unknown threshold method {method!r}; one of {', '.join(sorted(METHODS))}")
    find = METHODS[name](**options)
    return lambda a: find(as_bytes(a))


def crop_bounds(width: int, height: int, box: tuple[int | None, int | None, int | None, int | None] | None) -> tuple[int, int, int, int] | None:
    """x, y, w, h of a crop within the frame, or None without one; half-given or outside boxes are errors."""
    if box is None or all(v is None for v in box):
        return None
    if any(v is None for v in box):
        raise ValueError("a crop needs x, y, w and h")
    x, y, w, h = box
    if w < 1 or h < 1 or x < 0 or y < 0 or x + w > width or y + h > height:
        raise ValueError(f"crop {box} is not within a frame of {width} x {height}")
    return x, y, w, h


PREPROCESSED = "width int, height int, bbox_x int, bbox_y int, pixels array<int>, steps string"


def preprocess(frames: DataFrame, crop: tuple | None = None, apply_mask: bool = True, invert_intensity: bool = True, axis: int = 0, low: float = 1.0, high: float | None = None, fill: int = 0) -> DataFrame:
    """Crop, mask, correction and inversion of each frame, and the steps taken, in one pass.

    Of the optional columns, mask has the frame's size; background is an array
    of background_width values a row, of which a smaller frame takes the upper
    left part, or the number background_level; profile has a value for each
    column (axis 0) or row.  A background is preferred to a profile.  Frames
    with a `data` column keep their element type, and have one in the result.
    """
    kinds, typed = dict(frames.dtypes), "data" in frames.columns
    extra = {"mask": "array<int>", "background": "array<int>", "background_width": "int", "background_level": "double", "profile": "array<double>", "bbox_x": "int", "bbox_y": "int"}
    given = [F.col(c) if c in kinds else F.lit(None).cast(t).alias(c) for c, t in extra.items()]

    def rows(r: dict) -> list[tuple]:
        a, m, steps = r["pixels"], r["mask"], []
        kind = np.dtype(r["data"]["dtype"]) if typed else None
        h, w = a.shape
        m = None if m is None else m.reshape(h, w)
        field = r["background_level"]
        if r["background"] is not None:
            field = r["background"].reshape(-1, r["background_width"] or w)
            if field.shape[0] < h or field.shape[1] < w:
                raise ValueError(f"a background of {field.shape} cannot cover a frame of {a.shape}")
            field = field[:h, :w]
        profile = r["profile"]
        box = crop_bounds(w, h, crop)
        x = y = 0
        if box is not None:
            x, y, cw, ch = box
            cut = lambda v: v[y : y + ch, x : x + cw]
            a, m, field = cut(a), None if m is None else cut(m), cut(field) if isinstance(field, np.ndarray) else field
            profile = None if profile is None else (profile[x : x + cw] if axis == 0 else profile[y : y + ch])
            steps.append("crop")
        if apply_mask and m is not None:
            a = np.where(m > 0, a, np.asarray(fill, a.dtype))
            steps.append("mask")
        if field is not None:
            a = divided(a, field, low, high, kind)
            steps.append("background_correction")
        elif profile is not None:
            if len(profile) != a.shape[1 - axis]:
                raise ValueError(f"a profile of {len(profile)} values does not fit a frame of {a.shape}")
            a = divided(a, profile[None, :] if axis == 0 else profile[:, None], low, high, kind)
            steps.append("flatfield")
        if invert_intensity:
            a = inverted(a, kind)
            steps.append("invert_intensity")
        place = ((r["bbox_x"] or 0) + x, (r["bbox_y"] or 0) + y)
        if typed:
            return [(r["frame_id"], *place, encoded(a, kind.name), ",".join(steps))]
        return [(r["frame_id"], a.shape[1], a.shape[0], *place, a.reshape(-1), ",".join(steps))]

    shape = PREPROCESSED.replace("width int, height int, ", "").replace("pixels array<int>", f"data {DATA}") if typed else PREPROCESSED
    return frame_rows(frames.select("frame_id", *pixel_columns(frames), *given), rows, f"frame_id {kinds['frame_id']}, {shape}")


def with_backgrounds(frames: DataFrame, backgrounds: DataFrame, stride: int) -> DataFrame:
    """frames with the background of their window, if there is one: whole arrays are joined, not pixels."""
    b = backgrounds.select("asset_id", "centre", "background", F.col("width").alias("background_width"))
    return frames.withColumn("centre", centre(F.col("frame_index"), stride)).join(b, ["asset_id", "centre"], "left")


def segment(frames: DataFrame, method: str | Callable = "otsu", options: dict | None = None, steps: list[Callable] | None = None, least_area: int = 1, most: int | None = None, preprocessed: bool = False, chain: dict | None = None, **how: object) -> DataFrame:
    """The whole segment job: preprocessing (unless done), threshold, mask steps, components, filter, records."""
    x = frames if preprocessed else preprocess(frames, **(chain or {}))
    find = augment([thresholder(method, **(options or {})), *(steps or [])])
    return detections(x, find, keep=lambda b: b["area"] >= least_area, most=most, **how)


def segment_preview(frames: DataFrame, most: int = 100, **how: object) -> DataFrame:
    """The same pipeline without payloads, with at most `most` detections a frame."""
    return segment(frames, most=most, payloads=False, **how).drop("roi", "mask")


def stage_counts(frames: DataFrame, found: DataFrame) -> DataFrame:
    """One row: frames, frames with detections, detections, foreground pixels."""
    per = found.groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    x = frames.select("frame_id").join(per, "frame_id", "left")
    return x.agg(F.count("*").alias("frames"), F.count("n").alias("frames_with_detections"), F.coalesce(F.sum("n"), F.lit(0)).alias("detections"), F.coalesce(F.sum("area"), F.lit(0)).alias("foreground_pixels"))


def pack_arrays(frames: DataFrame, dtype: str = "uint8") -> DataFrame:
    """frame_id, dtype, shape and the pixels as bytes in row order, little-endian."""
    little(dtype)
    return with_data(frames.select("frame_id", "width", "height", "pixels"), dtype).select("frame_id", "data.dtype", "data.shape", "data.payload")


def unpack_arrays(packed: DataFrame, element: str = "double") -> DataFrame:
    """The frames of packed arrays: frame_id, width, height, pixels as an array of the element type; values it cannot hold, and a payload of another length than its shape, are errors."""
    return values(packed.select("frame_id", F.struct("dtype", "shape", "payload").alias("data")), element)
