"""Searches, lookups, paging and rankings over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(column: str, low: float | None = None, high: float | None = None) -> Column:
    """low <= column <= high, each end optional."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= low)
    if high is not None:
        out = out & (F.col(column) <= high)
    return out


def contains(column: str, value: str) -> Column:
    """Case-blind substring; % and _ in the value stay wildcards."""
    return F.col(column).ilike(f"%{value}%")


def search(df: DataFrame, exact: dict | None = None, like: dict | None = None, ranges: dict | None = None, member: tuple[str, str] | None = None) -> DataFrame:
    """Rows that meet all the given conditions; they reach the scan as pushed filters where it can take them."""
    for c, v in (exact or {}).items():
        df = df.where(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
    for c, v in (like or {}).items():
        df = df.where(contains(c, v))
    for c, (low, high) in (ranges or {}).items():
        df = df.where(bounds(c, low, high))
    return df.where(F.array_contains(member[0], member[1])) if member else df


def runs_in_collection(runs: DataFrame, assets: DataFrame, collection: str) -> DataFrame:
    """Runs with an asset in the collection."""
    return runs.join(assets.where(F.array_contains("collections", collection)), "run_id", "left_semi")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page by limit and offset; order must end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, keys: list[str], after: tuple | None, limit: int, descending: bool = False) -> DataFrame:
    """The page after the row whose keys are `after`, by keyset comparison."""
    if after is not None:
        here, there = F.struct(*keys), F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after, strict=True)])
        df = df.where(here < there if descending else here > there)
    return df.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys]).limit(limit)


def in_request_order(df: DataFrame, request: DataFrame, key: str) -> DataFrame:
    """Rows of df for the request's (position, key) pairs, by position; missing keys give nothing."""
    return request.join(df, key).orderBy("position")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the order columns, descending: one aggregation, no sort of groups."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in others])


def with_latest(rows: DataFrame, results: DataFrame, within: str, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """rows, each with the columns of its key's last result by the order columns, descending; nulls where there is none.

    results name the same `within` as the row of their key; both are dealt by
    that column alone, which rows from a join by it are already, so that they
    need not cross the network again, and one window over both takes the place
    of a join.
    """
    found = results.where(F.col(key).isNotNull()).select(within, key, F.struct(*order, *[c for c in columns if c not in order]).alias("__fl_last"))
    both = rows.withColumn("__fl_row", F.lit(True)).unionByName(found, allowMissingColumns=True)
    x = both.withColumn("__fl_last", F.max("__fl_last").over(Window.partitionBy(within, key))).where("__fl_row")
    return x.select(*rows.columns, *[F.col(f"__fl_last.{c}").alias(c) for c in columns])


def refined_only(detections: DataFrame, refined: DataFrame) -> DataFrame:
    return detections.join(refined, detections["detection_id"] == refined["candidate_detection_id"], "left_semi")


def unrefined(detections: DataFrame, refined: DataFrame) -> DataFrame:
    return detections.join(refined, detections["detection_id"] == refined["candidate_detection_id"], "left_anti")


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_per_group(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def renumber(df: DataFrame, group: str, order: list[str], into: str) -> DataFrame:
    """Gapless 1-based numbers within each group."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def filter_rois(detections: DataFrame, area: tuple = (None, None), width: tuple = (None, None), height: tuple = (None, None), perimeter: tuple = (None, None), width_height: tuple = (None, None)) -> DataFrame:
    """Regions within the bounds, renumbered by frame; perimeter is that of the box."""
    df = detections.withColumns({"box_perimeter": 2 * (F.col("bbox_w") + F.col("bbox_h")), "box_sum": F.col("bbox_w") + F.col("bbox_h")})
    for c, b in (("area", area), ("bbox_w", width), ("bbox_h", height), ("box_perimeter", perimeter), ("box_sum", width_height)):
        df = df.where(bounds(c, *b))
    return renumber(df.drop("box_perimeter", "box_sum"), "frame_id", ["roi_index", "detection_id"], "new_index")


def frame_context(frames: DataFrame, assets: DataFrame, detections: DataFrame) -> DataFrame:
    """A frame, its asset and its detections as one ordered list."""
    lists = detections.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("roi_index", "detection_id"))).alias("rois"))
    return frames.join(assets.select("asset_id", "filename", "kind"), "asset_id").join(lists, "frame_id", "left")


def collection_counts(assets: DataFrame, like: str | None = None) -> DataFrame:
    """Assets of each collection, of those whose name holds the text."""
    x = assets.select(F.explode("collections").alias("collection"))
    return (x if like is None else x.where(contains("collection", like))).groupBy("collection").agg(F.count("*").alias("asset_count"))


def normalize_collections(value: Column) -> Column:
    """Text split on commas, or a list as it is: trimmed, without empty ones, the first of equal ones; ['none'] if nothing is left."""
    return normalize_list(F.split(F.coalesce(value, F.lit("")), ","))


def normalize_list(values: Column) -> Column:
    parts = F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    return F.when(F.size(parts) == 0, F.array(F.lit("none"))).otherwise(parts)


#: Fixed value: a date, a blank, T or hyphen, and a time with hyphens or colons, in a file's name.
NAME_TIME = r"(\d{4})-(\d{2})-(\d{2})[ T-](\d{2})[-:](\d{2})[-:](\d{2})(?:\.(\d{1,6}))?"


def filename_timestamp(name: Column) -> Column:
    """Text YYYY-MM-DD HH:MM:SS.ffffff of the first time in a file's name; null without one."""
    g = lambda i: F.regexp_extract(name, NAME_TIME, i)
    return F.when(g(1) != "", F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit(" "), g(4), F.lit(":"), g(5), F.lit(":"), g(6), F.lit("."), F.rpad(g(7), 6, "0")))


def padded_bounds(padding: int, width: int, height: int) -> dict[str, Column]:
    """A box grown by the padding and cut to the image: left, top, right, bottom."""
    return {
        "left": F.greatest(F.col("bbox_x") - padding, F.lit(0)),
        "top": F.greatest(F.col("bbox_y") - padding, F.lit(0)),
        "right": F.least(F.col("bbox_x") + F.col("bbox_w") + padding, F.lit(width)),
        "bottom": F.least(F.col("bbox_y") + F.col("bbox_h") + padding, F.lit(height)),
    }


def overlap_pairs(rois: DataFrame, cell: int = 64) -> DataFrame:
    """Overlapping pairs of a frame's regions: intersection area, IoU, and containment of either.

    Regions meet in the cells of a grid over the frame, so that only those near
    each other are compared; a pair counts in the cell of its overlap's corner.
    """
    columns = ("frame_id", "detection_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h")
    span = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.greatest(F.col(size), F.lit(1)) - 1) / cell))
    binned = rois.select(*columns, F.explode(span("bbox_x", "bbox_w")).alias("cx"), span("bbox_y", "bbox_h").alias("cys")).select(*columns, "cx", F.explode("cys").alias("cy"))
    a, b = (binned.select(*[F.col(c).alias(f"{side}_{c}") for c in columns], *[F.col(c).alias(f"{side}_{c}") for c in ("cx", "cy")]) for side in "ab")
    p = a.join(b, (F.col("a_frame_id") == F.col("b_frame_id")) & (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy")) & (F.col("a_detection_id") < F.col("b_detection_id")))
    x, y = F.greatest("a_bbox_x", "b_bbox_x"), F.greatest("a_bbox_y", "b_bbox_y")
    p = p.where((F.floor(x / cell) == F.col("a_cx")) & (F.floor(y / cell) == F.col("a_cy")))
    w = F.least(F.col("a_bbox_x") + F.col("a_bbox_w"), F.col("b_bbox_x") + F.col("b_bbox_w")) - x
    h = F.least(F.col("a_bbox_y") + F.col("a_bbox_h"), F.col("b_bbox_y") + F.col("b_bbox_h")) - y
    p = p.withColumns({"w": w, "h": h}).where("w > 0 and h > 0").withColumn("intersection", F.col("w") * F.col("h"))
    size_a, size_b = F.col("a_bbox_w") * F.col("a_bbox_h"), F.col("b_bbox_w") * F.col("b_bbox_h")
    return p.select(F.col("a_detection_id").alias("first_id"), F.col("b_detection_id").alias("second_id"), "intersection", F.round(F.col("intersection") / (size_a + size_b - F.col("intersection")), 6).alias("iou"), F.round(F.col("intersection") / size_a, 6).alias("first_contained"), F.round(F.col("intersection") / size_b, 6).alias("second_contained"))


def tile_starts(length: Column, tile: int, overlap: float) -> Column:
    """Starts of overlapping tiles on an axis; the last tile ends with the axis."""
    stride = max(1, tile - round(tile * overlap))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), length - tile, F.lit(stride)), F.array(length - tile))))
