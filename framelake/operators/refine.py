"""Refinement of regions: tiles, prediction, merging, greedy reconciliation, residuals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framelake.sources.shared import write_shared

from .catalog import tile_starts
from .raster import boxes, label, mask_in_crop

IOU, CONTAINMENT = 0.5, 0.8


def tiles(frames: DataFrame, tile: int, overlap: float) -> DataFrame:
    """One row for each tile: frame_id, tile_x, tile_y and its pixels, short edges padded with 0.

    A mask, if there is one, is cut alike; regions with a place in their frame
    (crop_x, crop_y) have their tiles' boxes in it, as frame_x, frame_y,
    tile_w and tile_h.
    """
    x = frames.withColumn("tile_x", F.explode(tile_starts(F.col("width"), tile, overlap))).withColumn("tile_y", F.explode(tile_starts(F.col("height"), tile, overlap)))
    at = lambda i: (F.col("tile_y") + F.floor(i / tile)) * F.col("width") + F.col("tile_x") + i % tile
    inside = lambda i: (F.col("tile_x") + i % tile < F.col("width")) & (F.col("tile_y") + F.floor(i / tile) < F.col("height"))
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), lambda i: F.when(inside(i), F.get(c, at(i).cast("int"))).otherwise(0)).alias(c)
    more = [cut("mask")] if "mask" in frames.columns else []
    if "crop_x" in frames.columns:
        more += [(F.col("crop_x") + F.col("tile_x")).alias("frame_x"), (F.col("crop_y") + F.col("tile_y")).alias("frame_y")]
        more += [F.least(F.lit(tile), F.col("width") - F.col("tile_x")).alias("tile_w"), F.least(F.lit(tile), F.col("height") - F.col("tile_y")).alias("tile_h")]
    return x.select("frame_id", "tile_x", "tile_y", cut("pixels"), *more)


def predict(tiles_: DataFrame, model: Callable[[np.ndarray], np.ndarray], tile: int, threshold: float = 0.5) -> DataFrame:
    """The model's 0/1 mask of each tile; it gets (tiles, height, width) scaled to 0..1 and returns probabilities.

    A prediction with values above 1 is a 0/positive mask.
    """

    @F.pandas_udf("array<int>")
    def run(pixels: pd.Series) -> pd.Series:
        if not len(pixels):
            return pd.Series([], dtype=object)
        x = np.nan_to_num(np.stack(pixels.to_list()).reshape(-1, tile, tile).astype(np.float32))
        x = x / 255 if x.max(initial=0) > 1 else x
        out = np.asarray(model(x))
        binary = np.where((out.max(axis=(1, 2)) > 1)[:, None, None], out > 0, out >= threshold)
        return pd.Series(list(binary.reshape(len(out), -1).astype(np.int32)))

    return tiles_.withColumn("mask", run("pixels")).drop("pixels")


def merge_tiles(predicted: DataFrame, tile: int) -> DataFrame:
    """Pixels that at least half of the tiles over them vote for: frame_id, x, y."""
    p = predicted.select("frame_id", "tile_x", "tile_y", F.posexplode("mask").alias("i", "vote"))
    p = p.select("frame_id", (F.col("tile_x") + F.col("i") % tile).alias("x"), (F.col("tile_y") + F.floor(F.col("i") / tile)).cast("int").alias("y"), "vote")
    return p.groupBy("frame_id", "x", "y").agg(F.avg("vote").alias("share")).where("share >= 0.5").select("frame_id", "x", "y")


class Keepers:
    """The kept regions of a frame in cells of a grid, so that a region meets only those near it."""

    CELL = 64  # pixels

    def __init__(self) -> None:
        self.kept: list[dict] = []
        self.cells: dict[tuple[int, int], list[int]] = {}

    def cells_of(self, r: dict) -> list[tuple[int, int]]:
        c = self.CELL
        return [(i, j) for i in range(r["x"] // c, (r["x"] + max(r["w"], 1) - 1) // c + 1) for j in range(r["y"] // c, (r["y"] + max(r["h"], 1) - 1) // c + 1)]

    def near(self, r: dict) -> list[dict]:
        """Kept regions that share a cell with r, in the order they were kept."""
        return [self.kept[i] for i in sorted({i for cell in self.cells_of(r) for i in self.cells.get(cell, ())})]

    def add(self, r: dict) -> None:
        for cell in self.cells_of(r):
            self.cells.setdefault(cell, []).append(len(self.kept))
        self.kept.append(r)


def shared_area(a: dict, b: dict) -> int:
    """The pixels two regions share: of their masks, if they have any, else of their boxes."""
    x0, y0 = max(a["x"], b["x"]), max(a["y"], b["y"])
    x1, y1 = min(a["x"] + a["w"], b["x"] + b["w"]), min(a["y"] + a["h"], b["y"] + b["h"])
    if x1 <= x0 or y1 <= y0:
        return 0
    if a["mask"] is None or b["mask"] is None:
        return (x1 - x0) * (y1 - y0)
    p, q = (r["mask"][y0 - r["y"] : y1 - r["y"], x0 - r["x"] : x1 - r["x"]] for r in (a, b))
    return int(np.count_nonzero((p > 0) & (q > 0)))


def consume(found: list[dict], iou: float = IOU, containment: float = CONTAINMENT) -> list[tuple[dict, dict | None, int]]:
    """(region, the kept region that consumes it, shared pixels), the largest first; a kept region has none.

    Regions have area, order (what decides between equal areas), x, y, w, h and
    mask or None.
    """
    keepers, out = Keepers(), []
    for r in sorted(found, key=lambda r: (-r["area"], r["order"])):
        by, both = None, 0
        for k in keepers.near(r):
            both = shared_area(r, k)
            if both and (both >= iou * (r["area"] + k["area"] - both) or both >= containment * min(r["area"], k["area"])):
                by = k
                break
        if by is None:
            keepers.add(r)
        out.append((r, by, both if by else 0))
    return out


#: The edge of a grid cell, in pixels, in which regions look for each other.
CELL = 64


def overlapping_pairs(regions: DataFrame) -> DataFrame:
    """Pairs of a frame's regions whose boxes meet, the earlier one (larger area, then smaller id, then uid) as k, the other as r, and the boxes' shared area.

    regions has frame_id, detection_id, uid, x, y, w, h and area.  A region is in all
    cells of a grid that it touches, and meets those in the same cells; the
    pair counts in the cell that holds the corner of what both share.
    """
    span = lambda at, size: F.sequence(F.expr(f"{at} div {CELL}"), F.expr(f"({at} + greatest({size}, 1) - 1) div {CELL}"))
    cells = regions.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))
    named = lambda n: cells.select("frame_id", "cx", "cy", *[F.col(c).alias(f"{n}_{c}") for c in ("detection_id", "uid", "x", "y", "w", "h", "area")])
    met = named("k").join(named("r"), ["frame_id", "cx", "cy"])
    left, top_ = F.greatest("k_x", "r_x"), F.greatest("k_y", "r_y")
    wide = F.least(F.col("k_x") + F.col("k_w"), F.col("r_x") + F.col("r_w")) - left
    high = F.least(F.col("k_y") + F.col("k_h"), F.col("r_y") + F.col("r_h")) - top_
    rank = lambda n: F.struct(-F.col(f"{n}_area"), f"{n}_detection_id", f"{n}_uid")
    earlier = rank("k") < rank("r")
    here = (F.floor(left / CELL) == F.col("cx")) & (F.floor(top_ / CELL) == F.col("cy"))
    return met.where(earlier & (wide > 0) & (high > 0) & here).withColumn("shared_area", (wide * high).cast("long")).drop("cx", "cy")


def with_mask_overlap(pairs: DataFrame, masks: DataFrame) -> DataFrame:
    """pairs with the pixels that both masks share in place of the boxes' shared area; masks has uid and mask."""
    own = lambda n: masks.select(F.col("uid").alias(f"{n}_uid"), F.col("mask").alias(f"{n}_mask"))
    both = pairs.join(own("k"), "k_uid").join(own("r"), "r_uid")

    @F.pandas_udf("long")
    def shared(rows: pd.DataFrame) -> pd.Series:
        out = []
        for row in rows.itertuples(index=False):
            r, k = ({"x": g("x"), "y": g("y"), "w": g("w"), "h": g("h"), "mask": np.asarray(g("mask")).reshape(g("h"), g("w"))} for g in (lambda c, n=n: getattr(row, f"{n}_{c}") for n in "rk"))
            out.append(shared_area(r, k))
        return pd.Series(out, dtype="int64")

    columns = [f"{n}_{c}" for n in "kr" for c in ("x", "y", "w", "h", "mask")]
    return both.withColumn("shared_area", shared(F.struct(*columns))).select(pairs.columns)


def first_keepers(conflicts: DataFrame) -> DataFrame:
    """The conflicts (pairs in which r cannot stay beside k) that consume: each region's with the earliest region that is not consumed itself.

    Sorted by region, all of a frame's earlier decisions are known when a pair
    is read: one pass over the pairs, holding one frame's consumed ids.
    """
    keys = ["frame_id", F.desc("r_area"), "r_detection_id", "r_uid", F.desc("k_area"), "k_detection_id", "k_uid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, gone = None, set()
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (f, k, r) in enumerate(zip(*(b.column(n).to_pylist() for n in ("frame_id", "k_uid", "r_uid")), strict=True)):
                if f != frame:
                    frame, gone = f, set()
                if r not in gone and k not in gone:
                    gone.add(r)
                    keep[i] = True
            yield b.filter(pa.array(keep))

    return conflicts.repartition("frame_id").sortWithinPartitions(*keys).mapInArrow(run, conflicts.schema)


def reconcile(rois: DataFrame, iou: float = IOU, containment: float = CONTAINMENT) -> DataFrame:
    """Larger regions of a frame consume those that overlap them substantially: frame_id, detection_id, keeper_id, consumed, and for a consumed one shared_area, iou, containment and keeper_containment.

    rois has boxes and may have mask, an array of bbox_w values a row; areas and
    overlaps are then the masks'.  Regions that meet no other stay in Spark;
    only pairs that are in conflict are decided one after the other.  Rows with
    the same id are regions of their own.
    """
    masked = "mask" in rois.columns
    area = F.size(F.filter("mask", lambda v: v > 0)) if masked else F.col("bbox_w") * F.col("bbox_h")
    if masked:
        area = F.coalesce(F.when(F.col("mask").isNotNull(), area), F.col("bbox_w") * F.col("bbox_h"))
    boxes_ = [F.col(f"bbox_{k}").alias(k) for k in "xywh"]
    numbered = rois.select("frame_id", F.col("detection_id").cast("string").alias("detection_id"), *boxes_, area.cast("long").alias("area"), *(["mask"] if masked else []))
    numbered = write_shared(numbered.withColumn("uid", F.monotonically_increasing_id()))
    regions = numbered.drop("mask")
    pairs = overlapping_pairs(regions)
    if masked:
        some = numbered.where("mask is not null").select("uid", "mask")
        there = lambda n: some.select(F.col("uid").alias(f"{n}_uid"), F.lit(True).alias(f"{n}_masked"))
        marked = pairs.join(there("k"), "k_uid", "left").join(there("r"), "r_uid", "left")
        both = F.coalesce(F.col("k_masked") & F.col("r_masked"), F.lit(False))
        pairs = marked.where(~both).select(pairs.columns).unionByName(with_mask_overlap(marked.where(both).select(pairs.columns), some))
    shared, union = F.col("shared_area"), F.col("k_area") + F.col("r_area") - F.col("shared_area")
    conflicts = pairs.where((shared > 0) & ((shared >= iou * union) | (shared >= containment * F.least("k_area", "r_area"))))
    found = first_keepers(conflicts.select("frame_id", "k_detection_id", "r_detection_id", "k_uid", "r_uid", "k_area", "r_area", "shared_area"))
    links = found.select(F.col("r_uid").alias("uid"), F.col("k_detection_id").alias("keeper"), "shared_area", (shared / union).alias("iou"), (shared / F.col("r_area")).alias("containment"), (shared / F.col("k_area")).alias("keeper_containment"))
    joined = regions.select("frame_id", "detection_id", "uid").join(links, "uid", "left")
    return joined.select("frame_id", "detection_id", F.coalesce("keeper", "detection_id").alias("keeper_id"), F.col("keeper").isNotNull().alias("consumed"), "shared_area", "iou", "containment", "keeper_containment")


def consumed_links(reconciled: DataFrame) -> DataFrame:
    """Each kept region with the ids it consumed, in order, their count, and each link with its measures."""
    link = F.struct(F.col("detection_id").alias("candidate_detection_id"), "shared_area", "iou", "containment", "keeper_containment")
    eaten = reconciled.groupBy("keeper_id").agg(F.sort_array(F.collect_list(F.when(F.col("consumed"), link))).alias("consumed"))
    return eaten.select("keeper_id", F.col("consumed.candidate_detection_id").alias("consumed_candidate_detection_ids"), F.size("consumed").alias("consumed_count"), "consumed")


def not_empty(refined: DataFrame) -> DataFrame:
    """Refined rows whose mask has any foreground."""
    return refined.where(F.exists("mask", lambda v: v > 0))


def storage_candidate_id(metadata: str = "metadata", own: str = "detection_id") -> Column:
    """The stored candidate that a refined row belongs to: a split child's parent, or its own."""
    at = lambda k: F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit(""))
    return F.coalesce(at("split_from_candidate_detection_id"), at("residual_parent_candidate_detection_id"), F.col(own).cast("string"))


def starts_of(length: int, tile: int, stride: int) -> list[int]:
    return [0] if length <= tile else sorted({*range(0, length - tile + 1, stride), length - tile})


def refine_once(roi: np.ndarray, mask: np.ndarray, model: Callable[[np.ndarray], np.ndarray], tile: int, overlap: float, threshold: float = 0.5) -> np.ndarray:
    """Overlapping tiles of two channels, image and mask, through the model; a pixel stays that half of its tiles vote for."""
    h, w = roi.shape
    stride = max(1, tile - round(tile * overlap))
    at = [(y, x) for y in starts_of(h, tile, stride) for x in starts_of(w, tile, stride)]
    image = roi / 255.0 if roi.max(initial=0) > 1 else roi.astype(np.float64)
    stack = np.zeros((len(at), tile, tile, 2))
    for n, (y, x) in enumerate(at):
        part = image[y : y + tile, x : x + tile]
        stack[n, : part.shape[0], : part.shape[1], 0] = np.nan_to_num(part)
        stack[n, : part.shape[0], : part.shape[1], 1] = mask[y : y + tile, x : x + tile] > 0
    out = np.asarray(model(stack))
    votes, seen = np.zeros((h, w)), np.zeros((h, w))
    for (y, x), p in zip(at, out, strict=True):
        own = (p > 0) if p.max(initial=0) > 1 else (p >= threshold)
        rows, columns = min(tile, h - y), min(tile, w - x)
        votes[y : y + rows, x : x + columns] += own[:rows, :columns]
        seen[y : y + rows, x : x + columns] += 1
    return np.where(votes >= 0.5 * seen, 255, 0)


def edges_of(mask: np.ndarray, crop: tuple[int, int, int, int], shape: tuple[int, int], margin: int = 1) -> dict[str, bool]:
    """The edges of the crop that the mask reaches and that are no edges of the frame."""
    on, (x, y, w, h) = mask > 0, crop
    return {"left": bool(on[:, :margin].any()) and x > 0, "right": bool(on[:, max(0, w - margin) :].any()) and x + w < shape[1], "top": bool(on[:margin].any()) and y > 0, "bottom": bool(on[max(0, h - margin) :].any()) and y + h < shape[0]}


def refine_growing(frame: np.ndarray, crop: tuple[int, int, int, int], mask: np.ndarray, model: Callable[[np.ndarray], np.ndarray], tile: int, overlap: float, by: int, times: int) -> tuple[np.ndarray, tuple[int, int, int, int], int, bool]:
    """Refine, and where the mask reaches an edge grow the crop and refine again, `times` at most: mask, crop, growths, whether it still reaches one."""
    growths, reaches = 0, False
    for _ in range(times):
        x, y, w, h = crop
        mask = refine_once(frame[y : y + h, x : x + w], mask, model, tile, overlap)
        touched = edges_of(mask, crop, frame.shape)
        reaches = any(touched.values())
        if not reaches:
            break
        x0, y0 = max(0, x - by) if touched["left"] else x, max(0, y - by) if touched["top"] else y
        x1 = min(frame.shape[1], x + w + by) if touched["right"] else x + w
        y1 = min(frame.shape[0], y + h + by) if touched["bottom"] else y + h
        grown = (x0, y0, x1 - x0, y1 - y0)
        if grown == crop:
            break
        mask, crop, growths = mask_in_crop(mask, (x, y), grown), grown, growths + 1
        reaches = any(edges_of(mask, crop, frame.shape).values())
    return mask, crop, growths, reaches


REFINED = "detection_id string, candidate_detection_id string, generation int, crop_bbox_x int, crop_bbox_y int, crop_bbox_w int, crop_bbox_h int, bbox_x int, bbox_y int, bbox_w int, bbox_h int, area long, major_axis_length double, minor_axis_length double, min_gray int, mean_gray double, growths int, touches_edge boolean, consumed_by string, consumed_ids array<string>, mask array<int>"


def refine_detections(frames: DataFrame, detections: DataFrame, model: Callable[[np.ndarray], np.ndarray], tile: int = 256, overlap: float = 0.25, expansion: int | None = None, iterations: int = 3, residual_generations: int = 1, residual_area: int = 1, reconcile_overlaps: bool = True) -> DataFrame:
    """Refine each frame's detections with the frame at hand: growth at touched edges, what is left over as split children, no empty rows, overlaps reconciled.

    detections has detection_id, frame_id, crop_bbox_* and mask, as wide as the
    crop.  A frame and its detections meet once, in one group of the size of
    the frame; children keep their parent's id as candidate_detection_id.
    Consumed rows carry their keeper in consumed_by, keepers what they consumed.
    """
    by = tile // 2 if expansion is None else expansion
    kinds = dict(frames.dtypes)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for f in left.to_pylist()[:1]:
            frame = np.array(f["pixels"]).reshape(f["height"], f["width"])
            todo = []
            for d in sorted(right.to_pylist(), key=lambda d: d["detection_id"]):
                crop = tuple(d[f"crop_bbox_{k}"] for k in "xywh")
                todo.append((d["detection_id"], d["detection_id"], 0, crop, np.array(d["mask"]).reshape(crop[3], crop[2])))
            while todo:
                own, parent, generation, crop, before = todo.pop(0)
                mask, grown, growths, reaches = refine_growing(frame, crop, before, model, tile, overlap, 0 if generation else by, iterations)
                left_over = (mask_in_crop(before, crop[:2], grown) > 0) & (mask == 0)
                out.append({"frame_id": f["frame_id"], "detection_id": own, "candidate_detection_id": parent, "generation": generation, "crop": grown, "mask": mask, "growths": growths, "touches_edge": reaches})
                if generation < residual_generations:
                    parts = label(left_over)
                    sizes = np.bincount(parts.reshape(-1))[1:]
                    children = [i for i, n in enumerate(sizes, 1) if n >= residual_area]
                    todo += [(f"{own}:residual:{generation + 1}:{k}", parent, generation + 1, grown, (parts == i) * 255) for k, i in enumerate(children, 1)]
            out = [r for r in out if (r["mask"] > 0).any()]
            for r in out:
                x, y, w, h = r["crop"]
                r |= {"x": x, "y": y, "w": w, "h": h, "area": int(np.count_nonzero(r["mask"])), "order": r["detection_id"], "id": r["detection_id"], "consumed_by": None, "consumed_ids": []}
            if reconcile_overlaps:
                for r, keeper, _ in consume(out):
                    if keeper is not None:
                        r["consumed_by"] = keeper["id"]
                        keeper["consumed_ids"].append(r["id"])
            for r in out:
                x, y, w, h = r["crop"]
                b = boxes((r["mask"] > 0).astype(np.int64))
                gray = frame[y : y + h, x : x + w][r["mask"] > 0]
                r |= {f"crop_bbox_{k}": v for k, v in zip("xywh", r["crop"], strict=True)}
                r |= {"bbox_x": x + int(b["bbox_x"][0]), "bbox_y": y + int(b["bbox_y"][0]), "bbox_w": int(b["bbox_w"][0]), "bbox_h": int(b["bbox_h"][0]), "major_axis_length": float(b["major_axis_length"][0]), "minor_axis_length": float(b["minor_axis_length"][0]), "min_gray": int(gray.min()), "mean_gray": float(gray.mean()), "mask": r["mask"].reshape(-1).tolist(), "consumed_ids": sorted(r["consumed_ids"])}
        return pa.Table.from_pylist([{n: r[n] for n in schema.names} for r in out], to_arrow_schema(schema))

    schema = T.StructType.fromDDL(f"frame_id {kinds['frame_id']}, {REFINED}")
    own = detections.select("frame_id", "detection_id", "crop_bbox_x", "crop_bbox_y", "crop_bbox_w", "crop_bbox_h", "mask")
    return frames.select("frame_id", "width", "height", "pixels").groupBy("frame_id").cogroup(own.groupBy("frame_id")).applyInArrow(work, schema)


def residual(candidate: DataFrame, refined: DataFrame) -> DataFrame:
    """Pixels of the candidate masks that no refined mask covers."""
    return candidate.join(refined, ["frame_id", "x", "y"], "left_anti")
