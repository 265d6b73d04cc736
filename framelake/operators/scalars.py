"""Column functions: times, boxes, masks' edges, settings, metadata, summaries and progress."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame_timestamp(start: Column | str, fps: Column | str, number: Column | str) -> Column:
    """start plus (number - 1) / fps seconds, to the microsecond; null without a start or a positive rate."""
    start, fps, number = _c(start), _c(fps), _c(number)
    micros = F.round((number - 1) * 1e6 / fps).cast("long")
    return F.when(start.isNotNull() & (fps > 0), F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + micros))


def intersection(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """The overlap of two boxes (x, y, w, h) as a struct; null if they do not meet."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = ([F.col(c) for c in box] for box in (a, b))
    x, y = F.greatest(ax, bx), F.greatest(ay, by)
    w, h = F.least(ax + aw, bx + bw) - x, F.least(ay + ah, by + bh) - y
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def touched_edges(mask: str, box: tuple[str, str, str, str], frame_width: Column, frame_height: Column, margin: int = 1) -> dict[str, Column]:
    """Whether a mask (row by row, as wide as its box) reaches an edge of its box that is no edge of the frame."""
    x, y, w, h = (F.col(c) for c in box)
    m, indexed = max(1, margin), F.transform(mask, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    any_ = lambda test: F.exists(indexed, lambda e: (e["v"] > 0) & test(e["i"]))
    row = lambda i: F.floor(i / w)
    return {
        "left": any_(lambda i: i % w < m) & (x > 0),
        "right": any_(lambda i: i % w >= w - m) & (x + w < frame_width),
        "top": any_(lambda i: row(i) < m) & (y > 0),
        "bottom": any_(lambda i: row(i) >= h - m) & (y + h < frame_height),
    }


def expanded_box(box: tuple[str, str, str, str], touched: dict[str, Column], frame_width: Column, frame_height: Column, by: int) -> dict[str, Column]:
    """The box grown on its touched sides, cut to the frame."""
    x, y, w, h = (F.col(c) for c in box)
    x0 = F.when(touched["left"], F.greatest(F.lit(0), x - by)).otherwise(x)
    y0 = F.when(touched["top"], F.greatest(F.lit(0), y - by)).otherwise(y)
    x1 = F.when(touched["right"], F.least(frame_width, x + w + by)).otherwise(x + w)
    y1 = F.when(touched["bottom"], F.least(frame_height, y + h + by)).otherwise(y + h)
    return {"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0}


def mask_box(mask: str, box: tuple[str, str, str, str]) -> Column:
    """The mask's foreground as a box of the frame; of an empty mask the box's corner, without size."""
    x, y, w, _ = (F.col(c) for c in box)
    on = F.filter(F.transform(mask, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(on, lambda i: i % w), F.transform(on, lambda i: F.floor(i / w).cast("int"))
    full = F.struct((x + F.array_min(xs)).alias("x"), (y + F.array_min(ys)).alias("y"), (F.array_max(xs) - F.array_min(xs) + 1).alias("w"), (F.array_max(ys) - F.array_min(ys) + 1).alias("h"))
    return F.when(F.size(on) > 0, full).otherwise(F.struct(x.alias("x"), y.alias("y"), F.lit(0).alias("w"), F.lit(0).alias("h")))


def roi_encoding(n_bytes: Column | str, wanted: Column | str | None = None, small: int = 4096) -> Column:
    """What a region's pixels are stored as: the wanted encoding, or by size where that is auto."""
    wanted = F.lit("auto") if wanted is None else F.lower(_c(wanted))
    return F.when(wanted != "auto", wanted).when(_c(n_bytes) < small, "png").otherwise("zstd")


#: Weights of blue, green and red in 1 / 2**15, fixed values.
GRAY_WEIGHTS, GRAY_BITS = (3735, 19235, 9798), 15


def gray(blue: Column | str, green: Column | str, red: Column | str) -> Column:
    """Gray value of blue, green and red bytes, rounded in fixed point."""
    weighted = sum(F.lit(w) * _c(c) for w, c in zip(GRAY_WEIGHTS, (blue, green, red), strict=True))
    return F.shiftright((weighted + (1 << (GRAY_BITS - 1))).cast("int"), GRAY_BITS)


def gray_pixels(data: str, channels: Column | str) -> Column:
    """Gray pixels of interleaved values: one channel as it is, three or four as blue, green, red and what is left out."""
    n = _c(channels)
    at = lambda i, k: F.get(data, (i * n + k).cast("int"))
    size = (F.size(data) / n).cast("int")
    return F.when(n == 1, F.col(data)).otherwise(F.transform(F.sequence(F.lit(0), size - 1), lambda i: gray(at(i, 0), at(i, 1), at(i, 2))))


def to_bytes_range(pixels: str) -> Column:
    """Any values scaled to 0..255 by their least and largest; all 0 where these are equal."""
    low, high = F.array_min(pixels), F.array_max(pixels)
    return F.when(high > low, F.transform(pixels, lambda v: F.rint((v - low) * 255.0 / (high - low)).cast("int"))).otherwise(F.transform(pixels, lambda v: F.lit(0)))


def binary_mask(mask: str) -> Column:
    return F.transform(mask, lambda v: F.when(v > 0, 255).otherwise(0))


def json_object(text: Column | str) -> Column:
    """A JSON object's members by name, with their types; empty for what is no object."""
    found = F.try_variant_get(F.try_parse_json(_c(text)), "$", "map<string,variant>")
    return F.coalesce(found, F.create_map().cast("map<string,variant>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _over(low: Column, high: Column) -> Column:
    return _let(high, lambda h: F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(h, k)), h))


def _text(members: Column, strip_nulls: bool) -> Column:
    return F.to_json(F.to_variant_object(F.map_filter(members, lambda k, v: ~F.is_variant_null(v)) if strip_nulls else members))


def merged_json(*texts: Column | str, strip_nulls: bool = True) -> Column:
    """JSON objects merged, a later member in place of an earlier one, whole; keys in order.  Numbers, booleans and nested values keep their types."""
    return _text(functools.reduce(_over, map(json_object, texts)), strip_nulls)


def member(members: Column, *path: str) -> Column:
    """A nested object's members, empty where there is none."""
    for name in path:
        members = F.coalesce(F.try_variant_get(members[name], "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return members


def merged_settings(existing: Column | str, patch: Column | str, root: str = "storage", sections: tuple[str, ...] = ("frame", "roi")) -> Column:
    """Settings with a patch merged into their sections, key by key; other members stay, and a patch's other members are left out."""
    kind = "map<string,variant>"

    def merged(old: Column, new: Column) -> Column:
        def own(want: Column, name: str) -> Callable[[Column], Column]:
            section = lambda have: F.create_map(F.lit(name), F.to_variant_object(_over(member(have, name), member(want, name))))
            return lambda have: F.when(F.try_variant_get(want[name], "$", kind).isNotNull(), _over(have, section(have))).otherwise(have)

        def patched(want: Column) -> Column:
            have = member(old, root)
            for name in sections:
                have = _let(have, own(want, name))
            return _over(old, F.create_map(F.lit(root), F.to_variant_object(have)))

        return _let(F.try_variant_get(new[root], "$", kind), lambda want: F.when(want.isNotNull(), patched(want)).otherwise(old))

    return _text(_let(json_object(existing), lambda old: _let(json_object(patch), lambda new: merged(old, new))), False)


def resolved_sections(layers: list[tuple[str, Column]], keys: dict[str, list[str]]) -> list[Column]:
    """For each section and key the first layer's value that is there and no null, as JSON text, and that layer's name: columns <section>_<key> and <section>_<key>_source.

    Layers are names and JSON texts of objects of sections, the first one before the others.
    """
    out = []
    for section, names in keys.items():
        for key in names:
            own = [(name, member(json_object(text), section)[key]) for name, text in layers]
            there = [(name, F.when(~F.is_variant_null(value), value)) for name, value in own]
            out.append(F.to_json(F.coalesce(*[v for _, v in there])).alias(f"{section}_{key}"))
            out.append(F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for name, v in there]).alias(f"{section}_{key}_source"))
    return out


def setting(explicit: Column, project: Column, legacy: Column, default: Column) -> tuple[Column, Column]:
    """The first of an explicit value, the project's, its older metadata's and the default; and where it came from."""
    source = F.when(explicit.isNotNull(), "explicit").when(project.isNotNull(), "project").when(legacy.isNotNull(), "metadata").otherwise("default")
    return F.coalesce(explicit, project, legacy, default), source


def only_value(column: Column | str) -> Column:
    """An aggregate: a group's one value, null where it has several or none."""
    c = _c(column)
    return F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c))


def frame_summary(frames: DataFrame) -> DataFrame:
    """Frames without their profile: what they have, and the profile's length."""
    profile = F.coalesce(F.size("flatfield_profile"), F.lit(0))
    n = F.when(profile > 0, profile).otherwise(0)
    flags = [F.col("preprocessed_payload_ref").isNotNull().alias("has_preprocessed_payload"), F.col("background_payload_ref").isNotNull().alias("has_background_payload"), (n > 0).alias("has_flatfield_profile"), n.alias("flatfield_profile_length")]
    return frames.select(*[c for c in frames.columns if c != "flatfield_profile"], *flags)


def detection_summary(detections: DataFrame) -> DataFrame:
    """Detections without payloads, their boxes as structs, null unless all four values are there."""

    def box(prefix: str) -> Column:
        parts = [f"{prefix}_{p}" for p in "xywh"]
        whole = F.lit(True)
        for p in parts:
            whole = whole & F.col(p).isNotNull()
        return F.when(whole, F.struct(*[F.col(p).alias(p[-1]) for p in parts])).alias(prefix)

    gone = ("roi_payload", "mask_payload")
    return detections.select(*[c for c in detections.columns if c not in gone], box("bbox"), box("crop_bbox"))


def candidate_ids(metadata: Column | str, candidate: Column | str) -> Column:
    """The candidates behind a refined row: the primary one, its own and those it consumed, each once, in that order."""
    at = lambda k: F.nullif(F.get_json_object(_c(metadata), f"$.{k}"), F.lit(""))
    own = _c(candidate).cast("string")
    primary = F.coalesce(at("split_from_candidate_detection_id"), at("primary_candidate_detection_id"), own)
    listed = at("consumed_candidate_detection_ids")
    eaten = F.when(listed.startswith("["), F.from_json(listed, "array<string>")).when(listed.isNotNull(), F.array(listed))
    every = F.concat(F.array(primary, own), F.coalesce(eaten, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def progress(done: Column | str, total: Column | str, seconds: Column | str) -> list[Column]:
    """percent and units_per_second; null on a total or a time of zero."""
    done, total, seconds = _c(done), _c(total), _c(seconds)
    return [F.when(total > 0, 100.0 * done / total).alias("percent"), F.when(seconds > 0, done / seconds).alias("units_per_second")]


def unique_ids(ids: Column | str) -> Column:
    """A list's values, the first of equal ones, without nulls."""
    return F.array_distinct(F.array_compact(_c(ids)))


def stores_payload(area: Column | str, width: Column | str, height: Column | str, least_area: float | None = None, least_width: int | None = None, least_height: int | None = None, least_sum: int | None = None) -> Column:
    """Whether a region is big enough to keep its pixels."""
    out = F.lit(True)
    for c, least in ((area, least_area), (width, least_width), (height, least_height), (_c(width) + _c(height), least_sum)):
        if least is not None:
            out = out & (_c(c) >= least)
    return out
