"""Column functions over the catalogue: times, boxes, edges, settings, metadata, summaries, and frame work with options."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import catalog as c
from framelake.operators import hooks
from framelake.operators import raster as r
from framelake.operators import refine
from framelake.operators import scalars as v
from framelake.operators import search as s
from framelake.sources import tables as t
from framelake.sources.wide import wide

from .register import query
from .twins import sql


@query(sql("select frame_id, case when frame_id % 4 > 0 then epoch_us(captured_at) + cast(round((frame_index - 1) * 1000000.0 / (frame_id % 4 * 8)) as bigint) end as micros from frames", "frames"))
def frame_timestamps(spark: SparkSession, d: str) -> DataFrame:
    x = t.frames(spark, d).withColumn("fps", (F.col("frame_id") % 4 * 8).cast("double"))
    return x.select("frame_id", F.unix_micros(v.frame_timestamp("captured_at", "fps", "frame_index")).alias("micros"))


@query(sql("""select detection_id, case when least(bbox_x + bbox_w, crop_bbox_x + crop_bbox_w) > greatest(bbox_x, crop_bbox_x) and least(bbox_y + bbox_h, crop_bbox_y + crop_bbox_h) > greatest(bbox_y, crop_bbox_y) then
(least(bbox_x + bbox_w, crop_bbox_x + crop_bbox_w) - greatest(bbox_x, crop_bbox_x)) || 'x' || (least(bbox_y + bbox_h, crop_bbox_y + crop_bbox_h) - greatest(bbox_y, crop_bbox_y)) end as overlap from w_detections where crop_bbox_x is not null""", "w_detections"))
def box_intersection(spark: SparkSession, d: str) -> DataFrame:
    boxes = [tuple(f"{p}bbox_{k}" for k in "xywh") for p in ("", "crop_")]
    x = wide(spark, d, "w_detections").where("crop_bbox_x is not null").withColumn("o", v.intersection(*boxes))
    return x.select("detection_id", F.concat(F.col("o.w").cast("string"), F.lit("x"), F.col("o.h").cast("string")).alias("overlap"))


PLACED = "with p as (select *, cast(frame_id % 3 as integer) as bx, cast(frame_id % 2 as integer) as oy, case when frame_id % 4 = 0 then 8 else 20 end as fw from pixels), "


@query(sql(PLACED + 'e as (select frame_id, any_value(bx) as bx, any_value(oy) as oy, any_value(fw) as fw, bool_or(v > 170 and x = 0) and any_value(bx) > 0 as "left", bool_or(v > 170 and x = 7) and any_value(bx) + 8 < any_value(fw) as "right", bool_or(v > 170 and y = 0) and any_value(oy) > 0 as top, bool_or(v > 170 and y = 7) and any_value(oy) + 8 < any_value(fw) as bottom from p group by 1) select frame_id, "left", "right", top, bottom, case when "left" then greatest(0, bx - 4) else bx end as x0, case when "right" then least(fw, bx + 12) else bx + 8 end as x1 from e', "pixels"))
def touched_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("frame_id")
    x = t.images(spark, d).withColumns({"mask": r.mask_above(F.lit(170)), "bx": (k % 3).cast("int"), "by": (k % 2).cast("int"), "bw": F.lit(8), "bh": F.lit(8), "fw": F.when(k % 4 == 0, 8).otherwise(20)})
    box = ("bx", "by", "bw", "bh")
    edges = v.touched_edges("mask", box, F.col("fw"), F.col("fw"))
    grown = v.expanded_box(box, edges, F.col("fw"), F.col("fw"), 4)
    return x.select("frame_id", *[e.alias(n) for n, e in edges.items()], grown["x"].alias("x0"), (grown["x"] + grown["w"]).alias("x1"))


@query(sql("select frame_id, coalesce(min(x) filter (where v > 165), 0) + 3 as x, coalesce(min(y) filter (where v > 165), 0) + 5 as y, coalesce(max(x) filter (where v > 165) - min(x) filter (where v > 165) + 1, 0) as w, coalesce(max(y) filter (where v > 165) - min(y) filter (where v > 165) + 1, 0) as h from pixels group by 1", "pixels"))
def mask_boxes(spark: SparkSession, d: str) -> DataFrame:
    x = t.images(spark, d).withColumns({"mask": r.mask_above(F.lit(165)), "bx": F.lit(3), "by": F.lit(5), "bw": F.lit(8), "bh": F.lit(8)})
    x = x.select("frame_id", v.mask_box("mask", ("bx", "by", "bw", "bh")).alias("b"))
    return x.select("frame_id", *[F.col(f"b.{k}").cast("long").alias(k) for k in "xywh"])


@query(sql("select detection_id, case when roi_index % 3 = 0 then 'raw' when bbox_w * bbox_h < 128 then 'png' else 'zstd' end as encoding, area >= 20000 and bbox_w >= 3 and bbox_w + bbox_h >= 12 as stored from detections", "detections"))
def roi_storage(spark: SparkSession, d: str) -> DataFrame:
    x = t.detections(spark, d)
    wanted = F.when(F.col("roi_index") % 3 == 0, "RAW").otherwise("auto")
    return x.select("detection_id", v.roi_encoding(F.col("bbox_w") * F.col("bbox_h"), wanted, 128).alias("encoding"), v.stores_payload("area", "bbox_w", "bbox_h", 20000, 3, least_sum=12).alias("stored"))


@query(sql("with g as (select frame_id, pixels[3 * i + 1] as b, pixels[3 * i + 2] as g, pixels[3 * i + 3] as r from images, unnest(generate_series(0, 20)) as u(i)) select frame_id, cast(sum(((3735 * b + 19235 * g + 9798 * r + 16384) >> 15)) as bigint) as total from g group by 1", "images"))
def gray_values(spark: SparkSession, d: str) -> DataFrame:
    x = t.images(spark, d).select("frame_id", F.slice("pixels", 1, 63).alias("data"))
    return x.select("frame_id", F.aggregate(v.gray_pixels("data", F.lit(3)), F.lit(0).cast("long"), lambda a, p: a + p).alias("total"))


@query(sql("with m as (select frame_id, min(v) as a, max(v) as b from pixels group by 1) select frame_id, cast(sum(case when b > a then round_even((v - a) * 255.0 / (b - a), 0) else 0 end) as bigint) as total, cast(sum(case when v > 128 then 255 else 0 end) as bigint) as binary from pixels join m using (frame_id) group by 1", "pixels"))
def scaled_values(spark: SparkSession, d: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, p: a + p)
    x = t.images(spark, d).withColumn("high", F.transform("pixels", lambda p: F.greatest(p - 128, F.lit(0))))
    return x.select("frame_id", total(v.to_bytes_range("pixels")).alias("total"), total(v.binary_mask("high")).alias("binary"))


@query("""with x as (select o_orderkey as id, '{"clerk":{"k":' || o_custkey || '},"price":' || o_totalprice || ',"n":null,"done":' || case when o_orderstatus = 'F' then 'true' else 'false' end || ',"tags":["' || o_orderpriority || '",1]}' as old,
  case when o_orderkey % 3 = 0 then '{"clerk":{"z":' || o_orderkey || '},"done":null,"price":' || o_orderkey || '}' when o_orderkey % 3 = 1 then '[1]' end as new from orders),
m as (select id, json_merge_patch(old, case when new like '{%' then new else '{}' end) as joined, old, new from x)
select id as frame_id, case when new like '{%' then (json_extract(new, '$.clerk.z'))::bigint else null end as z, case when new like '{%' then null else (json_extract(old, '$.clerk.k'))::bigint end as k,
  round((json_extract(joined, '$.price'))::double, 4) as price, (json_extract(joined, '$.done'))::boolean as done, json_extract(joined, '$.tags[1]')::bigint as one, json_type(joined, '$.tags') = 'ARRAY' as tags from m""")
def merged_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata with numbers, booleans, lists and nested objects under another, read back by their types; a nested object is replaced whole."""
    o = t.table(spark, d, "orders")
    k = F.col("o_orderkey")
    old = F.to_json(F.struct(F.struct(F.col("o_custkey").alias("k")).alias("clerk"), F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "F").alias("done")))
    old = F.concat(F.regexp_replace(old, r"\}$", ""), F.lit(',"n":null,"tags":["'), "o_orderpriority", F.lit('",1]}'))
    new = F.when(k % 3 == 0, F.concat(F.lit('{"clerk":{"z":'), k, F.lit('},"done":null,"price":'), k, F.lit("}"))).when(k % 3 == 1, "[1]")
    x = F.parse_json(v.merged_json(old, new))
    get = lambda path, kind: F.variant_get(x, path, kind)
    tags = F.schema_of_variant(get("$.tags", "variant")).startswith("ARRAY")
    return o.select(k.alias("frame_id"), get("$.clerk.z", "long").alias("z"), get("$.clerk.k", "long").alias("k"), F.round(get("$.price", "double"), 4).alias("price"), get("$.done", "boolean").alias("done"), get("$.tags[1]", "long").alias("one"), tags.alias("tags"))


SETTINGS = {"explicit": """case when o_orderkey % 7 = 0 then '{"frame":{"quality":' || o_orderkey % 50 || '}}' end""",
            "project": """case when o_orderkey % 5 < 3 then '{"frame":{"encoding":"' || o_orderpriority || '"},"roi":{"encoding":null}}' end""",
            "metadata": """case when o_orderkey % 3 = 0 then '{"frame":{"quality":1,"encoding":"old"}}' when o_orderkey % 3 = 1 then 'no object' end""",
            "default": """'{"frame":{"quality":90,"encoding":"raw"},"roi":{"encoding":"auto"}}'"""}


@query("with l as (select o_orderkey as job_id, " + ", ".join(f"{c} as l_{n}" for n, c in SETTINGS.items()) + """ from orders), x as (select * replace (case when l_metadata like '{%' then l_metadata end as l_metadata) from l)
select job_id, """ + ", ".join(
    f"coalesce({', '.join(f'json_extract_string(l_{n}, {chr(39)}$.{s}.{k}{chr(39)})' for n in SETTINGS)}) as {s}_{k}, case " + " ".join(f"when json_extract_string(l_{n}, '$.{s}.{k}') is not null then '{n}'" for n in SETTINGS) + f" end as {s}_{k}_source"
    for s, k in (("frame", "quality"), ("frame", "encoding"), ("roi", "encoding"))) + " from x")
def resolved_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings by section and key from four layers, each with the layer that it came from."""
    layers = [(n, F.expr(c)) for n, c in SETTINGS.items()]
    columns = v.resolved_sections(layers, {"frame": ["quality", "encoding"], "roi": ["encoding"]})
    x = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), *columns)
    return x.withColumns({c: F.regexp_replace(c, '^"|"$', "") for c in ("frame_encoding", "roi_encoding")})


@query("""select o_orderkey as job_id, case when o_orderkey % 2 = 0 then o_custkey else 80 end as quality, case when o_orderkey % 2 = 0 then 'png' else 'raw' end as encoding, case when o_orderkey % 3 = 0 then 'zstd' end as roi, o_orderkey as other, false as foreign_ from orders""")
def merged_project_settings(spark: SparkSession, d: str) -> DataFrame:
    """A patch goes into its section key by key; what else it has is left out."""
    k = F.col("o_orderkey")
    old = F.concat(F.lit('{"storage":{"frame":{"encoding":"raw","quality":80}},"other":'), k, F.lit("}"))
    frame = F.when(k % 2 == 0, F.concat(F.lit('"frame":{"quality":'), "o_custkey", F.lit(',"encoding":"png"}'))).otherwise('"frame":5')
    patch = F.concat(F.lit('{"foreign":1,"storage":{'), frame, F.when(k % 3 == 0, ',"roi":{"encoding":"zstd"}').otherwise(""), F.lit("}}"))
    x = F.parse_json(v.merged_settings(old, patch))
    get = lambda path, kind: F.variant_get(x, path, kind)
    return t.table(spark, d, "orders").select(k.alias("job_id"), get("$.storage.frame.quality", "long").alias("quality"), get("$.storage.frame.encoding", "string").alias("encoding"), get("$.storage.roi.encoding", "string").alias("roi"), get("$.other", "long").alias("other"), get("$.foreign", "long").isNotNull().alias("foreign_"))


@query(sql("select frame_id, case when min(asset_id) = max(asset_id) and count(asset_id) = count(*) then min(asset_id) end as asset_id, case when min(roi_index) = max(roi_index) then min(roi_index) end as roi_index from w_detections group by 1", "w_detections"))
def batch_attributes(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d, "w_detections").groupBy("frame_id").agg(v.only_value("asset_id").alias("asset_id"), v.only_value("roi_index").alias("roi_index"))


@query(sql("select frame_id, preprocessed_payload_ref is not null as has_preprocessed_payload, background_payload_ref is not null as has_background_payload, flatfield_profile is not null as has_flatfield_profile, case when flatfield_profile is null then 0 else 3 end as flatfield_profile_length from w_frames", "w_frames"))
def frame_summaries(spark: SparkSession, d: str) -> DataFrame:
    return v.frame_summary(wide(spark, d, "w_frames")).select("frame_id", "has_preprocessed_payload", "has_background_payload", "has_flatfield_profile", "flatfield_profile_length")


@query(sql("select detection_id, bbox_x || ',' || bbox_y || ',' || bbox_w || ',' || bbox_h as bbox, case when crop_bbox_x is not null then crop_bbox_x || ',' || crop_bbox_y || ',' || crop_bbox_w || ',' || crop_bbox_h end as crop_bbox from w_detections", "w_detections"))
def detection_summaries(spark: SparkSession, d: str) -> DataFrame:
    x = v.detection_summary(wide(spark, d, "w_detections"))
    text = lambda n: F.when(F.col(n).isNotNull(), F.concat_ws(",", *[F.col(f"{n}.{k}").cast("string") for k in "xywh"])).alias(n)
    return x.select("detection_id", text("bbox"), text("crop_bbox"))


@query(sql("select refined_id, case when frame_id % 2 = 0 then 'parent,' else '' end || candidate_detection_id || case when bbox_x % 2 = 0 then ',e1,e2' else '' end as ids, case when frame_id % 2 = 0 then 'parent' else candidate_detection_id end as stored_under from refined", "refined"))
def refined_candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("frame_id") % 2 == 0, "parent").otherwise("")
    eaten = F.when(F.col("bbox_x") % 2 == 0, F.array(F.lit("e1"), F.lit("e2"), F.lit("e1"), "candidate_detection_id")).otherwise(F.array().cast("array<string>"))
    x = t.refined(spark, d).withColumn("metadata", F.to_json(F.struct(split.alias("split_from_candidate_detection_id"), eaten.alias("consumed_candidate_detection_ids"))))
    return x.select("refined_id", F.array_join(v.candidate_ids("metadata", "candidate_detection_id"), ",").alias("ids"), refine.storage_candidate_id("metadata", "candidate_detection_id").alias("stored_under"))


@query("select o_orderkey as job_id, round(cast(100 * (o_orderkey % 97) as double) / nullif(o_orderkey % 4 * 50, 0), 6) as percent, round((o_orderkey % 97) / nullif(cast(o_orderkey % 5 as double), 0), 6) as units_per_second from orders")
def job_progress_record(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = t.table(spark, d, "orders").select(k.alias("job_id"), *v.progress(k % 97, k % 4 * 50, k % 5))
    return x.select("job_id", F.round("percent", 6).alias("percent"), F.round("units_per_second", 6).alias("units_per_second"))


@query(sql("select frame_id, string_agg(l, ',' order by n, l) as ids from (select frame_id, cast(bbox_w as varchar) as l, min(roi_index) as n from detections group by 1, 2) group by 1", "detections"))
def ordered_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    listed = t.detections(spark, d).groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("roi_index", F.col("bbox_w").cast("string").alias("l")))).alias("x"))
    return listed.select("frame_id", F.array_join(v.unique_ids(F.col("x.l")), ",").alias("ids"))


@query("select c_custkey as asset_id, case when c_custkey % 4 = 0 then 'none' else c_mktsegment || case when c_custkey % 3 = 0 then '|x' else '' end end as collections from customer")
def normalize_collection_lists(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    listed = F.when(k % 4 == 0, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit(""), F.col("c_mktsegment"), F.when(k % 3 == 0, "x ")))
    return t.table(spark, d, "customer").select(k.alias("asset_id"), F.array_join(c.normalize_list(listed), "|").alias("collections"))


@query(sql("select frame_id, cast(sum(case when x between 2 and 6 and y between 1 and 4 then v end) as bigint) as total, 5 as width, 4 as height, 2 as bbox_x, 1 as bbox_y, 'crop' as steps from pixels group by 1", "pixels"))
def crop_frames(spark: SparkSession, d: str) -> DataFrame:
    x = r.preprocess(t.images(spark, d), crop=(2, 1, 5, 4), invert_intensity=False)
    return x.select("frame_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p).alias("total"), "width", "height", "bbox_x", "bbox_y", "steps")


@query(sql("with f as (select frame_id, y, avg(v) as field from pixels group by 1, 2) select p.frame_id, cast(sum(case when field < 1 then 255 else trunc(least(255, p.v * 255 / field)) end) as bigint) as total from pixels p join f using (frame_id, y) group by 1", "pixels"))
def flatfield_stored_profile(spark: SparkSession, d: str) -> DataFrame:
    """Each frame over its own row means, as a stored profile."""
    i = t.images(spark, d)
    means = r.mean_profiles(i.select("frame_id", F.col("frame_id").alias("asset_id"), F.lit(0).cast("long").alias("frame_index"), "width", "height", "pixels"), 1, 1, axis=1).where("centre = 0")
    x = i.join(means.select(F.col("asset_id").alias("frame_id"), "profile"), "frame_id")
    return r.preprocess(x, invert_intensity=False, axis=1).select("frame_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p).alias("total"))


@query(sql("select frame_id, cast(sum(255 - trunc(least(255, v * 255 / 150.0))) as bigint) as total, 'background_correction,invert_intensity' as steps from pixels group by 1", "pixels"))
def scalar_background(spark: SparkSession, d: str) -> DataFrame:
    x = r.preprocess(t.images(spark, d).withColumn("background_level", F.lit(150.0)))
    return x.select("frame_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p).alias("total"), "steps")


@query(sql("select p.frame_id, cast(sum(case when q.v < 1 then 255 else trunc(least(255, p.v * 255 / q.v)) end) as bigint) as total from pixels p join pixels q on q.frame_id = p.frame_id and q.pos = p.pos where p.x < 5 and p.y < 6 group by 1", "pixels"))
def fitted_background(spark: SparkSession, d: str) -> DataFrame:
    """A smaller frame over the upper left part of a whole one's pixels."""
    i = t.images(spark, d).withColumnsRenamed({"pixels": "background", "width": "background_width"}).drop("height")
    small = r.preprocess(t.images(spark, d), crop=(0, 0, 5, 6), invert_intensity=False)
    x = r.preprocess(small.join(i.select("frame_id", "background", "background_width"), "frame_id"), invert_intensity=False)
    return x.select("frame_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p).alias("total"))


DISPATCH = {"manual": {"threshold": 150}, "percentile_background": {"percentile": 60, "min_contrast": 15}, "adaptive_mean": {"block_size": 3, "c": 5}, "sobel": {"threshold": 150}}


@query(sql("""with near as (select p.frame_id, p.pos, p.v, q.v as u, m.v as mirrored, o.dx, o.dy from pixels p cross join (select a.i as dx, b.i as dy from (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(i)) o join pixels q on q.frame_id = p.frame_id and q.x = least(greatest(p.x + o.dx, 0), 7) and q.y = least(greatest(p.y + o.dy, 0), 7) join pixels m on m.frame_id = p.frame_id and m.x = 7 - abs(7 - abs(p.x + o.dx)) and m.y = 7 - abs(7 - abs(p.y + o.dy))),
n as (select frame_id, pos, v, floor(sum(u) / 9.0 + 0.5) - 5 as level, sum(mirrored * dx * (2 - abs(dy))) as gx, sum(mirrored * dy * (2 - abs(dx))) as gy from near group by 1, 2, 3), q as (select frame_id, least(255, quantile_cont(v, 0.6) + 15) as level from pixels group by 1),
m as (select frame_id, v > 150 as manual, v > q.level as percentile_background, v > n.level as adaptive_mean, gx * gx + gy * gy >= 22500 as sobel from n join q using (frame_id))
unpivot (select frame_id, cast(count(*) filter (where manual) as integer) as manual, cast(count(*) filter (where percentile_background) as integer) as percentile_background, cast(count(*) filter (where adaptive_mean) as integer) as adaptive_mean, cast(count(*) filter (where sobel) as integer) as sobel,
cast(count(*) filter (where manual or sobel) as integer) as manual_or_sobel from m group by 1) on columns(* exclude frame_id) into name method value foreground""", "pixels"))
def threshold_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """One pass for each method by its name, and two of them joined."""
    finders = {n: r.thresholder(n, **o) for n, o in DISPATCH.items()}
    finders["manual_or_sobel"] = r.thresholder(lambda a: np.maximum(finders["manual"](a), finders["sobel"](a)))
    rows = lambda f: [(f["frame_id"], n, int(np.count_nonzero(find(f["pixels"])))) for n, find in finders.items()]
    return r.frame_rows(t.images(spark, d).select("frame_id", "width", "height", "pixels"), rows, "frame_id long, method string, foreground int")


@query(sql("with g as (select frame_id, pos, sum(u * dx * (2 - abs(dy))) as gx, sum(u * dy * (2 - abs(dx))) as gy from (select p.frame_id, p.pos, o.dx, o.dy, q.v as u from pixels p cross join (select a.i as dx, b.i as dy from (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(i)) o join pixels q on q.frame_id = p.frame_id and q.x = 7 - abs(7 - abs(p.x + o.dx)) and q.y = 7 - abs(7 - abs(p.y + o.dy))) group by 1, 2), l as (select frame_id, quantile_cont(sqrt(gx * gx + gy * gy), 0.75) as level from g group by 1) select frame_id, cast(count(*) filter (where sqrt(gx * gx + gy * gy) >= level) as integer) as foreground from g join l using (frame_id) group by 1", "pixels"))
def sobel_percentile(spark: SparkSession, d: str) -> DataFrame:
    x = r.per_frame(t.images(spark, d), r.sobel(percentile=75))
    return x.select("frame_id", F.size(F.filter("mask", lambda p: p > 0)).alias("foreground"))


@query(sql("select frame_id, '8,8' as shape, 64 as bytes, cast(sum(v * (pos + 1)) as bigint) as checksum from pixels group by 1", "pixels"))
def packed_arrays(spark: SparkSession, d: str) -> DataFrame:
    packed = r.pack_arrays(t.images(spark, d))
    checksum = F.aggregate(F.transform("pixels", lambda p, i: p.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, p: a + p)
    back = r.unpack_arrays(packed, "int").select("frame_id", checksum.alias("checksum"))
    return packed.select("frame_id", F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"), F.octet_length("payload").alias("bytes")).join(back, "frame_id")


TYPED = "with f as (select vec_id as frame_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)"


@query(TYPED + """, m as (select frame_id, max(v) as top, min(v) as low from f group by 1)
select f.frame_id, round(sum(cast(cast(top - v as float) as double) * i), 3) as inverted, cast(count(*) filter (where trunc((cast(v as double) - low) * 255.0 / (cast(top as double) - low)) > 128) as integer) as foreground from f join m using (frame_id) group by 1""")
def float_frames(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as 8 x 8 frames of float32: inverted by their own largest value, and thresholded as stretched bytes."""
    e = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.lit(0).alias("asset_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").alias("pixels"))
    x = r.with_data(e, "float32")
    turned = r.values(r.preprocess(x).select("frame_id", "data"), "float")
    weighted = F.aggregate(F.transform("pixels", lambda p, i: p.cast("double") * (i + 1)), F.lit(0.0), lambda a, p: a + p)
    found = r.per_frame(x, r.thresholder("manual", threshold=128)).select("frame_id", F.size(F.filter("mask", lambda p: p > 0)).alias("foreground"))
    return turned.select("frame_id", F.round(weighted, 3).alias("inverted")).join(found, "frame_id")


@query(TYPED + """, w as (select frame_id, i, cast(floor(greatest(least(cast(v as double), 1), -1) * 20000 + 30000) as bigint) as v from f)
select frame_id, cast(sum(i * (65535 - trunc(least(65535, v * 255 / 100.0)))) as bigint) as checksum, 'uint16' as dtype from w group by 1""")
def wide_frames(spark: SparkSession, d: str) -> DataFrame:
    """16-bit frames over a scalar background, cut at their type's largest value, and inverted by it."""
    level = lambda x: F.floor(F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * 20000 + 30000).cast("int")
    e = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", level).alias("pixels"), F.lit(100.0).alias("background_level"))
    x = r.preprocess(r.with_data(e, "uint16"))
    whole = r.values(x.select("frame_id", "data"), "int")
    checksum = F.aggregate(F.transform("pixels", lambda p, i: p.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, p: a + p)
    return whole.select("frame_id", checksum.alias("checksum")).join(x.select("frame_id", "data.dtype"), "frame_id")


@query(sql("with p as (select frame_id, stage, o_custkey from (select o_orderkey as frame_id, case when o_orderkey % 3 = 0 then 'segment' when o_orderkey % 3 = 1 then 'ingest' else 'publish' end as stage, o_custkey from orders)) select frame_id, stage, case when stage = 'segment' then o_custkey * 2 else o_custkey + 1 end as result from p where stage <> 'publish'"))
def stage_routines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    jobs = t.table(spark, d, "orders").select(k.alias("frame_id"), F.when(k % 3 == 0, "segment").when(k % 3 == 1, "ingest").otherwise("publish").alias("stage"), "o_custkey")
    stages = hooks.Stages()
    stages.register("segment")(lambda x: x.withColumn("result", F.col("o_custkey") * 2))
    stages.register("ingest")(lambda x: x.withColumn("result", F.col("o_custkey") + 1))
    return stages.run_jobs(jobs).select("frame_id", "stage", "result")


@query(sql("with f as (select frame_id, pixels[1] / 255.0 as a, pixels[2] / 255.0 as b, pixels[3] / 255.0 as c from images) select cast(frame_id as varchar) as detection_id, 'm1' as model_id, case when a >= b and a >= c then 'copepod' when b >= c then 'diatom' else 'detritus' end as label, round(greatest(a, b, c), 9) as score, round(c, 9) as detritus from f", "images"))
def classify_detections(spark: SparkSession, d: str) -> DataFrame:
    x = t.images(spark, d).select(F.col("frame_id").cast("string").alias("detection_id"), F.transform(F.slice("pixels", 1, 3), lambda p: p / 255.0).alias("features"))
    y = hooks.classify(x, lambda features: features, ["copepod", "diatom", "detritus"], "m1")
    return y.select("detection_id", "model_id", "label", F.round("score", 9).alias("score"), F.round(F.col("scores")["detritus"], 9).alias("detritus"))


@query(sql("select count(*) as frames, count(*) filter (where n > 0) as frames_with_detections, cast(sum(area) as bigint) as foreground_pixels from (select frame_id, count(*) filter (where 255 - v > 150) as n, count(*) filter (where 255 - v > 150) as area from pixels group by 1)", "pixels"))
def segment_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    i = t.images(spark, d)
    return r.stage_counts(i, r.segment(i, "manual", {"threshold": 150}, padding=1)).drop("detections")


@query(sql("select frame_id, cast(least(1, count(*)) as bigint) as shown from pixels where v > 150 group by 1", "pixels"))
def segment_preview(spark: SparkSession, d: str) -> DataFrame:
    """At most one detection a frame, of frames that are preprocessed."""
    x = r.segment_preview(t.images(spark, d), 1, method="manual", options={"threshold": 150}, preprocessed=True)
    return x.groupBy("frame_id").agg(F.count("*").alias("shown"))


@query(sql("with p as (select frame_id, pos, x, y, v from pixels where v >= 0.6 * 255) select frame_id, count(*) as area, min(x) as bbox_x, min(y) as bbox_y, max(x) - min(x) + 1 as bbox_w, max(y) - min(y) + 1 as bbox_h, min(v) as min_gray, round(avg(v), 6) as mean_gray from p group by 1", "pixels"))
def refine_whole_frames(spark: SparkSession, d: str) -> DataFrame:
    """One candidate of each whole frame, refined by a level in overlapping tiles."""
    i = t.images(spark, d)
    whole = i.select("frame_id", F.col("frame_id").cast("string").alias("detection_id"), F.lit(0).alias("crop_bbox_x"), F.lit(0).alias("crop_bbox_y"), F.lit(8).alias("crop_bbox_w"), F.lit(8).alias("crop_bbox_h"), F.array_repeat(F.lit(0), 64).alias("mask"))
    x = refine.refine_detections(i, whole, lambda s_: (s_[..., 0] >= 0.6) * 1.0, 4, 0.5)
    boxes = [F.col(k).cast("long").alias(k) for k in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")]
    return x.select("frame_id", "area", *boxes, "min_gray", F.round("mean_gray", 6).alias("mean_gray"))


@query(sql("select frame_id from frames where frame_index = 2 and asset_id in (select asset_id from assets where kind = 'BUILDING')", "frames", "assets"))
def frames_of_assets(spark: SparkSession, d: str) -> DataFrame:
    wanted = c.search(t.assets(spark, d), {"kind": "BUILDING"}).select("asset_id")
    return s.lookup_many(s.lookup(t.frames(spark, d), frame_index=2), wanted, ["asset_id"]).select("frame_id")
