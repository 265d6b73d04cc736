"""Frame-work queries over 8 x 8 images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import raster as r
from framelake.operators import refine
from framelake.sources import tables as t

from .register import query
from .twins import sql

MASK_ROWS = "select frame_id, cast(count(*) filter (where v > {0}) as integer) as foreground from {1} group by 1"


def foreground(df: DataFrame, column: str = "mask") -> DataFrame:
    return df.select("frame_id", F.size(F.filter(column, lambda v: v > 0)).alias("foreground"))


def exploded(df: DataFrame) -> DataFrame:
    return df.select("frame_id", F.posexplode("pixels").alias("pos", "v")).select("frame_id", F.col("pos").cast("long").alias("pos"), "v")


@query(sql("select frame_id, cast(count(*) filter (where v > 140) as integer) as foreground from pixels group by 1", "pixels"))
def mask_manual(spark: SparkSession, d: str) -> DataFrame:
    return foreground(t.images(spark, d).withColumn("mask", r.mask_above(F.lit(140))))


OTSU = """with h as (select frame_id, v, count(*) as n from pixels group by 1, 2),
c as (select frame_id, v, sum(n) over w as n0, sum(n * v) over w as s0, sum(n) over (partition by frame_id) as n1, sum(n * v) over (partition by frame_id) as s1 from h window w as (partition by frame_id order by v rows between unbounded preceding and current row)),
o as (select frame_id, cast(v as double) as threshold from (select *, row_number() over (partition by frame_id order by between_ desc, v) as rn from (select *, case when n0 < n1 then cast((s0 * n1 - s1 * n0) as double) * cast((s0 * n1 - s1 * n0) as double) / cast(n0 * (n1 - n0) as double) else 0 end as between_ from c)) where rn = 1)"""


@query(sql(OTSU + " select * from o", "pixels"))
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return r.otsu(t.images(spark, d))


@query(sql(OTSU + """, m as (select frame_id, median(v) as b from pixels group by 1), l as (select frame_id, case when threshold - b < 30 then least(255, b + 30) else threshold end as level from o join m using (frame_id))
select frame_id, cast(case when count(*) filter (where v > level) > 0.3 * 64 then 0 else count(*) filter (where v > level) end as integer) as foreground from pixels join l using (frame_id) group by 1""", "pixels"))
def bounded_otsu(spark: SparkSession, d: str) -> DataFrame:
    return foreground(r.bounded_otsu(t.images(spark, d), 30, 0.3))


@query(sql("with q as (select frame_id, least(255, quantile_cont(v, 0.6) + 15) as level from pixels group by 1) select frame_id, round(level, 6) as threshold, cast(count(*) filter (where v > level) as integer) as foreground from pixels join q using (frame_id) group by 1, 2", "pixels"))
def percentile_threshold(spark: SparkSession, d: str) -> DataFrame:
    return r.percentile_background(t.images(spark, d), 0.6, 15).select("frame_id", F.round("threshold", 6).alias("threshold"), F.size(F.filter("mask", lambda v: v > 0)).alias("foreground"))


@query(sql("select frame_id, cast(count(*) filter (where v > 150 or v < 110) as integer) as either, cast(count(*) filter (where v > 150 and x < 4) as integer) as both from pixels group by 1", "pixels"))
def mask_ensemble(spark: SparkSession, d: str) -> DataFrame:
    i = t.images(spark, d).withColumns({"a": r.mask_above(F.lit(150)), "b": F.transform("pixels", lambda v: F.when(v < 110, 255).otherwise(0)), "c": F.transform("pixels", lambda v, k: F.when(k % F.col("width") < 4, 255).otherwise(0))})
    n = lambda c: F.size(F.filter(c, lambda v: v > 0))
    return i.select("frame_id", n(F.zip_with("a", "b", lambda p, q: F.greatest(p, q))).alias("either"), n(F.zip_with("a", "c", lambda p, q: F.least(p, q))).alias("both"))


@query(sql("with f as (select frame_id, x, quantile_cont(v, 0.5) as field from pixels group by 1, 2) select p.frame_id, p.pos, cast(case when field < 1 then 255 else trunc(least(255, p.v * 255 / field)) end as integer) as v from pixels p join f using (frame_id, x)", "pixels"))
def flatfield_quantile(spark: SparkSession, d: str) -> DataFrame:
    return exploded(r.flatfield(t.images(spark, d), 0.5))


CENTRES = "with fed as (select asset_id, frame_id, frame_index, pos, x, v, unnest(generate_series(greatest(cast(ceil((frame_index - {1} / 2.0) / {0}) as bigint), 0), cast(floor((frame_index + {1} / 2.0) / {0}) as bigint))) * {0} as centre from pixels)"
MEANS = CENTRES.format(25, 51) + ", m as (select asset_id, centre, pos, cast(round_even(avg(v), 0) as integer) as background, count(*) as frames from fed group by 1, 2, 3)"


@query(sql(MEANS + " select * from m", "pixels"))
def mean_background_windows(spark: SparkSession, d: str) -> DataFrame:
    return r.mean_fields(t.images(spark, d), 25, 51).withColumn("pos", F.col("pos").cast("long"))


@query(sql(CENTRES.format(15, 15) + " select asset_id, centre, x, round(sum(v) / count(*), 6) as profile from fed group by 1, 2, 3", "pixels"))
def flatfield_profiles(spark: SparkSession, d: str) -> DataFrame:
    return r.profiles(t.images(spark, d), 15, 15).select("asset_id", "centre", F.col("x").cast("long").alias("x"), F.round("profile", 6).alias("profile"))


@query(sql(MEANS + """ select p.frame_id, p.pos, cast(case when background < 1 then 255 else trunc(least(255, p.v * 255 / background)) end as integer) as v from pixels p join m on m.asset_id = p.asset_id and m.pos = p.pos and m.centre = (p.frame_index + 12) // 25 * 25""", "pixels"))
def background_divide(spark: SparkSession, d: str) -> DataFrame:
    i = t.images(spark, d)
    return exploded(r.preprocess(r.with_backgrounds(i, r.mean_backgrounds(i, 25, 51), 25).where("background is not null"), invert_intensity=False))


@query(sql(MEANS + """ select i.frame_id, i.asset_id, (i.frame_index + 12) // 25 * 25 as centre, exists (select 1 from m where m.asset_id = i.asset_id and m.centre = (i.frame_index + 12) // 25 * 25) as has_window from images i""", "pixels", "images"))
def window_assignment(spark: SparkSession, d: str) -> DataFrame:
    i = t.images(spark, d)
    return r.window_assignment(i, r.mean_backgrounds(i, 25, 51), 25).select("frame_id", "asset_id", "centre", "has_window")


@query(sql("select frame_id, cast(sum(255 - case when x between 1 and 6 and y between 1 and 5 then v else 128 end) as bigint) as total from pixels group by 1", "pixels"))
def invert_crop_mask(spark: SparkSession, d: str) -> DataFrame:
    i = r.crop_mask(t.images(spark, d), 1, 1, 7, 6, 128).withColumn("pixels", r.invert())
    return i.select("frame_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(sql(MEANS + """ select p.frame_id, cast(sum(255 - case when background is null then p.v when background < 1 then 255 else cast(trunc(least(255, p.v * 255 / background)) as integer) end) as bigint) as total, case when bool_or(background is not null) then 'background_correction,invert_intensity' else 'invert_intensity' end as steps from pixels p left join m on m.asset_id = p.asset_id and m.pos = p.pos and m.centre = (p.frame_index + 12) // 25 * 25 and p.frame_index % 2 = 0 group by 1""", "pixels"))
def preprocess_chain(spark: SparkSession, d: str) -> DataFrame:
    i = t.images(spark, d)
    even = r.with_backgrounds(i, r.mean_backgrounds(i, 25, 51), 25).withColumn("background", F.when(F.col("frame_index") % 2 == 0, F.col("background")))
    return r.preprocess(even).select("frame_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), "steps")


@query(sql("select frame_id, cast(x // 4 as integer) as px, cast(y // 4 as integer) as py, round(avg(v), 6) as v from pixels group by 1, 2, 3", "pixels"))
def preview_downscale(spark: SparkSession, d: str) -> DataFrame:
    return r.preview(t.images(spark, d), 4).withColumn("v", F.round("v", 6))


@query(sql("""with p as (select a.frame_id as pair_id, a.v as a, b.v as b from pixels a join pixels b on b.frame_id = a.frame_id + 1 and a.pos = b.pos)
select pair_id, round(avg((a - b) * (a - b)), 6) as mse, round(avg(abs(a - b)), 6) as mae, max(abs(a - b)) as max_abs, round(20 * log10(255 / sqrt(avg((a - b) * (a - b)))), 6) as psnr,
round((2 * avg(a) * avg(b) + 6.5025) * (2 * (avg(a * b) - avg(a) * avg(b)) + 58.5225) / ((avg(a) * avg(a) + avg(b) * avg(b) + 6.5025) * (avg(a * a) - avg(a) * avg(a) + avg(b * b) - avg(b) * avg(b) + 58.5225)), 6) as ssim from p group by 1""", "pixels"))
def image_metrics(spark: SparkSession, d: str) -> DataFrame:
    i = t.images(spark, d)
    return r.metrics(i.select(F.col("frame_id").alias("pair_id"), "pixels"), i.select((F.col("frame_id") - 1).alias("pair_id"), "pixels"))


@query(sql("select f.asset_id, width, height from (select asset_id, bbox_w as width, bbox_h as height, row_number() over (partition by asset_id order by count(*) desc, bbox_w * bbox_h desc, bbox_w desc) as rn from detections join frames using (frame_id) group by 1, 2, 3) f where rn = 1", "detections", "frames"))
def nominal_geometry(spark: SparkSession, d: str) -> DataFrame:
    return r.nominal_geometry(t.detections(spark, d).join(t.frames(spark, d).select("frame_id", "asset_id"), "frame_id").select("asset_id", F.col("bbox_w").alias("width"), F.col("bbox_h").alias("height")))


NEAR = "near as (select p.frame_id, p.pos, p.x, p.y, p.v, o.dx, o.dy, q.v as u from pixels p cross join (select a.i as dx, b.i as dy from (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(i)) o join pixels q on q.frame_id = p.frame_id and q.x = least(greatest(p.x + o.dx, 0), 7) and q.y = least(greatest(p.y + o.dy, 0), 7))"


@query(sql(f"with {NEAR}, m as (select frame_id, pos, v > floor(sum(u) / 9.0 + 0.5) - 5 as up from near group by 1, 2, v) select frame_id, cast(count(*) filter (where up) as integer) as foreground from m group by 1", "pixels"))
def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    return foreground(r.per_frame(t.images(spark, d), r.adaptive_mean(3, 5)))


@query(sql(f"with {NEAR.replace('least(greatest(p.x + o.dx, 0), 7)', '7 - abs(7 - abs(p.x + o.dx))').replace('least(greatest(p.y + o.dy, 0), 7)', '7 - abs(7 - abs(p.y + o.dy))')}, g as (select frame_id, pos, sum(u * dx * (2 - abs(dy))) as gx, sum(u * dy * (2 - abs(dx))) as gy from near group by 1, 2) select frame_id, cast(count(*) filter (where gx * gx + gy * gy >= 22500) as integer) as foreground from g group by 1", "pixels"))
def sobel_mask(spark: SparkSession, d: str) -> DataFrame:
    return foreground(r.per_frame(t.images(spark, d), r.sobel(150)))


@query(sql("""with w as (select * from (values (-2, 0.0625), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625)) t(i, w)),
b as (select p.frame_id, p.pos, p.v, sum(q.v * a.w * c.w) as mean from pixels p cross join w a cross join w c join pixels q on q.frame_id = p.frame_id and q.x = least(greatest(p.x + a.i, 0), 7) and q.y = least(greatest(p.y + c.i, 0), 7) group by 1, 2, 3)
select frame_id, cast(count(*) filter (where v > round_even(mean, 0) - 3) as integer) as foreground from b group by 1""", "pixels"))
def adaptive_bell_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The bell-shaped block of five, and a level of 2.5 that counts as 3."""
    return foreground(r.per_frame(t.images(spark, d), r.thresholder("adaptive_gaussian", block_size=4, c=2.5)))


@query(sql(f"with {NEAR}, e as (select frame_id, pos, min(case when u > 120 then 1 else 0 end) as eroded, max(case when u > 150 then 1 else 0 end) as dilated from near group by 1, 2) select frame_id, cast(sum(eroded) as integer) as eroded, cast(sum(dilated) as integer) as dilated from e group by 1", "pixels"))
def morphology(spark: SparkSession, d: str) -> DataFrame:
    i = t.images(spark, d)
    a = foreground(r.per_frame(i, lambda p: r.morph("erode")((p > 120) * 255))).withColumnRenamed("foreground", "eroded")
    return a.join(foreground(r.per_frame(i, lambda p: r.morph("dilate")((p > 150) * 255))).withColumnRenamed("foreground", "dilated"), "frame_id")


REACH = """with recursive on_ as (select frame_id, pos, x, y, v from pixels where v > {0}), reach as (select frame_id, pos as root, pos from on_ union select r.frame_id, r.root, b.pos from reach r join on_ a on a.frame_id = r.frame_id and a.pos = r.pos join on_ b on b.frame_id = a.frame_id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
part as (select frame_id, pos, min(root) as root from reach group by 1, 2)"""


def recursive(body: str, *views: str) -> str:
    return sql(body.replace("with recursive ", "with ", 1), *views).replace("with ", "with recursive ", 1)


@query(recursive(REACH.format(145) + ", c as (select frame_id, root, count(*) as n from part group by 1, 2) select frame_id, count(*) as components, cast(sum(n) as bigint) as area, max(n) as largest from c group by 1", "pixels"))
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    x = r.regions(t.images(spark, d), lambda a: (a > 145) * 255)
    return x.groupBy("frame_id").agg(F.count("*").alias("components"), F.sum("area").alias("area"), F.max("area").alias("largest"))


@query(recursive(REACH.format(139) + ", strong as (select distinct frame_id, root from part join pixels using (frame_id, pos) where v >= 165) select frame_id, count(*) as foreground from part join strong using (frame_id, root) group by 1", "pixels"))
def hysteresis_mask(spark: SparkSession, d: str) -> DataFrame:
    x = foreground(r.per_frame(t.images(spark, d), r.hysteresis(140, 165))).where("foreground > 0")
    return x.withColumn("foreground", F.col("foreground").cast("long"))


@query(recursive(REACH.format(145) + ", b as (select frame_id, root, min(x) as bbox_x, min(y) as bbox_y, max(x) - min(x) + 1 as bbox_w, max(y) - min(y) + 1 as bbox_h, count(*) as area, min(v) as min_gray, round(avg(v), 6) as mean_gray from part join pixels using (frame_id, pos) group by 1, 2) select frame_id, bbox_x, bbox_y, bbox_w, bbox_h, area, min_gray, mean_gray from b where area >= 2", "pixels"))
def segment_detections(spark: SparkSession, d: str) -> DataFrame:
    x = r.regions(t.images(spark, d), r.augment([lambda a: (a > 145) * 255, r.remove_small(2)])).drop("label")
    return x.select("frame_id", *[F.col(c).cast("long").alias(c) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")], "area", "min_gray", "mean_gray")


@query(recursive(REACH.format(150) + """, b as (select frame_id, root, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, count(*) as area from part join pixels using (frame_id, pos) group by 1, 2),
c as (select *, greatest(x0 - 2, 0) as cx, greatest(y0 - 2, 0) as cy, least(x1 + 3, 8) as ex, least(y1 + 3, 8) as ey from b)
select c.frame_id, cast(cx as integer) as crop_x, cast(cy as integer) as crop_y, cast(ex - cx as integer) as crop_w, cast(ey - cy as integer) as crop_h, area, cast(sum(p.v * ((p.y - cy) * (ex - cx) + p.x - cx + 1)) as bigint) as roi,
  cast(sum(case when m.root is not null then 255 * ((p.y - cy) * (ex - cx) + p.x - cx + 1) else 0 end) as bigint) as mask
from c join pixels p on p.frame_id = c.frame_id and p.x >= cx and p.x < ex and p.y >= cy and p.y < ey left join part m on m.frame_id = c.frame_id and m.pos = p.pos and m.root = c.root group by all""", "pixels"))
def padded_detections(spark: SparkSession, d: str) -> DataFrame:
    """Crops grown by two pixels, with the region's pixels and its mask in the crop, as sums weighted by place."""
    x = r.detections(t.images(spark, d), r.thresholder("manual", threshold=150), padding=2)
    weighted = lambda c: F.aggregate(F.transform(c, lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v).alias(c)
    return x.select("frame_id", *[F.col(f"crop_bbox_{k}").alias(f"crop_{k}") for k in "xywh"], "area", weighted("roi"), weighted("mask"))


@query(recursive("""with recursive off as (select frame_id, pos, x, y from pixels where v <= 130), outside as (select frame_id, pos from off where x in (0, 7) or y in (0, 7)
  union select b.frame_id, b.pos from outside o join off a on a.frame_id = o.frame_id and a.pos = o.pos join off b on b.frame_id = a.frame_id and abs(a.x - b.x) + abs(a.y - b.y) = 1),
filled as (select p.frame_id, p.pos, p.x, p.y, p.v from pixels p where not exists (select 1 from outside o where o.frame_id = p.frame_id and o.pos = p.pos)),
reach as (select frame_id, pos as root, pos from filled union select r.frame_id, r.root, b.pos from reach r join filled a on a.frame_id = r.frame_id and a.pos = r.pos join filled b on b.frame_id = a.frame_id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
part as (select frame_id, pos, min(root) as root from reach group by 1, 2)
select frame_id, cast(min(x) as integer) as bbox_x, cast(min(y) as integer) as bbox_y, cast(max(x) - min(x) + 1 as integer) as bbox_w, cast(max(y) - min(y) + 1 as integer) as bbox_h, count(*) as area, cast(min(v) as integer) as min_gray from part join filled using (frame_id, pos) group by frame_id, root""", "pixels"))
def outer_contours(spark: SparkSession, d: str) -> DataFrame:
    """Regions as their outer contours: holes count."""
    x = r.detections(t.images(spark, d), r.thresholder("manual", threshold=130), external=True, payloads=False)
    return x.select("frame_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "area", "min_gray")


@query(sql("select frame_id, count(*) as foreground from pixels where v >= 0.55 * 255 group by 1", "pixels"))
def refine_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The model is a level on the scaled pixels, so that tiling and merging must give the same pixels as no tiling."""
    tiles = refine.tiles(t.images(spark, d), 4, 0.5)
    return refine.merge_tiles(refine.predict(tiles, lambda x: x / 1.1, 4), 4).groupBy("frame_id").agg(F.count("*").alias("foreground"))


WALK = """with recursive o as (select frame_id, detection_id, bbox_x as x, bbox_y as y, bbox_w as w, bbox_h as h, bbox_w * bbox_h as size, row_number() over (partition by frame_id order by bbox_w * bbox_h desc, detection_id) as n from detections),
walk as (select distinct frame_id, cast(0 as bigint) as n, cast([] as struct(id varchar, x integer, y integer, w integer, h integer)[]) as kept, cast(null as varchar) as detection_id, cast(null as varchar) as keeper_id, false as consumed from o
union all select frame_id, n, case when hit is null then list_append(kept, {'id': detection_id, 'x': x, 'y': y, 'w': w, 'h': h}) else kept end, detection_id, coalesce(hit, detection_id), hit is not null from (
select o.*, kept, (list_filter(kept, lambda k: greatest(least(o.x + o.w, k.x + k.w) - greatest(o.x, k.x), 0) * greatest(least(o.y + o.h, k.y + k.h) - greatest(o.y, k.y), 0) > 0 and (
 greatest(least(o.x + o.w, k.x + k.w) - greatest(o.x, k.x), 0) * greatest(least(o.y + o.h, k.y + k.h) - greatest(o.y, k.y), 0) * 3 >= o.size + k.w * k.h
 or greatest(least(o.x + o.w, k.x + k.w) - greatest(o.x, k.x), 0) * greatest(least(o.y + o.h, k.y + k.h) - greatest(o.y, k.y), 0) * 10 >= 8 * least(o.size, k.w * k.h))))[1].id as hit
from walk join o on o.frame_id = walk.frame_id and o.n = walk.n + 1))"""


@query(recursive(WALK + " select frame_id, detection_id, keeper_id, consumed from walk where n > 0", "detections"))
def refine_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return refine.reconcile(t.detections(spark, d)).select("frame_id", "detection_id", "keeper_id", "consumed")


@query(recursive(WALK + """, p as (select w.frame_id, w.detection_id, w.keeper_id, a.bbox_w * a.bbox_h as r_area, b.bbox_w * b.bbox_h as k_area,
(least(a.bbox_x + a.bbox_w, b.bbox_x + b.bbox_w) - greatest(a.bbox_x, b.bbox_x)) * (least(a.bbox_y + a.bbox_h, b.bbox_y + b.bbox_h) - greatest(a.bbox_y, b.bbox_y)) as shared
from walk w join (select distinct on (detection_id) * from detections) a on a.detection_id = w.detection_id join (select distinct on (detection_id) * from detections) b on b.detection_id = w.keeper_id where n > 0 and consumed)
select keeper_id, detection_id as candidate_detection_id, shared::bigint as shared_area, round(shared / (r_area + k_area - shared), 9) as iou, round(shared / r_area, 9) as containment, round(shared / k_area, 9) as keeper_containment, count(*) over (partition by keeper_id) as consumed_count from p""", "detections"))
def refine_reconcile_links(spark: SparkSession, d: str) -> DataFrame:
    """What each kept region consumed, with the measures of each overlap."""
    links = refine.consumed_links(refine.reconcile(t.detections(spark, d)))
    x = links.select("keeper_id", F.col("consumed_count").cast("long").alias("consumed_count"), F.explode("consumed").alias("c"))
    return x.select("keeper_id", "c.candidate_detection_id", "c.shared_area", *[F.round(f"c.{m}", 9).alias(m) for m in ("iou", "containment", "keeper_containment")], "consumed_count")


@query(sql("select frame_id, count(*) as foreground from pixels where v > 130 and not v > 150 group by 1", "pixels"))
def residual_pixels(spark: SparkSession, d: str) -> DataFrame:
    p = r.pixels(t.images(spark, d))
    return refine.residual(p.where("v > 130"), p.where("v > 150")).groupBy("frame_id").agg(F.count("*").alias("foreground"))
