"""Catalogue, paging, status and export queries over the supplied views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import catalog as c
from framelake.operators import exports as e
from framelake.operators import status as s
from framelake.sources import tables as t

from .register import query
from .twins import sql

COUNTS = """with found as (select frame_id, count(*) as detection_count from detections group by 1),
done as (select frame_id, count(*) as refined_count, count(distinct candidate_detection_id) as refined_candidates from refined group by 1),
counts as (select f.*, coalesce(detection_count, 0) as detection_count, coalesce(refined_count, 0) as refined_count, coalesce(refined_candidates, 0) as refined_candidates,
  greatest(coalesce(detection_count, 0) - coalesce(refined_candidates, 0), 0) as unrefined_count
  from frames f left join found on f.frame_id = found.frame_id left join done on f.frame_id = done.frame_id)"""
STATUS = COUNTS + """,
status as (select frame_id, asset_id, frame_index, case when has_preprocessed then 'succeeded' when frame_id % 3 = 0 then 'failed' else 'unknown' end as preprocessing_status,
  case when detection_count > 0 then 'succeeded' when frame_id % 3 = 0 then 'failed' else 'unknown' end as detection_status,
  case when refined_count > 0 then 'succeeded' when frame_id % 3 = 0 then 'failed' else 'unknown' end as refinement_status, detection_count, refined_count, unrefined_count from counts)"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    return s.frame_counts(t.frames(spark, d), t.detections(spark, d), t.refined(spark, d))


def status(spark: SparkSession, d: str) -> DataFrame:
    old = t.frames(spark, d).where("frame_id % 3 = 0").select("frame_id", *[F.lit("failed").alias(f"old_{n}") for n in ("preprocessing", "detection", "refinement")])
    return s.rebuild(counts(spark, d), old)


@query(sql("select asset_id, filename, kind, size_bytes from assets where kind = 'BUILDING' and filename ilike '%00%1%' and size_bytes between 0 and 5000 and list_contains(collections, 'BUILDING')", "assets"))
def asset_search(spark: SparkSession, d: str) -> DataFrame:
    return c.search(t.assets(spark, d), {"kind": "BUILDING"}, {"filename": "00%1"}, {"size_bytes": (0, 5000)}, ("collections", "BUILDING")).select("asset_id", "filename", "kind", "size_bytes")


@query(sql("select run_id, run_key, project_id from runs where exists (select 1 from assets a where a.run_id = runs.run_id and list_contains(collections, 'MACHINERY')) and run_key ilike '%_1%'", "runs", "assets"))
def run_search_by_collection(spark: SparkSession, d: str) -> DataFrame:
    return c.runs_in_collection(c.search(t.runs(spark, d), like={"run_key": "_1"}), t.assets(spark, d), "MACHINERY")


@query(sql("select frame_id, asset_id, frame_index from frames where frame_index between 2 and 8 order by asset_id, frame_index desc limit 50 offset 5", "frames"))
def frame_range(spark: SparkSession, d: str) -> DataFrame:
    x = c.search(t.frames(spark, d), ranges={"frame_index": (2, 8)})
    return c.page(x, [F.col("asset_id"), F.col("frame_index").desc()], 50, 5).select("frame_id", "asset_id", "frame_index")


@query(sql("select detection_id, f.asset_id, a.run_id, bbox_w, area from detections d join frames f using (frame_id) join assets a on a.asset_id = f.asset_id where area between 20000 and 60000 and bbox_w >= 12 and bbox_h <= 8 and frame_index between 1 and 5 and list_contains(collections, 'AUTOMOBILE')", "detections", "frames", "assets"))
def detection_search(spark: SparkSession, d: str) -> DataFrame:
    x = c.search(t.detections(spark, d), ranges={"area": (20000, 60000), "bbox_w": (12, None), "bbox_h": (None, 8)})
    f = c.search(t.frames(spark, d), ranges={"frame_index": (1, 5)}).select("frame_id", "asset_id")
    a = c.search(t.assets(spark, d), member=("collections", "AUTOMOBILE")).select("asset_id", "run_id")
    return x.join(f, "frame_id").join(a, "asset_id").select("detection_id", "asset_id", "run_id", "bbox_w", "area")


@query(sql("select detection_id, frame_id from detections where exists (select 1 from refined r where r.candidate_detection_id = detection_id)", "detections", "refined"))
def detections_refined_only(spark: SparkSession, d: str) -> DataFrame:
    return c.refined_only(t.detections(spark, d), t.refined(spark, d)).select("detection_id", "frame_id")


@query(sql("select detection_id, frame_id from detections where not exists (select 1 from refined r where r.candidate_detection_id = detection_id)", "detections", "refined"))
def detections_unrefined(spark: SparkSession, d: str) -> DataFrame:
    return c.unrefined(t.detections(spark, d), t.refined(spark, d)).select("detection_id", "frame_id")


@query(sql("select candidate_detection_id, refined_id, method, area from (select *, row_number() over (partition by candidate_detection_id order by created_at desc, refined_id desc) as rn from refined) where rn = 1", "refined"))
def latest_refined_per_detection(spark: SparkSession, d: str) -> DataFrame:
    return c.latest(t.refined(spark, d), "candidate_detection_id", ["created_at", "refined_id"]).select("candidate_detection_id", "refined_id", "method", "area")


@query(sql("select cast(o_orderkey % 97 as integer) as position, frame_id, asset_id from orders join frames on frame_id = o_orderkey * 2", "frames"))
def frames_caller_order(spark: SparkSession, d: str) -> DataFrame:
    request = t.table(spark, d, "orders").select((F.col("o_orderkey") % 97).cast("int").alias("position"), (F.col("o_orderkey") * 2).alias("frame_id"))
    return c.in_request_order(t.frames(spark, d), request, "frame_id").select("position", "frame_id", "asset_id")


@query(sql("""with l as (select frame_id, string_agg(roi_index || ':' || detection_id, ',' order by roi_index, detection_id) as rois from detections group by 1)
select f.frame_id, a.filename, a.kind, l.rois from frames f join assets a using (asset_id) left join l on l.frame_id = f.frame_id""", "frames", "assets", "detections"))
def frame_context(spark: SparkSession, d: str) -> DataFrame:
    x = c.frame_context(t.frames(spark, d), t.assets(spark, d), t.detections(spark, d))
    listed = F.array_join(F.transform("rois", lambda r: F.concat_ws(":", r["roi_index"].cast("string"), r["detection_id"])), ",")
    return x.select("frame_id", "filename", "kind", listed.alias("rois"))


@query(sql(STATUS + " select asset_id, frame_index, frame_id, detection_status from status where (asset_id, frame_index, frame_id) > (100, 3, 0) order by asset_id, frame_index, frame_id limit 500", "frames", "detections", "refined"))
def status_page_cursor(spark: SparkSession, d: str) -> DataFrame:
    return c.page_after(status(spark, d).select("asset_id", "frame_index", "frame_id", "detection_status"), ["asset_id", "frame_index", "frame_id"], (100, 3, 0), 500)


@query(sql("select job_id, stage, status from jobs where (asset_id, job_id) < (900, 5000) order by asset_id desc, job_id desc limit 200", "jobs"))
def jobs_page_cursor(spark: SparkSession, d: str) -> DataFrame:
    return c.page_after(t.jobs(spark, d), ["asset_id", "job_id"], (900, 5000), 200, descending=True).select("job_id", "stage", "status")


@query(sql("select collection, count(*) as asset_count from assets, unnest(collections) as u(collection) group by 1", "assets"))
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return c.collection_counts(t.assets(spark, d))


@query(sql(COUNTS + """ select a.asset_id, a.filename, a.run_id, count(*) filter (where detection_count > 0) as detected_frames, cast(sum(detection_count) as bigint) as detection_count
from counts join assets a using (asset_id) group by 1, 2, 3 having sum(detection_count) >= 5""", "frames", "detections", "refined", "assets"))
def asset_detection_stats(spark: SparkSession, d: str) -> DataFrame:
    return s.asset_detection_stats(t.assets(spark, d), counts(spark, d), 5)


@query(sql(COUNTS + """, per as (select asset_id, count(*) as frame_count, count(*) filter (where has_preprocessed) as preprocessed_count, count(*) filter (where detection_count > 0) as detected_count, cast(sum(detection_count) as bigint) as detection_count from counts group by 1)
select a.asset_id, coalesce(frame_count, 0) as frame_count, coalesce(preprocessed_count, 0) as preprocessed_count, coalesce(detected_count, 0) as detected_count, coalesce(detection_count, 0) as detection_count,
case when frame_count > 0 and preprocessed_count = frame_count then 'fully-preprocessed' when preprocessed_count > 0 then 'partially-preprocessed' else 'needs-preprocessing' end as preprocessing_state,
case when frame_count > 0 and detected_count = frame_count then 'fully-detected' when detection_count > 0 then 'partially-detected' else 'needs-detections' end as detection_state
from assets a left join per on a.asset_id = per.asset_id""", "frames", "detections", "refined", "assets"))
def asset_processing_state(spark: SparkSession, d: str) -> DataFrame:
    return s.asset_state(t.assets(spark, d), counts(spark, d))


@query(sql(COUNTS + """ select frame_id, detection_count, refined_count, refined_candidates, unrefined_count, case when detection_count = 0 then 'no-detections' when refined_candidates = 0 then 'needs-refinement' when refined_candidates >= detection_count then 'fully-refined' else 'partially-refined' end as refinement_state from counts""", "frames", "detections", "refined"))
def frame_processing_state(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).select("frame_id", "detection_count", "refined_count", "refined_candidates", "unrefined_count", s.refinement_state().alias("refinement_state"))


@query(sql(STATUS + " select * from status", "frames", "detections", "refined"))
def frame_status_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return status(spark, d)


_CELLS = ", ".join(f"count(*) filter (where {st} = '{v}') as {st}_{v}" for st in s.STAGES for v in t.STATUSES)


@query(sql(STATUS + f" select count(*) as frame_count, count(*) filter (where detection_count > 0) as with_candidates, count(*) filter (where refined_count > 0) as with_refined, cast(sum(detection_count) as bigint) as detections, cast(sum(refined_count) as bigint) as refined, cast(sum(unrefined_count) as bigint) as unrefined, {_CELLS}, (select max(captured_at) from frames) as updated_at from status", "frames", "detections", "refined"))
def frame_status_summary(spark: SparkSession, d: str) -> DataFrame:
    at = t.frames(spark, d).select("frame_id", F.col("captured_at").alias("updated_at"))
    return s.summary(status(spark, d).join(at, "frame_id"), t.STATUSES)


_STAGE_ROWS = " union all ".join(f"select '{st}' as facet, {st} as value, 1 as n from status" for st in s.STAGES)


@query(sql(STATUS + f""", rows as ({_STAGE_ROWS} union all select 'refinement', 'refined', detection_count - unrefined_count from status union all select 'refinement', 'unrefined', unrefined_count from status
union all select 'asset', cast(asset_id as varchar), 1 from status union all select 'collection', u.collection, 1 from status join assets using (asset_id), unnest(collections) as u(collection))
select facet, value, cast(sum(n) as bigint) as n from rows group by 1, 2""", "frames", "detections", "refined", "assets"))
def frame_status_facets(spark: SparkSession, d: str) -> DataFrame:
    return s.facets(status(spark, d), t.assets(spark, d))


@query(sql(STATUS + " select frame_id from status where detection_count > 0 and refinement_status in ('unknown', 'failed') and frame_index between 1 and 6", "frames", "detections", "refined"))
def frame_status_ids(spark: SparkSession, d: str) -> DataFrame:
    return c.search(status(spark, d), {"refinement_status": ["unknown", "failed"]}, ranges={"detection_count": (1, None), "frame_index": (1, 6)}).select("frame_id")


@query(sql("""with new as (select project_id, cast(count(*) as varchar) || '/' || cast(sum(cast(floor(size_bytes) as bigint)) as varchar) as summary from assets group by 1),
old as (select r_regionkey as project_id, 3 as version, case when r_regionkey % 2 = 0 then new.summary else 'old' end as summary from region left join new on r_regionkey = project_id)
select coalesce(new.project_id, old.project_id) as project_id, cast(coalesce(version, 0) + case when new.summary is distinct from old.summary then 1 else 0 end as integer) as version, coalesce(new.summary, old.summary) as summary from new full join old on new.project_id = old.project_id""", "assets"))
def status_snapshot_version(spark: SparkSession, d: str) -> DataFrame:
    new = t.assets(spark, d).groupBy("project_id").agg(F.concat(F.count("*").cast("string"), F.lit("/"), F.sum(F.floor("size_bytes").cast("long")).cast("string")).alias("summary"))
    old = t.table(spark, d, "region").join(new, F.col("r_regionkey") == F.col("project_id"), "left").select(F.col("r_regionkey").alias("project_id"), F.lit(3).alias("version"), F.when(F.col("r_regionkey") % 2 == 0, F.col("summary")).otherwise("old").alias("summary"))
    return s.snapshot(new, old)


@query(sql("""with j as (select asset_id, count(*) as job_count, max_by(status, (created_at, job_id)) as last_status from jobs group by 1)
select f.frame_id, f.frame_index, a.filename, a.kind, a.run_key, a.project_id, job_count, last_status from frames f join assets a using (asset_id) left join j on j.asset_id = f.asset_id""", "frames", "assets", "jobs"))
def export_frame_metadata(spark: SparkSession, d: str) -> DataFrame:
    j = t.jobs(spark, d).groupBy("asset_id").agg(F.count("*").alias("job_count"), F.max_by("status", F.struct("created_at", "job_id")).alias("last_status"))
    return t.frames(spark, d).join(t.assets(spark, d), "asset_id").join(j, "asset_id", "left").select("frame_id", "frame_index", "filename", "kind", "run_key", "project_id", "job_count", "last_status")


@query(sql("""with r as (select candidate_detection_id, refined_id, method from (select *, row_number() over (partition by candidate_detection_id order by created_at desc, refined_id desc) as rn from refined) where rn = 1)
select d.detection_id, d.frame_id, f.asset_id, a.filename, a.run_id, d.bbox_x, d.bbox_y, d.bbox_w, d.bbox_h, d.area, r.refined_id, r.method from detections d join frames f using (frame_id) join assets a on a.asset_id = f.asset_id left join r on r.candidate_detection_id = d.detection_id""", "detections", "frames", "assets", "refined"))
def export_roi_metadata(spark: SparkSession, d: str) -> DataFrame:
    parts = t.parts(spark, d, "orders", "lineitem")
    r = t.refined(spark, d, parts).select("frame_id", F.col("candidate_detection_id").alias("detection_id"), "refined_id", "method", F.col("created_at").alias("refined_at"))
    x = t.detections(spark, d, parts).select("frame_id", "detection_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "area")
    done = c.with_latest(x, r, "frame_id", "detection_id", ["refined_at", "refined_id"], ["refined_id", "method"])
    # Assets join their frames, not their detections, of which there are several times as many.
    f = t.frames(spark, d, parts).select("frame_id", "asset_id").join(t.assets(spark, d).select("asset_id", "filename", "run_id"), "asset_id")
    return done.join(f, "frame_id").select("detection_id", "frame_id", "asset_id", "filename", "run_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "area", "refined_id", "method")


@query(sql("select asset_id, '[\"' || collections[1] || '\",\"' || collections[2] || '\"]' as collections, to_base64(encode(filename)) as filename, strftime(captured_at, '%Y-%m-%d %H:%M:%S') as captured_at, frame_id from assets join frames using (asset_id)", "assets", "frames"))
def export_values(spark: SparkSession, d: str) -> DataFrame:
    x = t.assets(spark, d).join(t.frames(spark, d), "asset_id")
    return e.rendered(x.select("asset_id", "collections", F.col("filename").cast("binary").alias("filename"), "captured_at", "frame_id"))


@query("select c_custkey as asset_id, case when len(w) = 0 then 'none' else array_to_string(w, '|') end as collections from (select c_custkey, list_filter([trim(c_mktsegment), trim(case when c_custkey % 2 = 0 then c_mktsegment else '' end), trim(case when c_custkey % 3 = 0 then ' x' else '' end)], lambda x, i: x <> '' and (i <> 2)) as w from customer)")
def normalize_collections(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "customer")
    text = F.concat(F.col("c_mktsegment"), F.lit(", "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.lit(" ,,"), F.when(F.col("c_custkey") % 3 == 0, " x").otherwise(""))
    return x.select(F.col("c_custkey").alias("asset_id"), F.array_join(c.normalize_collections(text), "|").alias("collections"))


#: Names as cameras give them: a blank, T or hyphen, hyphens or colons, with and without a fraction, and without a time.
@query("""select o_orderkey as frame_id, case when o_orderkey % 5 < 4 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.' || case when o_orderkey % 2 = 0 then rpad(cast(o_orderkey % 1000 as varchar), 6, '0') else '000000' end end as captured_at from orders""")
def filename_timestamps(spark: SparkSession, d: str) -> DataFrame:
    at = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey")
    time = F.when(k % 5 == 0, at("yyyy-MM-dd HH-mm-ss")).when(k % 5 == 1, at("yyyy-MM-dd'T'HH:mm:ss")).when(k % 5 == 2, at("yyyy-MM-dd-HH-mm:ss")).when(k % 5 == 3, at("yyyy-MM-dd HH:mm-ss")).otherwise(at("yyyyMMdd_HHmmss"))
    fraction = F.when(k % 2 == 0, F.concat(F.lit("."), (k % 1000).cast("string"))).otherwise("")
    name = F.concat(F.lit("cam 7 "), time, fraction, F.lit(".avi"))
    return t.table(spark, d, "orders").select(k.alias("frame_id"), c.filename_timestamp(name).alias("captured_at"))


@query(sql('select detection_id, greatest(bbox_x - 5, 0) as "left", greatest(bbox_y - 5, 0) as top, least(bbox_x + bbox_w + 5, 72) as "right", least(bbox_y + bbox_h + 5, 72) as bottom from detections', "detections"))
def padded_bounds(spark: SparkSession, d: str) -> DataFrame:
    return t.detections(spark, d).select("detection_id", *[x.alias(n) for n, x in c.padded_bounds(5, 72, 72).items()])


@query(sql("""select first_id, second_id, w * h as intersection, round(w * h / (sa + sb - w * h), 6) as iou, round(w * h / sa, 6) as first_contained, round(w * h / sb, 6) as second_contained from (
select a.detection_id as first_id, b.detection_id as second_id, least(a.bbox_x + a.bbox_w, b.bbox_x + b.bbox_w) - greatest(a.bbox_x, b.bbox_x) as w, least(a.bbox_y + a.bbox_h, b.bbox_y + b.bbox_h) - greatest(a.bbox_y, b.bbox_y) as h, a.bbox_w * a.bbox_h as sa, b.bbox_w * b.bbox_h as sb
from detections a join detections b on a.frame_id = b.frame_id and a.detection_id < b.detection_id) where w > 0 and h > 0""", "detections"))
def bbox_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return c.overlap_pairs(t.detections(spark, d))


@query("""select p_partkey as roi, cast(tile as integer) as tile from (select p_partkey, cast(p_size as integer) as n from part), unnest(case when n <= 12 then [cast(0 as integer)] else list_distinct(list_concat(generate_series(0, n - 12, 9), [n - 12])) end) as u(tile)""")
def tile_starts(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("roi"), F.explode(c.tile_starts(F.col("p_size").cast("int"), 12, 0.25)).alias("tile"))


@query(sql("select detection_id, cast(row_number() over (partition by frame_id order by roi_index, detection_id) as integer) as new_index from detections where area >= 10000 and bbox_w <= 20 and 2 * (bbox_w + bbox_h) between 20 and 70", "detections"))
def filter_rois(spark: SparkSession, d: str) -> DataFrame:
    return c.filter_rois(t.detections(spark, d), area=(10000, None), width=(None, 20), perimeter=(20, 70)).select("detection_id", "new_index")


@query(sql("select detection_id, frame_id, roi_index from (select *, row_number() over (partition by frame_id order by roi_index, detection_id) as place from detections) where place <= 2", "detections"))
def detections_capped(spark: SparkSession, d: str) -> DataFrame:
    return c.first_per_group(t.detections(spark, d), "frame_id", ["roi_index", "detection_id"], 2).select("detection_id", "frame_id", "roi_index")


@query(sql("select frame_id, payload_size from frames order by payload_size desc nulls last, frame_id limit 25", "frames"))
def largest_payloads(spark: SparkSession, d: str) -> DataFrame:
    return c.top(t.frames(spark, d), [F.col("payload_size").desc_nulls_last(), F.col("frame_id")], 25).select("frame_id", "payload_size")
