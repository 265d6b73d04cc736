"""Searches, lookups, scopes, states and pages over the catalogue with all its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import catalog as c
from framelake.operators import search as s
from framelake.operators import status as st
from framelake.sources import tables as t
from framelake.sources.wide import wide

from .catalogue import COUNTS, counts
from .register import query
from .twins import sql


@query(sql("select job_id, stage, status from w_jobs where project_id = 1 and status in ('queued', 'failed') and stage in ('URGENT', 'HIGH') and worker_id = 'w5'", "w_jobs"))
def job_search(spark: SparkSession, d: str) -> DataFrame:
    return s.search_jobs(wide(spark, d, "w_jobs"), ["queued", "failed", ""], ["URGENT", "HIGH"], project_id=1, worker_id="w5", run_id=None).select("job_id", "stage", "status")


@query(sql("select job_id, asset_id from w_jobs where run_id = 7 and job_id in (select l_orderkey from lineitem where l_returnflag = 'R')", "w_jobs"))
def job_search_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = t.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"))
    return s.search_jobs(wide(spark, d, "w_jobs"), ids=ids, run_id=7).select("job_id", "asset_id")


@query(sql("select id, level, event_type from w_logs where id > 100 and id < 9000 and level = 'error' and worker_id = 'w3' and logger = 'worker.error' and project_id = 3", "w_logs"))
def log_search(spark: SparkSession, d: str) -> DataFrame:
    return s.search_logs(wide(spark, d, "w_logs"), 100, 9000, "ERROR", worker_id="w3", logger="worker.error", project_id=3).select("id", "level", "event_type")


@query(sql("select l.id, l.job_id from w_logs l left join w_jobs j using (job_id) where (j.project_id = 2 or (l.job_id is null and json_extract_string(l.payload, '$.project_id') = '2')) and l.id > 50", "w_logs", "w_jobs"))
def event_search(spark: SparkSession, d: str) -> DataFrame:
    return s.search_events(wide(spark, d, "w_logs"), wide(spark, d, "w_jobs"), project=2, after_id=50).select("id", "job_id")


@query(sql("select l.id from w_logs l join w_jobs j using (job_id) where j.run_id = 11", "w_logs", "w_jobs"))
def event_search_by_run(spark: SparkSession, d: str) -> DataFrame:
    return s.search_events(wide(spark, d, "w_logs"), wide(spark, d, "w_jobs"), run=11).select("id")


@query(sql("select detection_id, area from w_detections d where area between 5000 and 80000 and bbox_w >= 4 and bbox_h <= 20 and mean_gray_value >= 20 and perimeter <= 180 and major_axis_length >= 3 and roi_encoding = 'zstd' and mask_format = 'label' and frame_index between 1 and 9 and exists (select 1 from w_assets a where a.asset_id = d.asset_id and list_contains(collections, 'BUILDING')) and exists (select 1 from w_refined r where r.candidate_detection_id = d.detection_id)", "w_detections", "w_refined", "w_assets"))
def detection_search_full(spark: SparkSession, d: str) -> DataFrame:
    ranges = {"area": (5000, 80000), "bbox_w": (4, None), "bbox_h": (None, 20), "mean_gray_value": (20, None), "perimeter": (None, 180), "major_axis_length": (3, None)}
    x = s.search_detections(wide(spark, d, "w_detections"), ranges, {"roi_encoding": "zstd", "mask_format": "label"}, (1, 9), wide(spark, d, "w_assets"), "BUILDING", wide(spark, d, "w_refined"), "Has_Refinement")
    return x.select("detection_id", "area")


SCOPED = {"assets": "asset_id", "frames": "frame_id", "detections": "detection_id", "refined": "refined_id", "jobs": "job_id", "logs": "id", "models": "model_id", "job_events": "id"}


@query(sql("""select 'assets' as name, count(*) as rows from w_assets where project_id = 2 union all select 'models', count(*) from w_models where project_id = 2 union all select 'jobs', count(*) from w_jobs where project_id = 2
union all select 'logs', count(*) from w_logs where project_id = 2 union all select 'frames', count(*) from w_frames join w_assets using (asset_id) where project_id = 2
union all select 'detections', count(*) from w_detections d join w_assets a on a.asset_id = d.asset_id where project_id = 2
union all select 'refined', count(*) from w_refined r join w_frames f on f.frame_id = r.frame_id join w_assets a on a.asset_id = f.asset_id where project_id = 2
union all select 'job_events', count(*) from w_logs l join w_jobs j on j.job_id = l.job_id where j.project_id = 2""", "w_refined", "w_jobs", "w_logs", "w_models"))
def project_scope(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each table one project has, each through its own path."""
    tables = {n: wide(spark, d, f"w_{n}") for n in ("assets", "frames", "detections", "refined", "jobs", "logs", "models")} | {"job_events": wide(spark, d, "w_logs").drop("project_id")}
    out = None
    for name in SCOPED:
        one = s.in_project(name, tables, 2).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("select o_orderkey * 2 as frame_id from orders where o_orderkey * 2 not in (select frame_id from w_frames join w_assets using (asset_id) where project_id = 1)", "w_frames"))
def frames_outside_project(spark: SparkSession, d: str) -> DataFrame:
    tables = {"frames": wide(spark, d, "w_frames"), "assets": wide(spark, d, "w_assets")}
    ids = t.table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("frame_id"))
    return s.outside_project("frames", tables, 1, ids, "frame_id")


@query(sql("select 'frame' as kind, cast(frame_id as varchar) as id from w_frames where asset_id = 5 and frame_index = 1 union all select 'job', cast(job_id as varchar) from w_jobs where job_id = 33 union all select 'run', cast(run_id as varchar) from w_runs where run_id = 4 union all select 'model', cast(model_id as varchar) from w_models where model_id = 9 union all select 'detection', detection_id from w_detections where frame_id = 7 and roi_index = 1", "w_jobs", "w_detections", "w_models"))
def point_lookups(spark: SparkSession, d: str) -> DataFrame:
    of = lambda kind, view, key, **at: s.lookup(wide(spark, d, view), **at).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    parts = [of("frame", "w_frames", "frame_id", asset_id=5, frame_index=1), of("job", "w_jobs", "job_id", job_id=33), of("run", "w_runs", "run_id", run_id=4), of("model", "w_models", "model_id", model_id=9), of("detection", "w_detections", "detection_id", frame_id=7, roi_index=1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(sql("select frame_id, asset_id, frame_index from w_frames where (asset_id, frame_index) in (select user_id % 1500, user_id % 3 + 1 from events)", "w_frames"))
def frames_by_asset_index(spark: SparkSession, d: str) -> DataFrame:
    wanted = t.table(spark, d, "events").select((F.col("user_id") % 1500).alias("asset_id"), (F.col("user_id") % 3 + 1).cast("int").alias("frame_index"))
    return s.lookup_many(wide(spark, d, "w_frames"), wanted, ["asset_id", "frame_index"]).select("frame_id", "asset_id", "frame_index")


@query(sql("select model_id, model_key from w_models where model_key ilike '%and#2%' and artifact_uri ilike '%PROMO%' and version = 'v1' and task = 'refine'", "w_models"))
def model_search(spark: SparkSession, d: str) -> DataFrame:
    return s.search_models(wide(spark, d, "w_models"), {"model_key": "and#2", "artifact_uri": "promo"}, version="v1", task="refine").select("model_id", "model_key")


@query("select s_suppkey as worker_id from supplier where s_suppkey % 3 = 0 and s_nationkey % 2 = 0")
def worker_search(spark: SparkSession, d: str) -> DataFrame:
    able = F.when(F.col("s_suppkey") % 3 == 0, '["segment","refine"]').otherwise('["segment"]')
    x = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("worker_id"), able.alias("capabilities"), F.when(F.col("s_nationkey") % 2 == 0, "online").otherwise("offline").alias("status"))
    return s.search_workers(x, "refine", status="online").select("worker_id")


@query(sql("select frame_id, json_extract_string(metadata, '$.live_preview.source_frame_id') as source from w_frames where json_extract_string(metadata, '$.live_preview.is_sandbox') = 'true' and json_extract_string(metadata, '$.live_preview.operation') = 'crop'", "w_frames"))
def sandbox_copies(spark: SparkSession, d: str) -> DataFrame:
    return s.sandbox_copies(wide(spark, d, "w_frames"), operation="crop").select("frame_id", F.get_json_object("metadata", "$.live_preview.source_frame_id").alias("source"))


@query(sql("select job_id, 'object' as payload_type, cast(strlen(payload) as integer) as payload_bytes, case when result like '[%' then 'array' when result like '{%' then 'object' when result like '\"%' then 'string' when result is not null then 'number' end as result_type, cast(strlen(result) as integer) as result_bytes, case when result like '[%' then cast(json_array_length(result) as integer) end as result_length from w_jobs", "w_jobs"))
def job_summary_projection(spark: SparkSession, d: str) -> DataFrame:
    return s.summary_columns(wide(spark, d, "w_jobs").select("job_id", "payload", "result"), ["payload", "result"]).drop("payload_length")


ASSET_COUNTS = COUNTS + """, per as (select a.asset_id, count(c.frame_id) as frame_count, count(*) filter (where has_preprocessed) as preprocessed_count, count(*) filter (where detection_count > 0) as detected_count, coalesce(cast(sum(detection_count) as bigint), 0) as detection_count from assets a left join counts c on c.asset_id = a.asset_id group by 1)"""


@query(sql(ASSET_COUNTS + " select asset_id, 'partial/complete' as filter from per where preprocessed_count > 0 and preprocessed_count < frame_count and frame_count > 0 and detected_count = frame_count union all select asset_id, 'needs/has' from per where preprocessed_count = 0 and detection_count > 0 union all select asset_id, 'complete/any' from per where frame_count > 0 and preprocessed_count = frame_count", "frames", "detections", "refined", "assets"))
def asset_state_search(spark: SparkSession, d: str) -> DataFrame:
    x = st.asset_state(t.assets(spark, d), counts(spark, d))
    cases = {"partial/complete": ("partially_preprocessed", "fully-detected"), "needs/has": ("needs-preprocessed", "has_detections"), "complete/any": ("complete", None)}
    kinds = F.array_compact(F.array(*[F.when(s.asset_state_filter(*how), n) for n, how in cases.items()]))
    return x.select("asset_id", F.explode(kinds).alias("filter"))


@query(sql(COUNTS + " select frame_id, 'none/partial' as filter from counts where not has_preprocessed and refined_candidates > 0 and unrefined_count > 0 union all select frame_id, 'has/complete' from counts where has_preprocessed and detection_count > 0 and unrefined_count = 0 union all select frame_id, 'any/no-detections' from counts where detection_count = 0", "frames", "detections", "refined"))
def frame_state_search(spark: SparkSession, d: str) -> DataFrame:
    cases = {"none/partial": ("none", None, "partially_refined"), "has/complete": ("has-preprocessed", None, "complete"), "any/no-detections": (None, None, "no_detections"), "never": (None, "partially-detected", None)}
    kinds = F.array_compact(F.array(*[F.when(s.frame_state_filter(*how), n) for n, how in cases.items()]))
    return counts(spark, d).select("frame_id", F.explode(kinds).alias("filter"))


@query(sql(COUNTS + " select frame_id, case when has_preprocessed then 'fully-preprocessed' else 'needs-preprocessed' end as preprocessing_state, case when detection_count > 0 then 'fully-detected' else 'needs-detections' end as detection_state, case when detection_count = 0 then 'no-detections' when refined_candidates = 0 then 'needs-refinement' when refined_candidates >= detection_count then 'fully-refined' else 'partially-refined' end as refinement_state from counts", "frames", "detections", "refined"))
def frame_states(spark: SparkSession, d: str) -> DataFrame:
    return st.frame_states(counts(spark, d)).select("frame_id", "preprocessing_state", "detection_state", "refinement_state")


@query(sql(COUNTS + " select count(*) as frames, count(*) filter (where has_preprocessed) as preprocessed_frames, count(*) filter (where detection_count > 0) as detected_frames, cast(sum(detection_count) as bigint) as detections, cast(sum(refined_candidates) as bigint) as refined_candidates, cast(sum(unrefined_count) as bigint) as unrefined, cast(sum(refined_count) as bigint) as refined from counts", "frames", "detections", "refined"))
def frame_states_summary(spark: SparkSession, d: str) -> DataFrame:
    return st.frame_states_summary(counts(spark, d))


@query(sql(COUNTS + ", per as (select asset_id, count(*) filter (where detection_count > 0) as f, sum(detection_count) as n from counts group by 1 having sum(detection_count) >= 5) select count(*) as assets, cast(sum(f) as bigint) as detected_frames, cast(sum(n) as bigint) as detections from per", "frames", "detections", "refined"))
def asset_detection_summary(spark: SparkSession, d: str) -> DataFrame:
    x = st.asset_detection_stats(t.assets(spark, d), counts(spark, d), 5)
    return x.agg(F.count("*").alias("assets"), F.sum("detected_frames").alias("detected_frames"), F.sum("detection_count").alias("detections"))


@query(sql("select asset_id, count(*) as frames from frames group by 1", "frames"))
def frame_counts_by_asset(spark: SparkSession, d: str) -> DataFrame:
    return t.frames(spark, d).groupBy("asset_id").agg(F.count("*").alias("frames"))


@query(sql("select stage, count(*) as matched, count(*) filter (where status in ('queued', 'leased', 'working', 'paused', 'unknown')) as cancellable from w_jobs where project_id = 1 group by 1", "w_jobs"))
def cancel_preview(spark: SparkSession, d: str) -> DataFrame:
    return s.cancel_preview(s.search_jobs(wide(spark, d, "w_jobs"), project_id=1))


@query(sql("select run_id, run_key from w_runs r where instrument = 'ISIIS' and exists (select 1 from w_assets a where a.run_id = r.run_id and list_contains(collections, 'BUILDING')) and exists (select 1 from w_assets a where a.run_id = r.run_id and kind = 'video') and exists (select 1 from w_assets a where a.run_id = r.run_id and media_count = 3) and exists (select 1 from w_assets a where a.run_id = r.run_id and filename ilike '%00_1%') and exists (select 1 from w_assets a where a.run_id = r.run_id and size_bytes >= 900000) and exists (select 1 from w_assets a where a.run_id = r.run_id and size_bytes <= 100)", "w_assets"))
def run_search_through_assets(spark: SparkSession, d: str) -> DataFrame:
    return s.runs_by_assets(wide(spark, d, "w_runs"), wide(spark, d, "w_assets"), "BUILDING", {"kind": "video", "media_count": 3}, {"filename": "00_1"}, 900000, 100, instrument="ISIIS").select("run_id", "run_key")


@query(sql("select id, event_type from w_logs l where created_at >= timestamp '2024-01-02 00:00:00' and created_at < timestamp '2024-01-20 00:00:00' and exists (select 1 from w_assets a where a.asset_id = l.asset_id and list_contains(collections, 'MACHINERY'))", "w_logs", "w_assets"))
def log_report_window(spark: SparkSession, d: str) -> DataFrame:
    return s.report_window(wide(spark, d, "w_logs"), "created_at", "2024-01-02 00:00:00", "2024-01-20 00:00:00", assets=wide(spark, d, "w_assets"), collection="MACHINERY").select("id", "event_type")


@query(sql("select detection_id, area from w_detections order by area asc nulls last, frame_index desc, roi_index, detection_id limit 40", "w_detections"))
def detections_sorted(spark: SparkSession, d: str) -> DataFrame:
    x = wide(spark, d, "w_detections")
    return c.page(x, [*s.sorted_by(s.detection_orders("asc"), "AREA", "asset_frame"), F.col("detection_id")], 40).select("detection_id", "area")


@query(sql("select detection_id, filename from w_detections join w_assets using (asset_id) order by filename desc nulls last, frame_index desc, roi_index desc, detection_id limit 30 offset 10", "w_detections", "w_assets"))
def detections_sorted_default(spark: SparkSession, d: str) -> DataFrame:
    x = wide(spark, d, "w_detections").join(wide(spark, d, "w_assets").select("asset_id", "filename"), "asset_id")
    return c.page(x, [*s.sorted_by(s.detection_orders(), "no such key", "asset_frame"), F.col("detection_id")], 30, 10).select("detection_id", "filename")


@query(sql("with p as (select asset_id, frame_index, frame_id from w_frames where (asset_id, frame_index, frame_id) > (20, 1, 0) order by 1, 2, 3 limit 100) select count(*) as rows, case when count(*) >= 100 then max_by(asset_id || '|' || frame_index || '|' || frame_id, (asset_id, frame_index, frame_id)) end as next_cursor from p", "w_frames"))
def status_next_cursor(spark: SparkSession, d: str) -> DataFrame:
    keys, limit = ["asset_id", "frame_index", "frame_id"], s.clamp(100, s.STATUS_LIMITS, 1000)
    return s.next_cursor(c.page_after(wide(spark, d, "w_frames").select(*keys), keys, (20, 1, 0), limit), keys, limit)


@query(sql('with p as (select 1 from w_runs limit 20 offset 10) select cast(20 as bigint) as "limit", cast(10 as bigint) as "offset", count(*) as count, cast(case when count(*) >= 20 then 10 + count(*) end as bigint) as next_offset from p', "w_runs"))
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    p = c.page(wide(spark, d, "w_runs"), [F.col("run_id")], 20, 10)
    return p.agg(F.count("*").alias("n")).select(*s.page_metadata(20, 10, F.col("n")))


@query(sql("select least(50, count(*)) as rows, least(50, count(*)) as known from w_frames", "w_frames"))
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample differs with its seed; its size, and that its rows are the table's, do not."""
    x = wide(spark, d, "w_frames").select("frame_id")
    y = s.sample(x, 50, 7)
    return y.agg(F.count("*").alias("rows")).crossJoin(y.distinct().join(x, "frame_id", "left_semi").agg(F.count("*").alias("known")))


@query(sql("select job_id, updated_at from w_jobs order by updated_at desc, job_id desc limit 15", "w_jobs"))
def recently_updated_jobs(spark: SparkSession, d: str) -> DataFrame:
    return c.top(wide(spark, d, "w_jobs"), [F.desc("updated_at"), F.desc("job_id")], 15).select("job_id", "updated_at")


@query(sql("with r as (select detection_id, roi_index % 2 as model_id, refined_id, created_at, method as label from (select candidate_detection_id as detection_id, x.roi_index, refined_id, r.created_at, method from refined r join detections x on x.detection_id = r.candidate_detection_id)), b as (select * from (select *, row_number() over (partition by detection_id, model_id order by created_at desc, refined_id desc) as rn from r) where rn = 1) select d.detection_id, b.model_id, b.label from detections d left join b on b.detection_id = d.detection_id", "refined"))
def latest_classification(spark: SparkSession, d: str) -> DataFrame:
    x = t.detections(spark, d)
    r = t.refined(spark, d).join(x.select(F.col("detection_id").alias("candidate_detection_id"), "roi_index"), "candidate_detection_id")
    results = r.select(F.col("candidate_detection_id").alias("detection_id"), (F.col("roi_index") % 2).alias("model_id"), F.col("refined_id").alias("result_id"), "created_at", F.col("method").alias("label"))
    return s.latest_classifications(x.select("detection_id"), results).select("detection_id", "model_id", "label")


@query(sql("select collection, count(*) as asset_count from assets, unnest(collections) as u(collection) where collection ilike '%NATION_1%' group by 1", "assets"))
def collection_counts_like(spark: SparkSession, d: str) -> DataFrame:
    return c.collection_counts(t.assets(spark, d), "nation_1")


@query(sql("select doc_id, key in (select key from blobs where source = 'src3') as stored from blobs", "blobs"))
def payload_exists(spark: SparkSession, d: str) -> DataFrame:
    x = t.blobs(spark, d)
    return s.exists_by_key(x.select("doc_id", "key"), x.where("source = 'src3'")).select("doc_id", "stored")


@query(sql("select f.frame_id from w_frames f join w_assets a using (asset_id) where list_has_any(collections, ['BUILDING', 'NATION_3']) and frame_index between 1 and 4", "w_frames"))
def frames_by_collections(spark: SparkSession, d: str) -> DataFrame:
    a = st.in_any_collection(wide(spark, d, "w_assets"), ["BUILDING", "NATION_3"]).select("asset_id")
    return c.search(wide(spark, d, "w_frames").join(a, "asset_id", "left_semi"), ranges={"frame_index": (1, 4)}).select("frame_id")
