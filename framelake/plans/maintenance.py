"""Table upkeep as merges: each query returns the table's new state or a digest of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import blobs as b
from framelake.operators import jobs as j
from framelake.operators import maintain as m
from framelake.operators import raster as r
from framelake.operators import status as s
from framelake.sources import tables as t
from framelake.sources.wide import wide

from .catalogue import COUNTS, STATUS, counts, status
from .register import query
from .twins import sql


@query(sql("select asset_id, frame_index, case when frame_index = 2 then -frame_id else frame_id end as frame_id from frames", "frames"))
def merge_frames(spark: SparkSession, d: str) -> DataFrame:
    old = t.frames(spark, d).select("asset_id", "frame_index", "frame_id")
    return s.merge(old, old.where("frame_index = 2").withColumn("frame_id", -F.col("frame_id")), ["asset_id", "frame_index"])


@query(sql("select detection_id, frame_id, area from detections where frame_id % 5 <> 0 union all select detection_id || '/new', frame_id, area + 1 from detections where frame_id % 5 = 0 and roi_index = 1", "detections"))
def replace_detections(spark: SparkSession, d: str) -> DataFrame:
    x = t.detections(spark, d).select("detection_id", "frame_id", "roi_index", "area")
    new = x.where("frame_id % 5 = 0 and roi_index = 1").select(F.concat("detection_id", F.lit("/new")).alias("detection_id"), "frame_id", "roi_index", (F.col("area") + 1).alias("area"))
    gone = x.where("frame_id % 5 = 0").select("frame_id").distinct()
    return x.join(gone, "frame_id", "left_anti").unionByName(new).select("detection_id", "frame_id", "area")


@query(sql(COUNTS + " select a.asset_id, coalesce(count(c.frame_id), 0) as frames, cast(coalesce(sum(detection_count), 0) as bigint) as detections, cast(coalesce(sum(refined_count), 0) as bigint) as refined from assets a left join counts c on c.asset_id = a.asset_id group by 1", "frames", "detections", "refined", "assets"))
def delete_asset_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What the delete of each asset would take."""
    per = counts(spark, d).groupBy("asset_id").agg(F.count("*").alias("frames"), F.sum("detection_count").alias("detections"), F.sum("refined_count").alias("refined"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return t.assets(spark, d).select("asset_id").join(per, "asset_id", "left").select("asset_id", *map(zero, ("frames", "detections", "refined")))


@query(sql("select asset_id, case when run_id % 4 = 0 then 'retagged' else collections[1] || ',' || collections[2] end as collections from assets", "assets"))
def retag_collections(spark: SparkSession, d: str) -> DataFrame:
    a = t.assets(spark, d)
    tags = t.runs(spark, d).where("run_id % 4 = 0").select("run_id", F.array(F.lit("retagged")).alias("new"))
    return a.join(F.broadcast(tags), "run_id", "left").select("asset_id", F.array_join(F.coalesce("new", "collections"), ",").alias("collections"))


@query("select user_id as key, max_by(event_type, (ts, event_id)) as status, count(*) as events from events group by 1")
def stage_status_fold(spark: SparkSession, d: str) -> DataFrame:
    return s.latest_status(t.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("id")))


@query(sql("select f.frame_id, coalesce(case when f.frame_id % 7 = 0 then 'w' || cast(frame_index // 3 as varchar) end, 'none') as background from frames f", "frames"))
def assign_backgrounds(spark: SparkSession, d: str) -> DataFrame:
    f = t.frames(spark, d).select("frame_id", "frame_index")
    new = f.where("frame_id % 7 = 0").select("frame_id", F.concat(F.lit("w"), F.floor(F.col("frame_index") / 3).cast("string")).alias("background"))
    return f.join(new, "frame_id", "left").select("frame_id", F.coalesce("background", F.lit("none")).alias("background"))


@query(sql("select j.job_id from jobs j where status in ('queued', 'failed') and not exists (select 1 from jobs k where k.job_id = j.job_id + 1 and k.status = 'succeeded')", "jobs"))
def work_still_eligible(spark: SparkSession, d: str) -> DataFrame:
    x = t.jobs(spark, d)
    moved = x.where("status = 'succeeded'").select((F.col("job_id") - 1).alias("job_id"))
    return x.where("status in ('queued', 'failed')").join(moved, "job_id", "left_anti").select("job_id")


@query(sql(COUNTS + """, n as (select project_id, count(*) || '/' || coalesce(sum(detection_count), 0)::bigint as summary from counts c join assets a using (asset_id) group by 1),
old as (select r_regionkey as project_id, 3 as version, case when r_regionkey % 2 = 0 then 'old' else n.summary end as summary, case when r_regionkey % 3 < 2 then timestamp '2024-01-02 00:00:00' end as generated_at, case when r_regionkey = 1 then timestamp '2024-01-03 00:00:00' else timestamp '2024-01-01 00:00:00' end as updated_at from region left join n on project_id = r_regionkey),
f as (select old.*, n.summary as new_summary, coalesce(old.summary is not null and generated_at >= updated_at, false) or n.summary is null as kept from old left join n using (project_id))
select project_id, version + case when kept or new_summary is not distinct from summary then 0 else 1 end as version, case when kept then summary else new_summary end as summary, case when kept then generated_at else timestamp '2024-02-01 00:00:00' end as generated_at, updated_at from f""", "frames", "detections", "refined", "assets"))
def status_snapshot_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Fresh snapshots stay as they are, be they right or not; stale ones take today's summary."""
    per = counts(spark, d).join(t.assets(spark, d).select("asset_id", "project_id"), "asset_id").groupBy("project_id").agg(F.count("*").alias("n"), F.sum("detection_count").alias("m"))
    new = per.select("project_id", F.concat(F.col("n").cast("string"), F.lit("/"), F.col("m").cast("string")).alias("summary"))
    k, at = F.col("r_regionkey"), lambda day: F.lit(f"2024-{day} 00:00:00").cast("timestamp_ntz")
    old = t.table(spark, d, "region").join(new, k == F.col("project_id"), "left")
    old = old.select(k.alias("project_id"), F.lit(3).alias("version"), F.when(k % 2 == 0, "old").otherwise(F.col("summary")).alias("summary"), F.when(k % 3 < 2, at("01-02")).alias("generated_at"), F.when(k == 1, at("01-03")).otherwise(at("01-01")).alias("updated_at"))
    return s.refreshed(old, new, at("02-01"))


PLAN = STATUS + """, p as (select s.frame_id, s.asset_id, f.run_id, coalesce(f.payload_ref, '') as ref from status s join w_frames f using (frame_id) where preprocessing_status in ('unknown', 'failed')),
u as (select *, row_number() over (order by ref, cast(frame_id as varchar)) - 1 as unit from p)"""


def frame_plan(spark: SparkSession, d: str) -> DataFrame:
    wanted = status(spark, d).where(F.col("preprocessing_status").isin("unknown", "failed")).select("frame_id")
    units = wide(spark, d, "w_frames").join(wanted, "frame_id").select("frame_id", "asset_id", "run_id", "payload_ref")
    return s.work_plan(units, "frame_id", [F.coalesce("payload_ref", F.lit(""))], 100)


@query(sql(PLAN + """ select unit // 100 as batch, count(*) as units, case when min(asset_id) = max(asset_id) then min(asset_id) end as asset_id, case when min(run_id) = max(run_id) then min(run_id) end as run_id, string_agg(frame_id, ',' order by unit) as ids from u group by 1""", "frames", "detections", "refined", "w_frames"))
def work_plan_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The jobs of a preprocess plan, in the order of payload references, with what they share."""
    return s.planned_jobs(frame_plan(spark, d), "frame_id").withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query(sql(PLAN + """ select count(*) as matched_count, count(distinct unit // 100) as job_count, 100::bigint as largest_batch, (select string_agg(frame_id, ',' order by unit) from u where unit < 20) as sample_ids from u""", "frames", "detections", "refined", "w_frames"))
def work_plan_report(spark: SparkSession, d: str) -> DataFrame:
    return s.plan_report(frame_plan(spark, d), "frame_id").withColumn("sample_ids", F.array_join(F.transform("sample_ids", lambda i: i.cast("string")), ","))


@query(sql(PLAN + """ select frame_id, case when asset_id % 10 = 0 then null when frame_id % 4 = 0 then 'queued' when frame_id % 4 = 1 then 'failed' else 'unknown' end as status_now, asset_id % 10 <> 0 and frame_id % 4 <> 0 as eligible from u""", "frames", "detections", "refined", "w_frames"))
def work_plan_recheck(spark: SparkSession, d: str) -> DataFrame:
    """A plan's frames against the status that others have given them since; some are gone."""
    k = F.col("frame_id")
    now = t.frames(spark, d).where("asset_id % 10 <> 0").select("frame_id", F.when(k % 4 == 0, "queued").when(k % 4 == 1, "failed").otherwise("unknown").alias("status"))
    return s.still_eligible(frame_plan(spark, d).select("frame_id"), now, "frame_id", "status", ["unknown", "failed"])


@query(sql("""with b as (select distinct asset_id, (frame_index + 12) // 25 * 25 as c from images where exists (select 1 from images o where o.asset_id = images.asset_id and abs(o.frame_index - (images.frame_index + 12) // 25 * 25) <= 25))
select frame_id, asset_id, case when frame_id % 3 = 0 then 'kept' end as flatfield_ref, coalesce('bg-' || asset_id || '-' || c, 'none') as background_payload_ref from images left join b using (asset_id) where c is null or c = (frame_index + 12) // 25 * 25""", "images"))
def assign_window_backgrounds(spark: SparkSession, d: str) -> DataFrame:
    """Frames with the reference of their window's background set, and what else they have untouched."""
    i = t.images(spark, d)
    placed = r.window_assignment(i, r.mean_backgrounds(i, 25, 51), 25).where("has_window")
    new = placed.select("frame_id", F.concat_ws("-", F.lit("bg"), "asset_id", "centre").alias("background_payload_ref"), F.lit(None).cast("string").alias("flatfield_ref"))
    old = i.select("frame_id", "asset_id", F.when(F.col("frame_id") % 3 == 0, "kept").alias("flatfield_ref"), F.lit("none").alias("background_payload_ref"))
    return m.assigned(old, new, "frame_id")


@query(sql("""with w as (select asset_id, frame_index, frame_id, (frame_index + 12) // 25 * 25 as b, (frame_index + 4) // 9 * 9 as p from images)
select frame_id, asset_id, case when exists (select 1 from images o where o.asset_id = w.asset_id and abs(o.frame_index - b) <= 25) then b end as background_centre, case when exists (select 1 from images o where o.asset_id = w.asset_id and abs(o.frame_index - p) <= 1) then p end as profile_centre from w""", "images"))
def window_assignment_two_schedules(spark: SparkSession, d: str) -> DataFrame:
    i = t.images(spark, d)
    return r.window_assignments(i, r.mean_backgrounds(i, 25, 51), r.mean_profiles(i, 9, 3), 25, 9)


@query(sql("""with s as (select key, min(payload) as payload from blobs group by 1), f as (select doc_id, case when doc_id % 3 > 0 then sha256(text) end as a, case when doc_id % 2 = 0 then sha256(text) end as b, sha256(text) as meta, lead(sha256(text)) over (order by doc_id) as bg from documents)
select doc_id, coalesce(strlen(p.payload), 0) as size, coalesce(strlen(g.payload), 0) as background_size from f left join s p on p.key = coalesce(a, meta) left join s g on g.key = case when doc_id % 5 = 0 then meta end""", "blobs"))
def frame_load_with_background(spark: SparkSession, d: str) -> DataFrame:
    x = t.blobs(spark, d)
    store = x.groupBy("key").agg(F.min("payload").alias("payload"))
    frames = x.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("key")).alias("payload_ref"), F.concat(F.lit('{"payload_ref":"'), "key", F.lit('"}')).alias("metadata"), F.when(F.col("doc_id") % 5 == 0, F.col("key")).alias("background_payload_ref"))
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    return b.loaded(frames, store).select("doc_id", size("payload").alias("size"), size("background_payload").alias("background_size"))


@query(sql("""select 'first_log_at' as name, epoch_us(min(created_at)) as n from w_logs union all select 'last_log_at', epoch_us(max(created_at)) from w_logs union all select 'log_count', count(*) from w_logs union all select 'timed_log_count', count(duration_ms) from w_logs
union all select 'error_log_count', count(*) filter (level = 'error') from w_logs union all select 'warning_log_count', count(*) filter (level = 'warning') from w_logs union all select 'job_count', count(*) from jobs
union all select status || '_jobs', count(*) from jobs where status in ('succeeded', 'failed', 'queued') group by 1 union all select 'timed_jobs', count(*) filter (started_at is not null and finished_at is not null) from jobs
union all select 'worker_session_count', count(distinct worker_id) from w_logs union all select 'asset_count', count(*) from assets union all select 'frame_count', count(*) from frames union all select 'detection_candidate_count', count(*) from detections""", "w_logs", "jobs", "assets", "frames", "detections"))
def report_overview_counts(spark: SparkSession, d: str) -> DataFrame:
    logs = wide(spark, d, "w_logs")
    return j.report_overview(logs, t.jobs(spark, d), worker_session=logs.select("worker_id").distinct(), asset=t.assets(spark, d), frame=t.frames(spark, d), detection_candidate=t.detections(spark, d))
