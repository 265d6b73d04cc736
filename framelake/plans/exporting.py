"""Exports, registration, and the table upkeep that is not in maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import exports as e
from framelake.operators import maintain as m
from framelake.operators import search as s
from framelake.sources import tables as t
from framelake.sources.shared import new_folder, write_shared
from framelake.sources.wide import wide

from .register import query
from .twins import sql

#: The jobs of an asset or of its run, each once: a plain union, unlike the sums that Spark takes.
JOBS_OF = """jobs_of as (select distinct a, job_id, status, stage, updated_at from (select asset_id as a, job_id, status, stage, updated_at from w_jobs where asset_id is not null
union all select x.asset_id, j.job_id, j.status, j.stage, j.updated_at from w_jobs j join w_assets x on x.run_id = j.run_id)),
job as (select a as asset_id, count(*) as job_count, max_by(status, (updated_at, job_id)) as latest_job_status, max_by(stage, (updated_at, job_id)) as latest_job_stage, max(updated_at) as latest_job_updated_at from jobs_of group by 1)"""
TIME = "case when epoch_us({0}) % 1000000 = 0 then strftime({0}, '%Y-%m-%d %H:%M:%S') else strftime({0}, '%Y-%m-%d %H:%M:%S.%f') end as {1}"
JOB_COLUMNS = "coalesce(job_count, 0) as job_count, latest_job_status, latest_job_stage, " + TIME.format("latest_job_updated_at", "latest_job_updated_at")


@query(sql(f"with {JOBS_OF} select a.asset_id, {JOB_COLUMNS} from w_assets a left join job using (asset_id)", "w_jobs"))
def asset_job_summary(spark: SparkSession, d: str) -> DataFrame:
    return e.rendered(e.job_summaries(wide(spark, d, "w_assets"), wide(spark, d, "w_jobs")))


@query(sql(f"""with {JOBS_OF} select f.frame_id, f.run_id, f.asset_id, a.filename as asset_filename, a.path as asset_path, a.kind as asset_kind, to_json(a.collections) as asset_collections, a.size_bytes as asset_size_bytes, a.media_count as asset_media_count,
r.run_key, r.instrument, r.source_type, r.status as run_status, f.frame_index, f.width, f.height, f.bbox_x, f.bbox_y, f.parent_frame_id, f.source_ref, {", ".join("f." + c for c in e.PAYLOADS)}, to_json(f.flatfield_profile) as flatfield_profile,
f.metadata as frame_metadata, f.preprocessed_metadata, f.background_metadata, f.flatfield_metadata, {TIME.format("f.created_at", "frame_created_at")}, {JOB_COLUMNS}
from w_frames f join w_assets a on a.asset_id = f.asset_id join w_runs r on r.run_id = f.run_id left join job on job.asset_id = a.asset_id""", "w_frames", "w_jobs"))
def export_frame_metadata_full(spark: SparkSession, d: str) -> DataFrame:
    w = lambda n: wide(spark, d, f"w_{n}")
    return e.rendered(e.frame_metadata(w("frames"), w("assets"), w("runs"), w("jobs")))


@query(sql(f"""with {JOBS_OF}, best as (select * from (select *, row_number() over (partition by candidate_detection_id order by created_at desc, refined_id desc) as rn from w_refined) where rn = 1)
select x.detection_id, x.run_id, x.frame_id, x.asset_id, a.filename as asset_filename, a.path as asset_path, a.kind as asset_kind, to_json(a.collections) as asset_collections, r.run_key, x.frame_index, x.roi_index, {", ".join("x." + c for c in e.BOXES + e.MEASURES + e.IMAGES)},
cast(strlen(roi_payload) as integer) as roi_payload_bytes, cast(strlen(mask_payload) as integer) as mask_payload_bytes, x.metadata as detection_metadata, {TIME.format("x.created_at", "detection_created_at")}, b.refined_id as refined_detection_id, b.refinement_method as refined_method, {TIME.format("b.created_at", "refined_created_at")}, {JOB_COLUMNS}
from w_detections x join w_assets a on a.asset_id = x.asset_id join w_runs r on r.run_id = x.run_id left join best b on b.candidate_detection_id = x.detection_id left join job on job.asset_id = x.asset_id""", "w_refined", "w_jobs"))
def export_roi_metadata_full(spark: SparkSession, d: str) -> DataFrame:
    parts = t.parts(spark, d, "orders", "lineitem")
    w = lambda n: wide(spark, d, f"w_{n}", parts)
    return e.rendered(e.roi_metadata(w("detections"), w("frames"), w("assets"), w("runs"), w("refined"), w("jobs")))


@query('select \'nation\' as "table", count(*) as rows from nation union all select \'orders\', count(*) from orders union all select \'part\', count(*) from part')
def export_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as CSV, read back and counted."""
    return e.export_tables({n: t.table(spark, d, n) for n in ("nation", "orders", "part")}, new_folder(spark), "csv")


@query(sql("select 'runs' as kind, count(distinct run_id) as rows from w_assets union all select 'assets', count(*) from (select distinct run_id, filename from w_assets) union all select 'jobs', 2 * count(*) from (select distinct run_id, filename from w_assets)", "w_assets"))
def register_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The assets as manifests of their runs, each registered twice over."""
    a = wide(spark, d, "w_assets")
    runs = a.groupBy("run_id", "project_id").agg(F.collect_list(F.struct("filename", "kind", "size_bytes")).alias("assets"), F.flatten(F.collect_list(F.array(*[F.struct("filename", F.lit(x).alias("stage")) for x in ("ingest", "segment")]))).alias("jobs"))
    manifest = runs.select(F.col("run_id").cast("string").alias("run_key"), "project_id", "assets", "jobs")
    made = e.register_manifest(manifest.unionByName(manifest))
    count = lambda n: made[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("kind"), "rows")
    return count("runs").unionByName(count("assets")).unionByName(count("jobs"))


@query(sql("select refined_id from refined union all select refined_id || '/again' from refined where frame_id % 3 = 0", "refined"))
def append_refined(spark: SparkSession, d: str) -> DataFrame:
    x = t.refined(spark, d).select("refined_id", "frame_id")
    return m.append(x, x.where("frame_id % 3 = 0").select(F.concat("refined_id", F.lit("/again")).alias("refined_id"), F.lit("job-7").alias("job_id"))).select("refined_id")


@query(sql("select detection_id, cast(1 as bigint) as model_id, case when roi_index = 2 then 'new' else 'old' end as label from detections union all select detection_id, 2, 'old' from detections", "detections"))
def replace_classifications(spark: SparkSession, d: str) -> DataFrame:
    x = t.detections(spark, d).select("detection_id", "roi_index")
    old = x.select("detection_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("model_id"), F.lit("old").alias("label"))
    return m.replace_keys(old, x.where("roi_index = 2").select("detection_id", F.lit(1).cast("long").alias("model_id"), F.lit("new").alias("label")), ["detection_id", "model_id"])


@query(sql("select frame_id, asset_id, case when frame_id % 2 = 0 then 'failed' else 'unknown' end as detection_status from frames union all select -frame_id, asset_id, 'failed' from frames where frame_id % 10 = 0", "frames"))
def ensure_status_rows(spark: SparkSession, d: str) -> DataFrame:
    f = t.frames(spark, d).select("frame_id", "asset_id")
    old = f.where("frame_id % 2 = 0").select("frame_id", (F.col("asset_id") + 1).alias("asset_id"), F.lit("failed").alias("detection_status"))
    gone = f.where("frame_id % 10 = 0").select((-F.col("frame_id")).alias("frame_id"), "asset_id", F.lit("failed").alias("detection_status"))
    return m.ensure_rows(old.unionByName(gone), f, "frame_id", ["asset_id"], {"detection_status": "unknown"})


@query(sql("select frame_id, asset_id from frames where asset_id % 5 <> 0 union all select frame_id + 1000000, asset_id from frames where asset_id % 5 = 0 and frame_index = 1", "frames"))
def replace_frames_of_asset(spark: SparkSession, d: str) -> DataFrame:
    f = t.frames(spark, d).select("frame_id", "asset_id", "frame_index")
    new = f.where("asset_id % 5 = 0 and frame_index = 1").withColumn("frame_id", F.col("frame_id") + 1000000)
    return m.replace_keys(f, new, ["asset_id"]).select("frame_id", "asset_id")


@query(sql("select distinct job_id, unnest([cast(job_id as varchar), cast(job_id - 1 as varchar)]) as frame_id from w_jobs union select j.job_id, cast(d.frame_id as varchar) from w_jobs j join w_detections d on d.frame_id = j.job_id and d.roi_index = 1", "w_jobs", "w_detections"))
def job_affected_frames(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that name frames, and jobs that name detections."""
    parts = t.parts(spark, d, "orders", "lineitem")
    j, x = wide(spark, d, "w_jobs", parts).select("job_id", "payload"), wide(spark, d, "w_detections", parts)
    named = x.where("roi_index = 1").select(F.col("frame_id").alias("job_id"), F.to_json(F.struct(F.array("detection_id").alias("detection_ids"))).alias("payload"))
    return m.affected_frames(j.unionByName(named), x, parts)


@query(sql("""with x as (select *, row_number() over (order by asset_id, frame_id) as n, row_number() over (partition by asset_id order by frame_id) as k from w_frames where frame_index <= 2 and json_extract_string(metadata, '$.live_preview.is_sandbox') is distinct from 'true')
select (select max(frame_id) from w_frames) + n as frame_id, asset_id, cast(-k as integer) as frame_index, frame_id as parent_frame_id, payload_ref, cast(frame_id as varchar) as source from x""", "w_frames"))
def sandbox_copy(spark: SparkSession, d: str) -> DataFrame:
    f = wide(spark, d, "w_frames")
    x = s.sandbox_copies(m.sandbox_copy(f, f.where("frame_index <= 2"), "mask"), operation="mask")
    return x.select("frame_id", "asset_id", "frame_index", "parent_frame_id", "payload_ref", F.get_json_object("metadata", "$.live_preview.source_frame_id").alias("source"))


@query(sql("select payload_ref from w_frames group by 1 having bool_and(frame_id % 500 < 40 or asset_id % 2 = 0)", "w_frames"))
def sandbox_delete_orphans(spark: SparkSession, d: str) -> DataFrame:
    f = wide(spark, d, "w_frames")
    return m.delete_copies(f, f.where("frame_id % 500 < 40 or asset_id % 2 = 0"))[1]


@query(sql("""with gone as (select asset_id from w_assets where run_id = 3), refs as (select asset_id, unnest([payload_ref, preprocessed_payload_ref, background_payload_ref]) as ref from w_frames)
select 'assets' as kind, count(*) as rows from w_assets where run_id <> 3 union all select 'frames', count(*) from w_frames where asset_id not in (from gone) union all select 'detections', count(*) from w_detections where asset_id not in (from gone)
union all select 'refined', count(*) from w_refined join w_frames using (frame_id) where asset_id not in (from gone) union all select 'jobs', count(*) from w_jobs where asset_id is null or asset_id not in (from gone)
union all select 'orphans', count(*) from (select ref from refs where ref is not null group by 1 having bool_and(asset_id in (from gone)))""", "w_refined", "w_jobs"))
def delete_assets(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table without one run's assets, and the payloads that go with them."""
    w = {n: wide(spark, d, f"w_{n}") for n in ("assets", "frames", "detections", "refined", "jobs")}
    left = m.delete_assets(w, w["assets"].where("run_id = 3").select("asset_id"))
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("kind"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("select frame_id, case when run_id % 4 = 0 then 'retagged' else collections[1] || ',' || collections[2] end as collections from frames join assets using (asset_id)", "frames", "assets"))
def retagged_projection(spark: SparkSession, d: str) -> DataFrame:
    a = t.assets(spark, d).withColumn("collections", F.when(F.col("run_id") % 4 == 0, F.array(F.lit("retagged"))).otherwise(F.col("collections")))
    projection = t.frames(spark, d).select("frame_id", "asset_id", F.array().cast("array<string>").alias("collections"))
    return m.retagged_projection(projection, a).select("frame_id", F.array_join("collections", ",").alias("collections"))


@query(sql("select coalesce(b.frame_id, p.frame_id) as frame_id, background, profile from (select frame_id, 'b' || frame_index as background from frames where frame_id % 2 = 0) b full join (select frame_id, 'p' || frame_index as profile from frames where frame_id % 3 = 0) p on b.frame_id = p.frame_id", "frames"))
def merge_assignments(spark: SparkSession, d: str) -> DataFrame:
    f = t.frames(spark, d)
    of = lambda n, k: f.where(f"frame_id % {k} = 0").select("frame_id", F.concat(F.lit(n[0]), F.col("frame_index").cast("string")).alias(n))
    return m.merged_assignments(of("background", 2), of("profile", 3), "frame_id")


@query(sql("with w as (select asset_id, frame_index // 3 * 3 as centre, count(*) as n from frames group by 1, 2) select asset_id, cast(centre as bigint) as centre from w where asset_id % 2 = 1 or centre > 6", "frames"))
def missing_windows(spark: SparkSession, d: str) -> DataFrame:
    from framelake.operators.raster import missing_windows as left

    fixed = [F.lit(3).alias("stride"), F.lit(5).alias("window"), F.lit(8).alias("width"), F.lit(8).alias("height")]
    x = t.frames(spark, d).select("asset_id", (F.floor(F.col("frame_index") / 3) * 3).cast("long").alias("centre"), *fixed).distinct()
    made = write_shared(x.where("asset_id % 2 = 0 and centre <= 6"))
    other = x.withColumn("window", F.lit(7))
    return left(x, made.unionByName(other)).select("asset_id", "centre")
