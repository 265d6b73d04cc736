"""Streaming queries, driven once over the events that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import jobs as j
from framelake.operators import raster as r
from framelake.sources import tables as t
from framelake.sources.shared import new_folder
from framelake.streaming import stateful as sf
from framelake.streaming import streams as st

from .register import query
from .twins import sql


@query("select w as window_start, event_type, count(*) as n, round(avg(value), 6) as mean from (select event_type, value, cast(floor(epoch(ts) / 1500) as bigint) * 1500 - unnest([0, 1500, 3000]) as w from events) group by 1, 2")
def stream_mean_field(spark: SparkSession, d: str) -> DataFrame:
    """All windows come from the stream: an event at the end of input lets the watermark pass the last of them."""
    how = ("75 minutes", "25 minutes", "10 minutes")
    events = st.ended(st.event_stream(spark, d), t.table(spark, d, "events"), "1 day")
    return st.run_once(st.hopping_mean(events, *how), "append").where(F.col("event_type") != st.END)


@query(sql("""with a as (select distinct asset_id, (frame_index + 12) // 25 * 25 as centre from images)
select a.asset_id, centre, pos, cast(round_even(avg(v), 0) as integer) as background, count(*) as frames from a join pixels p on p.asset_id = a.asset_id and p.frame_index between centre - 25 and centre + 25 group by 1, 2, 3""", "pixels"))
def stream_frame_windows(spark: SparkSession, d: str) -> DataFrame:
    """Mean frames of overlapping windows by frame index, from a stream in four steps and its assets' ends."""
    x = frames_in_order(spark, d)
    windows = sf.run_state(sf.frame_windows(sf.replayed([*sf.in_steps(x, "arrival", 4), sf.with_ends(x)], "asset_id"), 25, 51))
    return windows.where("kind = 'window' and frames > 0").select("asset_id", "centre", F.posexplode("background").alias("pos", "background"), "frames").withColumn("pos", F.col("pos").cast("long"))


@query(sql("""with a as (select distinct asset_id, (frame_index + 2) // 5 * 5 as centre from images)
select a.asset_id, centre, x, round(avg(v), 6) as profile, count(distinct frame_index) as frames from a join pixels p on p.asset_id = a.asset_id and p.frame_index between centre - 1 and centre + 1 group by 1, 2, 3""", "pixels"))
def stream_frame_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Mean column profiles with a stride above the width, so that some frames feed no window."""
    x = frames_in_order(spark, d)
    windows = sf.run_state(sf.frame_windows(sf.replayed([*sf.in_steps(x, "arrival", 3), sf.with_ends(x)], "asset_id"), 5, 3))
    rows = windows.where("kind = 'window' and profile_frames > 0").select("asset_id", "centre", F.posexplode("profile").alias("x", "profile"), F.col("profile_frames").alias("frames"))
    return rows.withColumns({"x": F.col("x").cast("long"), "profile": F.round("profile", 6)})


def frames_in_order(spark: SparkSession, d: str) -> DataFrame:
    return t.images(spark, d).select("asset_id", F.col("frame_index").alias("arrival"), "frame_index", "width", "height", "pixels", F.lit(False).alias("ended"))


@query(sql("""with a as (select id as arrival, worker_id as asset_id, cast(floor(duration_ms * 1000) as bigint) as frame_index from logs),
p as (select *, max(frame_index) over (partition by asset_id order by arrival rows between unbounded preceding and 1 preceding) as previous from a)
select asset_id, frame_index, previous from p where frame_index <= previous""", "logs"))
def stream_frame_order(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose index does not rise over the last one taken, found in the stream by state."""
    x = t.logs(spark, d).select(F.col("worker_id").alias("asset_id"), F.col("id").alias("arrival"), F.floor(F.col("duration_ms") * 1000).alias("frame_index"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("array<int>").alias("pixels"), F.lit(False).alias("ended"))
    found = sf.run_state(sf.frame_windows(sf.replayed(sf.in_steps(x, "arrival", 3), "asset_id"), 1, 1, strict=False))
    return found.where("kind = 'disorder'").select("asset_id", "frame_index", "previous")


@query(sql("""with b as (select user_id % 40 as worker_id, epoch_us(ts) // 1000 as ms from events),
n as (select *, lead(ms) over w as later, lag(ms) over w as before from b window w as (partition by worker_id order by ms))
select worker_id, ms, true as online from n where before is null or ms > before + 7200000 union all select worker_id, ms + 7200000, false from n where later is null or later > ms + 7200000"""))
def stream_worker_transitions(spark: SparkSession, d: str) -> DataFrame:
    """When workers come online and go silent, from a stream of beats in four steps; timers tell of the silence."""
    interval, steps = 3600, 4
    beats = t.table(spark, d, "events").select((F.col("user_id") % 40).alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"))
    low, high = beats.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    if low is None:
        return spark.createDataFrame([], "worker_id long, ms long, online boolean")
    # A step's files come in any order, so a beat may be late by a step.
    delay = (high - low) // steps + 60
    last = spark.range(1).select(F.lit(-1).cast("long").alias("worker_id"), F.timestamp_seconds(F.lit(high + 2 * interval + delay + 60)).alias("ts"))
    found = sf.run_state(sf.liveness(sf.replayed([*sf.in_steps(beats, "ts", steps), last]), interval, f"{delay} seconds"))
    return found.where("worker_id >= 0")


STAGE_CHANGES = """select event_id as id, ts as moment, user_id % 500 as frame_id, case event_type when 'view' then 'preprocess_frames' when 'click' then 'segment' else 'roi_refinement' end as stage,
  (['queued', 'leased', 'working', 'succeeded', 'failed'])[event_id % 5 + 1] as status, user_id as job_id, case when event_type = 'click' then cast(floor(value) as bigint) end as candidate_detection_count,
  case when event_type not in ('view', 'click') and event_id % 2 = 0 then event_id % 7 end as refined_detection_count from events"""


def stage_changes(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events")
    view, click = F.col("event_type") == "view", F.col("event_type") == "click"
    stage = F.when(view, "preprocess_frames").when(click, "segment").otherwise("roi_refinement")
    status = F.element_at(F.array(*map(F.lit, ("queued", "leased", "working", "succeeded", "failed"))), (F.col("event_id") % 5 + 1).cast("int"))
    counts = [F.when(click, F.floor("value")).alias("candidate_detection_count"), F.when(~view & ~click & (F.col("event_id") % 2 == 0), F.col("event_id") % 7).alias("refined_detection_count"), F.lit(None).cast("long").alias("unrefined_candidate_count")]
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("user_id") % 500).alias("frame_id"), stage.alias("stage"), status.alias("status"), F.col("user_id").alias("job_id"), *counts)


@query(f"""with c as ({STAGE_CHANGES}), l as (select frame_id, stage, max_by({{'status': status, 'job_id': job_id, 'completed_at': case when status = 'succeeded' then moment end}}, (moment, id)) as last,
  max_by(candidate_detection_count, (moment, id)) filter (candidate_detection_count is not null) as candidates, max_by(refined_detection_count, (moment, id)) filter (refined_detection_count is not null) as refined, max(moment) as seen from c group by 1, 2)
select frame_id, coalesce(max(last.status) filter (stage = 'preprocess_frames'), 'unknown') as preprocessing_status, max(last.job_id) filter (stage = 'preprocess_frames') as preprocessing_job_id, max(last.completed_at) filter (stage = 'preprocess_frames') as preprocessing_completed_at,
  coalesce(max(last.status) filter (stage = 'segment'), 'unknown') as candidate_detection_status, max(last.job_id) filter (stage = 'segment') as candidate_detection_job_id, max(last.completed_at) filter (stage = 'segment') as candidate_detection_completed_at,
  coalesce(max(last.status) filter (stage = 'roi_refinement'), 'unknown') as roi_refinement_status, max(last.job_id) filter (stage = 'roi_refinement') as roi_refinement_job_id, max(last.completed_at) filter (stage = 'roi_refinement') as roi_refinement_completed_at,
  coalesce(greatest(max(candidates), 0), 0) as candidate_detection_count, coalesce(max(refined), 0) as refined_detection_count, 0::bigint as unrefined_candidate_count, max(seen) as updated_at from l group by 1""")
def stream_stage_status(spark: SparkSession, d: str) -> DataFrame:
    """The projection kept current by a stream of changes in five steps; one of them is run twice, as after a failure."""
    changes = stage_changes(spark, d)
    projection = sf.Projection(spark, new_folder(spark), changes, every=3)

    def write(batch: DataFrame, batch_id: int) -> None:
        projection.write(batch, batch_id)
        if batch_id % 2 == 1:
            projection.write(batch, batch_id)

    sf.run_batches(sf.replayed(sf.in_steps(changes, "id", 5)), write, f"{new_folder(spark)}/checkpoint")
    return projection.frames()


@query("select event_id, event_type, user_id from events where event_id > 5000")
def stream_event_tail(spark: SparkSession, d: str) -> DataFrame:
    return st.run_once(st.tail_after(st.event_stream(spark, d), 5000), "append")


@query("select user_id, max_by(event_type, (ts, event_id)) as status, count(*) as events from events group by 1")
def stream_status_latest(spark: SparkSession, d: str) -> DataFrame:
    return st.run_once(st.current_status(st.event_stream(spark, d)), "complete")


@query("with p as (select user_id, max(cast(json_extract_string(props, '$.k') as bigint)) as done, cast(max(ceil(value)) as bigint) as total from events group by 1) select *, case when total > 0 then round(least(100.0, 100 * done / total), 4) end as percent from p")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    return st.run_once(st.progress(st.event_stream(spark, d)), "complete")


@query("with w as (select user_id % 8 as worker, cast(floor(epoch(max(ts))) as bigint) as last_seen, count(*) as beats from events group by 1) select *, last_seen >= (select max(last_seen) from w) - 2 * 30 as online from w")
def stream_workers(spark: SparkSession, d: str) -> DataFrame:
    w = st.run_once(st.workers_online(st.event_stream(spark, d)), "complete")
    return st.online(w, w.agg(F.max("last_seen")).first()[0] or 0, 30)


@query(sql("with a as (select id as arrival, worker_id as asset_id, cast(floor(duration_ms * 1000) as bigint) as frame_index from logs), p as (select *, lag(frame_index) over (partition by asset_id order by arrival) as previous from a) select asset_id, arrival, frame_index, previous from p where frame_index <= previous", "logs"))
def stream_order_audit(spark: SparkSession, d: str) -> DataFrame:
    x = t.logs(spark, d).select(F.col("id").alias("arrival"), F.col("worker_id").alias("asset_id"), F.floor(F.col("duration_ms") * 1000).alias("frame_index"))
    return st.order_violations(x)


@query(sql("select frame_id, cast(sum(255 - case when x between 1 and 6 and y between 1 and 5 then v else 128 end) as bigint) as total, count(*) as size, 'mask,invert_intensity' as steps from pixels group by 1", "pixels"))
def stream_frames_stored(spark: SparkSession, d: str) -> DataFrame:
    """Arriving frames through masking and inversion to the stored table, as a stream."""
    raw = st.table_stream(spark, d, "embeddings")
    inside = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when((i % 8).between(1, 6) & F.floor(i / 8).between(1, 5), 255).otherwise(0))
    masked = lambda x: x.withColumn("mask", inside)
    chain = lambda x: r.preprocess(x, fill=128)
    done = st.run_once(st.stored_frames(t.as_images(raw), masked, chain), "append")
    return done.select("frame_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), (F.col("width") * F.col("height")).cast("long").alias("size"), "steps")


@query(sql("select l.id, l.job_id, q.asset_id, case when event_type = 'error' then 'error' else 'info' end as level, event_type as message from logs l left join jobs q on q.job_id = l.job_id", "logs", "jobs"))
def stream_event_enrichment(spark: SparkSession, d: str) -> DataFrame:
    e = st.event_stream(spark, d).select(F.col("event_id").alias("id"), (F.col("user_id") % 1500 + 1).alias("job_id"), "event_type", F.lit("").alias("worker_id"))
    return st.run_once(j.enrich(e, t.jobs(spark, d)), "append")
