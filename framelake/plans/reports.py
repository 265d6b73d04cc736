"""Job, timing and payload-store queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators import blobs as b
from framelake.operators import jobs as j
from framelake.operators import quantiles as q
from framelake.operators import status as s
from framelake.operators.catalog import top
from framelake.sources import tables as t

from .catalogue import STATUS, status
from .register import query
from .twins import sql

NUMBER = "case when regexp_full_match(json_extract_string(progress, '$.{0}'), '-?\\d+(\\.\\d+)?') then cast(json_extract_string(progress, '$.{0}') as double) else 0 end"
SPREAD = "count({0}) as n, round(avg({0}), 4) as avg_{1}, round(quantile_cont({0}, 0.5), 4) as p50_{1}, round(quantile_cont({0}, 0.9), 4) as p90_{1}, round(quantile_cont({0}, 0.95), 4) as p95_{1}, round(max({0}), 4) as max_{1}, round(sum({0}), 2) as total_{1}"


@query(sql(f"with x as (select *, {NUMBER.format('completed')} as done, {NUMBER.format('total')} as wanted from jobs) select stage, status, grouping(stage, status) as level, count(*) as jobs, sum(done) as completed, sum(wanted) as total, round(100 * sum(done) / nullif(sum(wanted), 0), 4) as percent from x group by grouping sets ((), (stage), (status))", "jobs"))
def job_summary_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return j.summarize(t.jobs(spark, d))


@query(sql("""select asset_id, case when bool_or(status in ('failed', 'dead_lettered')) then 'failed' when bool_or(status = 'cancelled') then 'cancelled' when bool_or(status = 'leased') then 'running' when bool_or(status = 'paused') then 'paused' when bool_or(status = 'queued') then 'queued' when bool_and(status = 'succeeded') then 'completed' else 'registered' end as run_status, count(*) as jobs from jobs group by 1""", "jobs"))
def run_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return j.run_status(t.jobs(spark, d), "asset_id")


@query(sql("""with e as (select job_id, lag(job_id) over (partition by asset_id order by created_at, job_id) as depends_on from jobs)
select job_id, stage from jobs q where status = 'queued' and not exists (select 1 from e join jobs u on u.job_id = e.depends_on where e.job_id = q.job_id and u.status <> 'succeeded')""", "jobs"))
def job_ready_set(spark: SparkSession, d: str) -> DataFrame:
    x = t.jobs(spark, d)
    edges = x.select("job_id", F.lag("job_id").over(Window.partitionBy("asset_id").orderBy("created_at", "job_id")).alias("depends_on"))
    return j.ready(x, edges).select("job_id", "stage")


@query(sql("select worker_id, count(*) as events, count(*) filter (where event_type = 'click') as busy, max(created_at) >= timestamp '2024-01-01 00:00:00' as online from logs group by 1", "logs"))
def worker_overview(spark: SparkSession, d: str) -> DataFrame:
    return t.logs(spark, d).groupBy("worker_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "click").alias("busy"), (F.max("created_at") >= F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("online"))


@query(sql("""with s as (select 'u' || job_id % 97 as worker_id, max(created_at) as last_heartbeat, max_by(event_type, (created_at, id)) = 'click' as working from logs group by 1)
select 'queue' as part, status as name, count(*) as n from jobs group by 2 union all select 'workers', 'total', count(*) from s
union all select 'workers', 'online', count(*) from s where last_heartbeat >= (select max(created_at) from logs) - interval 10 hour union all select 'workers', 'busy', count(*) from s where working""", "jobs", "logs"))
def status_overview(spark: SparkSession, d: str) -> DataFrame:
    """The workers' sessions come from the log: last beat, and at work where the last event is a click."""
    x = t.logs(spark, d).withColumn("worker_id", F.concat(F.lit("u"), F.col("job_id") % 97))
    last = F.max_by("event_type", F.struct("created_at", "id"))
    sessions = x.groupBy("worker_id").agg(F.max("created_at").alias("last_heartbeat"), F.when(last == "click", "working").otherwise("idle").alias("status"))
    return j.status_overview(t.jobs(spark, d), sessions, F.lit(x.agg(F.max("created_at")).first()[0]), 5 * 3600)


@query(sql("select count(*) as logs, count(distinct worker_id) as workers, min(id) as first_id, max(id) as last_id, count(*) filter (where duration_ms > 50) as slow from logs", "logs"))
def report_overview(spark: SparkSession, d: str) -> DataFrame:
    return t.logs(spark, d).agg(F.count("*").alias("logs"), F.countDistinct("worker_id").alias("workers"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_if(F.col("duration_ms") > 50).alias("slow"))


@query(sql(f"select event_type, {SPREAD.format('duration_ms', 'ms')} from logs group by 1", "logs"))
def duration_by_event(spark: SparkSession, d: str) -> DataFrame:
    return q.spreads(t.logs(spark, d), ["event_type"], {"ms": "duration_ms"})


@query(sql(f"with x as (select stage, status, (epoch_us(started_at) - epoch_us(created_at)) / 1e6 as queue_s, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 as run_s from jobs) select stage, status, {SPREAD.format('queue_s', 'queue')}, {SPREAD.format('run_s', 'run').replace(' as n,', ' as n_run,')} from x group by 1, 2", "jobs"))
def job_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    x = t.jobs(spark, d).withColumns({"queue_s": j.seconds("started_at", "created_at"), "run_s": j.seconds("finished_at", "started_at")})
    return q.spreads(x, ["stage", "status"], {"queue": "queue_s", "run": "run_s"})


@query(sql(f"select coalesce(json_extract_string(payload, '$.stage'), 'unknown') as stage, worker_id, {SPREAD.format('duration_ms', 'ms')} from logs group by 1, 2", "logs"))
def handler_timing(spark: SparkSession, d: str) -> DataFrame:
    x = t.logs(spark, d).withColumn("stage", F.coalesce(F.get_json_object("payload", "$.stage"), F.lit("unknown")))
    return q.spreads(x, ["stage", "worker_id"], {"ms": "duration_ms"})


@query(sql("select event_type, sum(cast(coalesce(nullif(json_extract_string(payload, '$.units'), ''), nullif(json_extract_string(payload, '$.k'), '')) as double)) as units, round(sum(duration_ms), 2) as total_ms, round(sum(cast(json_extract_string(payload, '$.k') as double)) * 1000 / round(sum(duration_ms), 2), 4) as units_per_s from logs group by 1", "logs"))
def event_throughput(spark: SparkSession, d: str) -> DataFrame:
    return j.throughput(t.logs(spark, d), ["units", "k"])


@query(sql("select id, event_type, duration_ms from logs order by duration_ms desc, id limit 20", "logs"))
def slow_logs(spark: SparkSession, d: str) -> DataFrame:
    return top(t.logs(spark, d), [F.desc("duration_ms"), F.col("id")], 20).select("id", "event_type", "duration_ms")


@query(sql("select job_id, stage, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 as run_s from jobs where finished_at is not null order by run_s desc, job_id limit 20", "jobs"))
def slow_jobs(spark: SparkSession, d: str) -> DataFrame:
    x = t.jobs(spark, d).where("finished_at is not null").withColumn("run_s", j.seconds("finished_at", "started_at"))
    return top(x, [F.desc("run_s"), F.col("job_id")], 20).select("job_id", "stage", "run_s")


@query(sql("select id, event_type, worker_id from logs where event_type in ('error', 'purchase') order by created_at desc, id desc limit 15", "logs"))
def recent_errors(spark: SparkSession, d: str) -> DataFrame:
    return top(t.logs(spark, d).where(F.col("event_type").isin("error", "purchase")), [F.desc("created_at"), F.desc("id")], 15).select("id", "event_type", "worker_id")


@query(sql("with p as (select worker_id, event_type, sum(duration_ms) as ms, count(*) as n from logs group by 1, 2) select worker_id, event_type, n, round(ms / n, 4) as avg_ms, round(100 * ms / sum(ms) over (partition by worker_id), 4) as percent from p", "logs"))
def phase_timing(spark: SparkSession, d: str) -> DataFrame:
    return j.phases(t.logs(spark, d))


@query(sql("""with p as (select worker_id, event_type, sum(duration_ms) as ms, count(*) as n from logs where event_type <> 'error' group by 1, 2), w as (select worker_id, sum(duration_ms) as total_ms from logs group by 1),
u as (select worker_id, 'unattributed' as event_type, greatest(total_ms - coalesce(ms, 0), 0) as ms, 1 as n from w left join (select worker_id, sum(ms) as ms from p group by 1) using (worker_id)),
every as (select * from p union all select * from u)
select worker_id, event_type, n::bigint as n, round(ms / n, 4) as avg_ms, round(100 * ms / total_ms, 4) as percent from every join w using (worker_id)""", "logs"))
def phase_timing_totals(spark: SparkSession, d: str) -> DataFrame:
    """Errors are in the measured whole, but are no phase: their time is unattributed."""
    x = t.logs(spark, d)
    return j.phases(x.where("event_type <> 'error'"), x.groupBy("worker_id").agg(F.sum("duration_ms").alias("total_ms")))


@query(sql("select l.id, l.job_id, q.asset_id, case when regexp_matches(lower(event_type), 'failed|error|dead_lettered') then 'error' when regexp_matches(lower(event_type), 'retry|requeued|paused|shutdown') then 'warning' when regexp_matches(lower(event_type), 'heartbeat|touched|progress') then 'debug' else 'info' end as level, case when event_type like 'job.%' then 'Job event ' || event_type || coalesce(' for ' || stage, '') when event_type like 'worker.%' then 'Worker event ' || event_type || ' for ' || worker_id else replace(event_type, '.', ' ') end as message from (select id, job_id, worker_id, case when id % 3 = 0 then 'job.' || event_type when id % 3 = 1 then 'worker.heartbeat' else event_type || '.failed' end as event_type from logs) l left join jobs q on q.job_id = l.job_id", "logs", "jobs"))
def event_log_enrichment(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("id") % 3 == 0, F.concat(F.lit("job."), "event_type")).when(F.col("id") % 3 == 1, "worker.heartbeat").otherwise(F.concat("event_type", F.lit(".failed")))
    return j.enrich(t.logs(spark, d).withColumn("event_type", kind), t.jobs(spark, d))


@query(sql("select job_id, id from (select *, row_number() over (partition by job_id order by id desc) as rn from logs) where rn <= 3", "logs"))
def job_log_tail(spark: SparkSession, d: str) -> DataFrame:
    from framelake.operators.catalog import first_per_group

    x = t.logs(spark, d).withColumn("newest", -F.col("id"))
    return first_per_group(x, "job_id", ["newest"], 3).select("job_id", "id")


@query(sql("select refined_id, case when frame_id % 2 = 0 and bbox_x % 2 = 0 then 'many_to_many' when frame_id % 2 = 0 then 'split_child' when bbox_x % 2 = 0 then 'merge_keeper' else 'one_to_one' end as relationship from refined", "refined"))
def refinement_relationship(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("frame_id") % 2 == 0, F.col("candidate_detection_id")).otherwise("")
    eaten = F.when(F.col("bbox_x") % 2 == 0, F.array("candidate_detection_id")).otherwise(F.array().cast("array<string>"))
    meta = F.to_json(F.struct(split.alias("split_from_candidate_detection_id"), eaten.alias("consumed_candidate_detection_ids")))
    return t.refined(spark, d).select("refined_id", j.refinement_relationship(meta).alias("relationship"))


@query(sql(STATUS + """, w as (select frame_id, row_number() over (order by asset_id, frame_id) - 1 as unit from status where detection_count > 0 and refinement_status in ('unknown', 'failed'))
select unit // 100 as batch, count(*) as units, min(frame_id) as first_frame, max(frame_id) as last_frame from w group by 1""", "frames", "detections", "refined"))
def work_plan_batches(spark: SparkSession, d: str) -> DataFrame:
    x = status(spark, d).where("detection_count > 0 and refinement_status in ('unknown', 'failed')").select("asset_id", "frame_id")
    return s.work_batches(x, ["asset_id", "frame_id"], 100).groupBy("batch").agg(F.count("*").alias("units"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))


@query(sql("""with stored as (select key, max(sha256(case when doc_id % 50 = 0 then payload || '!' else payload end)) as have from (select *, row_number() over (partition by key order by doc_id) as rn from blobs where source = 'src0') where rn = 1 group by 1),
fresh as (select key, min(payload) as payload from blobs group by 1)
select fresh.key, strlen(payload) as size, case when have is null then 'stored' when have = fresh.key then 'kept' else 'conflict' end as action from fresh left join stored on stored.key = fresh.key""", "blobs"))
def blob_put_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The store holds one source's payloads, some of them with other bytes under their key."""
    x = t.blobs(spark, d)
    one = x.where("source = 'src0'").groupBy("key").agg(F.min_by("payload", "doc_id").alias("payload"), F.min("doc_id").alias("doc_id"))
    return b.put(x, one.select("key", F.when(F.col("doc_id") % 50 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")).alias("payload")))


@query("select page_id from pages where sha256(html) <> case when page_id % 10 = 0 then sha256(url) else sha256(html) end")
def blob_audit(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "pages")
    return b.audit(x.select("page_id", F.col("html").alias("payload"), F.when(F.col("page_id") % 10 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("key"))).select("page_id")


@query(sql("select substring(key, 1, 2) as prefix, count(*) as rows, cast(sum(strlen(payload)) as bigint) as bytes from blobs group by 1", "blobs"))
def blob_prefix_status(spark: SparkSession, d: str) -> DataFrame:
    return b.prefix_status(t.blobs(spark, d))


@query(sql("select key as ref from blobs group by key having min(source) = 'src3' and max(source) = 'src3'", "blobs"))
def blob_orphans(spark: SparkSession, d: str) -> DataFrame:
    return b.orphans(t.blobs(spark, d).select(F.col("key").alias("ref"), "source"), "source", "src3")


@query("select ref, count(*) as frames from (select unnest(list_distinct(['p' || l_partkey % 500, 'p' || l_suppkey % 500, ''])) as ref from lineitem) where ref <> '' group by 1")
def payload_refcount(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("frame_id"), F.concat(F.lit("p"), F.col("l_partkey") % 500).alias("a"), F.concat(F.lit("p"), F.col("l_suppkey") % 500).alias("b"), F.lit("").alias("c"))
    return b.reference_counts(x, ["a", "b", "c"])


@query(sql("select f.doc_id, strlen(b.payload) as size from (select doc_id, case when doc_id % 2 = 0 then sha256(text) end as first, case when doc_id % 3 = 0 then sha256(text) end as second from documents) f join (select key, min(payload) as payload from blobs group by 1) b on b.key = coalesce(first, second)", "blobs"))
def frame_payload_load(spark: SparkSession, d: str) -> DataFrame:
    x = t.blobs(spark, d)
    store = x.groupBy("key").agg(F.min("payload").alias("payload"))
    named = x.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("key")), F.when(F.col("doc_id") % 3 == 0, F.col("key"))).alias("key"))
    return named.where("key is not null").join(store, "key").select("doc_id", F.octet_length("payload").alias("size"))
