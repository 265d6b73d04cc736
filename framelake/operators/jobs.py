"""Job summaries, timing reports and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def progress_number(key: str) -> Column:
    """A counter of the progress JSON; what is no number counts as 0."""
    text = F.get_json_object("progress", f"$.{key}")
    return F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.cast("double")).otherwise(F.lit(0.0))


def summarize(jobs: DataFrame) -> DataFrame:
    """Totals, by stage and by status, with progress sums, in one GROUPING SETS pass."""
    x = jobs.withColumns({"done": progress_number("completed"), "wanted": progress_number("total")})
    sets = x.groupingSets([[], ["stage"], ["status"]], "stage", "status")
    out = sets.agg(F.grouping_id().alias("level"), F.count("*").alias("jobs"), F.sum("done").alias("completed"), F.sum("wanted").alias("total"))
    return out.withColumn("percent", F.when(F.col("total") > 0, F.round(100 * F.col("completed") / F.col("total"), 4)))


def status_overview(jobs: DataFrame, sessions: DataFrame, now: Column, interval: int) -> DataFrame:
    """(part, name, n): jobs by status, and all workers, those online, by a beat in the last two intervals (seconds), and those at work."""
    alive = F.unix_micros(F.col("last_heartbeat").cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - 2_000_000 * interval
    counts = sessions.agg(F.count("*").alias("total"), F.count_if(alive).alias("online"), F.count_if(F.col("status") == "working").alias("busy"))
    workers = counts.unpivot([], ["total", "online", "busy"], "name", "n").select(F.lit("workers").alias("part"), "name", "n")
    return jobs.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n")).select(F.lit("queue").alias("part"), "name", "n").unionByName(workers)


def report_overview(logs: DataFrame, jobs: DataFrame, **tables: DataFrame) -> DataFrame:
    """(name, n) of a report's head: logs with their first and last time (microseconds), those with a duration, errors and warnings; jobs by state; and the rows of each other table."""
    level = lambda v: F.count_if(F.col("level") == v)
    state = lambda v: F.count_if(F.col("status") == v)
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    parts = [
        logs.agg(at(F.min("created_at")).alias("first_log_at"), at(F.max("created_at")).alias("last_log_at"), F.count("*").alias("log_count"), F.count("duration_ms").alias("timed_log_count"), level("error").alias("error_log_count"), level("warning").alias("warning_log_count")),
        jobs.agg(F.count("*").alias("job_count"), state("succeeded").alias("succeeded_jobs"), state("failed").alias("failed_jobs"), state("queued").alias("queued_jobs"), F.count_if(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()).alias("timed_jobs")),
        *[x.agg(F.count("*").alias(f"{name}_count")) for name, x in tables.items()],
    ]
    long = [p.unpivot([], p.columns, "name", "n") for p in parts]
    out = long[0]
    for p in long[1:]:
        out = out.unionByName(p)
    return out


def run_status(jobs: DataFrame, key: str) -> DataFrame:
    """A run's status from its jobs' statuses; a running mix without a rule is 'registered'."""
    has = lambda *s: F.coalesce(F.max(F.col("status").isin(*s)), F.lit(False))
    x = jobs.groupBy(key).agg(has("failed", "dead_lettered").alias("failed"), has("cancelled").alias("cancelled"), has("leased").alias("leased"), has("paused").alias("paused"), has("queued").alias("queued"), F.min(F.col("status") == "succeeded").alias("all_done"), F.count("*").alias("jobs"))
    ladder = F.when(F.col("failed"), "failed").when(F.col("cancelled"), "cancelled").when(F.col("leased"), "running").when(F.col("paused"), "paused").when(F.col("queued"), "queued").when(F.col("all_done"), "completed").otherwise("registered")
    return x.select(key, ladder.alias("run_status"), "jobs")


def ready(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """Queued jobs without an unfinished upstream job."""
    open_ = edges.join(jobs.select(F.col("job_id").alias("depends_on"), F.col("status").alias("up_status")), "depends_on").where("up_status <> 'succeeded'")
    return jobs.where("status = 'queued'").join(open_, "job_id", "left_anti")


def seconds(later: str, earlier: str) -> Column:
    return (F.unix_micros(F.col(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))) / 1e6


def throughput(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Units and units per second of each event, units from the first non-empty key; events without units are left out."""
    units = F.coalesce(*[F.nullif(F.get_json_object("payload", f"$.{k}"), F.lit("")) for k in keys]).cast("double")
    x = logs.withColumn("units", units).groupBy("event_type").agg(F.sum("units").alias("units"), F.round(F.sum("duration_ms"), 2).alias("total_ms")).where("units is not null")
    return x.withColumn("units_per_s", F.when(F.col("total_ms") > 0, F.round(F.col("units") * 1000 / F.col("total_ms"), 4)))


def phases(logs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Time of each phase within its worker, and its share of the worker's total.

    totals (worker_id, total_ms), if given, is the measured whole; what no phase
    accounts for is then a phase of its own, 'unattributed'.
    """
    per = logs.groupBy("worker_id", "event_type").agg(F.sum("duration_ms").alias("ms"), F.count("*").alias("n"))
    measured = per.groupBy("worker_id").agg(F.sum("ms").alias("worker_ms"))
    if totals is not None:
        whole = measured.join(totals, "worker_id").select("worker_id", F.col("total_ms").alias("worker_ms"), F.greatest(F.col("total_ms") - F.col("worker_ms"), F.lit(0.0)).alias("ms"))
        per = per.unionByName(whole.select("worker_id", F.lit("unattributed").alias("event_type"), "ms", F.lit(1).cast("long").alias("n")))
        measured = whole.select("worker_id", "worker_ms")
    return per.join(measured, "worker_id").select("worker_id", "event_type", "n", F.round(F.col("ms") / F.col("n"), 4).alias("avg_ms"), F.round(100 * F.col("ms") / F.col("worker_ms"), 4).alias("percent"))


def event_level(event: Column) -> Column:
    e = F.lower(event)
    return F.when(e.rlike("failed|error|dead_lettered"), "error").when(e.rlike("retry|requeued|paused|shutdown"), "warning").when(e.rlike("heartbeat|touched|progress"), "debug").otherwise("info")


def event_message(event: Column, stage: Column, worker: Column) -> Column:
    named = lambda kind, who: F.concat(F.lit(f"{kind} event "), event, F.coalesce(F.concat(F.lit(" for "), F.nullif(who, F.lit(""))), F.lit("")))
    return F.when(event.startswith("job."), named("Job", stage)).when(event.startswith("worker."), named("Worker", worker)).otherwise(F.replace(event, F.lit("."), F.lit(" ")))


def enrich(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events with what their job knows, a level and a message; works on streams too.

    What an event has itself of project_id, run_id, asset_id and, in its
    payload, stage comes before what its job has.
    """
    names = [c for c in ("project_id", "run_id", "asset_id") if c in jobs.columns]
    known = jobs.select("job_id", *[F.col(c).alias(f"job_{c}") for c in names], F.col("stage").alias("job_stage"))
    x = events.join(known, "job_id", "left")
    own = lambda c: F.coalesce(F.col(c), F.col(f"job_{c}")) if c in events.columns else F.col(f"job_{c}")
    stage = F.coalesce(F.get_json_object("payload", "$.stage"), F.col("job_stage")) if "payload" in events.columns else F.col("job_stage")
    return x.select("id", "job_id", *[own(c).alias(c) for c in names], event_level(F.col("event_type")).alias("level"), event_message(F.col("event_type"), stage, F.col("worker_id")).alias("message"))


def refinement_relationship(metadata: Column) -> Column:
    """What a refined row is to its candidates, from its metadata JSON."""
    at = lambda k: F.coalesce(F.get_json_object(metadata, f"$.{k}"), F.lit(""))
    split = at("split_from_candidate_detection_id") != ""
    eaten = ~at("consumed_candidate_detection_ids").isin("", "[]", "null")
    return F.when(split & eaten, "many_to_many").when(split, "split_child").when(eaten, "merge_keeper").otherwise("one_to_one")
