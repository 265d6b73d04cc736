"""Searches, lookups, scopes, sorts and pages with all their filters, over any table of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import bounds, contains, latest

#: How a table reaches its project: itself, or through other tables, as (table, own key, its key).
SCOPES = {
    "runs": [], "assets": [], "models": [], "jobs": [], "logs": [],
    "frames": [("assets", "asset_id", "asset_id")],
    "detections": [("frames", "frame_id", "frame_id"), ("assets", "asset_id", "asset_id")],
    "refined": [("frames", "frame_id", "frame_id"), ("assets", "asset_id", "asset_id")],
    "job_events": [("jobs", "job_id", "job_id")],
    "job_dependencies": [("jobs", "job_id", "job_id")],
}
STATUS_LIMITS, EXPORT_LIMITS, EXPORT_DEFAULT = (1, 10_000), (1, 100_000), 10_000


def in_project(name: str, tables: dict[str, DataFrame], project: int | str) -> DataFrame:
    """Rows of the named table that belong to the project, by semi-joins along its path; the filter starts at the table that has project_id."""

    def keys_of(path: list[tuple[str, str, str]]) -> DataFrame:
        other, _, key = path[0]
        rows = tables[other]
        if len(path) == 1:
            return rows.where(F.col("project_id") == project).select(key)
        _, own, _ = path[1]
        return rows.join(keys_of(path[1:]).withColumnRenamed(path[1][2], own), own, "left_semi").select(key)

    path = SCOPES[name]
    if not path:
        return tables[name].where(F.col("project_id") == project)
    own, key = path[0][1], path[0][2]
    return tables[name].join(keys_of(path).withColumnRenamed(key, own), own, "left_semi")


def outside_project(name: str, tables: dict[str, DataFrame], project: int | str, ids: DataFrame, key: str) -> DataFrame:
    """The ids that are no rows of the project's: unknown ones, and other projects'."""
    return ids.join(in_project(name, tables, project).select(key), key, "left_anti")


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """The row or rows with these key values; equality filters that a Parquet scan takes."""
    for c, v in keys.items():
        df = df.where(F.col(c) == v)
    return df


def lookup_many(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The same for many keys at once, as a semi-join."""
    return df.join(wanted.select(*keys), keys, "left_semi")


def search_jobs(jobs: DataFrame, statuses: list[str] | None = None, stages: list[str] | None = None, ids: DataFrame | list | None = None, **exact: object) -> DataFrame:
    """Jobs by status, stage and id lists and exact columns; empty lists filter nothing, ids may be a table of job_id."""
    for column, values in (("status", statuses), ("stage", stages)):
        chosen = [v for v in values or [] if v]
        if chosen:
            jobs = jobs.where(F.col(column).isin(chosen))
    if isinstance(ids, DataFrame):
        jobs = lookup_many(jobs, ids, ["job_id"])
    elif ids:
        jobs = jobs.where(F.col("job_id").isin(ids))
    return lookup(jobs, **{k: v for k, v in exact.items() if v is not None})


def search_logs(logs: DataFrame, after_id: int | None = None, before_id: int | None = None, level: str | None = None, **exact: object) -> DataFrame:
    """Logs between two ids, both left out, with a level in any case and exact columns."""
    if after_id is not None:
        logs = logs.where(F.col("id") > after_id)
    if before_id is not None:
        logs = logs.where(F.col("id") < before_id)
    if level:
        logs = logs.where(F.col("level") == level.lower())
    return lookup(logs, **{k: v for k, v in exact.items() if v is not None})


def search_events(events: DataFrame, jobs: DataFrame, project: int | None = None, after_id: int | None = None, run: int | None = None, job: int | None = None) -> DataFrame:
    """Job events, by the project of their job or, for events without a job, the one their payload names."""
    if after_id is not None:
        events = events.where(F.col("id") > after_id)
    if job is not None:
        events = events.where(F.col("job_id") == job)
    if project is None and run is None:
        return events
    known = jobs.select("job_id", F.col("project_id").alias("job_project"), F.col("run_id").alias("job_run"))
    x = events.join(known, "job_id", "left")
    if project is not None:
        named = F.get_json_object("payload", "$.project_id") == str(project)
        x = x.where((F.col("job_project") == project) | (F.col("job_id").isNull() & named))
    if run is not None:
        x = x.where(F.col("job_run") == run)
    return x.select(*events.columns)


def search_models(models: DataFrame, like: dict[str, str] | None = None, **exact: object) -> DataFrame:
    """Models by substrings of model_key, model_name or artifact_uri, and exact columns."""
    for c, v in (like or {}).items():
        models = models.where(contains(c, v))
    return lookup(models, **exact)


def search_workers(workers: DataFrame, capability: str | None = None, **exact: object) -> DataFrame:
    """Worker sessions with a capability in their JSON list, and exact columns."""
    if capability is not None:
        workers = workers.where(F.array_contains(F.from_json("capabilities", "array<string>"), capability))
    return lookup(workers, **exact)


def sandbox_copies(frames: DataFrame, source: str | None = None, operation: str | None = None) -> DataFrame:
    """Frames marked as live-preview copies, of one source or by one operation."""
    at = lambda k: F.get_json_object("metadata", f"$.live_preview.{k}")
    x = frames.where(at("is_sandbox") == "true")
    for k, v in (("source_frame_id", source), ("operation", operation)):
        if v is not None:
            x = x.where(at(k) == v)
    return x


def search_detections(detections: DataFrame, ranges: dict[str, tuple] | None = None, exact: dict[str, object] | None = None, frame_range: tuple = (None, None), assets: DataFrame | None = None, collection: str | None = None, refined: DataFrame | None = None, state: str | None = None) -> DataFrame:
    """Detections by bounds of any measure, exact encodings, their frame's place, their asset's collection and refinement state."""
    for c, (low, high) in (ranges or {}).items():
        detections = detections.where(bounds(c, low, high))
    detections = lookup(detections.where(bounds("frame_index", *frame_range)), **(exact or {}))
    if collection is not None:
        detections = detections.join(assets.where(F.array_contains("collections", collection)).select("asset_id"), "asset_id", "left_semi")
    name = (state or "").replace("_", "-").lower()
    done = None if refined is None else refined.select(F.col("candidate_detection_id").alias("detection_id"))
    if name in ("refined", "has-refinement", "has-refined"):
        return detections.join(done, "detection_id", "left_semi")
    if name in ("unrefined", "needs-refinement", "needs-refined", "none"):
        return detections.join(done, "detection_id", "left_anti")
    return detections


def asset_state_filter(preprocessing: str | None = None, detection: str | None = None) -> Column:
    """Assets by what is done to their frames; unknown names filter nothing."""
    n, p, d, found = F.col("frame_count"), F.col("preprocessed_count"), F.col("detected_count"), F.col("detection_count")
    first = {"has-preprocessed": p > 0, "needs-preprocessed": p == 0, "none": p == 0, "fully-preprocessed": (n > 0) & (p == n), "complete": (n > 0) & (p == n), "partially-preprocessed": (p > 0) & (p < n), "partial": (p > 0) & (p < n)}
    second = {"has-detections": found > 0, "needs-detections": found == 0, "none": found == 0, "fully-detected": (n > 0) & (d == n), "complete": (n > 0) & (d == n), "partially-detected": (d > 0) & (d < n), "partial": (d > 0) & (d < n)}
    key = lambda s: (s or "").replace("_", "-")
    return first.get(key(preprocessing), F.lit(True)) & second.get(key(detection), F.lit(True))


def frame_state_filter(preprocessing: str | None = None, detection: str | None = None, refinement: str | None = None) -> Column:
    """Frames by what is done to them; a frame is never partly preprocessed or detected."""
    has, n, done, left = F.col("has_preprocessed"), F.col("detection_count"), F.col("refined_candidates"), F.col("unrefined_count")
    first = {"has-preprocessed": has, "needs-preprocessed": ~has, "none": ~has, "fully-preprocessed": has, "complete": has, "partially-preprocessed": F.lit(False), "partial": F.lit(False)}
    second = {"has-detections": n > 0, "needs-detections": n == 0, "none": n == 0, "fully-detected": n > 0, "complete": n > 0, "partially-detected": F.lit(False), "partial": F.lit(False)}
    third = {"has-refinement": done > 0, "refined": done > 0, "needs-refinement": left > 0, "unrefined": left > 0, "none": left > 0, "fully-refined": (n > 0) & (left == 0), "complete": (n > 0) & (left == 0), "partially-refined": (done > 0) & (left > 0), "partial": (done > 0) & (left > 0), "no-detections": n == 0}
    key = lambda s: (s or "").replace("_", "-")
    return first.get(key(preprocessing), F.lit(True)) & second.get(key(detection), F.lit(True)) & third.get(key(refinement), F.lit(True))


def runs_by_assets(runs: DataFrame, assets: DataFrame, collection: str | None = None, exact: dict[str, object] | None = None, like: dict[str, str] | None = None, min_size: int | None = None, max_size: int | None = None, **own: object) -> DataFrame:
    """Runs by their own columns and by what some asset of theirs is.

    Each filter may be met by another asset, so one aggregation over the assets
    notes which filters a run has an asset for, in place of a semi-join for each.
    """
    tests = [] if collection is None else [F.array_contains("collections", collection)]
    tests += [F.col(c) == v for c, v in (exact or {}).items()] + [contains(c, v) for c, v in (like or {}).items()]
    tests += [] if min_size is None else [F.col("size_bytes") >= min_size]
    tests += [] if max_size is None else [F.col("size_bytes") <= max_size]
    runs = lookup(runs, **own)
    if not tests:
        return runs
    met = assets.groupBy("run_id").agg(*[F.bool_or(F.coalesce(x, F.lit(False))).alias(f"t{i}") for i, x in enumerate(tests)])
    for i in range(len(tests)):
        met = met.where(f"t{i}")
    return runs.join(met.select("run_id"), "run_id", "left_semi")


def report_window(df: DataFrame, time: str, since: str | None = None, until: str | None = None, run: int | None = None, asset: int | None = None, assets: DataFrame | None = None, collection: str | None = None) -> DataFrame:
    """Rows from `since` to before `until`, of a run, an asset or a collection's assets."""
    if since is not None:
        df = df.where(F.col(time) >= F.lit(since).cast(df.schema[time].dataType))
    if until is not None:
        df = df.where(F.col(time) < F.lit(until).cast(df.schema[time].dataType))
    df = lookup(df, **{k: v for k, v in (("run_id", run), ("asset_id", asset)) if v is not None})
    if collection is None:
        return df
    return df.join(assets.where(F.array_contains("collections", collection)).select("asset_id"), "asset_id", "left_semi")


def summary_columns(df: DataFrame, heavy: list[str]) -> DataFrame:
    """df without its heavy JSON columns: for each the type, the bytes and, of an array, the length."""
    out = df.drop(*heavy)
    parts = []
    for c in heavy:
        first = F.substring(F.trim(F.col(c)), 1, 1)
        kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(first != "", "number")
        parts += [kind.alias(f"{c}_type"), F.octet_length(c).alias(f"{c}_bytes"), F.json_array_length(c).alias(f"{c}_length")]
    return df.select(*out.columns, *parts)


def sorted_by(options: dict[str, list[Column]], key: str | None, default: str) -> list[Column]:
    """The order that a key asks for, the default for unknown keys."""
    return options.get((key or default).lower(), options[default])


def detection_orders(direction: str = "desc") -> dict[str, list[Column]]:
    """Orders of detections by name, for sorted_by; nulls stay last either way."""
    by = lambda c: F.col(c).asc_nulls_last() if direction.lower() == "asc" else F.col(c).desc_nulls_last()
    newest = [F.col("frame_index").desc(), F.col("roi_index")]
    return {"area": [by("area"), *newest], "byte_size": [by("payload_bytes"), *newest], "id": [by("detection_id")], "asset_frame": [by("filename"), by("frame_index"), by("roi_index")]}


def sample(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows in random order: each task keeps k."""
    return df.orderBy(F.rand(seed)).limit(k)


def clamp(value: int | None, limits: tuple[int, int], default: int) -> int:
    """A row limit within the limits."""
    return min(max(default if value is None else int(value), limits[0]), limits[1])


def cursor_text(keys: list[str]) -> Column:
    """A row's place in a keyset order as text."""
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])


def next_cursor(page: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """One row: the rows of a page, and where the next one starts, null unless the page is full."""
    last = F.max(F.struct(*keys))
    return page.agg(F.count("*").alias("rows"), last.alias("at")).select("rows", F.when(F.col("rows") >= limit, F.concat_ws("|", *[F.col(f"at.{k}").cast("string") for k in keys])).alias("next_cursor"))


def page_metadata(limit: int | None, offset: int, count: Column) -> list[Column]:
    """limit, offset, count and next_offset, which is null unless the page is full."""
    following = F.lit(None).cast("long") if not limit or limit <= 0 else F.when(count >= limit, F.lit(max(0, offset)) + count)
    return [F.lit(None if limit is None else max(0, limit)).cast("long").alias("limit"), F.lit(max(0, offset)).cast("long").alias("offset"), count.cast("long").alias("count"), following.cast("long").alias("next_offset")]


def cancel_preview(jobs: DataFrame, cancellable: tuple[str, ...] = ("queued", "leased", "working", "paused", "unknown")) -> DataFrame:
    """A dry run: the jobs matched and those that could be cancelled, by stage."""
    return jobs.groupBy("stage").agg(F.count("*").alias("matched"), F.count_if(F.col("status").isin(*cancellable)).alias("cancellable"))


def latest_classifications(detections: DataFrame, results: DataFrame) -> DataFrame:
    """Each detection with the latest result of each model, if any."""
    keyed = results.withColumn("key", F.struct("detection_id", "model_id"))
    best = latest(keyed, "key", ["created_at", "result_id"])
    return detections.join(best.drop("key"), "detection_id", "left")


def exists_by_key(refs: DataFrame, store: DataFrame) -> DataFrame:
    """refs (key) with whether the store has a payload for it."""
    return refs.join(store.select("key").distinct().withColumn("stored", F.lit(True)), "key", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
