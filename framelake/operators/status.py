"""Processing state of assets and frames, its summaries and facets, and upkeep of the projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.shared import write_shared


def frame_counts(frames: DataFrame, detections: DataFrame, refined: DataFrame) -> DataFrame:
    """Each frame with its candidates, refined rows and distinct refined candidates; summed before the joins."""
    found = detections.groupBy("frame_id").agg(F.count("*").alias("detection_count"))
    done = refined.groupBy("frame_id").agg(F.count("*").alias("refined_count"), F.countDistinct("candidate_detection_id").alias("refined_candidates"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = frames.join(found, "frame_id", "left").join(done, "frame_id", "left")
    out = joined.select(*frames.columns, zero("detection_count"), zero("refined_count"), zero("refined_candidates"))
    return out.withColumn("unrefined_count", F.greatest(F.col("detection_count") - F.col("refined_candidates"), F.lit(0)))


def refinement_state() -> Column:
    return F.when(F.col("detection_count") == 0, "no-detections").when(F.col("refined_candidates") == 0, "needs-refinement").when(F.col("refined_candidates") >= F.col("detection_count"), "fully-refined").otherwise("partially-refined")


def frame_states(counts: DataFrame) -> DataFrame:
    """counts with the labels of all three stages; a frame is preprocessed or detected wholly or not at all."""
    return counts.withColumns({
        "preprocessing_state": F.when(F.col("has_preprocessed"), "fully-preprocessed").otherwise("needs-preprocessed"),
        "detection_state": F.when(F.col("detection_count") > 0, "fully-detected").otherwise("needs-detections"),
        "refinement_state": refinement_state(),
    })


def frame_states_summary(counts: DataFrame) -> DataFrame:
    """One row of totals over the frames of counts."""
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).alias(n)
    return counts.agg(F.count("*").alias("frames"), F.count_if("has_preprocessed").alias("preprocessed_frames"), F.count_if(F.col("detection_count") > 0).alias("detected_frames"), total("detection_count", "detections"), total("refined_candidates", "refined_candidates"), total("unrefined_count", "unrefined"), total("refined_count", "refined"))


def known_statuses(values: list[str], allowed: list[str]) -> list[str]:
    """The values, if all are statuses; else an error."""
    wrong = sorted(set(values) - set(allowed))
    if wrong:
        raise ValueError(f"unknown statuses: {', '.join(wrong)}")
    return values


def in_any_collection(rows: DataFrame, collections: list[str]) -> DataFrame:
    """Rows in at least one of the collections."""
    return rows.where(F.arrays_overlap("collections", F.array(*map(F.lit, collections))))


def asset_detection_stats(assets: DataFrame, counts: DataFrame, least: int = 1) -> DataFrame:
    """Frames with detections and detections of each asset that has at least `least`."""
    per = counts.groupBy("asset_id").agg(F.count(F.when(F.col("detection_count") > 0, 1)).alias("detected_frames"), F.sum("detection_count").alias("detection_count"))
    return per.where(F.col("detection_count") >= least).join(assets.select("asset_id", "filename", "run_id"), "asset_id")


def asset_state(assets: DataFrame, counts: DataFrame) -> DataFrame:
    per = counts.groupBy("asset_id").agg(F.count("*").alias("frame_count"), F.count(F.when(F.col("has_preprocessed"), 1)).alias("preprocessed_count"), F.count(F.when(F.col("detection_count") > 0, 1)).alias("detected_count"), F.sum("detection_count").alias("detection_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = assets.join(per, "asset_id", "left").select("asset_id", *[zero(c) for c in per.columns[1:]])
    done = F.when((F.col("frame_count") > 0) & (F.col("preprocessed_count") == F.col("frame_count")), "fully-preprocessed").when(F.col("preprocessed_count") > 0, "partially-preprocessed").otherwise("needs-preprocessing")
    seen = F.when((F.col("frame_count") > 0) & (F.col("detected_count") == F.col("frame_count")), "fully-detected").when(F.col("detection_count") > 0, "partially-detected").otherwise("needs-detections")
    return out.withColumns({"preprocessing_state": done, "detection_state": seen})


def rebuild(counts: DataFrame, old: DataFrame) -> DataFrame:
    """The projection from stored artifacts; an old status stays where none proves success."""
    x = counts.join(old, "frame_id", "left")
    keep = lambda proof, c: F.when(proof, "succeeded").otherwise(F.coalesce(F.col(c), F.lit("unknown")))
    return x.select("frame_id", "asset_id", "frame_index", keep(F.col("has_preprocessed"), "old_preprocessing").alias("preprocessing_status"), keep(F.col("detection_count") > 0, "old_detection").alias("detection_status"), keep(F.col("refined_count") > 0, "old_refinement").alias("refinement_status"), "detection_count", "refined_count", "unrefined_count")


STAGES = ("preprocessing_status", "detection_status", "refinement_status")


def summary(status: DataFrame, statuses: list[str]) -> DataFrame:
    """Totals, the count of each status of each stage and the last update, if rows tell it, in one scan, one row."""
    cells = [F.count_if(F.col(s) == v).alias(f"{s}_{v}") for s in STAGES for v in statuses]
    cells += [F.max("updated_at").alias("updated_at")] if "updated_at" in status.columns else []
    return status.agg(F.count("*").alias("frame_count"), F.count_if(F.col("detection_count") > 0).alias("with_candidates"), F.count_if(F.col("refined_count") > 0).alias("with_refined"), F.coalesce(F.sum("detection_count"), F.lit(0)).alias("detections"), F.coalesce(F.sum("refined_count"), F.lit(0)).alias("refined"), F.coalesce(F.sum("unrefined_count"), F.lit(0)).alias("unrefined"), *cells)


def facets(status: DataFrame, assets: DataFrame) -> DataFrame:
    """(facet, value, n): stages, assets and collections count frames, the refinement facet counts regions."""
    kinds = [F.struct(F.lit(s).alias("facet"), F.col(s).alias("value"), F.lit(1).cast("long").alias("n")) for s in STAGES]
    kinds.append(F.struct(F.lit("refinement").alias("facet"), F.lit("refined").alias("value"), (F.col("detection_count") - F.col("unrefined_count")).alias("n")))
    kinds.append(F.struct(F.lit("refinement").alias("facet"), F.lit("unrefined").alias("value"), F.col("unrefined_count").alias("n")))
    kinds.append(F.struct(F.lit("asset").alias("facet"), F.col("asset_id").cast("string").alias("value"), F.lit(1).cast("long").alias("n")))
    named = status.join(assets.select("asset_id", "collections"), "asset_id")
    own = F.transform("collections", lambda c: F.struct(F.lit("collection").alias("facet"), c.alias("value"), F.lit(1).cast("long").alias("n")))
    rows = named.select(F.explode(F.concat(F.array(*kinds), own)).alias("f")).select("f.*")
    return rows.groupBy("facet", "value").agg(F.sum("n").alias("n"))


def snapshot(new: DataFrame, old: DataFrame) -> DataFrame:
    """Versions after a refresh: one up where the summary changed or is new, as before where it did not."""
    x = new.join(old.withColumnRenamed("summary", "old_summary"), "project_id", "full")
    changed = ~F.col("summary").eqNullSafe(F.col("old_summary"))
    return x.select("project_id", (F.coalesce(F.col("version"), F.lit(0)) + changed.cast("int")).alias("version"), F.coalesce("summary", "old_summary").alias("summary"))


def is_fresh() -> Column:
    """Whether a snapshot holds: it has a summary, made no earlier than the projection's last update."""
    return F.coalesce(F.col("summary").isNotNull() & (F.col("generated_at") >= F.col("updated_at")), F.lit(False))


def refreshed(snapshots: DataFrame, summaries: DataFrame, now: Column) -> DataFrame:
    """Snapshots (project_id, version, summary, generated_at, updated_at) after a request: fresh ones stay; others take the summary of now, and a new version if it differs.

    summaries (project_id, summary) need only be made for projects whose snapshot is stale or missing.
    """
    x = snapshots.withColumn("fresh", is_fresh()).join(summaries.withColumnRenamed("summary", "new_summary"), "project_id", "full")
    kept = F.coalesce("fresh", F.lit(False)) | F.col("new_summary").isNull()
    changed = (~F.col("new_summary").eqNullSafe(F.col("summary"))).cast("int")
    version = F.coalesce("version", F.lit(0)) + F.when(kept, 0).otherwise(changed)
    return x.select("project_id", version.alias("version"), F.when(kept, F.col("summary")).otherwise(F.col("new_summary")).alias("summary"), F.when(kept, F.col("generated_at")).otherwise(now).alias("generated_at"), F.coalesce("updated_at", now).alias("updated_at"))


def latest_status(events: DataFrame) -> DataFrame:
    """Status events folded to the last status of each key."""
    return events.groupBy("key").agg(F.max_by("status", F.struct("at", "id")).alias("status"), F.count("*").alias("events"))


def work_batches(status: DataFrame, keys: list[str], batch_size: int) -> DataFrame:
    """Rows in key order cut into batches of batch_size: all columns, unit (from 0) and batch.  The keys are unique.

    Rows are range-partitioned by the keys and written once, with their part's
    number, in the shared folder; both the parts' sizes, one row each, and the
    rows' places come from that table, so that they agree whatever is computed
    again.  No task sorts all rows.
    """
    parts = write_shared(status.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each partition.
    bases = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    numbered = parts.withColumn("place", place).join(F.broadcast(bases), "part").withColumn("unit", F.col("base") + F.col("place"))
    return numbered.withColumn("batch", F.floor(F.col("unit") / batch_size)).drop("part", "place", "base")


def work_plan(units: DataFrame, unit_id: str, order: list[Column], batch_size: int) -> DataFrame:
    """Units in the order of a plan, with their unit number (from 0) and batch; ties go by the id as text.

    A frame's order is its payload reference, so that a job reads its store in order; detections go by frame and index.
    """
    keys = [f"__fl_{i}" for i in range(len(order) + 1)]
    x = units.withColumns(dict(zip(keys, [*order, F.col(unit_id).cast("string")], strict=True)))
    return work_batches(x, keys, batch_size).drop(*keys)


def planned_jobs(plan: DataFrame, unit_id: str) -> DataFrame:
    """One row for each batch of a plan: units, their ids in order, and the asset and run that all of them share, if they do."""
    one = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c)).alias(c)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("unit", unit_id))), lambda s: s[unit_id])  # as many as a batch has
    run = F.when(F.min("run_id") == F.max("run_id"), F.min("run_id")).alias("run_id")
    return plan.groupBy("batch").agg(F.count("*").alias("units"), one("asset_id"), run, ids.alias("ids"))


def plan_report(plan: DataFrame, unit_id: str, sample: int = 20) -> DataFrame:
    """One row: matched units, jobs, the largest batch, and the first units' ids."""
    sizes = plan.groupBy("batch").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("unit") < sample, F.struct("unit", unit_id)))).alias("first"))
    first = F.flatten(F.collect_list(F.when(F.size("first") > 0, F.col("first"))))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched_count"), F.count("*").alias("job_count"), F.max("n").alias("largest_batch"), F.transform(F.sort_array(first), lambda s: s[unit_id]).alias("sample_ids"))


def still_eligible(planned: DataFrame, current: DataFrame, key: str, status: str, allowed: list[str]) -> DataFrame:
    """Planned units with the status they have now and whether that still lets them be queued; a unit without a row has none any more."""
    now = current.select(key, F.col(status).alias("status_now"))
    x = planned.join(now, key, "left")
    return x.withColumn("eligible", F.coalesce(F.col("status_now").isin(allowed), F.lit(False)))


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of old without a row of the same keys in new, and all of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
