"""Writes as merges: appends, replacements, upserts and deletes that give a table's new state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scalars import merged_json
from .status import work_batches


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str], gone: DataFrame | None = None) -> DataFrame:
    """old without the rows of the keys in `gone` (those of new, if not given), and all of new."""
    named = (new if gone is None else gone).select(*keys).distinct()
    return old.join(named, keys, "left_anti").unionByName(new)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; columns that one lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def ensure_rows(projection: DataFrame, frames: DataFrame, key: str, identity: list[str], defaults: dict[str, object]) -> DataFrame:
    """A status row for each frame: identity columns as the frame has them, other columns kept, new rows with the defaults; rows without a frame stay."""
    kept = [c for c in projection.columns if c != key and c not in identity]
    old = projection.select(key, *[F.col(c).alias(f"old_{c}") for c in identity], *kept, F.lit(True).alias("known"))
    new = frames.select(key, *identity, F.lit(True).alias("there"))
    x = new.join(old, key, "full")
    fresh = [F.when(F.col("there"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in identity]
    rest = [F.when(F.col("known"), F.col(c)).otherwise(F.lit(defaults.get(c)).cast(projection.schema[c].dataType)).alias(c) for c in kept]
    return x.select(key, *fresh, *rest).select(*projection.columns)


def merged_assignments(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two sets of assignments (key and own columns) as one row for each key."""
    return first.join(second, key, "full")


def assigned(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with the columns of `new` set where it has the key; a null there leaves what is."""
    columns = [c for c in new.columns if c != key]
    x = rows.join(new.withColumnsRenamed({c: f"__fl_{c}" for c in columns}), key, "left")
    return x.select(*[F.coalesce(f"__fl_{c}", F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns], *[F.col(f"__fl_{c}").alias(c) for c in columns if c not in rows.columns])


def sandbox_copy(frames: DataFrame, wanted: DataFrame, operation: str) -> DataFrame:
    """A new copy of each wanted frame that is none itself, sharing its payload, with the source's id in its metadata and as its parent.

    Ids go on from the largest one; an asset's copies take the next negative
    frame indexes, so that (asset_id, frame_index) stays a key, and a frame may
    be copied again once its copies are part of `frames`.
    """
    x = frames.join(wanted.select("frame_id").distinct(), "frame_id", "left_semi")
    x = x.where(F.coalesce(F.get_json_object("metadata", "$.live_preview.is_sandbox"), F.lit("false")) != "true")
    lowest = frames.groupBy("asset_id").agg(F.least(F.min("frame_index"), F.lit(0)).alias("lowest"))
    largest = frames.agg(F.coalesce(F.max("frame_id"), F.lit(0))).first()[0]
    numbered = work_batches(x, ["asset_id", "frame_id"], 1)
    first = numbered.groupBy("asset_id").agg(F.min("unit").alias("first"))
    placed = numbered.join(first, "asset_id").join(lowest, "asset_id")
    source = F.col("frame_id").cast("string")
    mark = F.to_json(F.struct(F.struct(F.lit(True).alias("is_sandbox"), source.alias("source_frame_id"), F.lit(operation).alias("operation")).alias("live_preview")))
    new = {"frame_id": F.lit(largest) + 1 + F.col("unit"), "frame_index": F.col("lowest") - 1 - (F.col("unit") - F.col("first")), "metadata": merged_json("metadata", mark, strip_nulls=False)}
    if "parent_frame_id" in frames.columns:
        new["parent_frame_id"] = F.col("frame_id")
    return placed.select(*[new[c].cast(t).alias(c) if c in new else F.col(c) for c, t in frames.dtypes])


def delete_copies(frames: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frames without the copies, and the payload references that no remaining frame has."""
    left = frames.join(copies.select("frame_id"), "frame_id", "left_anti")
    refs = frames.join(copies.select("frame_id"), "frame_id", "left_semi").select("payload_ref").distinct()
    return left, refs.join(left.select("payload_ref"), "payload_ref", "left_anti")


def affected_frames(jobs: DataFrame, detections: DataFrame, parts: int | None = None) -> DataFrame:
    """(job_id, frame_id): the frames a job names itself, or those of the detections it names.

    With parts, detections and pairs are dealt into that many partitions, pairs
    before they are made distinct, so that no task keeps more than its share.
    """
    ids = lambda k: F.array_distinct(F.from_json(F.get_json_object("payload", f"$.{k}"), "array<string>"))
    dealt = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    named = jobs.select("job_id", F.explode(ids("frame_ids")).alias("frame_id"))
    known = dealt(detections.select("detection_id", F.col("frame_id").cast("string").alias("frame_id")), "detection_id")
    through = jobs.select("job_id", F.explode(ids("detection_ids")).alias("detection_id")).join(known, "detection_id")
    return dealt(named.unionByName(through.select("job_id", "frame_id")), "job_id", "frame_id").distinct()


def delete_assets(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without what hangs on the assets: frames by asset, detections and refined rows by frame, jobs by asset; and, as `orphans`, the payloads that only their frames had."""
    frames = tables["frames"]
    lost = frames.join(gone.select("asset_id"), "asset_id", "left_semi")
    out = {"assets": tables["assets"].join(gone.select("asset_id"), "asset_id", "left_anti"), "frames": frames.join(gone.select("asset_id"), "asset_id", "left_anti")}
    for name in ("detections", "refined"):
        out[name] = tables[name].join(lost.select("frame_id"), "frame_id", "left_anti")
    out["jobs"] = tables["jobs"].join(gone.select("asset_id"), "asset_id", "left_anti")
    refs = F.explode(F.array_distinct(F.array_compact(F.array("payload_ref", "preprocessed_payload_ref", "background_payload_ref")))).alias("ref")
    out["orphans"] = lost.select(refs).distinct().join(out["frames"].select(refs), "ref", "left_anti")
    return out


def retagged_projection(projection: DataFrame, assets: DataFrame) -> DataFrame:
    """The status projection with the collections its assets have now."""
    return projection.drop("collections").join(assets.select("asset_id", "collections"), "asset_id")
