"""Exports: whole tables, the joined data sets of frames and regions, and values as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import with_latest

FORMATS = ("parquet", "csv", "json", "orc")


def job_summaries(assets: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each asset: the jobs of the asset or of its run, and the latest of them.

    Jobs are summed by asset, by run, and by both, where a job would count
    twice; no job meets more than one row of each sum.
    """
    last = F.max(F.struct("updated_at", "job_id", "status", "stage"))
    known = assets.select("asset_id", "run_id")
    by_asset = jobs.where("asset_id is not null").groupBy("asset_id").agg(F.count("*").alias("n_asset"), last.alias("last_asset"))
    by_run = jobs.where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("n_run"), last.alias("last_run"))
    by_both = jobs.where("asset_id is not null and run_id is not null").groupBy("asset_id", "run_id").agg(F.count("*").alias("n_both"))
    x = known.join(by_asset, "asset_id", "left").join(by_run, "run_id", "left").join(by_both, ["asset_id", "run_id"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    x = x.withColumn("last", F.greatest("last_asset", "last_run"))
    return x.select("asset_id", (n("n_asset") + n("n_run") - n("n_both")).alias("job_count"), F.col("last.status").alias("latest_job_status"), F.col("last.stage").alias("latest_job_stage"), F.col("last.updated_at").alias("latest_job_updated_at"))


JOB_COLUMNS = ["job_count", "latest_job_status", "latest_job_stage", "latest_job_updated_at"]
PAYLOADS = [f"{kind}payload_{part}" for kind in ("", "preprocessed_", "background_") for part in ("ref", "encoding", "format", "dtype", "shape")]


def frame_metadata(frames: DataFrame, assets: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """The frame data set: a row for each frame with its asset, its run and the jobs of either."""
    a = assets.select("asset_id", F.col("filename").alias("asset_filename"), F.col("path").alias("asset_path"), F.col("kind").alias("asset_kind"), F.col("collections").alias("asset_collections"), F.col("size_bytes").alias("asset_size_bytes"), F.col("media_count").alias("asset_media_count"))
    r = runs.select("run_id", "run_key", "instrument", "source_type", F.col("status").alias("run_status"))
    x = frames.join(a.join(job_summaries(assets, jobs), "asset_id"), "asset_id").join(r, "run_id")
    return x.select("frame_id", "run_id", "asset_id", *a.columns[1:], *r.columns[1:], "frame_index", "width", "height", "bbox_x", "bbox_y", "parent_frame_id", "source_ref", *PAYLOADS, "flatfield_profile", F.col("metadata").alias("frame_metadata"), "preprocessed_metadata", "background_metadata", "flatfield_metadata", F.col("created_at").alias("frame_created_at"), *JOB_COLUMNS)


BOXES = ["bbox_x", "bbox_y", "bbox_w", "bbox_h", "crop_bbox_x", "crop_bbox_y", "crop_bbox_w", "crop_bbox_h"]
MEASURES = ["area", "perimeter", "major_axis_length", "minor_axis_length", "min_gray_value", "mean_gray_value"]
IMAGES = [f"{kind}_{part}" for kind in ("roi", "mask") for part in ("encoding", "format", "dtype", "shape")]


def roi_metadata(detections: DataFrame, frames: DataFrame, assets: DataFrame, runs: DataFrame, refined: DataFrame, jobs: DataFrame) -> DataFrame:
    """The region data set: a row for each detection with its frame, asset, run, latest refinement and jobs; payloads as their size.

    A refinement names its candidate's frame.  Assets and jobs join their
    frames, not their detections, of which there are several times as many; so
    detections are dealt by frame and by nothing else.
    """
    a = assets.select("asset_id", F.col("filename").alias("asset_filename"), F.col("path").alias("asset_path"), F.col("kind").alias("asset_kind"), F.col("collections").alias("asset_collections"))
    done = refined.select("frame_id", F.col("candidate_detection_id").alias("detection_id"), F.col("refined_id").alias("refined_detection_id"), F.col("refinement_method").alias("refined_method"), F.col("created_at").alias("refined_created_at"))
    x = detections.select("detection_id", "run_id", "frame_id", "roi_index", *BOXES, *MEASURES, *IMAGES, F.octet_length("roi_payload").alias("roi_payload_bytes"), F.octet_length("mask_payload").alias("mask_payload_bytes"), F.col("metadata").alias("detection_metadata"), F.col("created_at").alias("detection_created_at"))
    x = with_latest(x, done, "frame_id", "detection_id", ["refined_created_at", "refined_detection_id"], done.columns[2:])
    f = frames.select("frame_id", "asset_id", "frame_index").join(a.join(job_summaries(assets, jobs), "asset_id"), "asset_id")
    x = x.join(f, "frame_id").join(runs.select("run_id", "run_key"), "run_id")
    return x.select("detection_id", "run_id", "frame_id", "asset_id", *a.columns[1:], "run_key", "frame_index", "roi_index", *BOXES, *MEASURES, *IMAGES, "roi_payload_bytes", "mask_payload_bytes", "detection_metadata", "detection_created_at", *done.columns[2:], *JOB_COLUMNS)


def rendered(df: DataFrame) -> DataFrame:
    """Every column by its type as a flat export has it: decimals as doubles, times as text, bytes as base64, nested values as JSON."""

    def of(field: T.StructField) -> Column:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            c = c.cast("double")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            # Fractions only where there are some; a time of a known zone with its offset.
            zone = "xxx" if isinstance(kind, T.TimestampType) else ""
            c = F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, f"yyyy-MM-dd HH:mm:ss{zone}")).otherwise(F.date_format(c, f"yyyy-MM-dd HH:mm:ss.SSSSSS{zone}"))
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, T.BinaryType):
            c = F.base64(c)
        elif isinstance(kind, T.BooleanType):
            c = c.cast("int")
        elif isinstance(kind, T.StructType):
            c = F.to_json(F.struct(*[c[n].alias(n) for n in sorted(kind.names)]))
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            c = F.to_json(c)
        return c.alias(field.name)

    return df.select(*[of(f) for f in df.schema.fields])


def export_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> DataFrame:
    """Write each table to a folder of its own below path, and count what was written: table, rows."""
    if form not in FORMATS:
        raise ValueError(f"unsupported export format {form!r}; one of {', '.join(FORMATS)}")
    if not tables:
        raise ValueError("no tables to export")
    counts = None
    for name, df in sorted(tables.items()):
        rows = rendered(df) if form == "csv" else df
        rows.write.format(form).options(**({"header": "true"} if form == "csv" else {})).save(f"{path}/{name}")
        read = df.sparkSession.read.schema(rows.schema).format(form).options(**({"header": "true"} if form == "csv" else {})).load(f"{path}/{name}")
        one = read.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def register_manifest(manifest: DataFrame) -> dict[str, DataFrame]:
    """Runs, assets and jobs from one manifest table (run_key, project_id, assets array<struct>, jobs array<struct>), each once.

    Ids are hashes of natural keys, so that a manifest registered again gives
    the same rows.
    """
    runs = manifest.select(F.sha2("run_key", 256).alias("run_id"), "project_id", "run_key").dropDuplicates(["run_key"])
    a = manifest.select("run_key", "project_id", F.explode("assets").alias("a")).select("run_key", "project_id", "a.*").dropDuplicates(["run_key", "filename"])
    asset_id = F.sha2(F.concat_ws("/", "run_key", "filename"), 256)
    assets = a.select(asset_id.alias("asset_id"), F.sha2("run_key", 256).alias("run_id"), *[c for c in a.columns if c != "run_key"])
    j = manifest.select("run_key", "project_id", F.explode("jobs").alias("j")).select("run_key", "project_id", "j.*")
    jobs = j.select(F.sha2(F.concat_ws("/", "run_key", "filename", "stage"), 256).alias("job_id"), F.sha2("run_key", 256).alias("run_id"), asset_id.alias("asset_id"), "project_id", "stage", F.lit("queued").alias("status")).dropDuplicates(["job_id"])
    return {"runs": runs, "assets": assets, "jobs": jobs}
