"""The catalogue's tables with all their columns, supplied from the given Parquet tables.

Each view is one SQL text in the part of the language that Spark and DuckDB
share, so that both sides of a comparison start from the same rows; w_refined
alone is made here from one reading of w_detections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

GIVEN = ("region", "nation", "customer", "orders", "lineitem", "part", "events")

VIEWS = {
    "w_runs": """select n_nationkey as run_id, n_regionkey as project_id, n_name as run_key, case when n_nationkey % 3 = 0 then 'CPICS' else 'ISIIS' end as instrument,
        '/data/' || n_name as source_path, case when n_nationkey % 2 = 0 then 'video' else 'folder' end as source_type, case when n_nationkey % 4 = 0 then 'running' else 'completed' end as status from nation""",
    "w_assets": """select c_custkey as asset_id, project_id, run_id, c_name as filename, source_path || '/' || c_name as path, case when c_custkey % 2 = 0 then 'video' else 'image_sequence' end as kind,
        md5(c_name) as checksum, cast(floor(c_acctbal * 100) as bigint) as size_bytes, split(c_mktsegment || ',' || run_key, ',') as collections, cast(c_custkey % 7 as int) as media_count from customer join w_runs on c_nationkey = run_id""",
    "w_frames": """select o_orderkey as frame_id, run_id, o_custkey as asset_id, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) as frame_index, o_orderdate as captured_at,
        cast(o_orderkey % 3 + 6 as int) as width, cast(o_orderkey % 2 + 7 as int) as height, 0 as bbox_x, cast(o_orderkey % 5 as int) as bbox_y, case when o_orderkey % 6 = 0 then o_orderkey - 1 end as parent_frame_id,
        'frame://' || cast(o_orderkey as string) as source_ref, 'raw-' || cast(o_orderkey % 500 as string) as payload_ref, 'zstd' as payload_encoding, 'raw' as payload_format, 'uint8' as payload_dtype, '8,8' as payload_shape,
        case when o_orderstatus = 'F' then 'pre-' || cast(o_orderkey as string) end as preprocessed_payload_ref, case when o_orderstatus = 'F' then 'zstd' end as preprocessed_payload_encoding,
        case when o_orderstatus = 'F' then 'raw' end as preprocessed_payload_format, case when o_orderstatus = 'F' then 'uint8' end as preprocessed_payload_dtype, case when o_orderstatus = 'F' then '8,8' end as preprocessed_payload_shape,
        case when o_orderkey % 4 = 0 then 'bg-' || cast(o_custkey as string) end as background_payload_ref, case when o_orderkey % 4 = 0 then 'zstd' end as background_payload_encoding,
        case when o_orderkey % 4 = 0 then 'raw' end as background_payload_format, case when o_orderkey % 4 = 0 then 'uint8' end as background_payload_dtype, case when o_orderkey % 4 = 0 then '8,8' end as background_payload_shape,
        case when o_orderkey % 3 = 0 then split('1.5,2.5,3.5', ',') end as flatfield_profile,
        case when o_orderkey % 10 = 0 then '{"live_preview":{"is_sandbox":true,"source_frame_id":"' || cast(o_orderkey - 1 as string) || '","operation":"' || case when o_orderkey % 20 = 0 then 'crop' else 'mask' end || '"}}' else '{}' end as metadata,
        '{}' as preprocessed_metadata, '{}' as background_metadata, '{}' as flatfield_metadata, o_orderdate as created_at from orders join w_assets on o_custkey = asset_id""",
    "w_detections": """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as detection_id, f.run_id, l_orderkey as frame_id, f.asset_id, f.frame_index, l_linenumber as roi_index, cast(l_partkey % 64 as int) as bbox_x, cast(l_suppkey % 64 as int) as bbox_y,
        cast(floor(l_quantity) as int) % 24 + 1 as bbox_w, cast((l_partkey + l_suppkey) % 24 + 1 as int) as bbox_h, case when l_linenumber % 4 > 0 then cast(l_partkey % 60 as int) end as crop_bbox_x, cast(l_suppkey % 60 as int) as crop_bbox_y,
        cast(floor(l_quantity) as int) % 24 + 5 as crop_bbox_w, cast((l_partkey + l_suppkey) % 24 + 5 as int) as crop_bbox_h, l_extendedprice as area, l_quantity * 4 as perimeter, l_quantity as major_axis_length, l_quantity / 2 as minor_axis_length,
        cast(l_partkey % 100 as int) as min_gray_value, l_discount * 1000 as mean_gray_value, case when l_partkey % 2 = 0 then 'png' else 'zstd' end as roi_encoding, 'raw' as roi_format, 'uint8' as roi_dtype, '8,8' as roi_shape,
        'png' as mask_encoding, 'label' as mask_format, 'uint8' as mask_dtype, '8,8' as mask_shape, case when l_suppkey % 3 > 0 then l_returnflag || l_linestatus end as roi_payload, l_returnflag as mask_payload, '{}' as metadata, l_shipdate as created_at, l_returnflag as flag
        from lineitem join w_frames f on l_orderkey = f.frame_id""",
    "w_refined": """select detection_id || '/a' as refined_id, detection_id as candidate_detection_id, frame_id, 'identity' as refinement_method, created_at from w_detections where flag = 'R'
        union all select detection_id || '/b', detection_id, frame_id, 'model', created_at + interval 1 day from w_detections where flag = 'R' and bbox_w % 2 = 0""",
    "w_jobs": """select o_orderkey as job_id, a.project_id, case when o_orderkey % 4 > 0 then a.run_id end as run_id, case when o_orderkey % 3 > 0 then a.asset_id end as asset_id, substring(o_orderpriority, 3, 20) as stage,
        split('unknown,queued,leased,working,succeeded,failed,cancelled,paused', ',') as names, cast(o_orderkey % 8 as int) as status_no, cast(o_orderkey % 11 as int) as priority,
        case when o_orderkey % 5 > 0 then 'w' || cast(o_orderkey % 8 as string) end as worker_id, '{"frame_ids":["' || cast(o_orderkey as string) || '","' || cast(o_orderkey - 1 as string) || '"],"n":' || cast(o_orderkey % 9 as string) || '}' as payload,
        case when o_orderkey % 6 = 0 then '[1,2,3]' when o_orderkey % 6 = 1 then '"done"' when o_orderkey % 6 = 2 then '12' when o_orderkey % 6 = 3 then '{"a":1}' end as result,
        o_orderdate as created_at, o_orderdate + interval 1 hour as updated_at from orders join w_assets a on o_custkey = a.asset_id""",
    "w_logs": """select event_id as id, user_id % 5 as project_id, ts as created_at, case when event_type = 'error' then 'error' when event_id % 7 = 0 then 'warning' else 'info' end as level, 'worker.' || event_type as logger, event_type,
        case when user_id % 2 = 0 then user_id % 25 end as run_id, user_id % 150 + 1 as asset_id, case when event_id % 5 > 0 then event_id % 15000 + 1 end as job_id, 'w' || cast(user_id % 8 as string) as worker_id, 'r' || cast(event_id % 100 as string) as request_id,
        value as duration_ms, '{"project_id":' || cast(event_id % 5 as string) || ',"k":' || cast(event_id % 13 as string) || '}' as payload from events""",
    "w_models": """select p_partkey as model_id, cast(p_size % 5 as bigint) as project_id, p_brand as model_key, p_name as model_name, 'v' || cast(p_size % 3 as string) as version, case when p_partkey % 2 = 0 then 'classify' else 'refine' end as task, 'store://' || p_type as artifact_uri from part""",
}
NEEDS = {"w_assets": ["w_runs"], "w_frames": ["w_assets"], "w_detections": ["w_frames"], "w_refined": ["w_detections"], "w_jobs": ["w_assets"]}


def chain(name: str) -> list[str]:
    """The views that a view is built on, and itself, in order."""
    return [x for n in NEEDS.get(name, []) for x in chain(n)] + [name]


#: What each large table is joined by in the views.
DEALT_BY = {"orders": "o_custkey", "lineitem": "l_orderkey"}


def wide(spark: SparkSession, sf_dir: str, name: str, parts: int | None = None) -> DataFrame:
    """The view as a DataFrame; only the given tables that it names are opened.

    With parts, frames are dealt by asset and detections by frame into that many partitions.
    """
    if name == "w_refined":
        return _refined(wide(spark, sf_dir, "w_detections", parts))
    names = list(dict.fromkeys(chain(name)))
    text = "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names) + f" select * from {name}"
    used = [g for g in GIVEN if f"from {g}" in text or f"join {g}" in text]
    for g in used:
        text = text.replace(f"from {g}", f"from {{{g}}}").replace(f"join {g}", f"join {{{g}}}")
    # JSON braces stand for themselves.
    escaped = text.replace("{", "{{").replace("}", "}}")
    for g in used:
        escaped = escaped.replace(f"{{{{{g}}}}}", f"{{{g}}}")
    given = {g: table(spark, sf_dir, g) for g in used}
    if parts:
        given |= {g: given[g].repartition(parts, k) for g, k in DEALT_BY.items() if g in used}
    found = spark.sql(escaped, **given)
    if name == "w_jobs":
        found = found.selectExpr("*", "names[status_no] as status").drop("names", "status_no")
    return found


def _refined(detections: DataFrame) -> DataFrame:
    """The rows of w_refined from one reading of the detections; its text reads them twice."""
    made = lambda mark, method, at: F.struct(F.concat("detection_id", F.lit(mark)).alias("refined_id"), F.lit(method).alias("refinement_method"), at.alias("created_at"))
    second = F.when(F.col("bbox_w") % 2 == 0, made("/b", "model", F.col("created_at") + F.expr("interval 1 day")))
    x = detections.where("flag = 'R'").select("detection_id", "frame_id", F.explode(F.array_compact(F.array(made("/a", "identity", F.col("created_at")), second))).alias("made"))
    return x.select("made.refined_id", F.col("detection_id").alias("candidate_detection_id"), "frame_id", "made.refinement_method", "made.created_at")
