"""SQL twins of the views in framelake.sources.tables, as common table expressions for DuckDB."""

VIEWS = {
    "runs": "select n_nationkey as run_id, n_name as run_key, n_regionkey as project_id from nation",
    "assets": "select c_custkey as asset_id, run_id, project_id, run_key, c_name as filename, c_mktsegment as kind, c_acctbal as size_bytes, [c_mktsegment, run_key] as collections from customer join runs on c_nationkey = run_id",
    "frames": "select o_orderkey as frame_id, o_custkey as asset_id, o_orderdate as captured_at, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as integer) as frame_index, o_orderstatus = 'F' as has_preprocessed, o_totalprice as payload_size from orders",
    "detections": "select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as detection_id, l_orderkey as frame_id, l_linenumber as roi_index, cast(l_partkey % 64 as integer) as bbox_x, cast(l_suppkey % 64 as integer) as bbox_y, cast(trunc(l_quantity) as integer) % 24 + 1 as bbox_w, cast((l_partkey + l_suppkey) % 24 + 1 as integer) as bbox_h, l_extendedprice as area, l_returnflag as flag, l_linestatus as line_status, l_shipdate as created_at from lineitem",
    "refined": "select detection_id || '/a' as refined_id, detection_id as candidate_detection_id, frame_id, bbox_x, bbox_y, bbox_w, bbox_h, area, created_at, 'identity' as method from detections where flag = 'R' union all select detection_id || '/b', detection_id, frame_id, bbox_x, bbox_y, bbox_w, bbox_h, area, created_at + interval 1 day, 'model' from detections where flag = 'R' and bbox_w % 2 = 0",
    "jobs": """select o_orderkey as job_id, o_custkey as asset_id, substring(o_orderpriority, 3, 20) as stage,
       (['unknown', 'queued', 'leased', 'working', 'succeeded', 'failed', 'cancelled', 'dead_lettered'])[o_orderkey % 8 + 1] as status, o_orderdate as created_at, started_at, finished_at,
       '{"completed": ' || cast(o_orderkey % 97 as varchar) || ', "total": ' || case when o_orderkey % 5 = 0 then '"n/a"' else '100' end || '}' as progress
       from orders left join (select l_orderkey, min(l_shipdate) as started_at, max(l_shipdate) as finished_at from lineitem group by 1) on o_orderkey = l_orderkey""",
    "logs": "select event_id as id, ts as created_at, event_type, 'w' || cast(user_id % 8 as varchar) as worker_id, user_id % 1500 + 1 as job_id, value as duration_ms, props as payload from events",
    "images": "select vec_id as frame_id, label as asset_id, vec_id as frame_index, 8 as width, 8 as height, [cast(least(greatest(floor(cast(v as double) * 256 + 128), 0), 255) as integer) for v in embedding] as pixels from embeddings",
    "blobs": "select doc_id, source, text as payload, sha256(text) as key from documents",
    "pixels": "select frame_id, asset_id, frame_index, i - 1 as pos, (i - 1) % 8 as x, (i - 1) // 8 as y, pixels[i] as v from images, unnest(generate_series(1, 64)) as t(i)",
}
from framelake.sources import wide as _wide  # noqa: E402

VIEWS |= _wide.VIEWS
VIEWS["w_jobs"] = f"select * exclude (names, status_no), names[status_no + 1] as status from ({VIEWS['w_jobs']})"
NEEDS = {"assets": ["runs"], "refined": ["detections"], "pixels": ["images"]}


def sql(body: str, *views: str) -> str:
    """body with the named views before it."""
    names: list[str] = []
    for v in views:
        for n in [*NEEDS.get(v, []), *_wide.chain(v)]:
            if n not in names:
                names.append(n)
    if not names:
        return body.strip()
    head = ",\n".join(f"{n} as ({VIEWS[n]})" for n in names)
    body = body.strip()
    return f"with {head},\n{body[5:]}" if body.startswith("with ") else f"with {head}\n{body}"
