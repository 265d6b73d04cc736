"""Image-catalogue tables supplied from the given Parquet tables.

Operators take any DataFrames of these shapes.  Each view here has a SQL twin in
framelake.plans.twins, word for word, for the comparison with DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ["unknown", "queued", "leased", "working", "succeeded", "failed", "cancelled", "dead_lettered"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task joins, sorts or aggregates, where a query deals its rows by their number.
TASK_ROWS = 250_000


def parts(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Partitions in proportion to the tables' rows, which their footers tell, so that a task's memory does not grow with them; one for each core at least."""
    rows = sum(table(spark, sf_dir, n).count() for n in names)
    return max(rows // TASK_ROWS + 1, spark.sparkContext.defaultParallelism)


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("run_id"), F.col("n_name").alias("run_key"), F.col("n_regionkey").alias("project_id"))


def assets(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    c = table(spark, d, "customer")
    return c.join(r, c["c_nationkey"] == r["run_id"]).select(F.col("c_custkey").alias("asset_id"), "run_id", "project_id", "run_key", F.col("c_name").alias("filename"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("size_bytes"), F.array("c_mktsegment", "run_key").alias("collections"))


def dealt(spark: SparkSession, d: str, name: str, key: str, parts: int | None) -> DataFrame:
    x = table(spark, d, name)
    return x.repartition(parts, key) if parts else x


def frames(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """With parts, dealt by asset into that many partitions."""
    o = dealt(spark, d, "orders", "o_custkey", parts)
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("asset_id"), F.col("o_orderdate").alias("captured_at"), F.row_number().over(order).alias("frame_index"), (F.col("o_orderstatus") == "F").alias("has_preprocessed"), F.col("o_totalprice").alias("payload_size"))


def detections(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """With parts, dealt by frame into that many partitions."""
    x = dealt(spark, d, "lineitem", "l_orderkey", parts)
    return x.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("detection_id"), F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("roi_index"), (F.col("l_partkey") % 64).cast("int").alias("bbox_x"), (F.col("l_suppkey") % 64).cast("int").alias("bbox_y"), (F.col("l_quantity").cast("int") % 24 + 1).alias("bbox_w"), ((F.col("l_partkey") + F.col("l_suppkey")) % 24 + 1).cast("int").alias("bbox_h"), F.col("l_extendedprice").alias("area"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"), F.col("l_shipdate").alias("created_at"))


def refined(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    x = detections(spark, d, parts).where("flag = 'R'")
    columns = [F.col("detection_id").alias("candidate_detection_id"), "frame_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "area"]
    made = lambda mark, at, method: F.struct(F.concat(F.col("detection_id"), F.lit(mark)).alias("refined_id"), at.alias("created_at"), F.lit(method).alias("method"))
    first = made("/a", F.col("created_at"), "identity")
    second = F.when(F.col("bbox_w") % 2 == 0, made("/b", F.col("created_at") + F.expr("interval 1 day"), "model"))
    # One reading of the detections for both results.
    y = x.select(*columns, F.explode(F.array_compact(F.array(first, second))).alias("made"))
    return y.select("made.refined_id", *[c if isinstance(c, str) else "candidate_detection_id" for c in columns], "made.created_at", "made.method")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    o, x = table(spark, d, "orders"), table(spark, d, "lineitem")
    times = x.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("started_at"), F.max("l_shipdate").alias("finished_at"))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    joined = o.join(times, o["o_orderkey"] == times["l_orderkey"], "left")
    return joined.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("asset_id"), F.substring("o_orderpriority", 3, 20).alias("stage"), status.alias("status"), F.col("o_orderdate").alias("created_at"), "started_at", "finished_at", F.concat(F.lit('{"completed": '), (F.col("o_orderkey") % 97).cast("string"), F.lit(', "total": '), F.when(F.col("o_orderkey") % 5 == 0, F.lit('"n/a"')).otherwise(F.lit("100")), F.lit("}")).alias("progress"))


def logs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type"), F.concat(F.lit("w"), (F.col("user_id") % 8).cast("string")).alias("worker_id"), (F.col("user_id") % 1500 + 1).alias("job_id"), F.col("value").alias("duration_ms"), F.col("props").alias("payload"))


def images(spark: SparkSession, d: str) -> DataFrame:
    return as_images(table(spark, d, "embeddings"))


def as_images(embeddings: DataFrame) -> DataFrame:
    """Embeddings as square 8-bit frames: 64 floats are 8 x 8 pixels in row order."""
    pixel = lambda v: F.least(F.greatest(F.floor(v.cast("double") * 256 + 128), F.lit(0)), F.lit(255)).cast("int")
    return embeddings.select(F.col("vec_id").alias("frame_id"), F.col("label").alias("asset_id"), F.col("vec_id").alias("frame_index"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", pixel).alias("pixels"))


def blobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("payload"), F.sha2("text", 256).alias("key"))
