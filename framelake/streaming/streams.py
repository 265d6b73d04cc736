"""Streaming forms: hopping means of events, event tails, current status, progress.

Each builder takes a streaming (or batch) DataFrame of events and returns a
DataFrame; `run_once` drives a stream over what is there and returns its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.sources.shared import new_folder


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream, be it one file or a folder of files: a pattern may name either, a plain path only a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with event time as a timestamp."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that is there into a Parquet table of the shared folder, then read it; no row passes the driver.

    The checkpoint stands beside the table.  In append mode the sink's own log
    names the table's files; in complete mode each batch, which is the whole
    result, is a table of its own, and the last one is read.
    """
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession)
    path = f"{folder}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    done = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
        done.append(batch_id)

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch-{max(done)}") if done else spark.createDataFrame([], stream.schema)


def hopping_mean(events: DataFrame, width: str, stride: str, delay: str) -> DataFrame:
    """Mean value of each event type in sliding windows; in append mode a window is given, and its state dropped, once the watermark passes it."""
    x = events.withWatermark("ts", delay).groupBy(F.window("ts", width, stride), "event_type")
    return x.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.unix_seconds("window.start").alias("window_start"), "event_type", "n", "mean")


#: The type of the event that ends a stream.
END = "(end of input)"


def ended(stream: DataFrame, table: DataFrame, after: str) -> DataFrame:
    """A stream of the table's events with one more, of type END, so long after the last one that the watermark closes every window."""
    folder = new_folder(table.sparkSession)
    last = table.agg((F.max(F.col("ts").cast("timestamp")) + F.expr(f"interval {after}")).alias("ts"))
    columns = [F.col("ts") if c == "ts" else F.lit(END).alias(c) if c == "event_type" else F.lit(None).cast(t).alias(c) for c, t in stream.dtypes]
    last.select(*columns).where("ts is not null").write.parquet(folder)
    return stream.unionByName(table.sparkSession.readStream.schema(stream.schema).parquet(folder))


def order_violations(frames: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Frames whose index does not rise over that of the frame before, in order of arrival, within their asset: asset_id, arrival, frame_index, previous."""
    before = F.lag("frame_index").over(Window.partitionBy("asset_id").orderBy(arrival))
    return frames.withColumn("previous", before).where(F.col("frame_index") <= F.col("previous")).select("asset_id", arrival, "frame_index", "previous")


def in_order_or_raise(frames: DataFrame, arrival: str = "arrival") -> DataFrame:
    """frames, where a violation of their order is an error."""
    before = F.lag("frame_index").over(Window.partitionBy("asset_id").orderBy(arrival))
    wrong = F.raise_error(F.lit("frame index does not rise")).cast("long")
    return frames.withColumn("frame_index", F.when(F.coalesce(F.col("frame_index") <= before, F.lit(False)), wrong).otherwise(F.col("frame_index")))


def stored_frames(frames: DataFrame, *steps) -> DataFrame:
    """Arriving frames through each step in turn, as a stream that ends in a sink."""
    for step in steps:
        frames = frames.transform(step)
    return frames


def tail_after(events: DataFrame, after_id: int) -> DataFrame:
    """Events past an id; the stream's checkpoint takes the cursor's place."""
    return events.where(F.col("event_id") > after_id).select("event_id", "event_type", "user_id")


def current_status(events: DataFrame) -> DataFrame:
    """The last event type and the count of each key."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))


def progress(events: DataFrame) -> DataFrame:
    """The highest counter and the highest total seen for each key, and what share that is, in percent, 100 at most."""
    k = F.get_json_object("props", "$.k").cast("long")
    x = events.groupBy("user_id").agg(F.max(k).alias("done"), F.max(F.ceil("value")).alias("total"))
    return x.withColumn("percent", F.when(F.col("total") > 0, F.round(F.least(F.lit(100.0), 100 * F.col("done") / F.col("total")), 4)))


def workers_online(events: DataFrame) -> DataFrame:
    """Last beat and number of beats of each worker."""
    return events.groupBy((F.col("user_id") % 8).alias("worker")).agg(F.unix_seconds(F.max("ts")).alias("last_seen"), F.count("*").alias("beats"))


def online(workers: DataFrame, now: int, interval: int) -> DataFrame:
    """Workers with whether they beat within the last two intervals, all in seconds."""
    return workers.withColumn("online", F.col("last_seen") >= now - 2 * interval)
