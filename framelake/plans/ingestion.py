"""Queries over file listings and line-scan frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import ingest
from framelake.sources import tables as t

from .register import query
from .twins import sql

#: Orders as a file listing: folders by customer, suffixes by order.
FILES = """files as (select '/data/' || o_orderstatus || '/' || cast(o_custkey % 50 as varchar) || '/Frame_' || cast(o_orderkey as varchar) ||
  (['.png', '.TIF', '.jpg', '.mp4', '.txt', '.AVI', ''])[o_orderkey % 7 + 1] as path, cast(trunc(o_totalprice) as bigint) as length from orders),
parts as (select path, length, lower(regexp_extract(path, '[^/.][^/]*\\.([^./]+)$', 1)) as suffix, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, regexp_extract(path, '([^/]*)$', 1) as name from files)"""
IMAGES = "('bmp', 'dib', 'jpeg', 'jpg', 'jp2', 'png', 'tif', 'tiff', 'webp')"
VIDEOS = "('avi', 'm4v', 'mkv', 'mov', 'mp4', 'mpeg', 'mpg', 'wmv')"


def files(spark: SparkSession, d: str) -> DataFrame:
    suffixes = F.array(*map(F.lit, [".png", ".TIF", ".jpg", ".mp4", ".txt", ".AVI", ""]))
    ending = F.element_at(suffixes, (F.col("o_orderkey") % 7 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), "o_orderstatus", F.lit("/"), (F.col("o_custkey") % 50).cast("string"), F.lit("/Frame_"), F.col("o_orderkey").cast("string"), ending)
    return t.table(spark, d, "orders").select(path.alias("path"), F.col("o_totalprice").cast("long").alias("length"))


@query(f"""with {FILES},
media as (select case when suffix in {IMAGES} then 'image_sequence' when suffix in {VIDEOS} then 'video' end as kind, case when suffix in {VIDEOS} then path else folder end as source, * from parts),
found as (select kind, source as path, count(*) as media_count, cast(sum(length) as bigint) as size_bytes, arg_min(name, (lower(name), name)) as first_name, arg_max(name, (lower(name), name)) as last_name from media where kind is not null group by 1, 2)
select *, 'uncomputed:size=' || cast(size_bytes as varchar) || ':file_count=' || cast(media_count as varchar) as checksum from found""")
def ingest_sources(spark: SparkSession, d: str) -> DataFrame:
    return ingest.discover_sources(files(spark, d))


@query(f"with {FILES} select folder, name as filename, path, cast(row_number() over (partition by folder order by lower(name), name) as integer) as frame_index from parts where suffix in {IMAGES}")
def image_frame_order(spark: SparkSession, d: str) -> DataFrame:
    return ingest.frame_order(files(spark, d))


@query(f"with {FILES} select folder, name as filename, path, cast(row_number() over (order by folder[7:], lower(name), name) as integer) as frame_index from parts where suffix in {IMAGES}")
def image_tree_order(spark: SparkSession, d: str) -> DataFrame:
    return ingest.frame_order(files(spark, d), "/data/")


@query(f"""with {FILES}, media as (select case when suffix in {IMAGES} then folder else path end as source, name, sha256(path) as hash, case when suffix in {IMAGES} then 'image_sequence' else 'video' end as kind, length from parts where suffix in {IMAGES} or suffix in {VIDEOS})
select kind, source as path, count(*) as media_count, sha256(string_agg(hash, ',' order by lower(name), name)) as content_hash from media group by 1, 2""")
def ingest_content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Files whose contents are their paths."""
    x = files(spark, d).withColumn("content", F.col("path").cast("binary"))
    return ingest.content_profiles(x).select("kind", "path", "media_count", "content_hash")


@query(sql("""with scan as (select frame_id // 10 as asset_id, cast(frame_id % 10 + 1 as integer) as frame_index, width, height, pixels from images)
select asset_id, cast((frame_index - 1) // 4 + 1 as integer) as tile_number, min(frame_index) as source_frame_start, max(frame_index) as source_frame_end, min(width) as width, cast(sum(height) as bigint) as height,
  count(*) < 4 as partial_tile, cast(list_sum(list_transform(flatten(list(pixels order by frame_index)), lambda v, i: v * i)) as bigint) as checksum from scan group by 1, 2""", "images"))
def line_scan_tiles(spark: SparkSession, d: str) -> DataFrame:
    frames = t.images(spark, d).withColumn("asset_id", F.expr("frame_id div 10")).withColumn("frame_index", (F.col("frame_id") % 10 + 1).cast("int"))
    checksum = F.aggregate(F.transform("pixels", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return ingest.line_scan_tiles(frames, 4).withColumn("checksum", checksum).drop("pixels")
