"""Discovery of image folders and video files, frame order, profiles, and line-scan tiling."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources.shared import write_shared

from .catalog import filename_timestamp
from .scalars import GRAY_BITS, GRAY_WEIGHTS
from .status import work_batches

#: The file suffixes of frames and of videos.
IMAGE_SUFFIXES = ["bmp", "dib", "jpeg", "jpg", "jp2", "png", "tif", "tiff", "webp"]
VIDEO_SUFFIXES = ["avi", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "wmv"]


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length and modification time of the files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", "length", "modificationTime")


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def folder(path: Column | str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_image(path: Column | str) -> Column:
    return suffix(path).isin(IMAGE_SUFFIXES)


def is_video(path: Column | str) -> Column:
    return suffix(path).isin(VIDEO_SUFFIXES)


def discover_sources(files: DataFrame) -> DataFrame:
    """One source for each folder that holds images itself and for each video, with its profile.

    files has path and length.  Returns kind, path, media_count, size_bytes,
    first_name, last_name and the checksum's stand-in until contents are hashed.
    Sizes are added up before the shuffle, so a huge folder is one row a task.
    """
    kind = F.when(is_image("path"), "image_sequence").when(is_video("path"), "video")
    media = files.select(kind.alias("kind"), F.col("path").alias("file"), "length").where("kind is not null")
    source = F.when(F.col("kind") == "video", F.col("file")).otherwise(folder("file"))
    order = F.struct(F.lower(name("file")), name("file"))
    found = media.groupBy("kind", source.alias("path")).agg(F.count("*").alias("media_count"), F.sum("length").alias("size_bytes"), F.min_by(name("file"), order).alias("first_name"), F.max_by(name("file"), order).alias("last_name"))
    stand_in = F.concat(F.lit("uncomputed:size="), F.col("size_bytes").cast("string"), F.lit(":file_count="), F.col("media_count").cast("string"))
    return found.withColumn("checksum", stand_in)


def content_profiles(files: DataFrame, most: int | None = None) -> DataFrame:
    """discover_sources with hashes of the contents: files has path, length and content (binary).

    A source's checksum is the hash of its files' own hashes in order of their
    names; of more than `most` files, if that is given, the hash of the hashes
    of that many at a time, and so on.  captured_at is the time its first
    file's name tells, if it does.  Each file is hashed where it is read; only
    hashes are shuffled.
    """
    kind = F.when(is_image("path"), "image_sequence").when(is_video("path"), "video")
    media = files.select(kind.alias("kind"), F.col("path").alias("file"), F.sha2("content", 256).alias("hash")).where("kind is not null")
    source = F.when(F.col("kind") == "video", F.col("file")).otherwise(folder("file"))
    named = media.select("kind", source.alias("path"), name("file").alias("name"), "hash").withColumn("lower", F.lower("name"))
    hashes = hashed_in_order(named) if most is None else hashed_in_chunks(named, most)
    found = discover_sources(files)
    captured = found.withColumn("captured_at", filename_timestamp(F.col("first_name")))
    return captured.join(hashes, ["kind", "path"])


def hashed_in_order(named: DataFrame) -> DataFrame:
    """One hash of each source's hashes, which are fed to it as they come, sorted, from the shuffle; no row or batch holds a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, digest = None, hashlib.sha256()
        for b in batches:
            out: list[tuple] = []
            for kind, path, value in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (kind, path) == source:
                    digest.update(b",")
                else:
                    if source is not None:
                        out.append((*source, digest.hexdigest()))
                    source, digest = (kind, path), hashlib.sha256()
                digest.update(value.encode())
            yield rows(out)
        if source is not None:
            yield rows([(*source, digest.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["kind", "path", "content_hash"])

    placed = named.repartition("kind", "path").sortWithinPartitions("kind", "path", "lower", "name", "hash")
    return placed.select("kind", "path", "hash").mapInArrow(run, "kind string, path string, content_hash string")


def hashed_in_chunks(named: DataFrame, most: int) -> DataFrame:
    """Hashes of hashes, `most` at a time, until one is left of each source."""
    level = write_shared(ranked(named, ["kind", "path"], ["lower", "name"]).select("kind", "path", (F.col("rank") - 1).alias("at"), "hash"))
    done: list[DataFrame] = []
    while True:
        listed = F.sort_array(F.collect_list(F.struct("at", "hash")))  # of `most` hashes
        chunk = F.floor(F.col("at") / most).alias("chunk")
        hashed = level.groupBy("kind", "path", chunk).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["hash"]), ","), 256).alias("hash"))
        level = write_shared(hashed.withColumnRenamed("chunk", "at"))
        larger = level.where("at > 0").select("kind", "path").distinct()
        done.append(level.join(larger, ["kind", "path"], "left_anti"))
        if larger.isEmpty():
            break
        level = level.join(larger, ["kind", "path"], "left_semi")
    return functools.reduce(DataFrame.unionByName, done).select("kind", "path", F.col("hash").alias("content_hash"))


def ranked(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """rows with their rank from 1 within their group; a group of any size is spread over tasks."""
    numbered = work_batches(rows, [*groups, *order], 1).drop("batch")
    first = numbered.groupBy(*groups).agg(F.min("unit").alias("first"))
    return numbered.join(first, groups).withColumn("rank", F.col("unit") - F.col("first") + 1).drop("unit", "first")


def frame_order(files: DataFrame, root: str | None = None) -> DataFrame:
    """Images with frame_index, their rank from 1 by lower-cased name: within each folder or, below a root, over all its folders by relative folder and name."""
    images = files.where(is_image("path")).select(folder("path").alias("folder"), name("path").alias("filename"), "path")
    images = images.withColumn("lower", F.lower("filename"))
    if root is None:
        order = ranked(images, ["folder"], ["lower", "filename"])
        return order.select("folder", "filename", "path", F.col("rank").cast("int").alias("frame_index"))
    base = root.rstrip("/")
    inside = images.where(F.col("path").startswith(base + "/")).withColumn("relative", F.substring("folder", len(base) + 2, 1 << 20))
    placed = work_batches(inside, ["relative", "lower", "filename"], 1)
    return placed.select("folder", "filename", "path", (F.col("unit") + 1).cast("int").alias("frame_index"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files below a folder as gray frames: path, frame_index (its rank), width, height, pixels."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(path).select("image.*")
    schema = "path string, width int, height int, pixels array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for origin, h, w, n, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h * w, n).astype(np.int64)
                gray = a[:, 0] if n == 1 else (a[:, :3] @ np.array(GRAY_WEIGHTS) + (1 << (GRAY_BITS - 1))) >> GRAY_BITS
                out.append((origin, w, h, gray.astype(np.int32)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.int32()))], names=["path", "width", "height", "pixels"])

    frames = raw.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, schema)
    order = frame_order(frames.select("path"))
    return frames.join(order.select("path", "frame_index"), "path")


def line_scan_tiles(frames: DataFrame, n_tile: int) -> DataFrame:
    """Every n_tile frames of an asset, one above the other, as one tile; an asset's last tile may be partial.

    frames has asset_id, frame_index from 1, width, height and pixels in row
    order.  A tile never holds more than n_tile frames, so groups are bounded.
    Frames of unequal width cannot be stacked and raise an error.
    """
    tile = F.floor((F.col("frame_index") - 1) / n_tile).cast("int") + 1
    parts = F.sort_array(F.collect_list(F.struct("frame_index", "pixels")))
    stacked = frames.groupBy("asset_id", tile.alias("tile_number")).agg(
        F.min("frame_index").alias("source_frame_start"),
        F.max("frame_index").alias("source_frame_end"),
        F.min("width").alias("width"),
        F.max("width").alias("widest"),
        F.sum("height").alias("height"),
        F.count("*").alias("n_frames"),
        F.flatten(F.transform(parts, lambda p: p["pixels"])).alias("pixels"),
    )
    width = F.when(F.col("width") == F.col("widest"), F.col("width")).otherwise(F.raise_error(F.lit("frames of unequal width in a tile")).cast("int"))
    return stacked.select("asset_id", "tile_number", "source_frame_start", "source_frame_end", width.alias("width"), "height", (F.col("n_frames") < n_tile).alias("partial_tile"), "pixels")
