"""Content-addressed payloads: put, audit, status, references and orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Values that stand for a missing reference in a join.
SPREAD = 1 << 16


def put(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """What storing (key, payload) rows does: key, size, action.

    A new key is 'stored' once; a key that the store has with the same bytes is
    'kept'; a key with other bytes, in the store or among the incoming rows
    themselves, is a 'conflict', which nothing is written for.
    """
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    fresh = incoming.groupBy("key").agg(F.min("payload").alias("payload"), F.min(digest).alias("low"), F.max(digest).alias("high"))
    have = stored.select("key", digest.alias("stored"))
    x = fresh.join(have, "key", "left")
    action = F.when((F.col("low") != F.col("high")) | (F.col("stored") != F.col("low")), "conflict").when(F.col("stored").isNotNull(), "kept").otherwise("stored")
    return x.select("key", F.octet_length("payload").alias("size"), action.alias("action"))


def put_or_raise(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """put, where a conflict is an error."""
    x = put(incoming, stored)
    return x.withColumn("action", F.when(F.col("action") == "conflict", F.raise_error(F.concat(F.lit("other bytes are stored under key "), F.col("key")))).otherwise(F.col("action")))


def loaded(frames: DataFrame, store: DataFrame, kind: str = "original") -> DataFrame:
    """frames with the payload of that kind and that of their background, each null where nothing is named; a reference that the store lacks is an error.

    The original's key is payload_ref or, without one, the metadata's; the
    preprocessed one's is preprocessed_payload_ref.
    """
    own = {"original": F.coalesce("payload_ref", F.get_json_object("metadata", "$.payload_ref")), "preprocessed": F.col("preprocessed_payload_ref")}
    if kind not in own:
        raise ValueError(f"unknown payload kind {kind!r}; original or preprocessed")
    x = frames.withColumn("__fl_key", own[kind])
    for key, into in (("__fl_key", "payload"), ("background_payload_ref", "background_payload")):
        named = store.select(F.col("key").alias("__fl_k"), F.col("payload").alias(into), F.lit(True).alias("__fl_there"))
        missing = F.raise_error(F.concat(F.lit("no payload under key "), F.col(key))).cast(named.schema[into].dataType)
        # Frames that name nothing go to any task; as nulls all of them, with what they carry, would go to one.
        spread = F.coalesce(F.col(key), F.concat(F.lit("\0none/"), F.pmod(F.xxhash64(*x.columns), F.lit(SPREAD)).cast("string")))
        x = x.withColumn("__fl_spread", spread)
        x = x.join(named, (F.col("__fl_spread") == F.col("__fl_k")) & F.col(key).isNotNull(), "left").withColumn(into, F.when(F.col(key).isNotNull() & F.col("__fl_there").isNull(), missing).otherwise(F.col(into))).drop("__fl_k", "__fl_there", "__fl_spread")
    return x.drop("__fl_key")


def audit(store: DataFrame) -> DataFrame:
    """Rows whose payload does not hash to their key."""
    return store.where(F.sha2("payload", 256) != F.col("key"))


def prefix_status(store: DataFrame, letters: int = 2) -> DataFrame:
    return store.groupBy(F.substring("key", 1, letters).alias("prefix")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("payload")).alias("bytes"))


def reference_counts(frames: DataFrame, columns: list[str], key: str = "frame_id") -> DataFrame:
    """How many frames name each reference in any of the columns; one frame counts once."""
    refs = frames.select(key, F.explode(F.array_distinct(F.array(*columns))).alias("ref"))
    return refs.where("ref is not null and ref <> ''").groupBy("ref").agg(F.count("*").alias("frames"))


def orphans(refs: DataFrame, owner: str, value: str | int) -> DataFrame:
    """References that only the given owner has: what goes when it is deleted."""
    return refs.groupBy("ref").agg(F.min(owner).alias("low"), F.max(owner).alias("high")).where((F.col("low") == value) & (F.col("high") == value)).select("ref")
