"""Exact de-duplication with a heavy-hitter split.

Misra-Gries sketches, one for each task and merged by a sum, find the digests
that may be frequent.  Their exact counts and winners are then taken from all
rows, and the verified ones are broadcast (at most `counters` rows), so that
rows of frequent texts are settled where they stand.  Only the other digests
are shuffled, and none of those has a group above rows / counters.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Of equal texts the row with the largest doc_id stays (null ids are smallest);
of rows with the same text and id, exactly one stays.  An empty table gives no
rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Counters of each sketch, and so the most rows that are broadcast.
COUNTERS = 1024


def trim(counts: Counter, most: int) -> Counter:
    """Misra-Gries merge step: take the (most + 1)-th largest count off all, keep what is above 0."""
    if len(counts) <= most:
        return counts
    cut = counts.most_common(most + 1)[-1][1]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def sketch(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, n): at most `counters` rows; every digest in more than rows / counters rows is among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).value_counts():
                counts[x["values"].as_py()] += x["counts"].as_py()
            counts = trim(counts, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    merged = digests.select("digest").mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return merged.where("n > 1").orderBy(F.desc("n"), "digest").limit(counters)


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, keep_id, group_size, kept, text_sha256."""
    table = docs.select("doc_id", common.text_hash("text").alias("text_hash"), F.unhex(F.sha2(common.ascii_lower("text").cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row_key"))
    rows = common.materialize(table, "digests")
    best = F.max(F.struct("doc_id", "row_key"))
    heavy = F.broadcast(common.materialize(sketch(rows, counters), "frequent").select("digest"))
    winners = common.materialize(rows.join(heavy, "digest").groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")), "winners")
    named = F.broadcast(winners.select(F.col("digest").alias("w_digest"), "best", "group_size"))
    marked = rows.join(named, F.col("digest") == F.col("w_digest"), "left")
    same = Window.partitionBy("digest")
    rest = marked.where("w_digest is null").select("doc_id", "text_hash", "digest", "row_key").withColumn("best", best.over(same)).withColumn("group_size", F.count("*").over(same))
    columns = ["doc_id", "text_hash", "digest", "row_key", "best", "group_size"]
    both = marked.where("w_digest is not null").select(*columns).unionByName(rest.select(*columns))
    return both.select("doc_id", "text_hash", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row_key") == F.col("row_key")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    kept = common.materialize(exact_dedup(docs).where("kept").select("doc_id", "text_hash"), "kept")
    return common.keep_rows(docs, kept)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir)).drop("text_hash")


ORACLE = {
    "op6_exact_dedup": """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
"""
}
