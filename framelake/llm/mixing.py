"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule draws the source whose stretch of the cumulative targets
holds the t-th golden-ratio point.  Slots are ranked per source, and slot r of
a source takes block r of its words: its documents in shuffled order, end to
end and over again, cut into blocks of equal words.  The schedule has as many
slots as blocks fill the pool, and what it draws is what is taken: a source
drawn k times gives k blocks, within about two blocks of its target, for
golden-ratio points are spread so evenly; no document gives more than `repeat`
times its own words.  The slots are also the mix's order.

Points are exact: multiples of one Fibonacci number modulo the next.  Nothing
is ordered in one task: documents are ranked within hash ranges of their
source, slots within runs of SLOT_RUN, with prefix sums over both, and points
find their source within cells of the unit interval.  The sources' plan is a
table of its own, of any number of sources.

Null texts have size 0 and are taken 0 times, as are empty ones; a null source
is a source of its own, last in order.  Very long texts are spread over their
blocks.  Repeated rows and ids count one by one.  An empty table gives no rows.
Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, REPEAT = (5, 2, 1), 1.5, 2.0
BLOCK_WORDS, SLOT_RUN = 64, 16_384
#: Documents in a hash range of a source, and slots in a cell of the unit interval, about.
RANGE_ROWS, CELL_SLOTS = 2_000, 65_536
#: Two Fibonacci numbers in a row.
FIBONACCI = (365_435_296_162, 591_286_729_879)


def golden(t: Column) -> Column:
    """The t-th golden-ratio point of the unit interval."""
    a, m = FIBONACCI
    t = t % m
    low, high = t % 2**20, F.shiftright(t, 20)
    return (low * a + high * (a * 2**20 % m)) % m / m


def van_der_corput(t: Column) -> Column:
    """The t-th van der Corput point to base two: t's 40 bits read backwards."""
    return F.conv(F.reverse(F.lpad(F.bin(t), 40, "0")), 2, 10).cast("double") / 2**40


def words_of(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_level(sources: DataFrame, pool: float, repeat: float) -> float:
    """Words for each unit of weight once no source is above repeat times its size.

    sources has source_size and weight.  Each step reshares what the sources
    above their limit leave; the level only rises, so that they stay above.
    """
    level, seen = 0.0, -1
    while True:
        over = F.col("weight") * level > repeat * F.col("source_size")
        n, held, free = sources.where("source_size > 0").agg(F.count_if(over), F.coalesce(F.sum(F.when(over, repeat * F.col("source_size"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == seen or not free:
            return level if free else math.inf
        level, seen = (pool - held) / free, n


def plan_sources(sized: DataFrame, weights: tuple[float, ...], share: float, repeat: float) -> DataFrame:
    """One row for each source: source, source_index (by code point, null last), source_size, rows, target, low (the targets before its own)."""
    keys = [F.col("source").isNull(), F.col("source").cast("string")]
    parts = common.in_parts(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), keys, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_index") % len(weights) + 1).cast("int"))
    numbered = common.running(parts, keys, F.lit(1), "source_index").withColumn("source_index", F.col("source_index").cast("long"))
    weighed = common.materialize(numbered.withColumn("weight", weight), "weighed")
    pool = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(weighed, pool, repeat)
    most = repeat * F.col("source_size").cast("double")
    goal = F.when(F.col("source_size") == 0, 0.0).when(F.col("weight") * level > most, most).otherwise(F.col("weight") * level)
    planned = weighed.withColumn("target", goal)
    return common.materialize(common.running(planned, keys, F.col("target"), "low").drop("part", "weight"), "plan")


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS, points: Callable[[Column], Column] = golden) -> DataFrame:
    """The mix, one row for each slot: t, source_index, rank (the source's slots before it)."""
    spark = plan.sparkSession
    wanted = plan.where("target > 0")
    total, sources, last = wanted.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*"), F.max("source_index")).first()
    slots = max(1, round(total / block_words)) if total else 0
    cells = 1 << max(0, math.ceil(math.log2(max(4 * sources, slots / CELL_SLOTS, 1))))
    low, high = F.col("low") / total if total else F.col("low"), F.when(F.col("source_index") == last, 1.0).otherwise((F.col("low") + F.col("target")) / (total or 1.0))
    cell = lambda u: F.least(F.floor(u * cells), F.lit(cells - 1)).cast("long")
    starts = wanted.select("source_index", low.alias("u"), F.explode(F.sequence(cell(low), F.greatest(cell(low), cell(high)))).alias("cell"))
    starts = starts.select("cell", F.greatest("u", F.col("cell") / cells).alias("u"), F.lit(-1).cast("long").alias("t"), "source_index")
    drawn = spark.range(slots).select(points(F.col("id")).alias("u"), F.col("id").alias("t"))
    drawn = drawn.select(cell(F.col("u")).alias("cell"), "u", "t", F.lit(None).cast("long").alias("source_index"))
    # Within a cell a point belongs to the last source that starts at or before it.
    order = Window.partitionBy("cell").orderBy("u", F.col("t") >= 0, "source_index").rowsBetween(Window.unboundedPreceding, 0)
    found = drawn.unionByName(starts).withColumn("source_index", F.last("source_index", ignorenulls=True).over(order)).where("t >= 0")
    found = common.materialize(found.select("t", "source_index", F.expr(f"t div {SLOT_RUN}").alias("run")), "drawn")
    runs = found.groupBy("source_index", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_index").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("source_index", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_index", "run").orderBy("t")
    return found.withColumn("place", F.row_number().over(within) - 1).join(bases, ["source_index", "run"]).select("t", "source_index", (F.col("base") + F.col("place")).alias("rank"))


def shuffled(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """sized with its source's columns and start: the words of its source before the document, in shuffled order."""
    named = plan.select(F.col("source").alias("plan_source"), "source_index", "source_size", "target", "given", F.greatest(F.lit(1).cast("long"), F.expr(f"rows div {RANGE_ROWS}")).alias("ranges"))
    keyed = sized.join(named, F.col("source").eqNullSafe(F.col("plan_source")))
    keyed = keyed.withColumn("order", F.xxhash64("doc_id", "text_hash", F.lit(seed))).withColumn("range", F.pmod(F.shiftrightunsigned("order", 20), F.col("ranges")))
    totals = keyed.groupBy("source_index", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source_index").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_index", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_index", "range").orderBy("order", "doc_id", "text_hash", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("place", F.coalesce(F.sum("size").over(within), F.lit(0))).join(totals, ["source_index", "range"])
    return placed.withColumn("start", F.col("base") + F.col("place")).select("doc_id", "text_hash", "row_key", "size", "source_index", "source_size", "target", "given", "start")


def takes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT, block_words: int = BLOCK_WORDS, seed: int = 0, points: Callable[[Column], Column] = golden) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with their source's figures, and their parts in the mix: row_key, pass, slot (the first), words (from the text's start)."""
    sized = common.materialize(docs.select("doc_id", "source", common.text_hash("text").alias("text_hash"), words_of("text").alias("size"), F.monotonically_increasing_id().alias("row_key")), "sizes")
    plan = plan_sources(sized, weights, share, repeat)
    slots = common.materialize(schedule(plan, block_words, points), "slots")
    drawn = slots.groupBy("source_index").agg(F.count("*").alias("slots"))
    given = F.least(F.coalesce("slots", F.lit(0)) * block_words, F.floor(repeat * F.col("source_size")))
    plan = common.materialize(plan.join(drawn, "source_index", "left").withColumn("given", given.cast("long")), "given")
    placed = common.materialize(shuffled(sized, plan, seed), "placed")
    passes = F.expr("sequence(0L, (given - start - 1) div source_size)")
    parts = placed.where("size > 0 and start < given").select("row_key", "source_index", "size", "given", "source_size", "start", F.explode(passes).alias("pass"))
    parts = parts.withColumn("from", F.col("pass") * F.col("source_size") + F.col("start")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("given")))
    blocks = parts.select("row_key", "source_index", "pass", "from", "to", F.explode(F.expr(f"sequence(from div {block_words}, (to - 1) div {block_words})")).alias("rank"))
    words = F.least(F.col("to"), (F.col("rank") + 1) * block_words) - F.greatest(F.col("from"), F.col("rank") * block_words)
    met = blocks.join(slots, ["source_index", "rank"]).groupBy("row_key", "pass").agg(F.min("t").alias("slot"), F.sum(words).alias("words"))
    return placed, met


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, first_slot (null if not taken); `how` as for takes."""
    placed, met = takes(docs, **how)
    taken = met.groupBy("row_key").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return placed.join(taken, "row_key", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in the schedule's order: one row for each time a document is taken, the last time's text cut to the words taken.

    Rows that share id and text differ in nothing that is read, so that one of
    them stands for all.  Rows are range-partitioned and sorted by their first
    slot, with the columns of docs.
    """
    placed, met = takes(docs, **how)
    key = F.struct("doc_id", "__fl_hash").alias("__fl_key")
    # Hashes are never null, and must be seen so on both sides: keys of unlike types would be cast, and the texts shuffled again.
    text_hash = F.coalesce("text_hash", F.lit(0).cast("long")).alias("__fl_hash")
    each_take = placed.select("row_key", F.col("size").alias("__fl_size"), "doc_id", text_hash).join(met, "row_key")
    each_take = each_take.select(key, "__fl_size", F.col("slot").alias("__fl_slot"), F.col("words").alias("__fl_words"))
    marked = docs.withColumn("__fl_hash", common.text_hash("text")).withColumn("__fl_key", key).drop("__fl_hash")
    # The window's limit is applied before its shuffle, and the join keeps its partitioning.
    first = marked.withColumn("__fl_rank", F.row_number().over(Window.partitionBy("__fl_key").orderBy(F.lit(1)))).where("__fl_rank = 1")
    each = first.join(each_take, "__fl_key")
    cut = F.col("__fl_words") < F.col("__fl_size")
    each = each.withColumn("text", F.when(cut, first_words(F.col("text"), F.col("__fl_words"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        each = each.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    each = each.select(*[F.col(f"`{c}`") for c in docs.columns], "__fl_slot")
    return each.repartitionByRange("__fl_slot").sortWithinPartitions("__fl_slot").drop("__fl_slot")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents in the schedule's order."""
    return mixed_documents(docs)


def first_words(text: Column, n: Column) -> Column:
    """The first n words, joined by single spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), " ")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))
