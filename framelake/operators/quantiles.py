"""Exact quantiles of large groups without gathering a group's values.

Each pass counts a group's values in buckets of the interval that still holds a
wanted rank, with map-side sums, so that a pass shuffles a row for each bucket
and task at most.  The rank's bucket, by its least and largest value, is the
next interval; it ends when that is one value, or has so few that they are
gathered.  A pass or two is usual, seven the most: one over powers of two, and
those that tell a double's 53 bits apart.  No task holds more than GATHERED
values, or some thousand counts, of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.shared import write_shared

#: Buckets of an interval; values of an interval that are gathered.
BUCKETS, GATHERED = 4096, 4096


def order_statistics(values: DataFrame, ranks: DataFrame, buckets: int = BUCKETS, gathered: int = GATHERED) -> DataFrame:
    """(k, rank, v): the values at the wanted ranks (k, rank, from 0) of values(k, v), which has no nulls; k is any type, structs with nulls too.

    NaN comes after all other values, as Spark orders it, and counts as one value.
    """
    spread = values.where(~F.isnan("v")).groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = ranks.join(spread, "k", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "below": F.lit(0).cast("long")})
    found = [wanted.where("rank >= n").select("k", "rank", F.lit(float("nan")).alias("v"))]
    wanted = write_shared(wanted.where("rank < n").select("k", "rank", "low", "high", "n", "below"))
    while True:
        found.append(wanted.where("low = high").select("k", "rank", F.col("low").alias("v")))
        open_ = wanted.where("low < high")
        few = open_.where(F.col("n") <= gathered)
        own = inside(values, few).groupBy("k", "low").agg(F.sort_array(F.collect_list("v")).alias("all"))
        found.append(few.join(own, ["k", "low"]).select("k", "rank", F.element_at("all", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v")))
        many = open_.where(F.col("n") > gathered)
        if many.isEmpty():
            break
        counted = inside(values, many).groupBy("k", "low", bucket(buckets).alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("k", "low").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = counted.withColumn("before", before).withColumnRenamed("n", "own")
        next_ = many.join(parts, ["k", "low"]).withColumn("place", F.col("rank") - F.col("below") - F.col("before")).where("place >= 0 and place < own")
        wanted = write_shared(next_.select("k", "rank", F.col("least").alias("low"), F.col("most").alias("high"), F.col("own").alias("n"), (F.col("below") + F.col("before")).alias("below")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def bucket(buckets: int) -> Column:
    """The part of its interval that v lies in; rises with v, and parts the ends of an interval.

    Intervals of like values have parts of equal width; those over zero or many
    magnitudes first have one for each power of two, so that values of any
    distribution need few passes.
    """
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    power = F.floor(F.log2(F.abs(v))) + 1100
    by_power = F.when(v > 0, power).when(v < 0, -power).otherwise(0)
    near = F.least(F.floor((v - low) / (high - low) * buckets), F.lit(buckets - 1))
    return F.when(((low > 0) & (high / buckets <= low)) | ((high < 0) & (low / buckets >= high)), near).otherwise(by_power)


def inside(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """The values that lie in an interval of their group, with it; a group has a few, which do not overlap."""
    own = intervals.groupBy("k").agg(F.collect_set(F.struct("low", "high")).alias("intervals"))
    held = values.join(own, "k").withColumn("i", F.get(F.filter("intervals", lambda i: (F.col("v") >= i["low"]) & (F.col("v") <= i["high"])), F.lit(0)))
    return held.where("i is not null").select("k", "v", F.col("i.low").alias("low"), F.col("i.high").alias("high"))


def quantiles(rows: DataFrame, keys: list[str], value: Column | str, probabilities: list[float]) -> DataFrame:
    """One row for each group that has a value: keys, n and q, the interpolated quantiles in the order of the probabilities."""
    value = F.col(value) if isinstance(value, str) else value
    values = rows.select(F.struct(*keys).alias("k"), value.cast("double").alias("v")).where("v is not null")
    sizes = values.groupBy("k").agg(F.count("*").alias("n"))
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    both = F.array_distinct(F.concat(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in probabilities]))
    found = order_statistics(values, sizes.select("k", F.explode(both).alias("rank")))
    ranked = found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def interpolated(p: float) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(low == high, a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    return sizes.join(ranked, "k").select("k.*", "n", F.array(*map(interpolated, probabilities)).alias("q"))


def spreads(rows: DataFrame, keys: list[str], values: dict[str, Column | str]) -> DataFrame:
    """For each group and value, by its name: count, mean, three percentiles, largest and sum; a group without a value has nulls."""
    totals, own = [], {n: F.col(c) if isinstance(c, str) else c for n, c in values.items()}
    for i, (name, c) in enumerate(own.items()):
        totals += [F.count(c).alias("n" if i == 0 else f"n_{name}"), F.round(F.avg(c), 4).alias(f"avg_{name}"), F.round(F.max(c), 4).alias(f"max_{name}"), F.round(F.sum(c), 2).alias(f"total_{name}")]
    out = rows.groupBy(*keys).agg(*totals).withColumn("k", F.struct(*keys))
    for name, c in own.items():
        q = quantiles(rows, keys, c, [0.5, 0.9, 0.95]).select(F.struct(*keys).alias("k"), *[F.round(F.col("q")[i], 4).alias(f"p{p}_{name}") for i, p in enumerate((50, 90, 95))])
        out = out.join(q, "k", "left")
    columns = [c for i, name in enumerate(own) for c in ("n" if i == 0 else f"n_{name}", f"avg_{name}", f"p50_{name}", f"p90_{name}", f"p95_{name}", f"max_{name}", f"total_{name}")]
    return out.select(*keys, *columns)
