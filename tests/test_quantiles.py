"""Exact quantiles by counting against sorted values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import quantiles as q


def groups():
    rng = random.Random(3)
    out = {"even": [rng.random() for _ in range(500)], "ties": [rng.choice([1.0, 1.0, 1.0, 2.0, -3.0]) for _ in range(700)], "one": [4.5], "two": [1.0, 2.0], "same": [7.0] * 300}
    out["skewed"] = [10 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(400)]
    out["wide"] = [-1.7e308, 1.7e308, 0.0, 5e-324, -0.0] * 20
    out["near"] = [1.0 + i * 2.0**-52 for i in range(200)]
    out[None] = [float(i) for i in range(100)]
    return out


@pytest.mark.parametrize("buckets,gathered", [(16, 1), (300, 16), (4096, 4096)])
def test_order_statistics(spark, buckets, gathered):
    rows = [(k, v) for k, own in groups().items() for v in own]
    random.Random(1).shuffle(rows)
    values = spark.createDataFrame(rows, "g string, v double").select(F.struct("g").alias("k"), "v").repartition(3)
    ranks = [(k, r) for k, own in groups().items() for r in {0, len(own) - 1, len(own) // 2, len(own) // 3}]
    wanted = spark.createDataFrame(ranks, "g string, rank long").select(F.struct("g").alias("k"), "rank")
    got = {(x["k"]["g"], x["rank"]): x["v"] for x in q.order_statistics(values, wanted, buckets, gathered).collect()}
    assert got == {(k, r): sorted(groups()[k])[r] for k, r in ranks}


def test_spreads(spark):
    rows = [(k, v, -v if i % 2 else None) for k, own in groups().items() if k not in ("skewed", "wide") for i, v in enumerate(own)] + [("none", None, None), ("nan", math.nan, 1.0), ("nan", 2.0, 1.0)]
    got = {x["g"]: x for x in q.spreads(spark.createDataFrame(rows, "g string, v double, w double"), ["g"], {"v": "v", "w": "w"}).collect()}
    for k, own in groups().items():
        if k in got:
            for p in (50, 90, 95):
                assert math.isclose(got[k][f"p{p}_v"], round(float(np.percentile(own, p)), 4), abs_tol=1e-4)
            assert got[k]["n"] == len(own) and got[k]["n_w"] == len(own) // 2
    assert got["none"]["p50_v"] is None and got["none"]["n"] == 0
    assert math.isnan(got["nan"]["p95_v"]) and got["nan"]["p50_w"] == 1
    assert got["one"]["p50_w"] is None
    assert q.spreads(spark.createDataFrame([], "g string, v double"), ["g"], {"v": "v"}).collect() == []


def test_no_task_gathers_a_large_group(spark):
    """A million values: the plan has no percentile and no list but of GATHERED values."""
    values = spark.range(1_000_000).select(F.struct(F.lit(1).alias("g")).alias("k"), F.expr("cast(hash(id) as double) / 7").alias("v"))
    got = q.order_statistics(values, spark.sql("select struct(1 as g) as k, explode(array(10L, 499999L, 999999L)) as rank"))
    want = np.sort(values.select("v").toPandas()["v"].to_numpy())[[10, 499_999, 999_999]]
    assert sorted(x["v"] for x in got.collect()) == want.tolist()
