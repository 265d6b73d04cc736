"""Clusters, components and samples against NumPy and plain sorting."""

import hashlib

import numpy as np
import pytest

from framelake.operators import embeddings as e


def vectors(spark, x, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(parts)


def blobs(k=4, each=60, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, 6)) * 20
    return centres, np.concatenate([c + rng.normal(size=(each, 6)) for c in centres]).astype(np.float32)


def test_clusters_find_blobs_and_inertia_never_rises(spark):
    centres, x = blobs()
    found, got, inertias = e.kmeans(vectors(spark, x), 4)
    assert all(b <= a * (1 + 1e-12) for a, b in zip(inertias, inertias[1:])) and len(got) == 4
    assert sorted(np.linalg.norm(got[:, None] - centres[None], axis=2).min(axis=1))[-1] < 1
    clusters = {r["vec_id"]: r["cluster"] for r in found.collect()}
    assert all(len({clusters[i] for i in range(b * 60, b * 60 + 60)}) == 1 for b in range(4))
    again = e.kmeans(vectors(spark, x, 2), 4)[0]
    assert {r["vec_id"]: r["cluster"] for r in again.collect()} == clusters


def test_one_step_equals_numpy(spark):
    _, x = blobs(3, 40, 5)
    centres = x[:5].astype(float)
    new, sizes, inertia = e.lloyd_step(e.usable(vectors(spark, x), "vec_id", "embedding"), centres)
    far = ((x[:, None].astype(float) - centres[None]) ** 2).sum(axis=2)
    at = far.argmin(axis=1)
    assert np.isclose(inertia, far.min(axis=1).sum()) and sizes.tolist() == np.bincount(at, minlength=5).tolist()
    assert np.allclose(new, [x[at == i].mean(axis=0) if (at == i).any() else centres[i] for i in range(5)], atol=1e-6)


def test_rows_that_take_no_part(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, []), (5, [1.0, None]), (6, [3.0, 4.0]), (7, [float("inf"), 0.0])]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, centres, _ = e.kmeans(x, 5)
    assert sorted(r["vec_id"] for r in found.collect()) == [1, 6] and len(centres) == 2
    assert e.kmeans(x.where("vec_id = 2"), 3)[0].collect() == []
    with pytest.raises(Exception, match="unlike lengths"):
        e.lloyd_step(e.usable(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>").coalesce(1), "vec_id", "embedding"), np.zeros((1, 1)))


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 1000).astype(np.float32)
    values, axes, mean = e.principal_components(vectors(spark, x), 3)
    y = x.astype(float)
    want, directions = np.linalg.eigh(np.cov(y.T, bias=True))
    assert np.allclose(values, want[::-1][:3], rtol=1e-6) and np.allclose(mean, y.mean(axis=0))
    assert np.allclose(np.abs((axes * directions.T[::-1][:3]).sum(axis=1)), 1, atol=1e-6)
    got = {r["vec_id"]: r["coordinates"] for r in e.projected(vectors(spark, x), axes, mean).collect()}
    assert np.allclose([got[i] for i in range(300)], (y - y.mean(axis=0)) @ axes.T)
    assert np.allclose(np.var([got[i] for i in range(300)], axis=0), values)
    empty = e.principal_components(vectors(spark, x).where("false"), 3)
    assert len(empty[0]) == 0


def test_balanced_sets(spark, monkeypatch):
    rows = [(i, c) for c, n in (("a", 500), ("b", 7), ("c", 20), (None, 40)) for i in range(n)]
    df = spark.createDataFrame([(f"{c}{i}", c) for i, c in rows], "k string, c string").repartition(4)
    got = {(r["c"], r["k"]) for r in e.balanced(df, "c", 20, "k", seed=3).collect()}
    order = lambda k: (int(hashlib.md5(f"{k}/3".encode()).hexdigest()[:13], 16), k)
    want = {(c, k) for c in ("a", "b", "c", None) for k in sorted((f"{c}{i}" for i, d in rows if d == c), key=order)[:20]}
    assert got == want
    twice = spark.createDataFrame([("x", "a")] * 30 + [("y", "a")], "k string, c string")
    assert e.balanced(twice, "c", 10, "k").count() == 10


def test_uncertain_rows(spark):
    df = spark.createDataFrame([(1, [0.5, 0.4, 0.1]), (2, [0.9, 0.1]), (3, [0.3, 0.3]), (4, [1.0]), (5, None), (6, [0.35, 0.25])], "k long, s array<double>")
    assert [r["k"] for r in e.most_uncertain(df, "s", 3, "k").collect()] == [3, 1, 6]


def test_uncertain_vectors_equal_sql_with_null_components_and_halves(spark, tmp_path):
    """A null component adds nothing; a margin on a half is rounded as SQL rounds it."""
    import duckdb

    from framelake.plans import ORACLES, QUERIES

    rows = [(i, [0.5 * i, None if i == 3 else 0.001 * i + 0.0005], i % 2) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1] for r in c.execute(ORACLES["uncertain_vectors"]).fetchall()}
    assert {r["vec_id"]: r["margin"] for r in QUERIES["uncertain_vectors"](spark, str(tmp_path)).collect()} == want and 3 in want
