"""Queries over the vectors: clusters, components, samples for training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import embeddings as e
from framelake.sources import tables as t

from .register import query

FIRST = "with c as (select vec_id, cast(row_number() over (order by vec_id) - 1 as integer) as cluster, embedding::double[] as c from embeddings order by vec_id limit 8)"
NEAREST = FIRST + ", d as (select e.vec_id, c.cluster, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(e.embedding::double[], c.c)]) as distance from embeddings e cross join c), a as (select vec_id, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d group by 1)"


def first_centres(spark: SparkSession, d: str) -> np.ndarray:
    return np.array([r["embedding"] for r in t.table(spark, d, "embeddings").orderBy("vec_id").limit(8).collect()], np.float64)


@query(NEAREST + " select vec_id, cluster, round(distance, 6) as distance from a")
def nearest_centres(spark: SparkSession, d: str) -> DataFrame:
    """One assignment step from given centres."""
    x = e.assigned(e.usable(t.table(spark, d, "embeddings"), "vec_id", "embedding"), first_centres(spark, d))
    return x.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query(NEAREST + ", m as (select cluster, i, avg(v) as mean from (select cluster, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) as i from a join embeddings using (vec_id)) group by 1, 2) select cluster, cast(i - 1 as integer) as at, round(mean, 6) as mean from m")
def moved_centres(spark: SparkSession, d: str) -> DataFrame:
    """The centres after that step, from sums of tasks."""
    new, sizes, _ = e.lloyd_step(e.usable(t.table(spark, d, "embeddings"), "vec_id", "embedding"), first_centres(spark, d))
    rows = [(c, i, float(v)) for c, centre in enumerate(new) if sizes[c] for i, v in enumerate(centre)]  # a model's size
    return spark.createDataFrame(rows, "cluster int, at int, mean double").withColumn("mean", F.round("mean", 6))


@query()
def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's cluster by k-means from parallel seeds."""
    return e.kmeans(t.table(spark, d, "embeddings"), 10)[0]


@query("with v as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) select cast(a.i as integer) as i, cast(b.i as integer) as j, round(covar_pop(a.x, b.x), 6) + 0.0 as covariance from v a join v b using (vec_id) where a.i <= b.i group by 1, 2")
def embedding_covariance(spark: SparkSession, d: str) -> DataFrame:
    """The matrix whose eigenvectors are the principal components."""
    _, _, covariance = e.moments(e.usable(t.table(spark, d, "embeddings"), "vec_id", "embedding"))
    rows = [(i, j, float(covariance[i, j])) for i in range(len(covariance)) for j in range(i, len(covariance))]  # a model's size
    return spark.createDataFrame(rows, "i int, j int, covariance double").withColumn("covariance", F.round("covariance", 6) + 0.0)


@query()
def embedding_components(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's coordinates along the first components."""
    x = t.table(spark, d, "embeddings")
    _, axes, mean = e.principal_components(x, 4)
    return e.projected(x, axes, mean)


@query("with h as (select *, ('0x' || substr(md5(doc_id || '/5'), 1, 13))::bigint as h from documents) select doc_id, source from (select *, row_number() over (partition by source order by h, doc_id) as n from h) where n <= 25")
def balanced_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same number of documents of each source, whatever its size."""
    return e.balanced(t.table(spark, d, "documents").select("doc_id", "source"), "source", 25, "doc_id", seed=5)


@query("""with v as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as mean from v group by 1, 2),
s as (select v.vec_id, m.label, round(sum(x * mean), 9) as score from v join m using (i) group by 1, 2), r as (select *, row_number() over (partition by vec_id order by score desc) as n from s),
g as (select vec_id, max(score) filter (n = 1) - max(score) filter (n = 2) as margin from r group by 1)
select vec_id, round(margin, 6) as margin from g order by margin, vec_id limit 30""")
def uncertain_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors that two class means claim almost alike; there is one mean for each label."""
    x = t.table(spark, d, "embeddings")
    mean = x.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    means = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m"))  # an entry for each dimension
    every = means.agg(F.collect_list("m").alias("means"))
    # A null component adds nothing, as in a sum of rows.
    product = lambda m: F.aggregate(F.zip_with("embedding", m, lambda a, b: F.coalesce(a.cast("double") * b, F.lit(0.0))), F.lit(0.0), lambda a, p: a + p)
    # Halves are decided on the shifted double, as SQL engines do, and not on its shortest decimal form.
    rounded = lambda v, shift: F.round(v * shift) / shift
    scored = x.join(F.broadcast(every)).select("vec_id", F.transform("means", lambda m: rounded(product(m), 1e9)).alias("scores"))
    return e.most_uncertain(scored, "scores", 30, "vec_id").select("vec_id", rounded(F.col("margin"), 1e6).alias("margin"))
