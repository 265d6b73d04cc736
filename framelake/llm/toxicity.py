"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows and unlabelled text train linear classifiers whose risk is
corrected by the class prior: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),
so the unlabelled rows need not be clean.  Features are words and their first
letters, kept where they are much likelier in toxic than in unlabelled text;
a document has a feature or not, however long it is.  Each of BAGS classifiers
is fitted in a task of its own from its share of a bounded sample, and a score
is the mean of their probabilities.

The sample is at most MAX_POSITIVE rows labelled toxic and MAX_UNLABELLED rows
of any documents outside the held-out fold, whose labels, if they have one, are
not read; both are chosen by hashes of id and text, and rows that share both
count once.  The prior is the share of toxic among all labels of the training
folds.  Everything else covers all rows.  Texts, however long, are read whole.

Null and empty texts and texts without words score the classifiers' bias.  Null
ids belong to the fold of the empty text and have no label.  Repeated rows and
ids are scored row by row.  Null labels are unlabelled; of a document's labels
the largest counts.  Without toxic labels, or with nothing to set against them,
every score is 0.  An empty table gives no rows.  Columns of docs other than
doc_id and text, and of labels other than doc_id and toxic, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import coded_words, segment_ids, slices

FOLDS, HELD_OUT = 5, 0
MAX_POSITIVE, MAX_UNLABELLED, BAGS = 3_000, 9_000, 3
PREFIXES, MAX_FEATURES, MIN_POSITIVE, STRENGTH = (4, 5, 6), 4_096, 3, 4.5
#: Sampled rows for each classifier at least; fewer rows make fewer classifiers.
BAG_ROWS = 1_500
STEPS, RATE, RIDGE = 500, 0.1, 2e-5
#: Bytes of text that a task scores at a time.
SCORE_BYTES = 3_000_000


def features_of(word: str) -> list[str]:
    """The word, and its first letters marked as such."""
    return [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) > n]


def document_features(texts: pa.Array, known: dict[str, int], learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of the known features; learning, features not known yet are added."""
    offsets, codes, words = coded_words(texts)
    lists = []
    for w in words.to_pylist():
        if learn:
            lists.append([known.setdefault(f, len(known)) for f in features_of(w)])
        else:
            lists.append([known[f] for f in features_of(w) if f in known])
    counts = np.array([len(x) for x in lists], np.int64)
    flat = np.array([i for x in lists for i in x], np.int64)
    starts = np.cumsum(counts) - counts
    each = counts[codes]
    feature = flat[np.repeat(starts[codes], each) + common.runs(each)]
    row = np.repeat(segment_ids(offsets), each)
    pairs = np.unique(row * max(len(known), 1) + feature)
    return pairs // max(len(known), 1), pairs % max(len(known), 1)


def sample_features(texts: pa.Array, rows: int = 250) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """All features of a sample, some rows at a time: (row, feature) pairs and the features' names."""
    known: dict[str, int] = {}
    parts = []
    for i in range(0, len(texts), rows):
        row, feature = document_features(texts.slice(i, rows), known, learn=True)
        parts.append(((row + i).astype(np.int32), feature.astype(np.int32)))
    row, feature = (np.concatenate(x) for x in zip(*parts, strict=True))
    return row, feature, list(known)


def select_features(rows: np.ndarray, features: np.ndarray, names: list[str], positive: np.ndarray) -> list[str]:
    """Those in at least MIN_POSITIVE positives and by far likelier there, strongest first."""
    p = np.bincount(features[positive[rows]], minlength=len(names))
    u = np.bincount(features[~positive[rows]], minlength=len(names))
    rate_p, rate_u = p / positive.sum(), u / (~positive).sum()
    both = (p + u) / len(positive)
    strength = (rate_p - rate_u) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / positive.sum() + 1 / (~positive).sum()))
    good = np.flatnonzero((p >= MIN_POSITIVE) & (strength > STRENGTH) & (rate_p > 2.5 * rate_u))
    return [names[i] for i in good[np.argsort(-strength[good], kind="stable")][:MAX_FEATURES]]


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray, bool]:
    """The non-negative risk of the logits, the gradient to follow, and whether it is the risk's own.

    Where the unlabelled rows' risk as negatives, less the positives' share of
    it, falls below zero, the classifier over-fits: the risk counts it as zero,
    and the gradient steps back from it.
    """
    s, n_p, n_u = 1 / (1 + np.exp(-np.clip(z, -30, 30))), positive.sum(), (~positive).sum()
    as_negative = np.logaddexp(0, z)
    positive_part = prior * np.logaddexp(0, -z[positive]).mean()
    negative_part = as_negative[~positive].mean() - prior * as_negative[positive].mean()
    grad = np.where(positive, -prior * s / n_p, s / n_u)
    if negative_part < 0:
        return positive_part, -grad, False
    grad[positive] += prior * (s[positive] - 1) / n_p
    return positive_part + negative_part, grad, True


def fit(rows: np.ndarray, features: np.ndarray, n_features: int, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk with logistic loss, by Adam on the whole sample."""
    w, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        _, grad, _ = risk(bias + np.bincount(rows, w[features], len(positive)), positive, prior)
        g = np.append(np.bincount(features, grad[rows], n_features) + RIDGE * w, grad.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
    """Features' weights by classifier and the biases, or None if nothing can be learned."""
    fold = common.fold_of("doc_id", FOLDS)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold != HELD_OUT)
    n, toxic = known.where("toxic is not null").agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("int"))).first()
    if not n or not toxic or toxic == n:
        return None
    ids = docs.select("doc_id", common.text_hash("text").alias("text_hash")).where(fold != HELD_OUT).distinct()
    toxic_ids = known.where("toxic = 1").select("doc_id")
    pick = lambda df, most, flag: df.select("doc_id", "text_hash", F.lit(flag).alias("positive")).orderBy(F.xxhash64("doc_id", "text_hash", F.lit(flag)), "doc_id", "text_hash").limit(most)
    sample = common.materialize(pick(ids.join(toxic_ids, "doc_id", "left_semi"), MAX_POSITIVE, True).union(pick(ids, MAX_UNLABELLED, False)), "sample")
    bags = max(1, min(BAGS, sample.count() // BAG_ROWS))
    # At most MAX_POSITIVE + MAX_UNLABELLED names are broadcast, and as many texts, one for each, go to the classifiers.
    named = sample.select("doc_id", "text_hash").distinct()
    marked = docs.select("doc_id", "text").withColumn("text_hash", common.text_hash("text"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    found = marked.join(F.broadcast(named), same(marked, named), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = found.join(F.broadcast(sample), same(found, sample)).select("text", "positive", F.pmod(found["text_hash"], F.lit(bags)).cast("int").alias("bag"))
    prior = toxic / n

    def bag(pdf: pd.DataFrame) -> pd.DataFrame:
        positive = pdf["positive"].to_numpy(bool)
        if not positive.any() or positive.all():
            return pd.DataFrame({"bag": [], "feature": [], "weight": []})
        rows, features, names = sample_features(pa.array(pdf["text"], pa.string()))
        chosen = select_features(rows, features, names, positive)
        to = np.full(len(names), -1)
        at = {f: i for i, f in enumerate(names)}
        to[[at[f] for f in chosen]] = np.arange(len(chosen))
        keep = to[features] >= 0
        w, bias = fit(rows[keep], to[features[keep]], len(chosen), positive, prior)
        return pd.DataFrame({"bag": pdf["bag"].iloc[0], "feature": [*chosen, ""], "weight": [*w, bias]})

    learned = texts.groupBy("bag").applyInPandas(bag, "bag int, feature string, weight double").collect()  # at most BAGS * (MAX_FEATURES + 1) rows
    bags = sorted({r["bag"] for r in learned})
    if not bags:
        return None
    weights: dict[str, np.ndarray] = {}
    for r in learned:
        weights.setdefault(r["feature"], np.zeros(len(bags)))[bags.index(r["bag"])] = r["weight"]
    return weights, weights.pop("")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, held_out, score, predicted."""
    model = train(docs, labels)
    rows = docs.select("doc_id", common.text_hash("text").alias("text_hash"), (common.fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("score", T.DoubleType())])
    if model is None:
        scored = rows.select("doc_id", "text_hash", "held_out", F.lit(0.0).alias("score"))
        return scored.withColumn("predicted", F.lit(0))
    index = {f: i for i, f in enumerate(model[0])}
    weights, bias = np.array([model[0][f] for f in index]).reshape(len(index), len(model[1])), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SCORE_BYTES):
            row, feature = document_features(batch.column(3), index)
            z = np.stack([np.bincount(row, weights[feature, b], batch.num_rows) for b in range(len(bias))], axis=1) + bias
            mean = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mean)], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected as toxic."""
    clean = common.materialize(score(docs, labels_of(spark, sf_dir)).where("predicted = 0").select("doc_id", "text_hash"), "clean")
    marked = docs.withColumn("__fl_text_hash", common.text_hash("text"))
    named = clean.select(F.col("doc_id").alias("__fl_id"), F.col("text_hash").alias("__fl_hash"))
    kept = marked.join(named, marked["doc_id"].eqNullSafe(named["__fl_id"]) & (marked["__fl_text_hash"] == named["__fl_hash"]), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir), labels_of(spark, sf_dir)).drop("text_hash")
