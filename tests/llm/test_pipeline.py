"""The pipeline's stages on awkward rows, and the whole on small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import common

from .test_operators import SCHEMA, WORDS, awkward

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_awkward_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(awkward(), SCHEMA)
    for rows in (docs, docs.limit(0)):
        out = stage(spark, rows, DATA)
        if name != "packing":
            assert out.columns == docs.columns
        found = out.count()
        assert (found > 0) == (rows is docs)


def test_stages_take_effect(spark):
    docs = common.documents(spark, DATA)
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(common.materialize(stage(spark, kept[-1], DATA), "s"))
    counts = [x.count() for x in kept]
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    lost = docs.join(kept[1], "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.where("toxic = 0").count() <= 0.02 * labels.where("toxic = 0").count()
    assert kept[2].select(F.lower("text")).distinct().count() == kept[2].count()
    words = sum(len(WORDS.findall(r["text"])) for r in kept[3].collect())
    mixed = sum(len(WORDS.findall(r["text"])) for r in kept[4].collect())
    assert abs(mixed - 1.5 * words) <= 0.001 * mixed  # what is drawn is taken: within a block or two of each source
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[4], DATA)
    assert packed.agg(F.sum("length")).first()[0] > mixed
