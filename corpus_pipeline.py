"""Corpus pipeline: documents to packed training sequences, stage by stage.

Each stage works on all that the stage before it kept.  Its output is written
as Parquet in the shared folder and read again, so a lost executor costs one
stage at most.  STAGES counts as part of framelake.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import common, exact_dedup, mixing, near_dedup, packing, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
