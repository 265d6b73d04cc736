"""Tables in the folder that driver and executors share, to cut lineage and to fix what is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir.

    Where that is unset, a session in one process takes a temporary folder; on
    a cluster that would be another one on each machine, so it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("framelake.scratch", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("framelake.scratch", shared)
    return f"{shared.rstrip('/')}/framelake-{uuid.uuid4().hex}"


def write_shared(df: DataFrame) -> DataFrame:
    """df, written as a Parquet table of the shared folder and read back."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
