"""Intermediate tables, written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, name: str) -> DataFrame:
    """df computed once, as Parquet in the folder of spark.checkpoint.dir (without a cluster a local one if unset), so that a lost executor costs its tasks only."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
