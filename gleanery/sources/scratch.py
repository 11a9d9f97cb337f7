"""Where derived files go: the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; one of this machine's only where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/gleanery-scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, path: str) -> DataFrame:
    """Rows as a table at a new path: made once, however often they are read, and of a size that Spark knows when it joins
    them."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt out before work that each row makes much of. Larger tables, which are
    read by all cores anyway, stay as they are and are not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows
