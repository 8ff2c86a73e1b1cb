"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new place in the folder named by spark.checkpoint.dir; a local session without one uses its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written and read again, so that whatever reads them often doesn't make them again, nor a lost executor."""
    path = shared(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
