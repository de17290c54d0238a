"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster names it in ``spark.checkpoint.dir``. A temporary folder takes its place on one machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="webgrain-"))
    return _LOCAL[0]


def saved(df: DataFrame) -> DataFrame:
    """A table written to the cluster's shared folder and read again, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared(spark)}/saved-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
