"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests), and
    an error on a cluster, whose executors would not see it."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them back."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
