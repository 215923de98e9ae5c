"""Findings from a stream of records: the batch operators on a streaming DataFrame, written in whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import detect, normalize
from ..sources.shared import shared_dir
from ..sources.views import view_of


def stream_of(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A file stream over one table of a folder, with the schema that the files have now."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{table}.parquet*")


def findings_stream(events: DataFrame) -> DataFrame:
    """Stateless: rows of a stream become findings as rows of a table do."""
    return detect.findings(normalize.normalize(view_of(events.sparkSession, "logs", {"events": events})))


def run_available(df: DataFrame, path: str | None = None) -> str:
    """Write all that is there now and stop; the checkpoint makes a second start go on behind it."""
    base = path or shared_dir(df.sparkSession)
    q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{base}/out"
