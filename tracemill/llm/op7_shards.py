"""Sharding by a Feistel permutation of global row numbers; DataFrame and SQL functions only.

Rows are numbered 0 .. n - 1 in the order of (bucket of doc_id, doc_id, checksum, size): counts of at most BUCKETS
buckets give every bucket its first number, and rows are numbered inside their bucket, so no task orders all rows.
The permutation sends number i to p; shard = p mod shards, slot = p div shards. Shard sizes differ by one row at
most, slots have no gaps, and anyone who knows n and the seed can compute a row's place, or the row of a place.

Null texts have size 1 and checksum 0; rows without doc_id are spread by checksum; equal rows get places of their
own. An empty table gives an empty result; other columns are left out, whatever their names; texts of any size are measured
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, table
from .feistel import feistel

BUCKETS = 4096


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = only(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("bucket", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32")).otherwise(F.xxhash64("doc_id")), F.lit(BUCKETS)))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("c"))
    in_order, whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # At most BUCKETS rows, however large the table: one task and a broadcast.
    firsts = counts.select("bucket", F.coalesce(F.sum("c").over(in_order), F.lit(0)).alias("first"), F.sum("c").over(whole).alias("n"))
    own = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.join(F.broadcast(firsts), "bucket").withColumn("i", F.col("first") + F.row_number().over(own) - 1)
    placed = numbered.withColumn("p", F.expr(feistel("i", "n", str(seed))))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % shards).cast("int").alias("shard"), F.expr(f"p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
