"""Helpers shared by the training-data operators: tables, the shared folder, Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, stored  # noqa: F401

#: Words are runs of anything but ASCII blanks; Python's bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte buffer and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bound the bytes of one Arrow batch in this session, unless it has a bound of its own.

    Spark's own bound is 64 MB; with several tasks an executor that stands for a lot of memory in buffers and in Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


def slices(offsets: np.ndarray, most: int):
    """Ranges of documents whose bytes together stay near ``most``; one long document makes a range alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def dealt_join(rows: DataFrame, per: DataFrame, key: str, spread: str, parts: int = 64) -> DataFrame:
    """rows with the row of their key (left join), a hot key's rows dealt over ``parts`` tasks by a hash of ``spread``.

    ``per`` has one row a key; it is repeated once for every part.
    """
    copies = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"))
    dealt = rows.withColumn("_p", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    return dealt.join(copies, [key, "_p"], "left").drop("_p")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra or clashing columns of the caller never reach a join."""
    return df.select(*[F.col(f"`{n}`") for n in names])
