"""Record files: CSV with all cells as text, JSON lines with a fixed schema, and sinks that never overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canon import row_json
from ..functions.scalars import formula_safe
from .shared import stored

BAD = "_bad"


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """Every cell as text, exactly as written; ``_bad`` holds the whole line where its width is not the header's.

    Files stay splittable: quoted line ends are not looked for. Columns are not pruned in the parser, which would
    leave the width of a line unchecked.
    """
    schema = ", ".join(f"`{c}` string" for c in [*columns, BAD])
    options = {"header": header, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "columnPruning": False, "enforceSchema": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return spark.read.schema(schema).options(**options).csv(path)


def header_faults(spark: SparkSession, path: str, baseline: list[str]) -> list[tuple[str, str]]:
    """(fault, column) of a CSV folder's header: blank or repeated names, and baseline columns that are absent."""
    first = spark.read.text(path).limit(1).collect()
    names = first[0][0].lstrip("﻿").split(",") if first else []
    names = [n.strip('"') for n in names]
    faults = [("BLANK", str(i)) for i, n in enumerate(names) if not n.strip()]
    faults += [("REPEATED", n) for n in sorted({n for n in names if names.count(n) > 1})]
    return faults + [("ABSENT", n) for n in baseline if n not in names]


def write_csv(df: DataFrame, path: str, safe: bool = True) -> None:
    """Quoted CSV; nested cells as JSON, and text that a spreadsheet would take for a formula made harmless."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        c = F.to_json(c) if f.dataType.typeName() in ("struct", "array", "map") else c.cast("string")
        cells.append((formula_safe(c) if safe and f.dataType.typeName() == "string" else c).alias(f.name))
    df.select(*cells).write.mode("errorifexists").options(header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_canonical_lines(df: DataFrame, path: str) -> None:
    """One canonical JSON object a line: keys in order at every depth, nulls kept."""
    df.select(row_json(df.schema).alias("value")).write.mode("errorifexists").text(path)


def order_faults(spark: SparkSession, path: str, *fields: tuple[str, str]) -> DataFrame:
    """file, value, previous: records whose key does not rise over the one before it in the files, taken by name.

    ``fields`` (name, type) make the key; one field is its own key, several are a struct. A repeated key does not rise either.

    The order is that of the lines, not of the numbers. Inside a split, which one task reads, lines are numbered as they
    come; splits are joined by their first and last numbers, one row a split. A record without its first field is a fault of its own.
    """
    cells = [F.get_json_object("value", f"$.{name}").cast(kind).alias(name) for name, kind in fields]
    key = F.struct(*cells) if len(cells) > 1 else cells[0]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), cells[0].isNull().alias("blank"), key.alias("value"))
    held = stored(lines.withColumn("line", F.monotonically_increasing_id()))
    inside = Window.partitionBy("file", "start").orderBy("line")
    before = held.withColumn("previous", F.lag("value").over(inside)).withColumn("first", F.row_number().over(inside) == 1)
    ends = held.groupBy("file", "start").agg(F.max_by("value", "line").alias("last"))
    across = ends.select("file", "start", F.lag("last").over(Window.orderBy("file", "start")).alias("across"))
    joined = before.join(F.broadcast(across), ["file", "start"])
    previous = F.when(F.col("first"), F.col("across")).otherwise(F.col("previous"))
    return joined.withColumn("previous", previous).filter(F.col("blank") | (F.col("value") <= F.col("previous"))).select("file", "value", "previous")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order of name, nulls kept."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines of a fixed schema; a line that does not parse is an error, not a null row."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def foreign_keys(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """Lines whose keys are not exactly the known ones."""
    keys = F.array_sort(F.json_object_keys("value"))
    return spark.read.text(path).filter(~keys.eqNullSafe(F.array(*[F.lit(k) for k in sorted(known)])))
