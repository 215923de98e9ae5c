"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


SPREAD = 64


def dealt(rows: DataFrame, spread: str, parts: int = SPREAD) -> DataFrame:
    """rows with ``_part``, by which a hot key's rows are dealt over ``parts`` tasks."""
    return rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))


def with_group(rows: DataFrame, key: str | list[str], spread: str, partial: dict[str, Column], final: dict[str, Column], parts: int = SPREAD) -> DataFrame:
    """Every row with aggregates of its group, a hot group's rows dealt over ``parts`` tasks by a hash of ``spread``.

    ``partial`` aggregates rows of (key, part), ``final`` aggregates those. A group gives ``parts`` rows at most, and these
    alone meet in one task; its rows join by (key, part).
    """
    keys = [key] if isinstance(key, str) else key
    each_row = dealt(rows, spread, parts)
    some = each_row.groupBy(*keys, "_part").agg(*[e.alias(n) for n, e in partial.items()])
    whole = some.groupBy(*keys).agg(*[e.alias(n) for n, e in final.items()])
    each = some.select(*keys, "_part").join(whole, keys)
    return each_row.join(each, [*keys, "_part"]).drop("_part")


def with_match(rows: DataFrame, right: DataFrame, keys: list[str], spread: str, parts: int = SPREAD) -> DataFrame:
    """Every row with the columns of ``right`` (one row a key, or none), a hot key's rows dealt over tasks as in ``with_group``."""
    each_row = dealt(rows, spread, parts)
    each = each_row.select(*keys, "_part").distinct().join(right, keys)
    return each_row.join(each, [*keys, "_part"], "left").drop("_part")


def components(edges: DataFrame, most: int = 60, within: tuple[str, ...] = ()) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Edges that differ in the columns ``within`` (never null) are of graphs apart, which are settled together; these columns
    come first in the result.

    Each step joins nodes to the smallest neighbour known. A node with very many neighbours is dealt over many tasks by
    them (``with_group``), so it is not gathered in one place; edges are written out after each step, and the end is
    reached when no edge changes, which takes about log2 of the longest path steps. Loops and repeated edges count
    nothing; an edge with a null end takes no part.
    """
    e = stored(edges.filter("a <> b").select(*within, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    least = {"_m": F.min("v")}, {"m": F.min("_m")}
    for _ in range(most):
        both = e.select(*within, "u", "v").unionByName(e.select(*within, F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: what is above u goes to u's smallest neighbour, or to u where none is below it.
        large = with_group(both, [*within, "u"], "v", *least).filter("v > u").select(*within, F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Small star: what is below u goes to u's smallest neighbour, and so does u.
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        new = stored(with_group(large, [*within, "u"], "v", *least).select(*within, ends).select(*within, "x.*").filter("u <> v").distinct())
        change = new.select(*within, "u", "v", F.lit(1).alias("w")).unionByName(e.select(*within, "u", "v", F.lit(-1).alias("w"))).groupBy(*within, "u", "v").agg(F.sum("w").alias("w")).filter("w <> 0")
        e = new
        if not change.limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(*within, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(*within, F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
