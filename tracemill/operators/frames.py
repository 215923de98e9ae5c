"""Operators on DataFrames with column names as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import listed, missing
from ..sources.shared import stored

FEW_VALUES = 200_000  # distinct values up to which they are broadcast


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """Long form with text values, in one scan."""
    pairs = F.array(*[F.struct(F.lit(x).alias("k"), F.col(x).cast("string").alias("v")) for x in cols])
    return df.select(*ids, F.explode(pairs).alias("p")).select(*ids, F.col("p.k").alias(name), F.col("p.v").alias(value))


def missing_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """field, total, missing: one wide aggregate over one scan, then turned to rows."""
    wide = df.agg(F.count("*").alias("total"), *[F.count_if(missing(x)).alias(x) for x in cols])
    pairs = F.array(*[F.struct(F.lit(x).alias("k"), F.col(x).alias("v")) for x in cols])
    return wide.select("total", F.explode(pairs).alias("p")).select(F.col("p.k").alias("field"), "total", F.col("p.v").alias("missing"))


def top_values(df: DataFrame, cols: list[str], n: int, rare: bool = False) -> DataFrame:
    """The n most (or least) frequent combinations, ties by value."""
    order = F.asc("cnt") if rare else F.desc("cnt")
    return df.groupBy(*cols).agg(F.count("*").alias("cnt")).orderBy(order, *cols).limit(n)


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rn") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """row_number() over all rows without gathering them: ranges are sorted apart and offset by the sizes before them.

    The range-sorted rows are written once, each with its place in its range, so that nothing is sorted again. ``order`` must
    tell rows apart. Ranges are found by a sample, for which ``df`` is computed once more: store it where that is much work.
    """
    # The id counts the rows of a task from its number times 2^33.
    spread = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # One row a range: a small side, whatever the number of rows.
    ranked = spread.join(F.broadcast(before), part == F.col("_part"))
    return ranked.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_id")


def running_by_value(df: DataFrame, value: str, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Per distinct value its own sums and, as cum_<name>, the sums of all values up to it in order.

    Sums of ranges of values give each range its offset, so that no task holds all distinct values.
    """
    key = F.desc(value) if descending else F.asc(value)
    per = df.groupBy(value).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    spread = stored(per.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy("_part").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    own = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = spread.join(F.broadcast(parts), "_part")
    return out.select(value, *sums, *[(F.col(f"_b_{n}") + F.sum(n).over(own)).alias(f"cum_{n}") for n in sums])


def next_at_or_after(left: DataFrame, at: str, right: DataFrame, value: str, name: str) -> DataFrame:
    """left with ``name``: the smallest value of ``right`` at or after the row's own; null where there is none.

    Both sides go in one order, once. Inside a range of it the next value is seen by a window; a range's last rows take the
    first value of the ranges behind it, of which one row each is kept. No pairs are formed.
    """
    kind = right.schema[value].dataType
    rows = left.select(F.col(at).alias("_v"), F.lit(0).alias("_k"), F.lit(None).cast(kind).alias("_r"), F.struct(*left.columns).alias("_l"))
    marks = right.select(F.col(value).alias("_v"), F.lit(1).alias("_k"), F.col(value).alias("_r"), F.lit(None).cast(rows.schema["_l"].dataType).alias("_l")).filter("_v is not null")
    spread = stored(rows.unionByName(marks).repartitionByRange("_v", "_k").withColumn("_part", F.spark_partition_id()))
    firsts = spread.groupBy("_part").agg(F.min("_r").alias("_first"))
    behind = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("_part", F.min("_first").over(behind).alias("_behind"))
    own = Window.partitionBy("_part").orderBy(F.desc("_v"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    out = spread.withColumn("_n", F.min("_r").over(own)).join(F.broadcast(firsts), "_part").filter("_k = 0")
    return out.select("_l.*", F.when(F.col("_v").isNotNull(), F.coalesce("_n", "_behind")).alias(name))


def reference_percentile(df: DataFrame, value: str, is_reference: Column, name: str = "percentile") -> DataFrame:
    """100 * share of reference values at or below each row's value. Up to FEW_VALUES distinct values are broadcast, so that rows of
    a frequent value do not meet in one task; more of them are joined by shuffles."""
    cum = stored(running_by_value(df.filter(F.col(value).isNotNull()), value, {"_ref": is_reference.cast("int")}))
    put = F.broadcast if cum.count() <= FEW_VALUES else lambda x: x
    total = df.agg(F.sum(is_reference.cast("int")).alias("_total"))
    return df.join(put(cum.select(F.col(value).alias("_v"), "cum__ref")), F.col(value) == F.col("_v")).crossJoin(F.broadcast(total)).withColumn(name, 100.0 * F.col("cum__ref") / F.col("_total")).drop("_v", "cum__ref", "_total")


def violations(df: DataFrame, key: str, **rules: Column) -> DataFrame:
    """check, key for every row and rule whose condition (of a fault) holds."""
    return df.select(F.explode(listed(*[(e, F.lit(n)) for n, e in rules.items()])).alias("check"), F.col(key).cast("string").alias("key"))


def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-free digest of a table: rows, and sum and exclusive or of row hashes."""
    h = F.xxhash64(*cols)
    return df.agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"), F.bit_xor(h).alias("parity"))


def distinct_counts(df: DataFrame, values: dict[str, Column], task_rows: int = 1 << 20) -> DataFrame:
    """One row: the number of distinct values of every column expression, nulls left out; the expressions have one type.

    Values are written once and dealt by themselves over as many tasks as their number needs, so that a task holds
    about ``task_rows`` of them at most, whatever the number of rows.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("_w"), e.alias("_v")) for i, e in enumerate(values.values())])
    long = stored(df.select(F.explode(pairs).alias("_p")).select("_p.*").filter("_v is not null"))
    met = long.repartition(1 + long.count() // task_rows, "_v").groupBy("_v").agg(*[F.count_if(F.col("_w") == i).alias(f"_n{i}") for i in range(len(values))])
    return met.agg(*[F.count_if(F.col(f"_n{i}") > 0).alias(n) for i, n in enumerate(values)])


def full_compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of a full outer join by keys that do not agree, with a status."""
    l, r = left.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("_l")), right.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("_r"))
    both = l.join(r, keys, "full_outer")
    status = F.when(F.col("_l").isNull(), "UNEXPECTED").when(F.col("_r").isNull(), "ABSENT").when(~F.col("expected").eqNullSafe(F.col("actual")), "DIFFERENT")
    return both.withColumn("status", status).filter("status is not null").select(*keys, "expected", "actual", "status")


def allowed(df: DataFrame, columns: list[str], denied: set[str]) -> DataFrame:
    """The allowed columns alone; an error where one of them is denied."""
    if set(columns) & denied:
        raise ValueError(f"denied columns: {sorted(set(columns) & denied)}")
    return df.select(*columns)


def quantiles_by_group(df: DataFrame, group: str, value: str, key: str, shares: list[float]) -> DataFrame:
    """group, q, value: the ceil(q * n)-th of each group's values, from one global order instead of a sort a group.

    ``key`` tells rows apart; rows without a value are left out.
    """
    rows = df.filter(F.col(value).isNotNull()).select(group, value, key)
    ranked = stored(global_rank(rows, [group, value, key], "_rk"))
    sizes = ranked.groupBy(group).agg(F.count("*").alias("_n"), F.min("_rk").alias("_first"))
    places = F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("q")
    wanted = sizes.select(F.col(group).alias("_g"), "_n", "_first", places).withColumn("_at", F.col("_first") + F.greatest(F.ceil(F.col("q") * F.col("_n")), F.lit(1)) - 1)
    # A rank belongs to one row, so the rank alone joins and no group gathers in one task.
    return ranked.join(wanted, F.col("_rk") == F.col("_at")).select(group, "q", value)


def median(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row: the median of the values, the mean of the two in the middle where their number is even; null without values.

    From the values' running counts, so that no task holds all distinct values.
    """
    at = running_by_value(df.filter(F.col(value).isNotNull()), value, {"_c": F.lit(1)}).select(value, "_c", "cum__c")
    at = stored(at)
    n = at.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"))
    # A place k from 1 lies in the value whose counts reach it first: at most two rows are left.
    held = at.crossJoin(F.broadcast(n)).filter(" or ".join(f"(cum__c >= {k} and cum__c - _c < {k})" for k in ("(_n + 1) div 2", "(_n + 2) div 2")))
    return held.agg(((F.min(value) + F.max(value)) / 2).alias(name))


def quantile_disc(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for every name the ceil(share * n)-th value, from running counts of the values."""
    at = stored(running_by_value(df.filter(F.col(value).isNotNull()), value, {"_c": F.lit(1)}).select(value, "_c", "cum__c"))
    n = at.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"))
    held = at.crossJoin(F.broadcast(n))
    return held.agg(*[F.min(F.when(F.col("cum__c") >= F.greatest(F.ceil(F.lit(q) * F.col("_n")), F.lit(1)), F.col(value))).alias(k) for k, q in shares.items()])


def quantile_cont(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for every name the value at (n - 1) * share in order, between two values in proportion; null without values.

    From the values' running counts, so that no task holds all distinct values.
    """
    at = stored(running_by_value(df.filter(F.col(value).isNotNull()), value, {"_c": F.lit(1)}).select(value, "cum__c"))
    held = at.crossJoin(F.broadcast(at.agg(F.coalesce(F.max("cum__c"), F.lit(0)).alias("_n"))))
    from_ = lambda place: F.min(F.when(F.col("cum__c") > place, F.col(value)))
    place = {k: F.lit(float(q)) * (F.col("_n") - 1) for k, q in shares.items()}
    ends = held.agg(F.max("_n").alias("_n"), *[e for k, p in place.items() for e in (from_(F.floor(p)).alias(f"_lo_{k}"), from_(F.ceil(p)).alias(f"_hi_{k}"))])
    return ends.select(*[(F.col(f"_lo_{k}") + (p - F.floor(p)) * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k) for k, p in place.items()])


def nested_names(schema) -> set[str]:
    """Names of all fields of a schema, those inside structs, arrays and maps included."""
    kind = schema.typeName()
    if kind == "struct":
        return {f.name for f in schema.fields} | {n for f in schema.fields for n in nested_names(f.dataType)}
    if kind == "array":
        return nested_names(schema.elementType)
    if kind == "map":
        return nested_names(schema.keyType) | nested_names(schema.valueType)
    return set()


def blinded(df: DataFrame, columns: list[str], forbidden: set[str]) -> DataFrame:
    """The listed columns for a blind review; an error where a forbidden name stands at any depth of them."""
    out = df.select(*columns)
    met = nested_names(out.schema) & forbidden
    if met:
        raise ValueError(f"forbidden in a blind review: {sorted(met)}")
    return out


def category_counts(df: DataFrame, charts: dict[str, Column]) -> DataFrame:
    """chart, category, n: counts of every chart's categories from one scan.

    A name ending in [] marks an array of categories; a null category is not counted.
    """

    def pairs_of(name: str, e: Column) -> Column:
        values = e if name.endswith("[]") else F.array(e)
        return F.transform(values, lambda v: F.struct(F.lit(name.removesuffix("[]")).alias("chart"), v.cast("string").alias("category")))

    pairs = [pairs_of(*x) for x in charts.items()]
    return df.select(F.explode(F.concat(*pairs)).alias("p")).select("p.*").filter("category is not null").groupBy("chart", "category").agg(F.count("*").alias("n"))
