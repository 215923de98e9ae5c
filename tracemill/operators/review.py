"""Reviewed records: status, matrix with bounds over unsettled labels, agreement, cases, packaging counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Settled labels.
SETTLED = ("SUSPICIOUS", "NOT_SUSPICIOUS")


def review_status(review_id, label) -> Column:
    """Status of a record; an error for a label that is not known, or where a record that was not selected has one."""
    i, x = F.col(review_id), F.col(label)
    bad = F.raise_error(F.concat(F.lit("no such review: "), F.coalesce(i, F.lit("none")), F.lit(" "), F.coalesce(x, F.lit("none")))).cast("string")
    status = F.when(i.isNull(), F.when(x.isNull(), "NOT_SELECTED").otherwise(bad)).when(x.isNull(), "PENDING").when(x == "UNCERTAIN", "REVIEWED_UNCERTAIN")
    return status.when(x.isin(*SETTLED), "REVIEWED_RESOLVED").otherwise(bad)


def paired_passes(decisions: DataFrame, key: str) -> DataFrame:
    """key and outcome of two passes' decisions (key, pass_id, decision): one of each pass, equal or not."""
    g = decisions.groupBy(key).agg(F.max(F.when(F.col("pass_id") == "PASS_A", F.col("decision"))).alias("a"), F.max(F.when(F.col("pass_id") == "PASS_B", F.col("decision"))).alias("b"))
    return g.select(key, F.when(F.col("a").isNull() | F.col("b").isNull(), "REVIEW_INCOMPLETE").when(F.col("a") == F.col("b"), "AGREE").otherwise("DISAGREE").alias("outcome"))


def review_matrix(df: DataFrame) -> DataFrame:
    """One row from membership and blind_label: tp, fp, fn, tn of settled labels, and the unsettled ones of each side."""
    top, other = F.col("membership") == "TOP_50", F.col("membership") == "COMPARISON"
    yes, no, open_ = (F.col("blind_label") == v for v in ("SUSPICIOUS", "NOT_SUSPICIOUS", "UNCERTAIN"))
    parts = {"tp": top & yes, "fp": top & no, "fn": other & yes, "tn": other & no, "open_top": top & open_, "open_other": other & open_}
    return df.agg(*[F.count_if(e).alias(n) for n, e in parts.items()])


def uncertainty_bounds(m: DataFrame) -> DataFrame:
    """Least and greatest precision, recall and F1 over every way to settle the open labels, and whether one of them leaves a
    rate without a denominator (``undefined_possible``).

    Each rate rises with the open records at the top that turn out suspicious and falls with those of the other
    side, so its ends lie at two corners; the other corner serves where one has a zero denominator.
    """
    tp, fp, fn, u, v = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "open_top", "open_other"))
    div = F.try_divide
    low = {"precision": div(tp, tp + fp + u), "recall": div(tp, tp + fn + v), "f1": div(2 * tp, 2 * tp + fp + u + fn + v)}
    high = {"precision": div(tp + u, tp + fp + u), "recall": div(tp + u, tp + u + fn), "f1": div(2 * (tp + u), 2 * (tp + u) + fp + fn)}
    # The denominators are least where every open record turns out not suspicious; that of precision is the same in all.
    undefined = (tp + fp + u == 0) | (tp + fn == 0) | (2 * tp + fp + u + fn == 0)
    return m.select("*", *[F.coalesce(low[k], high[k]).alias(f"{k}_low") for k in low], *[F.coalesce(high[k], low[k]).alias(f"{k}_high") for k in high], undefined.alias("undefined_possible"))


def agreement(df: DataFrame, selected: Column, flags: dict[str, Column]) -> DataFrame:
    """For every flag its overlap with the selection: four counts, Jaccard and enrichment, in one pass."""
    long = df.select(selected.alias("s"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(e, F.lit(False)).alias("on")) for n, e in flags.items()])).alias("f")).select("s", "f.*")
    s, on = F.col("s"), F.col("on")
    g = long.groupBy("name").agg(F.count_if(s & on).alias("both"), F.count_if(s & ~on).alias("selected_only"), F.count_if(~s & on).alias("flag_only"), F.count_if(~s & ~on).alias("neither"))
    both, so, fo, n = (F.col(c) for c in ("both", "selected_only", "flag_only", "neither"))
    rate = F.try_divide(both + fo, both + so + fo + n)
    return g.withColumn("jaccard", F.try_divide(both, both + so + fo)).withColumn("enrichment", F.try_divide(F.coalesce(F.try_divide(both, both + so), F.lit(0.0)), rate))


def case_studies(df: DataFrame, rank: str, key: str, wanted: dict[str, Column]) -> DataFrame:
    """One record for each category in turn, the best ranked that no earlier category took; else the best unused.

    A category can lose at most as many of its first records as there are categories, so that many of each, and of
    all, are enough: the rest works on a handful of rows.
    """
    k = len(wanted)
    pools = [df.filter(e).orderBy(rank, key).limit(k).select(key, rank, F.lit(n).alias("pool")) for n, e in wanted.items()]
    pools.append(df.orderBy(rank, key).limit(k).select(key, rank, F.lit("ANY").alias("pool")))
    every = reduce(DataFrame.unionByName, pools).agg(F.array_sort(F.collect_list(F.struct(rank, key, "pool"))).alias("xs"))

    def take(out: Column, want: Column) -> Column:
        free = F.filter("xs", lambda x: ~F.exists(out, lambda o: o[key] == x[key]))
        own = F.try_element_at(F.filter(free, lambda x: x["pool"] == want), F.lit(1))
        best = F.coalesce(own, F.try_element_at(F.filter(free, lambda x: x["pool"] == "ANY"), F.lit(1)))
        actual = F.when(own.isNull(), "FALLBACK_NEXT_UNUSED_RANK").otherwise(want)
        made = F.struct((F.size(out) + 1).alias("case"), want.alias("requested"), actual.alias("actual"), best[key].alias(key))
        return F.when(best.isNull(), out).otherwise(F.concat(out, F.array(made)))

    none = F.array().cast(f"array<struct<case:int,requested:string,actual:string,{key}:{dict(df.dtypes)[key]}>>")
    picked = every.withColumn("out", F.aggregate(F.array(*[F.lit(n) for n in wanted]), none, take))
    return picked.select(F.explode("out").alias("o")).select("o.*")


def shares(df: DataFrame, selected: Column, category: str) -> DataFrame:
    """Count and percentage of each category within the selected rows and within the others."""
    totals = df.agg(F.count_if(selected).alias("_s"), F.count_if(~selected).alias("_o"))
    g = df.groupBy(category).agg(F.count_if(selected).alias("selected"), F.count_if(~selected).alias("others"))
    pct = lambda n, d: F.coalesce(F.round(100.0 * F.try_divide(F.col(n), F.col(d)), 4), F.lit(0.0))
    return g.crossJoin(F.broadcast(totals)).select(category, "selected", "others", pct("selected", "_s").alias("selected_pct"), pct("others", "_o").alias("others_pct"))
