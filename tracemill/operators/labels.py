"""Labels by agreement of strict predicates, over a record and the records just before it in its session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent_context(df: DataFrame, keys: list[str], time: str, order: list[str], k: int, cols: list[str], name: str = "context") -> DataFrame:
    """The last ``k`` records of the same keys with a strictly smaller time, as an array, latest first.

    Records are first reduced to k for each time, and k earlier times are looked at, so no row carries a session.
    """
    latest = Window.partitionBy(*keys, time).orderBy(*[F.desc(c) for c in order])
    few = df.filter(F.col(time).isNotNull()).withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= k)
    at = few.groupBy(*keys, time).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.struct(*cols).alias("v")))), lambda s: s["v"]).alias("_own"))
    before = Window.partitionBy(*keys).orderBy(time)
    past = F.flatten(F.array_compact(F.array(*[F.lag("_own", i).over(before) for i in range(1, k + 1)])))
    return df.join(at.select(*keys, time, F.slice(past, 1, k).alias(name)), [*keys, time], "left").withColumn(name, F.coalesce(name, F.slice(F.array(F.struct(*cols)), 1, 0)))


def captured_above(text: str, pattern: str, limit: int) -> Column:
    """Whether the whole text has the pattern and its first group is a number above the limit."""
    return F.coalesce(F.col(text).rlike(f"^{pattern}$") & (F.regexp_extract(text, f"^{pattern}$", 1).try_cast("bigint") > limit), F.lit(False))


def exactly_one(*conditions: Column) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c, F.lit(False)).cast("int")
    return total == 1


def decision(attack: list[Column], benign: list[Column], split: str = "split", splits=("TRAIN", "VALIDATION", "TEST")) -> Column:
    """Struct (label, reason): a label needs all predicates of its side and none of the other's."""

    def both(cs):
        return F.coalesce(cs[0] & cs[1], F.lit(False)), F.coalesce(cs[0] | cs[1], F.lit(False))

    (a_all, a_any), (b_all, b_any) = both(attack), both(benign)
    made = lambda label, reason: F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))
    known = F.coalesce(F.col(split).isin(*splits), F.lit(False))
    return (
        F.when(~known, made("UNCERTAIN", "INVALID_SPLIT"))
        .when(a_all & b_all, made("UNCERTAIN", "RULE_CONFLICT"))
        .when(a_all & ~b_any, made("ATTACK", "ATTACK_CONJUNCTION_MATCH"))
        .when(b_all & ~a_any, made("BENIGN", "BENIGN_CONJUNCTION_MATCH"))
        .otherwise(made("UNCERTAIN", "INSUFFICIENT_EVIDENCE"))
    )


def separable(df: DataFrame, label: str, features: list[str], group: str) -> DataFrame:
    """feature, separable: whether one threshold parts the two labels without fault, on two groups or more each."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = df.select(label, group, F.explode(pairs).alias("p")).select(label, group, "p.*").filter("v is not null")
    per = long.groupBy("feature", label).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.countDistinct(group).alias("g"))
    one, two = (per.filter(F.col(label) == v).select("feature", *[F.col(c).alias(f"{c}{v}") for c in ("lo", "hi", "g")]) for v in (0, 1))
    apart = (F.col("hi0") < F.col("lo1")) | (F.col("hi1") < F.col("lo0"))
    return one.join(two, "feature").select("feature", (apart & (F.col("g0") >= 2) & (F.col("g1") >= 2)).alias("separable"))


#: Allowed changes of a review's state, with who may make them.
TRANSITIONS = [
    ("NONE", "PENDING", "WORKFLOW_ENGINE"),
    ("PENDING", "IN_REVIEW", "PRIMARY_REVIEWER"),
    ("IN_REVIEW", "REVIEWED", "PRIMARY_REVIEWER"),
    ("REVIEWED", "RESOLVED", "WORKFLOW_ENGINE"),
    ("REVIEWED", "NEEDS_ADJUDICATION", "WORKFLOW_ENGINE"),
    ("NEEDS_ADJUDICATION", "ADJUDICATING", "HUMAN_ADJUDICATOR"),
    ("ADJUDICATING", "RESOLVED", "HUMAN_ADJUDICATOR"),
    ("PENDING", "CLOSED_UNRESOLVED", "REVIEW_ADMINISTRATOR"),
    ("IN_REVIEW", "CLOSED_UNRESOLVED", "REVIEW_ADMINISTRATOR"),
    ("NEEDS_ADJUDICATION", "CLOSED_UNRESOLVED", "REVIEW_ADMINISTRATOR"),
    ("ADJUDICATING", "CLOSED_UNRESOLVED", "REVIEW_ADMINISTRATOR"),
    ("RESOLVED", "SUPERSEDED", "CORRECTION_OFFICER"),
    ("CLOSED_UNRESOLVED", "SUPERSEDED", "CORRECTION_OFFICER"),
]


def forbidden_transitions(log: DataFrame) -> DataFrame:
    """Rows of a log (old, new, actor) whose change is not allowed."""
    allowed = log.sparkSession.createDataFrame(TRANSITIONS, "old string, new string, actor string")
    return log.join(F.broadcast(allowed), ["old", "new", "actor"], "left_anti")
