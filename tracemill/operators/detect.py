"""Declared rules over normalised events: one scan gives the findings of all rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import filled, length_prefixed
from ..sources.shared import stored
from .frames import top_per_group


@dataclass(frozen=True)
class Rule:
    """A rule is metadata and a condition; ``evidence`` names the paths that a finding shows."""

    rule_id: str
    severity: str
    condition: Column
    evidence: tuple[str, ...]


def rules() -> list[Rule]:
    return [
        Rule("RULE_ANOMALY_SUBTYPE", "MEDIUM", F.col("event.subtype") == "anomaly", ("event.subtype", "event.type")),
        Rule("RULE_SOURCE_THREAT", "HIGH", filled("threat.name"), ("threat.name", "event.subtype", "network.protocol")),
    ]


def checked(registry: list[Rule]) -> list[Rule]:
    ids = [r.rule_id for r in registry]
    if ids != sorted(set(ids)) or any(r.severity not in ("LOW", "MEDIUM", "HIGH") for r in registry):
        raise ValueError("rules must be sorted, unique and of a known severity")
    return registry


def findings(events: DataFrame, registry: list[Rule] | None = None) -> DataFrame:
    """A row for every event and rule that matches, with an evidence array of the filled paths."""

    def made(r: Rule) -> Column:
        shown = F.filter(F.array(*[F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value")) for p in r.evidence]), lambda e: e["value"].isNotNull())
        return F.when(r.condition, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), shown.alias("evidence")))

    matched = F.explode(F.array_compact(F.array(*[made(r) for r in checked(registry or rules())])))
    found = events.select("record_number", "loguid", matched.alias("f")).select("record_number", "loguid", "f.*")
    return found.withColumn("finding_id", F.sha2(length_prefixed("rule_id", "loguid", F.col("record_number").cast("string")), 256))


def evidence(found: DataFrame) -> DataFrame:
    return found.select("finding_id", F.posexplode("evidence").alias("ordinal", "e")).select("finding_id", F.col("ordinal").cast("bigint").alias("ordinal"), "e.path", "e.value")


def evidence_of(found: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """record_number, ordinal (from 1), path and value of the findings in ``ids`` (finding_id, few rows), in order, the first
    ``limit`` of them."""
    own = found.join(F.broadcast(ids), "finding_id").select("record_number", F.posexplode("evidence").alias("ordinal", "e"))
    return own.select("record_number", (F.col("ordinal") + 1).alias("ordinal"), "e.path", "e.value").orderBy("record_number", "ordinal").limit(limit)


def run_summary(found: DataFrame, samples: int = 5) -> DataFrame:
    """section, key, value of a run's findings: TOTAL, RULE, SEVERITY (rule:severity), MATCHED (records), SAMPLE (rule:place, a
    record). A rule's samples are its first records, of which each task keeps a few."""
    f = stored(found.select("record_number", "rule_id", "severity"))
    line = lambda s, k, v: (F.lit(s).alias("section"), k.alias("key"), v.cast("bigint").alias("value"))
    per = stored(f.groupBy("rule_id", "severity").agg(F.count("*").alias("n")))  # a few rows a rule
    first = top_per_group(f, ["rule_id"], ["record_number"], samples)
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(*line("TOTAL", F.lit(""), F.col("n")))
    for part in (
        per.groupBy("rule_id").agg(F.sum("n").alias("n")).select(*line("RULE", F.col("rule_id"), F.col("n"))),
        per.select(*line("SEVERITY", F.concat_ws(":", "rule_id", "severity"), F.col("n"))),
        f.select("record_number").distinct().agg(F.count("*").alias("n")).select(*line("MATCHED", F.lit(""), F.col("n"))),
        first.select(*line("SAMPLE", F.concat_ws(":", "rule_id", F.col("rn").cast("string")), F.col("record_number"))),
    ):
        out = out.unionByName(part)
    return out
