"""Findings of runs as four related tables, partitioned by run, and the checks of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import Rule, evidence, rules
from .frames import violations

#: table -> columns that name a row.
KEYS = {"runs": ["run_id"], "run_rules": ["run_id", "rule_id"], "findings": ["run_id", "finding_id"], "finding_evidence": ["run_id", "finding_id", "ordinal"]}
#: (table, columns, table that must hold them).
REFERENCES = [("run_rules", ["run_id"], "runs"), ("findings", ["run_id"], "runs"), ("findings", ["run_id", "rule_id"], "run_rules"), ("finding_evidence", ["run_id", "finding_id"], "findings")]


def tables_of_run(found: DataFrame, run_id: str, registry: list[Rule] | None = None) -> dict[str, DataFrame]:
    """The rows that one run adds to each table."""
    spark, run = found.sparkSession, F.lit(run_id).alias("run_id")
    known = [(i, r.rule_id, r.severity) for i, r in enumerate(registry or rules(), 1)]
    return {
        "runs": found.agg(F.count("*").alias("n_findings"), F.countDistinct("record_number").alias("n_records")).select(run, "n_findings", "n_records"),
        "run_rules": spark.createDataFrame(known, "ordinal int, rule_id string, severity string").select(run, "ordinal", "rule_id", "severity"),
        "findings": found.select(run, "finding_id", "record_number", "loguid", "rule_id", "severity"),
        "finding_evidence": evidence(found).select(run, "finding_id", (F.col("ordinal") + 1).alias("ordinal"), "path", "value"),
    }


def import_run(found: DataFrame, run_id: str, folder: str) -> None:
    """Add a run. A run that is there already is an error, so that nothing is counted twice."""
    spark = found.sparkSession
    if run_id in {r["run_id"] for r in stored_runs(spark, folder)}:
        raise ValueError(f"run {run_id} is stored already")
    made = tables_of_run(found, run_id)
    # The runs table comes last: a run that stopped half-way is not listed.
    for name in ("run_rules", "findings", "finding_evidence", "runs"):
        made[name].write.mode("append").partitionBy("run_id").parquet(f"{folder}/{name}")


def stored_runs(spark: SparkSession, folder: str) -> list:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("basePath", f"{folder}/runs").parquet(f"{folder}/runs").select(F.col("run_id").cast("string")).collect()
    except AnalysisException:  # no run yet
        return []


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables; filters on run_id read the folders of those runs alone."""
    return {n: spark.read.parquet(f"{folder}/{n}").withColumn("run_id", F.col("run_id").cast("string")) for n in KEYS}


def key_faults(tables: dict[str, DataFrame]) -> DataFrame:
    """check, key: repeated keys, references that lead nowhere, severities and ordinals outside of their domain."""
    out = []
    for name, keys in KEYS.items():
        twice = tables[name].groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
        out.append(twice.select(F.lit(f"{name}: repeated").alias("check"), F.concat_ws("/", *keys).alias("key")))
    for name, keys, other in REFERENCES:
        lost = tables[name].join(tables[other].select(*keys).distinct(), keys, "left_anti")
        out.append(lost.select(F.lit(f"{name}: not in {other}").alias("check"), F.concat_ws("/", *keys).alias("key")).distinct())
    f, e = tables["findings"], tables["finding_evidence"]
    out.append(violations(f, "finding_id", **{"findings: severity": ~F.col("severity").isin("LOW", "MEDIUM", "HIGH")}))
    out.append(violations(e, "finding_id", **{"finding_evidence: ordinal": F.col("ordinal") < 1}))
    faults = out[0]
    for x in out[1:]:
        faults = faults.unionByName(x)
    return faults
