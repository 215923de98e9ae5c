"""Queries over stored runs, their audits, explanations, scorers and comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contexts, detect, explain, features, frames, learn, metrics, normalize, scorers, splits, store, validation
from ..registry import query
from ..sources import files
from ..sources.shared import shared_dir, stored
from .flow_plans import ELIGIBLE_SQL, FEATURE_SQL, JOINS, REF, is_ref
from .log_plans import RULES
from .sqltext import m


def two_runs(logs) -> dict:
    """Tables of two runs: all findings, and those of high severity."""
    folder, found = shared_dir(logs.sparkSession), detect.findings(normalize.normalize(logs))
    store.import_run(found, "run-a", folder)
    store.import_run(found.filter("severity = 'HIGH'"), "run-b", folder)
    return store.read_tables(logs.sparkSession, folder)


EVIDENCE = f"(SELECT record_number, rule_id, severity, unnest(CASE WHEN rule_id = 'RULE_ANOMALY_SUBTYPE' THEN [1, 2] ELSE [1, 2, 3] END) AS ordinal FROM {RULES})"


@query("sc14_stored_tables", "logs", sql=f"SELECT 'runs' AS table_name, r AS run_id, CAST(1 AS BIGINT) AS n FROM (VALUES ('run-a'), ('run-b')) t(r) UNION ALL SELECT 'run_rules', r, CAST(2 AS BIGINT) FROM (VALUES ('run-a'), ('run-b')) t(r) UNION ALL SELECT 'findings', 'run-a', count(*) FROM {RULES} UNION ALL SELECT 'findings', 'run-b', count(*) FROM {RULES} WHERE severity = 'HIGH' UNION ALL SELECT 'finding_evidence', 'run-a', count(*) FROM {EVIDENCE} UNION ALL SELECT 'finding_evidence', 'run-b', count(*) FROM {EVIDENCE} WHERE severity = 'HIGH'")
def sc14(logs):
    out = None
    for name, t in two_runs(logs).items():
        n = t.groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "run_id", "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("j6_rules_of_runs", "logs", sql=f"SELECT 'run-b' AS run_id, record_number, rule_id FROM {RULES} WHERE severity = 'HIGH'")
def j6(logs):
    """Findings whose run has no such rule; the rule is taken out of the second run."""
    t = two_runs(logs)
    rules = t["run_rules"].filter("not (run_id = 'run-b' and rule_id = 'RULE_SOURCE_THREAT')")
    return t["findings"].join(rules, ["run_id", "rule_id"], "left_anti").select("run_id", "record_number", "rule_id")


@query("au5_stored_keys", "logs", sql=f"SELECT 'findings: repeated' AS \"check\", count(*) AS n FROM {RULES} WHERE record_number % 15 = 0 AND record_number % 13 <> 0 HAVING count(*) > 0 UNION ALL SELECT 'findings: severity', count(*) FROM {RULES} WHERE record_number % 14 = 0 AND record_number % 13 <> 0 HAVING count(*) > 0 UNION ALL SELECT 'finding_evidence: not in findings', count(*) FROM {RULES} WHERE record_number % 13 = 0 HAVING count(*) > 0")
def au5(logs):
    """Faults of keys, references and domains in a stored run with planted ones."""
    folder = shared_dir(logs.sparkSession)
    store.import_run(detect.findings(normalize.normalize(logs)), "run-a", folder)
    t = store.read_tables(logs.sparkSession, folder)
    n = F.col("record_number")
    f = t["findings"].filter(n % 13 != 0).withColumn("severity", F.when(n % 14 == 0, "ODD").otherwise(F.col("severity")))
    faults = store.key_faults(t | {"findings": f.unionByName(f.filter(n % 15 == 0))})
    return faults.select("check", "key").distinct().groupBy("check").agg(F.count("*").alias("n"))


PLANTED = "CASE WHEN record_number % 43 = 0 THEN rank + 1 ELSE rank END"
SCORED = f"(SELECT *, CASE WHEN percentile >= 99.9 THEN 'TOP_0_1' WHEN percentile >= 99 THEN 'TOP_1' WHEN percentile >= 95 THEN 'TOP_5' ELSE 'BASELINE' END AS band FROM (SELECT record_number, raw_score, row_number() OVER (ORDER BY raw_score DESC, record_number) AS rank, 100.0::DOUBLE * sum(CASE WHEN {REF} THEN 1 ELSE 0 END) OVER (ORDER BY raw_score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(CASE WHEN {REF} THEN 1 ELSE 0 END) OVER () AS percentile FROM flows))"


@query("au8_ranks_recomputed", "flows", sql=f"SELECT kind, count(*) AS n FROM (SELECT unnest([CASE WHEN record_number % 43 = 0 THEN 'rank' END, CASE WHEN record_number % 47 = 0 THEN 'percentile' END, CASE WHEN record_number % 53 = 0 AND band <> 'TOP_5' THEN 'band' END, CASE WHEN record_number % 59 = 0 THEN 'flag' END]) AS kind FROM {SCORED}) WHERE kind IS NOT NULL GROUP BY 1")
def au8(flows):
    """Ranks, percentiles, bands and flags of a kept score table against recomputed ones; some of each are changed."""
    n = F.col("record_number")
    # Flows are grouped once, and the sample of the ranges reads the percentiles instead of making them again.
    s = frames.reference_percentile(stored(flows.select("record_number", "raw_score", is_ref().alias("ref"))), "raw_score", F.col("ref"))
    s = frames.global_rank(stored(s), [F.desc("raw_score"), "record_number"], "rank").withColumn("band", S.anomaly_band("percentile")).withColumn("flag", F.col("percentile") >= 99)
    kept = s.select("record_number", F.when(n % 43 == 0, F.col("rank") + 1).otherwise(F.col("rank")).alias("k_rank"), F.when(n % 47 == 0, F.col("percentile") / 2 + 1e-3).otherwise(F.col("percentile")).alias("k_percentile"), F.when(n % 53 == 0, "TOP_5").otherwise(F.col("band")).alias("k_band"), F.when(n % 59 == 0, ~F.col("flag")).otherwise(F.col("flag")).alias("k_flag"))
    both = s.join(kept, "record_number")
    rules = {k: ~F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in ("rank", "percentile", "band", "flag")}
    return frames.violations(both, "record_number", **rules).groupBy(F.col("check").alias("kind")).agg(F.count("*").alias("n"))


@query("au12_package_differences", "logs", sql=f"SELECT 'CSV' AS side, CAST(record_number AS STRING) AS record_number, rule_id, 'LOW' AS severity FROM {RULES} WHERE record_number % 21 = 0 UNION ALL SELECT 'ROWS', CAST(record_number AS STRING), rule_id, severity FROM {RULES} WHERE record_number % 21 = 0 OR record_number % 22 = 0 UNION ALL SELECT 'SUMMARY', rule_id, rule_id, CAST(count(*) - count(*) FILTER (WHERE record_number % 22 = 0 AND record_number % 21 <> 0) AS STRING) FROM {RULES} GROUP BY rule_id HAVING count(*) FILTER (WHERE record_number % 22 = 0 AND record_number % 21 <> 0) > 0")
def au12(logs):
    """A packaged CSV against the rows it was made from, both ways, and its counts; some lines are changed or left out."""
    spark, n = logs.sparkSession, F.col("record_number")
    rows = stored(detect.findings(normalize.normalize(logs)).select("record_number", "rule_id", "severity"))
    path = shared_dir(spark)
    planted = rows.withColumn("severity", F.when(n % 21 == 0, "LOW").otherwise(F.col("severity"))).filter((n % 22 != 0) | (n % 21 == 0))
    files.write_csv(planted, path)
    written = files.read_csv(spark, path, ["record_number", "rule_id", "severity"]).drop(files.BAD)
    text = rows.withColumn("record_number", n.cast("string"))
    out = written.exceptAll(text).select(F.lit("CSV").alias("side"), "*").unionByName(text.exceptAll(written).select(F.lit("ROWS").alias("side"), "*"))
    counts = text.groupBy("rule_id").agg(F.count("*").alias("a")).join(written.groupBy("rule_id").agg(F.count("*").alias("b")), "rule_id", "left").filter("a <> coalesce(b, 0)")
    return out.unionByName(counts.select(F.lit("SUMMARY").alias("side"), F.col("rule_id").alias("record_number"), "rule_id", F.coalesce("b", F.lit(0)).cast("string").alias("severity")))


POPULATIONS = {"DEVELOPMENT": "row_key % 5 < 3", "LOCKED_TEST": "row_key % 5 >= 3"}
MODELS = {"CHAIN-S1": "score * (1 + 0.25 * label2)", "CHAIN-S2": "score + 40 * (row_key % 7)"}


def ap_sql(score: str, where: str) -> str:
    return f"(SELECT sum(p * cp / (cp + cn)) / sum(p) FROM (SELECT s, sum(y) AS p, sum(sum(y)) OVER (ORDER BY s DESC) AS cp, sum(sum(1 - y)) OVER (ORDER BY s DESC) AS cn FROM (SELECT CAST({score} AS DOUBLE) AS s, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0 END AS y FROM labelled_scores WHERE {where}) GROUP BY s))"


@query("rp3_comparison_tables", "labelled_scores", sql="SELECT population, model, round(base_ap, 6) AS base_ap, round(chain_ap, 6) AS chain_ap, round(chain_ap - base_ap, 6) AS delta_ap, CASE WHEN abs(chain_ap - base_ap) <= 1e-6 THEN 'EQUAL' WHEN chain_ap > base_ap THEN 'HIGHER' ELSE 'LOWER' END AS result FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS population, '{k}' AS model, {ap_sql('score', w)} AS base_ap, {ap_sql(e, w)} AS chain_ap" for p, w in POPULATIONS.items() for k, e in MODELS.items()) + ")")
def rp3(x):
    """Average precision of each model against its base, on the development rows and on the locked ones."""
    out = None
    for p, where in POPULATIONS.items():
        own = x.filter(where)
        base = metrics.average_precision(own).select(F.col("ap").alias("base_ap"))
        for k, e in MODELS.items():
            chain = metrics.average_precision(own.withColumn("s", F.expr(e).cast("double")), "s").select(F.col("ap").alias("chain_ap"))
            row = base.crossJoin(F.broadcast(chain)).select(F.lit(p).alias("population"), F.lit(k).alias("model"), "base_ap", "chain_ap")
            out = row if out is None else out.unionByName(row)
    d = F.col("chain_ap") - F.col("base_ap")
    result = F.when(F.abs(d) <= 1e-6, "EQUAL").when(d > 0, "HIGHER").otherwise("LOWER")
    return out.select("population", "model", F.round("base_ap", 6).alias("base_ap"), F.round("chain_ap", 6).alias("chain_ap"), F.round(d, 6).alias("delta_ap"), result.alias("result"))


def metric_sql(model: str, population: str) -> str:
    """SQL of all metrics of one model's scores on one population."""
    score = {"BASE": "score", **MODELS}[model]
    own = f"(SELECT CAST({score} AS DOUBLE) AS s, label = 1 AS y FROM labelled_scores WHERE {POPULATIONS[population]})"
    counts = f"(SELECT count(*) AS n, count(*) FILTER (WHERE y) AS positives, count(*) FILTER (WHERE s >= 2000 AND y) AS tp, count(*) FILTER (WHERE s >= 2000 AND NOT y) AS fp, count(*) FILTER (WHERE s < 2000 AND y) AS fn, count(*) FILTER (WHERE s < 2000 AND NOT y) AS tn FROM {own})"
    values = {"n": "n", "positives": "positives", "tp": "tp", "fp": "fp", "fn": "fn", "tn": "tn", "accuracy": "CAST(tp + tn AS DOUBLE) / nullif(n, 0)", "precision": "CAST(tp AS DOUBLE) / nullif(tp + fp, 0)", "recall": "CAST(tp AS DOUBLE) / nullif(tp + fn, 0)", "f1": "2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0)"}
    values |= {"ap": ap_sql(score, POPULATIONS[population]), "auc": f"(SELECT sum(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*) FROM {own} a, {own} b WHERE a.y AND NOT b.y)"}
    return " UNION ALL ".join(f"SELECT '{model}' AS model, '{population}' AS population, '{k}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM {counts}" for k, e in values.items())


@query("rp2_metrics_by_population", "labelled_scores", sql=" UNION ALL ".join(metric_sql(m, p) for m in ("BASE", *MODELS) for p in POPULATIONS))
def rp2_whole(x):
    """The long table of metrics by model and population: matrix, rates at one threshold, AP and ROC-AUC."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).cast("double").alias("s")) for m, e in {"BASE": "score", **MODELS}.items()])
    population = F.array_compact(F.array(*[F.when(F.expr(w), n) for n, w in POPULATIONS.items()]))
    long = x.select("label", F.explode(population).alias("population"), models.alias("m")).select("label", "population", F.explode("m").alias("m")).select("label", "population", "m.*")
    return contexts.metric_table(long, ["model", "population"], F.col("s") >= 2000, "s").withColumn("value", F.round("value", 6))


def kind_sql(f: str) -> str:
    return "MISSING" if f in explain.MISSING else "RARITY" if f in features.RARE else "SIGN" if f in explain.SIGNS else "NUMBER"


CELLS = "SELECT record_number, ref, unnest([" + ", ".join(f"{{'pos': {i}, 'feature': '{f}', 'kind': '{kind_sql(f)}', 'x': {f}, 'ok': substr(eligible, {i + 1}, 1) = '1', 'may': " + (f"{f} = 1" if f in explain.SIGNS else f"substr(eligible, {i + 1}, 1) = '1'") + "}" for i, f in enumerate(FEATURE_SQL)) + "], recursive := true) FROM (SELECT f.record_number, " + REF.replace("session_id", "f.session_id") + " AS ref, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in FEATURE_SQL.items()) + f", {ELIGIBLE_SQL} AS eligible FROM flows f {JOINS})"
COUNTED = f"SELECT *, CAST(sum(CASE WHEN ref AND ok THEN 1 ELSE 0 END) OVER (PARTITION BY pos ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto, CAST(sum(CASE WHEN ref AND ok THEN 1 ELSE 0 END) OVER (PARTITION BY pos, x) AS BIGINT) AS own, CAST(sum(CASE WHEN ref AND ok THEN 1 ELSE 0 END) OVER (PARTITION BY pos) AS BIGINT) AS total, count(DISTINCT CASE WHEN ref AND ok THEN x END) OVER (PARTITION BY pos) AS vals FROM ({CELLS})"
MEASURED = f"SELECT *, upto - own AS less, CASE WHEN total = 0 THEN 0 WHEN kind = 'RARITY' THEN CASE WHEN vals = 1 THEN CASE WHEN own = 0 AND upto > 0 THEN 1 ELSE 0 END ELSE greatest(0, 2 * ((upto - own + 0.5::DOUBLE * own) / total) - 1) END WHEN vals = 1 THEN CASE WHEN own > 0 THEN 0 ELSE 1 END ELSE 2 * abs((upto - own + 0.5::DOUBLE * own) / total - 0.5) END AS e FROM ({COUNTED}) WHERE may"
TEXT = "concat(CASE kind WHEN 'MISSING' THEN concat(replace(feature, '_missing', ''), ': absent in this record; reference absence frequency ', own, '/', total) WHEN 'RARITY' THEN concat(feature, ': observed in ', own, '/', total, ' reference records of this protocol') WHEN 'SIGN' THEN concat(feature, ': observed 1.0; reference frequency ', own, '/', total) ELSE concat(feature, ': observed ', printf('%.6f', x), '; ', CASE WHEN upto - own + own / 2.0 >= total / 2.0 THEN 'higher' ELSE 'lower' END, ' relative to ', total, ' eligible reference records') END, '; descriptive extremeness ', printf('%.6f', e))"


@query("sf26_sf27_sf28_drivers", "flows", sql=f"SELECT record_number, CAST(place AS INT) AS place, feature, round(e, 6) AS extremeness, {TEXT} AS text FROM (SELECT *, row_number() OVER (PARTITION BY record_number ORDER BY e DESC, pos) AS place FROM ({MEASURED})) WHERE place <= 3")
def sf28(flows):
    """The three most extreme features that may explain each record, in words."""
    rows = features.feature_rows(flows, is_ref(), "record_number", "session_id")
    return explain.drivers(rows, "record_number", is_ref()).withColumn("extremeness", F.round("extremeness", 6))


FAMILY_SQL = "CASE " + " ".join(f"WHEN feature IN ({', '.join(repr(f) for f in fs)}) THEN {i}" for i, (_, _, fs) in enumerate(explain.FAMILIES)) + " END"
BEHAVIOUR_SQL = "CASE family " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b, _) in enumerate(explain.FAMILIES)) + " END"
RULE_IDS = {"RULE_EVEN_PORT": "destination_port % 2 = 0", "RULE_LARGE": "sent_bytes > 50000"}
THREAT = "sent_packets % 7 = 0"
EXPLAINED = f"""WITH m AS (SELECT *, {FAMILY_SQL} AS family FROM ({MEASURED})),
b AS (SELECT *, row_number() OVER (PARTITION BY record_number, family ORDER BY e DESC, feature) AS k FROM m),
t AS (SELECT *, row_number() OVER (PARTITION BY record_number ORDER BY e DESC, family) AS p FROM b WHERE k = 1 AND e > 0),
r AS (SELECT record_number, count(*) AS n, string_agg(concat(feature, ' ', printf('%.6f', e)), ',' ORDER BY p) FILTER (WHERE p <= 3) AS reasons, max(CASE WHEN p = 1 THEN {TEXT} END) AS first_text FROM t GROUP BY 1),
q AS (SELECT record_number, count(*) AS n, string_agg({BEHAVIOUR_SQL}, ',' ORDER BY family) AS behaviours, max(family) >= 3 AS towards FROM (SELECT DISTINCT record_number, family FROM m WHERE kind <> 'MISSING' AND e >= 0.95) GROUP BY 1),
s AS (SELECT *, coalesce(length(rules) > 0 OR threat, false) AS seen FROM (SELECT record_number, row_number() OVER (ORDER BY raw_score DESC, record_number) AS place, 100.0::DOUBLE * count(*) OVER (ORDER BY raw_score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER () AS score, concat_ws(',', {", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in RULE_IDS.items())}) AS rules, {THREAT} AS threat, sent_packets % 14 = 0 AS recon FROM flows)),
x AS (SELECT s.record_number, place <= 50 AS selected, CASE WHEN place <= 50 AND q.n IS NULL THEN 'UNCLASSIFIED_ANOMALOUS_PATTERN' ELSE coalesce(behaviours, '') END AS behaviours, CASE WHEN place <= 50 THEN CASE WHEN recon AND coalesce(towards, false) THEN 'Possible reconnaissance activity' ELSE 'Unclassified suspicious behavior' END END AS attack_type, CASE WHEN place > 50 OR q.n IS NULL THEN NULL WHEN q.n >= 2 AND seen THEN 'HIGH' WHEN q.n >= 2 OR seen THEN 'MEDIUM' ELSE 'LOW' END AS strength, CASE WHEN r.n >= 3 THEN 'COMPLETE' ELSE 'LIMITED' END AS status, coalesce(reasons, '') AS reasons, first_text, round(least(100, 0.9::DOUBLE * score + CASE WHEN seen THEN 10.0::DOUBLE ELSE 0 END), 6) AS priority, rules, place FROM s LEFT JOIN r ON r.record_number = s.record_number LEFT JOIN q ON q.record_number = s.record_number)
SELECT * EXCLUDE (place), row_number() OVER (ORDER BY priority DESC, place) AS rank FROM x"""


@query("ml20_explanation_record", "flows", sql=EXPLAINED)
def ml20(flows):
    """The whole explanation of every record: reasons, behaviours, attack text, strength, status, priority and its rank."""
    flows = stored(flows)
    rows = features.feature_rows(flows, is_ref(), "record_number", "session_id")
    ranked = frames.global_rank(flows, [F.desc("raw_score"), "record_number"], "place").select("record_number", "place")
    scored = frames.reference_percentile(flows, "raw_score", F.lit(True), "score").join(ranked, "record_number")
    rules = F.array_compact(F.array(*[F.when(F.expr(e), n) for n, e in RULE_IDS.items()]))
    scores = scored.select("record_number", "score", "place", rules.alias("rules"), F.expr(THREAT).alias("threat"), F.when(F.expr("sent_packets % 14 = 0"), "Reconnaissance").alias("threat_type"))
    x = explain.explanations(rows, "record_number", is_ref(), scores)
    shown = F.array_join(F.transform("reasons", lambda r: F.concat(r["feature"], F.lit(" "), explain.fixed(r["extremeness"]))), ",")
    return x.select("record_number", "selected", F.array_join("behaviours", ",").alias("behaviours"), "attack_type", "strength", "status", shown.alias("reasons"), F.expr("get(reasons, 0).text").alias("first_text"), F.round("priority", 6).alias("priority"), F.array_join("rules", ",").alias("rules"), "rank")


#: Faults planted in explanations, by record number.
PLANTED = {"ABSENT": 37, "SELECTED": 41, "PRIORITY": 43, "RANK": 47, "RULES": 53, "STATUS": 59, "REASONS": 61, "STRENGTH": 67, "ATTACK_TYPE": 71}
MADE = f"FROM (SELECT record_number, row_number() OVER (ORDER BY raw_score DESC, record_number) AS place FROM flows) WHERE record_number % {PLANTED['ABSENT']} <> 0"


@query("au9_explanation_audit", "flows", sql=f"SELECT 'ABSENT' AS \"check\", CAST(record_number AS STRING) AS key FROM flows WHERE record_number % {PLANTED['ABSENT']} = 0 UNION ALL SELECT 'UNEXPECTED', '-1' UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', CAST(record_number AS STRING) {MADE} AND record_number % {k} = 0{' AND place > 50' if n == 'STRENGTH' else ''}" for n, k in PLANTED.items() if n != "ABSENT") + f" UNION ALL SELECT 'BEHAVIOURS', CAST(record_number AS STRING) {MADE} AND record_number % 2 = 0 AND place <= 50")
def au9(flows):
    """Explanations with planted faults against the scores that they belong to."""
    n = F.col("record_number")
    # Flows are grouped once; the places are ranked with the score beside them, so that no join brings them together.
    flows = stored(flows.select("record_number", "raw_score", "destination_port", "sent_bytes", "sent_packets"))
    scored = frames.global_rank(frames.reference_percentile(flows, "raw_score", F.lit(True), "score"), [F.desc("raw_score"), "record_number"], "place")
    rules = S.listed(*[(F.expr(e), F.lit(r)) for r, e in RULE_IDS.items()])
    scores = stored(scored.select("record_number", "score", "place", rules.alias("rules"), F.coalesce(F.expr(THREAT), F.lit(False)).alias("threat")))
    at = lambda name: n % PLANTED[name] == 0
    right = frames.global_rank(scores.withColumn("priority", S.priority("score", (F.size("rules") > 0) | F.col("threat"))), [F.desc("priority"), "place"], "rank")
    reason = lambda e: F.struct(F.lit("f").alias("feature"), F.lit(e).alias("extremeness"), F.lit("").alias("text"))
    top = F.col("place") <= 50
    made = right.filter(~at("ABSENT")).select(
        "record_number", F.when(at("SELECTED"), ~top).otherwise(top).alias("selected"), F.when(n % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("B"))).alias("behaviours"),
        F.when(at("ATTACK_TYPE") != top, "type").alias("attack_type"), F.when(at("STRENGTH") | top, "LOW").alias("strength"), F.when(at("STATUS"), "LIMITED").otherwise("COMPLETE").alias("status"),
        F.when(at("REASONS"), F.array(reason(0.5), reason(0.9), reason(0.7))).otherwise(F.array(reason(0.9), reason(0.9), reason(0.2))).alias("reasons"), F.when(at("PRIORITY"), F.col("priority") + 0.5).otherwise(F.col("priority")).alias("priority"),
        F.when(at("RULES"), F.concat(F.array_sort("rules"), F.array(F.lit("RULE_X")))).otherwise(F.array_sort("rules")).alias("rules"), F.when(at("RANK"), F.col("rank") + 1).otherwise(F.col("rank")).alias("rank"),
    )
    foreign = made.limit(1).withColumn("record_number", F.lit(-1).cast("bigint"))
    return explain.audit(made.unionByName(foreign), scores, "record_number")


@query("sf30_evidence_strength", "flows", sql="SELECT record_number, CASE WHEN place > 50 OR q = 0 THEN NULL WHEN q >= 2 AND seen THEN 'HIGH' WHEN q >= 2 OR seen THEN 'MEDIUM' ELSE 'LOW' END AS strength FROM (SELECT record_number, row_number() OVER (ORDER BY raw_score DESC, record_number) AS place, CASE WHEN sent_bytes > 50000 THEN 1 ELSE 0 END + CASE WHEN sent_packets > 40 THEN 1 ELSE 0 END + CASE WHEN service IS NULL THEN 1 ELSE 0 END AS q, coalesce(destination_port % 2 = 0, false) AS seen FROM flows)")
def sf30(flows):
    r = frames.global_rank(flows, [F.desc("raw_score"), "record_number"], "place")
    q = sum((F.coalesce(e, F.lit(False)).cast("int") for e in (F.col("sent_bytes") > 50000, F.col("sent_packets") > 40, F.col("service").isNull())), F.lit(0))
    return r.select("record_number", explain.evidence_strength(q, F.coalesce(F.col("destination_port") % 2 == 0, F.lit(False)), F.col("place") <= 50).alias("strength"))


Z = " + ".join(f"pow((f.{c} - s.m_{c}) / coalesce(nullif(s.d_{c}, 0), 1), 2)" for c in ("received_bytes", "sent_packets"))


@query("u2_pluggable_scorer", "flows", sql=f"SELECT f.record_number, round({Z}, 6) AS raw_score FROM flows f, (SELECT avg(received_bytes) AS m_received_bytes, stddev_pop(received_bytes) AS d_received_bytes, avg(sent_packets) AS m_sent_packets, stddev_pop(sent_packets) AS d_sent_packets FROM flows WHERE {REF}) s")
def u2(flows):
    rows = flows.select("record_number", "session_id", F.col("received_bytes").cast("double").alias("received_bytes"), F.col("sent_packets").cast("double").alias("sent_packets"))
    return scorers.score_with(scorers.Spread(), rows, is_ref(), "record_number", ["received_bytes", "sent_packets"]).withColumn("raw_score", F.round("raw_score", 6))


@query("g3_entity_tiers", "entity_keys")
def g3(x):
    """tier, row_key, root: groups by hard keys alone, with source and host, and with all endpoints."""
    return splits.tier_roots(x, "row_key")


@query("g10_staging", "entity_keys")
def g10(x):
    """The checks of the selected tier and, where it fails, of the approved fallback to hard keys with its allocation by strata."""
    size = F.length("exact_key")
    strata = F.when(size < 400, "SHORT").when(size < 1200, "MIDDLE").otherwise("LONG")
    return splits.staged(x.withColumn("stratum", strata), "row_key", "stratum", approved="HARD_GROUP_ONLY", groups_least=50, rows_least=10, off=0.1, most=0.25, stratum_off=0.15)


def labelled_rows(flows):
    f = features.traffic_features()
    names = ["log_sent_bytes", "log_received_bytes", "log_sent_packets", "log_received_packets", "sent_byte_share", "src_port_registered"]
    part = F.when(S.hash_bucket("session_id", 10) < 6, "FIT").when(S.hash_bucket("session_id", 10) < 8, "CALIBRATION").otherwise("TEST")
    return stored(flows.select("record_number", part.alias("part"), (F.col("protocol_number") == 6).cast("int").alias("label"), *[f[n].alias(n) for n in names])), names


JOB_NUMBERS, JOB_CATEGORIES = ["sent_bytes", "received_bytes", "sent_packets", "received_packets", "duration"], ["service"]


@query("ml25_saved_model_scores", "flows")
def ml25(flows):
    """A model that was fitted, saved and loaded again, on the test rows: matrix, rates, AP and ROC-AUC."""
    rows, names = labelled_rows(flows)
    path = shared_dir(flows.sparkSession)
    learn.save_pipeline(rows.filter("part = 'FIT'"), names, "label", path)
    p = stored(learn.score_saved(path, rows.filter("part = 'TEST'"), ["record_number", "label"]))
    m = metrics.rates(metrics.confusion(p, F.col("p_attack") >= 0.5), 0.0)
    return m.crossJoin(F.broadcast(metrics.average_precision(p, "p_attack"))).crossJoin(F.broadcast(metrics.roc_auc(p, "p_attack"))).select("tp", "fp", "fn", "tn", *[F.round(k, 6).alias(k) for k in ("accuracy", "precision", "recall", "f1", "ap", "auc")])


@query("ml26_validation_job", "flows")
def ml26(flows):
    """The forest and the centres fitted on the first part of whole sessions, their thresholds chosen on the second, both held
    against the third: matrix, rates, AP and ROC-AUC by part, with and without rows of conflicting targets, and the choice."""
    rows = stored(flows.select("record_number", "session_id", (F.col("protocol_number") == 6).cast("int").alias("label"), *JOB_NUMBERS, *JOB_CATEGORIES))
    job = validation.validation_job(rows, "record_number", "session_id", JOB_NUMBERS, JOB_CATEGORIES)
    return job.withColumns({k: F.round(k, 6) for k in ("threshold", "accuracy", "precision", "recall", "f1", "ap", "auc")})
