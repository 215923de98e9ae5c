"""Queries over packages for review and their audits: contexts, blind views, stored counts, chart counts, bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonkeys
from ..functions import scalars as S
from ..functions.canon import row_json, same_text, with_rebuilt
from ..operators import detect, frames, normalize, quality, review, splits
from ..registry import ORACLES, query
from ..sources.shared import stored
from . import log_plans  # noqa: F401  (its SQL comes first)
from .log_plans import ISSUES, PORT, RULES
from .review_plans import STATUS, behaviours
from .sqltext import i, m

ACCEPTED_ISSUES = ["EXPECTED_MISSING_PORTS", "CONTEXTUAL_MISSING"]
DENIED_KEYS = ["verdict", "label", "threat_name"]
STRUCTURE = [("protocol", "bigint"), ("sent_bytes", "bigint"), ("service", "string")]


@query("pf24_predicate_issues", "logs", sql=f"SELECT DISTINCT record_number FROM ({ISSUES}) WHERE code NOT IN ('EXPECTED_MISSING_PORTS', 'CONTEXTUAL_MISSING')")
def pf24(logs):
    return normalize.normalize(logs).filter(F.exists("issues", lambda x: ~x["code"].isin(ACCEPTED_ISSUES))).select("record_number")


@query("pf31_blind_view", "reviewed", sql="SELECT row_key, group_id, score FROM reviewed WHERE review_id IS NOT NULL")
def pf31(x):
    return frames.blinded(x.filter("review_id is not null"), ["row_key", "group_id", "score"], {"blind_label", "membership", "rule_seen", "threat_seen"})


@query("pf32_evidence_package", "logs", sql=f"SELECT record_number, sha256(concat(length(loguid), ':', loguid, length(event_type), ':', event_type, length(event_action), ':', event_action)) AS package_id, CASE WHEN NOT {m('threat_name')} THEN threat_name END AS threat FROM logs WHERE event_type = 'utm'")
def pf32(logs):
    e = normalize.normalize(logs.filter("event_type = 'utm'"))
    package = F.struct("loguid", F.col("event.type").alias("type"), F.col("event.action").alias("action"), F.col("threat.name").alias("threat"))
    p = e.select("record_number", package.alias("package"))
    return p.select("record_number", F.sha2(S.length_prefixed("package.loguid", "package.type", "package.action"), 256).alias("package_id"), "package.threat")


CONTEXT = f"SELECT l.record_number, {i('net_proto')} AS protocol, {PORT.format(x=i('dst_port'))} AS destination_port, CASE WHEN NOT {m('app_service')} THEN app_service END AS service, CASE WHEN {i('net_sentbytes')} >= 0 THEN {i('net_sentbytes')} END AS sent_bytes, {m('net_sentbytes')} AS sent_missing, coalesce(r.ids, '') AS rules, r.ids IS NOT NULL AS rule_seen FROM logs l LEFT JOIN (SELECT record_number, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS ids FROM {RULES} GROUP BY 1) r USING (record_number)"


@query("pf35_pf36_context", "logs", sql=CONTEXT)
def pf35(logs):
    """Rule ids come from the conditions on the row itself, so no findings are joined back."""
    rules = F.array_compact(F.array(*[F.when(r.condition, r.rule_id) for r in detect.rules()]))
    e = normalize.normalize(logs).withColumn("_rules", F.array_sort(F.array_distinct(rules)))
    return e.select("record_number", "network.protocol", "network.destination_port", F.col("application.service").alias("service"), "network.sent_bytes", S.missing(F.col("source_record")["net_sentbytes"]).alias("sent_missing"), F.array_join("_rules", ",").alias("rules"), (F.size("_rules") > 0).alias("rule_seen"))


@query("pf37_au6_json_projection", "logs", sql=f"SELECT record_number, 'sent_bytes' AS field FROM logs WHERE record_number % 13 = 0 AND {i('net_sentbytes')} >= 0")
def pf37(logs):
    """Fields of a stored JSON text that differ from the columns beside it; every 13th text has another byte count."""
    e = normalize.normalize(logs).select("record_number", "network.protocol", "network.sent_bytes", F.col("application.service").alias("service"))
    sent = F.when(F.col("record_number") % 13 == 0, F.col("sent_bytes") + 1).otherwise(F.col("sent_bytes"))
    text = e.withColumn("json", F.to_json(F.struct("protocol", sent.alias("sent_bytes"), "service")))
    back = text.withColumn("j", F.from_json("json", ", ".join(f"{n} {t}" for n, t in STRUCTURE)))
    wrong = F.array_compact(F.array(*[F.when(~F.col(n).eqNullSafe(F.col("j")[n]), F.lit(n)) for n, _ in STRUCTURE]))
    return back.select("record_number", F.explode(wrong).alias("field"))


@query("pf37_au6_whole_event", "logs", sql=f"SELECT record_number, CASE WHEN record_number % 17 = 0 THEN 'FORM' ELSE 'network' END AS field FROM logs WHERE record_number % 17 = 0 OR (record_number % 13 = 0 AND {i('net_sentbytes')} >= 0)")
def pf37_whole(logs):
    """Sections of the whole event that differ from its stored canonical text; every 13th text has another byte count, and
    every 17th a foreign key, so that it is not the text of an event."""
    e = stored(normalize.normalize(logs))
    n = F.col("record_number")
    other = F.col("network").withField("sent_bytes", F.when(n % 13 == 0, F.col("network.sent_bytes") + 1).otherwise(F.col("network.sent_bytes")))
    text = e.withColumn("own", F.col("network")).withColumn("network", other).withColumn("json", row_json(e.schema)).drop("network").withColumnRenamed("own", "network")
    text = text.withColumn("json", F.when(n % 17 == 0, F.regexp_replace("json", r"^\{", '{"foreign":1,')).otherwise(F.col("json")))
    back = with_rebuilt(text, "json", e.schema, "j")
    wrong = S.listed(*[(~same_text(f"`{f.name}`", f"j.`{f.name}`", f.dataType), F.lit(f.name)) for f in e.schema])
    wrong = F.when(F.col("j").isNull(), F.array(F.lit("FORM"))).otherwise(wrong)
    return back.select("record_number", F.explode(wrong).alias("field"))


KEY_TEXT = "concat('{\"a\":{\"', CASE WHEN record_number % 50 = 0 THEN 'Top-N' WHEN record_number % 50 = 1 THEN 'label' ELSE 'kept' END, '\":', net_proto, ',\"x\":[{\"k\":1', CASE WHEN record_number % 70 = 0 THEN ',\"k\":2' ELSE '' END, '}]},\"b\":null', CASE WHEN record_number % 90 = 0 THEN ',\"a\":0' WHEN record_number % 90 = 1 THEN ',' ELSE '' END, '}')"
KEY_FAULTS = {"INVALID": ("''", "record_number % 90 = 1"), "FORBIDDEN": ("CASE WHEN record_number % 50 = 0 THEN '/a/Top-N' ELSE '/a/label' END", "record_number % 50 < 2 AND record_number % 90 <> 1"), "REPEATED": ("'/a/x/0/k'", "record_number % 70 = 0 AND record_number % 90 <> 1")}


@query("sf37_json_keys", "logs", sql=" UNION ALL ".join(f"SELECT record_number, '{f}' AS fault, {path} AS path FROM logs WHERE {where}" for f, (path, where) in KEY_FAULTS.items()) + " UNION ALL SELECT record_number, 'REPEATED', '/a' FROM logs WHERE record_number % 90 = 0")
def sf37_keys(logs):
    """Repeated and forbidden keys at any depth of JSON texts, with their paths, and texts that do not parse."""
    return jsonkeys.scanned(logs.select("record_number", F.expr(KEY_TEXT).alias("json")), "record_number", "json", {"label", "top_n"})


@query("pf38_event_references", "logs", sql="SELECT record_number, event_type AS type, loguid AS id, CASE WHEN trim(itime) = '' THEN 'NO_TIME' END AS fault FROM logs")
def pf38(logs):
    e = normalize.normalize(logs)
    fault = F.when(F.col("record_number") < 1, "BAD_NUMBER").when(S.missing("loguid"), "NO_ID").when(F.col("time.raw").isNull(), "NO_TIME")
    return e.select("record_number", "event.type", F.col("loguid").alias("id"), fault.alias("fault"))


@query("j20_context_labels", "reviewed", "labels", sql="SELECT r.row_key, r.blind_label, l.toxic AS context_label FROM reviewed r LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE quality = 1) l ON l.doc_id = r.row_key")
def j20(x, labels):
    return x.join(labels.filter("quality = 1").select(F.col("doc_id").alias("row_key"), F.col("toxic").alias("context_label")), "row_key", "left").select("row_key", "blind_label", "context_label")


@query("ag35_score_quantiles", "reviewed", sql=" UNION ALL ".join(f"SELECT membership, CAST({q} AS DOUBLE) AS q, quantile_disc(score, {q}) AS score FROM reviewed GROUP BY 1" for q in (0.5, 0.75, 1.0)))
def ag35(x):
    return frames.quantiles_by_group(x, "membership", "score", "row_key", [0.5, 0.75, 1.0])


@query("ag68_stored_counts", "logs", sql=f"SELECT 'findings' AS name, count(*) AS declared, count(*) AS stored, true AS agrees FROM {RULES} UNION ALL SELECT 'evidence', n, n, true FROM (SELECT CAST(coalesce(sum(CASE WHEN event_subtype = 'anomaly' THEN 2 ELSE 0 END + CASE WHEN {m('threat_name')} THEN 0 ELSE 3 END), 0) AS BIGINT) AS n FROM logs)")
def ag68(logs):
    """Counts declared by the conditions against rows of the tables of findings and evidence."""
    e = normalize.normalize(logs)
    rules, found = detect.rules(), detect.findings(e)
    paths = [reduce(lambda a, b: a + b, [F.col(p).isNotNull().cast("int") for p in r.evidence]) for r in rules]
    said = e.agg(F.sum(reduce(lambda a, b: a + b, [F.coalesce(r.condition, F.lit(False)).cast("int") for r in rules])).alias("findings"), F.sum(reduce(lambda a, b: a + b, [F.when(r.condition, n).otherwise(0) for r, n in zip(rules, paths, strict=True)])).alias("evidence"))
    declared = said.select(F.expr("stack(2, 'findings', coalesce(findings, 0), 'evidence', coalesce(evidence, 0)) as (name, declared)"))
    rows = found.agg(F.count("*").alias("stored")).select(F.lit("findings").alias("name"), "stored").unionByName(detect.evidence(found).agg(F.count("*").alias("stored")).select(F.lit("evidence").alias("name"), "stored"))
    return declared.join(rows, "name").withColumn("agrees", F.col("declared") == F.col("stored"))


@query("au19_decision_keys", "logs", sql=f"SELECT record_number, 'threat_name' AS keys FROM logs WHERE NOT {m('threat_name')}")
def au19(logs):
    """Records whose raw map fills a key that no source record may decide with."""
    full = F.map_filter("source_record", lambda k, v: S.filled(v))
    met = F.array_sort(F.array_intersect(F.map_keys(full), F.array(*[F.lit(k) for k in DENIED_KEYS])))
    return normalize.normalize(logs).select("record_number", met.alias("met")).filter(F.size("met") > 0).select("record_number", F.array_join("met", ",").alias("keys"))


@query("au21_score_metadata", "flows", sql="SELECT CASE WHEN protocol_number IN (1, 6, 17) THEN 'KNOWN' ELSE 'OTHER' END AS part, count(*) AS n, count(DISTINCT raw_score) AS n_distinct, min(raw_score) AS low, max(raw_score) AS high, quantile_disc(raw_score, 0.5) AS p50, quantile_disc(raw_score, 0.99) AS p99 FROM flows GROUP BY 1")
def au21(flows):
    x = flows.select(F.when(F.col("protocol_number").isin(1, 6, 17), "KNOWN").otherwise("OTHER").alias("part"), "record_number", "raw_score")
    q = frames.quantiles_by_group(x, "part", "raw_score", "record_number", [0.5, 0.99])
    q = q.groupBy("part").agg(F.max(F.when(F.col("q") == 0.5, F.col("raw_score"))).alias("p50"), F.max(F.when(F.col("q") == 0.99, F.col("raw_score"))).alias("p99"))
    s = x.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("raw_score").alias("n_distinct"), F.min("raw_score").alias("low"), F.max("raw_score").alias("high"))
    return s.join(q, "part", "left").select("part", "n", "n_distinct", "low", "high", "p50", "p99")


@query("au18_au22_finding_statistics", "logs", sql=f"SELECT rule_id, count(*) AS n, count(DISTINCT record_number) AS records, CAST(0 AS BIGINT) AS repeated, min(record_number) AS first_record, max(record_number) AS last_record, CAST(CASE WHEN rule_id = 'RULE_ANOMALY_SUBTYPE' THEN 2 ELSE 3 END AS BIGINT) AS most_evidence FROM {RULES} GROUP BY 1")
def au22(logs):
    f = detect.findings(normalize.normalize(logs))
    return f.groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("record_number").alias("records"), (F.count("*") - F.countDistinct("finding_id")).alias("repeated"), F.min("record_number").alias("first_record"), F.max("record_number").alias("last_record"), F.max(F.size("evidence")).cast("bigint").alias("most_evidence"))


BANDS = [(1000, "UP_TO_1000"), (3000, "UP_TO_3000")]
BAND_SQL = "CASE WHEN score <= 1000 THEN 'UP_TO_1000' WHEN score <= 3000 THEN 'UP_TO_3000' ELSE 'ABOVE' END"
BEHAVIOUR_SQL = "SELECT 'behaviour' AS chart, 'RULE_PATTERN' AS category FROM reviewed WHERE rule_seen UNION ALL SELECT 'behaviour', 'THREAT_PATTERN' FROM reviewed WHERE threat_seen UNION ALL SELECT 'behaviour', 'VOLUME_PATTERN' FROM reviewed WHERE score >= 3000 UNION ALL SELECT 'behaviour', 'UNCLASSIFIED_ANOMALOUS_PATTERN' FROM reviewed WHERE NOT rule_seen AND NOT threat_seen AND score < 3000"
CHARTS = {"membership": "membership", "group": "group_id", "status": STATUS, "label": "blind_label", "band": BAND_SQL, "rule": "CASE WHEN rule_seen THEN 'yes' ELSE 'no' END", "threat": "CASE WHEN threat_seen THEN 'yes' ELSE 'no' END"}


@query("rp1_chart_counts", "reviewed", sql="SELECT chart, category, count(*) AS n FROM (" + " UNION ALL ".join([f"SELECT '{k}' AS chart, {e} AS category FROM reviewed" for k, e in CHARTS.items()] + [BEHAVIOUR_SQL]) + ") WHERE category IS NOT NULL GROUP BY ALL")
def rp1(x):
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    return frames.category_counts(x, {"membership": F.col("membership"), "group": F.col("group_id"), "status": review.review_status("review_id", "blind_label"), "label": F.col("blind_label"), "band": S.bucket("score", BANDS, "ABOVE"), "rule": yes("rule_seen"), "threat": yes("threat_seen"), "behaviour[]": behaviours()})


#: Sections of the data-quality report and the queries that give the same rows from scans of their own.
SECTIONS = {"conditional_missing": "ag7_conditional_missing", "protocol_ports": "ag8_protocol_ports", "missing_patterns": "ag9_missing_patterns", "missing_time_context": "ag10_missing_time_context", "population": "ag11_ag12_ag25_population", "services": "ag13_w5_services", "service_alignment": "ag14_service_alignment", "session_sizes": "ag15_session_sizes", "session_buckets": "ag16_sf7_session_buckets", "lifecycle": "ag17_lifecycle", "session_metrics": "ag18_session_metrics", "missing_combinations": "ag19_ag24_combinations", "rare_combinations": "ag24_rare_combinations", "time_stats": "ag20_time_stats", "time_difference": "ag21_time_difference", "frequency": "ag23_frequency", "threat_presence": "ag26_threat_presence", "occurrences": "ag27_occurrences", "numeric_semantics": "ag28_numeric_semantics"}


def cells(section: str, df: DataFrame) -> DataFrame:
    """section, row: every row of a section as one text of its columns by name."""
    text = lambda c: F.coalesce(F.col(c).cast("bigint").cast("string") if dict(df.dtypes)[c] == "double" else F.col(c).cast("string"), F.lit("-"))
    return df.select(F.lit(section).alias("section"), F.concat_ws("|", *[text(c) for c in sorted(df.columns)]).alias("row"))


@query("rp5_section_rows", "logs", sql=None)
def rp5(logs):
    """All rows of all sections of the data-quality report, which one scan gives."""
    return reduce(DataFrame.unionByName, [cells(n, df) for n, df in quality.analyze(logs).items()])


def section_sql(section: str) -> str:
    columns = {"conditional_missing": "bytes_missing event_subtype event_type n net_proto src_missing", "protocol_ports": "both_missing dst_missing net_proto src_missing status", "missing_patterns": "n pattern", "missing_time_context": "field n value", "population": "event_action event_type service_filled threat_filled threat_missing", "services": "app_service cnt net_proto rn", "service_alignment": "n outcome", "session_sizes": "high low mid p50 p95 sessions singles", "session_buckets": "bucket records sessions", "lifecycle": "event_action records sessions", "session_metrics": "sessions state", "missing_combinations": "cnt event_action event_type", "rare_combinations": "cnt event_action event_type net_proto", "time_stats": "distinct_times failures high low span valid", "time_difference": "high is_constant low", "frequency": "cnt field value", "threat_presence": "event_subtype n present", "occurrences": "ids occurrences", "numeric_semantics": "mid others p99 zeros"}[section].split()
    text = lambda c: f"CAST({f'CAST(trunc({c}) AS BIGINT)' if c == 'mid' else c} AS STRING)"
    return f"SELECT '{section}' AS section, concat_ws('|', {', '.join(f"coalesce({text(c)}, '-')" for c in columns)}) AS row FROM ({ORACLES[SECTIONS[section]]}) t"


ORACLES["rp5_section_rows"] = " UNION ALL ".join(section_sql(n) for n in SECTIONS)


STORED = "SELECT {k} AS category, count(*) AS n FROM reviewed WHERE {w} AND {k} IS NOT NULL GROUP BY 1"


@query("au10_au11_summary_differences", "reviewed", sql=" UNION ALL ".join(f"SELECT '{n}' AS chart, category, e.n AS expected, a.n AS actual, CASE WHEN e.n IS NULL THEN 'UNEXPECTED' WHEN a.n IS NULL THEN 'ABSENT' ELSE 'DIFFERENT' END AS status FROM ({STORED.format(k=k, w='true')}) e FULL JOIN ({STORED.format(k=k, w='row_key % 10 <> 0')}) a USING (category) WHERE e.n IS DISTINCT FROM a.n" for n, k in (("membership", "membership"), ("label", "blind_label"))))
def au10(x):
    """Counts recomputed from all rows against a stored summary; here the summary lacks every tenth key."""
    charts = {"membership": F.col("membership"), "label": F.col("blind_label")}
    return frames.full_compare(frames.category_counts(x, charts), frames.category_counts(x.filter("row_key % 10 <> 0"), charts), ["chart", "category"], "n")


BOUNDS = {"source_port": ("src_port", 65535), "destination_port": ("dst_port", 65535), "sent_bytes": ("net_sentbytes", None)}


@query("au1_coverage_bounds", "logs", sql=" UNION ALL ".join(f"SELECT '{n}' AS path, count(*) AS n, count(x) AS filled, min(x) AS low, max(x) AS high, count(*) FILTER (WHERE x < 0{f' OR x > {top}' if top else ''}) AS outside, count(*) FILTER (WHERE x IS NULL AND NOT {m(c)}) AS lost FROM (SELECT *, CASE WHEN {i(c)} >= 0{f' AND {i(c)} <= {top}' if top else ''} THEN {i(c)} END AS x FROM logs)" for n, (c, top) in BOUNDS.items()))
def au1(logs):
    """Coverage and range of every converted path, and filled source cells that gave no value, from one scan."""
    v = lambda n: F.col(f"network.{n}")
    cells = [F.struct(F.lit(n).alias("path"), v(n).alias("x"), (v(n).isNull() & S.filled(F.col("source_record")[c])).alias("lost"), F.coalesce((v(n) < 0) | (v(n) > top if top else F.lit(False)), F.lit(False)).alias("outside")) for n, (c, top) in BOUNDS.items()]
    x = normalize.normalize(logs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return x.groupBy("path").agg(F.count("*").alias("n"), F.count("x").alias("filled"), F.min("x").alias("low"), F.max("x").alias("high"), F.count_if("outside").alias("outside"), F.count_if("lost").alias("lost"))


@query("au13_leaked_signals", "flows", sql="WITH f AS (SELECT session_id, record_number % 3 AS fold, count(*) AS n FROM flows GROUP BY ALL), g AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS d FROM f) SELECT CAST(fold AS INT) AS fold, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE d > 1), 0) AS BIGINT) AS leaked FROM g GROUP BY 1")
def au13(flows):
    return splits.leaked_rows(flows, "session_id", F.col("record_number") % 3, 3)


@query("ml22_fold_fit", "flows", sql="WITH f AS (SELECT *, CAST(('0x' || substr(sha256(session_id), 1, 16))::UBIGINT % 4 AS INT) AS fold FROM flows) SELECT k.fold, count(*) AS n, round(avg(sent_packets), 6) AS mean, round(stddev_pop(sent_packets), 6) AS deviation FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold WHERE sent_packets IS NOT NULL GROUP BY 1")
def ml22(flows):
    """Folds follow the session's hash, so that no group is split by a fit set."""
    f = splits.fold_fit(flows, S.hash_bucket("session_id", 4), 4, "sent_packets")
    return f.withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query("g5_split_manifest", "doc_keys")
def g5(d):
    """Components of equal or near keys, cut into 80, 10 and 10 percent of rows; the part of every row."""
    from .flow_plans import rooted

    rows = stored(rooted(d).select("row_key", F.col("root").cast("string").alias("root")))
    parts = splits.contiguous_split(rows.groupBy("root").agg(F.count("*").alias("n")), "root", "n")
    return rows.join(parts.select("root", "part"), "root")
