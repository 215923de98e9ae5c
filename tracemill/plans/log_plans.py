"""Queries over the log view: normalising, rules, profiles, data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import detect, frames, normalize
from ..registry import query
from .sqltext import i, m, pct

FIELDS = ["net_sessionid", "itime", "event_type", "event_subtype", "event_action", "net_proto", "src_port", "dst_port", "app_service", "net_sentbytes", "threat_name"]
PORT = "CASE WHEN {x} BETWEEN 0 AND 65535 THEN {x} END"
RULES = "(SELECT record_number, loguid, 'RULE_ANOMALY_SUBTYPE' AS rule_id, 'MEDIUM' AS severity FROM logs WHERE event_subtype = 'anomaly' UNION ALL SELECT record_number, loguid, 'RULE_SOURCE_THREAT', 'HIGH' FROM logs WHERE NOT " + m("threat_name") + ")"


@query("pf1_normalize", "logs", sql=f"SELECT record_number, CASE WHEN NOT {m('event_type')} THEN event_type END AS event_type, {i('net_proto')} AS protocol, CASE WHEN NOT {m('app_service')} THEN app_service END AS service, {PORT.format(x=i('src_port'))} AS source_port, {PORT.format(x=i('dst_port'))} AS destination_port, CASE WHEN {i('net_sentbytes')} >= 0 THEN {i('net_sentbytes')} END AS sent_bytes FROM logs")
def pf1(logs):
    e = normalize.normalize(logs)
    return e.select("record_number", F.col("event.type").alias("event_type"), "network.protocol", F.col("application.service").alias("service"), "network.source_port", "network.destination_port", "network.sent_bytes")


@query("pf3_time", "logs", sql=f"SELECT record_number, CASE WHEN NOT {m('itime')} THEN itime END AS raw, strftime(make_timestamp({i('itime')} * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS utc FROM logs")
def pf3(logs):
    return normalize.normalize(logs).select("record_number", "time.raw", "time.utc")


@query("pf4_protocol", "logs", sql=f"SELECT net_proto AS raw, {i('net_proto')} AS number, CASE {i('net_proto')} WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END AS name, count(*) AS n FROM logs GROUP BY ALL")
def pf4(logs):
    n = S.integer("net_proto")
    return logs.groupBy(F.col("net_proto").alias("raw"), n.alias("number"), S.protocol_name(n).alias("name")).agg(F.count("*").alias("n"))


ISSUES = f"""
SELECT record_number, 'itime' AS field, 'MISSING_TIME' AS code FROM logs WHERE {m('itime')}
UNION ALL SELECT record_number, 'net_proto', 'UNKNOWN_PROTOCOL' FROM logs WHERE {i('net_proto')} NOT IN (1, 6, 17)
UNION ALL SELECT record_number, 'src_port', 'INVALID_PORT' FROM logs WHERE NOT {m('src_port')} AND coalesce({i('src_port')}, -1) NOT BETWEEN 0 AND 65535
UNION ALL SELECT record_number, 'dst_port', 'INVALID_PORT' FROM logs WHERE NOT {m('dst_port')} AND coalesce({i('dst_port')}, -1) NOT BETWEEN 0 AND 65535
UNION ALL SELECT record_number, 'ports', 'EXPECTED_MISSING_PORTS' FROM logs WHERE {i('net_proto')} = 1 AND {m('src_port')} AND {m('dst_port')}
UNION ALL SELECT record_number, 'src_port', 'CONTEXTUAL_MISSING' FROM logs WHERE coalesce({i('net_proto')} <> 1, true) AND {m('src_port')}
UNION ALL SELECT record_number, 'dst_port', 'CONTEXTUAL_MISSING' FROM logs WHERE coalesce({i('net_proto')} <> 1, true) AND {m('dst_port')}
UNION ALL SELECT record_number, 'net_sentbytes', 'INVALID_METRIC' FROM logs WHERE NOT {m('net_sentbytes')} AND coalesce({i('net_sentbytes')}, -1) < 0"""


@query("pf5_pf6_pf7_issues", "logs", sql=ISSUES)
def pf7(logs):
    return normalize.normalize(logs).select("record_number", F.explode("issues").alias("x")).select("record_number", "x.field", "x.code")


@query("pf8_provenance", "logs", sql=f"SELECT path, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT {m('event_type')} THEN 'event.type' END, CASE WHEN NOT {m('threat_name')} THEN 'threat.name' END, CASE WHEN NOT {m('src_port')} THEN 'network.source_port' END]) AS path FROM logs) WHERE path IS NOT NULL GROUP BY 1")
def pf8(logs):
    p = normalize.normalize(logs).select(F.explode("provenance").alias("p")).select("p.path")
    return p.filter(F.col("path").isin("event.type", "threat.name", "network.source_port")).groupBy("path").agg(F.count("*").alias("n"))


@query("pf10_pf17_event_violations", "logs", sql="SELECT 'no_provenance' AS \"check\", CAST(record_number AS STRING) AS key FROM logs WHERE record_number % 9 = 0 UNION ALL SELECT 'double_path', CAST(record_number AS STRING) FROM logs WHERE record_number % 11 = 0 AND record_number % 9 <> 0 UNION ALL SELECT 'lost_record', CAST(record_number AS STRING) FROM logs WHERE record_number % 13 = 0")
def pf10(logs):
    """Contract violations of events, with planted ones: provenance lost, a path twice, the source record lost."""
    n = F.col("record_number")
    e = normalize.normalize(logs).withColumn("provenance", F.when(n % 9 == 0, F.slice("provenance", 1, 0)).when(n % 11 == 0, F.concat("provenance", "provenance")).otherwise(F.col("provenance")))
    e = e.withColumn("source_record", F.when(n % 13 == 0, F.create_map().cast("map<string,string>")).otherwise(F.col("source_record")))
    return frames.violations(e, "record_number", no_provenance=F.size("provenance") == 0, double_path=F.size("provenance") != F.size(F.array_distinct(F.transform("provenance", lambda p: p["path"]))), lost_record=F.size("source_record") == 0)


@query("pf13_anomaly_rule", "logs", sql="SELECT record_number FROM logs WHERE event_subtype = 'anomaly'")
def pf13(logs):
    return logs.filter(S.equals(event_subtype="anomaly")).select("record_number")


@query("pf14_threat_rule", "logs", sql=f"SELECT record_number FROM logs WHERE NOT {m('threat_name')} OR event_type = 'utm'")
def pf14(logs):
    return logs.filter(S.any_of([S.filled("threat_name"), F.col("event_type") == "utm"])).select("record_number")


@query("pf15_findings", "logs", sql=f"SELECT f.record_number, loguid, rule_id, severity, sha256(concat(length(rule_id), ':', rule_id, length(loguid), ':', loguid, length(CAST(f.record_number AS STRING)), ':', CAST(f.record_number AS STRING))) AS finding_id FROM {RULES} f")
def pf15(logs):
    return detect.findings(normalize.normalize(logs)).drop("evidence")


@query("pf16_evidence", "logs", sql=f"SELECT rule_id, path, value, count(*) AS n FROM (SELECT 'RULE_ANOMALY_SUBTYPE' AS rule_id, unnest([{{'path': 'event.subtype', 'value': event_subtype}}, {{'path': 'event.type', 'value': event_type}}], recursive := true) FROM logs WHERE event_subtype = 'anomaly' UNION ALL SELECT 'RULE_SOURCE_THREAT', unnest([{{'path': 'threat.name', 'value': threat_name}}, {{'path': 'event.subtype', 'value': event_subtype}}, {{'path': 'network.protocol', 'value': net_proto}}], recursive := true) FROM logs WHERE NOT {m('threat_name')}) GROUP BY ALL")
def pf16(logs):
    f = detect.findings(normalize.normalize(logs))
    return f.select("rule_id", F.explode("evidence").alias("e")).groupBy("rule_id", "e.path", "e.value").agg(F.count("*").alias("n"))


@query("pf18_sr1_list_findings", "logs", sql=f"SELECT record_number, rule_id, severity FROM {RULES} WHERE severity = 'HIGH' AND rule_id = 'RULE_SOURCE_THREAT' ORDER BY record_number, rule_id LIMIT 50")
def pf18(logs):
    f = detect.findings(normalize.normalize(logs)).filter((F.col("severity") == "HIGH") & (F.col("rule_id") == "RULE_SOURCE_THREAT"))
    return f.select("record_number", "rule_id", "severity").orderBy("record_number", "rule_id").limit(50)


@query("pf19_get_finding", "logs", sql=f"SELECT record_number, rule_id FROM {RULES} WHERE record_number = (SELECT min(record_number) FROM {RULES})")
def pf19(logs):
    f = detect.findings(normalize.normalize(logs))
    first = f.agg(F.min("record_number").alias("r"))
    return f.join(F.broadcast(first), F.col("record_number") == F.col("r")).select("record_number", "rule_id")


@query("j3_rule_sets", "logs", sql=f"SELECT l.record_number, coalesce(r.rules, '') AS rules FROM logs l LEFT JOIN (SELECT record_number, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM {RULES} GROUP BY 1) r USING (record_number)")
def j3(logs):
    sets = detect.findings(normalize.normalize(logs)).groupBy("record_number").agg(F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))
    return logs.select("record_number").join(sets, "record_number", "left").select("record_number", F.coalesce("rules", F.lit("")).alias("rules"))


@query("j4_unmatched_findings", "logs", sql=f"SELECT record_number FROM {RULES} WHERE record_number % 10 = 3")
def j4(logs):
    """Findings whose record is gone: every tenth record is left out of the records' side."""
    kept = logs.filter("record_number % 10 <> 3").select("record_number")
    return detect.findings(normalize.normalize(logs)).join(kept, "record_number", "left_anti").select("record_number")


@query("j5_with_evidence_path", "logs", sql=f"SELECT record_number, rule_id FROM {RULES} WHERE rule_id = 'RULE_SOURCE_THREAT'")
def j5(logs):
    f = detect.findings(normalize.normalize(logs))
    return f.join(detect.evidence(f).filter("path = 'threat.name'"), "finding_id", "left_semi").select("record_number", "rule_id")


@query("ag1_profile_counts", "logs", sql=f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {i('net_proto')} IS NOT NULL) AS valid, count(*) FILTER (WHERE {i('dst_port')} IS NULL AND NOT {m('dst_port')}) AS malformed FROM logs")
def ag1(logs):
    return logs.agg(F.count("*").alias("n_rows"), F.count_if(S.integer("net_proto").isNotNull()).alias("valid"), F.count_if(S.integer("dst_port").isNull() & S.filled("dst_port")).alias("malformed"))


@query("ag2_missing", "logs", sql=" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS total, count(*) FILTER (WHERE {m(f)}) AS missing, {pct(f'count(*) FILTER (WHERE {m(f)})', 'count(*)')} AS percent FROM logs" for f in FIELDS))
def ag2(logs):
    return frames.missing_profile(logs, FIELDS).withColumn("percent", F.round(S.percentage("missing", "total"), 4))


@query("ag3_sr3_top_values", "logs", sql="SELECT event_action AS value, count(*) AS cnt, CAST((SELECT count(*) FROM logs) AS BIGINT) AS total FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def ag3(logs):
    return frames.top_values(logs.select(F.col("event_action").alias("value")), ["value"], 3).crossJoin(F.broadcast(logs.agg(F.count("*").alias("total"))))


@query("ag4_numeric_profile", "logs", sql=f"SELECT count(*) FILTER (WHERE NOT {m('dst_port')}) AS filled, count({i('dst_port')}) AS valid, count(*) FILTER (WHERE NOT {m('dst_port')} AND {i('dst_port')} IS NULL) AS failures, min({i('dst_port')}) AS low, max({i('dst_port')}) AS high FROM logs")
def ag4(logs):
    x = S.integer("dst_port")
    return logs.agg(F.count_if(S.filled("dst_port")).alias("filled"), F.count(x).alias("valid"), F.count_if(S.filled("dst_port") & x.isNull()).alias("failures"), F.min(x).alias("low"), F.max(x).alias("high"))


@query("ag5_duplicate_rows", "logs", sql="SELECT CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS c FROM logs GROUP BY net_sessionid, event_type, event_action, net_proto)")
def ag5(logs):
    key = F.sha2(S.length_prefixed("net_sessionid", "event_type", "event_action", "net_proto"), 256)
    return logs.groupBy(key.alias("h")).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("duplicates"))


@query("ag6_identifiers", "logs", sql="SELECT count(net_sessionid) AS filled, count(DISTINCT net_sessionid) AS distinct_ids, count(net_sessionid) - count(DISTINCT net_sessionid) AS repeats FROM logs")
def ag6(logs):
    return logs.agg(F.count("net_sessionid").alias("filled"), F.countDistinct("net_sessionid").alias("distinct_ids")).withColumn("repeats", F.col("filled") - F.col("distinct_ids"))


@query("ag7_conditional_missing", "logs", sql=f"SELECT event_type, event_subtype, net_proto, count(*) FILTER (WHERE {m('src_port')}) AS src_missing, count(*) FILTER (WHERE {m('net_sentbytes')}) AS bytes_missing, count(*) AS n FROM logs GROUP BY GROUPING SETS ((event_type), (event_subtype), (net_proto), (event_type, event_subtype), (event_type, net_proto), (event_type, event_subtype, net_proto), ())")
def ag7(logs):
    sets = [["event_type"], ["event_subtype"], ["net_proto"], ["event_type", "event_subtype"], ["event_type", "net_proto"], ["event_type", "event_subtype", "net_proto"], []]
    g = logs.groupingSets([[F.col(x) for x in s] for s in sets], "event_type", "event_subtype", "net_proto")
    return g.agg(F.count_if(S.missing("src_port")).alias("src_missing"), F.count_if(S.missing("net_sentbytes")).alias("bytes_missing"), F.count("*").alias("n"))


@query("ag8_protocol_ports", "logs", sql=f"SELECT net_proto, count(*) FILTER (WHERE {m('src_port')} AND {m('dst_port')}) AS both_missing, count(*) FILTER (WHERE {m('src_port')}) AS src_missing, count(*) FILTER (WHERE {m('dst_port')}) AS dst_missing, CASE WHEN count(*) FILTER (WHERE {m('src_port')} AND {m('dst_port')}) = count(*) THEN 'NEVER' WHEN count(*) FILTER (WHERE {m('src_port')} OR {m('dst_port')}) = 0 THEN 'ALWAYS' ELSE 'MIXED' END AS status FROM logs GROUP BY 1")
def ag8(logs):
    s, d = S.missing("src_port"), S.missing("dst_port")
    g = logs.groupBy("net_proto").agg(F.count_if(s & d).alias("both_missing"), F.count_if(s).alias("src_missing"), F.count_if(d).alias("dst_missing"), F.count_if(s | d).alias("either"), F.count("*").alias("n"))
    return g.withColumn("status", F.when(F.col("both_missing") == F.col("n"), "NEVER").when(F.col("either") == 0, "ALWAYS").otherwise("MIXED")).drop("either", "n")


@query("ag9_missing_patterns", "logs", sql=f"SELECT concat_ws(',', CASE WHEN {m('dst_port')} THEN 'dst_port' END, CASE WHEN {m('net_sentbytes')} THEN 'net_sentbytes' END, CASE WHEN {m('src_port')} THEN 'src_port' END) AS pattern, count(*) AS n FROM logs GROUP BY 1")
def ag9(logs):
    names = F.concat_ws(",", *[F.when(S.missing(x), x) for x in ("dst_port", "net_sentbytes", "src_port")])
    return logs.groupBy(names.alias("pattern")).agg(F.count("*").alias("n"))


@query("ag10_missing_time_context", "logs", sql=f"SELECT field, value, count(*) AS n FROM (SELECT 'event_action' AS field, event_action AS value FROM logs WHERE {m('itime')} UNION ALL SELECT 'net_proto', net_proto FROM logs WHERE {m('itime')}) GROUP BY ALL")
def ag10(logs):
    return frames.unpivot(logs.filter(S.missing("itime")), [], ["event_action", "net_proto"]).groupBy("field", "value").agg(F.count("*").alias("n"))


@query("ag11_ag12_ag25_population", "logs", sql=f"SELECT event_type, event_action, count(*) FILTER (WHERE NOT {m('threat_name')}) AS threat_filled, count(*) FILTER (WHERE {m('threat_name')}) AS threat_missing, count(*) FILTER (WHERE NOT {m('app_service')}) AS service_filled FROM logs GROUP BY ALL")
def ag11(logs):
    return logs.groupBy("event_type", "event_action").agg(F.count_if(S.filled("threat_name")).alias("threat_filled"), F.count_if(S.missing("threat_name")).alias("threat_missing"), F.count_if(S.filled("app_service")).alias("service_filled"))


@query("ag13_w5_services", "logs", sql="SELECT net_proto, app_service, cnt, rn FROM (SELECT *, row_number() OVER (PARTITION BY net_proto ORDER BY cnt DESC, app_service) AS rn FROM (SELECT net_proto, app_service, count(*) AS cnt FROM logs GROUP BY ALL)) WHERE rn <= 3")
def ag13(logs):
    g = logs.groupBy("net_proto", "app_service").agg(F.count("*").alias("cnt"))
    return frames.top_per_group(g, ["net_proto"], [F.desc("cnt"), "app_service"], 3).withColumn("rn", F.col("rn").cast("bigint"))


@query("ag14_service_alignment", "logs", sql=f"SELECT CASE WHEN NOT regexp_matches(app_service, '(?i)^\\s*(tcp|udp)/[0-9]+\\s*$') THEN 'NO_HINT' WHEN upper(split_part(app_service, '/', 1)) <> coalesce(CASE {i('net_proto')} WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END, '') THEN 'PROTOCOL_DIFFERS' WHEN {i('dst_port')} IS NULL THEN 'NO_PORT' WHEN CAST(split_part(app_service, '/', 2) AS BIGINT) = {i('dst_port')} THEN 'ALIGNED' ELSE 'PORT_DIFFERS' END AS outcome, count(*) AS n FROM logs GROUP BY 1")
def ag14(logs):
    proto, port = S.service_hint("app_service", 1), S.service_hint("app_service", 2).cast("bigint")
    actual, dst = F.lower(F.coalesce(S.protocol_name(S.integer("net_proto")), F.lit(""))), S.integer("dst_port")
    outcome = F.when(proto.isNull(), "NO_HINT").when(proto != actual, "PROTOCOL_DIFFERS").when(dst.isNull(), "NO_PORT").when(port == dst, "ALIGNED").otherwise("PORT_DIFFERS")
    return logs.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def sessions(logs):
    return logs.filter(S.filled("net_sessionid")).groupBy("net_sessionid").agg(F.count("*").alias("size"))


@query("ag15_session_sizes", "logs", sql="SELECT count(*) AS sessions, count(*) FILTER (WHERE size = 1) AS singles, min(size) AS low, max(size) AS high, CAST(median(size) AS DOUBLE) AS mid, CAST(quantile_disc(size, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(size, 0.95) AS BIGINT) AS p95 FROM (SELECT count(*) AS size FROM logs GROUP BY net_sessionid)")
def ag15(logs):
    return sessions(logs).agg(F.count("*").alias("sessions"), F.count_if(F.col("size") == 1).alias("singles"), F.min("size").alias("low"), F.max("size").alias("high"), F.median("size").cast("double").alias("mid"), F.expr("cast(percentile_disc(0.5) within group (order by size) as bigint)").alias("p50"), F.expr("cast(percentile_disc(0.95) within group (order by size) as bigint)").alias("p95"))


@query("ag16_sf7_session_buckets", "logs", sql="SELECT CASE WHEN size <= 1 THEN '1' WHEN size <= 2 THEN '2' WHEN size <= 5 THEN '3-5' WHEN size <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS sessions, CAST(sum(size) AS BIGINT) AS records FROM (SELECT count(*) AS size FROM logs GROUP BY net_sessionid) GROUP BY 1")
def ag16(logs):
    return sessions(logs).groupBy(S.bucket("size", S.SESSION_SIZES, "11+").alias("bucket")).agg(F.count("*").alias("sessions"), F.sum("size").alias("records"))


@query("ag17_lifecycle", "logs", sql="SELECT event_action, count(*) AS sessions, CAST(sum(c) AS BIGINT) AS records FROM (SELECT net_sessionid, event_action, count(*) AS c FROM logs GROUP BY ALL) GROUP BY 1")
def ag17(logs):
    return logs.groupBy("net_sessionid", "event_action").agg(F.count("*").alias("c")).groupBy("event_action").agg(F.count("*").alias("sessions"), F.sum("c").alias("records"))


@query("ag18_session_metrics", "logs", sql=f"SELECT CASE WHEN filled = 0 THEN 'ALL_MISSING' WHEN filled < n THEN 'MIXED' WHEN lo <> hi THEN 'VARYING' ELSE 'CONSTANT' END AS state, count(*) AS sessions FROM (SELECT count(*) AS n, count({i('net_sentbytes')}) AS filled, min({i('net_sentbytes')}) AS lo, max({i('net_sentbytes')}) AS hi FROM logs GROUP BY net_sessionid HAVING count(*) > 1) GROUP BY 1")
def ag18(logs):
    x = S.integer("net_sentbytes")
    g = logs.groupBy("net_sessionid").agg(F.count("*").alias("n"), F.count(x).alias("filled"), F.min(x).alias("lo"), F.max(x).alias("hi")).filter("n > 1")
    state = F.when(F.col("filled") == 0, "ALL_MISSING").when(F.col("filled") < F.col("n"), "MIXED").when(F.col("lo") != F.col("hi"), "VARYING").otherwise("CONSTANT")
    return g.groupBy(state.alias("state")).agg(F.count("*").alias("sessions"))


@query("ag19_ag24_combinations", "logs", sql=f"SELECT event_type, event_action, count(*) AS cnt FROM logs WHERE {m('net_sentbytes')} GROUP BY ALL ORDER BY cnt DESC, event_type, event_action LIMIT 5")
def ag19(logs):
    return frames.top_values(logs.filter(S.missing("net_sentbytes")), ["event_type", "event_action"], 5)


@query("ag24_rare_combinations", "logs", sql="SELECT event_type, event_action, net_proto, count(*) AS cnt FROM logs GROUP BY ALL ORDER BY cnt, event_type, event_action, net_proto LIMIT 5")
def ag24(logs):
    return frames.top_values(logs, ["event_type", "event_action", "net_proto"], 5, rare=True)


@query("ag20_time_stats", "logs", sql=f"SELECT count(t) AS valid, count(*) - count(t) AS failures, min(t) AS low, max(t) AS high, max(t) - min(t) AS span, count(DISTINCT t) AS distinct_times FROM (SELECT {i('itime')} AS t FROM logs)")
def ag20(logs):
    t = logs.select(S.integer("itime").alias("t"))
    return t.agg(F.count("t").alias("valid"), (F.count("*") - F.count("t")).alias("failures"), F.min("t").alias("low"), F.max("t").alias("high"), (F.max("t") - F.min("t")).alias("span"), F.countDistinct("t").alias("distinct_times"))


@query("ag21_time_difference", "logs", sql=f"SELECT min(d) AS low, max(d) AS high, min(d) = max(d) AS is_constant FROM (SELECT {i('itime')} - record_number AS d FROM logs)")
def ag21(logs):
    d = S.integer("itime") - F.col("record_number")
    return logs.agg(F.min(d).alias("low"), F.max(d).alias("high"), (F.min(d) == F.max(d)).alias("is_constant"))


@query("ag22_findings_by_rule", "logs", sql=f"SELECT rule_id, severity, count(*) AS n_findings, count(DISTINCT record_number) AS n_records FROM {RULES} GROUP BY ALL")
def ag22(logs):
    return detect.findings(normalize.normalize(logs)).groupBy("rule_id", "severity").agg(F.count("*").alias("n_findings"), F.countDistinct("record_number").alias("n_records"))


@query("ag22_w5_samples", "logs", sql=f"SELECT rule_id, record_number FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY record_number) AS rn FROM {RULES}) WHERE rn <= 5")
def ag22_samples(logs):
    return frames.top_per_group(detect.findings(normalize.normalize(logs)), ["rule_id"], ["record_number"], 5).select("rule_id", "record_number")


@query("ag23_frequency", "logs", sql="SELECT field, value, cnt FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY cnt DESC, value) AS rn FROM (SELECT field, value, count(*) AS cnt FROM (SELECT 'event_action' AS field, event_action AS value FROM logs UNION ALL SELECT 'event_type', event_type FROM logs) GROUP BY ALL)) WHERE rn <= 3")
def ag23(logs):
    g = frames.unpivot(logs, [], ["event_action", "event_type"]).groupBy("field", "value").agg(F.count("*").alias("cnt"))
    return frames.top_per_group(g, ["field"], [F.desc("cnt"), "value"], 3).drop("rn")


@query("ag26_threat_presence", "logs", sql=f"SELECT event_subtype, count(*) AS n, count(*) FILTER (WHERE NOT {m('threat_name')}) AS present FROM logs GROUP BY 1")
def ag26(logs):
    return logs.groupBy("event_subtype").agg(F.count("*").alias("n"), F.count_if(S.filled("threat_name")).alias("present"))


@query("ag27_occurrences", "logs", sql="SELECT c AS occurrences, count(*) AS ids FROM (SELECT count(*) AS c FROM logs GROUP BY net_sessionid) GROUP BY 1")
def ag27(logs):
    return sessions(logs).groupBy(F.col("size").alias("occurrences")).agg(F.count("*").alias("ids"))


@query("ag28_numeric_semantics", "logs", sql=f"SELECT count(*) FILTER (WHERE x = 0) AS zeros, count(*) FILTER (WHERE x <> 0) AS others, CAST(median(x) AS DOUBLE) AS mid, CAST(quantile_disc(x, 0.99) AS BIGINT) AS p99 FROM (SELECT {i('net_sentbytes')} AS x FROM logs) WHERE x IS NOT NULL")
def ag28(logs):
    x = logs.select(S.integer("net_sentbytes").alias("x")).filter("x is not null")
    counts = x.agg(F.count_if(F.col("x") == 0).alias("zeros"), F.count_if(F.col("x") != 0).alias("others"))
    return counts.crossJoin(F.broadcast(frames.median(x, "x", "mid"))).crossJoin(F.broadcast(frames.quantile_disc(x, "x", {"p99": 0.99})))


@query("ag64_issue_coverage", "logs", sql=f"SELECT field, code, count(*) AS n FROM ({ISSUES}) GROUP BY ALL")
def ag64(logs):
    return pf7(logs).groupBy("field", "code").agg(F.count("*").alias("n"))


@query("w4_adjacent", "logs", sql=f"SELECT CASE WHEN t > p THEN 'INCREASE' WHEN t = p THEN 'EQUAL' ELSE 'DECREASE' END AS direction, count(*) AS n FROM (SELECT {i('itime')} AS t, lag({i('itime')}) OVER (ORDER BY record_number) AS p FROM logs) WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY 1")
def w4(logs, block: int = 100_000):
    # Blocks of record numbers instead of one window over all; a block's first row meets the row before by a join.
    t = logs.select("record_number", S.integer("itime").alias("t"), F.expr(f"record_number div {block}").alias("b"))
    own = t.withColumn("p", F.lag("t").over(Window.partitionBy("b").orderBy("record_number"))).withColumn("first", F.row_number().over(Window.partitionBy("b").orderBy("record_number")) == 1)
    last = t.groupBy((F.col("b") + 1).alias("b")).agg(F.max_by("t", "record_number").alias("q"))
    both = own.join(last, "b", "left").withColumn("p", F.when(F.col("first"), F.col("q")).otherwise(F.col("p"))).filter("t is not null and p is not null")
    return both.groupBy(F.when(F.col("t") > F.col("p"), "INCREASE").when(F.col("t") == F.col("p"), "EQUAL").otherwise("DECREASE").alias("direction")).agg(F.count("*").alias("n"))


@query("j7_context_as_of", "logs", sql=f"SELECT record_number, coalesce(string_agg(CAST(other AS STRING), ',' ORDER BY rn), '') AS context FROM (SELECT a.record_number, b.record_number AS other, row_number() OVER (PARTITION BY a.record_number ORDER BY {i('b.itime')} DESC, b.record_number DESC) AS rn FROM logs a LEFT JOIN logs b ON a.net_sessionid = b.net_sessionid AND {i('b.itime')} < {i('a.itime')} WHERE {i('a.itime')} IS NOT NULL) WHERE rn <= 2 GROUP BY 1")
def j7(logs):
    # The two latest rows of earlier times: of rows of one time all share what came before the first of them, which is
    # at most two rows. So per (session, time) its last two rows, then two lags over times; no frame grows.
    x = logs.select("record_number", "net_sessionid", S.integer("itime").alias("t")).filter("t is not null")
    w = Window.partitionBy("net_sessionid").orderBy("t")
    times = x.groupBy("net_sessionid", "t").agg(F.max("record_number").alias("r1"), F.count("*").alias("n"))
    second = frames.top_per_group(x, ["net_sessionid", "t"], [F.desc("record_number")], 2).filter("rn = 2").select("net_sessionid", "t", F.col("record_number").alias("r2"))
    own = times.join(second, ["net_sessionid", "t"], "left").withColumn("own", F.array_compact(F.array("r1", "r2")))
    before = own.withColumn("before", F.slice(F.concat(F.coalesce(F.lag("own", 1).over(w), F.array().cast("array<bigint>")), F.coalesce(F.lag("own", 2).over(w), F.array().cast("array<bigint>"))), 1, 2))
    joined = x.join(before.select("net_sessionid", "t", "before"), ["net_sessionid", "t"])
    return joined.select("record_number", F.array_join(F.transform("before", lambda r: r.cast("string")), ",").alias("context"))


@query("sr4_group_sort", "logs", sql=f"SELECT dst_port, row_number() OVER (ORDER BY {i('dst_port')} IS NULL, {i('dst_port')}, dst_port) AS place FROM (SELECT DISTINCT dst_port FROM logs)")
def sr4(logs):
    d = logs.select("dst_port").distinct()
    ranked = frames.global_rank(d.withColumn("none", S.integer("dst_port").isNull()).withColumn("x", S.integer("dst_port")), ["none", "x", "dst_port"], "place")
    return ranked.select("dst_port", F.col("place").cast("bigint").alias("place"))


@query("sf12_row_signature", "logs", sql="SELECT record_number, sha256(concat(length(loguid), ':', loguid, length(event_type), ':', event_type)) AS signature FROM logs")
def sf12(logs):
    return logs.select("record_number", F.sha2(S.length_prefixed("loguid", "event_type"), 256).alias("signature"))


@query("sf16_g6_partition", "logs", sql="SELECT CASE WHEN (('0x' || substr(sha256(concat('session', net_sessionid)), 1, 16))::UBIGINT % 10) < 8 THEN 'REFERENCE' ELSE 'HOLDOUT' END AS partition_name, count(*) AS n, count(DISTINCT net_sessionid) AS sessions FROM logs GROUP BY 1")
def sf16(logs):
    p = F.when(S.hash_bucket(F.concat(F.lit("session"), "net_sessionid"), 10) < 8, "REFERENCE").otherwise("HOLDOUT")
    return logs.groupBy(p.alias("partition_name")).agg(F.count("*").alias("n"), F.countDistinct("net_sessionid").alias("sessions"))


@query("au2_record_numbers", "logs", sql="SELECT min(record_number) = 1 AND max(record_number) = count(*) AND count(DISTINCT record_number) = count(*) AS contiguous FROM logs")
def au2(logs):
    n = F.count("*")
    return logs.agg(((F.min("record_number") == 1) & (F.max("record_number") == n) & (F.countDistinct("record_number") == n)).alias("contiguous"))


@query("au3_j9_findings_recomputed", "logs", sql=f"SELECT record_number, 'HIGH' AS expected, 'LOW' AS actual, 'DIFFERENT' AS status FROM {RULES} WHERE rule_id = 'RULE_SOURCE_THREAT' AND record_number % 7 = 0")
def au3(logs):
    f = detect.findings(normalize.normalize(logs))
    changed = f.withColumn("severity", F.when((F.col("rule_id") == "RULE_SOURCE_THREAT") & (F.col("record_number") % 7 == 0), "LOW").otherwise(F.col("severity")))
    return frames.full_compare(f, changed, ["record_number", "rule_id"], "severity").drop("rule_id")


@query("au15_session_partition", "logs", sql="SELECT 'session' AS fault, net_sessionid AS key FROM (SELECT *, CASE WHEN record_number % 29 = 0 THEN 'HOLDOUT' WHEN (('0x' || substr(sha256(concat('session', net_sessionid)), 1, 16))::UBIGINT % 10) < 8 THEN 'REFERENCE' ELSE 'HOLDOUT' END AS part FROM logs) GROUP BY 2 HAVING count(DISTINCT part) > 1 UNION ALL SELECT 'record', CAST(record_number - record_number % 31 % 2 AS STRING) FROM logs GROUP BY record_number - record_number % 31 % 2 HAVING count(*) > 1")
def au15(logs):
    """Sessions in two partitions and repeated record numbers, in rows with planted faults of both kinds."""
    part = F.when((F.col("record_number") % 29 == 0) | (S.hash_bucket(F.concat(F.lit("session"), "net_sessionid"), 10) >= 8), "HOLDOUT").otherwise("REFERENCE")
    x = logs.select("net_sessionid", part.alias("part"), (F.col("record_number") - F.col("record_number") % 31 % 2).alias("number"))
    apart = x.groupBy(F.col("net_sessionid").alias("key")).agg(F.countDistinct("part").alias("c")).filter("c > 1").select(F.lit("session").alias("fault"), "key")
    twice = x.groupBy("number").agg(F.count("*").alias("c")).filter("c > 1").select(F.lit("record").alias("fault"), F.col("number").cast("string").alias("key"))
    return apart.unionByName(twice)


@query("sc11_csv_cells", "logs", sql="SELECT record_number, CASE WHEN regexp_matches(event_action, '^[=+\\-@]') THEN concat('''', event_action) ELSE event_action END AS action, CASE WHEN record_number % 3 = 0 THEN concat('''=', loguid) ELSE loguid END AS cell FROM logs")
def sc11(logs):
    cell = F.when(F.col("record_number") % 3 == 0, F.concat(F.lit("="), "loguid")).otherwise(F.col("loguid"))
    return logs.select("record_number", S.formula_safe("event_action").alias("action"), S.formula_safe(cell).alias("cell"))
