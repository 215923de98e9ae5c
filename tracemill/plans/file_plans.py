"""Queries through files, models and streams: CSV and JSON lines, sinks, isolation forest, clusters, classifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contexts, detect, features, forest, frames, learn, nested, normalize, signals, splits
from ..registry import ORACLES, QUERIES, query
from ..sources import files
from ..sources.shared import shared_dir, stored
from ..sources.views import oracle
from ..streaming import findings as streams
from .flow_plans import is_ref
from .label_plans import CONTEXT_SQL
from .log_plans import RULES

COLS = ["record_number", "event_type", "event_subtype", "net_proto", "app_service"]
SHORT, LONG = "record_number % 101 = 0", "record_number % 103 = 0"


def lines(logs):
    """Record files with some short and some long lines, as a source may send them."""
    path = shared_dir(logs.sparkSession)
    every = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLS])
    short = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLS[:-1]])
    logs.select(F.when(F.expr(SHORT), short).when(F.expr(LONG), F.concat(every, F.lit(",more"))).otherwise(every).alias("value")).write.text(path)
    return path


@query("sc1_sc3_csv_scan", "logs", sql=f"SELECT count(*) AS n, count(*) FILTER (WHERE {SHORT} OR {LONG}) AS malformed, count(DISTINCT record_number) FILTER (WHERE NOT ({SHORT} OR {LONG})) AS records FROM logs")
def sc1(logs):
    r = files.read_csv(logs.sparkSession, lines(logs), COLS, header=False)
    good = F.col(files.BAD).isNull()
    return r.agg(F.count("*").alias("n"), F.count_if(~good).alias("malformed"), F.countDistinct(F.when(good, F.col("record_number"))).alias("records"))


@query("sc2_header_faults", "logs", sql="SELECT 'ABSENT' AS fault, 'loguid' AS name, count(*) AS n FROM logs")
def sc2(logs):
    path = shared_dir(logs.sparkSession)
    files.write_csv(logs.select(*COLS), path)
    faults = files.header_faults(logs.sparkSession, path, [*COLS, "loguid"])
    n = files.read_csv(logs.sparkSession, path, COLS).agg(F.count("*").alias("n"))
    return logs.sparkSession.createDataFrame(faults, "fault string, name string").crossJoin(n)


@query("sc2_planted_header", "logs", sql="WITH a AS (SELECT DISTINCT event_action AS name FROM logs), t AS (SELECT DISTINCT event_type AS name FROM logs) SELECT 'ABSENT' AS fault, name FROM t WHERE name NOT IN (SELECT name FROM a) UNION ALL SELECT 'REPEATED', min(name) FROM a UNION ALL SELECT 'BLANK', CAST(count(*) + 1 AS STRING) FROM a")
def sc2_planted(logs):
    """Faults of a header that the data give: every action is a column, the first one twice, one name is blank, and the
    event types are wanted as well."""
    spark, path = logs.sparkSession, shared_dir(logs.sparkSession)
    names, types = (sorted(r[0] for r in logs.select(c).distinct().collect()) for c in ("event_action", "event_type"))  # a few values each
    spark.createDataFrame([(",".join([*names, names[0], " "]),)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame(files.header_faults(spark, path, [*names, *types]), "fault string, name string")


@query("sc9_csv_to_events", "logs", sql="SELECT record_number, CASE WHEN trim(event_type) <> '' THEN event_type END AS event_type, try_cast(net_proto AS BIGINT) AS protocol FROM logs")
def sc9(logs):
    path = shared_dir(logs.sparkSession)
    files.write_csv(logs, path, safe=False)
    back = files.read_csv(logs.sparkSession, path, logs.columns).withColumn("record_number", F.col("record_number").cast("bigint"))
    return normalize.normalize(back).select("record_number", F.col("event.type").alias("event_type"), "network.protocol")


@query("sc4_sc5_sc6_json_events", "logs", sql="SELECT record_number, CASE WHEN trim(event_type) <> '' THEN event_type END AS event_type, try_cast(net_proto AS BIGINT) AS protocol, CAST(0 AS BIGINT) AS foreign_lines FROM logs")
def sc4(logs):
    spark, path = logs.sparkSession, shared_dir(logs.sparkSession)
    e = normalize.normalize(logs)
    files.write_json_lines(e, path)
    foreign = files.foreign_keys(spark, path, e.columns).agg(F.count("*").alias("foreign_lines"))
    back = files.read_json_lines(spark, path, e.schema)
    return back.crossJoin(F.broadcast(foreign)).select("record_number", F.col("event.type").alias("event_type"), "network.protocol", "foreign_lines")


@query("sc4_record_order", "logs", sql="WITH s AS (SELECT record_number, CASE WHEN record_number % 500 = 0 THEN record_number + 2 WHEN record_number % 700 = 0 THEN NULL ELSE record_number END AS value FROM logs) SELECT value, previous FROM (SELECT value, lag(value) OVER (ORDER BY record_number) AS previous FROM s) WHERE value IS NULL OR value <= previous")
def sc4_order(logs):
    """Records of JSON-lines files whose number does not rise in the order of the lines; some numbers are planted too high or left out."""
    path, n = shared_dir(logs.sparkSession), F.col("record_number")
    value = F.when(n % 500 == 0, n + 2).when(n % 700 != 0, n)
    ordered = logs.select("record_number", value.alias("value"), "event_type").repartitionByRange(4, "record_number").sortWithinPartitions("record_number")
    ordered.select(F.to_json(F.struct("value", "event_type")).alias("text")).write.text(path)
    return files.order_faults(logs.sparkSession, path, ("value", "bigint")).select("value", "previous")


@query("au18_finding_order", "logs", sql=f"WITH s AS (SELECT record_number, rule_id, t FROM {RULES}, (VALUES (1), (2)) v(t) WHERE t = 1 OR record_number % 40 = 0), o AS (SELECT *, CASE WHEN record_number % 90 = 0 THEN record_number + 100000000 ELSE record_number END AS shown FROM s), p AS (SELECT shown, rule_id, lag(shown) OVER w AS ps, lag(rule_id) OVER w AS pr FROM o WINDOW w AS (ORDER BY record_number, rule_id, t)) SELECT shown AS record_number, rule_id, ps AS previous_record, pr AS previous_rule FROM p WHERE shown < ps OR (shown = ps AND rule_id <= pr)")
def au18(logs):
    """Findings of a file that are out of order or repeated, by record and rule; some are written twice, some with a number too high."""
    path, n = shared_dir(logs.sparkSession), F.col("record_number")
    found = detect.findings(normalize.normalize(logs)).select("record_number", "rule_id")
    ordered = found.withColumn("t", F.explode(F.expr("sequence(1, if(record_number % 40 = 0, 2, 1))"))).repartitionByRange(3, "record_number", "rule_id", "t").sortWithinPartitions("record_number", "rule_id", "t")
    shown = F.when(n % 90 == 0, n + 100_000_000).otherwise(n)
    ordered.select(F.to_json(F.struct(shown.alias("record_number"), "rule_id")).alias("text")).write.text(path)
    f = files.order_faults(logs.sparkSession, path, ("record_number", "bigint"), ("rule_id", "string"))
    return f.select("value.record_number", "value.rule_id", F.col("previous.record_number").alias("previous_record"), F.col("previous.rule_id").alias("previous_rule"))


SUMMARY = f"(SELECT 'TOTAL' AS section, '' AS key, count(*) AS value FROM {RULES} UNION ALL SELECT 'RULE', rule_id, count(*) FROM {RULES} GROUP BY ALL UNION ALL SELECT 'SEVERITY', concat(rule_id, ':', severity), count(*) FROM {RULES} GROUP BY ALL UNION ALL SELECT 'MATCHED', '', count(DISTINCT record_number) FROM {RULES} UNION ALL SELECT 'SAMPLE', concat(rule_id, ':', rn), record_number FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY record_number) AS rn FROM {RULES}) WHERE rn <= 5)"
STATED = f"(SELECT section, key, CASE WHEN section = 'RULE' THEN value + 1 WHEN key LIKE '%:3' THEN value * 2 ELSE value END AS value FROM {SUMMARY} WHERE NOT (section = 'SEVERITY' AND key LIKE '%HIGH') UNION ALL SELECT 'RULE', 'RULE_UNKNOWN', 1)"


@query("au4_run_summary", "logs", sql=f"SELECT section, key, e.value AS expected, a.value AS actual, CASE WHEN e.value IS NULL THEN 'UNEXPECTED' WHEN a.value IS NULL THEN 'ABSENT' ELSE 'DIFFERENT' END AS status FROM {SUMMARY} e FULL JOIN {STATED} a USING (section, key) WHERE e.value IS DISTINCT FROM a.value")
def au4(logs):
    """A run's stated summary against the one that its findings give: totals, rules, severities, matched records and samples."""
    real = stored(detect.run_summary(detect.findings(normalize.normalize(logs))))
    value = F.when(F.col("section") == "RULE", F.col("value") + 1).when(F.col("key").like("%:3"), F.col("value") * 2).otherwise(F.col("value"))
    stated = real.filter("not (section = 'SEVERITY' and key like '%HIGH')").select("section", "key", value.alias("value"))
    return frames.full_compare(real, stated.unionByName(logs.sparkSession.createDataFrame([("RULE", "RULE_UNKNOWN", 1)], "section string, key string, value long")), ["section", "key"], "value")


@query("sf18_sf33_digests", "flows", sql="SELECT record_number, sha256(concat('[\"order\",7,', record_number, ']')) AS digest, CAST(('0x' || substr(sha256(concat('[\"order\",7,', record_number, ']')), 1, 16))::UBIGINT AS DECIMAL(20, 0)) AS bucket, concat('R-', sha256(concat('[\"review\",\"', sha256('flows'), '\",', record_number, ']'))) AS review_id FROM flows")
def sf18(flows):
    """Digest and 64-bit bucket of a namespace, a seed and a number, and the pseudonymous review id of the record."""
    digest, bucket = S.digest_order("order", 7, "record_number")
    return flows.select("record_number", digest.alias("digest"), bucket.alias("bucket"), S.review_id(hashlib.sha256(b"flows").hexdigest(), "record_number").alias("review_id"))


@query("sc12_sf13_canonical_lines", "flows", sql="SELECT concat('{\"flow\":{\"bytes\":{\"received\":', received_bytes, ',\"sent\":', coalesce(CAST(sent_bytes AS STRING), 'null'), '},\"ports\":[', coalesce(CAST(source_port AS STRING), 'null'), ',', coalesce(CAST(destination_port AS STRING), 'null'), ']},\"record_number\":', record_number, ',\"score\":', raw_score, ',\"tags\":{\"a\\\"b\":', coalesce('\"' || service || '\"', 'null'), ',\"session\":\"', session_id, '\"}}') AS line FROM flows")
def sc12_canonical(flows):
    """Nested rows as canonical JSON lines: structs, arrays and maps by name of key."""
    path = shared_dir(flows.sparkSession)
    flow = F.struct(F.array("source_port", "destination_port").alias("ports"), F.struct(F.col("sent_bytes").alias("sent"), F.col("received_bytes").alias("received")).alias("bytes"))
    files.write_canonical_lines(flows.select(F.create_map(F.lit("session"), "session_id", F.lit('a"b'), "service").alias("tags"), "record_number", flow.alias("flow"), F.col("raw_score").cast("double").alias("score")), path)
    return flows.sparkSession.read.text(path).withColumnRenamed("value", "line")


@query("sc10_au4_findings_sink", "logs", sql="SELECT rule_id, count(*) AS n FROM (SELECT 'RULE_ANOMALY_SUBTYPE' AS rule_id FROM logs WHERE event_subtype = 'anomaly' UNION ALL SELECT 'RULE_SOURCE_THREAT' FROM logs WHERE trim(threat_name) <> '') GROUP BY 1")
def sc10(logs):
    path = shared_dir(logs.sparkSession)
    detect.findings(normalize.normalize(logs)).write.mode("errorifexists").partitionBy("rule_id").parquet(path)
    return logs.sparkSession.read.parquet(path).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("sc12_sf13_json_lines", "flows", sql="SELECT concat('{\"protocol_number\":', protocol_number, ',\"record_number\":', record_number, ',\"service\":', coalesce('\"' || service || '\"', 'null'), '}') AS line FROM flows")
def sc12(flows):
    path = shared_dir(flows.sparkSession)
    files.write_json_lines(flows.select("service", "record_number", "protocol_number"), path)
    return flows.sparkSession.read.text(path).withColumnRenamed("value", "line")


@query("sc8_sc13_review_queue", "reviewed", sql="SELECT CAST(row_key AS STRING) AS row_key, review_id, membership FROM reviewed WHERE review_id IS NOT NULL")
def sc13(x):
    path = shared_dir(x.sparkSession)
    files.write_csv(x.filter("review_id is not null").select("row_key", "review_id", "membership"), path)
    return files.read_csv(x.sparkSession, path, ["row_key", "review_id", "membership"]).drop(files.BAD)


@query("sc7_row_keys", "flows", sql="SELECT concat('set:TRAIN:', CAST(record_number AS STRING)) AS row_key, 'TRAIN' AS official_split FROM flows")
def sc7(flows):
    return flows.select(F.concat(F.lit("set:TRAIN:"), F.col("record_number").cast("string")).alias("row_key"), F.lit("TRAIN").alias("official_split"))


def model_rows(flows):
    f = features.traffic_features()
    names = ["log_sent_bytes", "log_received_bytes", "log_sent_packets", "log_received_packets", "sent_byte_share", "src_port_registered"]
    return flows.select("record_number", "session_id", (F.col("protocol_number") == 6).cast("int").alias("label"), *[f[n].alias(n) for n in names]), names


@query("ml3_ml4_isolation_forest", "flows")
def ml3(flows):
    """record_number, percentile, band: forest on reference rows, then the percentile among them."""
    rows, names = model_rows(flows)
    rows = stored(rows)  # read several times: flows are grouped once
    scored = stored(forest.score(rows, "record_number", names, forest.fit(rows, is_ref(), "record_number", names)))
    s = scored.join(rows.select("record_number", is_ref().alias("ref")), "record_number")
    return frames.reference_percentile(s, "raw_score", F.col("ref")).select("record_number", F.round("percentile", 6).alias("percentile"), S.anomaly_band("percentile").alias("band"))


@query("ml5_seed_sensitivity", "flows")
def ml5(flows):
    """How much the first 50 and the first 100 of two forests, grown from other seeds, have in common."""
    rows, names = model_rows(flows)
    rows = stored(rows)  # read several times: flows are grouped once
    tops = None
    for seed in (7, 8):
        model = forest.fit(rows, is_ref(), "record_number", names, seed=seed)
        best = (F.desc("raw_score"), "record_number")
        first = stored(forest.score(rows, "record_number", names, model).orderBy(*best).limit(100))
        for top in (50, 100):
            part = first.orderBy(*best).limit(top).select(F.lit(top).alias("top"), "record_number")
            tops = part if tops is None else tops.unionByName(part)
    return tops.groupBy("top", "record_number").agg(F.count("*").alias("c")).groupBy("top").agg((F.count_if(F.col("c") == 2) / F.count("*")).alias("jaccard"))


@query("ml6_ml24_cluster_scores", "flows")
def ml6(flows):
    """record_number, distance to the nearest of the centres fitted on reference rows, and its largest residuals."""
    rows, names = model_rows(flows)
    rows = stored(rows)  # read several times: flows are grouped once
    centres = learn.fit_centres(rows.filter(is_ref()), names)
    return features.nearest_centroid(rows.select("record_number", F.array(*names).alias("embedding")), centres).select("record_number", "nearest", F.round("distance", 6).alias("distance"), "top_dims")


@query("ml9_ml11_logistic", "flows")
def ml9(flows):
    rows, names = model_rows(flows)
    p = learn.probability(learn.logistic(rows.filter(is_ref()), names, "label"), rows.filter(~is_ref()), names, ["record_number", "label"])
    return p.select("record_number", "label", F.round("p_attack", 6).alias("p_attack"))


@query("ml10_ml23_random_forest", "flows")
def ml10(flows):
    rows, names = model_rows(flows)
    rows = stored(rows)
    model = learn.random_forest(rows.filter(is_ref()), names, "label", "record_number")
    return learn.probability(model, rows.filter(~is_ref()), names, ["record_number", "label"])


CHAIN_NUMBERS, CHAIN_CATEGORIES = ["sent_bytes", "received_bytes", "sent_packets", "received_packets", "duration"], ["service"]


def fold_rows(flows):
    """Flows with a label and their roles: reference sessions fit and score in nested folds, the others are scored at the end."""
    roles = F.when(is_ref(), splits.context_roles("session_id")).otherwise(F.create_map(F.lit("FINAL"), F.lit("SCORE")))
    return stored(flows.select("record_number", "session_id", (F.col("protocol_number") == 6).cast("int").alias("label"), *CHAIN_NUMBERS, *CHAIN_CATEGORIES, roles.alias("roles")))


def fold_table(rows):
    return contexts.context_table(rows, "session_id", ["record_number", "label"], CHAIN_NUMBERS, CHAIN_CATEGORIES)


@query("ml12_ml13_nested_choice", "flows")
def ml12(flows):
    """S1 of two strengths and S2 over nested folds of whole sessions, each context with a state of its own: every ap, and
    what is chosen."""
    return nested.nested_choice(fold_table(fold_rows(flows)), "record_number").withColumn("ap", F.round("ap", 6))


@query("ml16_ml18_chained_scores", "flows")
def ml16(flows):
    """S1 and S2 without and with two out-of-fold signals (isolation forest, distance to centres), for every outer context in
    either direction and for the final one: model, kind, context_id, ap."""
    table = fold_table(fold_rows(flows))
    made = signals.chain_table(table, signals.out_of_fold(table, "record_number"), "record_number", ["record_number", "label"])
    return nested.chained(made, "record_number").withColumn("ap", F.round("ap", 6))


def planted(flows):
    """Signals of all contexts with faults: some rows absent, some twice, and some from a context that has seen their session."""
    # Hashes are taken once and kept; the roles follow from them wherever they are used.
    rows = stored(flows.select("record_number", "session_id", splits.context_folds("session_id").alias("folds"))).select("record_number", "session_id", splits.kept_roles("folds").alias("roles"))
    long = rows.select("record_number", F.explode_outer("roles").alias("context_id", "role"))
    times = F.expr("CASE WHEN role = 'FIT' THEN int(record_number % 53 = 0) WHEN record_number % 37 = 0 THEN 0 WHEN record_number % 41 = 0 THEN 2 ELSE 1 END")
    return rows, long.select("record_number", "context_id", F.explode(F.array_repeat(F.lit(1), times))).drop("col")


@query("au13_ml16_signal_audit", "flows", sql=f"WITH r AS ({' UNION ALL '.join(c.replace(', session_id FROM', ', record_number FROM') for c in CONTEXT_SQL)}), s AS (SELECT context_id, count(*) FILTER (WHERE role = 'SCORE') AS expected, count(*) FILTER (WHERE role = 'SCORE' AND record_number % 37 <> 0 AND record_number % 41 = 0) AS repeated, count(*) FILTER (WHERE role = 'SCORE' AND record_number % 37 = 0) AS absent, count(*) FILTER (WHERE role = 'FIT' AND record_number % 53 = 0) AS unexpected, count(*) FILTER (WHERE role = 'FIT' AND record_number % 53 = 0) AS leaked FROM r GROUP BY 1) SELECT * FROM s WHERE expected + unexpected > 0")
def au13_signals(flows):
    """Coverage and leaks of out-of-fold signals with planted faults, by context."""
    return signals.audit(*planted(flows), "record_number", "session_id")


def st1(spark, sf_dir):
    """Findings of the event table taken as a stream equal those of the table."""
    path = streams.run_available(streams.findings_stream(streams.stream_of(spark, sf_dir, "events")))
    return spark.read.parquet(path).select("record_number", "rule_id", "severity")


QUERIES["st1_findings_stream"] = st1
ORACLES["st1_findings_stream"] = oracle("SELECT record_number, 'RULE_ANOMALY_SUBTYPE' AS rule_id, 'MEDIUM' AS severity FROM logs WHERE event_subtype = 'anomaly' UNION ALL SELECT record_number, 'RULE_SOURCE_THREAT', 'HIGH' FROM logs WHERE trim(threat_name) <> ''")
