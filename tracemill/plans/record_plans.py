"""Queries over full records: the 58-field mapping, and how it treats what is absent or wrong."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import detect, frames, mapping, normalize, observe
from ..registry import query
from .log_plans import RULES
from .sqltext import i, m

METRIC_FIELDS = ("net_rcvdpkts", "net_recvbytes", "net_sentbytes", "net_sentpkts", "net_sessionduration")


def path_sql() -> dict[str, str]:
    """SQL of every path of an event."""
    special = {
        "time.itime_utc_derived": f"CASE WHEN {i('itime')} BETWEEN -62135596800 AND 253402300799 THEN strftime(make_timestamp({i('itime')} * 1000000), '%Y-%m-%dT%H:%M:%SZ') END",
        "network.protocol_number": i("net_proto"), "network.protocol_name": f"CASE {i('net_proto')} WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END",
        "network.source.port": f"CASE WHEN {i('src_port')} BETWEEN 0 AND 65535 THEN {i('src_port')} END", "network.destination.port": f"CASE WHEN {i('dst_port')} BETWEEN 0 AND 65535 THEN {i('dst_port')} END",
    }
    out = {}
    for field, paths in mapping.FIELDS:
        for p in paths.split():
            out[p] = special.get(p) or (f"CASE WHEN {i(field)} >= 0 THEN {i(field)} END" if field in METRIC_FIELDS else f"CASE WHEN NOT {m(field)} THEN {field} END")
    return out


PATHS = path_sql()


@query("pf1_full_record", "records", sql="SELECT record_number, " + ", ".join(f"{e} AS {p.replace('.', '__')}" for p, e in PATHS.items()) + " FROM records")
def pf1_full(records):
    """Every path of the nested event as a column."""
    e = mapping.normalize_records(records)
    return e.select("record_number", *[F.col(p).alias(p.replace(".", "__")) for p in PATHS])


@query("pf8_full_provenance", "records", sql=" UNION ALL ".join(f"SELECT '{p}' AS path, count(*) AS n FROM records WHERE ({e}) IS NOT NULL" for p, e in PATHS.items()))
def pf8_full(records):
    p = mapping.normalize_records(records).select(F.explode("provenance").alias("p"))
    return p.groupBy("p.path").agg(F.count("*").alias("n"))


@query("pf9_unmapped", "records", sql="SELECT record_number, CAST(6 AS BIGINT) AS unmapped, concat_ws('|', adom_oid, data_timestamp, epid, euid, event_profile, extra_cell) AS cells, CAST(59 AS BIGINT) AS raw_fields FROM records")
def pf9(records):
    """Fields that the mapping leaves or does not know, as they stand."""
    e = mapping.normalize_records(records)
    cells = [F.col("unmapped_fields")[c] for c in ("adom_oid", "data_timestamp", "epid", "euid", "event_profile", "extra_cell")]
    return e.select("record_number", F.size("unmapped_fields").cast("bigint").alias("unmapped"), F.concat_ws("|", *cells).alias("cells"), F.size("source_record").cast("bigint").alias("raw_fields"))


NO_METRIC = " AND ".join(m(f) for f in METRIC_FIELDS)
ICMP_PORTS = f"coalesce({i('net_proto')} = 1, false) AND {m('src_port')} AND {m('dst_port')}"
ISSUE_SQL = {
    ("itime", "MISSING_ITIME"): m("itime"), ("itime", "INVALID_ITIME_INTEGER"): f"NOT {m('itime')} AND {i('itime')} IS NULL", ("itime", "ITIME_UTC_DERIVATION_UNAVAILABLE"): f"{i('itime')} > 253402300799",
    ("net_proto", "MISSING_PROTOCOL"): m("net_proto"), ("net_proto", "INVALID_PROTOCOL_INTEGER"): f"NOT {m('net_proto')} AND {i('net_proto')} IS NULL", ("net_proto", "UNKNOWN_PROTOCOL_NUMBER"): f"{i('net_proto')} NOT IN (1, 6, 17)",
    ("", "MISSING_PORTS_EXPECTED_FOR_ICMP"): ICMP_PORTS, ("", "ALL_SESSION_METRICS_MISSING"): NO_METRIC,
    **{(f, "INVALID_PORT"): f"NOT {m(f)} AND coalesce({i(f)}, -1) NOT BETWEEN 0 AND 65535" for f in ("src_port", "dst_port")},
    **{(f, "MISSING_CONTEXTUAL_PORT"): f"{m(f)} AND NOT ({ICMP_PORTS})" for f in ("src_port", "dst_port")},
    **{(f, "INVALID_NONNEGATIVE_INTEGER"): f"NOT {m(f)} AND coalesce({i(f)}, -1) < 0" for f in METRIC_FIELDS},
    **{(f, "MISSING_CONTEXTUAL_SESSION_METRIC"): f"{m(f)} AND NOT ({NO_METRIC})" for f in METRIC_FIELDS},
}


@query("pf5_pf7_full_issues", "records", sql=" UNION ALL ".join(f"SELECT record_number, '{f}' AS field, '{c}' AS code FROM records WHERE {e}" for (f, c), e in ISSUE_SQL.items()))
def pf7_full(records):
    e = mapping.normalize_records(records).select("record_number", F.explode("issues").alias("x"))
    return e.select("record_number", F.coalesce("x.field", F.lit("")).alias("field"), "x.code")


@query("w11_record_order", "logs", sql="SELECT 'not_after' AS fault, number AS key FROM (SELECT number, lag(number) OVER (ORDER BY record_number) AS p FROM (SELECT record_number, CASE WHEN record_number % 23 = 0 THEN record_number - 2 ELSE record_number END AS number FROM logs)) WHERE number <= p UNION ALL SELECT 'repeated', number FROM (SELECT CASE WHEN record_number % 23 = 0 THEN record_number - 2 ELSE record_number END AS number FROM logs) GROUP BY 2 HAVING count(*) > 1")
def w11(logs, block: int = 100_000):
    """Numbers that do not rise from one record to the next, and repeated ones, in rows with planted faults."""
    n = F.col("record_number")
    x = logs.select("record_number", F.when(n % 23 == 0, n - 2).otherwise(n).alias("number"), F.expr(f"record_number div {block}").alias("b"))
    # Blocks of records instead of one window over all; a block's first record meets the last one before by a join.
    w = Window.partitionBy("b").orderBy("record_number")
    own = x.withColumn("p", F.lag("number").over(w)).withColumn("first", F.row_number().over(w) == 1)
    last = x.groupBy((F.col("b") + 1).alias("b")).agg(F.max_by("number", "record_number").alias("q"))
    before = F.when(F.col("first"), F.col("q")).otherwise(F.col("p"))
    fallen = own.join(last, "b", "left").filter(F.col("number") <= before).select(F.lit("not_after").alias("fault"), F.col("number").alias("key"))
    twice = x.groupBy("number").agg(F.count("*").alias("c")).filter("c > 1").select(F.lit("repeated").alias("fault"), F.col("number").alias("key"))
    return fallen.unionByName(twice)


@query("pf20_finding_evidence", "logs", sql=f"SELECT record_number, ordinal, path, value FROM (SELECT f.record_number, unnest([{{'ordinal': 1, 'path': 'threat.name', 'value': l.threat_name}}, {{'ordinal': 2, 'path': 'event.subtype', 'value': l.event_subtype}}, {{'ordinal': 3, 'path': 'network.protocol', 'value': l.net_proto}}], recursive := true) FROM {RULES} f JOIN logs l USING (record_number) WHERE rule_id = 'RULE_SOURCE_THREAT' AND f.record_number = (SELECT min(record_number) FROM {RULES} WHERE rule_id = 'RULE_SOURCE_THREAT')) WHERE ordinal <= 2")
def pf20(logs):
    """The first evidence rows of one finding, in their order; the finding is named by its id."""
    f = detect.findings(normalize.normalize(logs)).filter("rule_id = 'RULE_SOURCE_THREAT'")
    one = f.agg(F.min_by("finding_id", "record_number").alias("finding_id"))
    return detect.evidence_of(f, one, 2)


@query("sf10_review_times", "reviewed", sql="SELECT row_key, written, CASE WHEN regexp_matches(written, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN epoch(CAST(written AS TIMESTAMPTZ)) END AS seconds FROM (SELECT row_key, concat('2024-03-', lpad(CAST(1 + row_key % 28 AS STRING), 2, '0'), 'T10:20:30', CASE row_key % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '-05:30' ELSE '' END) AS written FROM reviewed)")
def sf10(x):
    day = F.lpad((1 + F.col("row_key") % 28).cast("string"), 2, "0")
    offset = F.when(F.col("row_key") % 4 == 0, "Z").when(F.col("row_key") % 4 == 1, "+02:00").when(F.col("row_key") % 4 == 2, "-05:30").otherwise("")
    y = x.select("row_key", F.concat(F.lit("2024-03-"), day, F.lit("T10:20:30"), offset).alias("written"))
    return y.withColumn("seconds", F.unix_timestamp(S.offset_time("written")).cast("double"))


@query("sf35_sorted_unique", "reviewed", sql="SELECT row_key, list_sort(list_distinct([CAST(row_key % 5 AS STRING), coalesce(blind_label, 'NONE'), CAST(row_key % 3 AS STRING)])) = [CAST(row_key % 5 AS STRING), coalesce(blind_label, 'NONE'), CAST(row_key % 3 AS STRING)] AS clean, array_to_string(list_sort(list_distinct([CAST(row_key % 5 AS STRING), coalesce(blind_label, 'NONE'), CAST(row_key % 3 AS STRING)])), ',') AS items FROM reviewed")
def sf35(x):
    items = F.array((F.col("row_key") % 5).cast("string"), F.coalesce("blind_label", F.lit("NONE")), (F.col("row_key") % 3).cast("string"))
    return x.select("row_key", (S.sorted_unique(items) == items).alias("clean"), F.array_join(S.sorted_unique(items), ",").alias("items"))


def observed_sql() -> str:
    """SQL of an observation: its columns, part and violations."""
    proto, session = PATHS["network.protocol_number"], PATHS["session.identifier"]
    invalid = [f"CASE WHEN NOT {m('net_proto')} AND {i('net_proto')} IS NULL THEN 'INVALID:net_proto' END"]
    invalid += [f"CASE WHEN NOT {m(f)} AND NOT coalesce({i(f)} BETWEEN 0 AND 65535, false) THEN 'INVALID:{f}' END" for f in ("src_port", "dst_port")]
    invalid += [f"CASE WHEN NOT {m(f)} AND NOT coalesce({i(f)} >= 0, false) THEN 'INVALID:{f}' END" for f in observe.CHECKED[3:]]
    shape = [f"CASE WHEN {m('loguid')} THEN 'record_id' END", f"CASE WHEN {proto} IS NULL OR NOT {proto} BETWEEN 0 AND 255 THEN 'protocol_number' END"]
    digest = f"sha256(CASE WHEN ({session}) IS NULL THEN concat('[\"split\",\"record\",', record_number, ']') ELSE concat('[\"split\",\"session\",\"', {session}, '\"]') END)"
    part = f"CASE WHEN ('0x' || substr({digest}, 1, 16))::UBIGINT % 10 <= 7 THEN 'REFERENCE' ELSE 'HOLDOUT' END"
    numbers = ", ".join(f"{PATHS[p]} AS {n}" for n, p in observe.NUMBERS.items())
    return f"SELECT record_number, {PATHS['event.source_record_id']} AS record_id, {session} AS session_id, {part} AS partition, {numbers}, {PATHS['application.service_source']} AS service, concat_ws(',', {', '.join(invalid + shape)}) AS violations FROM records"


@query("ml1_full_observations", "records", sql=observed_sql())
def ml1_full(records):
    """The narrow observation of every full record, with its part and all violations of its contract."""
    return observe.observations(mapping.normalize_records(records)).withColumn("violations", F.array_join("violations", ","))
