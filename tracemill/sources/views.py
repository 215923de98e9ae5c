"""Input views over the given tables. Each text runs in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "logs": ("events", """
SELECT event_id + 1 AS record_number, concat('EV_', CAST(event_id AS STRING)) AS loguid, CAST(user_id AS STRING) AS net_sessionid,
  CASE WHEN event_id % 997 = 0 THEN '' ELSE CAST(1700000000 + event_id * 7 AS STRING) END AS itime,
  CASE WHEN event_type = 'error' THEN 'utm' ELSE 'traffic' END AS event_type,
  CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'anomaly' ELSE 'forward' END AS event_subtype,
  CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'accept' WHEN 'purchase' THEN 'timeout' WHEN 'signup' THEN 'server-rst' ELSE 'clear_session' END AS event_action,
  CASE event_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '6' WHEN 2 THEN '17' ELSE '47' END AS net_proto,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id * 31 % 70000 AS STRING) END AS src_port,
  CASE WHEN event_id % 4 = 0 THEN ' ' WHEN event_id % 50 = 1 THEN 'bad' ELSE CAST(user_id * 17 % 1024 AS STRING) END AS dst_port,
  CASE WHEN event_id % 4 = 0 THEN 'PING' WHEN event_id % 4 = 1 THEN concat('tcp/', CAST(user_id * 17 % 1024 AS STRING)) ELSE 'SMB' END AS app_service,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) END AS net_sentbytes,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'icmp_sweep' ELSE '' END AS threat_name
FROM {events}"""),
    "flows": ("lineitem", """
SELECT l_orderkey * 8 + l_linenumber AS record_number, concat('L_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS record_id,
  CAST(l_orderkey AS STRING) AS session_id, CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 17 ELSE 47 END AS protocol_number,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE max(l_partkey) * 37 % 65536 END AS source_port,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE max(l_suppkey) END AS destination_port,
  CASE WHEN max(l_suppkey) % 20 = 0 THEN NULL ELSE concat('SVC', CAST(max(l_suppkey) % 20 AS STRING)) END AS service,
  CASE WHEN max(l_discount) = 0 THEN NULL ELSE CAST(floor(max(l_extendedprice)) AS BIGINT) END AS sent_bytes,
  CAST(floor(max(l_extendedprice) * max(l_tax)) AS BIGINT) AS received_bytes, CAST(max(l_quantity) AS BIGINT) - 1 AS sent_packets,
  CASE WHEN max(l_tax) = 0 THEN NULL ELSE CAST(floor(max(l_tax) * 100) AS BIGINT) END AS received_packets, max(l_quantity) * max(l_discount) AS raw_score,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(max(l_partkey) % 3600 AS BIGINT) END AS duration
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""),
    "labelled_scores": ("documents labels", """
SELECT d.doc_id AS row_key, d.source AS group_id, CAST(d.n_chars AS DOUBLE) AS score, l.toxic AS label, l.quality AS label2
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""),
    "doc_keys": ("documents", """
SELECT doc_id AS row_key, text AS exact_key, concat(lang, ':', source, ':', CAST(n_chars % 97 AS STRING)) AS near_key FROM {documents}"""),
    "entity_keys": ("documents", """
SELECT doc_id AS row_key, text AS exact_key, concat(lang, ':', CAST(n_chars AS STRING)) AS near_key,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('s', CAST(doc_id * 7 % 409 AS STRING)) END AS entity_source,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('s', CAST(doc_id * 11 % 53 AS STRING)) END AS entity_destination,
  CASE WHEN doc_id % 5 > 0 THEN NULL ELSE concat('h', CAST(doc_id % 307 AS STRING)) END AS entity_host FROM {documents}"""),
    "alerts": ("events", """
SELECT event_id + 1 AS record_number, CAST(user_id AS STRING) AS session, 1700000000 + event_id * 7 AS itime,
  CASE WHEN event_type = 'error' THEN 'utm' ELSE 'traffic' END AS event_type, CASE WHEN event_type = 'error' THEN 'anomaly' ELSE 'forward' END AS event_subtype,
  CASE event_type WHEN 'error' THEN 'clear_session' WHEN 'click' THEN 'start' WHEN 'view' THEN 'accept' ELSE 'timeout' END AS event_action,
  CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 3 = 0 THEN 'icmp_sweep' ELSE 'icmp_src_session' END AS threat_name,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN concat('anomaly: icmp_sweep, ', CAST(event_id % 200 AS STRING), ' > threshold 100, repeats ', CAST(event_id % 9 AS STRING), ' times since last log, pps ', CAST(event_id % 37 + 1 AS STRING), ' of prior second')
    WHEN event_type = 'error' AND event_id % 3 = 1 THEN concat('anomaly: icmp_src_session, ', CAST(event_id % 700 AS STRING), ' > threshold 300, repeats ', CAST(event_id % 11 AS STRING), ' times since last log') ELSE 'none' END AS event_message,
  CASE WHEN event_type = 'error' AND event_id % 31 > 0 THEN '1' ELSE '6' END AS net_proto, CASE WHEN event_type <> 'error' THEN 'SMB' WHEN event_id % 29 = 0 THEN 'PING6' ELSE 'PING' END AS app_service,
  CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 23 = 0 THEN 'other' WHEN event_id % 3 = 0 THEN 'icmp_sweep' ELSE 'icmp_src_session' END AS threat_pattern,
  CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 3 = 0 THEN '16777320' ELSE '16777321' END AS threat_id,
  CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 17 = 0 THEN 'http://ids.example/VID16777320' WHEN event_id % 3 = 0 THEN 'http://ids.example/ids/VID16777320' ELSE 'http://ids.example/ids/VID16777321' END AS threat_ref,
  CASE WHEN user_id % 10 < 6 THEN 'TRAIN' WHEN user_id % 10 = 6 THEN 'VALIDATION' WHEN user_id % 10 < 9 THEN 'TEST' ELSE 'UNKNOWN' END AS split, value
FROM {events}"""),
    "reviewed": ("documents labels", """
SELECT row_key, group_id, score, membership, CASE WHEN membership <> 'NOT_SELECTED' THEN concat('R-', CAST(row_key AS STRING)) END AS review_id,
  CASE WHEN membership = 'NOT_SELECTED' OR row_key % 7 = 0 THEN NULL WHEN row_key % 5 = 0 THEN 'UNCERTAIN' WHEN toxic = 1 OR quality = 0 THEN 'SUSPICIOUS' ELSE 'NOT_SUSPICIOUS' END AS blind_label,
  quality = 0 AS rule_seen, row_key % 11 = 0 AS threat_seen
FROM (SELECT d.doc_id AS row_key, d.source AS group_id, CAST(d.n_chars AS DOUBLE) AS score, l.toxic, l.quality,
  CASE WHEN d.n_chars >= 1500 THEN 'TOP_50' WHEN d.doc_id % 3 = 0 THEN 'COMPARISON' ELSE 'NOT_SELECTED' END AS membership
  FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) x"""),
}


#: Field names of a full record whose values need no form of their own; filled or blank by turns.
PLAIN_FIELDS = "adom_oid app_cat app_service data_parsername data_sourceid data_sourcename data_sourcetype data_timestamp dst_geo dst_intf dst_ip dst_mac epid euid event_action event_id event_severity event_subtype event_type host_ip host_location host_mac host_type loguid net_sessionid src_geo src_intf src_ip src_mac event_profile host_osver src_natip src_natport host_hwvendor host_hwver host_osfamily host_osname host_name src_domain threat_action threat_name threat_severity threat_type app_id app_name threat_pattern event_message threat_id threat_ref extra_cell".split()


def _records() -> str:
    plain = ", ".join(f"CASE WHEN (n + {i}) % {5 + i % 7} = 0 THEN ' ' ELSE concat('{f}:', CAST(n % {13 + i} AS STRING)) END AS {f}" for i, f in enumerate(PLAIN_FIELDS))
    numbers = ", ".join(f"CASE WHEN n % 10 = 4 OR n % {6 + i} = 2 THEN '' WHEN n % {41 + i} = 3 THEN 'x' WHEN n % {53 + i} = 5 THEN '-7' ELSE CAST(n * {3 + i} AS STRING) END AS {f}" for i, f in enumerate(("net_rcvdpkts", "net_recvbytes", "net_sentbytes", "net_sentpkts", "net_sessionduration")))
    return f"""
SELECT n + 1 AS record_number, {plain}, {numbers},
  CASE WHEN n % 97 = 0 THEN '' WHEN n % 89 = 1 THEN 'soon' WHEN n % 83 = 2 THEN '999999999999999' ELSE CAST(1700000000 + n * 7 AS STRING) END AS itime,
  CASE n % 7 WHEN 0 THEN '1' WHEN 1 THEN '6' WHEN 2 THEN ' 17 ' WHEN 3 THEN '47' WHEN 4 THEN '' WHEN 5 THEN 'tcp' ELSE '6' END AS net_proto,
  CASE WHEN n % 7 = 0 OR n % 5 = 1 THEN '' ELSE CAST(n * 31 % 70000 AS STRING) END AS src_port,
  CASE WHEN n % 7 = 0 THEN ' ' WHEN n % 19 = 4 THEN '-1' ELSE CAST(n * 17 % 1024 AS STRING) END AS dst_port
FROM (SELECT event_id AS n FROM {{events}}) e"""


VIEWS["records"] = ("events", _records())


#: Tables of views and the key by which their rows are dealt over tasks first. Flows are groups of this key and a number, which
#: meet in a task then without partial groups: before, a map task held one of nearly every row of its file.
DEALT = {"flows": {"lineitem": "l_orderkey"}}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or a given table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in VIEWS[name][0].split()}
    return view_of(spark, name, tables | {t: tables[t].repartition(k) for t, k in DEALT.get(name, {}).items()})


def view_of(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A view over other tables of the same columns, streams included."""
    return spark.sql(VIEWS[name][1], **tables)


def oracle(sql: str) -> str:
    """SQL with the views that it names put before it as common table expressions."""
    import re

    used = [(n, t, v) for n, (t, v) in VIEWS.items() if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    parts = ", ".join(f"{n} AS ({v.format(**{x: x for x in t.split()})})" for n, t, v in used)
    return f"WITH {parts}, " + sql.strip()[5:] if sql.strip().upper().startswith("WITH ") else f"WITH {parts} {sql}"
