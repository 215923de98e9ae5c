"""The full mapping of raw firewall records (58 fields of text) to nested events, with provenance and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_utc, filled, integer, listed, missing, protocol_name

#: Source field and the paths of an event that it fills, in the order of the export. No path: kept unmapped.
FIELDS = [
    ("itime", "time.itime_raw time.itime_utc_derived"), ("adom_oid", ""), ("app_cat", "application.category_source"), ("app_service", "application.service_source"),
    ("data_parsername", "source.parser_name"), ("data_sourceid", "source.source_identifier"), ("data_sourcename", "source.source_name"), ("data_sourcetype", "source.source_type"),
    ("data_timestamp", ""), ("dst_geo", "network.destination.geo_source"), ("dst_intf", "network.destination.interface_source"), ("dst_ip", "network.destination.identifier"),
    ("dst_mac", "network.destination.link_layer_identifier"), ("dst_port", "network.destination.port"), ("epid", ""), ("euid", ""), ("event_action", "event.action_source"),
    ("event_id", "event.source_event_id"), ("event_severity", "event.severity_source"), ("event_subtype", "event.subtype_source"), ("event_type", "event.type_source"),
    ("host_ip", "host.identifier"), ("host_location", "host.location_source"), ("host_mac", "host.link_layer_identifier"), ("host_type", "host.type_source"),
    ("loguid", "event.source_record_id"), ("net_proto", "network.protocol_raw network.protocol_number network.protocol_name"), ("net_rcvdpkts", "session.received_packets"),
    ("net_recvbytes", "session.received_bytes"), ("net_sentbytes", "session.sent_bytes"), ("net_sentpkts", "session.sent_packets"), ("net_sessionduration", "session.duration_raw_value"),
    ("net_sessionid", "session.identifier"), ("src_geo", "network.source.geo_source"), ("src_intf", "network.source.interface_source"), ("src_ip", "network.source.identifier"),
    ("src_mac", "network.source.link_layer_identifier"), ("src_port", "network.source.port"), ("event_profile", ""), ("host_osver", "host.os_version_source"),
    ("src_natip", "network.source.nat_identifier_source"), ("src_natport", "network.source.nat_port_source"), ("host_hwvendor", "host.hardware_vendor_source"),
    ("host_hwver", "host.hardware_version_source"), ("host_osfamily", "host.os_family_source"), ("host_osname", "host.os_name_source"), ("host_name", "host.name_source"),
    ("src_domain", "network.source.domain_source"), ("threat_action", "threat_observations.action_source"), ("threat_name", "threat_observations.name_source"),
    ("threat_severity", "threat_observations.severity_source"), ("threat_type", "threat_observations.type_source"), ("app_id", "application.id_raw"), ("app_name", "application.name_source"),
    ("threat_pattern", "threat_observations.pattern_source"), ("event_message", "event.message_source"), ("threat_id", "threat_observations.id_raw"), ("threat_ref", "threat_observations.reference_source"),
]
PORTS = ("src_port", "dst_port")
METRICS = ("net_rcvdpkts", "net_recvbytes", "net_sentbytes", "net_sentpkts", "net_sessionduration")


def canonical() -> dict[str, tuple[str, str, Column]]:
    """path -> (source field, operation, value) of every mapped path; the value is null where the path stays empty."""
    out = {}
    for field, paths in FIELDS:
        text = F.when(filled(field), F.col(field))
        number = integer(field)
        for path in paths.split():
            if path == "time.itime_utc_derived":
                out[path] = field, "DERIVED", epoch_utc(number)
            elif path == "network.protocol_number":
                out[path] = field, "CONVERTED", number
            elif path == "network.protocol_name":
                out[path] = field, "DERIVED", protocol_name(number)
            elif field in PORTS:
                out[path] = field, "CONVERTED", F.when(number.between(0, 65535), number)
            elif field in METRICS:
                out[path] = field, "CONVERTED", F.when(number >= 0, number)
            else:
                out[path] = field, "COPIED", text
    return out


def nested(paths: dict[str, Column]) -> list[Column]:
    """Columns (structs at any depth) from values by dotted path, in the order in which the sections come up."""
    groups: dict[str, dict[str, Column]] = {}
    for path, value in paths.items():
        head, _, rest = path.partition(".")
        groups.setdefault(head, {})[rest] = value
    return [g[""].alias(n) if list(g) == [""] else F.struct(*nested(g)).alias(n) for n, g in groups.items()]


def record_issues() -> Column:
    """field (null for the whole record), code and status of everything that is absent or cannot be converted."""

    def issue(when: Column, field: str | None, code: str, status: str) -> tuple[Column, Column]:
        return when, F.struct(F.lit(field).cast("string").alias("field"), F.lit(code).alias("code"), F.lit(status).alias("status"))

    time, proto = integer("itime"), integer("net_proto")
    both = missing("src_port") & missing("dst_port")
    icmp = F.coalesce(proto == 1, F.lit(False)) & both
    all_metrics = F.lit(True)
    for f in METRICS:
        all_metrics = all_metrics & missing(f)
    return listed(
        issue(missing("itime"), "itime", "MISSING_ITIME", "UNKNOWN"),
        issue(filled("itime") & time.isNull(), "itime", "INVALID_ITIME_INTEGER", "ACTUAL_INVALID"),
        issue(time.isNotNull() & epoch_utc(time).isNull(), "itime", "ITIME_UTC_DERIVATION_UNAVAILABLE", "UNKNOWN"),
        issue(missing("net_proto"), "net_proto", "MISSING_PROTOCOL", "UNKNOWN"),
        issue(filled("net_proto") & proto.isNull(), "net_proto", "INVALID_PROTOCOL_INTEGER", "ACTUAL_INVALID"),
        issue(proto.isNotNull() & protocol_name(proto).isNull(), "net_proto", "UNKNOWN_PROTOCOL_NUMBER", "UNKNOWN"),
        *[issue(filled(f) & ~F.coalesce(integer(f).between(0, 65535), F.lit(False)), f, "INVALID_PORT", "ACTUAL_INVALID") for f in PORTS],
        issue(icmp, None, "MISSING_PORTS_EXPECTED_FOR_ICMP", "EXPECTED"),
        *[issue(missing(f) & ~icmp, f, "MISSING_CONTEXTUAL_PORT", "CONTEXT_DEPENDENT") for f in PORTS],
        *[issue(filled(f) & ~F.coalesce(integer(f) >= 0, F.lit(False)), f, "INVALID_NONNEGATIVE_INTEGER", "ACTUAL_INVALID") for f in METRICS],
        issue(all_metrics, None, "ALL_SESSION_METRICS_MISSING", "CONTEXT_DEPENDENT"),
        *[issue(missing(f) & ~all_metrics, f, "MISSING_CONTEXTUAL_SESSION_METRIC", "CONTEXT_DEPENDENT") for f in METRICS],
    )


def normalize_records(records: DataFrame, key: str = "record_number", adapter: str = "firewall") -> DataFrame:
    """One nested event a record: the sections, the raw record, unmapped fields, provenance and issues.

    An error where a mapped field's column is absent; columns that the mapping does not know are kept as unmapped.
    """
    known = [f for f, _ in FIELDS]
    absent = [f for f in known if f not in records.columns]
    if absent:
        raise ValueError(f"fields absent from the records: {absent}")
    paths = canonical()
    values = {"source.adapter_type": F.lit(adapter), "source.record_number": F.col(key)} | {p: v for p, (_, _, v) in paths.items()}
    loose = [f for f, p in FIELDS if not p] + [c for c in records.columns if c not in known and c != key]
    text = {c: F.col(f"`{c}`").cast("string") for c in records.columns if c != key}
    made = listed(*[(v.isNotNull(), F.struct(F.lit(p).alias("path"), F.lit(f).alias("field"), F.lit(o).alias("operation"))) for p, (f, o, v) in paths.items()])
    return records.select(
        key, *nested(values), F.create_map(*[x for c, v in text.items() for x in (F.lit(c), v)]).alias("source_record"),
        F.create_map(*[x for c in loose for x in (F.lit(c), text[c])]).alias("unmapped_fields"), made.alias("provenance"), record_issues().alias("issues"),
    )
