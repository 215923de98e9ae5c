"""Raw log records to nested events, with provenance and issues, from a declared mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_utc, filled, integer, listed, missing, protocol_name

#: section, path in it, source field; what is not listed stays in the map of unmapped fields.
MAPPING = [
    ("event", "type", "event_type"), ("event", "subtype", "event_subtype"), ("event", "action", "event_action"),
    ("session", "id", "net_sessionid"), ("application", "service", "app_service"), ("threat", "name", "threat_name"),
]
CONVERTED = {"network.protocol": "net_proto", "network.source_port": "src_port", "network.destination_port": "dst_port", "network.sent_bytes": "net_sentbytes", "time.utc": "itime"}


def value(field: str) -> Column:
    return F.when(filled(field), F.col(field))


def port(field: str) -> Column:
    return F.when(integer(field).between(0, 65535), integer(field))


def metric(field: str) -> Column:
    return F.when(integer(field) >= 0, integer(field))


def issue(when: Column, field: str, code: str) -> tuple[Column, Column]:
    return when, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))


def issues() -> Column:
    icmp = integer("net_proto") == 1
    both = missing("src_port") & missing("dst_port")
    return listed(
        issue(missing("itime"), "itime", "MISSING_TIME"),
        issue(filled("itime") & integer("itime").isNull(), "itime", "INVALID_TIME"),
        issue(filled("net_proto") & integer("net_proto").isNull(), "net_proto", "INVALID_PROTOCOL"),
        issue(integer("net_proto").isNotNull() & protocol_name(integer("net_proto")).isNull(), "net_proto", "UNKNOWN_PROTOCOL"),
        issue(filled("src_port") & port("src_port").isNull(), "src_port", "INVALID_PORT"),
        issue(filled("dst_port") & port("dst_port").isNull(), "dst_port", "INVALID_PORT"),
        issue(icmp & both, "ports", "EXPECTED_MISSING_PORTS"),
        issue(F.coalesce(~icmp, F.lit(True)) & missing("src_port"), "src_port", "CONTEXTUAL_MISSING"),
        issue(F.coalesce(~icmp, F.lit(True)) & missing("dst_port"), "dst_port", "CONTEXTUAL_MISSING"),
        issue(filled("net_sentbytes") & metric("net_sentbytes").isNull(), "net_sentbytes", "INVALID_METRIC"),
    )


def provenance() -> Column:
    """One entry for every filled path."""
    paths = {f"{s}.{p}": f for s, p, f in MAPPING} | CONVERTED
    return listed(*[
        (filled(f), F.struct(F.lit(p).alias("path"), F.array(F.lit(f)).alias("source_fields"), F.lit("CONVERTED" if p in CONVERTED else "COPIED").alias("operation")))
        for p, f in paths.items()
    ])


def normalize(logs: DataFrame) -> DataFrame:
    """One nested event a record; the raw record and unknown fields are kept as maps."""
    known = {f for _, _, f in MAPPING} | set(CONVERTED.values()) | {"record_number", "loguid"}
    sections = {}
    for s, p, f in MAPPING:
        sections.setdefault(s, []).append(value(f).alias(p))
    proto = integer("net_proto")
    rest = [x for x in logs.columns if x not in known]
    return logs.select(
        "record_number", "loguid", *[F.struct(*v).alias(s) for s, v in sections.items()],
        F.struct(proto.alias("protocol"), protocol_name(proto).alias("protocol_name"), port("src_port").alias("source_port"), port("dst_port").alias("destination_port"), metric("net_sentbytes").alias("sent_bytes")).alias("network"),
        F.struct(value("itime").alias("raw"), epoch_utc(integer("itime")).alias("utc")).alias("time"),
        F.create_map(*[x for f in logs.columns for x in (F.lit(f), F.col(f).cast("string"))]).alias("source_record"),
        (F.create_map(*[x for f in rest for x in (F.lit(f), F.col(f).cast("string"))]) if rest else F.create_map().cast("map<string,string>")).alias("unmapped_fields"),
        provenance().alias("provenance"), issues().alias("issues"),
    )
