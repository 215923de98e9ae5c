"""The narrow observation of a nested event: the approved fields alone, its part, and every violation of their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import text_sql
from ..functions.scalars import digest_of

#: The observation's columns and their paths in an event.
NUMBERS = {"protocol_number": "network.protocol_number", "source_port": "network.source.port", "destination_port": "network.destination.port", "sent_bytes": "session.sent_bytes", "received_bytes": "session.received_bytes", "sent_packets": "session.sent_packets", "received_packets": "session.received_packets", "duration": "session.duration_raw_value"}
#: Source fields whose invalid values keep an event from being observed, in the order of their violations.
CHECKED = ["net_proto", "src_port", "dst_port", "net_sentbytes", "net_recvbytes", "net_sentpkts", "net_rcvdpkts", "net_sessionduration"]
TOPS = {"protocol_number": 255, "source_port": 65535, "destination_port": 65535}


def partition(session: str, number: str) -> Column:
    """REFERENCE for eight of ten hash buckets of the session (of the record where it has none), else HOLDOUT."""
    by = F.when(F.coalesce(F.col(session), F.lit("")) != "", digest_of("split", "session", F.expr(text_sql(session)))).otherwise(digest_of("split", "record", F.col(number)))
    bucket = F.conv(F.substring(by, 1, 16), 16, 10).cast("decimal(20,0)") % 10
    return F.when(bucket <= 7, "REFERENCE").otherwise("HOLDOUT")


def observations(events: DataFrame, key: str = "record_number") -> DataFrame:
    """key, record_id, session_id, partition, NUMBERS, service and ``violations`` of every event, from one scan.

    Blank texts count as null. A violation is named by its column or, as INVALID:<field>, by the source field whose value could
    not be converted; an event is fit to be observed where the list is empty. Nothing else of the event is kept.
    """
    blank = lambda path: F.when(F.col(path) != "", F.col(path))
    out = events.select(key, blank("event.source_record_id").alias("record_id"), blank("session.identifier").alias("session_id"), *[F.col(p).alias(n) for n, p in NUMBERS.items()], blank("application.service_source").alias("service"), F.transform(F.filter("issues", lambda x: x["status"] == "ACTUAL_INVALID"), lambda x: x["field"]).alias("_bad"))
    faults = [F.when(F.array_contains("_bad", f), f"INVALID:{f}") for f in CHECKED]
    faults += [F.when(~F.coalesce(F.col(key) >= 1, F.lit(False)), key), F.when(F.col("record_id").isNull(), "record_id"), F.when(F.col("protocol_number").isNull(), "protocol_number")]
    for n in NUMBERS:
        top = TOPS.get(n)
        faults.append(F.when((F.col(n) < 0) | (F.col(n) > top if top else F.lit(False)), n))
    return out.withColumn("partition", partition("session_id", key)).withColumn("violations", F.array_compact(F.array(*faults))).drop("_bad")
