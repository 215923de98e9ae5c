"""A data-quality report from one scan: every record gives tagged keys, one aggregation counts them, sections read the counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import stored
from . import frames

#: Sets of fields by which missing values are counted.
SETS = [["event_type"], ["event_subtype"], ["net_proto"], ["event_type", "event_subtype"], ["event_type", "net_proto"], ["event_type", "event_subtype", "net_proto"], []]
CONTEXT = ["event_type", "event_subtype", "net_proto"]


def _tag(section: str, keys: list[Column], a: Column | None = None, b: Column | None = None, x: Column | None = None) -> Column:
    no = F.lit(False)
    number = F.lit(None) if x is None else x
    return F.struct(F.lit(section).alias("section"), F.array(*[k.cast("string") for k in keys]).cast("array<string>").alias("keys"), (no if a is None else a).alias("a"), (no if b is None else b).alias("b"), number.cast("bigint").alias("x"))


def service_outcome() -> Column:
    """How the protocol and port that a service names agree with those of the record."""
    proto, port = S.service_hint("app_service", 1), S.service_hint("app_service", 2).cast("bigint")
    actual, dst = F.lower(F.coalesce(S.protocol_name(S.integer("net_proto")), F.lit(""))), S.integer("dst_port")
    return F.when(proto.isNull(), "NO_HINT").when(proto != actual, "PROTOCOL_DIFFERS").when(dst.isNull(), "NO_PORT").when(port == dst, "ALIGNED").otherwise("PORT_DIFFERS")


def facts(logs: DataFrame) -> DataFrame:
    """section, keys, n, na, nb, nx, lo, hi: rows of every section's key, those with sign a and b, and the numbers x. Stored.

    Keys are counted before the shuffle, so that it carries one line a key and task; sessions alone have many keys.
    """
    miss, fill, c = S.missing, S.filled, F.col
    src, dst, sent, time = miss("src_port"), miss("dst_port"), S.integer("net_sentbytes"), S.integer("itime")
    tags = [_tag("conditional_missing", [F.lit(i), *[c(k) if k in s else F.lit(None) for k in CONTEXT]], src, miss("net_sentbytes")) for i, s in enumerate(SETS)]
    tags += [
        _tag("protocol_ports", [c("net_proto")], src & dst, src, F.when(dst, 1)),
        _tag("missing_patterns", [F.concat_ws(",", *[F.when(miss(x), x) for x in ("dst_port", "net_sentbytes", "src_port")])]),
        _tag("population", [c("event_type"), c("event_action")], fill("threat_name"), fill("app_service")),
        _tag("services", [c("net_proto"), c("app_service")]),
        _tag("service_alignment", [service_outcome()]),
        _tag("sessions", [c("net_sessionid"), c("event_action")], x=sent),
        _tag("combinations", [c("event_type"), c("event_action"), c("net_proto")], miss("net_sentbytes")),
        _tag("times", [time]),
        _tag("time_difference", [], x=time - c("record_number")),
        _tag("frequency", [F.lit("event_action"), c("event_action")]),
        _tag("frequency", [F.lit("event_type"), c("event_type")]),
        _tag("threat_presence", [c("event_subtype")], fill("threat_name")),
        _tag("sent_bytes", [sent]),
    ]
    timeless = [F.when(miss("itime"), _tag("missing_time_context", [F.lit(k), c(k)])) for k in ("event_action", "net_proto")]
    long = logs.select(F.explode(F.array_compact(F.array(*tags, *timeless))).alias("t")).select("t.*")
    counted = long.groupBy("section", "keys").agg(F.count("*").alias("n"), F.count_if("a").alias("na"), F.count_if("b").alias("nb"), F.count("x").alias("nx"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return stored(counted)


def _of(f: DataFrame, section: str) -> DataFrame:
    return f.filter(F.col("section") == section)


def _k(i: int, name: str) -> Column:
    return F.col("keys")[i].alias(name)


def _sessions(f: DataFrame) -> DataFrame:
    return _of(f, "sessions").groupBy(_k(0, "session")).agg(F.sum("n").alias("size"), F.sum("nx").alias("filled"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _sizes(f: DataFrame) -> DataFrame:
    return _sessions(f).filter(S.filled("session"))


def _protocol_ports(f: DataFrame) -> DataFrame:
    either = F.col("nb") + F.col("nx") - F.col("na")
    status = F.when(F.col("na") == F.col("n"), "NEVER").when(either == 0, "ALWAYS").otherwise("MIXED")
    return _of(f, "protocol_ports").select(_k(0, "net_proto"), F.col("na").alias("both_missing"), F.col("nb").alias("src_missing"), F.col("nx").alias("dst_missing"), status.alias("status"))


def _session_sizes(f: DataFrame) -> DataFrame:
    s = stored(_sizes(f))
    one = s.agg(F.count("*").alias("sessions"), F.count_if(F.col("size") == 1).alias("singles"), F.min("size").alias("low"), F.max("size").alias("high"))
    return one.crossJoin(F.broadcast(frames.median(s, "size", "mid"))).crossJoin(F.broadcast(frames.quantile_disc(s, "size", {"p50": 0.5, "p95": 0.95})))


def _session_metrics(f: DataFrame) -> DataFrame:
    state = F.when(F.col("filled") == 0, "ALL_MISSING").when(F.col("filled") < F.col("size"), "MIXED").when(F.col("lo") != F.col("hi"), "VARYING").otherwise("CONSTANT")
    return _sessions(f).filter("size > 1").groupBy(state.alias("state")).agg(F.count("*").alias("sessions"))


def _times(f: DataFrame) -> DataFrame:
    t = F.col("keys")[0].cast("bigint")
    return _of(f, "times").agg(F.coalesce(F.sum(F.when(t.isNotNull(), F.col("n"))), F.lit(0)).alias("valid"), F.coalesce(F.sum(F.when(t.isNull(), F.col("n"))), F.lit(0)).alias("failures"), F.min(t).alias("low"), F.max(t).alias("high"), (F.max(t) - F.min(t)).alias("span"), F.count(t).alias("distinct_times"))


def _numeric(f: DataFrame) -> DataFrame:
    x = stored(_of(f, "sent_bytes").select(F.col("keys")[0].cast("bigint").alias("x"), "n").filter("x is not null"))
    one = x.agg(F.coalesce(F.sum(F.when(F.col("x") == 0, F.col("n"))), F.lit(0)).alias("zeros"), F.coalesce(F.sum(F.when(F.col("x") != 0, F.col("n"))), F.lit(0)).alias("others"))
    # The values' running counts give every place; a value stands once, with the number of its rows.
    at = stored(frames.running_by_value(x, "x", {"c": F.col("n")}).select("x", "c", "cum_c"))
    held = at.crossJoin(F.broadcast(at.agg(F.sum("c").alias("all"))))
    at_place = lambda k: F.min(F.when(F.col("cum_c") >= k, F.col("x")))
    low, high = at_place(F.floor((F.col("all") + 1) / 2)), at_place(F.floor((F.col("all") + 2) / 2))
    return one.crossJoin(F.broadcast(held.agg(((low + high) / 2).alias("mid"), at_place(F.greatest(F.ceil(0.99 * F.col("all")), F.lit(1))).alias("p99"))))


SECTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "conditional_missing": lambda f: _of(f, "conditional_missing").select(*[_k(i + 1, n) for i, n in enumerate(CONTEXT)], F.col("na").alias("src_missing"), F.col("nb").alias("bytes_missing"), "n"),
    "protocol_ports": _protocol_ports,
    "missing_patterns": lambda f: _of(f, "missing_patterns").select(_k(0, "pattern"), "n"),
    "missing_time_context": lambda f: _of(f, "missing_time_context").select(_k(0, "field"), _k(1, "value"), "n"),
    "population": lambda f: _of(f, "population").select(_k(0, "event_type"), _k(1, "event_action"), F.col("na").alias("threat_filled"), (F.col("n") - F.col("na")).alias("threat_missing"), F.col("nb").alias("service_filled")),
    "services": lambda f: frames.top_per_group(_of(f, "services").select(_k(0, "net_proto"), _k(1, "app_service"), F.col("n").alias("cnt")), ["net_proto"], [F.desc("cnt"), "app_service"], 3).withColumn("rn", F.col("rn").cast("bigint")),
    "service_alignment": lambda f: _of(f, "service_alignment").select(_k(0, "outcome"), "n"),
    "session_sizes": _session_sizes,
    "session_buckets": lambda f: _sizes(f).groupBy(S.bucket("size", S.SESSION_SIZES, "11+").alias("bucket")).agg(F.count("*").alias("sessions"), F.sum("size").alias("records")),
    "lifecycle": lambda f: _of(f, "sessions").groupBy(_k(1, "event_action")).agg(F.count("*").alias("sessions"), F.sum("n").alias("records")),
    "session_metrics": _session_metrics,
    "missing_combinations": lambda f: _of(f, "combinations").groupBy(_k(0, "event_type"), _k(1, "event_action")).agg(F.sum("na").alias("cnt")).filter("cnt > 0").orderBy(F.desc("cnt"), "event_type", "event_action").limit(5),
    "rare_combinations": lambda f: _of(f, "combinations").select(_k(0, "event_type"), _k(1, "event_action"), _k(2, "net_proto"), F.col("n").alias("cnt")).orderBy("cnt", "event_type", "event_action", "net_proto").limit(5),
    "time_stats": _times,
    "time_difference": lambda f: _of(f, "time_difference").select(F.col("lo").alias("low"), F.col("hi").alias("high"), (F.col("lo") == F.col("hi")).alias("is_constant")),
    "frequency": lambda f: frames.top_per_group(_of(f, "frequency").select(_k(0, "field"), _k(1, "value"), F.col("n").alias("cnt")), ["field"], [F.desc("cnt"), "value"], 3).drop("rn"),
    "threat_presence": lambda f: _of(f, "threat_presence").select(_k(0, "event_subtype"), "n", F.col("na").alias("present")),
    "occurrences": lambda f: _sizes(f).groupBy(F.col("size").alias("occurrences")).agg(F.count("*").alias("ids")),
    "numeric_semantics": _numeric,
}


def analyze(logs: DataFrame) -> dict[str, DataFrame]:
    """All sections by name, from one scan of the records; an empty table gives sections without rows or of zeros."""
    f = facts(logs)
    return {name: section(f) for name, section in SECTIONS.items()}
