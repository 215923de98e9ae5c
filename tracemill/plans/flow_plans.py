"""Queries over flows, vectors and document keys: features, rarity, components, splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import explain, features, frames, splits
from ..registry import query
from ..sources.shared import stored

REF = "('0x' || substr(sha256(concat('session', session_id)), 1, 16))::UBIGINT % 10 < 8"


def is_ref():
    return S.hash_bucket(F.concat(F.lit("session"), "session_id"), 10) < 8


def pclass(x: str, k: str) -> str:
    low, high = {"well_known": (-1, 1023), "registered": (1024, 49151), "dynamic": (49152, 10**9)}[k]
    return f"CASE WHEN {x} BETWEEN {low} AND {high} THEN 1.0 ELSE 0.0 END"


def rare(col: str) -> str:
    """SQL of a rarity against reference rows of the protocol."""
    return f"CASE WHEN f.{col} IS NULL THEN 0.0 WHEN t_{col}.n IS NULL THEN 1.0 ELSE 1 - coalesce(c_{col}.n, 0) / CAST(t_{col}.n AS DOUBLE) END"


def rare_joins(col: str) -> str:
    part = f"FROM flows WHERE {REF} AND {col} IS NOT NULL"
    return f"LEFT JOIN (SELECT protocol_number, count(*) AS n {part} GROUP BY 1) t_{col} ON t_{col}.protocol_number = f.protocol_number LEFT JOIN (SELECT protocol_number, {col}, count(*) AS n {part} GROUP BY ALL) c_{col} ON c_{col}.protocol_number = f.protocol_number AND c_{col}.{col} = f.{col}"


def flag(e: str) -> str:
    return f"CASE WHEN {e} THEN 1.0 ELSE 0.0 END"


def bits(*conditions: str) -> str:
    return "concat(" + ", ".join(f"CASE WHEN {c} THEN '1' ELSE '0' END" for c in conditions) + ")"


SB, RB, SP, RP_ = "f.sent_bytes", "f.received_bytes", "f.sent_packets", "f.received_packets"
FEATURE_SQL = {
    "protocol_icmp": flag("f.protocol_number = 1"), "protocol_tcp": flag("f.protocol_number = 6"), "protocol_udp": flag("f.protocol_number = 17"), "protocol_other": flag("f.protocol_number NOT IN (1, 6, 17)"),
    "src_port_present": flag("f.source_port IS NOT NULL"), "dst_port_present": flag("f.destination_port IS NOT NULL"),
    "src_port_well_known": pclass("f.source_port", "well_known"), "src_port_registered": pclass("f.source_port", "registered"), "src_port_dynamic": pclass("f.source_port", "dynamic"),
    "dst_port_well_known": pclass("f.destination_port", "well_known"), "dst_port_registered": pclass("f.destination_port", "registered"), "dst_port_dynamic": pclass("f.destination_port", "dynamic"),
    "src_port_rarity": rare("source_port"), "dst_port_rarity": rare("destination_port"), "service_rarity": rare("service"), "service_missing": flag("f.service IS NULL"),
    "log_sent_bytes": f"ln(1 + coalesce({SB}, 0))", "log_received_bytes": f"ln(1 + coalesce({RB}, 0))", "log_sent_packets": f"ln(1 + coalesce({SP}, 0))", "log_received_packets": f"ln(1 + coalesce({RP_}, 0))", "log_duration": "ln(1 + coalesce(f.duration, 0))",
    "log_total_bytes": f"coalesce(ln(1 + {SB} + {RB}), 0)", "log_total_packets": f"coalesce(ln(1 + {SP} + {RP_}), 0)",
    "sent_byte_share": f"coalesce(CAST({SB} AS DOUBLE) / nullif({SB} + {RB}, 0), 0.5)", "sent_packet_share": f"coalesce(CAST({SP} AS DOUBLE) / nullif({SP} + {RP_}, 0), 0.5)",
    "log_sent_bytes_per_packet": f"coalesce(ln(1 + CAST({SB} AS DOUBLE) / nullif({SP}, 0)), 0)", "log_received_bytes_per_packet": f"coalesce(ln(1 + CAST({RB} AS DOUBLE) / nullif({RP_}, 0)), 0)",
    "sent_bytes_missing": flag(f"{SB} IS NULL"), "received_bytes_missing": flag(f"{RB} IS NULL"), "sent_packets_missing": flag(f"{SP} IS NULL"), "received_packets_missing": flag(f"{RP_} IS NULL"), "duration_missing": flag("f.duration IS NULL"),
    "zero_total_bytes": flag(f"{SB} + {RB} = 0"), "zero_total_packets": flag(f"{SP} + {RP_} = 0"), "zero_sent_packets": flag(f"{SP} = 0"), "zero_received_packets": flag(f"{RP_} = 0"),
}
ELIGIBLE_SQL = bits(
    *["true"] * 12, "f.source_port IS NOT NULL", "f.destination_port IS NOT NULL", "f.service IS NOT NULL", "true", f"{SB} IS NOT NULL", f"{RB} IS NOT NULL", f"{SP} IS NOT NULL", f"{RP_} IS NOT NULL", "f.duration IS NOT NULL",
    f"{SB} + {RB} IS NOT NULL", f"{SP} + {RP_} IS NOT NULL", f"{SB} + {RB} > 0", f"{SP} + {RP_} > 0", f"{SB} IS NOT NULL AND {SP} > 0", f"{RB} IS NOT NULL AND {RP_} > 0", *["true"] * 5,
    f"{SB} + {RB} IS NOT NULL", f"{SP} + {RP_} IS NOT NULL", f"{SP} IS NOT NULL", f"{RP_} IS NOT NULL",
)
JOINS = " ".join(rare_joins(c) for c in ("source_port", "destination_port", "service"))


@query("ml2_sf22_sf24_features", "flows", sql="SELECT f.record_number, " + ", ".join(f"CAST(round(CAST({e} AS DOUBLE), 6) AS DOUBLE) AS {n}" for n, e in FEATURE_SQL.items()) + f", {ELIGIBLE_SQL} AS eligible FROM flows f {JOINS}")
def ml2(flows):
    """All 36 features in their order, and a sign for each whether it is eligible."""
    # Flows are grouped once, for the counts and for the rows.
    f = features.feature_rows(stored(flows), is_ref(), "record_number")
    signs = F.array_join(F.transform("eligible", lambda x: x.cast("int").cast("string")), "")
    # Flags are 0 or 1, and rounding is most of the work of a number.
    return f.select("record_number", *[F.col(n) if n in explain.SIGNS else F.round(n, 6).alias(n) for n in features.FEATURES], signs.alias("eligible"))


@query("sf38_audit_features", "flows", sql="SELECT f.record_number, " + ", ".join(f"CAST(round(CAST({FEATURE_SQL[n]} AS DOUBLE), 6) AS DOUBLE) AS {n}" for n in list(FEATURE_SQL)[16:]) + " FROM flows f")
def sf38(flows):
    """The 20 traffic features of a leakage audit: those that depend on volumes alone."""
    f = features.traffic_features()
    return flows.select("record_number", *[F.round(f[n], 6).alias(n) for n in features.FEATURES[16:]])


@query("ml1_observations", "flows", sql="SELECT record_number, protocol_number, source_port, destination_port, sent_bytes, concat_ws(',', CASE WHEN source_port > 60000 THEN 'PORT_RANGE' END, CASE WHEN sent_bytes IS NULL AND received_bytes IS NOT NULL THEN 'ONE_SIDED_BYTES' END, CASE WHEN sent_packets = 0 AND sent_bytes > 0 THEN 'BYTES_WITHOUT_PACKETS' END) AS faults FROM flows")
def ml1(flows):
    """The narrow observation of a row, with its violations instead of an error."""
    faults = {"PORT_RANGE": F.col("source_port") > 60000, "ONE_SIDED_BYTES": F.col("sent_bytes").isNull() & F.col("received_bytes").isNotNull(), "BYTES_WITHOUT_PACKETS": (F.col("sent_packets") == 0) & (F.col("sent_bytes") > 0)}
    return flows.select("record_number", "protocol_number", "source_port", "destination_port", "sent_bytes", F.concat_ws(",", *[F.when(e, n) for n, e in faults.items()]).alias("faults"))


@query("ag29_j15_sf23_rarity", "flows", sql=f"SELECT f.record_number, round({rare('service')}, 6) AS service_rarity FROM flows f {rare_joins('service')}")
def ag29(flows):
    one = {"service_rarity": features.RARE["service_rarity"]}
    return features.with_rarity(flows, features.rarity_counts(flows, is_ref(), one), one).select("record_number", F.round("service_rarity", 6).alias("service_rarity"))


@query("ag30_ag31_distributions", "flows", sql=f"SELECT 'sent_packets' AS field, CAST(sent_packets AS STRING) AS value, count(*) AS cnt FROM flows WHERE {REF} GROUP BY 2 UNION ALL SELECT 'service', service, count(*) FROM flows WHERE {REF} GROUP BY 2")
def ag30(flows):
    return frames.unpivot(flows.filter(is_ref()), [], ["sent_packets", "service"]).groupBy("field", "value").agg(F.count("*").alias("cnt"))


@query("ag32_split_counts", "flows", sql=f"SELECT CASE WHEN {REF} THEN 'REFERENCE' ELSE 'HOLDOUT' END AS part, count(*) AS n, count(DISTINCT session_id) AS sessions FROM flows GROUP BY 1")
def ag32(flows):
    return flows.groupBy(F.when(is_ref(), "REFERENCE").otherwise("HOLDOUT").alias("part")).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


@query("ag57_ag58_fit_statistics", "flows", sql=f"SELECT round(quantile_cont(ln(1 + sent_bytes), 0.5), 6) AS mid, round(avg(ln(1 + received_bytes)), 6) AS mean, round(stddev_pop(ln(1 + received_bytes)), 6) AS std FROM flows WHERE {REF}")
def ag57(flows):
    r = flows.filter(is_ref())
    mid = frames.median(r.select(F.log1p(F.col("sent_bytes").cast("double")).alias("x")), "x", "mid")
    return r.agg(F.round(F.avg(F.log1p(F.col("received_bytes").cast("double"))), 6).alias("mean"), F.round(F.stddev_pop(F.log1p(F.col("received_bytes").cast("double"))), 6).alias("std")).crossJoin(F.broadcast(mid.select(F.round("mid", 6).alias("mid"))))


NUMBERS, CATEGORIES = ["sent_bytes", "received_bytes", "sent_packets", "received_packets", "duration"], ["service", "protocol_number"]
ML8_SQL = (
    "WITH m AS (SELECT " + ", ".join(f"coalesce(quantile_cont(ln(1 + {c}), 0.5), 0) AS mid_{c}" for c in NUMBERS) + f" FROM flows WHERE {REF}), "
    "s AS (SELECT " + ", ".join(f"max(mid_{c}) AS mid_{c}, avg(coalesce(ln(1 + {c}), mid_{c})) AS mean_{c}, coalesce(nullif(stddev_pop(coalesce(ln(1 + {c}), mid_{c})), 0), 1) AS scale_{c}" for c in NUMBERS) + f" FROM flows, m WHERE {REF}), "
    "v AS (SELECT " + ", ".join(f"list_sort(list(DISTINCT CAST({c} AS STRING)) FILTER ({c} IS NOT NULL)) AS voc_{c}" for c in CATEGORIES) + f" FROM flows WHERE {REF}) "
    "SELECT record_number, " + ", ".join(f"round((coalesce(ln(1 + {c}), mid_{c}) - mean_{c}) / scale_{c}, 5) AS {c}_scaled, CASE WHEN {c} IS NULL THEN 1::DOUBLE ELSE 0::DOUBLE END AS {c}_missing" for c in NUMBERS)
    + ", " + ", ".join(f"concat(array_to_string(list_transform(voc_{c}, lambda x: CASE WHEN x = CAST({c} AS STRING) THEN '1' ELSE '0' END), ''), CASE WHEN {c} IS NULL THEN '10' WHEN list_contains(voc_{c}, CAST({c} AS STRING)) THEN '00' ELSE '01' END) AS {c}_hot" for c in CATEGORIES)
    + " FROM flows, s, v"
)


@query("ml8_transform", "flows", sql=ML8_SQL)
def ml8(flows):
    """Scaled logs with missing flags, and one-hot signs in the order of the reference rows' values, MISSING, UNKNOWN."""
    state = features.column_state(flows.filter(is_ref()), NUMBERS, CATEGORIES)
    x = features.encoded(flows, state, NUMBERS, CATEGORIES, "record_number")
    hot = [F.array_join(F.transform(f"{c}_hot", lambda y: y.cast("int").cast("string")), "").alias(f"{c}_hot") for c in CATEGORIES]
    return x.select("record_number", *[F.round(f"{c}_scaled", 5).alias(f"{c}_scaled") for c in NUMBERS], *[f"{c}_missing" for c in NUMBERS], *hot)


@query("w6_sf26_midrank", "flows", sql=f"SELECT record_number, round(abs(2 * (less + 0.5 * equal) / total - 1), 6) AS extremeness FROM (SELECT f.record_number, (SELECT count(*) FROM flows r WHERE {REF.replace('session_id', 'r.session_id')} AND r.sent_packets < f.sent_packets) AS less, (SELECT count(*) FROM flows r WHERE {REF.replace('session_id', 'r.session_id')} AND r.sent_packets = f.sent_packets) AS equal, (SELECT count(*) FROM flows WHERE {REF}) AS total FROM flows f)")
def w6(flows):
    cum = frames.running_by_value(flows, "sent_packets", {"r": is_ref().cast("long")})
    total = flows.agg(F.count_if(is_ref()).alias("total"))
    mid = (F.col("cum_r") - 0.5 * F.col("r")) / F.col("total")
    return flows.join(cum, "sent_packets").crossJoin(F.broadcast(total)).select("record_number", F.round(F.abs(2 * mid - 1), 6).alias("extremeness"))


@query("j14_ml7_nearest_centroid", "embeddings", sql="WITH c AS (SELECT label AS id, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) r(i) WHERE label IS NOT NULL GROUP BY ALL), d AS (SELECT e.vec_id, c.id, sum(pow(CAST(e.embedding[c.i] AS DOUBLE) - c.v, 2)) AS d FROM embeddings e, c GROUP BY ALL) SELECT vec_id, round(min(d), 5) AS distance, arg_min(id, d) AS nearest FROM d GROUP BY 1")
def j14(e):
    centres = e.select("label", F.posexplode("embedding").alias("i", "x")).filter("label is not null").groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    centres = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centre")).withColumnRenamed("label", "id")
    rows = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return features.nearest_centroid(rows, centres).select("vec_id", F.round("distance", 5).alias("distance"), "nearest")


def rooted(d):
    return splits.group_roots(d, "row_key", {"": splits.HARD_KEYS}).select("row_key", "root")


@query("g2_g4_components", "doc_keys")
def g2(d):
    return rooted(d)


@query("ag54_component_sizes", "doc_keys")
def ag54(d):
    return rooted(d).groupBy("root").agg(F.count("*").alias("c")).agg(F.count("*").alias("n_groups"), F.max("c").alias("largest"), F.sum("c").alias("n"))


@query("g7_folds", "flows", sql="SELECT session_id, CAST(CASE WHEN (rn - 1) % 6 < 3 THEN (rn - 1) % 6 ELSE 5 - (rn - 1) % 6 END AS BIGINT) AS fold FROM (SELECT session_id, row_number() OVER (ORDER BY count(*) DESC, sha256(session_id)) AS rn FROM flows GROUP BY 1)")
def g7(flows):
    # Whole groups by size, dealt out back and forth, so that folds get equal numbers of rows.
    g = flows.groupBy("session_id").agg(F.count("*").alias("c")).withColumn("h", F.sha2("session_id", 256))
    r = frames.global_rank(g, [F.desc("c"), "h"], "rn")
    k = (F.col("rn") - 1) % 6
    return r.select("session_id", F.when(k < 3, k).otherwise(5 - k).cast("bigint").alias("fold"))


@query("g6_g9_sf17_split", "flows", sql="SELECT record_number, CASE WHEN b <= 6999 THEN 'TRAIN' WHEN b <= 8499 THEN 'VALIDATION' ELSE 'TEST' END AS split FROM (SELECT record_number, ('0x' || substr(sha256(session_id), 1, 16))::UBIGINT % 10000 AS b FROM flows)")
def g6(flows):
    b = S.hash_bucket("session_id", 10000)
    return flows.select("record_number", F.when(b <= 6999, "TRAIN").when(b <= 8499, "VALIDATION").otherwise("TEST").alias("split"))


@query("g8_group_strata", "flows", sql="SELECT session_id, count(*) FILTER (WHERE protocol_number = 1) AS icmp, count(*) FILTER (WHERE protocol_number = 6) AS tcp, count(*) FILTER (WHERE protocol_number NOT IN (1, 6)) AS others FROM flows GROUP BY 1")
def g8(flows):
    p = F.col("protocol_number")
    return flows.groupBy("session_id").agg(F.count_if(p == 1).alias("icmp"), F.count_if(p == 6).alias("tcp"), F.count_if(~p.isin(1, 6)).alias("others"))


@query("w10_sr13_family_best", "flows", sql="SELECT protocol_number, max(raw_score) AS best, arg_max(record_number, struct_pack(a := raw_score, b := -record_number)) AS record_number FROM flows GROUP BY 1")
def w10(flows):
    return flows.groupBy("protocol_number").agg(F.max("raw_score").alias("best"), F.max_by("record_number", F.struct("raw_score", -F.col("record_number"))).alias("record_number"))


@query("w12_ordinals", "flows", sql="SELECT session_id, max(rn) = count(*) AS gapless FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY record_number) AS rn FROM flows) GROUP BY 1")
def w12(flows):
    r = flows.withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy("record_number")))
    return r.groupBy("session_id").agg((F.max("rn") == F.count("*")).alias("gapless"))


@query("sf20_digests", "flows", sql="SELECT count(DISTINCT concat(session_id, ':', CAST(round(raw_score, 4) AS DECIMAL(38, 4)))) AS near, count(DISTINCT concat(session_id, ':', CAST(record_number AS STRING))) AS exact FROM flows")
def sf20(flows):
    near = F.unhex(F.sha2(F.concat_ws(":", "session_id", F.round("raw_score", 4).cast("decimal(38,4)").cast("string")), 256))
    exact = F.unhex(F.sha2(F.concat_ws(":", "session_id", F.col("record_number").cast("string")), 256))
    return frames.distinct_counts(flows, {"near": near, "exact": exact})


@query("ag66_logical_hash", "flows")
def ag66(flows):
    return frames.fingerprint(flows, ["record_number", "session_id", "service"])


@query("au5_unique_keys", "lineitem", sql="SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def au5(li):
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("w7_w13_versions", "flows", sql="SELECT session_id, count(*) AS versions, arg_max(record_id, record_number) AS latest FROM flows GROUP BY 1")
def w7(flows):
    return flows.groupBy("session_id").agg(F.count("*").alias("versions"), F.max_by("record_id", "record_number").alias("latest"))
