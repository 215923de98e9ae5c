"""Traffic features of flow observations, rarity against a reference population, residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import stored
from .frames import median, unpivot

RARE = {"src_port_rarity": "source_port", "dst_port_rarity": "destination_port", "service_rarity": "service"}
FEW_COUNTS = 200_000  # rarity counts of a field up to which they are broadcast
PARTS_OF_NULLS = 4096

#: The features in their fixed order.
FEATURES = [
    "protocol_icmp", "protocol_tcp", "protocol_udp", "protocol_other", "src_port_present", "dst_port_present",
    "src_port_well_known", "src_port_registered", "src_port_dynamic", "dst_port_well_known", "dst_port_registered", "dst_port_dynamic",
    "src_port_rarity", "dst_port_rarity", "service_rarity", "service_missing",
    "log_sent_bytes", "log_received_bytes", "log_sent_packets", "log_received_packets", "log_duration", "log_total_bytes", "log_total_packets",
    "sent_byte_share", "sent_packet_share", "log_sent_bytes_per_packet", "log_received_bytes_per_packet",
    "sent_bytes_missing", "received_bytes_missing", "sent_packets_missing", "received_packets_missing", "duration_missing",
    "zero_total_bytes", "zero_total_packets", "zero_sent_packets", "zero_received_packets",
]


def rarity_counts(rows: DataFrame, reference: Column, rare: dict[str, str] = RARE) -> DataFrame:
    """(protocol, field, value, cnt) over reference rows, stored: one aggregation serves every join. Null values count nowhere."""
    long = unpivot(rows.filter(reference), ["protocol_number"], list(rare.values())).filter("value is not null")
    return stored(long.groupBy("protocol_number", "field", "value").agg(F.count("*").alias("cnt")))


def with_rarity(rows: DataFrame, counts: DataFrame, rare: dict[str, str] = RARE) -> DataFrame:
    """1 - count / total of the protocol's values of a field; 0 for null values, 1 where the protocol has no value of the field.

    The totals of all fields are one row a protocol and join at once. A field's counts up to FEW_COUNTS rows are broadcast,
    more of them are joined by shuffles: each field by its own number, so that one with few values never deals out its rows by
    them. Rows without a value, which meet no count, are dealt over PARTS_OF_NULLS parts of their own then.
    """
    sizes = {r["field"]: r["n"] for r in counts.groupBy("field").agg(F.count("*").alias("n")).collect()}  # one line a field
    total = lambda col: F.sum(F.when(F.col("field") == col, F.col("cnt")))
    totals = counts.groupBy(F.col("protocol_number").alias("_p")).agg(*[total(col).alias(f"_t_{col}") for col in rare.values()])
    few_protocols = sum(sizes.values()) <= FEW_COUNTS or totals.count() <= FEW_COUNTS
    out = rows.join(F.broadcast(totals) if few_protocols else totals, F.col("protocol_number") == F.col("_p"), "left")
    for name, col in rare.items():
        c = counts.filter(F.col("field") == col).select(F.col("protocol_number").alias("_q"), F.col("value").alias("_v"), F.col("cnt").alias("_c"))
        same = (F.col("protocol_number") == F.col("_q")) & (F.col(col).cast("string") == F.col("_v"))
        if sizes.get(col, 0) <= FEW_COUNTS:
            out = out.join(F.broadcast(c), same, "left")
        else:
            spread = F.when(F.col(col).isNull(), F.pmod(F.xxhash64(*[x for x, t in rows.dtypes if "map<" not in t and t != "variant"]), F.lit(PARTS_OF_NULLS))).otherwise(-1)
            c = c.withColumn("_s", F.when(F.col("_v").isNull(), 0).otherwise(-1).cast("long"))
            out = out.withColumn("_n", spread.cast("long")).join(c, same & (F.col("_n") == F.col("_s")), "left").drop("_n", "_s")
        out = out.withColumn(name, F.when(F.col(col).isNull(), 0.0).when(F.col(f"_t_{col}").isNull(), 1.0).otherwise(1 - F.coalesce("_c", F.lit(0)) / F.col(f"_t_{col}"))).drop("_q", "_v", "_c")
    return out.drop("_p", *[f"_t_{col}" for col in rare.values()])


def both_filled(x: str, y: str) -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull()


def traffic_features() -> dict[str, Column]:
    """The features that need one row only; rarities come from ``with_rarity``."""
    p = F.col("protocol_number")
    out = {"protocol_icmp": p == 1, "protocol_tcp": p == 6, "protocol_udp": p == 17, "protocol_other": ~p.isin(1, 6, 17)}
    for side, col in (("src", "source_port"), ("dst", "destination_port")):
        out[f"{side}_port_present"] = F.col(col).isNotNull()
        for k in ("well_known", "registered", "dynamic"):
            out[f"{side}_port_{k}"] = F.coalesce(S.port_class(col) == k, F.lit(False))
    out["service_missing"] = F.col("service").isNull()
    out = {k: v.cast("double") for k, v in out.items()}
    b, r, sp, rp = "sent_bytes", "received_bytes", "sent_packets", "received_packets"
    for x in (b, r, sp, rp, "duration"):
        out[f"log_{x}"] = F.log1p(F.coalesce(F.col(x), F.lit(0)).cast("double"))
        out[f"{x}_missing"] = F.col(x).isNull().cast("double")
    for name, x, y in (("bytes", b, r), ("packets", sp, rp)):
        total = F.col(x) + F.col(y)
        out[f"log_total_{name}"] = F.when(both_filled(x, y), F.log1p(total.cast("double"))).otherwise(0.0)
        out[f"sent_{name[:-1]}_share"] = S.share(x, y)
        out[f"zero_total_{name}"] = (both_filled(x, y) & (total == 0)).cast("double")
    out["log_sent_bytes_per_packet"] = S.log_ratio(b, sp)
    out["log_received_bytes_per_packet"] = S.log_ratio(r, rp)
    out["zero_sent_packets"] = F.coalesce(F.col(sp) == 0, F.lit(False)).cast("double")
    out["zero_received_packets"] = F.coalesce(F.col(rp) == 0, F.lit(False)).cast("double")
    return out


def eligibility() -> dict[str, Column]:
    """For every feature whether its value says something of the row (it enters the reference distribution)."""
    out = {f: F.lit(True) for f in FEATURES}
    for name, col in RARE.items():
        out[name] = F.col(col).isNotNull()
    for x in ("sent_bytes", "received_bytes", "sent_packets", "received_packets", "duration"):
        out[f"log_{x}"] = F.col(x).isNotNull()
    for name, x, y in (("bytes", "sent_bytes", "received_bytes"), ("packets", "sent_packets", "received_packets")):
        out[f"log_total_{name}"] = out[f"zero_total_{name}"] = both_filled(x, y)
        out[f"sent_{name[:-1]}_share"] = both_filled(x, y) & F.coalesce(F.col(x) + F.col(y) > 0, F.lit(False))
    for side in ("sent", "received"):
        out[f"log_{side}_bytes_per_packet"] = F.col(f"{side}_bytes").isNotNull() & F.coalesce(F.col(f"{side}_packets") > 0, F.lit(False))
        out[f"zero_{side}_packets"] = F.col(f"{side}_packets").isNotNull()
    return out


def feature_rows(rows: DataFrame, reference: Column, *keep: str) -> DataFrame:
    """The kept columns, all FEATURES in their order, and ``eligible``, a flag for each of them in the same order."""
    f, e = traffic_features(), eligibility()
    return with_rarity(rows, rarity_counts(rows, reference)).select(*keep, *[f.get(n, F.col(n)).alias(n) for n in FEATURES], F.array(*[e[n] for n in FEATURES]).alias("eligible"))


def observed_log(col: str) -> Column:
    """log(1 + x), null for missing values; an error for negative and infinite values and NaN."""
    x = F.col(col).cast("double")
    bad = F.raise_error(F.concat(F.lit(f"{col} is not a finite number from 0: "), x.cast("string"))).cast("double")
    return F.when(x.isNull(), F.lit(None).cast("double")).when((x < 0) | F.isnan(x) | (x == float("inf")), bad).otherwise(F.log1p(x))


def category(col: str) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(F.col(col).cast("string")), F.lit(""))


def column_state(rows: DataFrame, numbers: list[str], categories: list[str], most: int = 512) -> DataFrame:
    """One row, fitted on ``rows``: mid_, mean_ and scale_ of every number's logs (missing ones filled with the median),
    voc_ with the sorted values of every category. An error where the encoded columns would be more than ``most``."""
    logs = stored(rows.select(*[observed_log(c).alias(c) for c in numbers], *[category(c).alias(f"c_{c}") for c in categories]))
    words = stored(unpivot(logs, [], [f"c_{c}" for c in categories]).filter("value is not null").distinct())
    width = 2 * len(numbers) + 2 * len(categories) + words.count()
    if width > most:
        raise ValueError(f"{width} encoded columns, of {most} allowed")
    one = words.agg(*[F.array_sort(F.collect_set(F.when(F.col("field") == f"c_{c}", F.col("value")))).alias(f"voc_{c}") for c in categories])
    mids = [median(logs, c, f"mid_{c}").select(F.coalesce(f"mid_{c}", F.lit(0.0)).alias(f"mid_{c}")) for c in numbers]
    for m in mids:
        one = one.crossJoin(F.broadcast(m))
        logs = logs.crossJoin(F.broadcast(m))
    sums = []
    for c in numbers:
        x = F.coalesce(c, f"mid_{c}")
        spread = F.stddev_pop(x)
        sums += [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"mean_{c}"), F.when(spread > 0, spread).otherwise(1.0).alias(f"scale_{c}")]
    return stored(one.crossJoin(F.broadcast(logs.agg(*sums))))


def one_hot(value: Column, known: Column) -> Column:
    """A flag for each known value, for a missing value and for one that is not known."""
    own = F.transform(known, lambda w: F.coalesce(w == value, F.lit(False)))
    unknown = value.isNotNull() & ~F.coalesce(F.array_contains(known, value), F.lit(False))
    return F.concat(own, F.array(value.isNull(), unknown)).cast("array<double>")


def encoded(rows: DataFrame, state: DataFrame, numbers: list[str], categories: list[str], *keep: str) -> DataFrame:
    """keep columns; of every number <name>_scaled and <name>_missing; of every category <name>_hot, one flag for each value of
    the state, then one for missing and one for values that the state does not know."""
    out = []
    for c in numbers:
        x = observed_log(c)
        out += [((F.coalesce(x, F.col(f"mid_{c}")) - F.col(f"mean_{c}")) / F.col(f"scale_{c}")).alias(f"{c}_scaled"), F.col(c).isNull().cast("double").alias(f"{c}_missing")]
    for c in categories:
        out.append(one_hot(category(c), F.col(f"voc_{c}")).alias(f"{c}_hot"))
    return rows.crossJoin(F.broadcast(state)).select(*keep, *out)


def nearest_centroid(rows: DataFrame, centres: DataFrame, vector: str = "embedding", top: int = 3) -> DataFrame:
    """Squared distance to the nearest of few centres (id, centre), and the dimensions of the largest residuals.

    The centres are one small array on every row; rows never multiply.
    """
    few = centres.agg(F.collect_list(F.struct("id", "centre")).alias("_cs"))
    d = F.transform("_cs", lambda c: F.struct(F.aggregate(F.zip_with(vector, c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), c["id"].alias("id"), c["centre"].alias("centre")))
    best = rows.crossJoin(F.broadcast(few)).withColumn("_b", F.array_min(d)).drop("_cs")
    res = F.transform(F.col(vector), lambda x, i: F.struct((-F.pow(x - F.element_at("_b.centre", (i + 1).cast("int")), 2)).alias("r"), i.alias("i")))
    return best.withColumn("distance", F.col("_b.d")).withColumn("nearest", F.col("_b.id")).withColumn("top_dims", F.transform(F.slice(F.array_sort(res), 1, top), lambda s: s["i"])).drop("_b")
