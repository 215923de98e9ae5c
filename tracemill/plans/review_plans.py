"""Queries over reviewed records: status, bounds, agreement, comparison of scores, cases, chart counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frames, review, splits
from ..registry import query
from ..sources.shared import stored

STATUS = "CASE WHEN review_id IS NULL THEN 'NOT_SELECTED' WHEN blind_label IS NULL THEN 'PENDING' WHEN blind_label = 'UNCERTAIN' THEN 'REVIEWED_UNCERTAIN' ELSE 'REVIEWED_RESOLVED' END"
SIDES = [("tp", "TOP_50", "SUSPICIOUS"), ("fp", "TOP_50", "NOT_SUSPICIOUS"), ("fn", "COMPARISON", "SUSPICIOUS"), ("tn", "COMPARISON", "NOT_SUSPICIOUS"), ("open_top", "TOP_50", "UNCERTAIN"), ("open_other", "COMPARISON", "UNCERTAIN")]
MATRIX = "SELECT " + ", ".join(f"count(*) FILTER (WHERE membership = '{a}' AND blind_label = '{b}') AS {n}" for n, a, b in SIDES) + " FROM reviewed"
OVERLAP = "SELECT '{n}' AS name, count(*) FILTER (WHERE s AND f) AS \"both\", count(*) FILTER (WHERE s AND NOT f) AS selected_only, count(*) FILTER (WHERE NOT s AND f) AS flag_only, count(*) FILTER (WHERE NOT s AND NOT f) AS neither, round(count(*) FILTER (WHERE s AND f) / nullif(count(*) FILTER (WHERE s OR f), 0), 6) AS jaccard, round((count(*) FILTER (WHERE s AND f) / nullif(count(*) FILTER (WHERE s), 0)) / nullif(count(*) FILTER (WHERE f) / count(*), 0), 6) AS enrichment FROM (SELECT membership = 'TOP_50' AS s, {e} AS f FROM reviewed)"
FLAGS = {"rule": "rule_seen", "threat": "threat_seen", "any": "rule_seen OR threat_seen"}
RANKED = "SELECT *, row_number() OVER (ORDER BY score DESC, row_key) AS rk FROM reviewed"


@query("sf32_j19_review_status", "reviewed", sql=f"SELECT row_key, {STATUS} AS status FROM reviewed")
def sf32(x):
    return x.select("row_key", review.review_status("review_id", "blind_label").alias("status"))


@query("ag44_review_matrix", "reviewed", sql=f"SELECT status, n, round(n / sum(n) OVER (), 6) AS share, tp, fp, fn, tn FROM (SELECT {STATUS} AS status, count(*) AS n FROM reviewed GROUP BY 1), ({MATRIX})")
def ag44(x):
    n = x.groupBy(review.review_status("review_id", "blind_label").alias("status")).agg(F.count("*").alias("n"))
    m = review.review_matrix(x).select("tp", "fp", "fn", "tn")
    return n.crossJoin(F.broadcast(m)).select("status", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), "tp", "fp", "fn", "tn")  # four rows


@query("ag45_uncertainty_bounds", "reviewed", sql=f"WITH m AS ({MATRIX}), g AS (SELECT tp + a AS tp, fp + open_top - a AS fp, fn + b AS fn FROM m, range(0, (SELECT open_top + 1 FROM m)) r(a), range(0, (SELECT open_other + 1 FROM m)) q(b)) SELECT round(min(tp / nullif(tp + fp, 0)), 6) AS precision_low, round(max(tp / nullif(tp + fp, 0)), 6) AS precision_high, round(min(tp / nullif(tp + fn, 0)), 6) AS recall_low, round(max(tp / nullif(tp + fn, 0)), 6) AS recall_high, round(min(2 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS f1_low, round(max(2 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS f1_high, count(*) FILTER (WHERE tp + fp = 0 OR tp + fn = 0 OR 2 * tp + fp + fn = 0) > 0 AS undefined_possible FROM g")
def ag45(x):
    b = review.uncertainty_bounds(review.review_matrix(x))
    return b.select(*[F.round(f"{k}_{e}", 6).alias(f"{k}_{e}") for k in ("precision", "recall", "f1") for e in ("low", "high")], "undefined_possible")


@query("ag47_reference_agreement", "reviewed", sql=" UNION ALL ".join(OVERLAP.format(n=n, e=e) for n, e in FLAGS.items()))
def ag47(x):
    a = review.agreement(x, F.col("membership") == "TOP_50", {n: F.expr(e) for n, e in FLAGS.items()})
    return a.withColumns({c: F.round(c, 6) for c in ("jaccard", "enrichment")})


@query("ag61_group_shares", "reviewed", sql="SELECT group_id, count(*) FILTER (WHERE membership = 'TOP_50') AS selected, count(*) FILTER (WHERE membership <> 'TOP_50') AS others, round(100.0 * count(*) FILTER (WHERE membership = 'TOP_50') / (SELECT count(*) FROM reviewed WHERE membership = 'TOP_50'), 4) AS selected_pct, round(100.0 * count(*) FILTER (WHERE membership <> 'TOP_50') / (SELECT count(*) FROM reviewed WHERE membership <> 'TOP_50'), 4) AS others_pct FROM reviewed GROUP BY 1")
def ag61(x):
    return review.shares(x, F.col("membership") == "TOP_50", "group_id")


def behaviours():
    """Fixed order of families; a fallback where none is seen."""
    own = F.array_compact(F.array(F.when(F.col("rule_seen"), "RULE_PATTERN"), F.when(F.col("threat_seen"), "THREAT_PATTERN"), F.when(F.col("score") >= 3000, "VOLUME_PATTERN")))
    return F.when(F.size(own) == 0, F.array(F.lit("UNCLASSIFIED_ANOMALOUS_PATTERN"))).otherwise(own)


@query("sf31_ag62_behaviour_counts", "reviewed", sql="SELECT behaviour, count(*) AS n FROM (SELECT 'RULE_PATTERN' AS behaviour FROM reviewed WHERE rule_seen UNION ALL SELECT 'THREAT_PATTERN' FROM reviewed WHERE threat_seen UNION ALL SELECT 'VOLUME_PATTERN' FROM reviewed WHERE score >= 3000 UNION ALL SELECT 'UNCLASSIFIED_ANOMALOUS_PATTERN' FROM reviewed WHERE NOT rule_seen AND NOT threat_seen AND score < 3000) GROUP BY 1")
def ag62(x):
    return x.select(F.explode(behaviours()).alias("behaviour")).groupBy("behaviour").agg(F.count("*").alias("n"))


@query("ag36_package_summary", "reviewed", sql=f"SELECT membership, status, group_id, count(*) AS n, min(score) AS low, max(score) AS high FROM (SELECT *, {STATUS} AS status FROM reviewed) GROUP BY GROUPING SETS ((membership), (status), (group_id), (membership, status), ())")
def ag36(x):
    c = [F.col("membership"), F.col("status"), F.col("group_id")]
    y = x.withColumn("status", review.review_status("review_id", "blind_label"))
    return y.groupingSets([[c[0]], [c[1]], [c[2]], c[:2], []], *c).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


@query("ag49_score_comparison", "flows", sql="WITH h AS (SELECT record_number, raw_score AS a, CAST(sent_packets AS DOUBLE) AS b, ('0x' || substr(sha256(concat('session', session_id)), 1, 16))::UBIGINT % 10 < 8 AS ref FROM flows), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM h WHERE NOT ref) SELECT (SELECT count(*) FROM h WHERE NOT ref) AS n, round((SELECT corr(ra, rb) FROM r), 6) AS spearman, round((SELECT avg(CASE WHEN a > (SELECT quantile_disc(a, 0.99) FROM h WHERE ref) THEN 1.0 ELSE 0 END) FROM h WHERE NOT ref), 6) AS alerts_a, round((SELECT avg(CASE WHEN b > (SELECT quantile_disc(b, 0.99) FROM h WHERE ref) THEN 1.0 ELSE 0 END) FROM h WHERE NOT ref), 6) AS alerts_b")
def ag49(flows):
    from .flow_plans import is_ref

    h = stored(flows.select("record_number", F.col("raw_score").alias("a"), F.col("sent_packets").cast("double").alias("b"), is_ref().alias("ref")))
    held = h.filter("not ref")
    ranked = held
    for c in ("a", "b"):  # average rank of a value from its running count
        cum = frames.running_by_value(held, c, {"n": F.lit(1)}).select(c, (F.col("cum_n") - (F.col("n") - 1) / 2).alias(f"r{c}"))
        ranked = ranked.join(cum, c)
    cut = h.filter("ref").agg(F.expr("percentile_disc(0.99) within group (order by a)").alias("ca"), F.expr("percentile_disc(0.99) within group (order by b)").alias("cb"))
    rate = lambda c: F.round(F.avg((F.col(c) > F.col(f"c{c}")).cast("double")), 6).alias(f"alerts_{c}")
    return ranked.crossJoin(F.broadcast(cut)).agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("spearman"), rate("a"), rate("b"))


CASES = [("TOP_WITH_RULE", "rk <= 50 AND rule_seen"), ("TOP_WITHOUT_RULE", "rk <= 50 AND NOT rule_seen"), ("RULE_OUTSIDE_TOP", "rk > 50 AND rule_seen"), ("NEVER_MET", "score < 0")]


@query("sr12_case_studies", "reviewed", sql=f"WITH k AS ({RANKED}), a AS (SELECT row_key FROM k WHERE {CASES[0][1]} ORDER BY rk LIMIT 1), b AS (SELECT row_key FROM k WHERE {CASES[1][1]} ORDER BY rk LIMIT 1), c AS (SELECT row_key FROM k WHERE {CASES[2][1]} ORDER BY rk LIMIT 1), d AS (SELECT row_key FROM k WHERE row_key NOT IN (SELECT row_key FROM a UNION ALL SELECT row_key FROM b UNION ALL SELECT row_key FROM c) ORDER BY rk LIMIT 1) SELECT 1 AS \"case\", 'TOP_WITH_RULE' AS requested, 'TOP_WITH_RULE' AS actual, row_key FROM a UNION ALL SELECT 2, 'TOP_WITHOUT_RULE', 'TOP_WITHOUT_RULE', row_key FROM b UNION ALL SELECT 3, 'RULE_OUTSIDE_TOP', 'RULE_OUTSIDE_TOP', row_key FROM c UNION ALL SELECT 4, 'NEVER_MET', 'FALLBACK_NEXT_UNUSED_RANK', row_key FROM d")
def sr12(x):
    r = stored(frames.global_rank(x, [F.desc("score"), "row_key"], "rk"))
    return review.case_studies(r, "rk", "row_key", {n: F.expr(e) for n, e in CASES})


@query("sr5_so7_review_sample", "reviewed", sql="WITH k AS (SELECT row_key, score, row_number() OVER (ORDER BY score DESC, row_key) AS rk, sha256(concat('sample:', CAST(row_key AS STRING))) AS h, CASE WHEN score < 1000 THEN 'LOW' WHEN score < 3000 THEN 'MIDDLE' ELSE 'HIGH' END AS band FROM reviewed) SELECT row_key, 'TOP' AS role FROM k WHERE rk <= 50 UNION ALL SELECT row_key, 'COMPARISON' FROM (SELECT row_key, row_number() OVER (PARTITION BY band ORDER BY h) AS rn FROM k WHERE rk > 50) WHERE rn <= 10")
def sr5(x):
    top = x.orderBy(F.desc("score"), "row_key").limit(50).select("row_key", F.lit("TOP").alias("role"))
    band = F.when(F.col("score") < 1000, "LOW").when(F.col("score") < 3000, "MIDDLE").otherwise("HIGH")
    rest = x.join(top.select("row_key"), "row_key", "left_anti").select("row_key", band.alias("band"), F.sha2(F.concat(F.lit("sample:"), F.col("row_key").cast("string")), 256).alias("h"))
    return top.unionByName(frames.top_per_group(rest, ["band"], ["h"], 10).select("row_key", F.lit("COMPARISON").alias("role")))


RANKED = "(SELECT row_key, r, CASE WHEN row_key % 37 = 0 THEN r + 1 ELSE r END AS kept FROM (SELECT row_key, row_number() OVER (ORDER BY score DESC, row_key) AS r FROM reviewed))"


@query("ag65_au20_rank_diagnostics", "reviewed", sql=f"SELECT count(*) AS n, count(DISTINCT kept) AS ranks, CAST(min(kept) AS BIGINT) AS low, CAST(max(kept) AS BIGINT) AS high, min(kept) = 1 AND max(kept) = count(*) AND count(DISTINCT kept) = count(*) AS contiguous, count(*) FILTER (WHERE kept <> r) AS differing FROM {RANKED}")
def ag65(x):
    """Diagnostics of kept ranks, some of which are planted faults, and how many differ from the recomputed ones."""
    r = frames.global_rank(x, [F.desc("score"), "row_key"], "rk").withColumn("kept", F.when(F.col("row_key") % 37 == 0, F.col("rk") + 1).otherwise(F.col("rk")))
    d = r.agg(F.count("*").alias("n"), F.countDistinct("kept").alias("ranks"), F.min("kept").cast("bigint").alias("low"), F.max("kept").cast("bigint").alias("high"), F.count_if(F.col("kept") != F.col("rk")).alias("differing"))
    return d.withColumn("contiguous", (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("ranks") == F.col("n")))


@query("j21_two_passes", "reviewed", sql="SELECT row_key, CASE WHEN a IS NULL OR b IS NULL THEN 'REVIEW_INCOMPLETE' WHEN a = b THEN 'AGREE' ELSE 'DISAGREE' END AS outcome FROM (SELECT row_key, blind_label AS a, CASE WHEN row_key % 6 = 0 THEN 'UNCERTAIN' WHEN row_key % 8 = 0 THEN NULL ELSE blind_label END AS b FROM reviewed WHERE review_id IS NOT NULL)")
def j21(x):
    """Decisions of two passes, one row a pass and record, paired by one pivot."""
    due = x.filter("review_id is not null")
    first = due.select("row_key", F.lit("PASS_A").alias("pass_id"), F.col("blind_label").alias("decision"))
    again = F.when(F.col("row_key") % 6 == 0, "UNCERTAIN").when(F.col("row_key") % 8 == 0, None).otherwise(F.col("blind_label"))
    decisions = first.unionByName(due.select("row_key", F.lit("PASS_B").alias("pass_id"), again.alias("decision")))
    return review.paired_passes(decisions, "row_key")


@query("au14_so4_label_set", "reviewed", "labels", sql="SELECT 'unknown' AS fault, doc_id AS key FROM labels WHERE doc_id NOT IN (SELECT row_key FROM reviewed WHERE review_id IS NOT NULL) UNION ALL SELECT 'pending', row_key FROM reviewed WHERE review_id IS NOT NULL AND blind_label IS NULL UNION ALL SELECT 'repeated', doc_id FROM labels GROUP BY 2 HAVING count(*) > 1")
def au14(x, labels):
    due = x.filter("review_id is not null")
    unknown = labels.join(due.select(F.col("row_key").alias("doc_id")), "doc_id", "left_anti").select(F.lit("unknown").alias("fault"), F.col("doc_id").alias("key"))
    pending = due.filter("blind_label is null").select(F.lit("pending").alias("fault"), F.col("row_key").alias("key"))
    twice = labels.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated").alias("fault"), F.col("doc_id").alias("key"))
    return unknown.unionByName(pending).unionByName(twice)


@query("ag50_feasibility", "flows", sql="WITH g AS (SELECT session_id, count(*) AS n, CASE WHEN b <= 6999 THEN 'TRAIN' WHEN b <= 8499 THEN 'VALIDATION' ELSE 'TEST' END AS part FROM (SELECT session_id, ('0x' || substr(sha256(session_id), 1, 16))::UBIGINT % 10000 AS b FROM flows) GROUP BY ALL), s AS (SELECT p, w, coalesce(CAST(sum(n) AS BIGINT), 0) AS n FROM (VALUES ('TRAIN', 0.7), ('VALIDATION', 0.15), ('TEST', 0.15)) v(p, w) LEFT JOIN g ON part = p GROUP BY ALL) SELECT 'GROUPS' AS \"check\", CAST(count(*) AS DOUBLE) AS actual, count(*) >= 500 AS passed FROM g UNION ALL SELECT 'ROWS_' || p, CAST(n AS DOUBLE), n >= 1500 FROM s UNION ALL SELECT 'SHARE_' || p, round(n / (SELECT sum(n) FROM g), 6), abs(n / (SELECT sum(n) FROM g) - w) <= 0.02 FROM s UNION ALL SELECT 'LARGEST_GROUP', round(max(n) / sum(n), 6), max(n) / sum(n) <= 0.1 FROM g")
def ag50(flows):
    from ..functions import scalars as S

    b = S.hash_bucket("session_id", 10000)
    x = flows.select("session_id", F.when(b <= 6999, "TRAIN").when(b <= 8499, "VALIDATION").otherwise("TEST").alias("part"))
    return splits.feasibility(x, "session_id", "part", {"TRAIN": 0.7, "VALIDATION": 0.15, "TEST": 0.15}, 500, 1500).withColumn("actual", F.round("actual", 6))


@query("ag55_g9_crossings", "flows", sql="WITH x AS (SELECT *, ('0x' || substr(sha256(session_id), 1, 16))::UBIGINT % 2 AS p FROM flows) SELECT 'session_id' AS key, count(*) FILTER (WHERE d > 1) AS crossings FROM (SELECT session_id, count(DISTINCT p) AS d FROM x GROUP BY 1) UNION ALL SELECT 'destination_port', count(*) FILTER (WHERE d > 1) FROM (SELECT destination_port, count(DISTINCT p) AS d FROM x WHERE destination_port IS NOT NULL GROUP BY 1)")
def ag55(flows):
    from ..functions import scalars as S

    return splits.groups_crossing(flows.withColumn("part", S.hash_bucket("session_id", 2)), ["session_id", "destination_port"], "part")


CUM = "SELECT session_id, n, CAST(sum(n) OVER (ORDER BY sha256(concat('split:', session_id))) AS BIGINT) AS c, row_number() OVER (ORDER BY sha256(concat('split:', session_id))) AS b, (SELECT count(*) FROM flows) AS t, count(*) OVER () AS k FROM (SELECT session_id, count(*) AS n FROM flows GROUP BY 1)"
PAIRS = "SELECT x.b AS b1, z.b AS b2 FROM c x JOIN c z ON z.b > x.b WHERE x.c >= 3072 AND z.b < x.k AND abs(100 * x.c - 80 * x.t) <= 2 * x.t AND abs(100 * (z.c - x.c) - 10 * x.t) <= 2 * x.t AND abs(100 * (x.t - z.c) - 10 * x.t) <= 2 * x.t ORDER BY abs(100 * x.c - 80 * x.t), abs(100 * (z.c - x.c) - 10 * x.t), abs(100 * (x.t - z.c) - 10 * x.t), b1, b2 LIMIT 1"


@query("w9_j18_contiguous_split", "flows", sql=f"WITH c AS ({CUM}), p AS ({PAIRS}) SELECT session_id, n, CASE WHEN b <= b1 THEN 'TRAIN' WHEN b <= b2 THEN 'CALIBRATION' ELSE 'COMPARISON' END AS part FROM c, p")
def w9(flows):
    return splits.boundary_split(flows.groupBy("session_id").agg(F.count("*").alias("n")), "session_id", "n")


SNAKE = "CASE WHEN ({0} - 1) % {2} < {1} THEN ({0} - 1) % {2} ELSE {2} - 1 - ({0} - 1) % {2} END"
FOLDS = f"g AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE protocol_number = 6) AS ones FROM flows GROUP BY 1), o AS (SELECT *, CAST({SNAKE.format("rn", 3, 6)} AS INTEGER) AS outer_fold FROM (SELECT *, row_number() OVER (ORDER BY n DESC, sha256(concat('outer:', session_id))) AS rn FROM g)), i AS (SELECT session_id, x, CAST({SNAKE.format("rn", 2, 4)} AS INTEGER) AS inner_fold FROM (SELECT session_id, x, row_number() OVER (PARTITION BY x ORDER BY n DESC, sha256(concat('inner:', x, ':', session_id))) AS rn FROM o, (VALUES (0), (1), (2)) v(x) WHERE x <> outer_fold))"


@query("g7_nested_folds", "flows", sql=f"WITH {FOLDS} SELECT o.session_id, outer_fold, x AS context, inner_fold FROM o JOIN i ON o.session_id = i.session_id")
def g7_nested(flows):
    """The outer fold of every session, and its inner fold in each outer context that trains on it."""
    f = splits.nested_folds(flows.groupBy("session_id").agg(F.count("*").alias("n")), "session_id", "n")
    return f.select("session_id", "outer_fold", F.explode("inner_folds").alias("context", "inner_fold"))


@query("ag55_fold_support", "flows", sql=f"WITH {FOLDS}, s AS (SELECT concat('OUTER_', x) AS context_id, n, ones, outer_fold = x AS test FROM o, (VALUES (0), (1), (2)) v(x) UNION ALL SELECT concat('INNER_', x, '_', y), n, ones, inner_fold = y FROM i JOIN g ON g.session_id = i.session_id, (VALUES (0), (1)) w(y)), c AS (SELECT context_id, CAST(sum(n) FILTER (WHERE test) AS BIGINT) AS rows, count(*) FILTER (WHERE test) AS groups, CAST(sum(n - ones) FILTER (WHERE test) AS BIGINT) AS n0, CAST(sum(ones) FILTER (WHERE test) AS BIGINT) AS n1, CAST(sum(n) FILTER (WHERE NOT test) AS BIGINT) AS train_rows, CAST(sum(n - ones) FILTER (WHERE NOT test) AS BIGINT) AS train0, CAST(sum(ones) FILTER (WHERE NOT test) AS BIGINT) AS train1 FROM s GROUP BY 1) SELECT *, least(rows, train_rows) >= 2048 AND least(n0, n1, train0, train1) > 0 AS passed FROM c")
def ag55_support(flows):
    """Rows, groups and classes on either side of every outer and inner fold, and whether they suffice."""
    x = flows.select("session_id", (F.col("protocol_number") == 6).cast("int").alias("label"))
    folds = splits.nested_folds(x.groupBy("session_id").agg(F.count("*").alias("n")), "session_id", "n")
    return splits.fold_support(x, "session_id", "label", folds, least=2048)


@query("sr14_first_groups", "flows", sql="SELECT record_number FROM flows WHERE session_id IN (SELECT session_id FROM (SELECT session_id, sum(n) OVER (ORDER BY f) AS c FROM (SELECT session_id, min(record_number) AS f, count(*) AS n FROM flows GROUP BY 1)) WHERE c <= 2000)")
def sr14(flows):
    return splits.first_groups(flows, "session_id", "record_number", 2000).select("record_number")


@query("sr8_allocation", "labelled_scores", sql="WITH s AS (SELECT CASE WHEN score < 1000 THEN 'SHORT' WHEN score < 3000 THEN 'MIDDLE' ELSE 'LONG' END AS stratum, count(*) AS n FROM labelled_scores GROUP BY 1), r AS (SELECT *, least(60, sum(n) OVER ()) AS goal, 0.5::DOUBLE * least(60, sum(n) OVER ()) * (n / sum(n) OVER ()) + 0.5::DOUBLE * least(60, sum(n) OVER ()) / count(*) OVER () AS raw FROM s), b AS (SELECT *, least(n, floor(raw)) AS base FROM r) SELECT stratum, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY floor(raw) - raw, stratum) <= goal - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS take FROM b")
def sr8(x):
    s = x.groupBy(F.when(F.col("score") < 1000, "SHORT").when(F.col("score") < 3000, "MIDDLE").otherwise("LONG").alias("stratum")).agg(F.count("*").alias("n"))
    return splits.allocate(s, 60)


@query("j11_j12_so6_overlap_flags", "flows", sql="WITH t AS (SELECT *, ('0x' || substr(sha256(session_id), 1, 16))::UBIGINT % 2 = 0 AS train FROM flows) SELECT record_number, coalesce(service, '') || ':' || coalesce(CAST(destination_port AS STRING), '') IN (SELECT coalesce(service, '') || ':' || coalesce(CAST(destination_port AS STRING), '') FROM t WHERE train) AS in_target, CAST(sent_packets AS STRING) || ':' || CAST(received_bytes // 1000 AS STRING) IN (SELECT CAST(sent_packets AS STRING) || ':' || CAST(received_bytes // 1000 AS STRING) FROM t WHERE train) AS in_volume FROM t WHERE NOT train")
def j11(flows):
    from ..functions import scalars as S

    t = flows.withColumn("_p", S.hash_bucket("session_id", 2))
    text = lambda *c: F.sha2(F.concat_ws(":", *[F.coalesce(F.expr(x).cast("string"), F.lit("")) for x in c]), 256)
    flags = splits.overlap_flags(t.filter("_p = 1"), t.filter("_p = 0"), {"target": text("service", "destination_port"), "volume": text("sent_packets", "received_bytes div 1000")})
    return flags.select("record_number", "in_target", "in_volume")
