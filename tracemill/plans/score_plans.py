"""Queries over scores and labels: ranks, metrics, thresholds, review samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import frames, metrics
from ..registry import query

REF = "('0x' || substr(sha256(CAST(row_key AS STRING)), 1, 16))::UBIGINT % 10 < 8"
RANKED = "SELECT *, row_number() OVER (ORDER BY score DESC, row_key) AS rk FROM labelled_scores"
PCT = f"SELECT row_key, score, 100.0 * (SELECT count(*) FROM labelled_scores b WHERE b.score <= a.score AND {REF.replace('row_key', 'b.row_key')}) / (SELECT count(*) FROM labelled_scores WHERE {REF}) AS percentile FROM labelled_scores a"
CM = "count(*) FILTER (WHERE score >= 2000 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 2000 AND label <> 1) AS fp, count(*) FILTER (WHERE score < 2000 AND label = 1) AS fn, count(*) FILTER (WHERE score < 2000 AND label <> 1) AS tn"
CURVE = "SELECT score, CAST(sum(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)) OVER (ORDER BY score DESC) AS BIGINT) AS cum_p, CAST(sum(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END)) OVER (ORDER BY score DESC) AS BIGINT) AS cum_n, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS p, CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS n FROM labelled_scores GROUP BY score"


def is_ref():
    return S.hash_bucket(F.col("row_key").cast("string"), 10) < 8


@query("w1_sr2_rank", "labelled_scores", sql=f"SELECT row_key, rk, rk <= 50 AS selected FROM ({RANKED})")
def w1(x):
    return frames.global_rank(x, [F.desc("score"), "row_key"], "rk").select("row_key", F.col("rk").cast("bigint").alias("rk"), (F.col("rk") <= 50).alias("selected"))


@query("w2_reference_percentile", "labelled_scores", sql=f"SELECT row_key, round(percentile, 6) AS percentile FROM ({PCT})")
def w2(x):
    return frames.reference_percentile(x, "score", is_ref()).select("row_key", F.round("percentile", 6).alias("percentile"))


@query("sf25_ag33_bands", "labelled_scores", sql=f"SELECT CASE WHEN percentile >= 99.9 THEN 'TOP_0_1' WHEN percentile >= 99 THEN 'TOP_1' WHEN percentile >= 95 THEN 'TOP_5' ELSE 'BASELINE' END AS band, count(*) AS n, count(DISTINCT score) AS scores FROM ({PCT}) GROUP BY 1")
def sf25(x):
    p = frames.reference_percentile(x, "score", is_ref())
    return p.groupBy(S.anomaly_band("percentile").alias("band")).agg(F.count("*").alias("n"), F.countDistinct("score").alias("scores"))


@query("w3_sf29_priority_rank", "labelled_scores", sql=f"SELECT row_key, row_number() OVER (ORDER BY priority DESC, row_key) AS place FROM (SELECT row_key, round(least(100, 0.9 * percentile + 10 * coalesce(label, 0)), 6) AS priority FROM ({PCT}) JOIN (SELECT row_key, label FROM labelled_scores) USING (row_key))")
def w3(x):
    p = frames.reference_percentile(x, "score", is_ref()).withColumn("priority", S.priority("percentile", F.coalesce("label", F.lit(0))))
    return frames.global_rank(p, [F.desc("priority"), "row_key"], "place").select("row_key", F.col("place").cast("bigint").alias("place"))


@query("pf28_ag35_triage", "labelled_scores", sql=f"SELECT triage, source, count(*) AS n FROM (SELECT CASE WHEN rk <= 50 THEN 'HIGH' WHEN percentile >= 95 THEN 'MEDIUM' ELSE 'LOW' END AS triage, group_id AS source FROM ({RANKED}) JOIN (SELECT row_key, percentile FROM ({PCT})) USING (row_key)) GROUP BY GROUPING SETS ((triage), (source), ())")
def pf28(x):
    r = frames.global_rank(frames.reference_percentile(x, "score", is_ref()), [F.desc("score"), "row_key"], "rk")
    t = r.select(F.when(F.col("rk") <= 50, "HIGH").when(F.col("percentile") >= 95, "MEDIUM").otherwise("LOW").alias("triage"), F.col("group_id").alias("source"))
    return t.groupingSets([[F.col("triage")], [F.col("source")], []], "triage", "source").agg(F.count("*").alias("n"))


@query("ag34_quantiles", "labelled_scores", sql="SELECT round(quantile_cont(score, 0.05), 6) AS q05, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.95), 6) AS q95 FROM labelled_scores")
def ag34(x):
    q = frames.quantile_cont(x, "score", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    return q.select(*[F.round(n, 6).alias(n) for n in q.columns])


@query("ag37_ag60_histogram", "labelled_scores", sql="SELECT CAST(b AS BIGINT) AS bin, count(score) AS n FROM range(0, 10) r(b) LEFT JOIN labelled_scores ON least(9, floor(score / 1000)) = b GROUP BY 1")
def ag37(x):
    bins = x.sparkSession.range(10).select(F.col("id").alias("bin"))
    n = x.groupBy(F.least(F.lit(9), F.floor(F.col("score") / 1000)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("ag38_ag39_rates", "labelled_scores", sql=f"SELECT tp, fp, fn, tn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (SELECT {CM} FROM labelled_scores)")
def ag38(x):
    r = metrics.rates(metrics.confusion(x, F.col("score") >= 2000))
    return r.select("tp", "fp", "fn", "tn", *[F.round(k, 6).alias(k) for k in ("accuracy", "precision", "recall", "f1")])


@query("ag39_supervised_zero", "labelled_scores", sql="SELECT CAST(coalesce(count(*) FILTER (WHERE score > 1e12 AND label = 1) / nullif(count(*) FILTER (WHERE score > 1e12), 0), 0) AS DOUBLE) AS precision, CAST(coalesce(count(*) FILTER (WHERE score > 1e12 AND label = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 0) AS DOUBLE) AS recall FROM labelled_scores")
def ag39(x):
    return metrics.rates(metrics.confusion(x, F.col("score") > 1e12), 0.0).select("precision", "recall")


@query("ag40_average_precision", "labelled_scores", sql=f"SELECT round(sum(CAST(p AS DOUBLE) * cum_p / (cum_p + cum_n)) / sum(p), 6) AS ap FROM ({CURVE})")
def ag40(x):
    return metrics.average_precision(x).select(F.round("ap", 6).alias("ap"))


@query("ag41_roc_auc", "labelled_scores", sql="SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM labelled_scores a, labelled_scores b WHERE a.label = 1 AND b.label = 0")
def ag41(x):
    return metrics.roc_auc(x).select(F.round("auc", 6).alias("auc"))


@query("ag42_curve", "labelled_scores", sql=f"SELECT score, cum_p, cum_n FROM ({CURVE})")
def ag42(x):
    return metrics.curve(x).select("score", "cum_p", "cum_n")


@query("ag43_subset_matrix", "labelled_scores", sql=f"SELECT {CM} FROM labelled_scores WHERE label2 = 1")
def ag43(x):
    return metrics.confusion(x.filter("label2 = 1"), F.col("score") >= 2000)


@query("w8_threshold", "labelled_scores", sql=f"SELECT score AS threshold, round(f1, 6) AS f1 FROM (SELECT score, 2.0 * cum_p / (cum_p + cum_n + (SELECT count(*) FROM labelled_scores WHERE label = 1)) AS f1 FROM ({CURVE})) ORDER BY f1 DESC, score DESC LIMIT 1")
def w8(x):
    return metrics.best_threshold(x).select("threshold", F.round("f1", 6).alias("f1"))


@query("ml14_compare_pair", "labelled_scores", sql=f"SELECT CASE WHEN abs(a - b) <= 1e-6 THEN 'TIE' WHEN a > b THEN 'FIRST' ELSE 'SECOND' END AS choice FROM (SELECT (SELECT sum(CAST(p AS DOUBLE) * cum_p / (cum_p + cum_n)) / sum(p) FROM ({CURVE})) AS a, (SELECT sum(CAST(p AS DOUBLE) * cum_p / (cum_p + cum_n)) / sum(p) FROM ({CURVE.replace('labelled_scores', '(SELECT -score AS score, label FROM labelled_scores)')})) AS b)")
def ml14(x):
    a = metrics.average_precision(x).select(F.col("ap").alias("a"))
    b = metrics.average_precision(x.withColumn("score", -F.col("score"))).select(F.col("ap").alias("b"))
    return a.crossJoin(b).select(F.when(F.abs(F.col("a") - F.col("b")) <= 1e-6, "TIE").when(F.col("a") > F.col("b"), "FIRST").otherwise("SECOND").alias("choice"))


@query("ag46_precision_at", "labelled_scores", sql=f"SELECT k, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) / k AS precision FROM ({RANKED}), (SELECT unnest([10, 20, 50]) AS k) WHERE rk <= k GROUP BY k")
def ag46(x):
    top = x.orderBy(F.desc("score"), "row_key").limit(50).withColumn("rk", F.row_number().over(Window.orderBy(F.desc("score"), "row_key")))  # 50 rows
    return top.withColumn("k", F.explode(F.array(F.lit(10), F.lit(20), F.lit(50)))).filter("rk <= k").groupBy("k").agg((F.count_if(F.col("label") == 1) / F.first("k")).alias("precision"))


@query("ag48_so5_jaccard", "labelled_scores", sql=f"WITH a AS (SELECT row_key FROM labelled_scores ORDER BY score DESC, row_key LIMIT 50), b AS (SELECT row_key FROM labelled_scores ORDER BY score % 1000 DESC, row_key LIMIT 50) SELECT round(CAST((SELECT count(*) FROM a JOIN b USING (row_key)) AS DOUBLE) / (SELECT count(*) FROM (SELECT row_key FROM a UNION SELECT row_key FROM b)), 6) AS jaccard")
def ag48(x):
    a = x.orderBy(F.desc("score"), "row_key").limit(50).select("row_key", F.lit(1).alias("s"))
    b = x.orderBy(F.desc(F.col("score") % 1000), "row_key").limit(50).select("row_key", F.lit(2).alias("s"))
    return a.unionByName(b).groupBy("row_key").agg(F.count("*").alias("c")).agg(F.round(F.count_if(F.col("c") == 2) / F.count("*"), 6).alias("jaccard"))


@query("ag53_target_conflicts", "labelled_scores", sql="SELECT score, count(*) AS n, min(label) AS lo, max(label) AS hi FROM labelled_scores GROUP BY 1 HAVING count(DISTINCT label) > 1")
def ag53(x):
    return x.groupBy("score").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.countDistinct("label").alias("d")).filter("d > 1").drop("d")


@query("ag52_leakage", "labelled_scores", sql="SELECT label, min(score) AS lo, max(score) AS hi, count(DISTINCT score) AS d FROM labelled_scores GROUP BY 1")
def ag52(x):
    return x.groupBy("label").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.countDistinct("score").alias("d"))


@query("sr5_sr6_sr9_hash_sample", "labelled_scores", sql="SELECT row_key, sha256(concat('seed:', CAST(row_key AS STRING))) AS h FROM labelled_scores ORDER BY h LIMIT 40")
def sr9(x):
    return x.select("row_key", F.sha2(F.concat(F.lit("seed:"), F.col("row_key").cast("string")), 256).alias("h")).orderBy("h").limit(40)


@query("sr7_sr8_allocation", "labelled_scores", sql="SELECT stratum, n, CAST(floor(60 * (0.5 * n / sum(n) OVER () + 0.5 / count(*) OVER ())) AS BIGINT) AS base FROM (SELECT CASE WHEN score < 1000 THEN 'SHORT' WHEN score < 3000 THEN 'MIDDLE' ELSE 'LONG' END AS stratum, count(*) AS n FROM labelled_scores GROUP BY 1)")
def sr8(x):
    s = x.groupBy(F.when(F.col("score") < 1000, "SHORT").when(F.col("score") < 3000, "MIDDLE").otherwise("LONG").alias("stratum")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row a stratum
    return s.withColumn("base", F.floor(60 * (0.5 * F.col("n") / F.sum("n").over(every) + 0.5 / F.count("*").over(every))).cast("bigint"))


@query("so1_so2_so3_sets", "labelled_scores", sql="SELECT count(*) FILTER (WHERE row_key % 17 = 0 AND row_key % 5 = 1) AS overlap, count(*) FILTER (WHERE row_key % 17 <> 0 AND row_key % 5 <> 1 AND row_key % 3 <> 0) AS uncovered FROM labelled_scores")
def so1(x):
    """Two sets that overlap and leave rows uncovered, by planted membership."""
    fit, held = x.filter("row_key % 17 = 0 or row_key % 3 = 0 and row_key % 5 <> 1").select("row_key"), x.filter("row_key % 5 = 1").select("row_key")
    both = fit.join(held, "row_key", "left_semi").agg(F.count("*").alias("overlap"))
    return both.crossJoin(x.select("row_key").exceptAll(fit.unionByName(held).distinct()).agg(F.count("*").alias("uncovered")))


@query("au23_au16_row_violations", "labelled_scores", sql="SELECT 'bad_label' AS \"check\", CAST(row_key AS STRING) AS key FROM labelled_scores WHERE label NOT IN (0, 1) UNION ALL SELECT 'short', CAST(row_key AS STRING) FROM labelled_scores WHERE score < 300")
def au16(x):
    return frames.violations(x, "row_key", bad_label=~F.col("label").isin(0, 1), short=F.col("score") < 300)


@query("rp2_metric_table", "labelled_scores", sql=f"SELECT 'tp' AS metric, CAST(tp AS DOUBLE) AS value FROM (SELECT {CM} FROM labelled_scores) UNION ALL SELECT 'fp', CAST(fp AS DOUBLE) FROM (SELECT {CM} FROM labelled_scores) UNION ALL SELECT 'fn', CAST(fn AS DOUBLE) FROM (SELECT {CM} FROM labelled_scores)")
def rp2(x):
    m = metrics.confusion(x, F.col("score") >= 2000).select(*[F.col(k).cast("double") for k in ("tp", "fp", "fn")])
    return m.unpivot([], ["tp", "fp", "fn"], "metric", "value")
