"""Rarities by broadcast and by shuffled joins."""


def test_rarity_joins_each_field_by_its_own_number_of_counts(spark, monkeypatch):
    """where the ports had many values, services were dealt out by their few values too, and rows without a value went to one task."""
    from pyspark.sql import functions as F

    from tracemill.operators import features

    n = F.col("id")
    x = spark.range(600).select("id", F.when(n % 5 > 0, n % 3).alias("protocol_number"), F.when(n % 2 == 0, n % 90).alias("source_port"), F.when(n % 7 > 0, n % 40).alias("destination_port"), F.when(n % 4 > 0, F.concat(F.lit("s"), (n % 2).cast("string"))).alias("service"))
    counts = features.rarity_counts(x, n % 3 < 2)
    get = lambda: sorted(tuple(r) for r in features.with_rarity(x, counts).select("id", *features.RARE).collect())
    want = get()
    monkeypatch.setattr(features, "FEW_COUNTS", 20)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = features.with_rarity(x, counts)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 2
        assert get() == want
        monkeypatch.setattr(features, "FEW_COUNTS", 0)
        assert get() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
