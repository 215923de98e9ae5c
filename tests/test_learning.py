"""Encoded columns, contexts of nested folds, and the choice of candidates."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import features, splits


def test_encoded_columns(spark):
    fit = spark.createDataFrame([(0.0, "a", 1), (None, " b ", 2), (3.0, "", 3)], "n double, c string, k int")
    state = features.column_state(fit, ["n"], ["c"])
    rows = spark.createDataFrame([(1, None, "a"), (2, 0.0, "zz"), (3, 3.0, None), (4, 1.0, " ")], "k int, n double, c string")
    got = {r["k"]: r for r in features.encoded(rows, state, ["n"], ["c"], "k").collect()}
    # Logs are 0 and ln 4, the median ln 2 fills the third row, so that the mean is ln 2.
    assert [got[k]["c_hot"] for k in (1, 2, 3, 4)] == [[1, 0, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0], [0, 0, 1, 0]]
    assert [got[k]["n_missing"] for k in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert got[1]["n_scaled"] == pytest.approx(0) and got[4]["n_scaled"] == pytest.approx(0)
    assert got[3]["n_scaled"] == pytest.approx(1.5**0.5) and got[2]["n_scaled"] == pytest.approx(-(1.5**0.5))


def test_encoding_without_rows_or_spread(spark):
    none = spark.createDataFrame([], "n double, c string")
    one = spark.createDataFrame([(1.0, None)], "n double, c string")
    for fit, scaled in ((none, 0.693147), (one, 0.0)):
        r = features.encoded(one, features.column_state(fit, ["n"], ["c"]), ["n"], ["c"]).first()
        assert round(r["n_scaled"], 6) == scaled and r["c_hot"] == [1, 0]


@pytest.mark.parametrize("bad", [-1.0, float("nan"), float("inf")])
def test_numbers_that_block(spark, bad):
    with pytest.raises(Exception, match="not a finite number"):
        features.column_state(spark.createDataFrame([(bad,)], "n double"), ["n"], []).collect()


def test_too_many_encoded_columns(spark):
    with pytest.raises(ValueError, match="of 12 allowed"):
        features.column_state(spark.range(11).select(F.lit(1.0).alias("n"), F.col("id").cast("string").alias("c")), ["n"], ["c"], 12)


def test_contexts_keep_groups_whole(spark):
    rows = spark.range(300).select("id", F.concat(F.lit("g"), (F.col("id") % 40).cast("string")).alias("g"))
    got = {r["id"]: r["roles"] for r in rows.select("id", splits.context_roles("g").alias("roles")).collect()}
    assert {c for r in got.values() for c in r} == {"FINAL", *[f"OUTER_{o}" for o in range(3)], *[f"INNER_{o}_{i}" for o in range(3) for i in range(2)]}
    for i, r in got.items():
        assert r == got[i % 40] and r["FINAL"] == "FIT" and [r[f"OUTER_{o}"] for o in range(3)].count("SCORE") == 1
        for o in range(3):
            inner = sorted(r[c] for c in r if c.startswith(f"INNER_{o}"))
            assert inner == ([] if r[f"OUTER_{o}"] == "SCORE" else ["FIT", "SCORE"])
