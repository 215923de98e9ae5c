import pyarrow as pa

from tracemill.llm.common import bound_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_bound_batches_cuts_batches_and_keeps_all_rows(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', 400) as text").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    spark.conf.unset(KEY)
    try:
        bound_batches(spark, "1m")
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 3000 and len(got) > 4 and max(r.size for r in got) < 1_200_000
        bound_batches(spark, "9m")
        assert spark.conf.get(KEY) == "1m"  # a bound that is set stays
    finally:
        spark.conf.unset(KEY)
