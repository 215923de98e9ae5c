"""Canonical JSON, key scans and the order of records in files."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import canon, jsonkeys
from tracemill.sources import files

DOUBLES = [0.0, -0.0, 1.0, -1.5, 0.1, 2.4000000000000004, 1e-3, 1.5e-4, 1e-4, 9.9e-5, 1e-5, 1.25e-7, 1e7, 12345678.9, 1.0e15, 123456789012345680.0, 1e16, 1.5e16, 1e22, 1e100, 1.7976931348623157e308, 5e-324, 123456789.0, 9999999999999998.0]


def canonical(v):
    return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def test_numbers(spark):
    r = random.Random(2)
    values = DOUBLES + [r.uniform(-1, 1) * 10 ** r.randint(-12, 20) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [x[0] for x in df.select(F.expr(canon.double_sql("v"))).collect()]
    assert got == [json.dumps(v) for v in values]
    for bad in (math.nan, math.inf):
        with pytest.raises(Exception, match="no JSON form"):
            spark.createDataFrame([(bad,)], "v double").select(F.expr(canon.double_sql("v"))).collect()


SCHEMA = "b struct<z: string, a: array<struct<y: int, x: double>>>, a map<string, array<boolean>>, e map<string, string>, c long"


def nested():
    odd = ['quote " and \\ back', "tab\tnew\nline\r\b\f", "\x00\x01\x1f", "é 日本 😀", "", "\\u001F", None, "</script>", "\x7f"]
    rows = [({"z": t, "a": [{"y": i, "x": i / 7}, None, {"y": None, "x": None}]}, {"k2": [True, None], "k1": [], "K": None}, {'q"': t, "a": "b"}, i) for i, t in enumerate(odd)]
    return rows + [(None, None, None, None), ({"z": None, "a": None}, {}, {}, -(2**63))]


def test_nested_values(spark):
    df = spark.createDataFrame(nested(), SCHEMA)
    got = [r[0] for r in df.select(canon.row_json(df.schema)).collect()]
    assert got == [canonical(dict(zip(("b", "a", "e", "c"), row, strict=True))) for row in nested()]


def test_only_canonical_texts_are_rebuilt(spark):
    df = spark.createDataFrame([(1, [2, 3], {"k": "v"})], "b int, a array<int>, c map<string,string>")
    good = '{"a":[2,3],"b":1,"c":{"k":"v"}}'
    bad = ['{"b":1,"a":[2,3],"c":{"k":"v"}}', '{"a":[2,3],"b":1}', '{"a":[2,3],"b":1,"c":{"k":"v"},"d":0}', '{"a":[2,3],"b":"1","c":{"k":"v"}}', '{"a":[2,3],"b":1,"b":1,"c":{"k":"v"}}', '{"a":[2, 3],"b":1,"c":{"k":"v"}}', "", "{", None]
    texts = spark.createDataFrame([(t,) for t in [good, *bad]], "t string")
    got = [r[0] for r in texts.select(canon.rebuilt("t", df.schema).isNotNull()).collect()]
    assert got == [True] + [False] * len(bad)


def test_keys():
    f = frozenset({"label", "top_n"})
    assert jsonkeys.key_faults('{"a":{"Top-N":1,"b":[{"x":1,"x":{"LABEL":2}},3]},"a":0,"a":1}', f) == [("FORBIDDEN", "/a/Top-N"), ("FORBIDDEN", "/a/b/0/x/LABEL"), ("REPEATED", "/a"), ("REPEATED", "/a/b/0/x")]
    assert jsonkeys.key_faults('{"\\u006cabel":1}', f) == [("FORBIDDEN", "/label")]
    assert jsonkeys.key_faults('["label","label"]', f) == [] and jsonkeys.key_faults("{", f) == [("INVALID", "")]
    assert jsonkeys.key_faults("[" * 200_000, f) == [("INVALID", "")]


def test_scan_of_a_column(spark):
    df = spark.createDataFrame([(1, '{"label":1}'), (2, None), (3, "{}"), (4, '{"a":1,"a":2}')], "id long, t string")
    assert sorted(map(tuple, jsonkeys.scanned(df, "id", "t", {"label"}).collect())) == [(1, "FORBIDDEN", "/label"), (4, "REPEATED", "/a")]
    assert jsonkeys.scanned(df.limit(0), "id", "t", {"label"}).count() == 0


def lines(path, numbers):
    path.write_text("".join(json.dumps({"n": n, "pad": "x" * 200}) + "\n" for n in numbers))


def test_a_swapped_pair_is_found_across_files_and_splits(spark, tmp_path):
    numbers = list(range(1, 2001))
    numbers[700], numbers[701] = numbers[701], numbers[700]
    (tmp_path / "x").mkdir()
    lines(tmp_path / "x" / "part-0.json", [*numbers[:1000], 1500])  # the next file begins below it
    lines(tmp_path / "x" / "part-1.json", [*numbers[1000:], 2000])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "16k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = sorted((r["value"], r["previous"]) for r in files.order_faults(spark, f"file://{tmp_path}/x", ("n", "bigint")).collect())
        assert got == [(701, 702), (1001, 1500), (2000, 2000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_records_without_a_number(spark, tmp_path):
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "a.json").write_text('{"n":1}\n{"m":2}\n{"n":2}\n')
    assert [tuple(r)[1:] for r in files.order_faults(spark, f"file://{tmp_path}/y", ("n", "bigint")).collect()] == [(None, 1)]


def test_values_are_compared_and_rebuilt_as_their_texts(spark):
    df = spark.createDataFrame(nested(), SCHEMA).withColumn("json", canon.row_json(spark.createDataFrame([], SCHEMA).schema))
    kind = df.drop("json").schema
    back = canon.with_rebuilt(df, "json", kind, "j")
    same = [canon.same_text(f"`{f.name}`", f"j.`{f.name}`", f.dataType) for f in kind.fields]
    assert all(all(r) for r in back.select(*same).collect())
    texts = spark.createDataFrame([('{"c":1}',), ('{"c":1,"d":2}',), ("null",), (None,)], "t string")
    got = [r["j"] for r in canon.with_rebuilt(texts, "t", spark.createDataFrame([], "c int").schema, "j").collect()]
    assert got[0]["c"] == 1 and got[1:] == [None, None, None]


def test_listed_values_need_no_interpreted_filter(spark):
    from tracemill.functions import scalars

    x = spark.range(3).select(scalars.listed((F.col("id") > 0, F.struct(F.lit("a").alias("n"))), (F.col("id") > 1, F.struct(F.lit("b").alias("n"))), (F.lit(None).cast("boolean"), F.struct(F.lit("c").alias("n")))).alias("x"))
    assert [[e["n"] for e in r["x"]] for r in x.orderBy(F.size("x")).collect()] == [[], ["a"], ["a", "b"]]
    assert "lambda" not in x._jdf.queryExecution().optimizedPlan().toString()
