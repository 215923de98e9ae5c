import math
import random
from collections import Counter

import duckdb
import numpy as np

from tracemill.llm import op12_embedding_join as op

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, threshold=0.98):
    def fine(label, e):
        return label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)

    ok = [i for i, (_, label, e) in enumerate(rows) if fine(label, e)]
    unit = {}
    for i in ok:
        x = np.float32(rows[i][2]).astype(float)
        x = x / np.abs(x).max()
        unit[i] = x / math.sqrt(float(x @ x))
    root, links = list(range(len(rows))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ok)):
        for b in range(a):
            i, j = ok[a], ok[b]
            if rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]) and float(unit[i] @ unit[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            low[find(i)] = min(low.get(find(i), v), v)
    return Counter((v, links[i], low.get(find(i)), v == low.get(find(i))) for i, (v, _, _) in enumerate(rows))


def clustered(r, n, dim, centres, labels, noise):
    middle = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i, r.choice(labels), [x + r.gauss(0, 1) * r.choice(noise) for x in r.choice(middle)]) for i in range(n)]


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    rows = con.execute("select vec_id, label, embedding from embeddings").fetchall()
    got = Counter(map(tuple, op.op12_embedding_join(spark, SF).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute(rows)
    assert got == Counter(con.execute(f"select vec_id, n_links, component_id, kept from ({op.SQL})").fetchall())


def test_small_cells_and_blocks(spark, monkeypatch):
    """Cells, blocks and parts far below the points' number, so that every way through the join is taken."""
    for name, value in (("CELL", 12), ("BLOCK", 8), ("FAN", 4)):
        monkeypatch.setattr(op, name, value)
    r = random.Random(2)
    rows = clustered(r, 500, 6, 25, [1, 2, None], [0.01, 0.05, 0.12])
    rows += [(1000 + i, 1, [1.0, 2.0, 3.0 + i / 1e4, 0.0, 0.0, 0.0]) for i in range(90)]  # a dense ball
    rows += [(2000 + i, 2, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert Counter(map(tuple, op.near_duplicates(df).collect())) == brute(rows)


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (2, 1, [1.0, 0.01]), (3, 1, [0.0, 0.0]), (4, 1, None), (5, 1, []), (6, 1, [nan, 1.0]), (7, 1, [inf, 1.0]), (8, 1, [None, 1.0]), (9, None, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (None, 7, [1.0, 1.0]), (10, 1, [1.0, 0.0, 0.0]), (11, 1, [3e38, 1e36]), (12, 1, [1e-44, 0.0]), (13, 2, [1.0, 0.0]), (14, 1, [-0.0, 1.0]), (15, 1, [0.0, 1.0]), (16, 1, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in ("cell", "home", "n", "cls", "key", "good", "links", "block", "part", "before")])
    assert Counter(map(tuple, op.near_duplicates(df).collect())) == brute(rows)
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    doubles = spark.createDataFrame([(1, 1, [1e300, 0.0]), (2, 1, [1e-300, 0.0])], "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, op.near_duplicates(doubles).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_no_pair_is_lost_and_clusters_prune():
    """Partners share a cell in which one of them is at home; on clustered points few copies are made."""
    r = np.random.default_rng(3)
    middle = r.normal(size=(40, 16))
    x = middle[r.integers(0, 40, 1500)] + 0.03 * r.normal(size=(1500, 16))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    pivots = unit[r.choice(1500, 16, replace=False)]
    first, copies = op.homes_and_copies(unit, pivots, np.ones(1500, bool), 0.98)
    for i, j in np.argwhere(unit @ unit.T >= 0.98):
        a, b = (i, j) if first[i] <= first[j] else (j, i)
        assert first[a] == first[b] or copies[b, first[a]]
    assert copies.sum() < 1500 * 16 / 8
