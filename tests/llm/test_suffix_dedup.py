import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from tests.llm.fixtures import documents, empty
from tracemill.llm import op8_suffix_dedup
from tracemill.llm.deep_shallow import sort_suffixes


def brute(rows, span=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - span + 1):
                s = t[i : i + span]
                first[s] = min(first.get(s, d), d)
    out = Counter()
    for d, t in texts:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - span + 1):
                if first[t[i : i + span]] < d:
                    gone[i : i + span] = b"\1" * span
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[(d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def passages():
    r = random.Random(11)
    words = ["th", "er", "an", "on", "é", "ing"]

    def prose(n):
        return " ".join("".join(r.choices(words, k=r.randint(1, 4))) for _ in range(n))

    shared = [prose(r.randint(9, 40)) for _ in range(6)]
    out = []
    for _ in range(70):
        t = prose(r.randint(1, 30))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 8)
            t += s[a : len(s) - r.randint(0, 30)] + prose(r.randint(0, 6))
        out.append(t)
    return [*out, out[0], out[0], out[1][3:], "a" * 49, "a" * 50, "a" * 200, "ab" * 100, "b" + "ab" * 60, None, "", shared[0], shared[0] + shared[1]]


def test_equals_brute_force(spark):
    rows = list(enumerate(passages()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert sum(k[2] for k in want) > 2000
    assert Counter(map(tuple, op8_suffix_dedup.remove_repeats(df).collect())) == want


def test_split_anchors_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(op8_suffix_dedup, "EDGES_A_TASK", 2)
    # the functions that run in workers take the changed limit with them only inside one process
    rows = list(enumerate(passages()))
    p = op8_suffix_dedup.Part(__import__("pyarrow").array([r[0] for r in rows]), __import__("pyarrow").array([r[1] for r in rows]), 4)
    codes = np.zeros(len(p.lead), np.uint8)
    _, edges, split = p.settle(codes)
    assert split.max() > 0 and len(edges)


def test_rows_of_one_doc_id_fill_no_part(spark, monkeypatch, tmp_path):
    texts = [t for t in passages() if t]
    rows = [(None if i % 3 == 0 else 40 if i % 3 == 1 else i, t) for i, t in enumerate(texts * 4)] + [(40, texts[0])] * 60
    folder = f"file://{tmp_path}/parts"
    monkeypatch.setattr(op8_suffix_dedup, "shared_dir", lambda spark: folder)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = Counter(map(tuple, op8_suffix_dedup.remove_repeats(df).collect()))
    finally:
        spark.conf.unset(key)
    assert got == brute(rows)
    parts = [pq.read_table(f).column("doc_id").to_pylist() for f in sorted((tmp_path / "parts").glob("part-*.parquet"))]
    assert None not in sum(parts, [])
    assert sum(40 in p for p in parts) > 1 and all(set(p) == {40} for p in parts if 40 in p)


def test_answers_by_rank():
    anchors, bodies = np.array([1, 1, 1, 2, 2, 3, 3], "<u4"), np.array([5, 5, 5, 6, 7, 8, 9], "<u8")
    got = op8_suffix_dedup.answers(anchors, bodies, np.array([10, 10, 11, 10, 10, 10, 11]))
    assert got.tolist() == [0, 0, op8_suffix_dedup.KNOWN, 0, 0, 1, 1]


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, op8_suffix_dedup.remove_repeats(docs).collect())) == brute(rows)
    assert op8_suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_deep_shallow_order():
    r = np.random.default_rng(2)
    data = r.integers(0, 2, 3000).astype(np.uint8)
    data[500:900] = data[100:500]
    data[1000:1400] = data[100:500]
    data[2000:2300] = 1
    at = r.permutation(2900)
    group = at % 2
    order, equal = sort_suffixes(data, at, group, 50)
    raw = data.tobytes()
    keys = [(group[i], raw[at[i] : at[i] + 50]) for i in order]
    assert keys == sorted(keys)
    assert equal.tolist() == [False] + [a == b for a, b in zip(keys[1:], keys[:-1], strict=True)]
