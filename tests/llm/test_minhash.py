import random
from collections import Counter

from tests.llm.fixtures import documents, empty
from tracemill.llm import op6_minhash


def brute(rows, width=2, threshold=80):
    sets = []
    for _, t in rows:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(s), low.get(find(i)), d == low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def copies():
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    out = []
    for g in range(12):
        base = r.choices(words, k=r.randint(3, 150))
        for _ in range(r.choice((1, 2, 3, 40))):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 14))):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
    r.shuffle(out)
    return out


def test_components_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(copies())]
    got = op6_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=2)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = op6_minhash.near_duplicates(docs, width=2).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    assert op6_minhash.near_duplicates(empty(spark)).count() == 0


def test_blocks_of_lists_and_clusters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(op6_minhash, "LIST_BLOCK", 7)
    monkeypatch.setattr(op6_minhash, "CLUSTER_BLOCK", 6)
    rows = [(i, t) for i, t in enumerate(copies()[:90])]
    got = op6_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_rows_without_doc_id_and_repeated_doc_ids(spark):
    r = random.Random(3)
    texts = copies()
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    rows += [(None, " ".join(f"n{r.random()}" for _ in range(20))) for _ in range(2)] * 40 + [(9, "x y z one two"), (9, "x y z one two"), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, op6_minhash.near_duplicates(df, width=2).collect())) == brute(rows)
    # The group of a row, by brute force over rows with ids of their own: one row stays, of the smallest doc_id.
    group = [c for (_, _, c, _) in sorted(brute([(i, t) for i, t in enumerate(t for _, t in rows)]).elements())]
    lowest = {}
    for (d, t), g in zip(rows, group, strict=True):
        if t:
            lowest.setdefault(g, []).append((d is None, d or 0))
    got = op6_minhash.first_of_each_group(df, width=2).collect()
    words = [x for x in got if x["text"]]
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in words) == sorted(min(v) for v in lowest.values())
    by_text = {t: g for (_, t), g in zip(rows, group, strict=True)}
    assert sorted(by_text[x["text"]] for x in words) == sorted(lowest)
    assert len(got) - len(words) == 2


def test_each_class_is_confirmed_on_one_text(spark, monkeypatch):
    rows = [(None, t) for t in copies()] * 3
    seen = []
    inner = op6_minhash._in_blocks
    monkeypatch.setattr(op6_minhash, "_in_blocks", lambda df, key, nb: seen.append(df) or inner(df, key, nb))
    assert op6_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).count() == len(rows)
    plan = seen[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" not in plan and seen[1].count() == seen[1].select("cls").distinct().count()
