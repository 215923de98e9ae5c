import hashlib
import zlib
from collections import Counter, defaultdict

from tests.llm.fixtures import documents, empty
from tracemill.llm import op11_merkle as op
from tracemill.llm.common import table

SF = "/root/testdata/sf0.001"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    out = ""
    for k, v in enumerate(row):
        if v is not None:
            v = str(v)
            if lower and k == 4:
                v = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v)
            out += f"{len(v.encode())}:{v}"
        else:
            out += "-"
    return h(out)


def tree(nodes):
    """Root and, for every leaf, its (left, right) siblings by level, as the definition reads."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            lo = i // 8 * 8
            paths[k].append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 8])))
            at[k] = i // 8
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    subs, below = [], []
    for v in langs:
        held = sorted(by[v], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, paths = tree([leaf(r) for r in held])
        subs.append(sub)
        below.append((held, paths))
    root, tops = tree(subs)
    out = Counter()
    for sub, (held, paths), top in zip(subs, below, tops, strict=True):
        for r, p in zip(held, paths, strict=True):
            path = p + top
            now = leaf(r, lower=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for x, y in path:
                now = h(x + now + y)
            out[r[0], leaf(r), sub, root, h("".join(x + y for x, y in path)), now, now == root] += 1
    return out


def test_query_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    out = op.op11_merkle(spark, SF)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = Counter(map(tuple, out.collect()))
    assert got == brute([tuple(r) for r in docs.select(*op.FIELDS).collect()])
    assert {k[-1] for k in got} == {True, False}


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    docs = documents(spark).unionByName(documents(spark).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.select("*", *[F.lit("clash").alias(c) for c in ("grp", "pos", "block", "row", "leaf", "node")])
    docs = docs.unionByName(docs.limit(1).withColumn("lang", F.lit("é")).withColumn("text", F.expr("repeat('Ab é ', 300000)")))
    rows = [tuple(r) for r in docs.select(*op.FIELDS).collect()]
    assert Counter(map(tuple, op.proved(op.manifest(docs)).collect())) == brute(rows)
    assert op.proved(op.manifest(empty(spark))).count() == 0


def test_many_subtrees_and_levels(spark, monkeypatch):
    """Subtrees of 8 leaves, so that a lang has several levels of them and more than eight langs make a tree of their own."""
    monkeypatch.setattr(op, "HEIGHT", 1)
    rows = [(i, f"s{i % 3}", None if i % 50 == 0 else f"l{i % 97 % 13}" if i % 3 else "en", i, f"Text {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert Counter(map(tuple, op.proved(op.manifest(df)).collect())) == brute(rows)


def test_layout():
    for levels in range(1, 6):
        places = [a for d in range(levels) for a in op.addresses(levels, d).tolist()]
        assert sorted(places) == list(range(op._nodes(levels))) and places[0] == 0
    # Four levels split in two and two: the upper nine nodes come first, then each lower subtree in one stretch.
    assert sorted(op.addresses(4, 1).tolist()) == list(range(1, 9))
    low = op.addresses(4, 3)[:8].tolist()
    assert low == list(range(op.addresses(4, 2)[0] + 1, op.addresses(4, 2)[0] + 9))
    for n in (1, 2, 8, 9, 64, 65, 500):
        nodes = [h(str(i)) for i in range(n)]
        root, paths = tree(nodes)
        stored = op.build(nodes, op.height_of(n))
        assert stored[:32].hex() == root
        assert [op.Subtree(stored, n, op.height_of(n)).path(i) for i in range(n)] == paths
        assert all(op.fold(a, p) == root for a, p in zip(nodes, paths, strict=True))
