import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tests.llm.fixtures import documents, empty, texts  # noqa: E402
from tracemill.llm import common, op1_topk, op2_token_counts, op3_bpe_chunks, op5_mix, op7_shards, op10_token_files  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def whole(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(3)
    vec = r.normal(size=(400, 6)).round(1)
    vec[50:90] = vec[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vec)]
    rows += [(1000, None), (1001, [1.0] * 5 + [None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1100, [1.0, 2.0])]
    got = op1_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))).collect()
    x = np.floor(vec * 1024).astype(np.int64)
    want = set()
    for q in range(0, 400, 100):
        for rank, i in enumerate(sorted((i for i in range(400) if i != q), key=lambda i: (-int(x[q] @ x[i]), i))[:10]):
            want.add((q, rank + 1, i, int(x[q] @ x[i])))
    assert {tuple(g)[:4] for g in got} == want
    assert op1_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_topk_of_repeated_rows(spark):
    r = np.random.default_rng(8)
    vec = r.integers(-9, 9, size=(60, 4))
    rows = [(i * 20, v.tolist()) for i, v in enumerate(vec)]
    rows += [rows[5]] * 10 + [(200, v.tolist()) for v in r.integers(-9, 9, size=(3, 4))] + [(7, vec[0].tolist())] * 30
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    want = Counter()
    for q, v in {(i, tuple(v)) for i, v in rows if i % 100 == 0}:
        others = list(rows)
        others.remove((q, list(v)))  # the asked row alone; its copies stay
        best = sorted(((-(2**20) * int(np.dot(v, w)), i) for i, w in others))[:10]
        want.update((q, rank, i, -s) for rank, (s, i) in enumerate(best, 1))
    assert sum(q == 100 for q, *_ in want.elements()) == 10 and sum(q == 200 for q, *_ in want.elements()) == 40
    assert Counter(tuple(g)[:4] for g in op1_topk.top_k(df).collect()) == want


def test_topk_of_huge_values(spark):
    big, long = 1e38, 2**63 - 1
    rows = [(100, [big, big]), (3, [big, big]), (4, [-big, 1.0]), (200, [0.5, 0.25]), (5, [0.5, 0.5]), (6, [1e-3, 1.7e308])]
    got = op1_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    def scaled(v):
        return [int(np.floor(x * 1024)) if abs(x) < 1e15 else int(x) * 1024 for x in v]

    want = set()
    for q, v in rows:
        if q % 100 == 0:
            score = [(max(-long, min(long, sum(a * b for a, b in zip(scaled(v), scaled(w), strict=True)))), i) for i, w in rows if i != q]
            want.update((q, rank, i, s) for rank, (s, i) in enumerate(sorted(score, key=lambda x: (-x[0], x[1])), 1))
    assert {tuple(g)[:4] for g in got} == want


def test_topk_prunes_blocks_of_clustered_rows(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 16)) * 4
    x = (centres[r.integers(0, 40, 6000)] + r.normal(size=(6000, 16)) * 0.1).round(3)
    got = op1_topk.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    w = np.floor(x * 1024).astype(np.int64)
    for q in range(0, 6000, 100):
        score = w @ w[q]
        score[q] = -(2**60)
        assert sorted((g.rank, g.vec_id) for g in got if g.query_id == q) == list(enumerate(np.lexsort((np.arange(6000), -score))[:10].tolist(), 1))
    assert sum(g.blocks_scored for g in got) < 0.3 * sum(g.blocks for g in got)


def test_topk_blocks_prune_without_loss():
    r = np.random.default_rng(5)
    x = r.integers(-20, 20, size=(700, 5))
    ids = r.permutation(5000)[:700]
    at, scores = op1_topk.prune_and_score(x[:30], x, ids, ids[:30], 10, block=16)
    for i in range(30):
        order = sorted((j for j in range(700) if j != i), key=lambda j: (-int(x[i] @ x[j]), ids[j]))[:10]
        assert at[i].tolist() == order
        assert scores[i].tolist() == [int(x[i] @ x[j]) for j in order]


def greedy(word, vocab, longest):
    n, i = 0, 0
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in vocab:
                break
        else:
            return 1
        n, i = n + 1, j
    return n


def test_token_counts_equal_greedy_matching(spark):
    vocab = set(op2_token_counts.vocabulary(BYTES))
    longest = max(map(len, vocab))
    got = Counter(map(tuple, op2_token_counts.count_tokens(documents(spark), BYTES).collect()))
    want = Counter()
    for r in documents(spark).select("doc_id", "text").collect():
        words = (r["text"] or "").encode().split()
        want[(r["doc_id"], len(words), sum(greedy(b" " + w, vocab, longest) for w in words))] += 1
    assert got == want


def test_automaton_with_gaps_in_the_vocabulary():
    r = random.Random(8)
    pieces = [bytes(r.choices(b"ab c", k=r.randint(1, 5))) for _ in range(25)] + [b" "]
    a = op2_token_counts.LongestMatch(pieces)
    words = [bytes(r.choices(b"abd", k=r.randint(1, 14))) for _ in range(400)] + [b"ab" * 300]
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    got = a.count(data, np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [greedy(b" " + w, set(pieces), 9) for w in words]


def test_bpe_chunks_equal_the_library(spark):
    t = whole(WORDS)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op3_bpe_chunks.bpe_encode(documents(spark), WORDS).collect())
    want = Counter()
    for r in documents(spark).select("doc_id", "text").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want
    assert op3_bpe_chunks.bpe_encode(empty(spark), WORDS).count() == 0


def test_bpe_joins_that_disagree_widen_then_fall_back():
    t = whole(WORDS)
    text = "Some words of it, again and again, ánd more: " * 60
    want = t.encode(text, add_special_tokens=False).ids
    coder = op3_bpe_chunks.ChunkCoder(WORDS)
    data = text.encode()
    chunks = [data[i : i + 150] if i else data[:150] for i in range(0, len(data), 150)]
    chunks = [c for c in (bytes(x).decode(errors="ignore").encode() for x in chunks) if c]
    whole_text = b"".join(chunks)
    want = t.encode(whole_text.decode(), add_special_tokens=False).ids
    coder.learn(chunks)
    ((ids, decoded),) = coder.encode([chunks])
    assert ids == struct.pack(f"<{len(want)}I", *want) and decoded.decode() == t.decode(want, skip_special_tokens=False)
    for upto in (1, op3_bpe_chunks.CONTEXT):  # ids that no encoding has, near the joins alone or in all of the context
        for c, e in coder.chunks.items():
            coder.chunks[c] = e._replace(last=[(p, b"\1\0\0\0" * 9 if i < upto else x) for i, (p, x) in enumerate(e.last)])
        assert next(coder.encode([chunks])) == (ids, decoded)


def test_token_files_round_trip(spark):
    t = whole(BYTES)
    folder = common.shared_dir(spark)
    docs = documents(spark)
    made = sorted(op10_token_files.write_files(docs, folder, BYTES).collect())
    files, start = [], 0
    for m in made:
        files.append((m["path"], start))
        start += m["n_tokens"]
    got = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in op10_token_files.read_files(spark, folder, files).collect())
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"], r["text"] is not None, (r["text"] or "").encode()))
    place, want = 0, []
    for r in rows:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.append((place, r["doc_id"], struct.pack(f"<{len(ids)}I", *ids)))
        place += len(ids)
    assert got == want
    assert zlib.crc32(want[0][2]) == spark.createDataFrame([(want[0][2],)], "b binary").select(F.crc32("b")).first()[0]
    assert op10_token_files.write_files(empty(spark), common.shared_dir(spark), BYTES).count() == 0


def test_shards_are_a_gapless_permutation(spark):
    got = op7_shards.shard_rows(documents(spark)).collect()
    again = op7_shards.shard_rows(documents(spark).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in documents(spark).select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    assert op7_shards.shard_rows(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation_with_inverse(spark, n):
    from tracemill.llm.feistel import feistel

    rows = spark.range(n).select("id", F.expr(feistel("id", str(n), "9")).alias("p")).select("id", "p", F.expr(feistel("p", str(n), "9", inverse=True)).alias("back")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["id"] == r["back"] for r in rows)


def wanted_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            open_.remove(s)
    return target


def test_mix_meets_targets(spark):
    docs = documents(spark)
    path = common.shared_dir(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    got = op5_mix.op5_mix(spark, path).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, op5_mix.op5_mix(spark, path).collect()))
    rows = docs.select("doc_id", "text", "source").collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len((r["text"] or "").encode().split())
    target = wanted_targets(size)
    assert len(got) == len(rows)
    # sources are told apart by their sizes, which differ here
    taken = Counter()
    for g in got:
        assert 0 <= g["taken"] <= 2 * g["size"]
        taken[g["source_size"]] += g["taken"]
    for s, t in target.items():
        assert abs(taken[size[s]] - t) <= 1
        assert all(abs(g["target"] - t) < 1e-6 * max(t, 1) for g in got if g["source_size"] == size[s])


def test_mixed_documents_hold_the_taken_words(spark):
    docs = documents(spark)
    words = Counter()
    for r in op5_mix.mixed_documents(docs).collect():
        assert r["n_chars"] == len(r["text"])
        words[r["source"]] += len(r["text"].encode().split())
    size = Counter()
    for r in docs.select("text", "source").collect():
        size[r["source"]] += len((r["text"] or "").encode().split())
    for s, t in wanted_targets(size).items():
        assert abs(words[s] - t) <= 1
    assert op5_mix.mixed_documents(empty(spark)).count() == 0


def test_texts_hold_the_awkward_cases():
    assert None in texts() and "" in texts()
