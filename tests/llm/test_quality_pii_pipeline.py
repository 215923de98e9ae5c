import hashlib
import re

import numpy as np
import pytest
from tests.llm.fixtures import documents, empty, texts

from tracemill.llm import op4_quality, op9_pii

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
PERSONAL = ["write to a.b@x.org or a@b@c.de, not a@b", "1.2.3.4 and 300.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111111111111112", "call +49 (30) 1234567 or +1 2", "4111-1111-1111-1111 a@b.c +49 30 1234 5678", "", None]


def plain_quality(text):
    w = WORDS.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {g for g in grams if grams.count(g) > 1}
    repeated = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(bool(WORDS.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def plain_spans(text):
    def good(kind, s):
        d = "".join(c for c in s if c.isdigit())
        if kind == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if kind == 2:
            return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == 0 or 9 <= len(d) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if good(k, m.group()))


def test_quality_statistics_equal_brute_force(spark):
    rows = op4_quality.quality(documents(spark), None).collect()
    source = documents(spark).select("doc_id", "text").collect()
    want = sorted((r.doc_id, *plain_quality(r.text)) for r in source)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert all(r.kept != r.base_failed for r in rows)
    assert op4_quality.quality(empty(spark), None).count() == 0


def test_viterbi_equals_every_sequence():
    from itertools import product

    r = np.random.default_rng(3)
    x, w = r.normal(size=(7, 4)), r.normal(size=8)
    t, e = w[-4:].reshape(2, 2), x @ w[:-4]
    got = op4_quality.viterbi(x, np.array([0, 5, 5, 7]), w).tolist()
    for a, b in ((0, 5), (5, 7)):
        best = max(product((0, 1), repeat=b - a), key=lambda y: sum(e[a + i] * v for i, v in enumerate(y)) + sum(t[p, q] for p, q in zip(y, y[1:], strict=False)))
        assert tuple(got[a:b]) == best


def test_likelihood_equals_every_sequence():
    from itertools import product

    r = np.random.default_rng(5)
    x, w, first, y = r.normal(size=(8, 3)), r.normal(size=7), np.array([0, 3, 3, 4, 8]), r.integers(0, 2, 8)

    def plain(w):
        t, e, total = w[-4:].reshape(2, 2), x @ w[:-4], 0.0
        for a, b in zip(first[:-1], first[1:], strict=True):
            score = {s: sum(e[a + i] * v for i, v in enumerate(s)) + sum(t[p, q] for p, q in zip(s, s[1:], strict=False)) for s in product((0, 1), repeat=b - a)}
            total += score[tuple(y[a:b])] - np.log(sum(np.exp(v) for v in score.values()))
        return total

    value, g = op4_quality.likelihood(x, first, y, w)
    assert abs(value - plain(w)) < 1e-9
    for k in range(len(w)):
        step = np.eye(len(w))[k] * 1e-5
        assert abs((plain(w + step) - plain(w - step)) / 2e-5 - g[k]) < 1e-5


def boilerplate(i):
    words = [f"wort{i * 31 % 89}{k * 7 % 53}e" for k in range(60)]
    lines = [" ".join(words[k : k + 12]).capitalize() + "." for k in range(0, 60, 12)]
    if i % 4 == 0:
        return "\n".join(f"{x.upper()} ### $$$ %%% &&&" for x in lines), 0
    return "\n".join(["Home page of it.", *lines, "Read more."]), 1


def test_trained_field_marks_lines(spark):
    rows = [(i, *boilerplate(i)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 160] * 2, "doc_id long, quality int")
    w = op4_quality.train(docs, labels)
    assert (w == op4_quality.train(docs.repartition(5), labels)).all()
    for r in op4_quality.quality(docs, w).filter("doc_id >= 160").collect():  # held out
        good = boilerplate(r.doc_id)[1]
        assert r.kept == bool(good) and (r.n_lines, r.n_content_lines) == ((7, 5) if good else (5, 0))
    assert op4_quality.train(docs, labels.filter("quality = 1")) is None
    assert {r.doc_id for r in op4_quality.good_documents(docs, w).filter("doc_id >= 160").collect()} == {i for i in range(160, 240) if i % 4}


def personal(i):
    d = str(4000000000000000 + i * 7919 * 10**4 + 10)
    d = next(d[:15] + str(k) for k in range(10) if op9_pii.luhn(d[:15] + str(k)))
    user, before = (f"u{i}.x", "bob", f"anna.li{i % 9}", "jo_k")[i % 4], ("it", "write to", "at", "mail")[i // 4 % 4]
    return f"Words before {before} {user}@host{i % 7}.example.org and more words 10.{i % 200}.3.{i % 99} then {d} then +1 ({200 + i % 700}) 555-{1000 + i * 13 % 9000} end"


def test_trained_trees_add_spans_and_leave_lookalikes(spark):
    docs = spark.createDataFrame([(i, personal(i)) for i in range(400)], "doc_id long, text string")
    model = op9_pii.train(docs)
    assert np.isfinite(model.limits).all()
    hidden = {"write to bo.li (at) host (dot) org today": "email", "see 10[.]20[.]3[.]77 there": "ip", "then 4111.1111.1111.1111 here": "card", "call +1 (456) 555-2186 4041894974608795 now": "phone"}
    for text, kind in hidden.items():
        got = op9_pii.added_spans(text, op9_pii.base_spans(text), model)
        assert kind in {op9_pii.KINDS[k] for _, k, _ in got}, text
    for text in ("built on 2024-01-12 again", "key a12345678901c0 in it", "part no 123456789 of it", "token x4111111111111111f there"):
        assert not op9_pii.added_spans(text, op9_pii.base_spans(text), model), text
    few = docs.filter("doc_id < 9")
    assert np.isinf(op9_pii.train(few).limits).all()  # too few held-out positives: nothing is added
    assert op9_pii.find_pii(few, op9_pii.train(few)).filter("n_added > 0").count() == 0


def test_base_spans_equal_the_patterns(spark):
    for text in [*PERSONAL, *texts()]:
        assert op9_pii.base_spans(text or "") == plain_spans(text), text
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    for r in op9_pii.find_pii(df, None).collect():
        spans = plain_spans(PERSONAL[r.doc_id])
        assert r.spans == op9_pii.written(spans) and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()


@pytest.mark.parametrize("rows", [PERSONAL, []])
def test_redaction_keeps_rows_and_hides_spans(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", None if t is None else len(t)) for i, t in enumerate(rows)], "doc_id long, text string, spans string, n_chars long")
    got = {r.doc_id: r for r in op9_pii.redacted_documents(df, op9_pii.train(df)).collect()}
    assert set(got) == set(range(len(rows)))
    for i, t in enumerate(rows):
        assert (got[i].text is None) == (t is None) and got[i].spans == "clash"
        if t:
            assert got[i].n_chars == len(got[i].text) and not plain_spans(got[i].text)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    keep = ["doc_id", "text", "lang", "source", "n_chars"]
    good = spark.createDataFrame([(100 + i, f"Document {i} says: " + " ".join(f"word{i}x{k}" for k in range(80)) + ".", "en", f"s{i % 3}", 900) for i in range(12)], documents(spark).select(*keep).schema)
    for name, docs in (("some", documents(spark).select(*keep).unionByName(good)), ("none", empty(spark))):
        docs.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(100, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}")
        assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)
        assert (out.count() > 0) == (name == "some")


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Every stage on what the one before kept, against plain Python with the same fitted weights and trees."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from tracemill.llm.common import table

    def prose(i):
        return [f"w{i * 37 % 83}{k * 11 % 61}x" for k in range(70)]

    rows = [(i, "\n".join(" ".join(prose(i)[k : k + 14]) for k in range(0, 70, 14)) + f" mail u{i}@host.example.org end", "en", f"s{i % 3}", 400) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 400) for i in range(10)]  # exact copies
    rows += [(200 + i, rows[i][1] + " and one", "en", "s2", 400) for i in range(10)]  # near ones
    rows += [(300 + i, " ".join(x.upper() + "!! ###" for x in prose(i)), "en", "s0", 400) for i in range(30)]
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), (402, "short one", "en", "s0", 9)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, *_ in rows if i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = table(spark, folder, "documents")
    w = op4_quality.train(docs, table(spark, folder, "labels"))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, folder))
        after[name] = before.collect(), docs.collect()

    def kept(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        stats, x, visible, first = op4_quality.measure(data, np.array([0, len(data)]))
        y = op4_quality.viterbi(x, first, w)
        return not plain_quality(text)[-1] and (visible * y).sum() >= 0.5 * visible.sum()

    start, good = after["quality rules"]
    assert {r.doc_id for r in good} == {r.doc_id for r in start if kept(r.text)} == {*range(60), *range(100, 110), *range(200, 210)}

    def shingles(text):
        t = [x.lower() for x in WORDS.findall(text)]
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}

    start, one = after["near-duplicates"]
    sets = {r.doc_id: shingles(r.text) for r in start}
    linked = {i: min(j for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in sets}
    assert {r.doc_id for r in one} == set(linked.values()) == set(range(60))

    start, hidden = after["personal data"]
    model = op9_pii.train(spark.createDataFrame([tuple(r) for r in start], docs_schema(spark, folder)))
    texts = {r.doc_id: op9_pii.redact(r.text, (b := op9_pii.base_spans(r.text)) + op9_pii.added_spans(r.text, b, model)) for r in start}
    assert {r.doc_id: r.text for r in hidden} == texts and all("[EMAIL]" in t for t in texts.values())

    start, mixed = after["mixing"]
    size = {s: sum(len(r.text.split()) for r in start if r.source == s) for s in ("s0", "s1", "s2")}
    words = {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in size}
    assert abs(sum(words.values()) - 1.5 * sum(size.values())) <= 3 and all(words[s] <= 2 * size[s] for s in size)
    assert all(r.text in texts[r.doc_id] or set(r.text.split()) <= set(texts[r.doc_id].split()) for r in mixed)

    start, coded = after["encoding"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    ids = [(r.doc_id, t.encode(r.text, add_special_tokens=False).ids) for r in start]
    want = sorted((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in coded) == want


def docs_schema(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").schema


def test_addresses_are_those_of_the_pattern():
    import random

    r = random.Random(9)
    texts = ["".join(r.choice("012.25a .") for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["1.2.3.4.5.6.7.8", "1.2.3.4.5", "1..2.3.4", "0001.02.3.255", "1.2.3.00000256", "9" * 500 + ".1.1.1"]
    pattern = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for t in texts:
        assert [(a, b) for a, b, _ in op9_pii.addresses(t)] == [m.span() for m in pattern.finditer(t)], t


def test_long_uniform_texts_take_seconds(spark):
    """A million digits or line ends, long runs of dots and signs, and a contact list of a megabyte."""
    import time

    contacts = " ".join(f"mail u{i}@ex{i % 7}.org or +49 30 {i:07d}, host 10.{i % 256}.3.{i % 200}, card 4111 1111 1111 1111;" for i in range(12_000))
    model = op9_pii.Boosted([], 1.0, [0.5] * 4)
    for t in ("7" * 1_000_000, "1." * 10_000, "a" * 200_000 + "@", "+1" * 10_000, "\n" * 1_000_000 + "5", contacts):
        began = time.time()
        base = op9_pii.base_spans(t)
        added = op9_pii.added_spans(t, base, model)
        assert time.time() - began < 60
        ends = sorted((a, b) for a, _, b in added)
        assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False))
    assert len(op9_pii.base_spans(contacts)) == 4 * 12_000
