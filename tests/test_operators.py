import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill import registry
from tracemill.functions import scalars as S
from tracemill.operators import detect, explain, forest, frames, graph, metrics, signals, splits
from tracemill.plans import label_plans, store_plans
from tracemill.sources.views import view


def test_ranks_and_percentiles_with_ties(spark):
    x = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 3.0), (4, 3.0)], "id long, v double")
    r = {t["id"]: t["rk"] for t in frames.global_rank(x, [F.desc("v"), "id"], "rk").collect()}
    assert r == {2: 1, 3: 2, 4: 3, 1: 4}
    p = {t["id"]: t["percentile"] for t in frames.reference_percentile(x, "v", F.col("id") != 4).collect()}
    assert round(p[3], 4) == 66.6667 and p[2] == 100


def test_confusion_and_auc(spark):
    x = spark.createDataFrame([(0.1, 0), (0.9, 0), (0.9, 1), (0.1, 1)], "score double, label int")
    m = metrics.confusion(x, F.col("score") >= 0.5).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (1, 1, 1, 1)
    assert metrics.roc_auc(x).first()["auc"] == 0.5


def test_rates_on_zero(spark):
    x = spark.createDataFrame([(0.1, 0)], "score double, label int")
    m = metrics.confusion(x, F.col("score") >= 0.5)
    assert metrics.rates(m).first()["precision"] is None
    assert metrics.rates(m, 0.0).first()["precision"] == 0.0


def test_running_sums_equal_sorting(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 50), r.randint(0, 9)) for _ in range(500)]
    got = {t["v"]: t["cum_w"] for t in frames.running_by_value(spark.createDataFrame(rows, "v long, w long"), "v", {"w": F.col("w")}).collect()}
    assert got == {v: sum(b for a, b in rows if a <= v) for v, _ in rows}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101)]
    got = {t["node"]: t["root"] for t in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_missing_knows_unicode_blanks(spark):
    x = spark.createDataFrame([(" ",), ("",), (None,), ("a",)], "s string")
    assert [t[0] for t in x.select(S.missing("s")).collect()] == [True, True, True, False]


def test_rules_must_be_sorted_and_known():
    import pytest

    with pytest.raises(ValueError):
        detect.checked([detect.Rule("B", "LOW", None, ()), detect.Rule("A", "LOW", None, ())])


def test_full_compare_names_each_fault(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "q"), (4, "z")], "k long, v string")
    assert {(t["k"], t["status"]) for t in frames.full_compare(a, b, ["k"], "v").collect()} == {(2, "DIFFERENT"), (3, "ABSENT"), (4, "UNEXPECTED")}


def test_bounds_equal_every_way_to_settle(spark):
    from itertools import product

    from tracemill.operators import review

    def rates(tp, fp, fn):
        return tp / (tp + fp) if tp + fp else None, tp / (tp + fn) if tp + fn else None, 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else None

    cases = list(product((0, 2), (0, 3), (0, 1), (0, 2), (0, 1)))
    df = spark.createDataFrame(cases, "tp long, fp long, fn long, open_top long, open_other long")
    for r in review.uncertainty_bounds(df).collect():
        ways = [rates(r.tp + a, r.fp + r.open_top - a, r.fn + b) for a in range(r.open_top + 1) for b in range(r.open_other + 1)]
        for i, name in enumerate(("precision", "recall", "f1")):
            seen = [w[i] for w in ways if w[i] is not None]
            got = r[f"{name}_low"], r[f"{name}_high"]
            assert got == ((None, None) if not seen else (min(seen), max(seen))), (r, name)
        assert r["undefined_possible"] == any(v is None for w in ways for v in w)


def test_context_is_strictly_earlier_and_bounded(spark):
    from tracemill.operators import labels

    rows = [("a", 1, 10), ("a", 2, 10), ("a", 3, 10), ("a", 4, 11), ("a", 5, 11), ("a", 6, 12), ("b", 7, 1), ("b", 8, None)]
    df = spark.createDataFrame(rows, "s string, id long, t long")
    got = {r.id: [c.id for c in r.context] for r in labels.recent_context(df, ["s"], "t", ["id"], 2, ["id"]).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [3, 2], 5: [3, 2], 6: [5, 4], 7: [], 8: []}


def test_allocation_goes_round_small_strata(spark):
    from tracemill.operators import splits

    df = spark.createDataFrame([("a", 2), ("b", 1), ("c", 100), ("d", 0)], "stratum string, n long")
    for budget in (0, 1, 7, 50, 103, 500):
        got = {r.stratum: r["take"] for r in splits.allocate(df, budget).collect()}
        assert sum(got.values()) == min(budget, 103) and got["a"] <= 2 and got["b"] <= 1, (budget, got)


def test_cases_fall_back_to_the_next_unused(spark):
    from tracemill.operators import review

    df = spark.createDataFrame([(1, 10), (2, 20)], "rk long, key long")
    got = [tuple(r) for r in review.case_studies(df, "rk", "key", {"FIRST": F.col("rk") == 1, "AGAIN": F.col("rk") == 1, "NONE": F.col("rk") > 5}).collect()]
    assert got == [(1, "FIRST", "FIRST", 10), (2, "AGAIN", "FALLBACK_NEXT_UNUSED_RANK", 20)]
    assert review.case_studies(df.limit(0), "rk", "key", {"FIRST": F.col("rk") == 1}).count() == 0


def test_forest_sets_outliers_apart(spark):
    from tracemill.operators import forest

    df = spark.range(600).select("id", (F.col("id") % 17).cast("double").alias("x"), F.when(F.col("id") == 599, 500.0).otherwise((F.col("id") % 13).cast("double")).alias("y"))
    model = forest.fit(df, F.lit(True), "id", ["x", "y"], trees=20, sample=256)
    assert forest.score(df, "id", ["x", "y"], model).orderBy(F.desc("raw_score")).first()["id"] == 599
    assert forest.fit(df.limit(0), F.lit(True), "id", ["x", "y"]) == ([], 0)


def test_csv_keeps_cells_and_tells_bad_lines(spark, tmp_path):
    from tracemill.sources import files

    df = spark.createDataFrame([("=1+1", " pad ", 'q"uote'), ("plain", "", "x,y")], "a string, b string, c string")
    files.write_csv(df, f"file://{tmp_path}/x")
    got = files.read_csv(spark, f"file://{tmp_path}/x", ["a", "b", "c"]).orderBy("a").drop("_bad").collect()
    assert ("'=1+1", " pad ", 'q"uote') in [tuple(r) for r in got] and len(got) == 2
    assert files.header_faults(spark, f"file://{tmp_path}/x", ["a", "z"]) == [("ABSENT", "z")]


def test_first_groups_stop_before_the_limit(spark):
    from tracemill.operators import splits

    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5)], "g string, o long")
    assert sorted(r.o for r in splits.first_groups(df, "g", "o", 3).collect()) == [1, 2, 3]


def test_quantiles_by_group_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(g, float(i // 3), i) for g in ("a", "b") for i in range(11)] + [("a", None, 99), ("c", 7.0, 1), ("d", None, 2)], "g string, v double, k long")
    got = {(r.g, r.q): r.v for r in frames.quantiles_by_group(df, "g", "v", "k", [0.0, 0.5, 1.0]).collect()}
    assert got == {(g, q): v for g in ("a", "b") for q, v in ((0.0, 0.0), (0.5, 1.0), (1.0, 3.0))} | {("c", q): 7.0 for q in (0.0, 0.5, 1.0)}


def test_blinded_looks_inside_structs(spark):
    df = spark.sql("select 1 as k, named_struct('x', array(named_struct('label', 1))) as s, 2 as label")
    assert frames.blinded(df, ["k"], {"label"}).columns == ["k"]
    with pytest.raises(ValueError, match="label"):
        frames.blinded(df, ["k", "s"], {"label"})


def test_category_counts_of_arrays_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, ["p", "q"]), (1, ["p"]), (None, [])], "a int, b array<string>")
    charts = {"a": F.col("a"), "b[]": F.col("b")}
    assert {tuple(r) for r in frames.category_counts(df, charts).collect()} == {("a", "1", 2), ("b", "p", 2), ("b", "q", 1)}
    assert frames.category_counts(df.limit(0), charts).count() == 0


def test_fold_fit_on_large_close_values(spark):
    rows = [(i % 3, 1e9 + i % 5) for i in range(60)] + [(None, 5.0), (7, 5.0), (1, None)]
    got = {r.fold: r for r in splits.fold_fit(spark.createDataFrame(rows, "f int, v double"), F.col("f"), 3, "v").collect()}
    for k in range(3):
        own = [v for f, v in rows if f in {0, 1, 2} - {k} and v is not None]
        mean = sum(own) / len(own)
        assert got[k].n == len(own) and abs(got[k].mean - mean) < 1e-5
        assert abs(got[k].deviation - (sum((v - mean) ** 2 for v in own) / len(own)) ** 0.5) < 1e-5


def test_leaked_rows(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("b", 1), (None, 1), (None, 0)], "g string, f int")
    assert {tuple(r) for r in splits.leaked_rows(df, "g", F.col("f"), 2).collect()} == {(0, 4, 2), (1, 2, 2)}


def test_split_manifest_keeps_components_whole(spark):
    from tracemill.plans import package_plans

    keys = spark.createDataFrame([(i, f"t{i // 2}", f"n{i // 6}") for i in range(300)] + [(300, None, ""), (301, "", None)], "row_key long, exact_key string, near_key string")
    got = {r.row_key: (r.root, r.part) for r in package_plans.g5(keys).collect()}
    assert sorted(got) == list(range(302)) and all(got[i] == got[i // 6 * 6] for i in range(300))
    assert got[300][0] == "300" and got[301][0] == "301"
    sizes = [sum(p == n for _, p in got.values()) for n in ("TRAIN", "CALIBRATION", "COMPARISON")]
    assert abs(sizes[0] - 242) <= 6 and abs(sizes[1] - 30) <= 12


def test_features_keep_their_order_and_flags(spark):
    from tracemill.operators import features

    cols = "record_number long, protocol_number int, source_port long, destination_port long, service string, sent_bytes long, received_bytes long, sent_packets long, received_packets long, duration long"
    rows = [(1, 6, 80, None, "A", 10, 30, 0, 5, None), (2, 6, None, 443, None, None, 7, 3, None, 9), (3, 17, 60000, 5, "B", 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, cols)
    out = features.feature_rows(df, F.col("record_number") < 3, "record_number").orderBy("record_number").collect()
    assert len(features.FEATURES) == 36 == len(set(features.FEATURES)) and list(out[0].asDict())[1:-1] == features.FEATURES
    a, b, c = out
    assert (a.service_rarity, b.service_rarity, c.service_rarity) == (0.0, 0.0, 1.0)  # the only value, null, unseen protocol
    assert (a.sent_byte_share, b.sent_byte_share, c.zero_total_bytes) == (0.25, 0.5, 1.0)
    flags = [dict(zip(features.FEATURES, r.eligible, strict=True)) for r in out]
    assert not flags[0]["dst_port_rarity"] and not flags[0]["log_duration"] and flags[0]["sent_byte_share"] and not flags[0]["log_sent_bytes_per_packet"]
    assert not flags[1]["log_total_bytes"] and not flags[1]["zero_total_bytes"] and not flags[2]["sent_byte_share"] and flags[2]["zero_total_bytes"]


def test_tiers_equal_joined_sets(spark):
    from tracemill.operators import splits

    r = random.Random(6)
    pick = lambda p, n: r.choice([None, "", *[f"{p}{i}" for i in range(n)]])
    rows = [(i, pick("e", 60), pick("n", 50), pick("s", 30), pick("d", 9), pick("h", 40)) for i in range(90)]
    names = ["row_key", "exact_key", "near_key", "entity_source", "entity_destination", "entity_host"]
    df = spark.createDataFrame(rows, "row_key long, exact_key string, near_key string, entity_source string, entity_destination string, entity_host string")
    for tier, extra in splits.TIERS.items():
        root = {i: i for i, *_ in rows}
        for _ in rows:  # as often as the longest path may need
            for k in [*splits.HARD_KEYS, *extra]:
                at = names.index(k)
                for a in rows:
                    for b in rows:
                        if a[at] and a[at] == b[at]:
                            root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
        assert {x.row_key: x.root for x in splits.tier_groups(df, "row_key", tier).collect()} == root


def test_rows_of_equal_keys_give_few_edges_and_all_tiers_settle_at_once(spark, monkeypatch):
    from tracemill.operators import splits
    from tracemill.plans import store_plans

    # 400 rows, few values of every key but the first: more rows that agree add no edge. A row of its own, one without any key, one without id.
    rows = [(i, f"t{i // 2 if i < 40 else i}", f"n{i % 10}", f"s{i % 10}" if i % 3 else "", f"d{i % 7}", None) for i in range(400)]
    rows += [(400, "alone", "alone", None, None, "h"), (401, None, "", " ", None, None), (None, "t0", "n0", "s0", "d0", "h")]
    # An id that occurs three times joins what each of its rows has.
    rows += [(500, "u1", None, None, None, None), (500, "u2", None, None, None, None), (500, "u3", None, None, None, None), *[(500 + i, f"u{i}", None, None, None, None) for i in (1, 2, 3)]]
    names = ["row_key", "exact_key", "near_key", "entity_source", "entity_destination", "entity_host"]
    df = spark.createDataFrame(rows, "row_key long, exact_key string, near_key string, entity_source string, entity_destination string, entity_host string")
    met = []
    monkeypatch.setattr(splits, "components", lambda edges, **kw: (met.append(edges.count()), met.append(edges.distinct().count()), graph.components(edges, **kw))[-1])
    got = sorted(((r.tier, r.row_key, r.root) for r in store_plans.g3(df).collect()), key=str)
    want = []
    for tier, extra in splits.TIERS.items():
        root = {r[0]: r[0] for r in rows if r[0] is not None}
        for _ in range(20):
            for k in [*splits.HARD_KEYS, *extra]:
                low = {}
                for r in rows:
                    v = r[names.index(k)]
                    if r[0] is not None and v and v.strip():
                        low[v] = min(low.get(v, root[r[0]]), root[r[0]])
                for r in rows:
                    if r[0] is not None and (v := r[names.index(k)]) and v.strip():
                        root[r[0]] = min(root[r[0]], low[v])
        want += [(tier, r[0], root.get(r[0])) for r in rows]
    assert got == sorted(want, key=str)
    assert len(met) == 2 and met[1] < 400


def test_graphs_apart_are_settled_together(spark):
    edges = [(g, i + g, i + g + 1) for g in (0, 1) for i in range(0, 20, 2 - g)]
    got = {(t["g"], t["node"]): t["root"] for t in graph.components(spark.createDataFrame(edges, "g int, a long, b long"), within=("g",)).collect()}
    assert got == {(0, i): i // 2 * 2 for i in range(20)} | {(1, i): 1 for i in range(1, 22)}


def test_match_keeps_every_row_of_a_hot_key(spark):
    rows = spark.createDataFrame([(i, "hot" if i < 300 else f"k{i}" if i % 2 else None) for i in range(320)], "r long, k string")
    right = spark.createDataFrame([("hot", 1), ("k301", 2)], "k string, v int")
    got = {t["r"]: t["v"] for t in graph.with_match(rows, right, ["k"], "r").collect()}
    assert got == {i: 1 if i < 300 else 2 if i == 301 else None for i in range(320)}


def test_saved_model_scores_as_the_fitted_one(spark, tmp_path):
    from tracemill.operators import learn

    r = random.Random(3)
    df = spark.createDataFrame([(i, r.random(), r.random(), int(i % 3 == 0)) for i in range(200)], "i long, a double, b double, label int")
    learn.save_pipeline(df, ["a", "b"], "label", f"file://{tmp_path}/m")
    fitted = learn.probability(learn.logistic(df, ["a", "b"], "label"), df, ["a", "b"], ["i"])
    saved = learn.score_saved(f"file://{tmp_path}/m", df, ["i"])
    assert sorted((x.i, round(x.p_attack, 9)) for x in saved.collect()) == sorted((x.i, round(x.p_attack, 9)) for x in fitted.collect())


def test_median_and_quantiles_by_running_counts(spark):
    for values in ([], [4.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0], [3.0, 3.0, 3.0, 8.0, None]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        known = sorted(v for v in values if v is not None)
        want = None if not known else (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
        assert frames.median(df, "x", "m").first().m == want
        q = frames.quantile_disc(df, "x", {"low": 0.25, "top": 1.0}).first()
        assert (q.low, q.top) == ((known[max(1, math.ceil(0.25 * len(known))) - 1], known[-1]) if known else (None, None))


def test_next_at_or_after(spark):
    from tracemill.operators import frames as f

    left = spark.createDataFrame([(i, v) for i, v in enumerate([0, 3, 3, 7, 50, 99, 100, 101, None])], "i int, v int").repartition(3)
    right = spark.createDataFrame([(v,) for v in (3, 5, 60, 60, 100, None)], "w int").repartition(2)
    got = {r["i"]: r["n"] for r in f.next_at_or_after(left, "v", right, "w", "n").collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 60, 4: 60, 5: 100, 6: 100, 7: None, 8: None}
    assert {r["n"] for r in f.next_at_or_after(left, "v", right.limit(0), "w", "n").collect()} == {None}


def test_boundary_split_is_the_best_pair(spark):
    import random

    from tracemill.operators import splits

    r = random.Random(4)
    for off, least in ((2, 0), (6, 0), (2, 700)):
        sizes = {f"g{i}": r.choice((1, 2, 3, 9)) for i in range(260)}
        order = sorted(sizes, key=lambda g: __import__("hashlib").sha256(f"split:{g}".encode()).hexdigest())
        cum, total = [0], sum(sizes.values())
        for g in order:
            cum.append(cum[-1] + sizes[g])
        ok = lambda n, s: abs(100 * n - s * total) <= off * total
        pairs = [(abs(100 * cum[a] - 80 * total), abs(100 * (cum[b] - cum[a]) - 10 * total), abs(100 * (total - cum[b]) - 10 * total), a, b) for a in range(1, len(order) - 1) for b in range(a + 1, len(order)) if cum[a] >= least and ok(cum[a], 80) and ok(cum[b] - cum[a], 10) and ok(total - cum[b], 10)]
        *_, a, b = min(pairs)
        got = {x["g"]: x["part"] for x in splits.boundary_split(spark.createDataFrame(list(sizes.items()), "g string, n long").repartition(3), "g", "n", off=off, least=least).collect()}
        assert got == {g: "TRAIN" if i < a else "CALIBRATION" if i < b else "COMPARISON" for i, g in enumerate(order)}


def test_boundary_split_without_a_feasible_pair(spark):
    from tracemill.operators import splits

    for sizes, least in (([100, 1, 1], 0), ([10] * 100, 3072), ([5, 5], 0)):
        with pytest.raises(ValueError, match="no feasible pair"):
            splits.boundary_split(spark.createDataFrame([(f"g{i}", n) for i, n in enumerate(sizes)], "g string, n long"), "g", "n", least=least)


def test_nested_folds_are_whole_and_even(spark):
    from tracemill.operators import splits

    groups = spark.createDataFrame([(f"g{i}", 1 + i % 9) for i in range(120)], "g string, n long")
    got = splits.nested_folds(groups, "g", "n").collect()
    assert len(got) == 120 and all(set(r["inner_folds"]) == {0, 1, 2} - {r["outer_fold"]} for r in got)
    rows = [sum(r["n"] for r in got if r["outer_fold"] == o) for o in range(3)]
    assert max(rows) - min(rows) <= 9
    for o in range(3):
        inner = [sum(r["n"] for r in got if r["inner_folds"].get(o) == i) for i in range(2)]
        assert max(inner) - min(inner) <= 9 and sum(inner) == sum(rows) - rows[o]
    x = spark.createDataFrame([(f"g{i}", int(i % 4 == 0)) for i in range(120) for _ in range(1 + i % 9)], "g string, label int")
    support = {r["context_id"]: r for r in splits.fold_support(x, "g", "label", splits.nested_folds(groups, "g", "n"), least=150).collect()}
    assert len(support) == 9 and support["OUTER_1"]["rows"] == rows[1] and support["OUTER_1"]["passed"] and support["OUTER_1"]["rows"] + support["OUTER_1"]["train_rows"] == sum(rows)
    none = splits.fold_support(x.withColumn("label", F.lit(0)), "g", "label", splits.nested_folds(groups, "g", "n"), least=1).collect()
    assert not any(r["passed"] for r in none)


def staging_rows(spark, linked):
    """240 groups of 1 to 6 rows by their text, in three strata; ``linked`` joins all rows by one host."""
    rows = [(g * 10 + i, f"text{g}", f"near{g}", None, None, "h" if linked else None, ("A", "B", "C")[(g + i // 5) % 3]) for g in range(240) for i in range(1 + g % 6)]
    return spark.createDataFrame(rows, "row_key long, exact_key string, near_key string, entity_source string, entity_destination string, entity_host string, stratum string")


def test_allocation_keeps_groups_whole_and_strata_near(spark):
    from tracemill.operators import splits

    x = staging_rows(spark, False)
    parts = splits.allocate_groups(x, "exact_key", "stratum")
    assert parts.count() == 240 and parts.select("exact_key").distinct().count() == 240
    y = x.join(parts.select("exact_key", "part"), "exact_key")
    n = y.count()
    for p, s in splits.PARTS.items():
        assert abs(y.filter(F.col("part") == p).count() / n - s) <= 0.02
    assert all(r["passed"] for r in splits.stratum_checks(y, "stratum", "part", splits.PARTS).collect())


def test_repairs_mend_a_bad_cut(spark):
    """Two groups a size class fall to TRAIN and VALIDATION alone; the repairs fill the third part."""
    from tracemill.operators import splits

    sizes = [60, 60, 31, 31, 15, 15, 7, 7, 3, 3, 1, 1]
    x = spark.createDataFrame([(f"g{i}", "A") for i, n in enumerate(sizes) for _ in range(n)], "g string, s string")
    raw, mended = ({p: sum(r["size"] for r in splits.allocate_groups(x, "g", "s", rounds=k).collect() if r["part"] == p) for p in splits.PARTS} for k in (0, 8))
    off = lambda got: max(abs(got[p] - s * sum(sizes)) for p, s in splits.PARTS.items())
    assert raw["TEST"] == 0 and sum(mended.values()) == sum(sizes) and off(mended) < off(raw) and mended["TEST"] > 0


def test_staging_takes_the_selected_tier_first_and_falls_back_only_where_approved(spark):
    from tracemill.operators import splits

    least = {"groups_least": 50, "rows_least": 50, "off": 0.08, "stratum_off": 0.12}
    got = splits.staged(staging_rows(spark, False), "row_key", "stratum", **least).collect()
    assert {r["tier"] for r in got} == {"ENTITY_ALL_ENDPOINTS"} and all(r["chosen"] and r["passed"] for r in got)
    linked = staging_rows(spark, True)
    with pytest.raises(ValueError, match="ENTITY_ALL_ENDPOINTS failed and no fallback is approved: .*LARGEST_GROUP"):
        splits.staged(linked, "row_key", "stratum", **least)
    with pytest.raises(ValueError, match="approved fallback ENTITY_SOURCE_HOST failed"):
        splits.staged(linked, "row_key", "stratum", approved="ENTITY_SOURCE_HOST", **least)
    got = splits.staged(linked, "row_key", "stratum", approved="HARD_GROUP_ONLY", **least).collect()
    assert {r["tier"] for r in got if r["chosen"]} == {"HARD_GROUP_ONLY"} and all(r["passed"] for r in got if r["chosen"])
    assert {r["check"] for r in got if not r["chosen"] and not r["passed"]} >= {"GROUPS", "LARGEST_GROUP"}


def test_quantile_cont(spark):
    import numpy as np

    r = random.Random(3)
    values = [r.choice([1.0, 2.5, 7.0, r.random()]) for _ in range(75)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
    got = frames.quantile_cont(df, "v", {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}).first()
    assert list(got) == pytest.approx(np.quantile(values, [0, 0.05, 0.5, 0.95, 1]).tolist())
    assert list(frames.quantile_cont(df.limit(0), "v", {"a": 0.5}).first()) == [None]


def test_digests(spark):
    import hashlib
    import json

    def own(*parts):
        return hashlib.sha256(json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    df = spark.createDataFrame([(1,), (2**40,)], "n long")
    digest, bucket = S.digest_order('a "b" é', -3, "n")
    sha = hashlib.sha256(b"x").hexdigest()
    for r in df.select("n", digest.alias("d"), bucket.alias("b"), S.review_id(sha, "n").alias("i")).collect():
        assert r["d"] == own('a "b" é', -3, r["n"]) and int(r["b"]) == int(r["d"][:16], 16) and r["i"] == "R-" + own("review", sha, r["n"])
    with pytest.raises(ValueError, match="SHA-256"):
        S.review_id("abc", "n")
    with pytest.raises(Exception, match="not a record number"):
        spark.createDataFrame([(0,)], "n long").select(S.review_id(sha, "n")).collect()


def test_rarity_of_chosen_fields_and_of_all(spark):
    from tracemill.operators import features

    df = spark.createDataFrame([(i, 6 if i % 3 else 17, i % 4 or None, i % 5, f"s{i % 2}" if i % 7 else None) for i in range(60)], "id long, protocol_number long, source_port long, destination_port long, service string").unionByName(spark.createDataFrame([(99, 1, 5, 5, "s9")], "id long, protocol_number long, source_port long, destination_port long, service string"))
    ref = F.col("id") < 40
    rows = df.collect()
    every = {r["id"]: r for r in features.with_rarity(df, features.rarity_counts(df, ref)).collect()}
    one = {"service_rarity": "service"}
    alone = {r["id"]: r["service_rarity"] for r in features.with_rarity(df, features.rarity_counts(df, ref, one), one).collect()}
    for r in rows:
        for name, col in features.RARE.items():
            seen = [q[col] for q in rows if q["id"] < 40 and q["protocol_number"] == r["protocol_number"] and q[col] is not None]
            want = 0.0 if r[col] is None else 1.0 if not seen else 1 - seen.count(r[col]) / len(seen)
            assert every[r["id"]][name] == pytest.approx(want)
        assert alone[r["id"]] == every[r["id"]]["service_rarity"]


def test_observations_name_every_violation(spark):
    from tracemill.operators import observe

    kind = "record_number long, event struct<source_record_id: string>, session struct<identifier: string, sent_bytes: long, received_bytes: long, sent_packets: long, received_packets: long, duration_raw_value: long>, network struct<protocol_number: long, source: struct<port: long>, destination: struct<port: long>>, application struct<service_source: string>, issues array<struct<field: string, code: string, status: string>>"
    fine = (1, ("id",), ("s", 1, 2, 3, 4, 5), (6, (80,), (443,)), ("HTTP",), [("itime", "MISSING_ITIME", "UNKNOWN")])
    empty = (2, ("id",), ("", None, None, None, None, None), (0, (None,), (None,)), ("",), [])
    bad = (0, ("",), ("s", -1, None, None, None, -7), (256, (65536,), (-1,)), (None,), [("net_sentpkts", "X", "ACTUAL_INVALID"), (None, "Y", "EXPECTED")])
    none = (3, (None,), (None, 0, 0, 0, 0, 0), (None, (0,), (65535,)), ("a",), None)
    got = {r["record_number"]: r for r in observe.observations(spark.createDataFrame([fine, empty, bad, none], kind)).collect()}
    assert got[1]["violations"] == [] and got[2]["violations"] == [] and got[2]["session_id"] is None and got[2]["service"] is None
    assert got[0]["violations"] == ["INVALID:net_sentpkts", "record_number", "record_id", "protocol_number", "source_port", "destination_port", "sent_bytes", "duration"]
    assert got[3]["violations"] == ["record_id", "protocol_number"]
    assert {r["partition"] for r in got.values()} <= {"REFERENCE", "HOLDOUT"} and got[1]["partition"] == got[0]["partition"]  # one session


def test_fixed_rounds_the_binary_value(spark):
    df = spark.createDataFrame([(0.9259375,), (0.0078125,), (3 / 128,), (1234567.0234375,), (0.0,), (1.0,)], "x double")
    got = [r[0] for r in df.select(explain.fixed(F.col("x"))).collect()]
    assert got == [f"{x:.6f}" for (x,) in df.collect()] and got[0] == "0.925937"


@pytest.mark.parametrize("groups", [["a", "b", "c"], ["a"], ["a", "b", None], [None], []])
def test_masked_metrics_with_every_group_seen_and_nulls(spark, groups):
    """OUTSIDE has a line without rows too, and takes null groups as NOT IN does."""
    import duckdb

    seen = lambda k: int(hashlib.sha256(str(k).encode()).hexdigest()[:16], 16) % 50 == 0
    first = iter(groups)
    rows = [(k, next(first, "d") if seen(k) else ["b", "d", None][k % 3], float(k * 37 % 4000), k % 2, 0) for k in range(400) if groups or not seen(k)]
    df = spark.createDataFrame(rows, "row_key long, group_id string, score double, label int, label2 int")
    labelled_scores = df.toPandas()  # noqa: F841
    sql = registry.ORACLES["ml21_masked_metrics"]
    want = duckdb.sql(sql[sql.index("SELECT 'ALL'") :]).fetchall()
    assert sorted(tuple(r) for r in label_plans.ml21(df).collect()) == sorted(want)


@pytest.mark.parametrize("kind", ["<f4", "<f8"])
def test_walks_end_where_single_steps_end(kind):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(9000, 3)), 1)
    x[5, 1] = np.nan
    trees = [forest.grow(x[100 * k : 100 * k + 300], 7, np.random.default_rng(k)).astype(kind) for k in range(4)] + [forest.grow(x[:1], 7, rng).astype(kind)]

    def end(nodes, row):
        at = 0
        while nodes[at, 0] >= 0:
            at = int(nodes[at, 2] if row[int(nodes[at, 0])] <= nodes[at, 1] else nodes[at, 3])
        return float(nodes[at, 4])

    got = forest.walked(x, [forest.packed(n) for n in trees])
    assert got == pytest.approx([sum(end(n, row) for n in trees) for row in x])
    c = rng.normal(size=(5, 3))
    assert signals.distances(x[10:], c) == pytest.approx(((x[10:, None, :] - c[None]) ** 2).sum(2).min(1))


@pytest.mark.parametrize("name", ["sf26_sf27_sf28_drivers", "ml20_explanation_record"])
def test_features_of_many_values_are_joined_alike(spark, monkeypatch, name):
    """Looked up in a task or joined by shuffles, in part or all: the same rows."""
    flows = view(spark, "/root/testdata/sf0.001", "flows").filter("record_number % 4 = 0")
    plan = {"sf26_sf27_sf28_drivers": store_plans.sf28, "ml20_explanation_record": store_plans.ml20}[name]
    got = []
    for few in (explain.FEW_VALUES, 300, 0):
        monkeypatch.setattr(explain, "FEW_VALUES", few)
        got.append(sorted(map(str, plan(flows).collect())))
    assert got[0] and got[0] == got[1] == got[2]


def test_distinct_counts_leave_nulls_out(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("b"), F.lit(None).cast("long").alias("c"))
    for rows in (1 << 20, 100):
        got = frames.distinct_counts(df, {n: F.col(n) for n in "abc"}, rows).first()
        assert tuple(got) == (7, 334, 0)
    assert tuple(frames.distinct_counts(df.limit(0), {"a": F.col("a")}).first()) == (0,)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_rank_sorts_once_and_percentiles_broadcast_few_values(spark):
    """ranks were taken by a second shuffle and sort, and rows of a frequent value met in one task of a shuffled join."""
    from pyspark.sql import functions as F

    from tracemill.operators import frames

    x = spark.range(5000).select("id", (F.col("id") * 7919 % 13).cast("double").alias("v"), (F.col("id") % 3 > 0).alias("ref"))
    ranked = frames.global_rank(x, [F.desc("v"), "id"], "rank")
    # The sort that is left is of one row a range.
    assert "row_number" not in plan_of(ranked) and plan_of(ranked).count("Sort [") == 1
    rows = sorted(x.collect(), key=lambda r: (-r["v"], r["id"]))
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {r["id"]: i + 1 for i, r in enumerate(rows)}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = frames.reference_percentile(x, "v", F.col("ref"))
        assert "SortMergeJoin" not in plan_of(p)
        refs = [r["v"] for r in rows if r["ref"]]
        upto = {v: 100.0 * sum(r <= v for r in refs) / len(refs) for v in range(13)}
        assert all(abs(r["percentile"] - upto[int(r["v"])]) < 1e-9 for r in p.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
