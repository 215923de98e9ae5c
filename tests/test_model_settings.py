"""The registered model queries run at the operators' full settings."""

from tests.test_oracles import SF
from tracemill import registry
from tracemill.operators import forest, learn


def made_by(spark, monkeypatch, module, name, query):
    made, inner = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: made.append(inner(*a, **k)) or made[-1])
    return made, registry.QUERIES[query](spark, SF)


def test_isolation_forest(spark, monkeypatch):
    made, _ = made_by(spark, monkeypatch, forest, "fit", "ml3_ml4_isolation_forest")
    assert [(len(nodes), rows) for nodes, rows in made] == [(200, min(4096, made[0][1]))] and made[0][1] > 1024


def test_seeds(spark, monkeypatch):
    made, df = made_by(spark, monkeypatch, forest, "fit", "ml5_seed_sensitivity")
    assert [len(nodes) for nodes, _ in made] == [200, 200]
    got = {r["top"]: r["jaccard"] for r in df.collect()}
    assert sorted(got) == [50, 100] and all(0 <= j <= 1 for j in got.values())


def test_centres(spark, monkeypatch):
    made, _ = made_by(spark, monkeypatch, learn, "fit_centres", "ml6_ml24_cluster_scores")
    assert made[0].count() > 8


def test_random_forest(spark, monkeypatch):
    made, _ = made_by(spark, monkeypatch, learn, "random_forest", "ml10_ml23_random_forest")
    assert made[0].getNumTrees == 150 and made[0].getOrDefault("maxDepth") == 16
