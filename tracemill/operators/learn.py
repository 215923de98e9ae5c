"""Models over feature columns: clusters and logistic regression of Spark's own library, a random forest of ``bagged`` trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bagged


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def fit_centres(rows: DataFrame, features: list[str], k: int = 32, seed: int = 7) -> DataFrame:
    """(id, centre) of k clusters; few rows, as nearest_centroid takes them."""
    model = KMeans(k=k, seed=seed, maxIter=20).fit(vectors(rows, features))
    data = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(data, "id int, centre array<double>")


def logistic(rows: DataFrame, features: list[str], label: str, c: float = 1.0):
    """Ridge logistic regression with inverse strength ``c``, as a sum over rows."""
    n = max(1, rows.count())
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, tol=1e-4, maxIter=1000).fit(vectors(rows, features))


@dataclass
class Forest:
    """Trees with the edges of the columns' bins, and the settings that they were grown with under the names of Spark's library."""

    edges: list[np.ndarray]
    trees: list[np.ndarray]
    settings: dict

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.trees)

    def getOrDefault(self, name: str):  # noqa: N802
        return self.settings[name]


def random_forest(rows: DataFrame, features: list[str], label: str, key: str, trees: int = 150, depth: int = 16, leaves: int = 1024, seed: int = 7) -> Forest:
    """A forest whose trees have ``leaves`` leaves at most, best gain first: Spark's own keeps up to 2 ** depth of every tree open."""
    table = rows.select(F.lit("ALL").alias("context_id"), F.lit("FIT").alias("role"), key, F.col(label).alias("label"), F.array(*[F.col(f).cast("double") for f in features]).alias("vector"))
    binned, edges = bagged.prepared(table, key, [])
    made = bagged.fit(binned, trees, depth, leaves, seed=seed)
    return Forest(edges.get("ALL", []), made.get("ALL", []), {"numTrees": trees, "maxDepth": depth, "maxLeaves": leaves, "minInstancesPerNode": 2, "seed": seed})


def _shares(model: Forest, rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((model.edges, model.trees))

    def run(batches):
        edges, trees = sent.value
        for b in batches:
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) if len(b) else np.zeros((0, len(edges)))
            p = np.zeros(len(x))
            if trees:
                bins = bagged.dealt(x, edges)
                p = sum((n[bagged.place(n, bins), 4] for n in trees), p) / len(trees)
            yield pa.record_batch([*[b.column(k) for k in keep], pa.array(p)], [*keep, "p_attack"])

    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keep)
    return rows.select(*keep, F.array(*[F.col(f).cast("double") for f in features]).alias("_x")).mapInArrow(run, f"{kinds}, p_attack double")


def probability(model, rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep columns with p_attack, the probability of class 1."""
    if isinstance(model, Forest):
        return _shares(model, rows, features, keep)
    return model.transform(vectors(rows, features)).select(*keep, vector_to_array("probability")[1].alias("p_attack"))


def save_pipeline(rows: DataFrame, features: list[str], label: str, path: str, c: float = 1.0) -> None:
    """Fit vectors and logistic regression as one pipeline and write it to ``path``."""
    from pyspark.ml import PipelineModel

    PipelineModel(stages=[VectorAssembler(inputCols=features, outputCol="features"), logistic(rows, features, label, c)]).write().save(path)


def score_saved(path: str, rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns with p_attack by a saved pipeline, which is not fitted again."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path).transform(rows).select(*keep, vector_to_array("probability")[1].alias("p_attack"))
