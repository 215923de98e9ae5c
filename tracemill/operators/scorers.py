"""Scorers by a protocol: what is fitted on reference rows is one small state, applied to batches of all rows."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    def fit(self, rows: DataFrame, features: list[str]) -> object:
        """A state whose size does not grow with the rows."""

    def score(self, state: object, x: np.ndarray) -> np.ndarray:
        """One score a row; larger is stranger."""


class Spread:
    """Sum of squared deviations from the reference means, in standard deviations."""

    def fit(self, rows: DataFrame, features: list[str]) -> object:
        one = rows.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
        k = len(features)
        return [float(v or 0.0) for v in one[:k]], [float(v or 0.0) or 1.0 for v in one[k:]]

    def score(self, state: object, x: np.ndarray) -> np.ndarray:
        mean, spread = map(np.array, state)
        return (((x - mean) / spread) ** 2).sum(1)


def score_with(scorer: Scorer, rows: DataFrame, reference: Column, key: str, features: list[str]) -> DataFrame:
    """key, raw_score of every row by a scorer that was fitted on the reference rows."""
    state = scorer.fit(rows.filter(reference), features)

    def run(batches):
        for t in batches:
            yield pd.DataFrame({key: t[key], "raw_score": np.asarray(scorer.score(state, t[features].to_numpy(float)), float)})

    return rows.select(key, *features).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, raw_score double")
