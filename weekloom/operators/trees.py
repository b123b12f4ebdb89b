"""Boosted trees as numbers: node tables, scoring in one projection or as plain expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TreeSettings:
    """Boosting settings; 16 leaves are a depth of 4 in level-wise trees."""

    rounds: int = 90
    step: float = 0.05
    depth: int = 4
    bins: int = 64
    seed: int = 42
    minimum_train_rows: int = 100
    lineage_every: int = 10


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: at an inner node go left where the feature is at most the threshold; leaves have no feature."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]


def trees_value(trees: list[Tree], columns: list[str]) -> Column:
    """Sum of the trees' leaf values: one Arrow function, however many trees."""
    if not trees:
        return F.lit(0.0)
    tables = [(t.feature, t.threshold, t.left, t.right, t.value) for t in trees]

    def run(batches):
        import numpy as np
        import pandas as pd

        own = [tuple(np.asarray(x) for x in t) for t in tables]
        for rows in batches:
            x = np.vstack(rows.to_numpy()) if len(rows) else np.empty((0, 1))
            every, total = np.arange(len(x)), np.zeros(len(x))
            for feature, threshold, left, right, value in own:
                at = np.zeros(len(x), dtype=np.int64)
                while (feature[at] >= 0).any():
                    f = feature[at]
                    onward = np.where(x[every, np.maximum(f, 0)] <= threshold[at], left[at], right[at])
                    at = np.where(f >= 0, onward, at)
                total += value[at]
            yield pd.Series(total)

    scorer = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)
    return scorer(F.array(*[F.col(c).cast("double") for c in columns]))


def tree_expression(tree: Tree, columns: list[str], node: int = 0) -> Column:
    """One tree as comparisons of columns."""
    if tree.feature[node] < 0:
        return F.lit(tree.value[node])
    goes_left = F.col(columns[tree.feature[node]]).cast("double") <= F.lit(tree.threshold[node])
    return F.when(goes_left, tree_expression(tree, columns, tree.left[node])).otherwise(
        tree_expression(tree, columns, tree.right[node])
    )


@dataclass
class QuantileModel:
    """Boosted trees for one quantile: a start value and trees whose leaves are already stepped."""

    quantile: float
    start: float
    features: list[str]
    trees: list[Tree] = field(default_factory=list)

    def column(self, columns: list[str] | None = None) -> Column:
        """The prediction over the features, or over other columns in their order."""
        return F.lit(self.start) + trees_value(self.trees, columns or self.features)

    def expression(self, columns: list[str]) -> Column:
        """The same prediction without Python, for plans that score few rows in many steps."""
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree_expression(tree, columns)
        return total

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        return df.select("*", self.column().alias(name))


@dataclass
class ProbabilityModel(QuantileModel):
    """Boosted trees for log odds; the prediction is a probability."""

    def column(self, columns: list[str] | None = None) -> Column:
        return _logistic(super().column(columns))

    def expression(self, columns: list[str]) -> Column:
        return _logistic(super().expression(columns))


def _logistic(odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


NODE_SCHEMA = "tag string, tree int, node int, feature int, threshold double, left int, right int, value double"


def node_rows(models: dict[str, QuantileModel]) -> list[tuple]:
    """Rows of NODE_SCHEMA for all trees of several models."""
    return [
        (tag, k, i, t.feature[i], t.threshold[i], t.left[i], t.right[i], t.value[i])
        for tag, model in models.items()
        for k, t in enumerate(model.trees)
        for i in range(len(t.feature))
    ]


def trees_from_rows(rows) -> dict[str, list[Tree]]:
    found: dict[str, list[Tree]] = {}
    for r in sorted(rows, key=lambda r: (r["tag"], r["tree"], r["node"])):
        trees = found.setdefault(r["tag"], [])
        if r["node"] == 0:
            trees.append(Tree([], [], [], [], []))
        for name in ("feature", "threshold", "left", "right", "value"):
            getattr(trees[-1], name).append(r[name])
    return found
