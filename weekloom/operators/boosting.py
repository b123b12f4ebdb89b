"""Boosted trees of many models grown together, one Spark job per tree level.

Held-out folds train on nested sets of years, quantiles on the same rows, specialists on subsets. Each of them
is a goal: a label, a row weight (0 leaves the row out) and a loss. All goals share the binned rows. For a level
every task sums the gradients of its rows by (goal, node, feature, bin); the sums of one node meet in a group
of one small array per task, where its best split is found. So a round takes ``depth`` jobs and one for the leaves,
however many goals there are, and nothing as long as the rows passes the driver.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.config import cut_lineage
from weekloom.operators.trees import ProbabilityModel, QuantileModel, Tree, TreeSettings

#: Functions for the executors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Goal:
    """One model to grow. ``quantile`` is None for log loss on a 0/1 label."""

    tag: str
    label: Column
    weight: Column
    quantile: float | None = 0.5


class Partial:
    """A tree while it grows, over bin numbers; ``value`` is set when its leaves are known."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value = [-1], [0], [-1], [-1], [0.0]

    def split(self, node: int, feature: int, at: int) -> list[int]:
        new = [len(self.feature), len(self.feature) + 1]
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, new[0], new[1]
        for part, blank in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            part += [blank] * 2
        return new

    def arrays(self) -> tuple:
        return tuple(np.asarray(x) for x in (self.feature, self.bin, self.left, self.right, self.value))


def leaf_of(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """Node that each row of bin numbers ends in."""
    feature, at, left, right, _ = tree
    node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while (feature[node] >= 0).any():
        f = feature[node]
        onward = np.where(bins[every, np.maximum(f, 0)] <= at[node], left[node], right[node])
        node = np.where(f >= 0, onward, node)
    return node


def gradients(quantile: float | None, y: np.ndarray, now: np.ndarray) -> np.ndarray:
    if quantile is None:
        return y - 1.0 / (1.0 + np.exp(-now))
    return np.where(y >= now, quantile, quantile - 1.0)


def histogram(bins: np.ndarray, slot: np.ndarray, slots: int, width: int, g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of weight and weighted gradient by (slot, feature, bin)."""
    n, features = bins.shape
    at = ((slot[:, None] * features + np.arange(features)) * width + bins).ravel()
    size = slots * features * width
    sums = [np.bincount(at, np.repeat(v, features), size) for v in (w, w * g)] if n else [np.zeros(size)] * 2
    return np.stack(sums, 1).reshape(slots, features, width, 2)


def best_split(sums: np.ndarray) -> tuple[int, int] | None:
    """(feature, bin) that lowers the squared error of the gradient most; ties to the first feature and lowest bin."""
    w, g = np.cumsum(sums[:, :, 0], 1), np.cumsum(sums[:, :, 1], 1)
    total_w, total_g = w[:, -1:], g[:, -1:]
    rest = total_w - w
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((w > 0) & (rest > 1e-9), g**2 / w + (total_g - g) ** 2 / rest - total_g**2 / total_w, -1.0)
    gain = np.round(gain, 12)
    at = int(np.argmax(gain))
    return divmod(at, gain.shape[1]) if gain.flat[at] > 1e-9 else None


class _Rows:
    """Rows of a batch as arrays: bin numbers, labels, weights and predictions by goal."""

    def __init__(self, batch: pa.RecordBatch, goals: int, grown: list[list[tuple]]):
        n = batch.num_rows
        self.bins = np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(n, -1)
        self.y, self.w, self.now = (
            np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(n, goals).copy() for c in ("y", "w", "f")
        )
        for k, trees in enumerate(grown):
            for tree in trees:
                self.now[:, k] += tree[4][leaf_of(tree, self.bins)]


def _level(quantiles: list, grown: list, partial: list, open_nodes: list[list[int]], width: int):
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows(batch, len(quantiles), grown)
            for k, nodes in enumerate(open_nodes):
                if not nodes:
                    continue
                slot_of = np.full(len(partial[k][0]), -1)
                slot_of[nodes] = np.arange(len(nodes))
                slot = slot_of[leaf_of(partial[k], rows.bins)]
                own = (rows.w[:, k] > 0) & (slot >= 0)
                g = gradients(quantiles[k], rows.y[own, k], rows.now[own, k])
                made = histogram(rows.bins[own], slot[own], len(nodes), width, g, rows.w[own, k])
                sums[k] = sums[k] + made if k in sums else made
        out = [(k, node, sums[k][i].tobytes()) for k in sums for i, node in enumerate(open_nodes[k])]
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], ["goal", "node", "sums"])

    return run


def _splitter(features: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
        found = best_split(sums.reshape(features, width, 2))
        if found is None:
            return pa.table({n: pa.array([], t) for n, t in (("goal", pa.int64()), ("node", pa.int64()), ("feature", pa.int64()), ("bin", pa.int64()))})
        key = [table.column(c)[0].as_py() for c in ("goal", "node")]
        return pa.table({n: pa.array([v], pa.int64()) for n, v in zip(("goal", "node", "feature", "bin"), (*key, *found), strict=True)})

    return run


def _leaves(quantiles: list, grown: list, partial: list):
    """Residuals of each goal's rows in their leaves, as often as they weigh; sums of the Newton step for log loss."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows(batch, len(quantiles), grown)
            for k, q in enumerate(quantiles):
                own = rows.w[:, k] > 0
                leaf = leaf_of(partial[k], rows.bins[own])
                y, w, now = rows.y[own, k], rows.w[own, k], rows.now[own, k]
                if q is None:
                    p = 1.0 / (1.0 + np.exp(-now))
                    nodes, at = np.unique(leaf, return_inverse=True)
                    cols = [nodes, np.zeros(len(nodes)), np.bincount(at, w * (y - p)), np.bincount(at, w * p * (1 - p))]
                else:
                    often = w.astype(np.int64)
                    cols = [np.repeat(leaf, often), np.repeat(y - now, often), *[np.zeros(int(often.sum()))] * 2]
                if len(cols[0]):
                    goal = np.full(len(cols[0]), k, np.int64)
                    yield pa.record_batch([pa.array(c) for c in (goal, *cols)], ["goal", "leaf", "residual", "up", "down"])

    return run


def _leaf_values(base: DataFrame, goals: list[Goal], grown: list, partial: list) -> dict[tuple[int, int], float]:
    """Residual quantile, or Newton step, of every leaf; quantiles exact up to 10,000 distinct values, then to 1 in 10,000 of rank."""
    quantiles = [g.quantile for g in goals]
    asked = sorted({q for q in quantiles if q is not None}) or [0.5]
    rows = base.mapInArrow(_leaves(quantiles, grown, partial), "goal long, leaf long, residual double, up double, down double")
    found = rows.groupBy("goal", "leaf").agg(
        F.percentile_approx("residual", asked, 10000).alias("q"), F.sum("up").alias("up"), F.sum("down").alias("down")
    )
    out = {}
    for r in found.collect():  # at most 2**depth rows a goal
        q = quantiles[r["goal"]]
        out[r["goal"], r["leaf"]] = r["q"][asked.index(q)] if q is not None else r["up"] / max(r["down"], 1e-12)
    return out


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to ``bins - 1`` cut points of each feature at equal ranks; a value belongs to the first cut it does not exceed."""
    asked = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), asked, 10000).alias(c) for c in features]).first()
    return [sorted({float(v) for v in (found[c] or []) if v == v}) for c in features]


def _binned(rows: DataFrame, features: list[str], cuts: list[list[float]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.asarray(batch.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(n, len(cuts))
            bins = _bins_of(x, cuts)
            yield pa.record_batch(
                [pa.array([r.tobytes() for r in bins], pa.binary()), batch.column("y"), batch.column("w"), batch.column("f")], ["b", "y", "w", "f"]
            )

    array = "array<double>"
    return rows.mapInArrow(run, f"b binary, y {array}, w {array}, f {array}")


def _advanced(base: DataFrame, goals: int, grown: list) -> DataFrame:
    """Rows with the trees' values added to their predictions."""

    def run(batches):
        for batch in batches:
            rows = _Rows(batch, goals, grown)
            offsets = pa.array(np.arange(batch.num_rows + 1) * goals, pa.int32())
            now = pa.ListArray.from_arrays(offsets, pa.array(rows.now.ravel()))
            yield pa.record_batch([batch.column("b"), batch.column("y"), batch.column("w"), now], ["b", "y", "w", "f"])

    return base.mapInArrow(run, base.schema)


def grow(
    rows: DataFrame, features: list[str], goals: list[Goal], settings: TreeSettings = TreeSettings(), cuts_from: Column | None = None
) -> dict[str, QuantileModel]:
    """Fit all goals on the rows they weigh. Weights of quantile goals are whole numbers: a row counts that often.

    ``cuts_from`` picks the rows whose features set the cut points, the earliest training set where later years are
    held out. A goal without rows is left out of the result. A leaf starts at the weighted log odds or the quantile.
    """
    numbers = lambda cols: F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    weights = numbers([g.weight for g in goals])
    picked = rows.select("*", weights.alias("_w")).where(F.exists("_w", lambda w: w > 0))
    picked = cut_lineage(picked)
    cuts = cut_points(picked.where(cuts_from) if cuts_from is not None else picked, features, settings.bins)
    width = max((len(c) for c in cuts), default=0) + 1
    shaped = picked.select(
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features]).alias("x"),
        numbers([g.label for g in goals]).alias("y"), F.col("_w").alias("w"), F.array(*[F.lit(0.0)] * len(goals)).alias("f"),
    )
    base = cut_lineage(_binned(shaped, features, cuts))
    quantiles, none = [g.quantile for g in goals], [[] for _ in goals]
    starts = _starts(base, goals)
    live = [k for k in range(len(goals)) if k in starts]
    grown = [[_stump(starts.get(k, 0.0))] for k in range(len(goals))]
    kept: list[list[tuple]] = [[] for _ in goals]
    for turn in range(settings.rounds):
        trees = [Partial() for _ in goals]
        open_nodes = [[0] if k in live else [] for k in range(len(goals))]
        for _ in range(settings.depth):
            if not any(open_nodes):
                break
            partial = [t.arrays() for t in trees]
            sums = base.mapInArrow(_level(quantiles, grown, partial, open_nodes, width), "goal long, node long, sums binary")
            found = sums.groupBy("goal", "node").applyInArrow(_splitter(len(features), width), "goal long, node long, feature long, bin long")
            open_nodes = [[] for _ in goals]
            for r in sorted(found.collect()):  # at most one row a node
                open_nodes[r["goal"]] += trees[r["goal"]].split(r["node"], r["feature"], r["bin"])
        values = _leaf_values(base, goals, grown, [t.arrays() for t in trees])
        for k in live:
            tree = trees[k]
            tree.value = [settings.step * values.get((k, i), 0.0) if f < 0 else 0.0 for i, f in enumerate(tree.feature)]
            grown[k].append(tree.arrays())
            kept[k].append(grown[k][-1])
        if (turn + 1) % settings.lineage_every == 0 and turn + 1 < settings.rounds:
            base = cut_lineage(_advanced(base, len(goals), grown))
            grown = [list(x) for x in none]
    out = {}
    for k in live:
        kind = ProbabilityModel if goals[k].quantile is None else QuantileModel
        q = 0.5 if goals[k].quantile is None else goals[k].quantile
        out[goals[k].tag] = kind(q, starts[k], list(features), [_on_values(t, cuts) for t in kept[k]])
    return out


# --- one model per key -----------------------------------------------------------------

NODES = "tag string, tree int, node int, feature int, threshold double, left int, right int, value double"
_NODE_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
_NODE_NAMES = [f.split(" ")[0] for f in NODES.split(", ")]


def _rank_value(values: np.ndarray, q: float) -> float:
    """The value at rank ceil(q * n), as Spark's percentile_approx has it."""
    at = max(0, int(np.ceil(q * len(values))) - 1)
    return float(np.partition(values, at)[at])


def _cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """``cut_points`` of the rows of one key."""
    asked, cuts = np.arange(1, bins) / bins, []
    for column in x.T:
        known = np.sort(column[~np.isnan(column)])
        at = np.maximum(np.ceil(asked * len(known)).astype(int) - 1, 0)
        cuts.append(np.unique(known[at]) if len(known) else np.zeros(0))
    return cuts


def _bins_of(x: np.ndarray, cuts: list) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1).astype(np.uint8)


def _fit_one(bins: np.ndarray, cuts: list, y: np.ndarray, w: np.ndarray, quantile: float | None, settings: TreeSettings) -> list[tuple]:
    """Trees over values for the rows of one key; the first is the start value."""
    own = w > 0
    bins, y, w = bins[own], y[own], w[own]
    if not len(y):
        return []
    often, width = w.astype(np.int64), max((len(c) for c in cuts), default=0) + 1
    if quantile is None:
        mean = min(1 - 1e-6, max(1e-6, float(np.average(y, weights=w))))
        start = float(np.log(mean / (1 - mean)))
    else:
        start = _rank_value(np.repeat(y, often), quantile)
    now, trees = np.full(len(y), start), [_stump(start)]
    for _ in range(settings.rounds):
        g, tree, open_nodes, leaf = gradients(quantile, y, now), Partial(), [0], np.zeros(len(y), np.int64)
        for _ in range(settings.depth):
            if not open_nodes:
                break
            slot_of = np.full(len(tree.feature), -1)
            slot_of[open_nodes] = np.arange(len(open_nodes))
            slot = slot_of[leaf]
            inside = slot >= 0
            sums = histogram(bins[inside], slot[inside], len(open_nodes), width, g[inside], w[inside])
            made = []
            for i, node in enumerate(open_nodes):
                found = best_split(sums[i])
                if found:
                    made += (children := tree.split(node, *found))
                    rows = leaf == node
                    leaf[rows] = np.where(bins[rows, found[0]] <= found[1], *children)
            open_nodes = made
        p = 1.0 / (1.0 + np.exp(-now))
        for node in np.unique(leaf):
            rows = leaf == node
            if quantile is None:
                value = float(np.sum(w[rows] * (y[rows] - p[rows]))) / max(float(np.sum(w[rows] * p[rows] * (1 - p[rows]))), 1e-12)
            else:
                value = _rank_value(np.repeat(y[rows] - now[rows], often[rows]), quantile)
            tree.value[node] = settings.step * value
        now += np.asarray(tree.value)[leaf]
        trees.append(tree.arrays())
    found = [_on_values(t, cuts) for t in trees[1:]]
    return [trees[0], *[tuple(np.asarray(v) for v in (t.feature, t.threshold, t.left, t.right, t.value)) for t in found]]


def grow_each(rows: DataFrame, by: list[str], features: list[str], goals: list[Goal], settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Fit every goal for every key of ``by`` on its own rows: a node table (``by``, NODES).

    For keys whose rows the calendar bounds, one series or one fold of it: a key's rows meet in one group, and all keys
    are fitted in one Spark job. Tree 0 of a model is its start value. A goal without rows leaves no nodes.
    """
    tags, quantiles = [g.tag for g in goals], [g.quantile for g in goals]
    shaped = rows.select(
        *by, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"x{j}") for j, c in enumerate(features)],
        *[F.coalesce(g.label.cast("double"), F.lit(0.0)).alias(f"y{k}") for k, g in enumerate(goals)],
        *[F.coalesce(g.weight.cast("double"), F.lit(0.0)).alias(f"w{k}") for k, g in enumerate(goals)],
    )
    keyed = rows.select(*by).schema

    def run(table: pa.Table) -> pa.Table:
        x = np.stack([table.column(f"x{j}").to_numpy() for j in range(len(features))], 1)
        y, w = (np.stack([table.column(f"{c}{k}").to_numpy() for k in range(len(tags))], 1) for c in "yw")
        used = (w > 0).any(1)
        x, y, w = x[used], y[used], w[used]
        cuts = _cuts_of(x, settings.bins)
        bins = _bins_of(x, cuts)
        cols: list[list] = [[] for _ in _NODE_NAMES]
        for k, (tag, quantile) in enumerate(zip(tags, quantiles, strict=True)):
            trees = _fit_one(bins, cuts, y[:, k], w[:, k], quantile, settings)
            for t, tree in enumerate(trees):
                n = len(tree[0])
                for col, part in zip(cols, ([tag] * n, [t] * n, range(n), *(v.tolist() for v in tree)), strict=True):
                    col.extend(part)
        made = [pa.array(c, kind) for c, kind in zip(cols, _NODE_TYPES, strict=True)]
        own = [pa.repeat(table.column(c)[0], len(cols[0])) for c in by]
        return pa.table([*own, *made], [*by, *_NODE_NAMES])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keyed), NODES])
    return shaped.groupBy(*by).applyInArrow(run, schema)


class Forest:
    """All trees of one model as padded arrays; scores many rows and all trees at once."""

    def __init__(self, nodes: list[tuple]):
        trees: dict[int, list[tuple]] = {}
        for tree, *rest in sorted(nodes):
            trees.setdefault(tree, []).append(rest)
        size = max((len(t) for t in trees.values()), default=1)
        self.feature, self.threshold, self.left, self.right, self.value = (
            np.full((len(trees), size), v, d) for v, d in ((-1, np.int64), (0, float), (0, np.int64), (0, np.int64), (0, float))
        )
        for t, tree in enumerate(trees.values()):
            for node, *cells in tree:
                for part, cell in zip((self.feature, self.threshold, self.left, self.right, self.value), cells, strict=True):
                    part[t, node] = cell

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' leaf values for each row of ``x``."""
        every, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        while True:
            f = self.feature[every, node]
            inner = f >= 0
            if not inner.any():
                return self.value[every, node].sum(1)
            left = x[rows, np.maximum(f, 0)] <= self.threshold[every, node]
            node = np.where(inner, np.where(left, self.left[every, node], self.right[every, node]), node)


def forests(nodes: pa.Table) -> dict[str, Forest]:
    """Forest by tag of one key's node table."""
    by_tag: dict[str, list[tuple]] = {}
    for tag, *rest in zip(*(nodes.column(c).to_pylist() for c in _NODE_NAMES), strict=True):
        by_tag.setdefault(tag, []).append(tuple(rest))
    return {tag: Forest(rows) for tag, rows in by_tag.items()}


def score_each(rows: DataFrame, nodes: DataFrame, by: list[str], features: list[str], outputs: dict[str, str]) -> DataFrame:
    """Rows with a raw score column for each model tag in ``outputs``; the key's own node table meets its rows."""
    seen = rows.select("*", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features]).alias("_x"))
    names = rows.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        made = forests(right)
        x = np.asarray(left.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(n, len(features)) if n else None
        cols = [left.column(c) for c in names]
        for tag in outputs:
            cols.append(pa.array(made[tag].score(x) if n and tag in made else [None] * n, pa.float64()))
        return pa.table(cols, [*names, *outputs.values()])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(o, T.DoubleType()) for o in outputs.values())])
    return seen.groupBy(*by).cogroup(nodes.groupBy(*by)).applyInArrow(run, schema)


def _stump(value: float) -> tuple:
    tree = Partial()
    tree.value = [value]
    return tree.arrays()


def _starts(base: DataFrame, goals: list[Goal]) -> dict[int, float]:
    """Start value of every goal that has rows."""
    flat = [_stump(0.0) for _ in goals]
    found = {k: v for (k, _), v in _leaf_values(base, goals, [[] for _ in goals], flat).items()}
    for k, goal in enumerate(goals):
        if goal.quantile is None and k in found:
            # The step from even odds is (mean - 1/2) / (1/4).
            mean = min(1 - 1e-6, max(1e-6, found[k] / 4 + 0.5))
            found[k] = float(np.log(mean / (1 - mean)))
    return {k: float(v) for k, v in found.items()}


def _on_values(tree: tuple, cuts: list[list[float]]) -> Tree:
    """The tree over feature values: bins up to ``b`` hold the values up to cut ``b``."""
    feature, at, left, right, value = tree
    limit = [float(cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(feature.tolist(), at.tolist(), strict=True)]
    return Tree(feature.tolist(), limit, left.tolist(), right.tolist(), value.tolist())
