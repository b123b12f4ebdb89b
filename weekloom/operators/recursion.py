"""Week-by-week forecasts that feed on their own predictions, as one fold over each series' step array.

The state of a series is one row: its last counts and its weeks to predict, both bounded by the calendar. A batch
of states is folded together, one matrix operation per week, so the plan has one narrow stage however long the
horizon; where every key has models of its own, they meet the state in one group per key.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators.boosting import Forest, forests

#: Functions for the executors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CASE_HISTORY = ["cases_lag_1", "cases_lag_2", "cases_lag_4", "cases_lag_52", "cases_mean_4", "cases_mean_8", "cases_change_1"]
MEMORY = 52

#: (base features, case features by history, models) -> (outputs, next value of each history); one value per state.
Step = Callable[[np.ndarray, dict[str, np.ndarray], dict[str, Forest]], tuple[dict[str, np.ndarray], dict[str, np.ndarray]]]


def case_features(past: np.ndarray) -> np.ndarray:
    """CASE_HISTORY from the last ``MEMORY`` counts of each state, NaN where there is no such week."""

    def mean(k: int) -> np.ndarray:
        tail = past[:, -k:]
        known = ~np.isnan(tail)
        total, n = np.where(known, tail, 0.0).sum(1), known.sum(1)
        return np.where(n > 0, total / np.maximum(n, 1), np.nan)

    back = {k: past[:, -k] for k in (1, 2, 4, 52)}
    return np.stack([back[1], back[2], back[4], back[52], mean(4), mean(8), back[1] - back[2]], 1)


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.full((len(lists), width), np.nan)
    for i, values in enumerate(lists):
        row = np.array([np.nan if v is None else v for v in values], float)[-width:]
        if len(row):
            out[i, -len(row) :] = row
    return out


def fold_states(states: pa.Table, models: dict[str, Forest], by: list[str], base: list[str], carry: list[str], histories: list[str],
                outputs: dict[str, pa.DataType], step: Step) -> pa.Table:
    """All predicted weeks of some states; the weeks of a state stay in order."""
    steps = states.column("_steps").combine_chunks()
    sizes = np.array([len(s) for s in steps], int)
    flat = steps.flatten()
    total, horizon = len(flat), int(sizes.max(initial=0))
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    x = np.stack([np.asarray(flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in base], 1) if base else np.zeros((total, 0))
    first = _matrix([v.as_py() or [] for v in states.column("_history")], MEMORY)
    past = {h: first.copy() for h in histories}
    made = {name: np.full(total, np.nan) for name in outputs}
    for week in range(horizon):
        alive = np.flatnonzero(sizes > week)
        at = starts[alive] + week
        seen = {h: np.nan_to_num(case_features(past[h][alive]), nan=0.0) for h in histories}
        found, following = step(np.nan_to_num(x[at], nan=0.0), seen, models)
        for name in outputs:
            made[name][at] = found[name]
        for h in histories:
            past[h][alive] = np.concatenate((past[h][alive][:, 1:], following[h][:, None]), 1)
    owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
    cols = [states.column(c).take(owner) for c in by] + [flat.field(c) for c in carry]
    for name, kind in outputs.items():
        cols.append(pa.array(made[name] > 0) if pa.types.is_boolean(kind) else pa.array(made[name], kind))
    return pa.table(cols, [*by, *carry, *outputs])


def _states(rows: DataFrame, by: list[str], base: list[str], carry: list[str], order: str, value: str) -> DataFrame:
    """One row per key: the last ``MEMORY`` training counts and the weeks to predict."""
    training = F.col("fold_role") == "train"
    known = F.array_sort(F.collect_list(F.when(training, F.struct(order, F.col(value).cast("double").alias("v")))))
    weeks = F.array_sort(F.collect_list(F.when(~training, F.struct(order, *[c for c in dict.fromkeys([*carry, *base]) if c != order]))))
    grouped = rows.groupBy(*by).agg(F.transform(known, lambda r: r["v"]).alias("_all"), weeks.alias("_steps"))
    history = F.slice("_all", F.greatest(F.size("_all") - MEMORY + 1, F.lit(1)), F.lit(MEMORY)).alias("_history")
    return grouped.where(F.size("_steps") > 0).select(*by, history, "_steps")


def recursive_forecast(
    rows: DataFrame, by: list[str], base: list[str], step: Step, histories: list[str], carry: list[str], outputs: dict[str, str],
    nodes: DataFrame | None = None, order: str = "week_start_date", value: str = "total_cases",
) -> DataFrame:
    """Predictions of the validation rows of every key, each week from the predictions before it.

    ``rows`` have ``fold_role``; ``base`` are features known beforehand, NULL as 0. Every name in ``histories`` is a course of
    its own: it starts from the training counts and takes what ``step`` returns for it. ``outputs`` maps names to
    ``double`` or ``boolean``. ``nodes`` is a node table keyed by ``by`` whose forests go to ``step``.
    """
    states = _states(rows, by, base, carry, order, value)
    types = {"double": pa.float64(), "boolean": pa.bool_()}
    kinds = {k: types[t] for k, t in outputs.items()}
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{c} {fields[c]}" for c in [*by, *carry]), *(f"{k} {t}" for k, t in outputs.items())])

    if nodes is None:

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield from fold_states(pa.Table.from_batches([batch]), {}, by, base, carry, histories, kinds, step).to_batches()

        return states.mapInArrow(run, schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return fold_states(left, forests(right), by, base, carry, histories, kinds, step)

    return states.join(nodes.select(*by).distinct(), by, "left_semi").groupBy(*by).cogroup(nodes.groupBy(*by)).applyInArrow(meet, schema)


def linear_step(base: list[str], weights: dict[str, float], intercept: float = 0.0) -> Step:
    """A linear model over ``base`` and CASE_HISTORY, never below zero; one history ``_h``, one output ``prediction``."""
    names = [*base, *CASE_HISTORY]
    factors = np.array([weights.get(n, 0.0) for n in names])

    def step(x, past, models):
        made = np.maximum(0.0, np.concatenate((x, past["_h"]), 1) @ factors + intercept)
        return {"prediction": made}, {"_h": made}

    return step


COURSES = ["_h_single", "_h_mae", "_h_recall"]
POLICY = ["slope", "intercept", "mae_gate", "recall_gate"]
TWO_STAGE_OUTPUTS = {
    "single_stage_prediction": "double",
    "two_stage_mae_prediction": "double",
    "two_stage_recall_prediction": "double",
    "outbreak_probability": "double",
    "mae_policy_alert": "boolean",
    "recall_policy_alert": "boolean",
}


def two_stage_parts(x: np.ndarray, models: dict[str, Forest]) -> tuple[np.ndarray, np.ndarray]:
    """Floored predictions of the two specialists; a specialist that had no rows to learn from gives way to the single stage."""
    return tuple(np.maximum(0.0, models.get(tag, models["single"]).score(x)) for tag in ("normal", "outbreak"))


def calibrated(odds: np.ndarray, slope: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Probability from log odds; a slope of 0 stands for a curve that could not be fitted."""
    raw = 1.0 / (1.0 + np.exp(-odds))
    return np.where(slope == 0, raw, 1.0 / (1.0 + np.exp(-(slope * raw + intercept))))


def two_stage_step(width: int) -> Step:
    """Both policies and the single stage; alerts of both policies use the probability of the MAE course.

    The first ``width`` base values are features, then come POLICY.
    """

    def step(x, past, models):
        features, (slope, intercept, mae_gate, recall_gate) = x[:, :width], x[:, width:].T
        seen = {h: np.concatenate((features, past[h]), 1) for h in COURSES}
        single = np.maximum(0.0, models["single"].score(seen["_h_single"]))
        p = calibrated(models["classifier"].score(seen["_h_mae"]), slope, intercept)
        values = {}
        for course, gate in (("_h_mae", mae_gate), ("_h_recall", recall_gate)):
            normal, outbreak = two_stage_parts(seen[course], models)
            values[course] = np.where(p >= gate, outbreak, normal)
        out = (single, values["_h_mae"], values["_h_recall"], p, (p >= mae_gate) * 1.0, (p >= recall_gate) * 1.0)
        return dict(zip(TWO_STAGE_OUTPUTS, out, strict=True)), {"_h_single": single, **values}

    return step
