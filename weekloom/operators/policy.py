"""Gate search, residual scales, upper offsets, persistence fallback and promotion rules."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import Guardrails
from weekloom.functions.rules import safe_ratio
from weekloom.operators.metrics import pinball
from weekloom.operators.ordered import exact_quantiles

# The candidate grids.
POLICY_GATES = [k * 5 / 100 for k in range(1, 19)]  # 0.05 .. 0.90
RECALL_GATES = [k / 100 for k in range(5, 96)]  # 0.05 .. 0.95
RESIDUAL_SCALES = [k * 5 / 100 for k in range(31)]  # 0 .. 1.5


def gate_table(
    df: DataFrame,
    keys: list[str],
    gates: list[float],
    probability: str = "probability",
    label: str = "label",
    losses: tuple[str, str] | None = None,
) -> DataFrame:
    """Precision, recall and, with ``losses``, blended error of every gate.

    A row passes all gates up to its probability, so rows are counted once per step of the
    grid and summed from the top: the input is never multiplied by the number of gates.
    ``losses`` names the error when the alert is raised and when it is not.
    """
    edges = [float("-inf"), *gates, float("inf")]
    y = F.col(label).cast("int")
    raised, quiet = (F.col(losses[0]), F.col(losses[1])) if losses else (F.lit(0.0), F.lit(0.0))
    placed = Bucketizer(splits=edges, inputCol="_p", outputCol="_step").transform(
        df.select(
            *keys, F.col(probability).cast("double").alias("_p"), y.alias("_y"), raised.alias("_r"), quiet.alias("_q")
        )
    )
    counted = placed.groupBy(*keys, F.col("_step").cast("int").alias("_step")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_y").alias("_pos"),
        F.sum("_r").alias("_raised"),
        F.sum("_q").alias("_quiet"),
    )
    # Steps nobody falls on still are gates: lay the whole grid under each key.
    grid = F.array(*[F.struct(F.lit(i).alias("_step"), F.lit(edges[i]).alias("gate")) for i in range(len(gates) + 1)])
    base = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_steps")) if keys else counted.agg(
        F.count(F.lit(1)).alias("_steps")
    )
    laid = base.select(*keys, F.explode(grid).alias("_g")).select(*keys, "_g._step", "_g.gate")
    full = laid.join(counted, [*keys, "_step"], "left").fillna(0, ["_n", "_pos"]).fillna(0.0, ["_raised", "_quiet"])
    w = Window.partitionBy(*keys).orderBy(F.col("_step").desc())  # at most one row per gate
    up, every = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    summed = full.select(
        *keys,
        "_step",
        "gate",
        F.sum("_n").over(up).alias("alert_rows"),
        F.sum("_pos").over(up).alias("true_positives"),
        F.sum("_pos").over(every).alias("positive_rows"),
        F.sum("_n").over(every).alias("rows"),
        (
            F.sum("_raised").over(up) + F.sum("_quiet").over(every) - F.sum("_quiet").over(up)
        ).alias("_loss"),
    ).filter("_step > 0")
    out = [
        *keys,
        "gate",
        "alert_rows",
        "true_positives",
        safe_ratio(F.col("true_positives"), F.col("alert_rows")).alias("precision"),
        safe_ratio(F.col("true_positives"), F.col("positive_rows")).alias("recall"),
    ]
    if losses:
        out.append((F.col("_loss") / F.col("rows")).alias("mae"))
    return summed.select(*out)


def _first(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)  # one row per gate
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*keys, F.col("gate").alias(name))


def recall_gate(
    df: DataFrame, keys: list[str], target_recall: float, probability: str = "probability", label: str = "label"
) -> DataFrame:
    """Most precise gate that reaches the target recall, the highest on ties; else best recall."""
    table = gate_table(df, keys, RECALL_GATES, probability, label)
    ok = F.col("recall") >= target_recall
    order = [
        ok.desc(),
        F.when(~ok, F.col("recall")).desc_nulls_last(),
        F.col("precision").desc(),
        F.col("gate").desc(),
    ]
    return _first(table, keys, order, "alert_gate")


def policy_gates(
    df: DataFrame,
    keys: list[str],
    probability: str,
    label: str,
    actual: str,
    outbreak_prediction: str,
    normal_prediction: str,
    target_recall: float = 0.80,
) -> DataFrame:
    """MAE gate (lowest blended error, then highest gate) and recall gate (lowest gate at target)."""
    a = F.col(actual).cast("double")
    # round() keeps equal-loss ties equal whatever the order of summation.
    rows = df.select(
        *keys,
        probability,
        label,
        F.abs(a - F.col(outbreak_prediction)).alias("_if_raised"),
        F.abs(a - F.col(normal_prediction)).alias("_if_quiet"),
    )
    table = gate_table(rows, keys, POLICY_GATES, probability, label, ("_if_raised", "_if_quiet")).withColumn(
        "_m", F.round("mae", 9)
    )
    mae = _first(table, keys, [F.col("_m").asc(), F.col("gate").desc()], "mae_gate")
    ok = F.col("recall") >= target_recall
    order = [
        ok.desc(),
        F.when(~ok, F.col("recall")).desc_nulls_last(),
        F.col("gate").asc(),
        F.col("precision").desc(),
        F.col("_m").asc(),
    ]
    recall = _first(table, keys, order, "recall_gate")
    return mae.join(recall, keys) if keys else mae.crossJoin(F.broadcast(recall))


def residual_scales(
    df: DataFrame,
    keys: list[str],
    actual: str,
    baseline: str,
    residuals: dict[float, str],
) -> DataFrame:
    """Best shrink factor of each quantile's residual; the smaller factor wins a tie.

    All factors are separate aggregates over one pass, so no row is copied per factor.
    """
    a, b = F.col(actual).cast("double"), F.col(baseline).cast("double")
    aggs = []
    for q, column in residuals.items():
        losses = []
        for s in RESIDUAL_SCALES:
            p = F.greatest(F.lit(0.0), b + F.lit(s) * F.col(column))
            loss = F.abs(a - p) if q == 0.5 else pinball(a, p, q)
            losses.append(F.struct(F.round(F.avg(loss), 9).alias("loss"), F.lit(s).alias("scale")))
        aggs.append(F.array_min(F.array(*losses))["scale"].alias(f"scale_p{round(q * 100)}"))
    return df.groupBy(*keys).agg(*aggs)


def upper_offsets(
    df: DataFrame, keys: list[str], actual: str, median_prediction: str, weekly_groups: bool = False
) -> DataFrame:
    """Non-negative P80 and P90 of pooled errors above the median forecast.

    ``weekly_groups`` says that a group is the weeks of one series, so short that the built-in
    exact percentile may hold it.
    """
    errors = df.select(*keys, (F.col(actual).cast("double") - F.col(median_prediction)).alias("_e"))
    points = {"offset_p80": 0.80, "offset_p90": 0.90}
    if weekly_groups:
        found = errors.groupBy(*keys).agg(*[F.percentile("_e", F.lit(q)).alias(n) for n, q in points.items()])
    else:
        found = exact_quantiles(errors, keys, "_e", points)
    return found.select(*keys, *[F.greatest(F.lit(0.0), F.col(c)).alias(c) for c in points])


def persistence_fallback(
    df: DataFrame,
    keys: list[str],
    actual: str = "actual_cases",
    persistence: str = "cases_lag_1",
    offsets: tuple[str, str] = ("offset_p80", "offset_p90"),
) -> DataFrame:
    """Use the last report as P50 in the series where the model's MAE is worse than it."""
    a = F.col(actual).cast("double")
    score = df.groupBy(*keys).agg(
        (F.avg(F.abs(a - F.col("predicted_cases_p50"))) > F.avg(F.abs(a - F.col(persistence).cast("double")))).alias(
            "used_persistence_fallback"
        )
    )
    joined = df.join(score, keys) if keys else df.crossJoin(F.broadcast(score))
    use, last = F.col("used_persistence_fallback"), F.col(persistence).cast("double")
    fixed = {"predicted_cases_p50": F.when(use, last).otherwise(F.col("predicted_cases_p50"))}
    for tag, offset in zip(("p80", "p90"), offsets):
        p = F.col(f"predicted_cases_{tag}")
        fixed[f"predicted_cases_{tag}"] = F.when(use, F.greatest(p, last + F.col(offset))).otherwise(p)
    return joined.select(
        *[fixed[c].alias(c) if c in fixed else F.col(c) for c in df.columns], "used_persistence_fallback"
    )


# metric -> (kind of comparison, tolerance). ``lower``/``upper`` are absolute, ``relative`` a factor.
def _rules(g: Guardrails) -> dict[str, tuple[str, float]]:
    return {
        "precision": ("lower", g.precision_tolerance),
        "recall": ("lower", g.recall_tolerance),
        "pr_auc": ("lower", g.pr_auc_tolerance),
        "brier": ("upper", g.brier_tolerance),
        "case_mae": ("relative", g.case_mae_relative_tolerance),
        "outbreak_week_mae": ("relative", g.outbreak_mae_relative_tolerance),
        "persistence": ("relative", g.persistence_relative_tolerance),
    }


def promotion_rules(
    candidate: DataFrame,
    champion: DataFrame,
    candidate_models: DataFrame,
    champion_models: DataFrame,
    series: list[str],
    guardrails: Guardrails = Guardrails(),
    minimum_new_weeks: int = 13,
) -> DataFrame:
    """One row per series and rule: passed or not, and why.

    ``candidate``/``champion``: (series, route, metric, value) with the metrics precision,
    recall, pr_auc, brier, case_mae, outbreak_week_mae and, for case-aware routes,
    persistence_mae. ``*_models``: (series, training_data_cutoff, model_schema_version,
    case_forecast_schema_version), one row per series. A series without a champion passes
    by one bootstrap rule.
    """
    rules = _rules(guardrails)
    new = candidate_models.select(
        *series,
        F.col("training_data_cutoff").alias("_nc"),
        F.struct("model_schema_version", "case_forecast_schema_version").alias("_nv"),
    )
    old = champion_models.select(
        *series,
        F.col("training_data_cutoff").alias("_oc"),
        F.struct("model_schema_version", "case_forecast_schema_version").alias("_ov"),
        F.lit(True).alias("_has"),
    )
    pair = new.join(old, series, "left").select(
        *series,
        F.coalesce("_has", F.lit(False)).alias("_has"),
        F.floor(F.datediff("_nc", "_oc") / 7).cast("bigint").alias("_weeks"),
        (~F.col("_nv").eqNullSafe(F.col("_ov"))).alias("_upgrade"),
    )
    boot = pair.filter("NOT _has").select(
        *series,
        F.lit("all").alias("route"),
        F.lit("bootstrap").alias("rule"),
        F.lit(None).cast("double").alias("candidate_value"),
        F.lit(None).cast("double").alias("champion_value"),
        F.lit(True).alias("passed"),
        F.lit("bootstrap: no champion exists").alias("reason"),
    )
    wait = pair.filter("_has").select(
        *series,
        F.lit("all").alias("route"),
        F.lit("new_weeks").alias("rule"),
        F.col("_weeks").cast("double").alias("candidate_value"),
        F.lit(float(minimum_new_weeks)).alias("champion_value"),
        (F.col("_upgrade") | (F.col("_weeks") >= minimum_new_weeks)).alias("passed"),
        F.concat(
            F.lit("new finalized weeks: "),
            F.col("_weeks").cast("string"),
            F.lit(f" (minimum {minimum_new_weeks}); "),
            F.when(F.col("_upgrade"), "schema upgrade").otherwise("schema unchanged"),
        ).alias("reason"),
    )
    guarded = [m for m in rules if m != "persistence"]
    both = (
        candidate.filter(F.col("metric").isin(guarded))
        .select(*series, "route", "metric", F.col("value").alias("_new"))
        .join(
            champion.filter(F.col("metric").isin(guarded)).select(*series, "route", "metric", F.col("value").alias("_old")),
            [*series, "route", "metric"],
            "full_outer",
        )
        .join(pair.filter("_has"), series)
    )
    n, o = F.col("_new"), F.col("_old")
    verdict = F.lit(None).cast("boolean")
    for metric, (kind, tolerance) in rules.items():
        test = {
            "lower": n >= o - F.lit(tolerance),
            "upper": n <= o + F.lit(tolerance),
            "relative": n <= o * F.lit(1.0 + tolerance),
        }[kind]
        verdict = F.when(F.col("metric") == metric, test).otherwise(verdict)
    established = o.isNull() & n.isNotNull() & F.col("_upgrade")
    compared = both.select(
        *series,
        "route",
        F.col("metric").alias("rule"),
        n.alias("candidate_value"),
        o.alias("champion_value"),
        F.when(established, F.lit(True)).otherwise(F.coalesce(verdict, F.lit(False))).alias("passed"),
        F.concat(
            F.col("route"),
            F.lit(" "),
            F.col("metric"),
            F.when(established, ": baseline established")
            .when(n.isNull() | o.isNull(), ": fail (metric missing)")
            .when(verdict, ": pass")
            .otherwise(": fail"),
        ).alias("reason"),
    )
    # Case-aware routes of the candidate must also hold against persistence.
    wide = (
        candidate.filter(F.col("metric").isin("case_mae", "persistence_mae") & (F.col("route") != "weather_only"))
        .groupBy(*series, "route")
        .agg(
            F.max(F.when(F.col("metric") == "case_mae", F.col("value"))).alias("_m"),
            F.max(F.when(F.col("metric") == "persistence_mae", F.col("value"))).alias("_p"),
        )
        .filter("_m IS NOT NULL")
        .join(pair.filter("_has").select(*series), series)
    )
    held = F.coalesce(F.col("_m") <= F.col("_p") * F.lit(1.0 + guardrails.persistence_relative_tolerance), F.lit(False))
    persist = wide.select(
        *series,
        "route",
        F.lit("persistence").alias("rule"),
        F.col("_m").alias("candidate_value"),
        F.col("_p").alias("champion_value"),
        held.alias("passed"),
        F.concat(
            F.col("route"),
            F.lit(" persistence"),
            F.when(F.col("_p").isNull(), ": fail (metric missing)").when(held, ": pass").otherwise(": fail"),
        ).alias("reason"),
    )
    return boot.unionByName(wait).unionByName(compared).unionByName(persist)


def promotion_decision(rules: DataFrame, series: list[str]) -> DataFrame:
    """Promote where every rule passed; a series has a few dozen rules at most."""
    return rules.groupBy(*series).agg(
        F.bool_and("passed").alias("promote"),
        F.count(F.lit(1)).alias("rule_count"),
        F.count_if(~F.col("passed")).alias("failed_rules"),
        F.array_sort(F.collect_list("reason")).alias("reasons"),
    )


def merge_slots(slots: DataFrame, candidates: DataFrame, decision: DataFrame, series: list[str]) -> DataFrame:
    """Champion slots after a decision: each series keeps its model unless its own candidate is promoted.

    ``slots`` and ``candidates`` hold one model row per series with the same columns. A series without a champion whose
    candidate fails has no slot afterwards.
    """
    rest = [c for c in slots.columns if c not in series]
    promoted = candidates.join(decision.where("promote").select(*series), series, "left_semi")
    kept = slots.join(promoted.select(*series), series, "left_anti")
    return kept.select(*series, *rest).unionByName(promoted.select(*series, *rest))


def retrain_due(
    finalized: DataFrame,
    models: DataFrame,
    series: list[str],
    minimum_new_weeks: int = 13,
    schema_version: int | None = None,
    case_schema_version: int | None = None,
) -> DataFrame:
    """New finalized weeks per series since the current compatible model's cut-off."""
    usable = models
    if schema_version is not None:
        usable = usable.filter(F.col("model_schema_version") == schema_version)
    if case_schema_version is not None:
        usable = usable.filter(F.col("case_forecast_schema_version") == case_schema_version)
    newest = finalized.groupBy(*series).agg(F.max("week_start_date").alias("latest_finalized_week"))
    joined = newest.join(usable.select(*series, "training_data_cutoff"), series, "left")
    weeks = F.floor(F.datediff("latest_finalized_week", "training_data_cutoff") / 7).cast("bigint")
    return joined.withColumn("new_finalized_weeks", weeks).withColumn(
        "retrain_due", F.col("training_data_cutoff").isNull() | (F.col("new_finalized_weeks") >= minimum_new_weeks)
    )


def current_models(history: DataFrame, series: list[str], schema_version: int, case_schema_version: int) -> DataFrame:
    """Latest promoted, compatible model version of each series from the append-only history."""
    compatible = history.filter(
        (F.col("model_schema_version") == schema_version)
        & (F.col("case_forecast_schema_version") == case_schema_version)
    )
    rest = [c for c in history.columns if c not in series]
    newest = compatible.groupBy(*series).agg(
        F.max_by(F.struct(*rest), F.struct("promoted_at_utc", "model_version")).alias("_m")
    )
    return newest.select(*series, "_m.*")


def finalized(cases: DataFrame, as_of: Column, weeks: int = 4) -> DataFrame:
    """Weeks that ended before the stabilization buffer."""
    return cases.filter(F.date_add("week_start_date", 6) <= F.date_sub(as_of.cast("date"), 7 * weeks))
