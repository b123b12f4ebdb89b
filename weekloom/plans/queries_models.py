"""Queries: folds with fitted models, at the programs' settings: 90 rounds, all folds, held-out years and fields.

SQL cannot fit trees. The SQL forms state which rows are scored, their actuals, and facts that the models must
have: errors against those of a constant or of persistence, coverage, order of quantiles, alerts at the gates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import cut_lineage, working_path
from weekloom.operators import features as X
from weekloom.operators import finalfit as FF
from weekloom.operators import forecast as W
from weekloom.operators import models as ML
from weekloom.operators import recursion as R
from weekloom.operators import thresholds as H
from weekloom.operators.folds import expanding_splits
from weekloom.plans import tables as V
from weekloom.plans.queries_rollup import area_weekly
from weekloom.plans.tables import G, doubles, query

WEEK = "week_start_date"
KEY = [*G, WEEK]
FEATURES = [*S.EXACT_FEATURES, *ML.SERIES_FEATURES]
HISTORY_WEATHER = ["air_temperature", "precipitation"]
HISTORY_WEATHER += [c for c in S.WEEKLY_WEATHER if c not in ("temperature_2m_mean", "precipitation_sum")]


def training_frame(spark, sf):
    """Weekly series with exact case features and labels where earlier years allow them."""
    w = V.weekly(spark, sf)
    labels = H.expanding_outbreak_labels(w, G).select(*KEY, "outbreak_threshold", "outbreak_label")
    frame = ML.series_features(X.health_features(w, G), G).dropna(subset=S.EXACT_FEATURES)
    return frame.join(labels, KEY, "left")


def history_frame(spark, sf):
    """Weekly series beside the weather of both areas, for the historical evaluation."""
    wide = (
        area_weekly(spark, sf)
        .groupBy(WEEK)
        .agg(
            F.avg("temperature_2m_mean").alias("air_temperature"),
            F.avg("precipitation_sum").alias("precipitation"),
            *[F.avg(c).alias(c) for c in HISTORY_WEATHER[2:]],
        )
    )
    return V.weekly(spark, sf).join(wide, WEEK, "left")


_SCORED = "FROM v_lags WHERE cases_mean_8 IS NOT NULL AND year >= 2000"


@query(
    "point_regressor",
    f"""
SELECT geography, CAST(count(*) AS BIGINT) AS scored_rows, round(avg(abs(total_cases - cases_lag_1)), 6) AS persistence_mae,
 TRUE AS below_constant_mae, TRUE AS never_negative {_SCORED} GROUP BY geography""",
    ("v_lags",),
)
def _(spark, sf):
    """Held-out rows by series beside persistence; ``below_constant_mae``: the training error is below that of the series' median."""
    rows = cut_lineage(training_frame(spark, sf))
    model = ML.point_regressor(rows.filter("year < 2000"), FEATURES, "total_cases", ML.TreeSettings())
    scored = ML.predict_point(model, rows, FEATURES, "prediction").withColumn("held", F.col("year") >= 2000)
    constants = rows.filter("year < 2000").groupBy(*G).agg(F.median("total_cases").alias("constant"))
    miss = lambda c, rows: F.avg(F.when(rows, F.abs(F.col("total_cases") - F.col(c))))
    held = F.col("held")
    return scored.join(constants, G).groupBy(*G).agg(
        F.count_if(held).alias("scored_rows"), F.round(miss("cases_lag_1", held), 6).alias("persistence_mae"),
        (miss("prediction", ~held) < miss("constant", ~held)).alias("below_constant_mae"), F.bool_and(F.col("prediction") >= 0).alias("never_negative"),
    )


@query(
    "outbreak_classifier",
    """
SELECT geography, week_start_date, l.outbreak_label, TRUE AS outbreaks_score_higher, TRUE AS probability_holds
FROM v_labelled l JOIN v_lags g USING (geography, week_start_date)
WHERE l.outbreak_label IS NOT NULL AND g.cases_mean_8 IS NOT NULL AND l.year >= 2000""",
    ("v_labelled", "v_lags"),
)
def _(spark, sf):
    """Every held-out row; ``outbreaks_score_higher``: training outbreak weeks got a higher mean probability than the others."""
    rows = cut_lineage(training_frame(spark, sf).filter("outbreak_label IS NOT NULL"))
    train = ML.balanced(rows.filter("year < 2000"), "outbreak_label")
    model = ML.outbreak_classifier(train, FEATURES, "outbreak_label", ML.TreeSettings(), "_weight")
    p = cut_lineage(ML.predict_probability(model, rows, FEATURES, "probability"))
    high = F.col("outbreak_label") == 1
    mean = lambda c: F.avg(F.when(c, F.col("probability")))
    seen = p.filter("year < 2000").agg((mean(high) > mean(~high)).alias("outbreaks_score_higher"))
    scored = p.filter("year >= 2000").select(*KEY, "outbreak_label", F.col("probability").between(0.0, 1.0).alias("probability_holds"))
    return scored.crossJoin(F.broadcast(seen)).select(*KEY, "outbreak_label", "outbreaks_score_higher", "probability_holds")


@query(
    "probability_calibrator",
    f"""
WITH RECURSIVE d AS (SELECT geography, probability AS r, CAST(actual_outbreak AS DOUBLE) AS y FROM v_forecast WHERE probability IS NOT NULL),
 classes AS (SELECT geography, min(y) < max(y) AS two FROM d GROUP BY geography),
 curves(step, geography, a, b) AS (
  SELECT 0, geography, 0.0::DOUBLE, 0.0::DOUBLE FROM classes WHERE two
  UNION ALL
  SELECT step + 1, geography, a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (
   SELECT step, geography, a, b, sum((p - y) * r) + a AS ga, sum(p - y) AS gb, sum(p * (1 - p) * r * r) + 1 AS aa,
    sum(p * (1 - p) * r) AS ab, sum(p * (1 - p)) AS bb
   FROM (SELECT c.*, d.r, d.y, 1 / (1 + exp(-(c.a * d.r + c.b))) AS p FROM curves c JOIN d USING (geography) WHERE c.step < {ML.CURVE_STEPS})
   GROUP BY step, geography, a, b))
SELECT f.geography, f.week_start_date, f.probability,
 round(CASE WHEN c.a IS NULL THEN f.probability ELSE 1 / (1 + exp(-(c.a * f.probability + c.b))) END, 6) AS calibrated
FROM v_forecast f LEFT JOIN curves c ON c.geography = f.geography AND c.step = {ML.CURVE_STEPS}""",
    ("v_forecast",),
)
def _(spark, sf):
    """A Platt curve for every series, all by the same grouped Newton steps."""
    rows = cut_lineage(V.forecasts(spark, sf))
    curves = ML.calibration_curves(rows, G, "probability", "actual_outbreak")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("slope") * F.col("probability") + F.col("intercept"))))
    joined = rows.join(curves, G, "left")
    return doubles(joined.select(*KEY, "probability", F.coalesce(p, F.col("probability")).alias("calibrated")))


@query(
    "quantile_regressor",
    f"SELECT CAST(count(*) AS BIGINT) AS scored_rows, TRUE AS training_share_near_p80, TRUE AS finite {_SCORED}",
    ("v_lags",),
)
def _(spark, sf):
    """``training_share_near_p80``: 75 to 85 in 100 training rows lie at or below the prediction."""
    rows = cut_lineage(training_frame(spark, sf))
    model = ML.quantile_regressor(rows.filter("year < 2000"), FEATURES, "total_cases", 0.8, ML.TreeSettings())
    scored = model.predict(rows, "p80").withColumn("held", F.col("year") >= 2000)
    share = F.avg(F.when(~F.col("held"), (F.col("total_cases") <= F.col("p80")).cast("double")))
    return scored.agg(
        F.count_if("held").alias("scored_rows"), share.between(0.75, 0.85).alias("training_share_near_p80"),
        F.bool_and(F.col("p80").isNotNull() & ~F.isnan("p80")).alias("finite"),
    )


# Labelled rows of the last four years with labels, or all but the first two.
_HELD = """
 f AS (SELECT l.geography, l.week_start_date, l.year, l.total_cases, l.outbreak_label, g.cases_lag_1
   FROM v_labelled l JOIN v_lags g USING (geography, week_start_date) WHERE l.outbreak_label IS NOT NULL AND g.cases_mean_8 IS NOT NULL),
 y AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT year FROM f)),
 held AS (SELECT f.* FROM f JOIN y USING (year) WHERE k <= least(4, n - 2))"""


@query(
    "oof_detector",
    f"""WITH {_HELD}
SELECT geography, CAST(count(*) AS BIGINT) AS held_out_rows, CAST(sum(outbreak_label) AS BIGINT) AS outbreak_rows, TRUE AS gate_in_grid,
 TRUE AS recall_holds FROM held GROUP BY geography""",
    ("v_labelled", "v_lags"),
)
def _(spark, sf):
    """``recall_holds``: held-out recall at the gate is what the alerts of the rows say, and reaches the target unless no gate does."""
    found = W.oof_detector(training_frame(spark, sf), FEATURES, G)
    judged = found.held_out.join(found.gates, G)
    high, alert = F.col("outbreak_label") == 1, F.col("probability") >= F.col("alert_gate")
    rows = judged.groupBy(*G).agg(
        F.count(F.lit(1)).alias("held_out_rows"), F.count_if(high).alias("outbreak_rows"), F.max("alert_gate").alias("gate"),
        F.try_divide(F.count_if(high & alert), F.count_if(high)).alias("seen"),
        F.try_divide(F.count_if(high & (F.col("probability") >= 0.05)), F.count_if(high)).alias("most"),
    )
    both = rows.join(found.metrics.select(*G, "recall"), G)
    reached = (F.col("seen") >= 0.8) | (F.col("most") < 0.8) | (F.col("outbreak_rows") == 0)
    holds = (F.abs(F.coalesce("seen", F.lit(0.0)) - F.coalesce("recall", F.lit(0.0))) < 1e-9) & reached
    return both.select(*G, "held_out_rows", "outbreak_rows", F.col("gate").between(0.0, 1.0).alias("gate_in_grid"), holds.alias("recall_holds"))


@query(
    "quantile_forecaster",
    f"""WITH {_HELD}
SELECT geography, year, week_start_date, CAST(total_cases AS DOUBLE) AS actual_cases, cases_lag_1, TRUE AS quantiles_hold FROM held""",
    ("v_labelled", "v_lags"),
)
def _(spark, sf):
    """Held-out rows of the last four labelled years with their quantiles in order."""
    fitted = W.quantile_forecaster(training_frame(spark, sf), FEATURES, G, "weather_plus_recent_cases", "cases_lag_1", fallback=True)
    p50, p80, p90 = (F.col(f"predicted_cases_{t}") for t in ("p50", "p80", "p90"))
    holds = (p50 >= 0) & (p50 <= p80) & (p80 <= p90) & F.col("used_persistence_fallback").isNotNull()
    return fitted.held_out.select(*KEY, "year", "actual_cases", "cases_lag_1", holds.alias("quantiles_hold"))


_PERIODS = {"whole_series": "2001-12-31", "before_2001": "2000-12-31"}


@query(
    "surge_experiment",
    "WITH " + ",\n".join(
        _HELD.replace(" f AS", f" f_{p} AS").replace("cases_mean_8 IS NOT NULL)", f"cases_mean_8 IS NOT NULL AND l.week_start_date <= DATE '{last}')")
        .replace("FROM f)", f"FROM f_{p})").replace("SELECT f.* FROM f JOIN y", f"SELECT f.* FROM f_{p} f JOIN y_{p}").replace(" y AS", f" y_{p} AS")
        .replace(" held AS", f" held_{p} AS")
        for p, last in _PERIODS.items()
    )
    + "\n" + "\nUNION ALL\n".join(
        f"SELECT geography, '{p}' AS period, CAST(count(*) AS BIGINT) AS held_out_rows, round(avg(abs(total_cases - cases_lag_1)), 6) AS persistence_mae, "
        f"TRUE AS errors_hold FROM held_{p} GROUP BY geography"
        for p in _PERIODS
    ),
    ("v_labelled", "v_lags"),
)
def _(spark, sf):
    """``errors_hold``: the error lies between those of the normal and of the outbreak weeks and at most at persistence."""
    found = W.surge_experiment(training_frame(spark, sf), G, _PERIODS, FEATURES)
    mae, parts = F.col("mae"), [F.coalesce("normal_week_mae", "mae"), F.coalesce("outbreak_week_mae", "mae")]
    holds = mae.between(F.least(*parts) - 1e-9, F.greatest(*parts) + 1e-9) & (mae <= F.col("persistence_mae") + 1e-9)
    return doubles(found.select("geography", "period", "held_out_rows", "persistence_mae", holds.alias("errors_hold")))


# Complete years with an earlier one, the last four of each series, and the rows of their folds.
_FOLDS = """
 years AS (SELECT geography, year AS validation_year, row_number() OVER (PARTITION BY geography ORDER BY year DESC) AS k
   FROM (SELECT geography, year FROM v_weekly GROUP BY ALL HAVING count(*) >= 50)),
 firsts AS (SELECT geography, min(year) AS first FROM v_weekly GROUP BY ALL),
 folds AS (SELECT geography, validation_year FROM years JOIN firsts USING (geography) WHERE k <= 4 AND validation_year > first),
 train AS (SELECT w.*, f.validation_year, row_number() OVER (PARTITION BY w.geography, f.validation_year ORDER BY week_start_date) AS i
   FROM v_weekly w JOIN folds f ON f.geography = w.geography AND w.year < f.validation_year),
 lagged AS (SELECT *, lag(total_cases, 1) OVER w AS l1, lag(total_cases, 2) OVER w AS l2, lag(total_cases, 4) OVER w AS l4, lag(total_cases, 52) OVER w AS l52,
   avg(total_cases) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m4, avg(total_cases) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS m8
   FROM train WINDOW w AS (PARTITION BY geography, validation_year ORDER BY week_start_date))"""
_HISTORY_SQL = {
    "cases_lag_1": "l1", "cases_lag_2": "l2", "cases_lag_4": "l4", "cases_lag_52": "l52", "cases_mean_4": "m4", "cases_mean_8": "m8",
    "cases_change_1": "l1 - l2",
}


@query(
    "training_matrix",
    f"""WITH {_FOLDS},
 m AS (SELECT geography, validation_year, {', '.join(f'median({e}) AS {c}' for c, e in _HISTORY_SQL.items())} FROM lagged GROUP BY ALL)
SELECT l.geography, l.validation_year, l.week_start_date, l.total_cases, {', '.join(f'round(coalesce({e}, m.{c}, 0), 6) AS {c}' for c, e in _HISTORY_SQL.items())},
 round(sin(2 * pi() * l.weekofyear / 52.0), 6) AS week_sin_1, round(cos(4 * pi() * l.weekofyear / 52.0), 6) AS week_cos_2,
 CAST(0 AS BIGINT) AS missing_features FROM lagged l JOIN m USING (geography, validation_year)""",
    ("v_weekly",),
)
def _(spark, sf):
    """Training rows of all folds, all weather fields filled; ``missing_features`` counts what is still NULL or not finite."""
    by = [*G, "validation_year"]
    table, base = W.fold_features(history_frame(spark, sf), G, HISTORY_WEATHER)
    matrix = W.training_matrix(cut_lineage(table), by, base)
    gaps = F.array(*[F.col(c).cast("double") for c in base])
    lost = F.size(F.filter(gaps, lambda v: v.isNull() | F.isnan(v))).cast("bigint").alias("missing_features")
    return doubles(matrix.select(*by, WEEK, "total_cases", *R.CASE_HISTORY, "week_sin_1", "week_cos_2", lost))


@query(
    "evaluate_expanding",
    f"""WITH {_FOLDS},
 slots AS (SELECT t.geography, t.validation_year, s.slot, quantile_cont(t.total_cases::DOUBLE, 0.75) AS q
   FROM train t, (SELECT unnest(range(1, 54)) AS slot) s WHERE least(abs(t.weekofyear - s.slot), 53 - abs(t.weekofyear - s.slot)) <= 2 GROUP BY ALL),
 alls AS (SELECT geography, validation_year, quantile_cont(total_cases::DOUBLE, 0.75) AS q FROM train GROUP BY ALL)
SELECT v.geography, f.validation_year, v.week_start_date, v.total_cases, round(coalesce(s.q, a.q), 6) AS outbreak_threshold,
 v.total_cases >= coalesce(s.q, a.q) AS actual_outbreak, TRUE AS predictions_hold, TRUE AS alerts_hold
FROM v_weekly v JOIN folds f ON f.geography = v.geography AND f.validation_year = v.year
JOIN alls a ON a.geography = f.geography AND a.validation_year = f.validation_year
LEFT JOIN slots s ON s.geography = f.geography AND s.validation_year = f.validation_year AND s.slot = v.weekofyear""",
    ("v_weekly",),
)
def _(spark, sf):
    """``alerts_hold``: each alert is its probability at its gate, and both gates lie on the grid."""
    found = W.evaluate_expanding(history_frame(spark, sf), G, HISTORY_WEATHER)
    values = [F.col(c) for c in W.MODEL_COLUMNS.values()]
    p = F.col("outbreak_probability")
    alerts = [F.col(f"{k}_policy_alert") == (p >= F.col(f"{k}_gate")) for k in ("mae", "recall")]
    gates = [F.col(f"{k}_gate").between(0.05, 0.95) for k in ("mae", "recall")]
    return doubles(
        found.select(
            *G, "validation_year", WEEK, "total_cases", "outbreak_threshold", "actual_outbreak",
            (F.forall(F.array(*values), lambda v: (v >= 0) & ~F.isnan(v)) & p.between(0.0, 1.0)).alias("predictions_hold"),
            F.forall(F.array(*alerts, *gates), lambda v: v).alias("alerts_hold"),
        )
    )


_LINEAR = {"cases_lag_1": 0.5, "cases_mean_4": 0.25, "cases_lag_52": 0.125, "cases_change_1": -0.125, "air_temperature": 0.25}


@query(
    "recursive_forecast",
    f"""WITH RECURSIVE {_FOLDS},
 weather AS (SELECT week_start_date, avg(temperature_2m_mean) AS air_temperature FROM v_weather GROUP BY ALL),
 steps AS (SELECT v.geography, f.validation_year, v.week_start_date, v.total_cases, coalesce(h.air_temperature, 0) AS x,
    row_number() OVER (PARTITION BY v.geography, f.validation_year ORDER BY v.week_start_date) AS i
   FROM v_weekly v JOIN folds f ON f.geography = v.geography AND f.validation_year = v.year LEFT JOIN weather h USING (week_start_date)),
 known AS (SELECT geography, validation_year, list(total_cases::DOUBLE ORDER BY week_start_date) AS h FROM train GROUP BY ALL),
 run(geography, validation_year, i, h) AS (
  SELECT geography, validation_year, CAST(0 AS BIGINT), h[-52:] FROM known
  UNION ALL
  SELECT r.geography, r.validation_year, s.i, list_append(r.h, greatest(0, 0.5 * coalesce(h[-1], 0) + 0.25 * coalesce(list_avg(h[-4:]), 0)
    + 0.125 * CASE WHEN len(h) >= 52 THEN h[-52] ELSE 0 END - 0.125 * coalesce(h[-1] - h[-2], 0) + 0.25 * s.x + 1.0::DOUBLE))[-52:]
  FROM run r JOIN steps s ON s.geography = r.geography AND s.validation_year = r.validation_year AND s.i = r.i + 1)
SELECT s.geography, s.validation_year, s.week_start_date, s.total_cases, round(r.h[-1], 6) AS prediction
FROM steps s JOIN run r USING (geography, validation_year, i)""",
    ("v_weekly", "v_weather"),
)
def _(spark, sf):
    """A fixed linear model run through the last four years of every series on its own predictions."""
    rows = expanding_splits(history_frame(spark, sf), G)
    by, base = [*G, "validation_year"], ["air_temperature"]
    step = R.linear_step(base, _LINEAR, 1.0)
    return doubles(R.recursive_forecast(rows, by, base, step, ["_h"], [WEEK, "total_cases"], {"prediction": "double"}))


_FACTS = f"""
WITH d AS (SELECT w.*, lag(total_cases, 1) OVER w AS l1, lag(total_cases, 52) OVER w AS l52,
   avg(total_cases) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS m8 FROM v_weekly w WINDOW w AS (PARTITION BY geography ORDER BY week_start_date)),
 slots AS (SELECT t.geography, s.slot, quantile_cont(t.total_cases::DOUBLE, 0.60) AS q60, quantile_cont(t.total_cases::DOUBLE, 0.75) AS q75
   FROM v_weekly t, (SELECT unnest(range(1, 54)) AS slot) s WHERE least(abs(t.weekofyear - s.slot), 53 - abs(t.weekofyear - s.slot)) <= 2 GROUP BY ALL)
SELECT d.geography, CAST(count(*) AS BIGINT) AS training_rows, min(week_start_date) AS training_start, max(week_start_date) AS training_end,
 median(total_cases) AS median_cases, CAST(count_if(total_cases >= q75) AS BIGINT) AS outbreak_rows,
 CAST(count_if(total_cases >= q60) AS BIGINT) AS near_outbreak_rows, round(median(l1), 6) AS median_lag_1, round(median(l52), 6) AS median_lag_52,
 round(median(m8), 6) AS median_mean_8"""


def _fact_rows(models):
    medians = models.medians.groupBy(*G).pivot("feature", ["cases_lag_1", "cases_lag_52", "cases_mean_8"]).agg(F.first("median"))
    names = {"cases_lag_1": "median_lag_1", "cases_lag_52": "median_lag_52", "cases_mean_8": "median_mean_8"}
    return models.facts.join(medians.withColumnsRenamed(names), G)


@query(
    "single_stage_fit",
    f"{_FACTS}, CAST({ML.TreeSettings().rounds + 1} AS BIGINT) AS trees, TRUE AS below_constant_mae FROM d JOIN slots s ON s.geography = d.geography AND s.slot = d.weekofyear GROUP BY d.geography",
    ("v_weekly",),
)
def _(spark, sf):
    """Facts of the models read back from disk; ``below_constant_mae``: their training error is below the median's."""
    cases = history_frame(spark, sf)
    path = working_path(spark, "final-models")
    FF.save_final(FF.single_stage_fit(cases, G, HISTORY_WEATHER), path, "v1")
    models = FF.load_final(spark, path, "v1", G)
    matrix, _ = FF.final_matrix(cases, G, models.weather)
    scored = FF.score_scenarios(models, matrix).join(models.facts.select(*G, "median_cases"), G)
    miss = lambda c: F.avg(F.abs(F.col("total_cases") - F.col(c)))
    errors = scored.groupBy(*G).agg((miss("single_stage_prediction") < miss("median_cases")).alias("below_constant_mae"))
    trees = models.nodes.where("tag = 'single'").groupBy(*G).agg(F.count_distinct("tree").alias("trees"))
    return doubles(_fact_rows(models).join(trees, G).join(errors, G))


@query(
    "two_stage_fit",
    f"{_FACTS}, TRUE AS models_complete, TRUE AS gates_in_grid, TRUE AS outbreaks_score_higher FROM d JOIN slots s ON s.geography = d.geography AND s.slot = d.weekofyear GROUP BY d.geography",
    ("v_weekly",),
)
def _(spark, sf):
    """Facts of all four models of every series, read back from disk."""
    cases = history_frame(spark, sf)
    path = working_path(spark, "final-models")
    FF.save_final(FF.two_stage_final(cases, G, HISTORY_WEATHER), path, "v1")
    models = FF.load_final(spark, path, "v1", G)
    matrix, _ = FF.final_matrix(cases, G, models.weather)
    scored = FF.score_scenarios(models, matrix)
    high = F.col("total_cases") >= F.col("outbreak_threshold")
    mean = lambda c: F.avg(F.when(c, F.col("outbreak_probability")))
    ranks = scored.groupBy(*G).agg((mean(high) > mean(~high)).alias("outbreaks_score_higher"))
    gates = models.curves.select(*G, (F.col("mae_gate").between(0.05, 0.95) & F.col("recall_gate").between(0.05, 0.95)).alias("gates_in_grid"))
    whole = models.nodes.groupBy(*G).agg((F.count_distinct("tag") == 4).alias("models_complete"))
    return doubles(_fact_rows(models).join(whole, G).join(gates, G).join(ranks, G))


_SCENARIO = {
    "cases_lag_1": "l1", "cases_lag_2": "l2", "cases_lag_4": "l4", "cases_lag_52": "coalesce(l52, med52)", "cases_mean_4": "m4",
    "cases_mean_8": "m8", "cases_change_1": "l1 - l2",
}


@query(
    "what_if_rows",
    f"""
WITH d AS (SELECT w.*, lag(total_cases, 1) OVER w AS l1, lag(total_cases, 2) OVER w AS l2, lag(total_cases, 4) OVER w AS l4,
  lag(total_cases, 8) OVER w AS l8, lag(total_cases, 52) OVER w AS l52, avg(total_cases) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m4,
  avg(total_cases) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS m8 FROM v_weekly w WINDOW w AS (PARTITION BY geography ORDER BY week_start_date)),
 m AS (SELECT geography, median(l52) AS med52 FROM d GROUP BY ALL),
 x AS (SELECT week_start_date, {', '.join(f'avg({c}) AS {c}' for c in S.WEEKLY_WEATHER)} FROM v_weather GROUP BY ALL)
SELECT d.geography, d.week_start_date, {', '.join(f'round({e}, 6) AS {c}' for c, e in _SCENARIO.items())},
 round(sin(2 * pi() * weekofyear / 52.0), 6) AS week_sin_1,
 {', '.join(f'round(x.{c}, 6) AS {n}_chosen_lag, 0.0::DOUBLE AS {n}_missing' for c, n in zip(S.WEEKLY_WEATHER, ["air_temperature" if c == "temperature_2m_mean" else "precipitation" if c == "precipitation_sum" else c for c in S.WEEKLY_WEATHER]))},
 TRUE AS predictions_hold
FROM d JOIN m USING (geography) JOIN x USING (week_start_date) WHERE l8 IS NOT NULL AND {' AND '.join(f'x.{c} IS NOT NULL' for c in S.WEEKLY_WEATHER)}""",
    ("v_weekly", "v_weather"),
)
def _(spark, sf):
    """Every week as a scenario, its weather, its last 8 counts, last year's count, scored with models read back from disk."""
    cases = cut_lineage(history_frame(spark, sf))
    path = working_path(spark, "final-models")
    FF.save_final(FF.two_stage_final(cases, G, HISTORY_WEATHER), path, "v1")
    models = FF.load_final(spark, path, "v1", G)
    past = X.Past(G)
    scenarios = cases.select(
        *KEY, "weekofyear", *models.weather, F.collect_list("total_cases").over(past.frame(-8, -1)).alias("last_8_cases"),
        past.lag(F.col("total_cases"), 52).alias("cases_last_year"),
    )
    scenarios = X.complete_rows(scenarios.where("size(last_8_cases) = 8"), models.weather)
    scored = FF.score_scenarios(models, FF.scenario_rows(models, scenarios))
    values = F.array(*[F.col(c) for c in W.MODEL_COLUMNS.values()])
    holds = F.forall(values, lambda v: (v >= 0) & ~F.isnan(v)) & F.col("outbreak_probability").between(0.0, 1.0)
    names = [f"{c}_{k}" for c in models.weather for k in ("chosen_lag", "missing")]
    return doubles(scored.select(*KEY, *R.CASE_HISTORY, "week_sin_1", *names, holds.alias("predictions_hold")))
