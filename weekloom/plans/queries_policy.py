"""Queries: metrics, gates, promotion, ledger, serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.config import cut_lineage
from weekloom.functions import calendar as C
from weekloom.operators import ledger as L
from weekloom.operators import metrics as M
from weekloom.operators import policy as P
from weekloom.operators import serving as Z
from weekloom.plans import tables as V
from weekloom.plans.tables import G, doubles, query

WEEK = "week_start_date"
KEY = [*G, WEEK]
LEDGER_ROW = [*G, "as_of_date", WEEK, "lead_weeks", "model_version"]


def _confusion_sql(up, high):
    tp, fp = f"count(*) FILTER (WHERE {up} AND {high})", f"count(*) FILTER (WHERE {up} AND NOT {high})"
    tn, fn = f"count(*) FILTER (WHERE NOT {up} AND NOT {high})", f"count(*) FILTER (WHERE NOT {up} AND {high})"
    return f"""count(*) AS evaluated_rows, {tp} AS true_positives, {fp} AS false_positives, {tn} AS true_negatives, {fn} AS false_negatives,
 round(({tp} + {tn}) / CAST(count(*) AS DOUBLE), 6) AS accuracy,
 round(coalesce({tp} / CAST(nullif({tp} + {fp}, 0) AS DOUBLE), 0), 6) AS precision,
 round(coalesce({tp} / CAST(nullif({tp} + {fn}, 0) AS DOUBLE), 0), 6) AS recall,
 round(coalesce(2 * {tp} / CAST(nullif(2 * {tp} + {fp} + {fn}, 0) AS DOUBLE), 0), 6) AS f1,
 round({tn} / CAST(nullif({tn} + {fp}, 0) AS DOUBLE), 6) AS specificity"""


@query(
    "metric_mae_split",
    """
SELECT geography, count(*) AS held_out_rows, round(avg(abs(actual_cases - predicted_cases_p50)), 6) AS mae,
 round(median(abs(actual_cases - predicted_cases_p50)), 6) AS median_absolute_error,
 round(avg(abs(actual_cases - predicted_cases_p50)) FILTER (WHERE actual_outbreak = 0), 6) AS normal_week_mae,
 round(avg(abs(actual_cases - predicted_cases_p50)) FILTER (WHERE actual_outbreak = 1), 6) AS outbreak_week_mae,
 round(avg(abs(actual_cases - cases_lag_1)), 6) AS persistence_mae FROM v_forecast GROUP BY ALL""",
    ("v_forecast",),
)
def _(spark, sf):
    return doubles(M.mae_split(cut_lineage(V.forecasts(spark, sf)), G))


@query(
    "metric_by_city",
    """
WITH l AS (SELECT geography, actual_cases AS a, actual_outbreak AS o, 'mean_4' AS model, predicted_cases_p50 AS p FROM v_forecast
 UNION ALL SELECT geography, actual_cases, actual_outbreak, 'persistence', cases_lag_1 FROM v_forecast)
SELECT model, coalesce(geography, 'overall') AS geography, round(avg(abs(a - p)), 6) AS mae,
 round(avg(abs(a - p)) FILTER (WHERE o = 0), 6) AS normal_week_mae, round(avg(abs(a - p)) FILTER (WHERE o = 1), 6) AS outbreak_week_mae
FROM l GROUP BY GROUPING SETS ((model), (model, geography))""",
    ("v_forecast",),
)
def _(spark, sf):
    f = V.forecasts(spark, sf)
    return doubles(
        M.model_mae(f, {"mean_4": "predicted_cases_p50", "persistence": "cases_lag_1"}, "geography", "actual_cases")
    )


@query(
    "metric_pinball_coverage",
    """
SELECT geography, """
    + ", ".join(
        f"round(avg(greatest({q} * (actual_cases - predicted_cases_p{n}), ({q} - 1) * (actual_cases - predicted_cases_p{n}))), 6) AS p{n}_pinball_loss,"
        f" round(avg(CASE WHEN actual_cases <= predicted_cases_p{n} THEN 1.0::DOUBLE ELSE 0 END), 6) AS p{n}_coverage"
        for q, n in (("0.8::DOUBLE", 80), ("0.9::DOUBLE", 90))
    )
    + " FROM v_forecast GROUP BY ALL",
    ("v_forecast",),
)
def _(spark, sf):
    return doubles(M.pinball_coverage(V.forecasts(spark, sf), G))


@query(
    "metric_confusion",
    f"SELECT geography, lead_weeks, {_confusion_sql('outbreak_alert', 'actual_outbreak = 1')} FROM "
    "(SELECT l.*, CAST(w.total_cases >= l.historical_outbreak_threshold_cases AS INTEGER) AS actual_outbreak"
    " FROM v_ledger l JOIN v_weekly w USING (geography, week_start_date)) GROUP BY ALL",
    ("v_ledger",),
)
def _(spark, sf):
    w = V.weekly(spark, sf)
    rows = V.ledger(spark, sf, w).join(w.select(*KEY, "total_cases"), KEY)
    tagged = rows.withColumn("actual_outbreak", F.col("total_cases") >= F.col("historical_outbreak_threshold_cases"))
    return doubles(M.confusion(tagged, [*G, "lead_weeks"]))


def _ap_sql(table, keys, score, label):
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""
SELECT {k}CASE WHEN max(pos) > 0 AND max(pos) < max(tot) THEN round(sum(p * cp / CAST(cn AS DOUBLE)) / max(pos), 6) END AS pr_auc FROM (
 SELECT {k}p, sum(p) OVER ({part}ORDER BY s DESC) AS cp, sum(n) OVER ({part}ORDER BY s DESC) AS cn,
  sum(p) OVER ({part.strip()}) AS pos, sum(n) OVER ({part.strip()}) AS tot
 FROM (SELECT {k}{score} AS s, count(*) AS n, sum({label}) AS p FROM {table} GROUP BY ALL))
{f'GROUP BY {keys}' if keys else ''}"""


@query("metric_average_precision", _ap_sql("v_scores", "geography", "probability", "label"), ("v_scores",))
def _(spark, sf):
    return doubles(M.average_precision(cut_lineage(V.scores(spark, sf)), G))


@query("metric_average_precision_overall", _ap_sql("v_scores", "", "probability", "label"), ("v_scores",))
def _(spark, sf):
    return doubles(M.average_precision(cut_lineage(V.scores(spark, sf)), []))


@query("metric_brier", "SELECT geography, round(avg(pow(probability - label, 2)), 6) AS brier FROM v_scores GROUP BY ALL", ("v_scores",))
def _(spark, sf):
    return doubles(M.brier(V.scores(spark, sf), G))


@query(
    "threshold_signal",
    """
SELECT geography, round(coalesce(h / CAST(nullif(u, 0) AS DOUBLE), 0), 6) AS p50_threshold_precision,
 round(coalesce(h / CAST(nullif(o, 0) AS DOUBLE), 0), 6) AS p50_threshold_recall FROM (
SELECT geography, count(*) FILTER (WHERE predicted_cases_p50 >= outbreak_threshold AND actual_outbreak = 1) AS h,
 count(*) FILTER (WHERE predicted_cases_p50 >= outbreak_threshold) AS u, count(*) FILTER (WHERE actual_outbreak = 1) AS o
FROM v_forecast GROUP BY ALL)""",
    ("v_forecast",),
)
def _(spark, sf):
    return doubles(M.threshold_signal(V.forecasts(spark, sf), G))


# --- gates -----------------------------------------------------------------------------

_GATES = """
 g AS (SELECT geography, k / 100.0::DOUBLE AS gate, count(*) FILTER (WHERE probability >= k / 100.0::DOUBLE) AS alert_rows,
   count(*) FILTER (WHERE probability >= k / 100.0::DOUBLE AND label = 1) AS true_positives, sum(label) AS pos
  FROM v_scores, generate_series(5, 95) AS s(k) GROUP BY geography, k),
 t AS (SELECT geography, gate, alert_rows, true_positives, coalesce(true_positives / CAST(nullif(alert_rows, 0) AS DOUBLE), 0) AS precision,
   coalesce(true_positives / CAST(nullif(pos, 0) AS DOUBLE), 0) AS recall FROM g)"""


@query(
    "gate_cross",
    f"WITH {_GATES} SELECT geography, gate, alert_rows, true_positives, round(precision, 6) AS precision, round(recall, 6) AS recall FROM t",
    ("v_scores",),
)
def _(spark, sf):
    return doubles(P.gate_table(V.scores(spark, sf), G, P.RECALL_GATES))


@query(
    "recall_gate",
    f"""WITH {_GATES} SELECT geography, gate AS alert_gate FROM (SELECT *, row_number() OVER (PARTITION BY geography
 ORDER BY recall >= 0.8 DESC, CASE WHEN recall >= 0.8 THEN NULL ELSE recall END DESC NULLS LAST, precision DESC, gate DESC) AS r FROM t) WHERE r = 1""",
    ("v_scores",),
)
def _(spark, sf):
    return P.recall_gate(V.scores(spark, sf), G, 0.8)


@query(
    "policy_gates",
    """
WITH t AS (SELECT geography, k * 5 / 100.0::DOUBLE AS gate,
  round(avg(abs(actual_cases - CASE WHEN probability >= k * 5 / 100.0::DOUBLE THEN predicted_cases_p90 ELSE predicted_cases_p50 END)), 9) AS mae,
  coalesce(count(*) FILTER (WHERE probability >= k * 5 / 100.0::DOUBLE AND actual_outbreak = 1)
    / CAST(nullif(count(*) FILTER (WHERE probability >= k * 5 / 100.0::DOUBLE), 0) AS DOUBLE), 0) AS precision,
  coalesce(count(*) FILTER (WHERE probability >= k * 5 / 100.0::DOUBLE AND actual_outbreak = 1)
    / CAST(nullif(sum(actual_outbreak), 0) AS DOUBLE), 0) AS recall
 FROM v_forecast, generate_series(1, 18) AS s(k) GROUP BY geography, k)
SELECT a.geography, a.gate AS mae_gate, b.gate AS recall_gate
FROM (SELECT *, row_number() OVER (PARTITION BY geography ORDER BY mae, gate DESC) AS r FROM t) a
JOIN (SELECT *, row_number() OVER (PARTITION BY geography ORDER BY recall >= 0.8 DESC,
   CASE WHEN recall >= 0.8 THEN NULL ELSE recall END DESC NULLS LAST, gate, precision DESC, mae) AS r FROM t) b
 ON a.geography = b.geography AND a.r = 1 AND b.r = 1""",
    ("v_forecast",),
)
def _(spark, sf):
    f = cut_lineage(V.forecasts(spark, sf))
    return P.policy_gates(
        f, G, "probability", "actual_outbreak", "actual_cases", "predicted_cases_p90", "predicted_cases_p50"
    )


def _scale_sql(q, n, p):
    loss = (
        "abs(actual_cases - p)"
        if q == 0.5
        else f"greatest({q}::DOUBLE * (actual_cases - p), ({q}::DOUBLE - 1) * (actual_cases - p))"
    )
    return f"""(SELECT geography, arg_min(s, (l, s)) AS scale_p{n} FROM (SELECT geography, s, round(avg({loss}), 9) AS l FROM (
  SELECT geography, k * 5 / 100.0::DOUBLE AS s, actual_cases, greatest(0, cases_lag_1 + k * 5 / 100.0::DOUBLE * ({p} - cases_lag_1)) AS p
  FROM v_forecast, generate_series(0, 30) AS g(k)) GROUP BY geography, s) GROUP BY geography)"""


@query(
    "residual_scales",
    f"""SELECT * FROM {_scale_sql(0.5, 50, 'predicted_cases_p50')} JOIN {_scale_sql(0.8, 80, 'predicted_cases_p80')} USING (geography)
 JOIN {_scale_sql(0.9, 90, 'predicted_cases_p90')} USING (geography)""",
    ("v_forecast",),
)
def _(spark, sf):
    f = V.forecasts(spark, sf)
    names = {q: f"residual_{n}" for q, n in ((0.5, 50), (0.8, 80), (0.9, 90))}
    rows = f.select(
        *KEY,
        "actual_cases",
        "cases_lag_1",
        *[(F.col(f"predicted_cases_p{round(q * 100)}") - F.col("cases_lag_1")).alias(n) for q, n in names.items()],
    )
    return P.residual_scales(rows, G, "actual_cases", "cases_lag_1", names)


@query(
    "upper_offsets",
    """
SELECT geography, round(greatest(0, quantile_cont(actual_cases - predicted_cases_p50, 0.8)), 6) AS offset_p80,
 round(greatest(0, quantile_cont(actual_cases - predicted_cases_p50, 0.9)), 6) AS offset_p90 FROM v_forecast GROUP BY ALL""",
    ("v_forecast",),
)
def _(spark, sf):
    return doubles(P.upper_offsets(cut_lineage(V.forecasts(spark, sf)), G, "actual_cases", "predicted_cases_p50"))


@query(
    "persistence_fallback",
    """
WITH s AS (SELECT geography, avg(abs(actual_cases - predicted_cases_p90)) > avg(abs(actual_cases - cases_lag_1)) AS f FROM v_forecast GROUP BY ALL)
SELECT geography, week_start_date, round(CASE WHEN f THEN cases_lag_1 ELSE predicted_cases_p90 END, 6) AS predicted_cases_p50,
 round(CASE WHEN f THEN greatest(predicted_cases_p90, cases_lag_1 + 2) ELSE predicted_cases_p90 END, 6) AS predicted_cases_p80,
 round(CASE WHEN f THEN greatest(predicted_cases_p90, cases_lag_1 + 3) ELSE predicted_cases_p90 END, 6) AS predicted_cases_p90,
 f AS used_persistence_fallback
FROM v_forecast JOIN s USING (geography)""",
    ("v_forecast",),
)
def _(spark, sf):
    f = V.forecasts(spark, sf)
    high = F.col("predicted_cases_p90")
    rows = f.select(
        *KEY,
        "actual_cases",
        "cases_lag_1",
        *[high.alias(f"predicted_cases_{t}") for t in ("p50", "p80", "p90")],
        F.lit(2.0).alias("offset_p80"),
        F.lit(3.0).alias("offset_p90"),
    )
    out = P.persistence_fallback(rows, G)
    return doubles(out.select(*KEY, *[f"predicted_cases_{t}" for t in ("p50", "p80", "p90")], "used_persistence_fallback"))


# --- promotion and model versions ------------------------------------------------------

def route_metrics(f, years):
    """Metrics of two routes over the given years: a stand-in for a trained model's report."""
    high = F.col("actual_outbreak") == 1
    aggs = []
    names = ["precision", "recall", "brier", "case_mae", "outbreak_week_mae", "persistence_mae"]
    routes = {"weather_only": "predicted_cases_p50", "weather_plus_recent_cases": "cases_lag_1"}
    for route, p in routes.items():
        up = F.col(p) >= F.col("outbreak_threshold")
        error = F.abs(F.col("actual_cases") - F.col(p))
        hit = F.count_if(up & high)
        values = [
            F.coalesce(hit / F.nullif(F.count_if(up), F.lit(0)), F.lit(0.0)),
            F.coalesce(hit / F.nullif(F.count_if(high), F.lit(0)), F.lit(0.0)),
            F.avg(F.pow(F.col("probability") - F.col("actual_outbreak"), 2)),
            F.avg(error),
            F.avg(F.when(high, error)),
            F.avg(F.abs(F.col("actual_cases") - F.col("cases_lag_1"))),
        ]
        aggs += [v.alias(f"{route}:{n}") for n, v in zip(names, values)]
    wide = f.filter(years).groupBy(*G).agg(*aggs)
    long = wide.unpivot(G, [f"`{r}:{n}`" for r in routes for n in names], "_name", "value").filter("value IS NOT NULL")
    both = F.split("_name", ":")
    return long.select(*G, both[0].alias("route"), both[1].alias("metric"), F.round("value", 6).alias("value"))


def _route_sql(where):
    parts = []
    for route, p in (("weather_only", "predicted_cases_p50"), ("weather_plus_recent_cases", "cases_lag_1")):
        up, high = f"{p} >= outbreak_threshold", "actual_outbreak = 1"
        for metric, e in {
            "precision": f"coalesce(count(*) FILTER (WHERE {up} AND {high}) / CAST(nullif(count(*) FILTER (WHERE {up}), 0) AS DOUBLE), 0)",
            "recall": f"coalesce(count(*) FILTER (WHERE {up} AND {high}) / CAST(nullif(count(*) FILTER (WHERE {high}), 0) AS DOUBLE), 0)",
            "brier": "avg(pow(probability - actual_outbreak, 2))",
            "case_mae": f"avg(abs(actual_cases - {p}))",
            "outbreak_week_mae": f"avg(abs(actual_cases - {p})) FILTER (WHERE {high})",
            "persistence_mae": "avg(abs(actual_cases - cases_lag_1))",
        }.items():
            parts.append(
                f"SELECT geography, '{route}' AS route, '{metric}' AS metric, round({e}, 6) AS value FROM v_forecast WHERE {where} GROUP BY geography"
            )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


_RULES = f"""
WITH n AS ({_route_sql('year >= 2000')}), o AS ({_route_sql("year < 2000 AND geography <> '5-LOW'")}),
 nm AS (SELECT geography, max(week_start_date) AS c FROM v_forecast GROUP BY ALL),
 om AS (SELECT geography, max(week_start_date) AS c FROM v_forecast WHERE year < 2000 AND geography <> '5-LOW' GROUP BY ALL),
 m AS (SELECT coalesce(n.geography, o.geography) AS geography, coalesce(n.route, o.route) AS route, coalesce(n.metric, o.metric) AS rule,
   n.value AS candidate_value, o.value AS champion_value FROM n FULL OUTER JOIN o
   ON n.geography = o.geography AND n.route = o.route AND n.metric = o.metric
   WHERE coalesce(n.metric, o.metric) <> 'persistence_mae'),
 rules AS (
 SELECT geography, 'all' AS route, 'bootstrap' AS rule, CAST(NULL AS DOUBLE) AS candidate_value, CAST(NULL AS DOUBLE) AS champion_value, TRUE AS passed
 FROM nm WHERE geography NOT IN (SELECT geography FROM om)
 UNION ALL SELECT nm.geography, 'all', 'new_weeks', CAST(floor((nm.c - om.c) / 7) AS DOUBLE), 13.0, (nm.c - om.c) / 7 >= 13 FROM nm JOIN om USING (geography)
 UNION ALL SELECT geography, route, rule, candidate_value, champion_value, coalesce(CASE rule
   WHEN 'precision' THEN candidate_value >= champion_value - 0.03::DOUBLE WHEN 'recall' THEN candidate_value >= champion_value - 0.03::DOUBLE
   WHEN 'brier' THEN candidate_value <= champion_value + 0.02::DOUBLE WHEN 'case_mae' THEN candidate_value <= champion_value * 1.1::DOUBLE
   WHEN 'outbreak_week_mae' THEN candidate_value <= champion_value * 1.15::DOUBLE END, FALSE)
 FROM m WHERE geography IN (SELECT geography FROM om)
 UNION ALL SELECT a.geography, a.route, 'persistence', a.value, b.value, a.value <= b.value * 1.05::DOUBLE
 FROM n a JOIN n b ON a.geography = b.geography AND a.route = b.route AND a.metric = 'case_mae' AND b.metric = 'persistence_mae'
 WHERE a.route <> 'weather_only' AND a.geography IN (SELECT geography FROM om))"""


def _contest(spark, sf):
    """Candidate models, champion slots and the rules between them."""
    late, early = F.col("year") >= 2000, (F.col("year") < 2000) & (F.col("geography") != "5-LOW")
    f = cut_lineage(V.forecasts(spark, sf))  # read by both reports and both model lists
    model = lambda rows: rows.groupBy(*G).agg(
        F.max(WEEK).alias("training_data_cutoff"),
        F.lit(5).alias("model_schema_version"),
        F.lit(6).alias("case_forecast_schema_version"),
    )
    candidates, slots = cut_lineage(model(f)), cut_lineage(model(f.filter(early)))
    return candidates, slots, P.promotion_rules(route_metrics(f, late), route_metrics(f, early), candidates, slots, G)


def _promotion(spark, sf):
    return _contest(spark, sf)[2]


@query("promotion_rules", f"{_RULES} SELECT * FROM rules", ("v_forecast",))
def _(spark, sf):
    return _promotion(spark, sf).drop("reason")


@query(
    "promotion_decision",
    f"""{_RULES} SELECT geography, bool_and(passed) AS promote, count(*) AS rule_count,
 count(*) FILTER (WHERE NOT passed) AS failed_rules FROM rules GROUP BY ALL""",
    ("v_forecast",),
)
def _(spark, sf):
    return P.promotion_decision(_promotion(spark, sf), G).drop("reasons")


@query(
    "train_candidate",
    f"""{_RULES}, d AS (SELECT geography, bool_and(passed) AS promote FROM rules GROUP BY ALL)
SELECT d.geography, d.promote, CASE WHEN d.promote THEN nm.c ELSE om.c END AS training_data_cutoff,
 CASE WHEN d.promote THEN 'm' || CAST(isoyear(nm.c) AS VARCHAR) ELSE 'm' || CAST(isoyear(om.c) AS VARCHAR) END AS model_version
FROM d LEFT JOIN nm USING (geography) LEFT JOIN om USING (geography) WHERE d.promote OR om.c IS NOT NULL""",
    ("v_forecast",),
)
def _(spark, sf):
    """The slots after a candidate of all series met the champions: each series is promoted, or keeps its model, alone."""
    candidates, slots, rules = _contest(spark, sf)
    decision = cut_lineage(P.promotion_decision(rules, G))
    merged = P.merge_slots(slots, candidates, decision, G)
    version = F.concat(F.lit("m"), C.iso_year("training_data_cutoff").cast("string")).alias("model_version")
    return merged.select(*G, "training_data_cutoff", version).join(decision.select(*G, "promote"), G)


def model_history(spark, sf):
    """One model version per series and year, older ones under an older schema."""
    return (
        V.weekly(spark, sf)
        .groupBy(*G, "year")
        .agg(F.max(WEEK).alias("training_data_cutoff"))
        .select(
            *G,
            F.concat(F.lit("m"), F.col("year").cast("string")).alias("model_version"),
            "training_data_cutoff",
            F.date_add("training_data_cutoff", 30).cast("string").alias("promoted_at_utc"),
            F.when(F.col("year") >= 2001, 4).otherwise(5).alias("model_schema_version"),
            F.lit(6).alias("case_forecast_schema_version"),
        )
    )


_HISTORY = """
 h AS (SELECT geography, 'm' || CAST(year AS VARCHAR) AS model_version, max(week_start_date) AS training_data_cutoff,
   CAST(max(week_start_date) + 30 AS VARCHAR) AS promoted_at_utc,
   CASE WHEN year >= 2001 THEN 4 ELSE 5 END AS model_schema_version, 6 AS case_forecast_schema_version
  FROM v_weekly GROUP BY geography, year),
 c AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY geography ORDER BY promoted_at_utc DESC) AS r FROM h
   WHERE model_schema_version = 5 AND case_forecast_schema_version = 6) WHERE r = 1)"""


@query("model_versions", f"WITH {_HISTORY} SELECT * FROM c", ("v_weekly",))
def _(spark, sf):
    return P.current_models(model_history(spark, sf), G, 5, 6)


@query(
    "retrain_due",
    f"""WITH {_HISTORY} SELECT geography, latest_finalized_week, training_data_cutoff,
 CAST(floor((latest_finalized_week - training_data_cutoff) / 7) AS BIGINT) AS new_finalized_weeks,
 training_data_cutoff IS NULL OR floor((latest_finalized_week - training_data_cutoff) / 7) >= 13 AS retrain_due
FROM (SELECT geography, max(week_start_date) AS latest_finalized_week FROM v_weekly WHERE week_start_date + 6 <= DATE '2001-07-20' GROUP BY ALL)
LEFT JOIN c USING (geography)""",
    ("v_weekly",),
)
def _(spark, sf):
    current = P.current_models(model_history(spark, sf), G, 5, 6)
    stable = P.finalized(V.weekly(spark, sf), F.lit("2001-08-17").cast("date"), 4)
    return P.retrain_due(stable, current, G)


# --- ledger ----------------------------------------------------------------------------

@query(
    "dedup_keep_last",
    """
SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r
 FROM events) WHERE r = 1""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return L.keep_last(e, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    "combine_sources",
    """
SELECT geography, date, weather_source, round(temperature_2m_mean, 6) AS temperature_2m_mean FROM (
 SELECT *, row_number() OVER (PARTITION BY geography, date ORDER BY weather_source DESC) AS r FROM v_point) WHERE r = 1""",
    ("v_point",),
)
def _(spark, sf):
    p = V.points(spark, sf).select(*G, "date", "weather_source", "temperature_2m_mean")
    archive, live = p.filter("weather_source < 'archive:N'"), p.filter("weather_source >= 'archive:N'")
    return doubles(L.combine_sources(archive, live, [*G, "date"]))


@query(
    "latest_row",
    """
SELECT geography, week_start_date, total_cases FROM (SELECT *, row_number() OVER (PARTITION BY geography ORDER BY week_start_date DESC) AS r
 FROM v_weekly) WHERE r = 1""",
    ("v_weekly",),
)
def _(spark, sf):
    return L.latest_row(V.weekly(spark, sf).select(*KEY, "total_cases"), G, WEEK)


@query(
    "latest_complete_issue",
    """
WITH i AS (SELECT geography, generated_at_utc FROM v_ledger GROUP BY ALL HAVING bool_or(lead_weeks = 0) AND bool_or(lead_weeks = 1))
SELECT l.geography, l.as_of_date, l.week_start_date, l.lead_weeks, l.model_version
FROM v_ledger l JOIN (SELECT geography, max(generated_at_utc) AS generated_at_utc FROM i GROUP BY ALL) USING (geography, generated_at_utc)""",
    ("v_ledger",),
)
def _(spark, sf):
    return L.latest_complete_issue(cut_lineage(V.ledger(spark, sf)), G).select(*LEDGER_ROW)


@query(
    "latest_live_by_lead",
    """
SELECT geography, as_of_date, week_start_date, lead_weeks, model_version FROM (
 SELECT *, row_number() OVER (PARTITION BY geography, week_start_date, lead_weeks ORDER BY generated_at_utc DESC) AS r
 FROM v_ledger WHERE model_version = 'm2000') WHERE r = 1""",
    ("v_ledger",),
)
def _(spark, sf):
    return L.latest_live_by_lead(V.ledger(spark, sf), F.lit("m2000"), G).select(*LEDGER_ROW)


_HASHED = ["geography", "week_start_date", "total_cases", "hospitalized_cases"]


def _canonical_sql(columns):
    parts = [
        f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns
    ]
    return " || '|' || ".join(parts)


@query(
    "vintage_hash",
    f"""
SELECT geography, n AS row_count, 'case-' || substr(sha256(CAST(n AS VARCHAR) || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3), 1, 16) AS vintage_id
FROM (SELECT geography, count(*) AS n, """
    + ", ".join(
        f"CAST(sum(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(4)
    )
    + f" FROM (SELECT geography, sha256({_canonical_sql(_HASHED)}) AS d FROM v_weekly) GROUP BY geography)",
    ("v_weekly",),
)
def _(spark, sf):
    return L.content_hash(V.weekly(spark, sf).select(*_HASHED), G, _HASHED)


@query(
    "input_vintages",
    f"""
SELECT geography, week_start_date, 'input-' || substr(sha256({_canonical_sql(['geography', 'week_start_date', 'hospitalized_cases', 'total_cases'])}), 1, 16) AS input_vintage_id
FROM v_weekly""",
    ("v_weekly",),
)
def _(spark, sf):
    w = V.weekly(spark, sf).withColumn("generated_at_utc", F.current_timestamp().cast("string"))
    out = L.input_vintages(w, ["total_cases", "hospitalized_cases"], ["geography", WEEK, "generated_at_utc"])
    return out.select(*KEY, "input_vintage_id")


_RECONCILED = """
 r AS (SELECT l.*, CAST(w.total_cases AS DOUBLE) AS actual_cases, abs(w.total_cases - l.predicted_cases_p50) AS absolute_case_error,
  CAST(w.total_cases >= l.historical_outbreak_threshold_cases AS BIGINT) AS actual_outbreak
  FROM v_ledger l LEFT JOIN (SELECT * FROM v_weekly WHERE week_start_date + 6 <= DATE '2001-06-02') w USING (geography, week_start_date))"""


def _reconciled(spark, sf):
    as_of = F.lit("2001-06-30").cast("date")
    w = V.weekly(spark, sf)
    return L.attach_truth(V.ledger(spark, sf, w), w, KEY, as_of, 4)


@query(
    "reconcile",
    f"""WITH {_RECONCILED} SELECT geography, as_of_date, week_start_date, lead_weeks, model_version, actual_cases,
 round(absolute_case_error, 6) AS absolute_case_error, actual_outbreak FROM r""",
    ("v_ledger",),
)
def _(spark, sf):
    rows = _reconciled(spark, sf)
    return doubles(rows.select(*LEDGER_ROW, "actual_cases", "absolute_case_error", "actual_outbreak"))


@query(
    "reconcile_metrics",
    f"""WITH {_RECONCILED}, b AS (
 SELECT 'all_versioned_predictions' AS evaluation_basis, * FROM r WHERE actual_outbreak IS NOT NULL
 UNION ALL SELECT 'prospective_persisted_issue_time_inputs', * FROM r WHERE actual_outbreak IS NOT NULL
  AND input_vintage_basis = 'prospective_persisted_issue_time_inputs'),
 ap AS (SELECT geography, evaluation_basis, pr_auc FROM ({_ap_sql('b', 'geography, evaluation_basis', 'outbreak_probability', 'actual_outbreak')}))
SELECT b.geography, b.evaluation_basis, {_confusion_sql('outbreak_alert', 'actual_outbreak = 1')}, max(ap.pr_auc) AS pr_auc,
 round(avg(pow(outbreak_probability - actual_outbreak, 2)), 6) AS brier, count(*) AS case_rows,
 round(avg(absolute_case_error), 6) AS mae, round(median(absolute_case_error), 6) AS median_absolute_error,
 round(avg(absolute_case_error) FILTER (WHERE actual_outbreak = 0), 6) AS normal_week_mae,
 round(avg(absolute_case_error) FILTER (WHERE actual_outbreak = 1), 6) AS outbreak_week_mae,
 """
    + ", ".join(
        f"round(avg(greatest({q} * (actual_cases - predicted_cases_p{n}), ({q} - 1) * (actual_cases - predicted_cases_p{n}))), 6) AS p{n}_pinball_loss,"
        f" round(avg(CASE WHEN actual_cases <= predicted_cases_p{n} THEN 1.0::DOUBLE ELSE 0 END), 6) AS p{n}_coverage"
        for q, n in (("0.8::DOUBLE", 80), ("0.9::DOUBLE", 90))
    )
    + " FROM b JOIN ap ON ap.geography = b.geography AND ap.evaluation_basis = b.evaluation_basis GROUP BY b.geography, b.evaluation_basis",
    ("v_ledger",),
)
def _(spark, sf):
    return doubles(L.reconcile_metrics(_reconciled(spark, sf), G))


@query(
    "reconcile_report",
    f"""WITH {_RECONCILED}, k AS (SELECT * FROM r WHERE geography <> '5-LOW' AND (geography <> '1-URGENT' OR lead_weeks = 1)),
 b AS (SELECT 'all_versioned_predictions' AS evaluation_basis, * FROM k WHERE actual_outbreak IS NOT NULL
  UNION ALL SELECT 'prospective_persisted_issue_time_inputs', * FROM k WHERE actual_outbreak IS NOT NULL
  AND input_vintage_basis = 'prospective_persisted_issue_time_inputs'),
 n AS (SELECT geography, evaluation_basis, count(*) AS n, avg(absolute_case_error) AS mae FROM b GROUP BY ALL),
 w AS (SELECT DISTINCT r.geography, t.evaluation_basis, t.message FROM r, (VALUES
  ('all_versioned_predictions', '{L.NOTHING_FINAL[L.ALL_PREDICTIONS]}'),
  ('prospective_persisted_issue_time_inputs', '{L.NOTHING_FINAL["prospective_persisted_issue_time_inputs"]}')) AS t(evaluation_basis, message))
SELECT w.geography, w.evaluation_basis, coalesce(n.n, 0) AS evaluated_rows, round(n.mae, 6) AS mae, CASE WHEN n.n IS NULL THEN w.message END AS message
FROM w LEFT JOIN n USING (geography, evaluation_basis)""",
    ("v_ledger",),
)
def _(spark, sf):
    """One series has no outcome yet, another only for rows without persisted inputs."""
    rows = _reconciled(spark, sf)
    late = (F.col("geography") == "5-LOW") | ((F.col("geography") == "1-URGENT") & (F.col("lead_weeks") == 0))
    open_ = rows.withColumns({c: F.when(~late, F.col(c)) for c in ("actual_cases", "actual_outbreak")})
    return doubles(L.reconcile_report(open_, G).select(*G, "evaluation_basis", "evaluated_rows", "mae", "message"))


# --- serving ---------------------------------------------------------------------------

@query(
    "tail_weeks",
    """
SELECT geography, week_start_date, total_cases FROM (SELECT *, row_number() OVER (PARTITION BY geography ORDER BY week_start_date DESC) AS r
 FROM v_weekly) WHERE r <= 13""",
    ("v_weekly",),
)
def _(spark, sf):
    return Z.tail_weeks(V.weekly(spark, sf).select(*KEY, "total_cases"), G, 13)


@query(
    "ordered_output",
    "SELECT geography, week_start_date, total_cases, row_number() OVER (PARTITION BY geography ORDER BY week_start_date) AS position FROM v_weekly",
    ("v_weekly",),
)
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy(*G).orderBy(WEEK)
    rows = V.weekly(spark, sf).select(*KEY, "total_cases", F.row_number().over(w).cast("bigint").alias("position"))
    return rows.orderBy(*KEY)


@query(
    "compact_projection",
    """
SELECT geography, week_start_date AS date, year, 'weather_only' AS variant, round(actual_cases, 3) AS actual,
 round(outbreak_threshold, 3) AS threshold, actual_outbreak AS outbreak, round(predicted_cases_p50, 3) AS p50,
 round(predicted_cases_p80, 3) AS p80, round(predicted_cases_p90, 3) AS p90 FROM v_forecast""",
    ("v_forecast",),
)
def _(spark, sf):
    f = V.forecasts(spark, sf).withColumn("forecast_variant", F.lit("weather_only"))
    return Z.compact_report(f, G)


@query(
    "union_reported_estimates",
    """
SELECT geography, 'reported' AS row_type, week_start_date, total_cases AS cases, hospitalized_cases AS hospitalized,
 CAST(NULL AS DOUBLE) AS most_likely, CAST(NULL AS DOUBLE) AS higher, CAST(NULL AS DOUBLE) AS highest FROM v_weekly
UNION ALL SELECT geography, 'estimate', week_start_date, NULL, NULL, round(predicted_cases_p50, 6), round(predicted_cases_p80, 6),
 round(predicted_cases_p90, 6) FROM v_ledger""",
    ("v_ledger",),
)
def _(spark, sf):
    w = V.weekly(spark, sf)
    return doubles(Z.reported_and_estimated(w, V.ledger(spark, sf, w), G))


@query(
    "forecast_view",
    """
SELECT geography, as_of_date, week_start_date, lead_weeks, time_scope, round(predicted_cases_p50, 6) AS p50, outbreak_alert AS alert,
 round(historical_outbreak_threshold_cases, 6) AS threshold FROM v_ledger""",
    ("v_ledger",),
)
def _(spark, sf):
    v = _full_ledger(spark, sf).select(*G, "as_of_date", Z.forecast_view().alias("v"))
    return doubles(
        v.select(
            *G,
            "as_of_date",
            F.col("v.weekStart").alias(WEEK),
            F.col("v.leadWeeks").alias("lead_weeks"),
            F.col("v.timeScope").alias("time_scope"),
            F.col("v.cases.p50").alias("p50"),
            F.col("v.outbreak.alert").alias("alert"),
            F.col("v.cases.seasonalThreshold").alias("threshold"),
        )
    )


def _full_ledger(spark, sf, cases=None):
    from weekloom import schemas as S
    from weekloom.operators.joins import conform

    return conform(V.ledger(spark, sf, cases), S.LEDGER)


def snapshot(spark, sf):
    from weekloom import schemas as S
    from weekloom.operators.joins import conform

    w = V.weekly(spark, sf)
    cases = conform(w.withColumn("complete_week", F.lit(True)), S.CASE_TABLE)
    newest = cases.groupBy(*G).agg(F.max(WEEK).alias("latest"))
    led = cut_lineage(_full_ledger(spark, sf, w).join(newest, G))
    led = led.withColumn("latest_case_week", F.col("latest")).withColumn(
        "case_data_age_weeks", F.datediff(WEEK, "latest") / 7.0
    )
    return Z.serving_snapshot(led.drop("latest"), cases, G)


@query(
    "serving_snapshot",
    """
WITH i AS (SELECT geography, generated_at_utc FROM v_ledger GROUP BY ALL HAVING bool_or(lead_weeks = 0) AND bool_or(lead_weeks = 1)),
 n AS (SELECT geography, max(generated_at_utc) AS generated_at_utc FROM i GROUP BY ALL),
 l AS (SELECT v.* FROM v_ledger v JOIN n USING (geography, generated_at_utc)),
 h AS (SELECT geography, count(*) AS history_weeks, CAST(sum(total_cases) AS BIGINT) AS history_cases, max(week_start_date) AS last_week FROM v_weekly GROUP BY ALL)
SELECT l.geography, max(l.generated_at_utc) AS issued_at, max(l.week_start_date) FILTER (WHERE lead_weeks = 0) AS current_week,
 round(max(predicted_cases_p50) FILTER (WHERE lead_weeks = 0), 6) AS current_p50,
 round(max(predicted_cases_p50) FILTER (WHERE lead_weeks = 1), 6) AS next_p50, max(h.history_weeks) AS history_weeks,
 max(h.history_cases) AS history_cases, max(h.last_week) AS last_week,
 CASE WHEN max((l.week_start_date - h.last_week) / 7.0) FILTER (WHERE lead_weeks = 0) <= 2 THEN 'current' ELSE 'delayed' END AS level
FROM l JOIN h USING (geography) GROUP BY l.geography""",
    ("v_ledger",),
)
def _(spark, sf):
    s = snapshot(spark, sf)
    return doubles(
        s.select(
            *G,
            F.col("issuedAt").alias("issued_at"),
            F.col("signal.currentWeek.weekStart").alias("current_week"),
            F.col("signal.currentWeek.cases.p50").alias("current_p50"),
            F.col("signal.nextWeek.cases.p50").alias("next_p50"),
            F.size("history").cast("bigint").alias("history_weeks"),
            F.aggregate("history", F.lit(0).cast("bigint"), lambda a, x: a + x["totalCases"]).alias("history_cases"),
            F.element_at("history", -1)["weekStart"].alias("last_week"),
            F.col("freshness.level").alias("level"),
        )
    )
