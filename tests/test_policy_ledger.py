"""Metrics, gates, promotion, revisions, vintages, ledger and serving."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import Guardrails
from weekloom.functions import rules as R
from weekloom.operators import ledger as L
from weekloom.operators import metrics as M
from weekloom.operators import ordered as O
from weekloom.operators import policy as P
from weekloom.operators import quality as Q
from weekloom.operators import serving as Z
from weekloom.operators.joins import conform
from weekloom.sources import readers, sinks

G = ["geography"]
KEY = ["geography", "week_start_date"]


@pytest.fixture
def six(spark):
    rows = [("a", p, y) for p, y in ((0.05, 0), (0.10, 0), (0.20, 1), (0.40, 0), (0.80, 1), (0.90, 1))]
    return spark.createDataFrame(rows, "geography string, probability double, label int")


def brute_ap(pairs):
    pos = sum(y for _, y in pairs)
    area = last = 0.0
    for s in sorted({p for p, _ in pairs}, reverse=True):
        tp = sum(y for p, y in pairs if p >= s)
        n = sum(1 for p, _ in pairs if p >= s)
        area += (tp / pos - last) * tp / n
        last = tp / pos
    return area


def test_recall_gate_is_most_precise_then_highest(six):
    r = P.recall_gate(six, G, 0.66).first()
    assert r.alert_gate == 0.8
    everything = P.recall_gate(six, G, 1.0).first()
    assert everything.alert_gate == 0.2


def test_gate_table_counts_every_gate(six):
    got = {r.gate: r for r in P.gate_table(six, G, P.RECALL_GATES).collect()}
    assert len(got) == 91 and (got[0.05].alert_rows, got[0.06].alert_rows, got[0.95].alert_rows) == (6, 5, 0)
    assert got[0.95].precision == 0 and got[0.8].recall == pytest.approx(2 / 3)
    assert len(P.POLICY_GATES) == 18 and len(P.RESIDUAL_SCALES) == 31


def test_average_precision_matches_brute_force_with_a_dominant_series(spark):
    rng = random.Random(1)
    rows = [("big", round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(4000)]
    rows += [("small", rng.random(), int(rng.random() < 0.5)) for _ in range(50)] + [("one", 0.5, 1)]
    df = spark.createDataFrame(rows, "geography string, probability double, label int")
    got = {r.geography: r.pr_auc for r in M.average_precision(df, G).collect()}
    for g in ("big", "small"):
        assert got[g] == pytest.approx(brute_ap([(p, y) for k, p, y in rows if k == g]))
    assert got["one"] is None
    assert M.average_precision(df, []).first().pr_auc == pytest.approx(brute_ap([(p, y) for _, p, y in rows]))


@pytest.mark.parametrize("repeat", [1, 3])
def test_exact_quantiles_match_numpy_on_skewed_groups(spark, repeat):
    import numpy as np

    rng = random.Random(repeat)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("hot", 1.0)] * 1000 + [("cold", float(i % 3)) for i in range(7)]
    rows += [("none", None)]
    df = spark.createDataFrame(rows, "geography string, v double").repartition(1 + repeat)
    points = {"a": 0.0, "b": 0.25, "c": 0.6, "d": 1.0}
    got = {r.geography: r for r in O.exact_quantiles(df, G, "v", points).collect()}
    assert set(got) == {"hot", "cold"}
    for g in got:
        values = [v for k, v in rows if k == g]
        assert [got[g][n] for n in points] == pytest.approx([float(np.quantile(values, q)) for q in points.values()])


def test_running_totals_descending(spark):
    df = spark.createDataFrame([("a", float(v), v) for v in range(10)], "g string, v double, n int")
    got = {r.v: r.cum_n for r in O.running_totals(df, ["g"], "v", ["n"], descending=True).collect()}
    assert got == {float(v): sum(range(v, 10)) for v in range(10)}


def test_metric_split(spark):
    rows = [("a", 10.0, 8.0, 12.0, 12.0, 0, 15.0, 9.0), ("a", 20.0, 22.0, 25.0, 30.0, 0, 30.0, 10.0), ("a", 100.0, 80.0, 110.0, 120.0, 1, 50.0, 20.0), ("a", 80.0, 50.0, 70.0, 90.0, 1, 50.0, 100.0)]
    df = spark.createDataFrame(rows, "geography string, actual_cases double, predicted_cases_p50 double, predicted_cases_p80 double, predicted_cases_p90 double, actual_outbreak int, outbreak_threshold double, cases_lag_1 double")
    for flag in (False, True):
        r = M.mae_split(df, G, weekly_groups=flag).first()
        assert (r.mae, r.normal_week_mae, r.outbreak_week_mae, r.median_absolute_error) == (13.5, 2, 25, 11)
    assert M.pinball_coverage(df, G).first().p90_coverage == 1
    signal = M.threshold_signal(df, G).first()
    assert (signal.p50_threshold_precision, signal.p50_threshold_recall) == (1, 1)


def test_ordered_quantiles_residuals_scales_offsets(spark):
    one = spark.range(1)

    def q(*raw, **kw):
        made = R.ordered_quantiles(*[F.lit(float(x)) for x in raw], **kw)
        return tuple(one.select(*[c.alias(n) for n, c in made.items()]).first())

    assert q(20, 15, -3) == (20, 20, 20)
    assert q(-5, 2, 8, baseline=40.0) == (35, 42, 48)
    assert q(10, 20, 30, baseline=40.0, scales=(0.0, 0.5, 2 / 3)) == pytest.approx((40, 50, 60))
    assert q(0, 0, 0, baseline=40.0, offsets=(12.0, 25.0)) == (40, 52, 65)


def test_scales_prefer_the_smaller_on_ties_and_fallback(spark):
    df = spark.createDataFrame([("a", 10.0, 10.0, 0.0), ("b", 10.0, 8.0, 2.0)], "geography string, y double, base double, r double")
    got = {r.geography: r.scale_p50 for r in P.residual_scales(df, G, "y", "base", {0.5: "r"}).collect()}
    assert got == {"a": 0.0, "b": 1.0}
    rows = spark.createDataFrame([("a", 10.0, 20.0, 20.0, 20.0, 11.0, 1.0, 30.0), ("b", 10.0, 10.0, 11.0, 12.0, 3.0, 1.0, 2.0)],
        "geography string, actual_cases double, predicted_cases_p50 double, predicted_cases_p80 double, predicted_cases_p90 double, cases_lag_1 double, offset_p80 double, offset_p90 double")
    got = {r.geography: r for r in P.persistence_fallback(rows, G).collect()}
    assert (got["a"].predicted_cases_p50, got["a"].predicted_cases_p80, got["a"].predicted_cases_p90) == (11, 20, 41)
    assert got["a"].used_persistence_fallback and not got["b"].used_persistence_fallback and got["b"].predicted_cases_p50 == 10


def test_finalized_weeks(spark):
    weeks = spark.createDataFrame([("a", date(2026, 5, 4) + timedelta(weeks=i)) for i in range(12)], "geography string, week_start_date date")
    last = P.finalized(weeks, F.lit("2026-06-29").cast("date"), 4).agg(F.max("week_start_date")).first()[0]
    assert last == date(2026, 5, 25)


MODEL = "geography string, training_data_cutoff date, model_schema_version int, case_forecast_schema_version int"
BASE = {"precision": 0.8, "recall": 0.9, "pr_auc": 0.8, "brier": 0.17}
CASE = {"case_mae": 10.0, "outbreak_week_mae": 20.0, "persistence_mae": 10.0}


def promote(spark, new, old, weeks=13, upgrade=False, champion=True):
    def long(metrics):
        rows = [("pr", route, m, float(v)) for route, ms in metrics.items() for m, v in ms.items()]
        return spark.createDataFrame(rows, "geography string, route string, metric string, value double")

    cut = date(2026, 1, 5)
    candidate = spark.createDataFrame([("pr", cut + timedelta(weeks=weeks), 6 if upgrade else 5, 6)], MODEL)
    champions = spark.createDataFrame([("pr", cut, 5, 6)] if champion else [], MODEL)
    rules = P.promotion_rules(long(new), long(old), candidate, champions, G, Guardrails(), 13)
    decision = P.promotion_decision(rules, G).first()
    return decision.promote, decision.reasons


def test_promotion_passes_fails_and_bootstraps(spark):
    good = {"weather_only": BASE | CASE, "weather_plus_recent_cases": BASE | CASE}
    assert promote(spark, good, good)[0]
    assert not promote(spark, good, good, weeks=12)[0]
    assert promote(spark, good, good, weeks=0, upgrade=True)[0]
    assert promote(spark, good, {}, champion=False) == (True, ["bootstrap: no champion exists"])
    worse = good | {"weather_only": BASE | CASE | {"recall": 0.86}}
    passed, reasons = promote(spark, worse, good)
    assert not passed and any("weather_only recall: fail" in r for r in reasons)
    edge = good | {"weather_only": BASE | CASE | {"recall": 0.88}}
    assert promote(spark, edge, good)[0]
    slower = good | {"weather_plus_recent_cases": BASE | CASE | {"case_mae": 11.2, "persistence_mae": 12.0}}
    assert not promote(spark, slower, good)[0]
    beaten = good | {"weather_plus_recent_cases": BASE | CASE | {"case_mae": 10.9, "persistence_mae": 10.0}}
    passed, reasons = promote(spark, beaten, good)
    assert not passed and any("persistence: fail" in r for r in reasons)
    added = good | {"weather_plus_delayed_cases": BASE | CASE}
    assert not promote(spark, added, good)[0] and promote(spark, added, good, upgrade=True)[0]
    silent = good | {"weather_plus_recent_cases": BASE | {"case_mae": 10.0, "outbreak_week_mae": 20.0}}
    assert not promote(spark, silent, good)[0]


def case_rows(spark, values, stamp="t0"):
    rows = [("pr", date(2026, 1, 5) + timedelta(weeks=i), t, p, g, h, True, "f", "2026-02-01", stamp, "") for i, (t, p, g, h) in enumerate(values)]
    return spark.createDataFrame(rows, S.CASE_TABLE)


def test_canonical_table_revisions_and_guards(spark, tmp_path):
    table, log = str(tmp_path / "cases"), str(tmp_path / "log")
    first = sinks.write_canonical(case_rows(spark, [(10, 7, 3, 2), (5, 4, 1, 0)]), table, "s1", log)
    assert first == {"replaced": True, "events": 2}
    same = sinks.write_canonical(case_rows(spark, [(10, 7, 3, 2), (5, 4, 1, 0)], "later"), table, "s2", log)
    assert same == {"replaced": False, "events": 0}
    parts = sinks.write_canonical(case_rows(spark, [(10, 6, 4, 2), (5, 4, 1, 0)]), table, "s3", log)
    assert parts == {"replaced": True, "events": 0}
    changed = sinks.write_canonical(case_rows(spark, [(12, 8, 4, 4), (5, 4, 1, 0)]), table, "s4", log)
    assert changed["events"] == 1
    event = spark.read.parquet(log).filter("change_type = 'revision'").first()
    assert (event.old_total_cases, event.new_total_cases, event.old_hospitalized_cases, event.new_hospitalized_cases) == (10, 12, 2, 4)
    assert {r.total_cases for r in sinks.read_canonical(spark, table).collect()} == {12, 5}
    with pytest.raises(Q.QualityError, match="lost too many"):
        sinks.write_canonical(case_rows(spark, [(12, 8, 4, 4)]), table, "s5", log)
    twice = case_rows(spark, [(1, 1, 0, 0)])
    with pytest.raises(Q.QualityError, match="duplicate"):
        sinks.write_canonical(twice.union(twice), table, "s6", log)


def test_backfilled_hospitalizations_are_no_revision(spark):
    old, new = case_rows(spark, [(10, 7, 3, None)]), case_rows(spark, [(10, 7, 3, 4)])
    assert L.revision_events(old, new, KEY).count() == 0


def test_vintage_identity_ignores_order_partitions_and_retrieval(spark, tmp_path):
    rows = case_rows(spark, [(i, i, 0, 0) for i in range(7)])
    hashed = [c for c in S.CASE_COLUMNS if c != "retrieved_at_utc"]
    one = L.content_hash(rows.coalesce(1), G, hashed).first()
    two = L.content_hash(rows.withColumn("retrieved_at_utc", F.lit("x")).repartition(5).orderBy(F.desc("total_cases")), G, hashed).first()
    three = L.content_hash(case_rows(spark, [(i, i, 0, int(i == 3)) for i in range(7)]), G, hashed).first()
    assert one == two and one.vintage_id != three.vintage_id
    path = str(tmp_path / "vintages")
    for _ in range(2):
        sinks.write_case_vintage(rows, path)
    assert spark.read.parquet(path).count() == 7


def ledger_rows(spark, rows):
    made = spark.createDataFrame(rows, "geography string, generated_at_utc string, as_of_date date, week_start_date date, lead_weeks long, model_version string, predicted_cases_p50 double, historical_outbreak_threshold_cases double, outbreak_probability double, outbreak_alert boolean, input_vintage_basis string")
    return conform(made, S.LEDGER)


def issue(day, lead, p=1.0, stamp="a", basis=S.PERSISTED_BASIS):
    return ("pr", f"{day}T{stamp}", day, day + timedelta(weeks=lead), lead, "m", p, 5.0, 0.9, True, basis)


def test_ledger_upsert_is_idempotent_and_keeps_other_days(spark, tmp_path):
    path, d0, d1 = str(tmp_path / "ledger"), date(2026, 1, 5), date(2026, 1, 12)
    sinks.upsert_ledger(ledger_rows(spark, [issue(d0, 0), issue(d0, 1), issue(d1, 0)]), path)
    rerun = ledger_rows(spark, [issue(d1, 0, 2.0, "b"), issue(d1, 1, 3.0, "b")])
    for _ in range(2):
        sinks.upsert_ledger(rerun, path)
    got = {(r.as_of_date, r.lead_weeks): r.predicted_cases_p50 for r in sinks.read_ledger(spark, path).collect()}
    assert got == {(d0, 0): 1.0, (d0, 1): 1.0, (d1, 0): 2.0, (d1, 1): 3.0}


def test_reconciliation_and_prospective_rows(spark):
    d = date(2026, 1, 5)
    led = ledger_rows(spark, [issue(d, 0, 8.0), issue(d, 1, 4.0, basis="not_persisted"), issue(d + timedelta(weeks=20), 0)])
    cases = spark.createDataFrame([("pr", d, 10), ("pr", d + timedelta(weeks=1), 3), ("pr", d + timedelta(weeks=20), 3)], "geography string, week_start_date date, total_cases long")
    known = L.attach_truth(led, cases, KEY, F.lit("2026-03-01").cast("date"), 4, F.lit("now"))
    got = {(r.lead_weeks, r.as_of_date): (r.actual_cases, r.absolute_case_error, r.actual_outbreak) for r in known.collect()}
    assert got[(0, d)] == (10, 2, 1) and got[(1, d)] == (3, 1, 0) and got[(0, d + timedelta(weeks=20))] == (None, None, None)
    m = {r.evaluation_basis: r for r in L.reconcile_metrics(known, G).collect()}
    assert m["all_versioned_predictions"].evaluated_rows == 2 and m["all_versioned_predictions"].mae == 1.5
    assert m[S.PERSISTED_BASIS].evaluated_rows == 1 and m[S.PERSISTED_BASIS].pr_auc is None and m[S.PERSISTED_BASIS].recall == 1
    assert L.reconcile_metrics(known.filter("false"), G).count() == 0
    open_rows = known.withColumn("actual_outbreak", F.lit(None).cast("bigint"))
    report = {r.evaluation_basis: r for r in L.reconcile_report(open_rows, G).collect()}
    assert {b: (r.evaluated_rows, r.message) for b, r in report.items()} == {b: (0, t) for b, t in L.NOTHING_FINAL.items()}


def test_latest_complete_issue_skips_a_half_written_one(spark):
    d = date(2026, 1, 5)
    led = ledger_rows(spark, [issue(d, 0), issue(d, 1), issue(d + timedelta(weeks=1), 0)])
    got = L.latest_complete_issue(led, G).collect()
    assert {r.as_of_date for r in got} == {d} and len(got) == 2


def test_snapshot_is_valid_json_without_nan(spark, tmp_path):
    d = date(2026, 1, 5)
    led = ledger_rows(spark, [issue(d, 0, 6.0), issue(d, 1, 7.0)])
    snap = Z.serving_snapshot(led, case_rows(spark, [(10, 7, 3, 2), (5, 4, 1, 0), (6, 5, 1, 0)]), G, history_weeks=2)
    sinks.write_serving_json(snap, str(tmp_path / "serving"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "serving")).collect()]
    doc = json.loads(lines[0])
    assert len(lines) == 1 and "NaN" not in lines[0]
    assert doc["signal"]["nextWeek"]["cases"]["p50"] == 7.0 and [h["totalCases"] for h in doc["history"]] == [5, 6]
    assert doc["freshness"]["level"] == "unavailable"


def test_keep_last_moves_whole_rows(spark):
    df = spark.createDataFrame([("k", 1, "old", 5), ("k", 2, None, None)], "k string, t int, s string, n int")
    r = L.keep_last(df, ["k"], ["t"]).first()
    assert (r.t, r.s, r.n) == (2, None, None)


def test_checked_joins_raise_on_broken_cardinality(spark):
    one, two = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(1, "y"), (1, "z")], "k int, b string")
    assert Q.checked_join(one, two, ["k"], "left", "one_to_many").count() == 2
    for expect in ("one_to_one", "many_to_one"):
        with pytest.raises(Exception, match="repeats a key"):
            Q.checked_join(one, two, ["k"], "left", expect).collect()


def test_readers_refuse_bad_input(spark, tmp_path):
    def csv(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    ok = csv("ok.csv", "city,week_start_date,total_cases\n SJ ,2026-01-05,4\n")
    assert readers.read_recent_cases(spark, ok, ["sj", "iq"]).first().city == "sj"
    for name, text in {
        "unknown": "city,week_start_date,total_cases\nxx,2026-01-05,4\n",
        "negative": "city,week_start_date,total_cases\nsj,2026-01-05,-4\n",
        "twice": "city,week_start_date,total_cases\nsj,2026-01-05,4\nSJ,2026-01-05,5\n",
        "text": "city,week_start_date,total_cases\nsj,2026-01-05,many\n",
    }.items():
        with pytest.raises(Exception):
            readers.read_recent_cases(spark, csv(name, text), ["sj", "iq"]).collect()
    with pytest.raises(Q.QualityError):
        readers.read_recent_cases(spark, csv("short", "city,total_cases\nsj,1\n"), ["sj"])
    block = {"time": ["2026-07-06", "2026-07-07"]} | {c: [1, "x"] for c in S.DAILY_WEATHER}
    (tmp_path / "w.json").write_text(json.dumps({"daily": block}, indent=1))
    got = readers.read_columnar_daily_json(spark, str(tmp_path / "w.json"), F.lit("s")).orderBy("date").collect()
    assert [r.rain_sum for r in got] == [1.0, None]
    block["rain_sum"] = [1]
    (tmp_path / "w.json").write_text(json.dumps({"daily": block}))
    spark.catalog.clearCache()
    with pytest.raises(Exception, match="unequal lengths"):
        readers.read_columnar_daily_json(spark, str(tmp_path / "w.json"), F.lit("s")).collect()
