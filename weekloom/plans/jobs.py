"""The scheduled jobs as functions over table paths: ingest, train and guard, predict and monitor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import Policy, cut_lineage
from weekloom.functions.calendar import iso_week, iso_year, week_floor
from weekloom.operators import features as X
from weekloom.operators import ledger as L
from weekloom.operators import policy as P
from weekloom.operators import rollup as U
from weekloom.operators.joins import conform
from weekloom.operators.models import TreeSettings
from weekloom.operators.quality import require_rows
from weekloom.operators.serving import serving_snapshot
from weekloom.plans import bundles as B
from weekloom.sources import sinks
from weekloom.sources.readers import read_if_present

SERIES = ["geography"]
WEEK = "week_start_date"
HISTORY_SCHEMA = (
    "geography string, model_version string, training_data_cutoff date, promoted_at_utc string, "
    "model_schema_version int, case_forecast_schema_version int, bundle string"
)


@dataclass(frozen=True)
class Store:
    """Paths of the state tables below one shared folder."""

    root: str

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def ingest(
    daily: DataFrame, store: Store, stamp: str, source_file_id: str, publication_date: str, source_page: str = ""
) -> dict:
    """Daily records to the canonical weekly table, its vintage and the revision log."""
    weekly = U.weekly_case_rollup(daily, SERIES)
    stamped = conform(
        weekly.select(
            "*",
            F.lit(source_file_id).alias("source_file_id"),
            F.lit(publication_date).alias("source_publication_date"),
            F.lit(stamp).alias("retrieved_at_utc"),
            F.lit(source_page).alias("source_page"),
        ),
        S.CASE_TABLE,
    )
    table = cut_lineage(require_rows(stamped, "the source holds no complete week"))
    sinks.write_case_vintage(table, store.at("case_vintages"))
    return sinks.write_canonical(table, store.at("cases"), stamp, store.at("revisions"))


def load_cases(spark: SparkSession, store: Store) -> DataFrame:
    cases = sinks.read_canonical(spark, store.at("cases"))
    return cases.select("*", iso_year(WEEK).alias("year"), iso_week(WEEK).alias("weekofyear"))


def model_history(spark: SparkSession, store: Store) -> DataFrame:
    empty = spark.createDataFrame([], HISTORY_SCHEMA).schema
    return read_if_present(spark, store.at("model_history"), empty)


def champion_slots(spark: SparkSession, store: Store) -> DataFrame:
    """The newest promoted, compatible model of each series and the bundle that holds it."""
    return P.current_models(model_history(spark, store), SERIES, S.MODEL_SCHEMA_VERSION, S.CASE_FORECAST_SCHEMA_VERSION)


def champions(spark: SparkSession, store: Store) -> list[tuple[B.Candidate, DataFrame]]:
    """Every bundle that a slot names, with the series it serves; as many as there are promotions still in use."""
    slots = cut_lineage(champion_slots(spark, store))
    found = [r["bundle"] for r in slots.select("bundle").distinct().orderBy("bundle").collect()]
    return [(B.load_candidate(spark, path), slots.where(F.col("bundle") == path)) for path in found]


def train_and_guard(
    spark: SparkSession,
    store: Store,
    weekly_weather: DataFrame,
    as_of: Column,
    stamp: str,
    policy: Policy = Policy(),
    settings: TreeSettings = TreeSettings(),
    validation_years: int = 4,
) -> DataFrame:
    """Train only where enough new weeks are final, then promote under the guardrails.

    A bundle is trained when any series is due. Each series is promoted alone: the history gets a row, and with it the
    slot the new bundle, only where its own rules pass. Returns the decision per series.
    """
    stable = cut_lineage(P.finalized(load_cases(spark, store), as_of, policy.label_stabilization_weeks))
    current = P.current_models(model_history(spark, store), SERIES, S.MODEL_SCHEMA_VERSION, S.CASE_FORECAST_SCHEMA_VERSION)
    due = cut_lineage(P.retrain_due(stable, current, SERIES, policy.minimum_new_finalized_weeks))
    if due.filter("retrain_due").isEmpty():
        return due.select(
            *SERIES,
            F.lit(False).alias("promote"),
            F.lit(False).alias("candidate_trained"),
            F.array(
                F.concat(F.lit("only "), F.col("new_finalized_weeks").cast("string"), F.lit(" new finalized weeks"))
            ).alias("reasons"),
        )
    candidate = B.train_candidate(stable, weekly_weather, SERIES, policy, settings, stamp, validation_years=validation_years)
    rules, decision = B.decide(candidate, champions(spark, store), policy)
    decision = cut_lineage(decision)
    sinks.append_log(rules.withColumn("evaluated_at_utc", F.lit(stamp)), store.at("promotion_reports"))
    promoted = decision.filter("promote").select(*SERIES)
    if not promoted.isEmpty():
        bundle = store.at("models/" + stamp.replace(":", "").replace("-", ""))
        B.save_candidate(candidate, bundle)
        parts = [f.held_out.drop(*_features(f)) for f in candidate.forecasters.values()]
        keep = ["week_start_date", "year", "weekofyear", "forecast_variant", "actual_cases", "outbreak_threshold",
                "actual_outbreak", "predicted_cases_p50", "predicted_cases_p80", "predicted_cases_p90"]
        rows = [p.select(*SERIES, *keep).join(promoted, SERIES, "left_semi") for p in parts]
        known = read_if_present(spark, store.at("validation_rows"), rows[0].schema)
        kept = cut_lineage(known.join(promoted, SERIES, "left_anti"))  # of series that keep their champion
        sinks.write_validation_rows([*rows, kept], store.at("validation_rows"))
        # The history rows are the promotion: they are written after everything they point to.
        history = candidate.metadata.join(promoted, SERIES, "left_semi").withColumn("bundle", F.lit(bundle))
        sinks.append_log(history, store.at("model_history"))
    return decision.withColumn("candidate_trained", F.lit(True)).drop("rule_count", "failed_rules")


def _features(forecaster) -> list[str]:
    return [c for c in forecaster.features if c in forecaster.held_out.columns]


def predict_and_monitor(
    spark: SparkSession,
    store: Store,
    weekly_weather: DataFrame,
    as_of: str,
    stamp: str,
    policy: Policy = Policy(),
) -> DataFrame:
    """Score this week and the next of every series, append idempotently, reconcile old rows."""
    cases = cut_lineage(load_cases(spark, store))
    serving = champions(spark, store)
    if not serving:
        raise ValueError("no champion exists; run guarded training first")
    day = F.lit(as_of).cast("date")
    leads = F.array(*[F.lit(k).cast("bigint") for k in range(policy.prediction_weeks_ahead + 1)])
    features = cut_lineage(X.weather_features(weekly_weather, SERIES).drop("weekofyear"))
    vintages = sinks.current_vintages(cases, SERIES)
    for candidate, slots in serving:
        targets = slots.select(*SERIES, F.explode(leads).alias("lead_weeks")).withColumn(
            WEEK, F.date_add(week_floor(day), (F.col("lead_weeks") * 7).cast("int"))
        )
        scored = cut_lineage(B.score_weeks(candidate, features, cases, targets, policy, day, stamp, vintages))
        sinks.write_vintages(B.input_rows(scored, candidate), store.at("input_vintages"), "input_vintage_id")
        sinks.upsert_ledger(B.ledger_rows(scored), store.at("ledger"))
    return monitor(spark, store, day, stamp, policy)


def monitor(spark: SparkSession, store: Store, as_of: Column, stamp: str, policy: Policy = Policy()) -> DataFrame:
    """Attach finalized outcomes to the ledger and report metrics of all and prospective rows."""
    ledger = sinks.read_ledger(spark, store.at("ledger"))
    cases = load_cases(spark, store)
    known = L.attach_truth(
        ledger, cases, [*SERIES, WEEK], as_of, policy.label_stabilization_weeks, F.lit(stamp)
    )
    # Only rows whose outcome is new are rewritten.
    changed = cut_lineage(
        known.filter(F.col("evaluated_at_utc") == stamp)
        .join(
            ledger.select(*S.LEDGER_KEY, F.col("actual_cases").alias("_was")), S.LEDGER_KEY, "left"
        )
        .filter(~F.col("actual_cases").eqNullSafe(F.col("_was")))
        .drop("_was")
    )
    if not changed.isEmpty():
        sinks.upsert_ledger(changed, store.at("ledger"))
    return L.reconcile_metrics(sinks.read_ledger(spark, store.at("ledger")), SERIES)


def publish(spark: SparkSession, store: Store, history_weeks: int | None = None) -> DataFrame:
    """Serving snapshot of the newest complete issue of every series."""
    snapshot = serving_snapshot(
        sinks.read_ledger(spark, store.at("ledger")), load_cases(spark, store), SERIES, history_weeks=history_weeks
    )
    sinks.write_serving_json(snapshot, store.at("serving"))
    return snapshot


def weekly(spark, store, daily, weekly_weather, as_of, stamp, source_file_id, publication_date, policy=Policy(), settings=TreeSettings(), validation_years=4):
    """Ingest, train where nothing compatible exists yet, score, reconcile, publish."""
    ingest(daily, store, stamp, source_file_id, publication_date)
    if champion_slots(spark, store).isEmpty():
        train_and_guard(spark, store, weekly_weather, F.lit(as_of).cast("date"), stamp, policy, settings, validation_years)
    predict_and_monitor(spark, store, weekly_weather, as_of, stamp, policy)
    return publish(spark, store)


def monthly(spark, store, daily, weekly_weather, as_of, stamp, source_file_id, publication_date, policy=Policy(), settings=TreeSettings(), validation_years=4):
    """The weekly job with the retraining decision taken first."""
    ingest(daily, store, stamp, source_file_id, publication_date)
    train_and_guard(spark, store, weekly_weather, F.lit(as_of).cast("date"), stamp, policy, settings, validation_years)
    predict_and_monitor(spark, store, weekly_weather, as_of, stamp, policy)
    return publish(spark, store)
