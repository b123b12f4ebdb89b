"""Revisions, vintages, the prediction ledger and its reconciliation with outcomes.

Last-row-wins and latest-row operators are ``max_by`` aggregates: they combine on the map
side, so a key with very many re-appends never fills one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom import schemas as S
from weekloom.config import cut_lineage
from weekloom.functions.rules import freshness_level
from weekloom.operators import metrics as M
from weekloom.operators.ordered import exact_quantiles
from weekloom.operators.policy import finalized


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; whole rows, no column mixing.

    ``order`` should decide every tie, or which of two equal rows stays is open.
    """
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in order])
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def combine_sources(archive: DataFrame, live: DataFrame, keys: list[str], source: str = "weather_source") -> DataFrame:
    """Whole row of the alphabetically last source on overlap, even where it has NULLs."""
    return keep_last(archive.unionByName(live), keys, [source])


def revision_events(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New weeks and changed counts between two snapshots, compared NULL-safely.

    A hospitalization that was never recorded before is a back-fill, not a revision.
    """
    o = old.select(
        *keys,
        F.col("total_cases").alias("old_total_cases"),
        F.col("hospitalized_cases").alias("old_hospitalized_cases"),
        F.lit(True).alias("_had"),
    )
    passed = [c for c in ("retrieved_at_utc", "source_file_id", "source_publication_date") if c in new.columns]
    n = new.select(
        *keys,
        F.col("total_cases").alias("new_total_cases"),
        F.col("hospitalized_cases").alias("new_hospitalized_cases"),
        *passed,
    )
    both = n.join(o, keys, "left")
    is_new = F.col("_had").isNull()
    total = ~F.col("old_total_cases").eqNullSafe(F.col("new_total_cases"))
    hospital = F.col("old_hospitalized_cases").isNotNull() & ~F.col("old_hospitalized_cases").eqNullSafe(
        F.col("new_hospitalized_cases")
    )
    return both.filter(is_new | total | hospital).select(
        *keys,
        "old_total_cases",
        "new_total_cases",
        "old_hospitalized_cases",
        "new_hospitalized_cases",
        F.when(is_new, "new").otherwise("revision").alias("change_type"),
        *[F.col(c).alias("observed_at_utc" if c == "retrieved_at_utc" else c) for c in passed],
    )


def snapshot_difference(left: DataFrame, right: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Rows whose multiplicity differs: one shuffle instead of two set differences."""
    columns = [c for c in left.columns if c not in set(ignore or [])]
    tagged = left.select(*columns, F.lit(1).alias("_d")).unionByName(right.select(*columns, F.lit(-1).alias("_d")))
    return tagged.groupBy(*columns).agg(F.sum("_d").alias("extra_rows")).filter("extra_rows <> 0")


def snapshot_equal(left: DataFrame, right: DataFrame, ignore: list[str] | None = None) -> bool:
    return snapshot_difference(left, right, ignore).isEmpty()


def canonical_text(columns: list[str]) -> Column:
    """Unambiguous text of a row: each value with its length, NULL marked apart."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *parts)


def content_hash(df: DataFrame, keys: list[str], columns: list[str], prefix: str = "case-") -> DataFrame:
    """Content identity of each series' rows that depends on neither row nor partition order.

    Row digests are added up as numbers, which combines on the map side; no group is
    gathered to be sorted and serialized.
    """
    digest = F.sha2(canonical_text(columns), 256)
    pieces = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    summed = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.sum(p).alias(f"_s{i}") for i, p in enumerate(pieces)]
    )
    whole = F.concat_ws("|", F.col("row_count").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)])
    return summed.select(*keys, "row_count", F.concat(F.lit(prefix), F.substring(F.sha2(whole, 256), 1, 16)).alias("vintage_id"))


def input_vintages(scored: DataFrame, features: list[str], metadata: list[str], prefix: str = "input-") -> DataFrame:
    """Per-row content identity of model inputs, features kept as a map for audit.

    The generation time is not part of the identity.
    """
    names = sorted(set(features))
    hashed = [c for c in sorted(metadata) if c != "generated_at_utc"]
    identity = F.sha2(canonical_text([*hashed, *names]), 256)
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in names])
    return scored.select(
        *metadata,
        F.map_from_entries(entries).alias("features"),
        F.concat(F.lit(prefix), F.substring(identity, 1, 16)).alias("input_vintage_id"),
    )


def attach_truth(ledger: DataFrame, cases: DataFrame, keys: list[str], as_of: Column, weeks: int = 4, stamp: Column | None = None) -> DataFrame:
    """Finalized outcomes, error and actual label onto ledger rows; other rows stay as they are."""
    truth = finalized(cases, as_of, weeks).select(*keys, F.col("total_cases").cast("double").alias("_truth"))
    made = ("actual_cases", "absolute_case_error", "actual_outbreak", "evaluated_at_utc")
    joined = ledger.join(truth, keys, "left")
    t = F.col("_truth")
    new = {
        "actual_cases": t,
        "absolute_case_error": F.abs(t - F.col("predicted_cases_p50")),
        "actual_outbreak": (t >= F.col("historical_outbreak_threshold_cases")).cast("bigint"),
        "evaluated_at_utc": stamp if stamp is not None else F.lit(None).cast("string"),
    }
    kept = {c: (F.col(c) if c in ledger.columns else F.lit(None)) for c in made}
    out = [F.col(c) for c in ledger.columns if c not in made]
    return joined.select(*out, *[F.when(t.isNotNull(), new[c]).otherwise(kept[c]).alias(c) for c in made])


def prediction_metrics(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """Alert and case metrics of the evaluated ledger rows, per key.

    Counts and means share one aggregate; the median error and the average precision need an
    order and come from value ranges.
    """
    rows = evaluated.filter(F.col("actual_outbreak").isNotNull())
    up, high = F.col("outbreak_alert"), F.col("actual_outbreak") == 1
    actual, p50 = F.col("actual_cases"), F.col("predicted_cases_p50")
    known = p50.isNotNull()
    error = F.abs(actual - p50)
    gap = F.col("outbreak_probability") - F.col("actual_outbreak")
    aggs = [
        F.count(F.lit(1)).alias("evaluated_rows"),
        F.count_if(up & high).alias("true_positives"),
        F.count_if(up & ~high).alias("false_positives"),
        F.count_if(~up & ~high).alias("true_negatives"),
        F.count_if(~up & high).alias("false_negatives"),
        F.avg(gap * gap).alias("brier"),
        F.count_if(known).alias("case_rows"),
        F.avg(error).alias("mae"),
        F.avg(F.when(~high, error)).alias("normal_week_mae"),
        F.avg(F.when(high, error)).alias("outbreak_week_mae"),
    ]
    for q, tag in ((0.80, "p80"), (0.90, "p90")):
        p = F.col(f"predicted_cases_{tag}")
        aggs.append(F.avg(F.when(known, M.pinball(actual, p, q))).alias(f"{tag}_pinball_loss"))
        aggs.append(F.avg(F.when(known, (actual <= p).cast("double"))).alias(f"{tag}_coverage"))
    counted = rows.groupBy(*keys).agg(*aggs).select("*", *M.confusion_ratios())
    pr = M.average_precision(rows, keys, "outbreak_probability", "actual_outbreak")
    middle = exact_quantiles(rows.select(*keys, error.alias("_e")), keys, "_e", {"median_absolute_error": 0.5})
    return counted.join(pr, keys).join(middle, keys, "left")


ALL_PREDICTIONS = "all_versioned_predictions"
NOTHING_FINAL = {
    ALL_PREDICTIONS: "no prediction has a finalized outcome yet",
    S.PERSISTED_BASIS: "no prediction with persisted inputs has a finalized outcome yet",
}


def reconcile_report(reconciled: DataFrame, keys: list[str]) -> DataFrame:
    """``reconcile_metrics`` with a row for every series and basis: where nothing is final, 0 rows and a message say so."""
    bases = F.explode(F.array(*[F.lit(b) for b in NOTHING_FINAL])).alias("evaluation_basis")
    wanted = reconciled.select(*keys).distinct().select(*keys, bases)
    found = wanted.join(reconcile_metrics(reconciled, keys), [*keys, "evaluation_basis"], "left")
    said = F.coalesce(*[F.when(F.col("evaluation_basis") == b, m) for b, m in NOTHING_FINAL.items()])
    none = F.col("evaluated_rows").isNull()
    return found.withColumn("message", F.when(none, said)).withColumn("evaluated_rows", F.coalesce("evaluated_rows", F.lit(0).cast("bigint")))


def reconcile_metrics(reconciled: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of all versioned predictions and of those with persisted inputs."""
    rows = reconciled.select(
        "*",
        F.explode(
            F.when(
                F.col("input_vintage_basis") == S.PERSISTED_BASIS,
                F.array(F.lit(ALL_PREDICTIONS), F.lit(S.PERSISTED_BASIS)),
            ).otherwise(F.array(F.lit(ALL_PREDICTIONS)))
        ).alias("evaluation_basis"),
    )
    needed = ["outbreak_alert", "outbreak_probability", "actual_outbreak", "actual_cases"]
    needed += [f"predicted_cases_{t}" for t in ("p50", "p80", "p90")]
    # Several ordered passes follow; they read the narrow, evaluated rows and not the whole join.
    evaluated = cut_lineage(
        rows.filter(F.col("actual_outbreak").isNotNull()).select(*keys, "evaluation_basis", *needed)
    )
    return prediction_metrics(evaluated, [*keys, "evaluation_basis"])


def latest_row(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return keep_last(df, keys, [order])


def latest_complete_issue(ledger: DataFrame, series: list[str], issue: str = "generated_at_utc") -> DataFrame:
    """Rows of the newest issue that has both lead 0 and lead 1."""
    leads = ledger.groupBy(*series, issue).agg(
        F.bool_or(F.col("lead_weeks") == 0).alias("_zero"), F.bool_or(F.col("lead_weeks") == 1).alias("_one")
    )
    newest = leads.filter("_zero AND _one").groupBy(*series).agg(F.max(issue).alias(issue))
    return ledger.join(newest, [*series, issue], "left_semi")


def latest_live_by_lead(ledger: DataFrame, version: Column, series: list[str]) -> DataFrame:
    """Newest row of one model version per target week and lead."""
    rows = ledger.filter(F.col("model_version") == version)
    return keep_last(rows, [*series, "week_start_date", "lead_weeks"], ["generated_at_utc"])


def case_age(latest: str, target: str) -> tuple[Column, Column]:
    age = F.datediff(target, latest) / F.lit(7.0)
    return age.alias("case_data_age_weeks"), freshness_level(age).alias("freshness_level")
