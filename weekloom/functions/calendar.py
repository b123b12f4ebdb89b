"""Week arithmetic. Weekdays count from Monday = 0; weeks are ISO unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CYCLE_WEEKS = 53  # length of the cyclic week axis
SEASON_WEEKS = 52.0  # period of the harmonics


def _c(value: Column | str | int) -> Column:
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value) if isinstance(value, int) else value


def week_floor(day: Column | str, start_weekday: int | Column = 0) -> Column:
    """Latest week start on or before ``day``."""
    d = _c(day).cast("date")
    return F.date_sub(d, F.pmod(F.weekday(d) - _c(start_weekday), F.lit(7)).cast("int"))


def iso_year(day: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(day)).cast("int")


def iso_week(day: Column | str) -> Column:
    return F.weekofyear(_c(day)).cast("int")


def iso_week_start(year: Column | str, week: Column | str, strict: bool = False) -> Column:
    """Monday of an ISO year and week; an impossible pair is NULL, or an error when strict."""
    y, w = _c(year).cast("int"), _c(week).cast("int")
    first = F.date_trunc("week", F.make_date(y, F.lit(1), F.lit(4))).cast("date")
    monday = F.date_add(first, (w - 1) * 7)
    real = (iso_year(monday) == y) & (iso_week(monday) == w)
    if not strict:
        return F.when(real, monday)
    bad = F.concat(F.lit("impossible ISO year and week: "), y.cast("string"), F.lit("/"), w.cast("string"))
    return F.when(real, monday).when(y.isNotNull() & w.isNotNull(), F.raise_error(bad).cast("date"))


def epi_week(day: Column | str, offset: Column | str | int) -> Column:
    """Week number 1..53 of a source whose numbering runs ``offset`` weeks from ISO."""
    return (F.pmod(iso_week(day) + _c(offset) - 1, F.lit(CYCLE_WEEKS)) + 1).cast("int")


def week_offset(week: Column | str, day: Column | str) -> Column:
    """Signed cyclic distance (-26..26) of a source's week number from the ISO week."""
    return (F.pmod(_c(week).cast("int") - iso_week(day) + 26, F.lit(CYCLE_WEEKS)) - 26).cast("int")


def week_index(day: Column | str) -> Column:
    """Whole weeks since the epoch; equal steps for any fixed start weekday."""
    return F.floor(F.datediff(_c(day), F.lit("1970-01-01").cast("date")) / 7).cast("int")


def weekday_phase(day: Column | str) -> Column:
    """Position of the start weekday in the cycle of ``week_index``."""
    return F.pmod(F.datediff(_c(day), F.lit("1970-01-01").cast("date")), F.lit(7)).cast("int")


def weeks_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_c(later), _c(earlier)) / F.lit(7.0)


def neighbour_weeks(week: Column | str, width: int = 2) -> Column:
    """The ``2*width+1`` week numbers at cyclic distance up to ``width``."""
    w = _c(week).cast("int")
    return F.array(
        *[
            (F.pmod(w + F.lit(step) - 1, F.lit(CYCLE_WEEKS)) + 1).cast("int")
            for step in range(-width, width + 1)
        ]
    )


def harmonics(week: Column | str) -> dict[str, Column]:
    """Two yearly sine and cosine pairs."""
    w = _c(week)
    out: dict[str, Column] = {}
    for h in (1, 2):
        angle = F.lit(2.0) * F.pi() * F.lit(h) * w / F.lit(SEASON_WEEKS)
        out[f"week_sin_{h}"] = F.sin(angle)
        out[f"week_cos_{h}"] = F.cos(angle)
    return out
