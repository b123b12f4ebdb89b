"""Ranks, running sums and list ranks of distributed rows; no key's rows ever have to meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import partitions, stored

#: Rows of a chunk of a running sum, and of a list that one task ranks.
CHUNK, SMALL = 4096, 16_384
#: One arc in this many begins a stretch of a list.
STRETCH = 32
_ROW = (1 << 33) - 1


def sorted_rows(df: DataFrame, order: list, name: str, range_by: list | None = None, keep: list | None = None) -> DataFrame:
    """``keep`` of the rows, stored in ranges of ``order``, with ``_part`` and ``_at``, the place in the range.

    ``range_by`` may be a coarser order that ``order`` refines.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *(range_by or order)).sortWithinPartitions(*order)
    rows = stored(dealt.select(*(keep or df.columns), F.monotonically_increasing_id().alias("_id")), name)
    return rows.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(_ROW)}).drop("_id")


def numbered(df: DataFrame, order: list, name: str, number: str) -> DataFrame:
    """Rows with their number in the whole order, from 0, without a gap."""
    rows = sorted_rows(df, order, name)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row a range: as many as there are partitions.
    return rows.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + F.col("_at")).alias(number))


def ranked(
    df: DataFrame, key: str, order: list, name: str, rank: str, size: str, range_by: list | None = None, keep: list | None = None
) -> DataFrame:
    """``keep`` of the rows with their rank within ``key``, from 1, and the number of rows of the key."""
    rows = sorted_rows(df, [F.col(key), *order], name, [F.col(key), *(range_by or order)], keep)
    spans = rows.groupBy(key, "_part").agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    spans = spans.select(
        key, "_part", "_lo", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(size)
    )
    place = F.col("_before") + F.col("_at") - F.col("_lo") + 1
    return rows.join(spans, [key, "_part"]).select(*[c for c in rows.columns if c not in ("_part", "_at")], place.alias(rank), size)


def running_sums(df: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Each of ``values`` becomes its sum up to the row, in the order of ``at`` (whole numbers without a gap) within ``keys``.

    Rows are added within chunks, the chunks' totals alike one level up, so a task holds ``CHUNK`` rows.
    """
    chunk = f"_{at}_chunk"
    rows = df.withColumn(chunk, F.expr(f"{at} div {CHUNK}"))
    inside = Window.partitionBy(*keys, chunk).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(*[F.sum(c).over(inside).alias(c) if c in values else F.col(c) for c in rows.columns])
    totals = rows.groupBy(*keys, chunk).agg(*[F.sum(c).alias(c) for c in values])
    if keys:
        up = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        above = totals.select(*keys, chunk, *[F.sum(c).over(up).alias(f"_above_{c}") for c in values])
    else:
        totals = stored(totals, "chunk-totals")
        if totals.count() > CHUNK:
            sums = running_sums(totals, [], chunk, values)
            above = sums.select((F.col(chunk) + 1).alias(chunk), *[F.col(c).alias(f"_above_{c}") for c in values])
        else:
            up = Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
            above = totals.select(chunk, *[F.sum(c).over(up).alias(f"_above_{c}") for c in values])
    joined = local.join(above, [*keys, chunk], "left")
    added = [(F.col(c) + F.coalesce(f"_above_{c}", F.lit(0))).alias(c) if c in values else F.col(c) for c in df.columns]
    return joined.select(*added)


def _walk(rows):
    """Positions in a list of at most ``SMALL`` stretches that begins at arc 0 and ends at -1."""
    import pandas as pd

    onward = dict(zip(rows["arc"].tolist(), zip(rows["to"].tolist(), rows["dist"].tolist(), strict=True), strict=True))
    at, place, found = 0, 0, []
    while at in onward:
        found.append((at, place))
        at, dist = onward[at]
        place += dist
    return pd.DataFrame(found, columns=["arc", "position"], dtype="int64")


def list_rank(arcs: DataFrame, level: int = 0) -> DataFrame:
    """(arc, position) of every arc of one linked list: arc, to (-1 at the end), dist (steps to it); arc 0 is first.

    One arc in ``STRETCH``, drawn by a hash of its own at each level, and arc 0 begin stretches. Every arc doubles
    its pointer until that meets a stretch, then the stretches alone are a list ``STRETCH`` times shorter, ranked in the
    same way; arcs place themselves by the stretch that they point to. A list of up to ``SMALL`` is walked in one task.
    """
    count, total = arcs.agg(F.count(F.lit(1)), F.sum("dist")).first()
    if count <= SMALL:
        return arcs.groupBy(F.lit(0).alias("_")).applyInPandas(_walk, "arc long, position long")
    begins = lambda c: (F.col(c) <= 0) | (F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(STRETCH)) == 0)
    state = stored(arcs.select("arc", "to", "dist", begins("to").alias("met")), "pointers")
    while not state.where("NOT met").isEmpty():
        ahead = state.select(F.col("arc").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("met").alias("_met"))
        moved = state.where("NOT met").join(ahead, "to").select(
            "arc", F.col("_to").alias("to"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_met").alias("met")
        )
        state = stored(state.where("met").unionByName(moved), "pointers")
    places = stored(list_rank(state.where(begins("arc")).select("arc", "to", "dist"), level + 1), "stretch-places")
    inner = state.where("to >= 0").join(places.select(F.col("arc").alias("to"), "position"), "to")
    last = state.where("to < 0").select("arc", (F.lit(total) - F.col("dist")).alias("position"))
    return inner.select("arc", (F.col("position") - F.col("dist")).alias("position")).unionByName(last)
