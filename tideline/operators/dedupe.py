"""First write wins: de-duplication, insert-if-absent and the idempotent append."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from tideline.functions.frames import instant
from tideline.schema import EVENT_KEY
from tideline.sources.tables import area, exists, read_telemetry, staged, with_event_date, write_daily

#: Days of a batch whose time ranges are written into the plan.
MOST_DAYS_IN_PLAN = 64


def _order(order_by: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order_by]


def dedupe_events(
    df: DataFrame, keys: Sequence[str] = EVENT_KEY, order_by: Sequence[str] = ("processed_at",)
) -> DataFrame:
    """Keep the first row of every key.

    The rank filter is applied on the map side as well (Spark's window group limit), so a key that
    holds a large share of the input reaches its reducer as one row per map task.
    """
    first = Window.partitionBy(*keys).orderBy(*_order(order_by))
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def label_outcomes(
    df: DataFrame, order_by: Sequence[str], existing: DataFrame | None = None, keys: Sequence[str] = EVENT_KEY, is_unique: bool = False,
) -> DataFrame:
    """Add ``outcome``: ``stored`` for the first row of a key that is not stored yet, else ``duplicate``.

    Of rows of a key that ``order_by`` does not tell apart (as a log position would) one is stored and the others
    are duplicates. ``is_unique`` says that there are none, as with a log position: then nothing needs to be told apart.
    The winner of a key is found by a partial aggregate; the join back is one that AQE may split when a key is hot.
    """
    # A single plain column keeps the aggregate hash-based.
    position = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*[F.col(c) for c in order_by])
    winners = df.groupBy(*keys).agg(F.min(position).alias("_first"))
    if existing is not None:
        known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
        winners = winners.join(known, list(keys), "left")
    else:
        winners = winners.withColumn("_known", F.lit(None).cast("boolean"))
    wins = F.col("_known").isNull() & position.eqNullSafe(F.col("_first"))
    labelled = df.join(winners, list(keys), "left").withColumn("_wins", wins)
    if is_unique:
        return labelled.select(*df.columns, F.when(F.col("_wins"), F.lit("stored")).otherwise(F.lit("duplicate")).alias("outcome"))
    # Rows in front of their key, nearly always one a key: of several that tie, one is stored.
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order_by)))
    front = labelled.filter("_wins").withColumn("outcome", F.when(nth == 1, F.lit("stored")).otherwise(F.lit("duplicate")))
    rest = labelled.filter("NOT _wins").withColumn("outcome", F.lit("duplicate"))
    return front.unionByName(rest).select(*df.columns, "outcome")


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """The new rows whose key is not stored yet."""
    return new.join(existing.select(*keys), list(keys), "left_anti")


class AppendResult(NamedTuple):
    inserted: int
    duplicate: int


def append_events(
    df: DataFrame, path: str, order_by: Sequence[str] = ("processed_at",), which: str = "daily", is_staged: bool = False
) -> AppendResult:
    """Insert-if-absent into the day-partitioned table. Appending the same rows again adds nothing.

    The input is worked out once, into a staging folder; ``is_staged`` says that it is a stored table already. Of
    the stored rows, each touched day gives back the keys between its own first and last new time, so a stray old row
    costs the row groups around its time and not the days up to it.
    """
    if not is_staged:
        with staged(df, "append") as rows:
            return append_events(rows, path, order_by, which, is_staged=True)
    spark, moment = df.sparkSession, F.col("event_timestamp")
    per_day = with_event_date(df).groupBy("event_date").agg(F.count("*").alias("rows"), F.min(moment).alias("low"), F.max(moment).alias("high"))
    with staged(per_day, "append-days") as days:
        total = days.agg(F.sum("rows")).first()[0] or 0
        # As many rows as a plan may hold as constants, and one more; beyond, the days stay a table.
        few = days.filter("low IS NOT NULL").limit(MOST_DAYS_IN_PLAN + 1).collect()
        fresh = dedupe_events(df, order_by=order_by)
        if few and exists(spark, area(path, which)):
            fresh = insert_if_absent(fresh, _near(read_telemetry(spark, path, which), days, few))
        written = Observation()
        write_daily(fresh, path, which, written=written)
        inserted = written.get["rows"]
    return AppendResult(inserted, total - inserted)


def _near(stored: DataFrame, days: DataFrame, few: list[Row]) -> DataFrame:
    """The stored rows of each day of ``days`` between its ``low`` and ``high``.

    Ranges of few days are constants that reach the row groups. Many days (a producer's broken clock) are joined: Spark
    prunes the other days at run time, and the ranges are compared row by row.
    """
    moment = F.col("event_timestamp")
    if len(few) <= MOST_DAYS_IN_PLAN:
        ranges = [(F.col("event_date") == F.lit(r["event_date"])) & moment.between(instant(r["low"]), instant(r["high"])) for r in few]
        return stored.filter(reduce(lambda a, b: a | b, ranges))
    bounds = days.select(F.col("event_date").alias("_day"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    return stored.join(bounds, (F.col("event_date") == F.col("_day")) & moment.between(F.col("_low"), F.col("_high")), "left_semi")
