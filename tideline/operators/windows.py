"""Per-service event tallies: one window, or every tick of a replay."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import epoch_us, from_us, instant, within_dates
from tideline.functions.text import ceil_div, floor_div, micros
from tideline.schema import ERROR_SEVERITIES

SERVICE = ("tenant_id", "service_name")

#: Up to so many ticks a lookback's counts are spread over them; beyond, they are rises and falls.
FEW_TICKS = 8
#: Ticks whose changes are summed at a time.
BLOCK_TICKS = 4096


def is_error() -> Column:
    return F.col("severity").isin(*ERROR_SEVERITIES)


def window_stats(df: DataFrame, since: datetime, count_since: datetime) -> DataFrame:
    """Per tenant and service over ``[since, ...)``: total, errors and errors since ``count_since``."""
    recent = within_dates(df, since=since).filter(F.col("event_timestamp") >= instant(since))
    return recent.groupBy(*SERVICE).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_error()).alias("errors"),
        F.count_if(is_error() & (F.col("event_timestamp") >= instant(count_since))).alias("new_errors"),
    )


def replay_windows(
    df: DataFrame, window: timedelta | Sequence[timedelta], step: timedelta, mode: str = "inclusive",
    start: datetime | None = None, until: datetime | None = None,
) -> DataFrame:
    """``window_stats`` of every tick of a fixed cadence, from one pass over the events.

    Several lookbacks share the pass: each row meets every one of them before it is counted, and ``window_us`` tells
    the tallies apart.

    ``inclusive`` replays the evaluator: tick T sees the rows processed by T whose time is at or after
    ``T - window``; an error is new when it is at or after the previous tick, so one stamped exactly on a
    tick counts twice. ``half_open`` is the event-time form ``[T - window, T)`` that a stream computes,
    where each error is new once. At the first tick ``start`` the whole window is new. Ticks after
    ``until`` are not evaluated.

    An event is visible to a run of consecutive ticks. Events are first counted per service and run (combined on the
    map side), without regard to lookbacks; only those counts meet the lookbacks. Where a lookback covers few ticks the
    counts are spread over them; beyond ``FEW_TICKS``, a run is a rise at its first tick and a fall after its last one,
    and running sums of these give the tallies, so the work does not depend on how many ticks a lookback covers.
    """
    d = micros(step)
    lookbacks = sorted({micros(w) for w in ([window] if isinstance(window, timedelta) else window)})
    if not lookbacks or lookbacks[0] <= 0 or d <= 0:
        raise ValueError("windows and step must be positive")
    if mode not in ("inclusive", "half_open"):
        raise ValueError(f"unknown mode {mode!r}")
    begin = None if start is None else -(-epoch_us(start) // d)
    end = None if until is None else epoch_us(until) // d
    runs = _runs(df, lookbacks, d, mode, begin, end)
    ticks = _spread(runs, begin) if lookbacks[-1] <= FEW_TICKS * d else _running(runs, begin)
    return ticks.select(from_us(F.col("_tick") * F.lit(d)).alias("tick"), F.col("_w").alias("window_us"), *SERVICE, "total", "errors", "new_errors")


def _runs(df: DataFrame, lookbacks: Sequence[int], d: int, mode: str, begin: int | None, end: int | None) -> DataFrame:
    """``_w, tenant_id, service_name, _first, _last, _last_new, _total, _errors``: ticks that see so many events of a lookback."""
    ts, seen = F.unix_micros("event_timestamp"), F.unix_micros("processed_at")
    slot = floor_div(ts, d)
    first = ceil_div(seen, d) if mode == "inclusive" else slot + 1
    # A lookback that is no multiple of the step ends a tick later for events late enough in their slot.
    rests = {w % d: f"_later{k}" for k, w in enumerate(lookbacks) if w % d}
    later = [(ts - slot * F.lit(d) + F.lit(r) >= F.lit(d)).cast("int").alias(name) for r, name in rests.items()]
    counts = df.select(*SERVICE, is_error().alias("_error"), first.alias("_first"), slot.alias("_slot"), *later).groupBy(
        *SERVICE, "_first", "_slot", *rests.values()
    ).agg(F.count(F.lit(1)).alias("_total"), F.count_if("_error").alias("_errors"))
    each = F.array(*(
        F.struct(F.lit(w).cast("long").alias("w"), (F.col("_slot") + F.lit(w // d) + (F.col(rests[w % d]) if w % d else F.lit(0))).alias("last"))
        for w in lookbacks
    ))
    met = counts.withColumn("_each", F.explode(each))
    low = F.col("_first") if begin is None else F.greatest("_first", F.lit(begin))
    high = F.col("_each.last") if end is None else F.least("_each.last", F.lit(end))
    runs = met.select(F.col("_each.w").alias("_w"), *SERVICE, low.alias("_first"), high.alias("_last"), F.least(high, F.col("_slot") + 1).alias("_last_new"), "_total", "_errors")
    # sequence() counts down when its bounds are reversed: an unseen event has no ticks.
    return runs.filter("_first <= _last")


def _spread(runs: DataFrame, begin: int | None) -> DataFrame:
    """Every run at each of its ticks, added up."""
    ticks = runs.select("_w", *SERVICE, "_total", "_errors", "_last_new", F.explode(F.sequence("_first", "_last")).alias("_tick"))
    fresh = F.col("_tick") <= F.col("_last_new")
    if begin is not None:
        fresh = fresh | (F.col("_tick") == F.lit(begin))
    return ticks.groupBy("_w", "_tick", *SERVICE).agg(
        F.sum("_total").alias("total"), F.sum("_errors").alias("errors"), F.sum(F.when(fresh, F.col("_errors")).otherwise(F.lit(0))).alias("new_errors")
    )


def _running(runs: DataFrame, begin: int | None) -> DataFrame:
    """Rises and falls per tick, summed in blocks of ticks first and then block by block; between two changes tallies stay.

    A service has as many changes as ticks at most, however busy it is, and a task orders those of a block.
    """
    none = F.lit(0).cast("long")
    change = F.explode(F.array(
        F.struct(F.col("_first").alias("tick"), F.col("_total").alias("t"), F.col("_errors").alias("e"), F.when(F.col("_first") <= F.col("_last_new"), F.col("_errors")).otherwise(none).alias("n")),
        F.struct((F.col("_last") + 1).alias("tick"), (-F.col("_total")).alias("t"), (-F.col("_errors")).alias("e"), none.alias("n")),
        F.struct((F.col("_last_new") + 1).alias("tick"), none.alias("t"), none.alias("e"), F.when(F.col("_first") <= F.col("_last_new"), -F.col("_errors")).otherwise(none).alias("n")),
    ))
    keys = ("_w", *SERVICE)
    moved = runs.select(*keys, change.alias("c")).select(*keys, "c.*").groupBy(*keys, "tick").agg(*(F.sum(c).alias(c) for c in ("t", "e", "n")))
    moved = moved.withColumn("block", floor_div(F.col("tick"), BLOCK_TICKS))
    blocks = moved.groupBy(*keys, "block").agg(*(F.sum(c).alias(f"{c}_in") for c in ("t", "e", "n")), F.min("tick").alias("opens"))
    in_turn = Window.partitionBy(*keys).orderBy("block")
    before = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys, "block", *(F.coalesce(F.sum(f"{c}_in").over(before), none).alias(f"{c}_before") for c in ("t", "e", "n")), F.lead("opens").over(in_turn).alias("after")
    )
    inside = Window.partitionBy(*keys, "block").orderBy("tick")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = moved.join(blocks, [*keys, "block"]).select(
        *keys, "tick", F.coalesce(F.lead("tick").over(inside), F.col("after")).alias("next"),
        *((F.sum(c).over(so_far) + F.col(f"{c}_before")).alias(name) for c, name in (("t", "total"), ("e", "errors"), ("n", "new_errors"))),
    )
    # After its last change a service has no events in sight.
    ticks = levels.filter("total > 0").select(*keys, "total", "errors", "new_errors", F.explode(F.sequence("tick", F.col("next") - 1)).alias("_tick"))
    new = F.col("new_errors") if begin is None else F.when(F.col("_tick") == F.lit(begin), F.col("errors")).otherwise(F.col("new_errors"))
    return ticks.select("_w", "_tick", *SERVICE, "total", "errors", new.alias("new_errors"))
