"""One stream for a whole rule set: events are counted once into panes, lookbacks are running sums of panes.

A pane is as long as the greatest common divisor of the step and all lookbacks, so every window of every lookback is a
run of whole panes. Spark's own window aggregate counts events into panes, with partial sums in each task, and lets a
pane go once the watermark has passed its end. A keyed state holds the panes that some lookback still covers. From one
tick to the next, each lookback adds the panes that came in and takes off those that went out: work per tick does not
depend on how many panes a lookback covers, and raw events meet neither the lookbacks nor Python.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from math import gcd

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.functions.text import micros
from tideline.operators.detect import RULES, Rule, detect
from tideline.operators.windows import SERVICE, is_error
from tideline.streaming.stateful import STATE_STORE

__all__ = ["STATE_STORE", "pane_counts", "rule_detections", "rule_windows"]

TALLIES = "tick timestamp, window_us long, tenant_id string, service_name string, total long, errors long, new_errors long"
TALLY = Row(*(c.split()[0] for c in TALLIES.split(", ")))
HELD = "told long, totals array<long>, errors array<long>, panes array<long>, pane_totals array<long>, pane_errors array<long>"


def pane_length(step: timedelta, lookbacks: Sequence[timedelta]) -> int:
    """Microseconds of the longest pane that divides the step and every lookback."""
    if not lookbacks or min(micros(w) for w in lookbacks) <= 0 or micros(step) <= 0:
        raise ValueError("windows and step must be positive")
    return gcd(micros(step), *(micros(w) for w in lookbacks))


def pane_counts(events: DataFrame, pane_us: int, late: timedelta) -> DataFrame:
    """``window, pane, tenant_id, service_name, total, errors`` of each pane that the watermark has closed."""
    return (
        events.withWatermark("event_timestamp", f"{micros(late)} microseconds")
        .groupBy(F.window("event_timestamp", f"{pane_us} microseconds"), *SERVICE)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(is_error()).alias("errors"))
        .select("window", F.call_function("div", F.unix_micros("window.start"), F.lit(pane_us).cast("long")).alias("pane"), *SERVICE, "total", "errors")
    )


class Lookbacks(StatefulProcessor):
    """Running sums per lookback over the panes of one service.

    The whole state of a service is one value, read and written once a trigger: a call to the state store costs more
    than the sums of many ticks. It holds the panes of the longest lookback, and those that are not told yet.
    """

    def __init__(self, step_us: int, pane_us: int, lookbacks_us: Sequence[int]) -> None:
        self.step_us, self.lookbacks_us = step_us, list(lookbacks_us)
        self.per_step = step_us // pane_us
        self.lengths = [w // pane_us for w in lookbacks_us]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The last tick that was told (null: none since the sums were empty), the sums of each lookback at it, the panes in order.
        self.held = handle.getValueState("held", HELD)

    def _wake(self, tick: int) -> None:
        self.handle.registerTimer(-(-tick * self.step_us // 1000))

    def _first_tick(self, pane: int) -> int:
        """The first tick whose windows hold a pane."""
        return pane // self.per_step + 1

    def _load(self) -> tuple[int | None, list[int], list[int], dict[int, tuple[int, int]]]:
        held = self.held.get()
        if held is None:
            return None, [], [], {}
        told, totals, errors, panes, pane_totals, pane_errors = held
        return told, list(totals), list(errors), dict(zip(panes, zip(pane_totals, pane_errors, strict=True), strict=True))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Closed panes come in; ticks that the watermark has reached are told at once."""
        told, totals, errors, panes = self._load()
        for row in rows:
            panes[row.pane] = (row.total, row.errors)
        return self._tell(key, timerValues, told, totals, errors, panes)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Ticks without a new pane."""
        told, totals, errors, panes = self._load()
        if not panes or (told is not None and told >= self._ready(timerValues)):
            # Told already, when panes came in.
            return iter(())
        return self._tell(key, timerValues, told, totals, errors, panes)

    def _ready(self, timerValues) -> int:
        return int(timerValues.getCurrentWatermarkInMs()) * 1000 // self.step_us

    def _tell(
        self, key: tuple, timerValues, told: int | None, totals: list[int], errors: list[int], panes: dict[int, tuple[int, int]]
    ) -> Iterator[Row]:
        """All ticks up to the watermark: their panes are complete."""
        waiting = sorted(panes)
        if told is None:
            told, totals, errors = self._first_tick(waiting[0]) - 1, [0] * len(self.lengths), [0] * len(self.lengths)
        out, ready = [], self._ready(timerValues)
        while told < ready:
            if not any(totals):
                ahead = bisect_left(waiting, told * self.per_step)
                if ahead == len(waiting):
                    break
                told = max(told, self._first_tick(waiting[ahead]) - 1)
                if told >= ready:
                    break
            told += 1
            end, before = told * self.per_step, (told - 1) * self.per_step
            fresh = [panes[p] for p in range(before, end) if p in panes]
            for k, length in enumerate(self.lengths):
                gone = [panes[p] for p in range(before - length, end - length) if p in panes]
                totals[k] += sum(t for t, _ in fresh) - sum(t for t, _ in gone)
                errors[k] += sum(e for _, e in fresh) - sum(e for _, e in gone)
            new = sum(e for _, e in fresh)
            if self.per_step > min(self.lengths):
                # A lookback shorter than the step never meets the older panes of the step.
                self._short(panes, before, end, totals, errors)
            at = datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=told * self.step_us)
            out += [TALLY(at, w, *key, totals[k], errors[k], min(new, errors[k])) for k, w in enumerate(self.lookbacks_us) if totals[k]]
        # Panes that no later tick takes off its sums are let go: all that were told, once the sums are empty.
        left = waiting[bisect_left(waiting, told * self.per_step - (max(self.lengths) if any(totals) else 0)):]
        if any(totals):
            self._wake(told + 1)
        elif left:
            self._wake(self._first_tick(left[0]))
            told = None
        if left:
            self.held.update((told, totals, errors, left, [panes[p][0] for p in left], [panes[p][1] for p in left]))
        else:
            self.held.clear()
        return iter(out)

    def _short(self, panes: dict, before: int, end: int, totals: list[int], errors: list[int]) -> None:
        for k, length in enumerate(self.lengths):
            if length < self.per_step:
                held = [panes[p] for p in range(end - length, end) if p in panes]
                totals[k], errors[k] = sum(t for t, _ in held), sum(e for _, e in held)

    def close(self) -> None:
        pass


def rule_windows(events: DataFrame, lookbacks: Sequence[timedelta], step: timedelta, late: timedelta) -> DataFrame:
    """Tallies ``[T - lookback, T)`` of every tick and lookback with an event in it, from one stream.

    The same rows as ``replay_windows`` in its ``half_open`` form, each once, when the watermark has passed the tick.
    ``tick`` carries the watermark on. Events later than ``late`` behind the newest one miss the panes that were closed.
    The state needs the RocksDB provider (``STATE_STORE``).
    """
    wanted = sorted(set(lookbacks))
    pane_us = pane_length(step, wanted)
    processor = Lookbacks(micros(step), pane_us, [micros(w) for w in wanted])
    counts = pane_counts(events, pane_us, late)
    # One instant carries the watermark with less to hand over than a window; it is the same to the millisecond, as watermarks are.
    if pane_us % 1000 == 0:
        counts = counts.withColumn("window", F.window_time("window"))
    return counts.groupBy(*SERVICE).transformWithState(
        processor, TALLIES, "Append", "EventTime", eventTimeColumnName="tick"
    )


def rule_detections(events: DataFrame, rules: Sequence[Rule], step: timedelta, late: timedelta) -> DataFrame:
    """What a rule set of any lookbacks finds on a stream, in one query; each event is counted once for all rules."""
    lookbacks = {r.window for r in rules if r.kind in RULES}
    if not lookbacks:
        raise ValueError("no rule of a known kind")
    return detect(rule_windows(events, sorted(lookbacks), step, late), rules)
