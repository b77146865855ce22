"""Long-running incident state per fingerprint, for streams that also carry operator actions.

The state of a fingerprint is a value (its open incident) and a map (actions that run ahead, by time); timers wake it
when one of them is due or the incident has been quiet for long enough. What a trigger does not touch is not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.functions.frames import from_us
from tideline.functions.text import micros
from tideline.operators.incidents import incident_id

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
INCIDENT = "opened long, last long, count long, acked boolean, details string"
WAITING_KEY, WAITING = "at_us long, phase int, action_id string", "what string"
CHANGES = (
    "fingerprint string, change string, at_us long, opened_us long, last_us long, event_count long, action_id string, details string"
)
CHANGE_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]


def _arrivals(detections: DataFrame, actions: DataFrame | None, late: timedelta) -> DataFrame:
    """Both streams in one shape: what happened to a fingerprint, at which tick and in which order."""
    none, delay = F.lit(None), f"{micros(late)} microseconds"
    fired = detections.select(
        "fingerprint", F.unix_micros("tick").alias("at_us"), F.col("tick").alias("seen_at"), F.lit(2).alias("phase"),
        F.lit("detection").alias("what"), "event_count", "new_event_count", none.cast("string").alias("action_id"), "details",
    ).withWatermark("seen_at", delay)
    if actions is None:
        return fired
    # An action takes effect before the tick it is stamped on or before.
    asked = actions.select(
        F.col("target").alias("fingerprint"), F.unix_micros("at").alias("at_us"), F.col("at").alias("seen_at"),
        F.when(F.col("action") == "acknowledge", F.lit(0)).otherwise(F.lit(1)).alias("phase"), F.col("action").alias("what"),
        none.cast("long").alias("event_count"), none.cast("long").alias("new_event_count"), "action_id",
        none.cast("string").alias("details"),
    ).withWatermark("seen_at", delay)
    return fired.unionByName(asked)


class IncidentState(StatefulProcessor):
    """Arrivals of one fingerprint in order of time; an action counts once a detection or the watermark has reached it."""

    def __init__(self, quiet_us: int) -> None:
        self.quiet_us = quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.incident = handle.getValueState("incident", INCIDENT)
        self.waiting = handle.getMapState("waiting", f"{WAITING_KEY}", WAITING)
        # Time of the earliest waiting action, so that the map is walked only when one is due.
        self.due = handle.getValueState("due", "at_us long")

    def _load(self, key: tuple) -> None:
        self.key, self.out = key[0], []
        self.now = tuple(self.incident.get()) if self.incident.exists() else None
        self.next_us = self.due.get()[0] if self.due.exists() else None

    def _note(self, change: str, at: int, action_id: str | None = None) -> None:
        opened, last, count, _, details = self.now or (None,) * 5
        self.out.append((self.key, change, at, opened, last, count, action_id, details))

    def _close_if_quiet(self, now: int, reached: bool) -> None:
        """An action at the closing tick still comes first; a later arrival finds the incident closed."""
        if self.now is not None:
            due = self.now[1] + self.quiet_us
            if now >= due if reached else now > due:
                self._note("auto_resolved", due)
                self.now = None

    def _act(self, at: int, action_id: str, what: str) -> None:
        self._close_if_quiet(at, reached=False)
        if self.now is None or (what == "acknowledge" and self.now[3]):
            self._note("rejected", at, action_id)
        elif what == "acknowledge":
            self.now = (*self.now[:3], True, self.now[4])
            self._note("acknowledged", at, action_id)
        else:
            self._note("resolved", at, action_id)
            self.now = None

    def _act_until(self, now: int) -> None:
        if self.next_us is None or self.next_us > now:
            return
        held = sorted((k, v[0]) for k, v in self.waiting.iterator())
        for (at, phase, action_id), what in held:
            if at > now:
                self.next_us = at
                return
            self._act(at, action_id, what)
            self.waiting.removeKey((at, phase, action_id))
        self.next_us = None

    def _fire(self, at: int, errors: int, new: int, details: str | None) -> None:
        self._act_until(at)
        self._close_if_quiet(at, reached=False)
        if self.now is None:
            self.now = (at, at, errors, False, details)
            self._note("opened", at)
        else:
            opened, last, count, acked, kept = self.now
            self.now = (opened, max(last, at), count + new, acked, kept)
            self._note("grouped", at)

    def _settle(self, watermark_us: int) -> pd.DataFrame:
        """What lies behind the watermark meets no detection any more. Keeps the rest, and a timer for the next of it."""
        self._act_until(watermark_us)
        self._close_if_quiet(watermark_us, reached=True)
        if self.now is None:
            self.incident.clear()
        else:
            self.incident.update(self.now)
        if self.next_us is None:
            self.due.clear()
        else:
            self.due.update((self.next_us,))
        wake = min([t for t in (self.next_us, None if self.now is None else self.now[1] + self.quiet_us) if t is not None], default=None)
        if wake is not None:
            # Rounded up, and not before the watermark itself: a late detection may leave an incident due at once.
            self.handle.registerTimer(max(-(-wake // 1000), watermark_us // 1000 + 1))
        return pd.DataFrame(self.out, columns=CHANGE_COLUMNS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load(key)
        arrived = pd.concat(list(rows)).sort_values(["at_us", "phase", "action_id"], kind="stable")
        fired = arrived["what"] == "detection"
        for row in arrived[~fired].itertuples(index=False):
            self.waiting.updateValue((int(row.at_us), int(row.phase), row.action_id), (row.what,))
            self.next_us = int(row.at_us) if self.next_us is None else min(self.next_us, int(row.at_us))
        for row in arrived[fired].itertuples(index=False):
            self._fire(int(row.at_us), int(row.event_count), int(row.new_event_count), row.details)
        yield self._settle(int(timerValues.getCurrentWatermarkInMs()) * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load(key)
        yield self._settle(int(timerValues.getCurrentWatermarkInMs()) * 1000)

    def close(self) -> None:
        pass


def stateful_incidents(
    detections: DataFrame, step: timedelta, resolve_after: timedelta, late: timedelta, actions: DataFrame | None = None,
) -> DataFrame:
    """A changelog of incidents: opened, grouped, acknowledged, resolved, auto_resolved, rejected.

    Arrivals are detections (at most one per fingerprint and tick) and operator actions, never raw events; an action id
    names one action. An action that runs ahead waits in the state until a later detection or the watermark reaches its
    time, so triggers may cut the streams anywhere. A quiet incident is resolved when the watermark passes the tick that
    would have noticed.

    Each stream has a watermark of its own, ``late`` behind its newest row, and the slower one rules (Spark's default
    policy): actions that run ahead never make detections late. So an action stream that falls silent holds timers
    back; give it a heartbeat (any action on a target nobody has) where quiet hours are long. The state needs the RocksDB
    provider (``STATE_STORE``).
    """
    step_us = micros(step)
    quiet_us = (micros(resolve_after) // step_us + 1) * step_us
    changes = _arrivals(detections, actions, late).groupBy("fingerprint").transformWithStateInPandas(
        IncidentState(quiet_us), CHANGES, "Append", "EventTime"
    )
    opened_at = from_us(F.col("opened_us"))
    return changes.select(
        F.when(F.col("opened_us").isNotNull(), incident_id(F.col("fingerprint"), opened_at)).alias("id"), "fingerprint", "change",
        from_us(F.col("at_us")).alias("at"), opened_at.alias("opened_at"), from_us(F.col("last_us")).alias("last_seen_at"),
        "event_count", "action_id", "details",
    )


def open_incidents(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Incidents that are open in the state of a changelog query, read from its checkpoint: ``fingerprint, opened_at, ...``."""
    state = spark.read.format("statestore").option("stateVarName", "incident").load(checkpoint)
    return state.select(
        F.col("key.fingerprint").alias("fingerprint"), from_us(F.col("value.opened")).alias("opened_at"), from_us(F.col("value.last")).alias("last_seen_at"),
        F.col("value.count").alias("event_count"), F.col("value.acked").alias("acknowledged"), F.col("value.details").alias("details"),
    )


def waiting_actions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Actions that still wait for their time in the state of a changelog query: ``fingerprint, at, action_id, action``."""
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    return state.select(
        F.col("key.fingerprint").alias("fingerprint"), from_us(F.col("user_map_key.at_us")).alias("at"),
        F.col("user_map_key.action_id").alias("action_id"), F.col("user_map_value.what").alias("action"),
    )
