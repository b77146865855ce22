"""Windows, detections and incidents on a stream."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import micros
from tideline.operators.detect import Rule, detect
from tideline.operators.incidents import incident_id
from tideline.operators.windows import SERVICE, is_error


def _span(length: timedelta) -> str:
    return f"{micros(length)} microseconds"


def stream_windows(events: DataFrame, window: timedelta, step: timedelta, late: timedelta) -> DataFrame:
    """Sliding per-service tallies ``[T - window, T)``; the watermark only concerns detection, not storage.

    Aggregation is partial per task before the state store is reached, so a busy service is combined
    where it is read.
    """
    span = F.window("event_timestamp", _span(window), _span(step))
    tick = F.col("window.end")
    return (
        events.withWatermark("event_timestamp", _span(late))
        .groupBy(span, *SERVICE)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(is_error()).alias("errors"),
            F.count_if(is_error() & (F.col("event_timestamp") >= F.col("window.end") - F.expr(f"INTERVAL '{micros(step) / 1e6:.6f}' SECOND"))).alias("new_errors"),
        )
        .select("window", tick.alias("tick"), F.lit(micros(window)).cast("long").alias("window_us"), *SERVICE, "total", "errors", "new_errors")
    )


def stream_incidents(windows: DataFrame, rules: Sequence[Rule], step: timedelta, resolve_after: timedelta) -> DataFrame:
    """Incidents as sessions of firing windows, emitted when they have gone quiet, for all rules of the registry.

    A rule meets the windows of its own lookback, as in a replay. ``windows`` are those of one lookback
    (``stream_windows``) or of a whole rule set (``panes.rule_windows``).
    Two firings belong together while they are fewer than ``resolve_after // step + 2`` ticks apart. Firings
    lie on ticks, so a session gap half a tick short of that separates exactly those.
    Operator actions need ``stateful_incidents``.
    """
    quiet = micros(resolve_after) // micros(step)
    gap = timedelta(microseconds=(quiet + 1) * micros(step) + micros(step) // 2)
    # window_time is the last instant inside the window: tick - 1 microsecond. It, or the tick itself, carries the watermark.
    moment = F.window_time("window") if "window" in windows.columns else F.col("tick")
    sessions = detect(windows, rules).groupBy(
        F.session_window(moment, _span(gap)).alias("session"), "fingerprint", *SERVICE, "rule_id", "severity"
    ).agg(
        F.min("tick").alias("opened_at"), F.max("tick").alias("last_seen_at"),
        F.min_by("event_count", "tick").alias("_seed"), F.min_by("new_event_count", "tick").alias("_first_new"),
        F.sum("new_event_count").alias("_new"),
    )
    return sessions.select(
        incident_id(F.col("fingerprint"), F.col("opened_at")).alias("id"), "fingerprint", *SERVICE, "rule_id", "severity",
        (F.col("_seed") + F.col("_new") - F.col("_first_new")).alias("event_count"), "opened_at", "last_seen_at",
        F.timestamp_micros(F.unix_micros("last_seen_at") + F.lit((quiet + 1) * micros(step))).alias("resolved_at"),
    )
