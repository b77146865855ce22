"""Incidents from detections: grouping, auto-resolve, operator actions, lifecycle rules."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import epoch_us, from_us, instant
from tideline.functions.text import ceil_div, floor_div, is_blank, micros, rfc3339, uuid5
from tideline.schema import (
    FINGERPRINT_SEPARATOR,
    INCIDENT_NAMESPACE,
    INCIDENT_STATUSES,
    SEVERITIES,
)

# Detections are merged inside blocks of this many ticks first, then block by block: no task ever
# orders more than a block, or the merged runs, of one fingerprint.
BLOCK_TICKS = 4096
EVIDENCE = ("rule_id", "tenant_id", "service_name", "title", "severity", "details", "event_count")


def incident_id(fingerprint: Column, opened_at: Column) -> Column:
    """A stable id: the same detection log always yields the same incidents."""
    return uuid5(INCIDENT_NAMESPACE, F.concat(fingerprint, F.lit(FINGERPRINT_SEPARATOR), rfc3339(opened_at)))


def _firings(detections: DataFrame, step_us: int) -> DataFrame:
    tick = floor_div(F.unix_micros("tick"), step_us)
    return detections.select(
        "fingerprint", tick.alias("slot"), F.lit(1).alias("phase"), tick.alias("begin"), tick.alias("end"),
        F.col("new_event_count").alias("seed"), F.col("new_event_count").alias("added"),
        F.struct(*EVIDENCE).alias("evidence"),
        F.lit(None).cast("long").alias("resolve_us"), F.lit(None).cast("long").alias("ack_us"),
    )


def _interventions(actions: DataFrame, step_us: int, like: DataFrame) -> DataFrame:
    """Acknowledge / resolve by fingerprint, reduced to the first of each kind between two ticks.

    Nothing else changes state between ticks, so a later one in the same gap can never be accepted.
    """
    at = F.unix_micros("at")
    lifecycle = actions.filter(F.col("action").isin("acknowledge", "resolve"))
    return lifecycle.groupBy(F.col("target").alias("fingerprint"), ceil_div(at, step_us).alias("slot")).agg(
        F.min(F.when(F.col("action") == "resolve", at)).alias("resolve_us"),
        F.min(F.when(F.col("action") == "acknowledge", at)).alias("ack_us"),
    ).select(
        "fingerprint", "slot", F.lit(0).alias("phase"),
        *[F.lit(None).cast(like.schema[c].dataType).alias(c) for c in ("begin", "end", "seed", "added", "evidence")],
        "resolve_us", "ack_us",
    )


def _merge_runs(units: DataFrame, keys: Sequence[str], quiet_ticks: int, step_us: int) -> DataFrame:
    """Merge units (single firings, or runs of them) that belong to one incident.

    A unit opens a new run when the gap to the previous firing is long enough for auto-resolve to
    have acted, or when somebody resolved in between. Works on any granularity, so it can be applied
    per block and then across blocks.
    """
    ordered = Window.partitionBy(*keys).orderBy("slot", "phase")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = units.select(
        "*",
        F.max("end").over(before).alias("_previous"),
        F.max("resolve_us").over(before).alias("_resolved"),
    )
    opens = F.col("begin").isNotNull() & (
        F.col("_previous").isNull()
        | (F.col("begin") - F.col("_previous") >= quiet_ticks)
        | (F.col("_resolved") > F.col("_previous") * F.lit(step_us))
    )
    numbered = seen.withColumn("run", F.sum(F.coalesce(opens.cast("int"), F.lit(0))).over(upto))
    return numbered.groupBy(*keys, "run").agg(
        F.min("slot").alias("slot"),
        F.max("phase").alias("phase"),
        F.min("begin").alias("begin"),
        F.max("end").alias("end"),
        F.min_by("seed", "begin").alias("seed"),
        F.sum("added").alias("added"),
        F.min_by("evidence", "begin").alias("evidence"),
        F.min("resolve_us").alias("resolve_us"),
        F.min("ack_us").alias("ack_us"),
    )


def incidents_from_detections(
    detections: DataFrame, step: timedelta, resolve_after: timedelta, horizon: datetime,
    actions: DataFrame | None = None, block_ticks: int = BLOCK_TICKS,
) -> DataFrame:
    """The incident table a detection log leaves behind at ``horizon``.

    The first firing tick opens with all its errors; later ones add their new errors. An incident
    that stayed quiet for longer than ``resolve_after`` is resolved at the first tick that notices.
    ``actions`` are acknowledge / resolve requests for the current incident of a fingerprint
    (``target``); one stamped exactly on a tick takes effect before that tick.
    """
    step_us = micros(step)
    quiet = micros(resolve_after) // step_us
    units = _firings(detections.filter(F.col("tick") <= instant(horizon)), step_us)
    if actions is not None:
        units = units.unionByName(_interventions(actions.filter(F.col("at") <= instant(horizon)), step_us, units))
    # A firing exactly on a block edge and the actions before it share the block: both use the tick.
    blocks = units.withColumn("block", floor_div(F.col("slot"), block_ticks))
    by_block = _merge_runs(blocks, ("fingerprint", "block"), quiet + 2, step_us).drop("block", "run")
    runs = _merge_runs(by_block, ("fingerprint",), quiet + 2, step_us).filter("run > 0")

    horizon_us = epoch_us(horizon)
    last_us = F.col("end") * F.lit(step_us)
    auto_us = last_us + F.lit((quiet + 1) * step_us)
    by_hand = F.col("resolve_us") <= auto_us
    resolved_us = F.when(by_hand, F.col("resolve_us")).when(auto_us <= horizon_us, auto_us)
    shaped = runs.select(
        "fingerprint", "evidence", from_us(F.col("begin") * F.lit(step_us)).alias("opened_at"),
        from_us(last_us).alias("last_seen_at"), resolved_us.alias("_resolved_us"),
        F.when(resolved_us.isNotNull(), ~F.coalesce(by_hand, F.lit(False))).alias("auto_resolved"),
        (F.col("evidence.event_count") + F.col("added") - F.col("seed")).alias("event_count"),
        F.when(F.col("ack_us") <= F.coalesce(resolved_us, F.lit(horizon_us)), F.col("ack_us")).alias("_ack_us"),
    )
    status = (
        F.when(F.col("_resolved_us").isNotNull(), F.lit("resolved"))
        .when(F.col("_ack_us").isNotNull(), F.lit("acknowledged")).otherwise(F.lit("open"))
    )
    return shaped.select(
        incident_id(F.col("fingerprint"), F.col("opened_at")).alias("id"), "fingerprint",
        *[F.col(f"evidence.{c}").alias(c) for c in ("tenant_id", "service_name", "rule_id", "title", "severity")],
        status.alias("status"), "event_count", F.col("opened_at").alias("first_seen_at"), "last_seen_at", "opened_at",
        from_us(F.col("_ack_us")).alias("acknowledged_at"), from_us(F.col("_resolved_us")).alias("resolved_at"),
        "auto_resolved",
        F.greatest(F.col("last_seen_at"), from_us(F.col("_ack_us")), from_us(F.col("_resolved_us"))).alias("updated_at"),
        F.col("evidence.details").alias("details"),
    )


def cycle_metrics(detections: DataFrame, incidents: DataFrame) -> DataFrame:
    """Opened, grouped and auto-resolved incidents per tick."""
    fired = detections.groupBy("tick").agg(F.count(F.lit(1)).alias("fired"))
    opened = incidents.groupBy(F.col("opened_at").alias("tick")).agg(F.count(F.lit(1)).alias("opened"))
    resolved = incidents.filter("auto_resolved").groupBy(F.col("resolved_at").alias("tick")).agg(
        F.count(F.lit(1)).alias("resolved")
    )
    none = F.lit(0).cast("long")
    everything = (
        fired.select("tick", "fired", none.alias("opened"), none.alias("resolved"))
        .unionByName(opened.select("tick", none.alias("fired"), "opened", none.alias("resolved")))
        .unionByName(resolved.select("tick", none.alias("fired"), none.alias("opened"), "resolved"))
    )
    return everything.groupBy("tick").agg(
        F.sum("opened").alias("opened"), (F.sum("fired") - F.sum("opened")).alias("grouped"),
        F.sum("resolved").alias("resolved"),
    )


def can_transition(source: Column, target: Column) -> Column:
    """Whether the lifecycle allows this step."""
    return F.coalesce(
        ((source == "open") & target.isin("acknowledged", "resolved"))
        | ((source == "acknowledged") & (target == "resolved")),
        F.lit(False),
    )


def apply_actions(incidents: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold an operator log over stored incidents: accepted transitions, and refused actions with a reason.

    ``actions`` name an incident id and carry a unique ``action_id``. Per incident the first resolve is
    accepted, and the first acknowledge before it while the incident was open; all else is refused.
    """
    place = F.struct("at", "action", "action_id")
    firsts = actions.groupBy(F.col("target").alias("_id")).agg(
        F.min(F.when(F.col("action") == "resolve", place)).alias("_resolve"),
        F.min(F.when(F.col("action") == "acknowledge", place)).alias("_ack"),
    )
    states = incidents.select(F.col("id").alias("_id"), F.col("status").alias("_stored"))
    judged = actions.join(firsts.join(states, "_id", "left"), F.col("target") == F.col("_id"), "left")
    active = F.col("_stored").isin("open", "acknowledged")
    resolving = (F.col("action") == "resolve") & active & (place == F.col("_resolve"))
    in_time = F.col("_resolve").isNull() | (F.col("_ack") < F.col("_resolve"))
    acking = (F.col("action") == "acknowledge") & (F.col("_stored") == "open") & in_time & (place == F.col("_ack"))
    acked_before = (F.col("_stored") == "acknowledged") | (
        (F.col("_stored") == "open") & in_time & (F.col("_ack") < place)
    )
    before = (
        F.when(F.col("_stored") == "resolved", F.lit("resolved"))
        .when(F.col("_resolve") < place, F.lit("resolved"))
        .when(acked_before, F.lit("acknowledged")).otherwise(F.lit("open"))
    )
    labelled = judged.select(
        *actions.columns, F.coalesce(resolving | acking, F.lit(False)).alias("_ok"), F.col("_stored"),
        F.when(F.col("_stored").isNotNull(), before).alias("from_status"),
    )
    transitions = labelled.filter("_ok").select(
        *actions.columns, "from_status",
        F.when(F.col("action") == "resolve", F.lit("resolved")).otherwise(F.lit("acknowledged")).alias("to_status"),
    )
    rejected = labelled.filter("NOT _ok").select(
        *actions.columns, "from_status",
        F.when(F.col("_stored").isNull(), F.lit("not_found")).otherwise(F.lit("invalid_transition")).alias("reason"),
    )
    return transitions, rejected


def validate_incidents(df: DataFrame) -> DataFrame:
    """Add ``problems``: every rule an incident row breaks, together."""
    required = ("fingerprint", "tenant_id", "service_name", "rule_id", "title")
    checks = [F.when(is_blank(F.col(c)), F.lit(f"{c} is required")) for c in required]
    for column, allowed in (("status", INCIDENT_STATUSES), ("severity", SEVERITIES)):
        c = F.coalesce(F.col(column), F.lit(""))
        checks.append(F.when(~c.isin(*allowed), F.concat(F.lit(f"{column} "), c, F.lit(" is not recognised"))))
    return df.withColumn("problems", F.array_compact(F.array(*checks)))


def incident_status(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    """Current status per asked id; an incident that is gone counts as resolved."""
    known = incidents.select("id", "status")
    return ids.join(known, "id", "left").select("id", F.coalesce("status", F.lit("resolved")).alias("status"))
