"""Table rules as a violation report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import floor_div
from tideline.schema import (
    INCIDENT_STATUSES,
    NOTIFICATION_STATUSES,
    REMEDIATION_STATUSES,
    SEVERITIES,
    STEP_MODES,
)


def _filled(name: str) -> Column:
    return F.col(name) != ""


def _rules(table: str) -> dict[str, Column]:
    if table == "telemetry_events":
        return {
            "severity": F.col("severity").isin(*SEVERITIES),
            **{c: _filled(c) for c in ("schema_version", "tenant_id", "service_name", "event_type")},
        }
    if table == "incidents":
        return {
            "status": F.col("status").isin(*INCIDENT_STATUSES),
            "severity": F.col("severity").isin(*SEVERITIES),
            "resolved_at": (F.col("status") == "resolved") == F.col("resolved_at").isNotNull(),
            **{c: _filled(c) for c in ("fingerprint", "tenant_id", "service_name", "rule_id")},
        }
    if table == "notifications":
        return {
            "level": F.col("level") >= 1,
            "status": F.col("status").isin(*NOTIFICATION_STATUSES),
            **{c: _filled(c) for c in ("target", "contact", "channel")},
        }
    if table == "remediation_actions":
        return {
            "step_index": F.col("step_index") >= 1,
            "mode": F.col("mode").isin(*STEP_MODES),
            "status": F.col("status").isin(*REMEDIATION_STATUSES),
            **{c: _filled(c) for c in ("step_name", "runbook_id")},
        }
    raise ValueError(f"no rules for table {table!r}")


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    """Rows per broken rule, in one pass; a rule every row keeps is reported with zero."""
    rules = _rules(table)
    # As in SQL, a rule that evaluates to null is not broken.
    counted = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    report = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counted.select(F.inline(report))


# --- rules across rows -----------------------------------------------------------------------------

def active_twice(incidents: DataFrame, block_us: int = 86_400_000_000) -> DataFrame:
    """Incidents that open while an earlier one of their fingerprint is still active (an open one is active for good).

    Incidents are swept in order of opening, in blocks of time first: a block needs of the ones before it only how long
    the latest of them lasts. So a noisy fingerprint is many blocks and not one long task.
    """
    opened, ends = F.unix_micros("opened_at"), F.coalesce(F.unix_micros("resolved_at"), F.lit((1 << 63) - 1))
    placed = incidents.select("*", opened.alias("_from"), ends.alias("_to"), floor_div(opened, block_us).alias("_block"))
    whole = placed.groupBy(F.col("fingerprint").alias("_f"), F.col("_block").alias("_b")).agg(F.max("_to").alias("_lasts"))
    in_turn = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("_f", "_b", F.max("_lasts").over(in_turn).alias("_before"))
    inside = Window.partitionBy("fingerprint", "_block").orderBy("_from", "id").rowsBetween(Window.unboundedPreceding, -1)
    swept = placed.join(before, (F.col("fingerprint") == F.col("_f")) & (F.col("_block") == F.col("_b"))).withColumn("_earlier", F.max("_to").over(inside))
    return swept.filter(F.greatest("_before", "_earlier") > F.col("_from")).select(*incidents.columns)


def check_references(incidents: DataFrame, actions: DataFrame, notifications: DataFrame) -> DataFrame:
    """``problem, id``: a row for each row of the three tables that breaks a rule across rows.

    ``active_twice`` (``active_twice``), ``step_twice`` (a step of an incident that has several actions, each of them),
    ``orphan_action`` and ``orphan_notification`` (of an incident that is not there).
    """
    steps = actions.groupBy(F.col("incident_id").alias("_i"), F.col("step_index").alias("_s")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = actions.join(steps, (F.col("incident_id") == F.col("_i")) & (F.col("step_index") == F.col("_s")), "left_semi")
    known = incidents.select(F.col("id").alias("_id"))
    found = {
        "active_twice": active_twice(incidents), "step_twice": twice,
        "orphan_action": actions.join(known, F.col("incident_id") == F.col("_id"), "left_anti"),
        "orphan_notification": notifications.join(known, F.col("incident_id") == F.col("_id"), "left_anti"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("problem"), "id") for name, df in found.items()])
