"""Who is paged for an incident, when, and how it was delivered."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import messages
from tideline.functions.frames import from_us
from tideline.functions.text import ceil_div, micros, uuid5
from tideline.schema import NOTIFICATION_NAMESPACE

# fixed value: the longest span the rotation arithmetic knows; one without a start has run this long.
LONGEST_US = 9_223_372_036_854_775


def on_call_at(level: Column, at: Column) -> Column:
    """The contact of a level's rotation at a moment.

    Contacts take turns of ``shift_us`` from ``start``. Before the start, with one contact or without
    a shift it is the first one; a level without contacts has none (null).
    """
    contacts = level["contacts"]
    since = F.unix_micros(at) - F.unix_micros(level["start"])
    elapsed = F.least(F.coalesce(since, F.lit(LONGEST_US)), F.lit(LONGEST_US))
    shift = F.coalesce(level["shift_us"], F.lit(0))
    turn = F.call_function("div", elapsed, F.nullif(shift, F.lit(0).cast("long")))
    first = (F.size(contacts) <= 1) | (shift <= 0) | (elapsed < 0)
    place = F.when(first, F.lit(1)).otherwise((F.pmod(turn, F.size(contacts)) + 1).cast("int"))
    return F.try_element_at(contacts, place)


def escalation_offsets(levels: DataFrame) -> DataFrame:
    """When each level is reached, counted from the start of the escalation.

    A policy is one hand-written file, so ordering its levels in one task is no bottleneck.
    """
    earlier = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    return levels.withColumn("offset_us", F.coalesce(F.sum("ack_timeout_us").over(earlier), F.lit(0)))


def policy_value(levels: DataFrame) -> Column:
    """The whole policy as one array value that every incident row can see without a join."""
    rungs = F.struct("level", "target", "ack_timeout_us", "contacts", "start", "shift_us", "offset_us")
    return escalation_offsets(levels).agg(F.sort_array(F.collect_list(rungs))).scalar()


def first_poll(opened_at: Column, poll: timedelta) -> Column:
    """Microseconds of the first poll at or after the opening."""
    return ceil_div(F.unix_micros(opened_at), micros(poll)) * F.lit(micros(poll))


def first_ack_or_resolve(incidents: DataFrame) -> DataFrame:
    """Earliest event that stops an escalation, and the earliest one that also interrupts its waits.

    Only a person's acknowledge or resolve is signalled; an auto-resolve is noticed at the next check.
    """
    by_hand = F.when(~F.coalesce("auto_resolved", F.lit(False)), F.col("resolved_at"))
    return incidents.select(
        "*", F.least("acknowledged_at", "resolved_at").alias("stopped_at"),
        F.least(F.col("acknowledged_at"), by_hand).alias("signalled_at"),
    )


def alert_starts(incidents: DataFrame, markers: DataFrame | None, poll: timedelta) -> DataFrame:
    """Incidents the poller picks up: still open at its first look, and not marked before."""
    start_us = first_poll(F.col("opened_at"), poll)
    watched = first_ack_or_resolve(incidents).select("*", from_us(start_us).alias("started_at"))
    starting = watched.filter(F.col("stopped_at").isNull() | (F.col("stopped_at") > F.col("started_at")))
    if markers is not None:
        starting = starting.join(markers.select(F.col("incident_id").alias("id")), "id", "left_anti")
    return starting


def escalation_timeline(
    incidents: DataFrame, levels: DataFrame, poll: timedelta = timedelta(seconds=10), markers: DataFrame | None = None
) -> DataFrame:
    """Every page an incident causes, one row per page.

    Level *k* is paged after the waits of all earlier levels, unless somebody acknowledged or resolved
    by then. When the last wait ends without a signal one more row says the policy is exhausted. An
    auto-resolve inside the last wait goes unnoticed, as nothing checks the status after it.
    The policy is a constant for the rows, so the incidents are neither joined nor shuffled.
    """
    started = alert_starts(incidents, markers, poll).withColumn("_levels", policy_value(levels))
    start_us = F.unix_micros("started_at")

    def page(rung: Column) -> Column:
        at = from_us(start_us + rung["offset_us"])
        contact = on_call_at(rung, at)
        return F.struct(
            rung["level"].alias("level"), rung["target"].alias("target"),
            F.coalesce(contact["name"], F.lit("")).alias("contact"),
            F.coalesce(contact["address"], F.lit("")).alias("contact_address"),
            F.lit("escalation").alias("reason"), at.alias("sent_at"),
        )

    last = F.element_at("_levels", -1)
    checked_at = from_us(start_us + last["offset_us"])
    ends_at = from_us(start_us + last["offset_us"] + last["ack_timeout_us"])
    exhausted = F.struct(
        last["level"].alias("level"), F.lit(messages.EXHAUSTED).alias("target"), F.lit("none").alias("contact"),
        F.lit("").alias("contact_address"), F.lit("exhausted").alias("reason"), ends_at.alias("sent_at"),
    )
    unanswered = (F.col("signalled_at").isNull() | (F.col("signalled_at") > ends_at)) & (
        F.col("stopped_at").isNull() | (F.col("stopped_at") > checked_at)
    )
    reached = F.filter(
        F.transform("_levels", page), lambda p: F.col("stopped_at").isNull() | (p["sent_at"] < F.col("stopped_at"))
    )
    pages = F.concat(reached, F.when(unanswered, F.array(exhausted)).otherwise(F.filter(F.array(exhausted), lambda _: F.lit(False))))
    listed = started.select(F.col("id").alias("incident_id"), "title", "severity", F.explode(pages).alias("p"))
    return listed.select(
        uuid5(NOTIFICATION_NAMESPACE, F.concat_ws(":", "incident_id", F.col("p.level").cast("string"), "p.reason")).alias("id"),
        "incident_id", "p.level", "p.target", "p.contact", "p.contact_address", "p.reason", "title", "severity", "p.sent_at",
    )


def notification_rows(pages: DataFrame, deliveries: DataFrame | None = None, webhook_url: str = "") -> DataFrame:
    """The audit row of every page.

    ``deliveries`` holds what the webhook answered per page id (``status_code`` or ``error``). A page
    without an answer was delivered to the log only, or counts as sent.
    """
    webhook = (F.col("contact_address") != "") | F.lit(webhook_url != "")
    joined = pages if deliveries is None else pages.join(
        deliveries.select(F.col("notification_id").alias("id"), "status_code", "error"), "id", "left"
    )
    if deliveries is None:
        joined = joined.select("*", F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("error"))
    refused = (F.col("status_code") < 200) | (F.col("status_code") >= 300)
    problem = F.when(webhook, F.coalesce(
        F.col("error"), F.when(refused, F.concat(F.lit(messages.WEBHOOK_STATUS), F.col("status_code")))))
    detail = F.to_json(F.struct(problem.alias("error"), "reason", "severity", "title"))
    return joined.select(
        "id", "incident_id", "level", "target", "contact",
        F.when(webhook, F.lit("webhook")).otherwise(F.lit("log")).alias("channel"),
        F.when(problem.isNotNull(), F.lit("failed")).otherwise(F.lit("sent")).alias("status"),
        detail.alias("detail"), "sent_at",
    )
