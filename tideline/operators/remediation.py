"""Runbooks: which one applies, which steps ran, and where it stopped."""

from __future__ import annotations

from collections import Counter
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import messages
from tideline.functions.frames import from_us
from tideline.functions.text import duration_text, uuid5
from tideline.operators.oncall import alert_starts
from tideline.schema import ACTION_NAMESPACE


def _catalog(steps: DataFrame) -> DataFrame:
    """One row per runbook with its steps in order. A catalog is one hand-written file."""
    return steps.groupBy(
        "ordinal", "runbook_id", "match_rule_id", "match_service", "match_severity", "approval_timeout_us"
    ).agg(F.sort_array(F.collect_list(F.struct("step_index", "step_name", "kind", "mode", "target", F.map_entries("params").alias("params")))).alias("steps"))


def catalog_value(steps: DataFrame) -> Column:
    """The whole catalog, in its order, as one array value that every incident row can see without a join."""
    book = F.struct("ordinal", "runbook_id", "match_rule_id", "match_service", "match_severity", "approval_timeout_us", "steps")
    return _catalog(steps).agg(F.sort_array(F.collect_list(book))).scalar()


def match_runbook(incidents: DataFrame, steps: DataFrame) -> DataFrame:
    """The first runbook in catalog order whose matcher fits; nulls when there is nothing to automate.

    The rule id must be equal, a blank service or severity fits any. The catalog is a constant of the plan, so
    incidents are neither joined nor shuffled.
    """
    def any_or(wanted: Column, actual: Column) -> Column:
        return (wanted == "") | (wanted == actual)

    fitting = F.filter("_books", lambda b: (b["match_rule_id"] == F.col("rule_id"))
                       & any_or(b["match_service"], F.col("service_name")) & any_or(b["match_severity"], F.col("severity")))
    matched = incidents.withColumn("_books", catalog_value(steps)).withColumn("_book", F.try_element_at(fitting, F.lit(1)))
    return matched.select(
        *incidents.columns, F.col("_book.runbook_id").alias("runbook_id"),
        F.col("_book.approval_timeout_us").alias("approval_timeout_us"), F.col("_book.steps").alias("steps"),
    )


def remediation_starts(
    incidents: DataFrame, steps: DataFrame, markers: DataFrame | None = None, poll: timedelta = timedelta(seconds=10)
) -> DataFrame:
    """Every incident the poller handles: ``started`` with its runbook, or ``unmatched`` and only marked."""
    picked = match_runbook(alert_starts(incidents, markers, poll), steps)
    return picked.withColumn(
        "outcome", F.when(F.col("runbook_id").isNotNull(), F.lit("started")).otherwise(F.lit("unmatched"))
    )


def step_outcome(outcomes: DataFrame) -> DataFrame:
    """Success and detail of an executed step, from what its target answered (``status_code`` / ``error``).

    Needs the step's ``kind``, ``target`` and ``params`` beside the answer.
    """
    answered = (F.col("status_code") >= 200) & (F.col("status_code") < 300)
    problem = (
        F.when(F.col("kind") == "noop", F.lit(None).cast("string"))
        .when(F.col("kind") != "webhook", F.concat(F.lit('unknown remediation action kind "'), F.col("kind"), F.lit('"')))
        .when(F.col("target") == "", F.concat(F.lit('step "'), F.col("step_name"), F.lit('" is a webhook action with no target')))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.coalesce(answered, F.lit(True)), F.concat(F.lit(messages.TARGET_STATUS), F.col("status_code")))
    )
    params = F.col("params") if dict(outcomes.dtypes)["params"].startswith("map") else F.map_from_entries("params")
    done = F.when(F.col("kind") == "noop", F.to_json(F.struct(F.lit("noop").alias("executed"), params.alias("params")))).otherwise(
        F.to_json(F.struct(F.lit("webhook").alias("executed"), params.alias("params"), "status_code", "target"))
    )
    return outcomes.withColumns({
        "succeeded": problem.isNull(),
        "outcome_detail": F.coalesce(F.to_json(F.struct(problem.alias("error"))), F.lit("{}")),
    }).withColumn("outcome_detail", F.when(F.col("succeeded"), done).otherwise(F.col("outcome_detail")))


def _gate_answers(runs: DataFrame, decisions: DataFrame, gates: int) -> DataFrame:
    """The n-th decision after the start answers the n-th gate, so only as many as there are gates matter.

    The rank filter also runs before the shuffle: an incident with many decisions is cut down per map task.
    Reject comes first among decisions of the same moment.
    """
    starts = runs.select(F.col("id").alias("incident_id"), F.col("started_at").alias("_start"))
    open_ = decisions.join(starts, "incident_id").filter(F.col("at") >= F.col("_start"))
    first = Window.partitionBy("incident_id").orderBy(F.col("at"), F.col("action").desc(), F.col("actor"))
    ranked = open_.withColumn("gate", F.row_number().over(first)).filter(F.col("gate") <= gates)
    return ranked.select("incident_id", "gate", F.col("action").alias("answer"), F.col("actor").alias("answer_actor"),
                         F.col("at").alias("answered_at"))


def remediation_timeline(
    incidents: DataFrame, steps: DataFrame, decisions: DataFrame, outcomes: DataFrame,
    poll: timedelta = timedelta(seconds=10), markers: DataFrame | None = None,
) -> DataFrame:
    """The transition log of every started runbook, one row per status a step went through.

    Steps run in order from the start. A step reached after the incident was resolved is skipped; an
    approval step waits for a decision and fails the run on silence or a reject; a failed step ends it.
    ``decisions``: incident_id, action (approve / reject), actor, at. ``outcomes``: incident_id,
    step_index, status_code, error - at most one row per step.
    """
    started = remediation_starts(incidents, steps, markers, poll).filter("outcome = 'started'")
    runs = started.select("id", "started_at", "resolved_at", "runbook_id", "approval_timeout_us", "steps")
    # Catalog-sized: the largest number of gates one runbook has.
    gated_steps = Counter(r[0] for r in steps.filter("mode = 'approval'").select("runbook_id").collect())
    gates = max(gated_steps.values(), default=0)
    listed = runs.select(
        F.col("id").alias("incident_id"), "started_at", "resolved_at", "runbook_id", "approval_timeout_us", F.inline("steps")
    )
    order = Window.partitionBy("incident_id").orderBy("step_index")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    gated = F.col("mode") == "approval"
    numbered = listed.withColumn("gate", F.when(gated, F.count_if(gated).over(upto).cast("int")))
    answered = numbered.join(_gate_answers(runs, decisions, gates), ["incident_id", "gate"], "left")
    known = answered.join(outcomes.select("incident_id", "step_index", "status_code", "error"), ["incident_id", "step_index"], "left")
    judged = step_outcome(known)

    # Nothing but a gate takes time, so a step is reached when the last gate before it was answered.
    reached_us = F.unix_micros(F.coalesce(F.max("answered_at").over(before), F.col("started_at")))
    timed = judged.withColumn("_reached_us", reached_us)
    deadline = F.col("_reached_us") + F.col("approval_timeout_us")
    silent = F.col("answered_at").isNull() | (F.unix_micros("answered_at") >= deadline)
    ended = (
        F.when(F.unix_micros("resolved_at") <= F.col("_reached_us"), F.lit("skipped"))
        .when(gated & silent, F.lit("timed_out"))
        .when(gated & (F.col("answer") == "reject"), F.lit("rejected"))
        .when(F.col("succeeded"), F.lit("succeeded")).otherwise(F.lit("failed"))
    )
    settled = timed.withColumn("_final", ended)
    alive = F.coalesce(F.min((F.col("_final") == "succeeded").cast("int")).over(before), F.lit(1)) == 1
    walked = settled.withColumn("_alive", alive).filter("_alive")

    actor = F.coalesce("answer_actor", F.lit(""))
    reached, answered_at = from_us(F.col("_reached_us")), F.col("answered_at")
    ran_at = F.when(gated, answered_at).otherwise(reached)

    def entry(seq: int, status: str, who: Column, at: Column, detail: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(status).alias("status"), who.alias("actor"),
                                     at.alias("at"), detail.alias("detail")))

    def note(**members: Column) -> Column:
        return F.to_json(F.struct(*[c.alias(k) for k, c in members.items()]))

    nobody, final = F.lit(""), F.col("_final")
    ran_by = F.when(gated, actor).otherwise(nobody)
    log = F.array_compact(F.array(
        entry(1, "skipped", nobody, reached,
              note(incident_status=F.lit("resolved"), reason=F.lit(messages.NO_LONGER_ACTIVE)), final == "skipped"),
        entry(1, "pending", nobody, reached,
              note(awaiting=F.lit("approval"), timeout=duration_text(F.col("approval_timeout_us"))),
              gated & (final != "skipped")),
        entry(2, "timed_out", nobody, from_us(deadline), note(reason=F.lit(messages.NOBODY_APPROVED)),
              final == "timed_out"),
        entry(2, "rejected", actor, answered_at, note(reason=F.lit(messages.REJECTED)), final == "rejected"),
        entry(2, "approved", actor, answered_at, note(approved_by=actor), gated & final.isin("succeeded", "failed")),
        entry(3, "succeeded", ran_by, ran_at, F.col("outcome_detail"), final == "succeeded"),
        entry(3, "failed", ran_by, ran_at, F.col("outcome_detail"), final == "failed"),
    ))
    rows = walked.select(
        "incident_id", "runbook_id", "step_index", "step_name", F.col("kind").alias("action_kind"), "mode", F.inline(log)
    )
    key = F.concat_ws(":", "incident_id", F.col("step_index").cast("string"))
    return rows.select(
        uuid5(ACTION_NAMESPACE, key).alias("id"), "incident_id", "runbook_id", "step_index", "step_name", "action_kind",
        "mode", "seq", "status", "actor", "detail", "at",
    )


def latest_action_status(log: DataFrame) -> DataFrame:
    """The stored audit row of each step: its last status, when it was created and last changed."""
    last = F.struct("status", "actor", "detail")
    return log.groupBy(
        "id", "incident_id", "runbook_id", "step_index", "step_name", "action_kind", "mode"
    ).agg(
        F.max_by(last, F.struct("at", "seq")).alias("_last"),
        F.min("at").alias("created_at"), F.max("at").alias("updated_at"),
    ).select(
        "id", "incident_id", "runbook_id", "step_index", "step_name", "action_kind", "mode",
        "_last.status", "_last.actor", "_last.detail", "created_at", "updated_at",
    )


def pending_spans(log: DataFrame) -> DataFrame:
    """When each gated step was waiting: ``[pending_at, ended_at)``, open-ended while it still is."""
    return log.filter("mode = 'approval'").groupBy("incident_id", "step_index", "step_name").agg(
        F.min(F.when(F.col("status") == "pending", F.col("at"))).alias("pending_at"),
        F.min(F.when(F.col("status").isin("approved", "rejected", "timed_out"), F.struct("at", "status"))).alias("_end"),
    ).select("incident_id", "step_index", "step_name", "pending_at", F.col("_end.at").alias("ended_at"),
             F.col("_end.status").alias("ended_as")).filter("pending_at IS NOT NULL")


def decide(decisions: DataFrame, log: DataFrame) -> DataFrame:
    """Every decision with the step it was delivered to, or ``no_pending_action``.

    A step that ended by a decision was still waiting at that very moment. The spans of an incident do
    not overlap and are as few as its gates, so they travel as a short list beside each decision.
    """
    spans = pending_spans(log).groupBy("incident_id").agg(
        F.sort_array(F.collect_list(F.struct("pending_at", "step_index", "step_name", "ended_at", "ended_as"))).alias("_spans")
    )
    at = F.col("at")
    waiting = F.filter("_spans", lambda s: (s["pending_at"] <= at) & (
        s["ended_at"].isNull() | (at < s["ended_at"]) | ((at == s["ended_at"]) & (s["ended_as"] != "timed_out"))))
    step = F.try_element_at(waiting, F.lit(1))
    delivered = F.when(F.col("action") == "approve", F.lit("approved")).otherwise(F.lit("rejected"))
    return decisions.join(spans, "incident_id", "left").select(
        *decisions.columns,
        F.when(step.isNotNull(), delivered).otherwise(F.lit("no_pending_action")).alias("result"),
        step["step_index"].alias("step_index"), step["step_name"].alias("step_name"),
    )


def decisions_asof(decisions: DataFrame, log: DataFrame) -> DataFrame:
    """The first decision of every waiting span, which is the one that counted."""
    delivered = decide(decisions, log).filter("step_index IS NOT NULL")
    first = F.struct("at", F.when(F.col("action") == "reject", 0).otherwise(1).alias("rank"), "actor")
    return delivered.groupBy("incident_id", "step_index").agg(
        F.min_by(F.struct("action", "actor", "at"), first).alias("d")
    ).select("incident_id", "step_index", "d.action", "d.actor", "d.at")
