"""Paging, remediation, policies and catalogs."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline.functions.frames import local_frame
from tideline.operators import oncall, reads, remediation
from tideline.schema import INCIDENT, INT, POLICY_LEVEL, STRING, TIMESTAMP, columns
from tideline.sources.config import ConfigError, duration_us, load_policy, parse_policy, parse_runbooks, policy_rows, runbook_rows

T0 = datetime(2026, 7, 25, 9, 30, tzinfo=timezone.utc)
MIN = timedelta(minutes=1)
POLICY = """{"levels": [
  {"target": "primary", "ack_timeout": "2m", "rotation": {"contacts": [{"name": "a"}]}},
  {"target": "secondary", "ack_timeout": "5m", "rotation": {"contacts": [{"name": "b", "address": "http://b"}]}}]}"""
CATALOG = """{"runbooks": [
  {"id": "pay", "match": {"rule_id": "error_rate", "service_name": "payment"}, "approval_timeout": "10m",
   "steps": [{"name": "look", "kind": "noop", "mode": "auto"}, {"name": "restart", "kind": "webhook", "mode": "approval", "target": "http://x"}]},
  {"id": "general", "match": {"rule_id": "error_rate"}, "approval_timeout": "10m", "steps": [{"name": "look", "kind": "noop", "mode": "auto"}]}]}"""


def incident(id_, ack=None, resolved=None, auto=None, service="payment", rule="error_rate", opened=T0):
    def moved(d):
        return None if d is None else opened + d

    status = "resolved" if resolved is not None else "acknowledged" if ack is not None else "open"
    return {"id": id_, "fingerprint": id_, "tenant_id": "t", "service_name": service, "rule_id": rule, "title": "x", "severity": "error", "status": status,
            "event_count": 1, "first_seen_at": opened, "last_seen_at": opened, "opened_at": opened, "acknowledged_at": moved(ack),
            "resolved_at": moved(resolved), "auto_resolved": auto, "updated_at": opened, "details": "{}"}


def test_escalation(spark):
    cases = {
        "never": (incident("never"), ["primary", "secondary", "escalation exhausted"]),
        "acked": (incident("acked", ack=MIN / 2), ["primary"]),
        "resolved": (incident("resolved", resolved=MIN / 2, auto=False), ["primary"]),
        "closed": (incident("closed", resolved=timedelta(0), auto=False), []),
        "acked before the poll": (incident("acked before the poll", ack=timedelta(0)), []),
        "later": (incident("later", ack=3 * MIN), ["primary", "secondary"]),
        "auto in first wait": (incident("auto in first wait", resolved=MIN, auto=True), ["primary"]),
        "auto in last wait": (incident("auto in last wait", resolved=4 * MIN, auto=True), ["primary", "secondary", "escalation exhausted"]),
        "by hand in last wait": (incident("by hand in last wait", resolved=4 * MIN, auto=False), ["primary", "secondary"]),
    }
    pages = oncall.escalation_timeline(local_frame(spark, [c[0] for c in cases.values()], INCIDENT), parse_policy(spark, POLICY))
    rows = pages.orderBy("incident_id", "sent_at").collect()
    for name, (_, targets) in cases.items():
        assert [r.target for r in rows if r.incident_id == name] == targets, name
    never = [r for r in rows if r.incident_id == "never"]
    assert [r.sent_at - T0.replace(tzinfo=None) for r in never] == [timedelta(0), 2 * MIN, 7 * MIN]
    assert [(r.level, r.contact) for r in never] == [(1, "a"), (2, "b"), (2, "none")]
    sent = {r.target: (r.channel, r.status) for r in oncall.notification_rows(pages.filter("incident_id = 'never'")).collect()}
    assert sent == {"primary": ("log", "sent"), "secondary": ("webhook", "sent"), "escalation exhausted": ("log", "sent")}


def test_poll_delays_and_markers(spark):
    late = incident("late", opened=T0 + timedelta(seconds=3))
    starts = oncall.alert_starts(local_frame(spark, [late, incident("done")], INCIDENT),
                                 local_frame(spark, [{"incident_id": "done"}], columns(incident_id=STRING)), timedelta(seconds=10))
    assert [(r.id, r.started_at) for r in starts.collect()] == [("late", (T0 + timedelta(seconds=10)).replace(tzinfo=None))]


def test_rotation(spark):
    start = datetime(2026, 1, 5, tzinfo=timezone.utc)
    week = timedelta(days=7)

    def rung(names, shift=7 * 86_400_000_000, begin=start):
        return {"level": 1, "target": "x", "ack_timeout_us": 1, "contacts": [{"name": n, "address": ""} for n in names], "start": begin, "shift_us": shift}

    cases = [(rung("abc"), start - week, "a"), (rung("abc"), start, "a"), (rung("abc"), start + week, "b"), (rung("abc"), start + 2 * week, "c"),
             (rung("abc"), start + 3 * week, "a"), (rung("abc", shift=0), start + week, "a"), (rung("z"), start + week, "z"), (rung(""), start, None)]
    for level, at, name in cases:
        frame = local_frame(spark, [level], POLICY_LEVEL).select(F.struct("*").alias("rung"))
        got = frame.select(oncall.on_call_at(F.col("rung"), F.timestamp_micros(F.lit(int(at.timestamp() * 1_000_000)))).alias("c")).first()["c"]
        assert (got["name"] if got else None) == name


DECISION = columns(incident_id=STRING, action=STRING, actor=STRING, at=TIMESTAMP)
OUTCOME = columns(incident_id=STRING, step_index=INT, status_code=INT, error=STRING)


def run(spark, incidents, decisions=(), outcomes=()):
    log = remediation.remediation_timeline(
        local_frame(spark, incidents, INCIDENT), parse_runbooks(spark, CATALOG),
        local_frame(spark, [dict(zip(DECISION.names, d, strict=True)) for d in decisions], DECISION),
        local_frame(spark, [dict(zip(OUTCOME.names, o, strict=True)) for o in outcomes], OUTCOME),
    )
    return log


def test_remediation(spark):
    names = ("approve", "reject", "silent", "late", "failed", "both", "flood")
    incidents = [incident(n) for n in names] + [
        incident("gone", resolved=timedelta(0) + MIN, auto=True, opened=T0 + timedelta(seconds=1)), incident("mid", resolved=2 * MIN, auto=True),
        incident("other", service="order"), incident("none", rule="else")]
    decisions = [("approve", "approve", "eve", T0 + MIN / 2), ("reject", "reject", "bob", T0 + MIN), ("late", "approve", "eve", T0 + 10 * MIN),
                 ("failed", "approve", "eve", T0 + MIN), ("both", "approve", "eve", T0 + MIN), ("both", "reject", "bob", T0 + MIN), ("mid", "approve", "eve", T0 + 3 * MIN)]
    decisions += [("flood", "approve", f"a{i}", T0 + i * MIN / 100 - MIN) for i in range(300)]
    log = run(spark, incidents, decisions, [("failed", 2, 500, None)])
    last = {(r.incident_id, r.step_index): (r.status, r.actor) for r in remediation.latest_action_status(log).collect()}
    assert {k: v for k, v in last.items() if k[1] == 2} == {
        ("approve", 2): ("succeeded", "eve"), ("reject", 2): ("rejected", "bob"), ("silent", 2): ("timed_out", ""), ("late", 2): ("timed_out", ""),
        ("failed", 2): ("failed", "eve"), ("both", 2): ("rejected", "bob"), ("gone", 2): ("timed_out", ""), ("mid", 2): ("succeeded", "eve"),
        ("flood", 2): ("succeeded", "a100")}
    assert last[("other", 1)] == ("succeeded", "") and not any(k[0] == "none" for k in last)
    seen = [r.status for r in log.filter("incident_id = 'approve' AND step_index = 2").orderBy("seq").collect()]
    assert seen == ["pending", "approved", "succeeded"]
    verdicts = {(r.incident_id, r.actor): r.result for r in remediation.decide(
        local_frame(spark, [dict(zip(DECISION.names, d, strict=True)) for d in decisions], DECISION), log).collect()}
    assert verdicts[("approve", "eve")] == "approved" and verdicts[("late", "eve")] == "no_pending_action" and verdicts[("flood", "a3")] == "no_pending_action"


def test_resolved_before_start_is_not_run(spark):
    # Open when the poller looked, resolved at that very moment by nobody: only reachable by a later look.
    assert run(spark, [incident("x", resolved=timedelta(0), auto=False)]).count() == 0


def test_pending_action(spark):
    log = run(spark, [incident("x")])
    assert log.filter("status = 'pending'").count() == 1
    waiting = remediation.latest_action_status(log.filter("status IN ('pending', 'succeeded')"))
    assert [(r.step_index, r.step_name) for r in reads.pending_action(waiting).collect()] == [(2, "restart")]


def test_default_sized_policy_loads(spark, tmp_path):
    (tmp_path / "policy.json").write_text(POLICY)
    assert [(r.level, r.ack_timeout_us) for r in load_policy(spark, str(tmp_path / "policy.json")).collect()] == [(1, 120_000_000), (2, 300_000_000)]


def level(**changes):
    base = {"target": '"t"', "ack_timeout": '"1m"', "contacts": '[{"name":"a"}]', "extra": ""}
    base.update(changes)
    return '{"levels":[{"target":%(target)s,"ack_timeout":%(ack_timeout)s,"rotation":{"contacts":%(contacts)s}%(extra)s}]}' % base


@pytest.mark.parametrize("document,words", [
    ('{"levels": []}', "levels has 0 entries"), (level(target='""'), "target is blank"), (level(ack_timeout='"soon"'), "ack_timeout is 'soon'"),
    (level(ack_timeout='"0s"'), "too short"), (level(contacts="[]"), "contacts has 0 entries"), (level(contacts='[{"name":" "}]'), "contacts.0..name is blank"),
    (level(extra=',"more":1'), "unknown key 'more'"), ("nope", "no JSON"), (level(target="5"), "target is no text"), (level(ack_timeout="5"), "ack_timeout is no text"),
    (level(contacts='[{"name":"a"}],"start":"2024-01-05"'), "no RFC 3339 time"), (level(contacts='[{"name":"a"}],"start":"20240105T000000"'), "no RFC 3339 time"),
    (level(contacts='[{"name":"a"}],"start":5'), "start is no text"), (level(contacts='[{"name":"a"}],"shift":"-1h"'), "shift is '-1h', too short"), ("[]", "is no object"),
    ('{"levels": {}}', "levels is no list"),
])
def test_policy_errors(document, words):
    with pytest.raises(ConfigError, match=words):
        policy_rows(document)


STEP = '{"name":"s","kind":"noop","mode":"auto"}'


def book(step=STEP, match='{"rule_id":"r"}', timeout="1m", id_="a"):
    return f'{{"id":"{id_}","approval_timeout":"{timeout}","match":{match},"steps":[{step}]}}'


@pytest.mark.parametrize("books,words", [
    ("", "runbooks has 0 entries"), (book(match="{}"), "match.rule_id is blank"), (book(step=""), "steps has 0 entries"),
    (book(step=STEP.replace("noop", "launch")), "kind is 'launch'"), (book(step=STEP.replace("noop", "webhook")), "a webhook needs one"),
    (book(step=STEP.replace("auto", "whenever")), "mode is 'whenever'"), (book() + "," + book(), "repeats 'a'"), (book(timeout="soon"), "approval_timeout is 'soon'"),
    (book(step=STEP.replace("}", ',"q":1}')), "unknown key 'q'"), (book(step=STEP.replace("}", ',"params":[1]}')), "params is no object of texts"),
    (book(step=STEP.replace("}", ',"params":"x"}')), "params is no object of texts"), (book(step=STEP.replace("}", ',"params":{"a":1}}')), "params is no object of texts"),
])
def test_catalog_errors(books, words):
    with pytest.raises(ConfigError, match=words):
        runbook_rows(f'{{"runbooks":[{books}]}}')


def test_all_problems_at_once():
    with pytest.raises(ConfigError) as found:
        policy_rows('{"levels": [{"target": "", "ack_timeout": "x"}, {"more": 1}]}')
    assert len(found.value.problems) == 7


def test_durations():
    assert [duration_us(x) for x in ("0", "1h30m", "-1.5s", ".5ms", "1.ms", "+2us", "1ns")] == [0, 5_400_000_000, -1_500_000, 500, 1000, 2, 0]
    assert [duration_us(x) for x in ("", "5", "h", "1h ", "1d", "- 1h")] == [None] * 6


def test_match_runbook(spark):
    rows = remediation.match_runbook(local_frame(spark, [incident("p"), incident("o", service="order"), incident("n", rule="else")], INCIDENT),
                                     parse_runbooks(spark, CATALOG)).collect()
    assert {r.id: r.runbook_id for r in rows} == {"p": "pay", "o": "general", "n": None}
