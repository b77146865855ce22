"""The closed-form incident timeline against a literal cycle-by-cycle simulation."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tideline.functions.frames import epoch_us, local_frame
from tideline.operators.incidents import apply_actions, can_transition, incidents_from_detections
from tideline.schema import DETECTION, INCIDENT, OPERATOR_ACTION, columns, STRING
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
STEP = timedelta(seconds=15)


def at(ticks: float) -> datetime:
    return T0 + ticks * STEP


def detection(fp, tick, errors=5, new=2):
    return {
        "tick": at(tick), "rule_id": "r", "tenant_id": "t", "service_name": fp, "fingerprint": fp, "title": f"at {tick}",
        "severity": "error", "event_count": errors, "new_event_count": new, "details": "{}",
    }


def simulate(fired, actions, horizon, quiet):
    """One fingerprint, one tick at a time: actions, then detection, then auto-resolve."""
    closed, active = [], None
    todo = sorted(actions, key=lambda a: (a[0], a[1]))
    for tick in range(0, horizon + 1):
        while todo and todo[0][0] <= tick:
            when, kind = todo.pop(0)
            if active is None:
                continue
            if kind == "acknowledge" and active["ack"] is None:
                active["ack"] = when
            elif kind == "resolve":
                closed.append({**active, "resolved": when, "auto": False})
                active = None
        if tick in fired:
            errors, new = fired[tick]
            if active is None:
                active = {"opened": tick, "last": tick, "count": errors, "ack": None}
            else:
                active["last"], active["count"] = tick, active["count"] + new
        if active and active["last"] * 15 < tick * 15 - quiet:
            closed.append({**active, "resolved": tick, "auto": True})
            active = None
    return closed + ([{**active, "resolved": None, "auto": None}] if active else [])


@pytest.mark.parametrize("with_actions,block", [(False, 4096), (True, 4096), (True, 3), (False, 5)])
def test_matches_literal_cycles(spark, with_actions, block):
    rng = random.Random(7 + block)
    horizon, detections, actions, expected = 60, [], [], []
    # One quiet period for the whole log, as in a real evaluator.
    quiet = 40
    for n in range(120):
        fp = f"f{n}"
        fired = {t: (rng.randint(3, 9), rng.randint(0, 3)) for t in range(1, horizon + 1) if rng.random() < rng.choice((0.1, 0.3, 0.6))}
        acts = []
        if with_actions:
            acts = [(rng.randint(2, 240) / 4, rng.choice(("acknowledge", "resolve"))) for _ in range(rng.randint(0, 6))]
        detections += [detection(fp, t, *v) for t, v in fired.items()]
        actions += [
            {"action_id": f"{fp}-{i}", "target": fp, "action": kind, "actor": "x", "at": at(when)}
            for i, (when, kind) in enumerate(acts)
        ]
        expected += [
            (fp, i["opened"], i["last"], i["count"], i["ack"], i["resolved"], i["auto"])
            for i in simulate(fired, acts, horizon, quiet)
        ]
    found = incidents_from_detections(
        local_frame(spark, detections, DETECTION), STEP, timedelta(seconds=quiet), at(horizon),
        local_frame(spark, actions, OPERATOR_ACTION) if with_actions else None, block_ticks=block,
    )

    def ticks(moment):
        return None if moment is None else (epoch_us(moment) - epoch_us(T0)) / 15_000_000

    got = [
        (r.fingerprint, ticks(r.opened_at), ticks(r.last_seen_at), r.event_count, ticks(r.acknowledged_at), ticks(r.resolved_at), r.auto_resolved)
        for r in found.collect()
    ]
    assert sorted(got, key=repr) == sorted([tuple(float(v) if i in (1, 2, 4, 5) and v is not None else v for i, v in enumerate(e)) for e in expected], key=repr)


def test_grouping_adds_only_new_errors(spark):
    log = local_frame(spark, [detection("f", 1, 15, 15), detection("f", 2, 18, 3), detection("f", 3, 20, 2)], DETECTION)
    rows = incidents_from_detections(log, STEP, timedelta(minutes=5), at(3)).collect()
    assert [(r.event_count, r.status, r.title) for r in rows] == [(20, "open", "at 1")]


def test_replay_keeps_ids(spark):
    log = local_frame(spark, [detection("f", 1), detection("f", 40)], DETECTION)
    runs = [sorted(r.id for r in incidents_from_detections(log, STEP, timedelta(minutes=5), at(90)).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(set(runs[0])) == 2


def test_apply_actions(spark):
    base = {"fingerprint": "f", "tenant_id": "t", "service_name": "s", "rule_id": "r", "title": "x", "severity": "error",
            "event_count": 1, "first_seen_at": T0, "last_seen_at": T0, "opened_at": T0, "acknowledged_at": None, "resolved_at": None,
            "auto_resolved": None, "updated_at": T0, "details": "{}"}
    stored = local_frame(spark, [{**base, "id": i, "status": s} for i, s in (("a", "open"), ("b", "acknowledged"), ("c", "resolved"))], INCIDENT)
    log = [("1", "a", "acknowledge", 1), ("2", "a", "acknowledge", 2), ("3", "a", "resolve", 3), ("4", "a", "resolve", 4), ("5", "a", "acknowledge", 5),
           ("6", "b", "acknowledge", 1), ("7", "b", "resolve", 2), ("8", "c", "resolve", 1), ("9", "z", "resolve", 1)]
    actions = local_frame(spark, [{"action_id": i, "target": t, "action": k, "actor": "x", "at": at(w)} for i, t, k, w in log], OPERATOR_ACTION)
    accepted, refused = apply_actions(stored, actions)
    assert {(r.action_id, r.from_status, r.to_status) for r in accepted.collect()} == {
        ("1", "open", "acknowledged"), ("3", "acknowledged", "resolved"), ("7", "acknowledged", "resolved")}
    assert {(r.action_id, r.from_status, r.reason) for r in refused.collect()} == {
        ("2", "acknowledged", "invalid_transition"), ("4", "resolved", "invalid_transition"), ("5", "resolved", "invalid_transition"),
        ("6", "acknowledged", "invalid_transition"), ("8", "resolved", "invalid_transition"), ("9", None, "not_found")}


def test_transitions(spark):
    names = ("open", "acknowledged", "resolved", "gone")
    pairs = local_frame(spark, [{"a": a, "b": b} for a in names for b in names], columns(a=STRING, b=STRING))
    legal = {(r.a, r.b) for r in pairs.filter(can_transition(F.col("a"), F.col("b"))).collect()}
    assert legal == {("open", "acknowledged"), ("open", "resolved"), ("acknowledged", "resolved")}


def test_actions_ahead_of_detections_lose_nothing(spark, tmp_path):
    """Several triggers; every action is read long before the detections of its time."""
    from tideline.streaming.stateful import STATE_STORE, open_incidents, stateful_incidents, waiting_actions

    fired = {"a": [1, 2, 3, 30, 31], "b": [2, 40]}
    acts = [("a1", "a", "acknowledge", 2), ("a2", "a", "resolve", 30.5), ("n", "nobody", "resolve", 200), ("b1", "b", "acknowledge", 5), ("b2", "b", "acknowledge", 6)]
    folders = {name: str(tmp_path / name) for name in ("detections", "actions", "out", "checkpoint")}

    def drop(name, rows, schema):
        local_frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(folders[name])

    drop("actions", [{"action_id": i, "target": t, "action": k, "actor": "x", "at": at(n)} for i, t, k, n in acts], OPERATOR_ACTION)
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    before = 0
    try:
        for last in (2, 10, 35, 50, 200, 201):
            rows = [detection(f, t) for f, ticks in fired.items() for t in ticks if before < t <= last]
            before = last
            drop("detections", rows + [detection("clock", last)], DETECTION)
            # A restarted query knows no watermark of a stream that stays silent: the heartbeat.
            drop("actions", [{"action_id": f"beat-{last}", "target": "nobody", "action": "resolve", "actor": "x", "at": at(last)}], OPERATOR_ACTION)
            streams = [spark.readStream.schema(s).parquet(folders[n]) for n, s in (("detections", DETECTION), ("actions", OPERATOR_ACTION))]
            changes = stateful_incidents(streams[0], STEP, timedelta(seconds=40), timedelta(seconds=30), streams[1])
            writer = changes.writeStream.format("parquet").option("checkpointLocation", folders["checkpoint"]).trigger(availableNow=True)
            writer.start(folders["out"]).awaitTermination()
            if last == 2:
                # Read back between two starts: what is open, and what waits for its time.
                held = {(r.fingerprint, epoch_us(r.opened_at), r.event_count, r.acknowledged) for r in open_incidents(spark, folders["checkpoint"]).collect()}
                assert held == {("a", epoch_us(at(1)), 7, True), ("b", epoch_us(at(2)), 5, False), ("clock", epoch_us(at(2)), 5, False)}
                assert {r.action_id for r in waiting_actions(spark, folders["checkpoint"]).collect()} == {"a2", "b1", "b2", "n", "beat-2"}
    finally:
        for key in STATE_STORE:
            spark.conf.unset(key)
    batch = incidents_from_detections(
        local_frame(spark, [detection(f, t) for f, ticks in fired.items() for t in ticks], DETECTION), STEP, timedelta(seconds=40), at(150),
        local_frame(spark, [{"action_id": i, "target": t, "action": k, "actor": "x", "at": at(n)} for i, t, k, n in acts], OPERATOR_ACTION))
    log = spark.read.parquet(folders["out"]).filter("fingerprint IN ('a', 'b')")
    last = log.groupBy("fingerprint", "opened_at").agg(
        F.max_by("event_count", "at").alias("event_count"), F.max("last_seen_at").alias("last_seen_at"), F.max(F.when(F.col("change") == "acknowledged", F.col("at"))).alias("acked"),
        F.max(F.when(F.col("change").isin("resolved", "auto_resolved"), F.col("at"))).alias("resolved"), F.max(F.col("change") == "auto_resolved").alias("auto"))
    got = sorted(map(tuple, last.filter("opened_at IS NOT NULL").collect()))
    assert got == sorted(map(tuple, batch.select("fingerprint", "opened_at", "event_count", "last_seen_at", "acknowledged_at", "resolved_at", "auto_resolved").collect()))
    assert len(got) == 5 and [r.action_id for r in log.filter("change = 'rejected'").collect()] == ["b2"]


@pytest.mark.parametrize("block", [1_000_000, 86_400_000_000])
def test_overlaps_are_found_in_any_blocks(spark, block):
    from tideline.operators.constraints import active_twice

    draw = random.Random(block)
    rows = []
    for n in range(200):
        start = draw.randint(0, 900)
        rows.append({"id": f"i{n:03d}", "fingerprint": f"f{n % 7}", "opened_at": at(start / 15), "resolved_at": None if draw.random() < 0.01 else at((start + draw.randint(0, 40)) / 15)})
    far = at(10_000)
    want = {r["id"] for r in rows for e in rows if e["fingerprint"] == r["fingerprint"] and (e["opened_at"], e["id"]) < (r["opened_at"], r["id"]) and (e["resolved_at"] or far) > r["opened_at"]}
    found = active_twice(local_frame(spark, rows, columns(id=STRING, fingerprint=STRING, opened_at=INCIDENT["opened_at"].dataType, resolved_at=INCIDENT["resolved_at"].dataType)), block)
    got = [r.id for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and 0 < len(want) < 200
