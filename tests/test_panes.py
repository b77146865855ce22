"""Pane streams against the replay of the same events, over several triggers and restarts."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row

from tideline.functions.frames import local_frame
from tideline.operators.detect import Rule, evaluate_rules
from tideline.operators.windows import replay_windows
from tideline.schema import TELEMETRY
from tideline.streaming.panes import STATE_STORE, Lookbacks, pane_length, rule_detections, rule_windows

DAY = datetime(2026, 7, 20, 12, tzinfo=timezone.utc)
KEY = ["tick", "window_us", "tenant_id", "service_name", "total", "errors", "new_errors"]


def event(n, at, severity="info", service="s"):
    return {
        "event_id": f"00000000-0000-4000-8000-{n:012d}", "schema_version": "1.0", "tenant_id": "t", "service_name": service, "environment": "prod",
        "event_type": "request", "severity": severity, "event_timestamp": at, "trace_id": "", "attributes": "{}", "received_at": at, "processed_at": at,
    }


@pytest.fixture
def rocks(spark):
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    yield spark
    for key in STATE_STORE:
        spark.conf.unset(key)


def run(spark, tmp_path, batches, build):
    """Each batch is a file and a start of its own from the checkpoint of the last."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in batches:
        local_frame(spark, rows, TELEMETRY).coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(TELEMETRY).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


def noise(seed=3, n=300):
    draw = random.Random(seed)
    spread = sorted(draw.choice([draw.randint(0, 200), draw.randint(900, 1_100), 2_000]) for _ in range(n))
    return [event(k, DAY + timedelta(seconds=s, milliseconds=k % 900), draw.choice(["info", "error", "critical"]), draw.choice(["hot", "hot", "hot", "a", "b"])) for k, s in enumerate(spread)]


@pytest.mark.parametrize(("step", "lookbacks"), [(15, (60, 45)), (30, (75, 30, 10)), (60, (60,))])
def test_equals_the_replay(rocks, tmp_path, step, lookbacks):
    rows, step, lookbacks = noise(), timedelta(seconds=step), [timedelta(seconds=w) for w in lookbacks]
    end = [event(9_999, DAY + timedelta(hours=3), service="clock")]
    live = run(rocks, tmp_path, [rows[:120], rows[120:121], rows[121:], end], lambda s: rule_windows(s, lookbacks, step, timedelta(seconds=20)))
    # Within a lookback that is shorter than the step, an error is new only where the window holds it.
    want = sorted(
        (*r[:6], min(r[6], r[5])) for r in replay_windows(local_frame(rocks, rows, TELEMETRY), lookbacks, step, mode="half_open").select(*KEY).collect()
    )
    assert sorted(map(tuple, live.filter("service_name <> 'clock'").select(*KEY).collect())) == want


def test_rule_set_in_one_query(rocks, tmp_path):
    rows, step = noise(5), timedelta(seconds=15)
    rules = [Rule(), Rule(id="burst", window=timedelta(seconds=45), threshold=0.6, min_events=3), Rule(id="odd", kind="unheard-of")]
    end = [event(9_999, DAY + timedelta(hours=3), service="clock")]
    live = run(rocks, tmp_path, [rows[:200], rows[200:], end], lambda s: rule_detections(s, rules, step, timedelta(seconds=5)))
    batch = evaluate_rules(local_frame(rocks, rows, TELEMETRY), rules, step, mode="half_open")
    got = sorted(map(tuple, live.filter("service_name <> 'clock'").select(*batch.columns).collect()))
    assert got == sorted(map(tuple, batch.collect())) and {r[1] for r in got} == {"error_rate", "burst"}


def test_late_events_miss_closed_panes_only(rocks, tmp_path):
    step, lookbacks = timedelta(seconds=15), [timedelta(seconds=60)]
    first = [event(1, DAY), event(2, DAY + timedelta(seconds=100))]
    # The watermark stands at 70 s: 50 s is lost, 80 s is counted.
    late = [event(3, DAY + timedelta(seconds=50)), event(4, DAY + timedelta(seconds=80)), event(5, DAY + timedelta(hours=1), service="clock")]
    live = run(rocks, tmp_path, [first, late], lambda s: rule_windows(s, lookbacks, step, timedelta(seconds=30)))
    want = replay_windows(local_frame(rocks, [first[0], first[1], late[1]], TELEMETRY), lookbacks, step, mode="half_open")
    assert sorted(map(tuple, live.filter("service_name = 's'").select(*KEY).collect())) == sorted(map(tuple, want.select(*KEY).collect()))


def test_pane_length():
    assert pane_length(timedelta(seconds=15), [timedelta(seconds=60), timedelta(seconds=40)]) == 5_000_000
    for bad in ([], [timedelta(0)]):
        with pytest.raises(ValueError):
            pane_length(timedelta(seconds=15), bad)


class Store:
    """A state store of one service that counts the calls."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_to_the_state_do_not_grow_with_panes():
    store, states = Store(), Lookbacks(15_000_000, 5_000_000, [20_000_000, 60_000_000])
    states.init(store)
    counts = {p: (1 + p % 3, p % 2) for p in range(30, 430) if p % 40 < 30}
    told = []
    for first, last in ((30, 200), (200, 210), (210, 430)):
        before = store.calls
        rows = [Row(pane=p, total=t, errors=e) for p, (t, e) in counts.items() if first <= p < last]
        told += states.handleInputRows(("t", "s"), iter(rows), At(last * 5_000))
        assert store.calls - before <= 3
    # Without panes a timer closes what is left; one that comes after its tick was told says nothing.
    assert not list(states.handleExpiredTimer(("t", "s"), At(430 * 5_000), None))
    told += states.handleExpiredTimer(("t", "s"), At(10_000_000), None)
    assert store.value is None
    want = []
    for tick in range(1, 300):
        for lookback in (4, 12):
            seen = [counts[p] for p in range(tick * 3 - lookback, tick * 3) if p in counts]
            new = sum(counts[p][1] for p in range(tick * 3 - 3, tick * 3) if p in counts)
            if seen:
                want.append((tick * 15, lookback * 5_000_000, "t", "s", sum(t for t, _ in seen), sum(e for _, e in seen), new))
    assert [(int(r[0].timestamp()), *r[1:]) for r in told] == want
