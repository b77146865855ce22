"""The day-partitioned table, its maintenance, and the streams that fill it."""

import base64
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.cursor import read_cursor
from tideline.functions.frames import local_frame
from tideline.operators import dedupe, reads, reports, retention, windows
from tideline.operators.detect import Rule, detect
from tideline.operators.windows import replay_windows, window_stats
from tideline.plans import queries
from tideline.schema import BOOLEAN, INT, LONG, PARTITION, STRING, TELEMETRY, TIMESTAMP, columns
from tideline.sources import streams, tables
from tideline.streaming.detection import stream_windows
from tideline.streaming.ingest import dedupe_stream, read_quarantine, start_ingest

DAY = datetime(2026, 7, 20, 12, tzinfo=timezone.utc)
LATER = datetime(2026, 7, 25, tzinfo=timezone.utc)


def event(n, at=DAY, severity="info", service="s", processed=None):
    return {
        "event_id": f"00000000-0000-4000-8000-{n:012d}", "schema_version": "1.0", "tenant_id": "t", "service_name": service, "environment": "prod",
        "event_type": "request", "severity": severity, "event_timestamp": at, "trace_id": "" if n % 2 else f"tr-{n}", "attributes": "{}",
        "received_at": at, "processed_at": processed or at,
    }


def frame(spark, rows):
    return local_frame(spark, rows, TELEMETRY)


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [event(1), event(1), event(2), event(2, DAY + timedelta(days=1)), event(3, DAY - timedelta(days=200))]
    assert dedupe.append_events(frame(spark, rows), path) == (4, 1)
    assert dedupe.append_events(frame(spark, rows), path) == (0, 5)
    assert dedupe.append_events(frame(spark, [event(9)]), path) == (1, 0)
    stored = tables.scan_events(spark, path)
    assert stored.count() == 5
    assert {(r.event_id[-1], r.copies) for r in reads.duplicate_event_ids(stored).collect()} == {("2", 2)}
    plan = reads.filter_events(stored, since=DAY, until=DAY)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(event_timestamp" in plan


def test_stream_ingest_survives_redelivery(spark, tmp_path):
    good = streams.to_stream_records(frame(spark, [event(1), event(2), event(2), event(3, LATER - timedelta(days=400)), event(4, LATER + timedelta(hours=1))]), "topic")
    poison = local_frame(spark, [{"value": v} for v in ("nope", "[1]", "", "{}")], columns(value=STRING)).select(
        F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit("topic").alias("topic"), F.array().cast(good.schema["headers"].dataType).alias("headers"))
    numbered = good.unionByName(poison).select("key", "value", "topic", F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), F.lit(DAY).alias("timestamp"), "headers")
    numbered.write.parquet(str(tmp_path / "topic"))
    seen = {}
    for attempt in (1, 2):
        stream = streams.read_event_stream(spark, "parquet", str(tmp_path / "topic"))
        start_ingest(stream, str(tmp_path / "table"), str(tmp_path / "q"), str(tmp_path / f"c{attempt}"), clock=lambda: LATER, available_now=True,
                     on_outcomes=lambda batch, outcomes: seen.setdefault(attempt, outcomes)).awaitTermination()
    assert seen == {1: {"stored": 3, "duplicate": 1, "invalid": 5}, 2: {"stored": 0, "duplicate": 4, "invalid": 5}}
    stored = tables.scan_events(spark, str(tmp_path / "table"))
    assert sorted(r.event_id[-1] for r in stored.collect()) == ["1", "2", "3"]
    assert spark.read.parquet(str(tmp_path / "q")).count() == 10
    refused = read_quarantine(spark, str(tmp_path / "q"))
    assert refused.count() == 5 and refused.filter("reason LIKE '%not a valid%'").count() == 3


def test_batch_equals_stream_on_timely_data(spark, tmp_path):
    rows = [event(n, DAY + timedelta(seconds=7 * n), "error" if n % 3 == 0 else "info", f"s{n % 2}") for n in range(60)]
    rows.append(event(999, DAY + timedelta(days=1), service="late"))
    frame(spark, rows).write.parquet(str(tmp_path / "in"))
    window, step = timedelta(seconds=60), timedelta(seconds=15)
    out = stream_windows(spark.readStream.schema(TELEMETRY).parquet(str(tmp_path / "in")), window, step, timedelta(0)).drop("window")
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
    query.awaitTermination()
    batch = replay_windows(frame(spark, rows), window, step, mode="half_open").filter("service_name <> 'late'")
    key = ["tick", "service_name", "total", "errors", "new_errors"]
    live = spark.read.parquet(str(tmp_path / "o")).filter("service_name <> 'late'")
    assert sorted(map(tuple, live.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))


def test_inclusive_ticks_count_twice(spark):
    rows = frame(spark, [event(n, DAY, "error") for n in range(8)])
    step = timedelta(seconds=15)
    ticks = replay_windows(rows, timedelta(seconds=60), step).orderBy("tick").collect()
    assert [(t.total, t.errors, t.new_errors) for t in ticks] == [(8, 8, 8), (8, 8, 8), (8, 8, 0), (8, 8, 0), (8, 8, 0)]
    stats = window_stats(rows, DAY, DAY + timedelta(seconds=1)).first()
    assert (stats.total, stats.errors, stats.new_errors) == (8, 8, 0)


@pytest.mark.parametrize("mode", ["inclusive", "half_open"])
@pytest.mark.parametrize("few", [8, 0])
def test_hot_service_replay_matches_brute_force(spark, mode, few, monkeypatch):
    """One service holds most rows, many arrive late; every tick is compared with a literal count, spread and running."""
    monkeypatch.setattr(windows, "FEW_TICKS", few)
    monkeypatch.setattr(windows, "BLOCK_TICKS", 5)
    rows = [event(n, DAY + timedelta(seconds=(n * 37) % 600), "critical" if n % 4 == 0 else "warn", "hot" if n % 5 else f"s{n % 7}",
                  DAY + timedelta(seconds=(n * 37) % 600 + (n * 13) % 90)) for n in range(400)]
    window, step = timedelta(seconds=60), timedelta(seconds=15)
    want = {}
    for k in range(0, 60):
        tick = DAY + k * step
        for r in rows:
            t, p = r["event_timestamp"], r["processed_at"]
            sees = (p <= tick and t >= tick - window) if mode == "inclusive" else (tick - window <= t < tick)
            if sees:
                bad = r["severity"] == "critical"
                total, errors, new = want.get((tick, r["service_name"]), (0, 0, 0))
                want[(tick, r["service_name"])] = (total + 1, errors + bad, new + (bad and t >= tick - step))
    got = {(r.tick.replace(tzinfo=timezone.utc), r.service_name): (r.total, r.errors, r.new_errors)
           for r in replay_windows(frame(spark, rows), window, step, mode=mode).collect()}
    assert got == want


@pytest.mark.parametrize("mode", ["inclusive", "half_open"])
def test_running_sums_equal_spread_counts(spark, mode, monkeypatch):
    """Odd lookbacks together, bounds on both sides, events seen after their last tick, gaps over several blocks."""
    rows = [event(n, DAY + timedelta(milliseconds=(n * n * 7_919) % 900_000 + (5_000_000 if n % 31 == 0 else 0)), "error" if n % 3 else "info", f"s{n % 3}") for n in range(300)]
    for n, r in enumerate(rows):
        r["processed_at"] = r["event_timestamp"] + timedelta(milliseconds=(n * 613) % 70_000)
    lookbacks, step = [timedelta(seconds=s) for s in (20, 37.5, 600)], timedelta(seconds=15)
    found = []
    for few in (1_000, 0):
        monkeypatch.setattr(windows, "FEW_TICKS", few)
        monkeypatch.setattr(windows, "BLOCK_TICKS", 16)
        ticks = replay_windows(frame(spark, rows), lookbacks, step, mode=mode, start=DAY + timedelta(seconds=100), until=DAY + timedelta(seconds=5_200))
        found.append(sorted(map(tuple, ticks.collect())))
    assert found[0] == found[1] and len(found[0]) > 300


def test_rule_boundaries(spark):
    cases = [(20, 15, 1), (10, 5, 1), (10, 4, 0), (50, 0, 0), (4, 4, 0), (5, 5, 1)]
    schema = columns(tick=TIMESTAMP, window_us=LONG, tenant_id=STRING, service_name=STRING, total=LONG, errors=LONG, new_errors=LONG)
    windows = local_frame(spark, [{"tick": DAY, "window_us": 60_000_000, "tenant_id": "t", "service_name": f"s{i}", "total": t, "errors": e, "new_errors": e}
                                  for i, (t, e, _) in enumerate(cases)], schema)
    fired = {r.service_name: r.title for r in detect(windows, [Rule(), Rule(id="odd", kind="unheard-of"), Rule(id="wide", window=timedelta(hours=1))]).collect()}
    assert set(fired) == {f"s{i}" for i, c in enumerate(cases) if c[2]}
    assert fired["s0"] == "elevated error rate: 75% error rate on s0 (15 of 20 events over 1m0s)"


def test_page_limits_and_cursor_rules(spark):
    rows = frame(spark, [event(n, DAY + timedelta(seconds=n // 3)) for n in range(120)])
    assert [reads.page_limit(n) for n in (None, 0, 7, 500)] == [50, 50, 7, 500]
    seen, token, pages = [], "", 0
    while pages == 0 or token:
        page, token = reads.page_events(rows, limit=50, cursor=token)
        seen += [r.event_id for r in page.collect()]
        pages += 1
    assert pages == 3 and len(seen) == len(set(seen)) == 120 and seen == sorted(seen, reverse=True)
    assert reads.page_events(rows, limit=120)[1] == ""
    _, token = reads.page_events(rows, limit=5)
    for bad in ({"cursor": token, "offset": 3}, {"limit": -1}, {"offset": -1}, {"cursor": "???"}, {"filters": {"severity": "huge"}}):
        with pytest.raises(ValueError):
            reads.page_events(rows, **bad)


def test_partition_plan_edges(spark):
    names = ["telemetry_events_default", "telemetry_events_20260710", "telemetry_events_20260716", "telemetry_events_20260717",
             "telemetry_events_20260720", "telemetry_events_20260725", "telemetry_events_not_a_date", "other", "telemetry_events_20261345"]
    plan = retention.partition_plan(local_frame(spark, [{"name": n} for n in names], PARTITION), date(2026, 7, 25), timedelta(days=1), timedelta(days=7))
    assert [(r.action, r.name[-8:]) for r in plan.orderBy("step", "name").collect()] == [("create", "20260726"), ("drop", "20260710"), ("drop", "20260716")]


def test_drain_and_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    day = local_frame(spark, [{"name": "telemetry_events_20260720"}], PARTITION)
    rows = [event(n, DAY + timedelta(days=n % 3)) for n in range(9)]
    assert retention.route_events(frame(spark, rows), path, day) == ((3, 0), (6, 0))
    assert retention.default_partition_rows(frame(spark, rows), day).first()[0] == 6
    assert retention.drain_default(spark, path, date(2026, 7, 21)) == 3 and retention.drain_default(spark, path, date(2026, 7, 21)) == 0
    listed = {r.name: r.rows for r in retention.list_partitions(spark, path).collect()}
    assert listed == {"telemetry_events_20260720": 3, "telemetry_events_20260721": 3, "telemetry_events_default": 3}
    plan = retention.partition_plan(retention.list_partitions(spark, path), date(2026, 8, 1), timedelta(0), timedelta(days=10))
    assert retention.expire_partitions(path, plan) == 1
    assert tables.scan_events(spark, path).count() == 3
    with pytest.raises(ValueError):
        retention.expire_partitions(path, day.select(F.lit("drop").alias("action"), F.lit("telemetry_events_default").alias("name")))


def test_percentiles_are_nearest_rank(spark):
    schema = columns(path=STRING, v=LONG)
    tens = [{"path": "p", "v": n * 1000} for n in range(1, 11)]
    got = {r.q: r.v for r in reports.nearest_rank(local_frame(spark, tens, schema), ["path"], "v", (0.0, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0)).collect()}
    assert got == {0.0: 1000, 0.1: 1000, 0.5: 5000, 0.9: 9000, 0.95: 10000, 0.99: 10000, 1.0: 10000}


def test_status_distribution(spark):
    schema = columns(path=STRING, status=INT, latency_us=LONG, failed=BOOLEAN)
    rows = [{"path": "a", "status": 200, "latency_us": 1, "failed": False}] * 2 + [{"path": "b", "status": 503, "latency_us": 1, "failed": False}] * 2 + [
        {"path": "b", "status": None, "latency_us": None, "failed": True}] * 3
    got = {r.path: r for r in reports.status_distribution(local_frame(spark, rows, schema)).collect()}
    assert got["a"].is_clean and not got["b"].is_clean
    assert (got["b"].failures, got["b"].statuses_text, got["b"].statuses) == (3, "2×503", {503: 2})


def test_ties_have_one_winner(spark):
    rows = [event(1), event(1), event(1), event(2)]
    got = sorted(r.outcome for r in dedupe.label_outcomes(frame(spark, rows), ("processed_at",)).collect())
    assert got == ["duplicate", "duplicate", "stored", "stored"]
    # Where positions are unique, both ways give the same.
    placed = frame(spark, [event(n % 5, processed=DAY + timedelta(seconds=(n * 7) % 23)) for n in range(20)])
    known = frame(spark, [event(3)])
    both = [sorted((r.processed_at, r.event_id, r.outcome) for r in dedupe.label_outcomes(placed, ("processed_at",), known, is_unique=u).collect()) for u in (False, True)]
    assert both[0] == both[1] and sum(o == "stored" for _, _, o in both[0]) == 4
    twice = frame(spark, [event(1), event(1)])
    assert [r.outcome for r in dedupe.label_outcomes(frame(spark, [event(1)]), ("processed_at",), twice).collect()] == ["duplicate"]


def test_a_row_parked_during_a_drain_survives(spark, tmp_path, monkeypatch):
    path, day = str(tmp_path / "t"), DAY.date()
    dedupe.append_events(frame(spark, [event(1), event(2)]), path, which=tables.PARKED)
    append = retention.append_events

    def parked_meanwhile(rows, where):
        append(frame(spark, [event(3)]), path, which=tables.PARKED)
        return append(rows, where)

    monkeypatch.setattr(retention, "append_events", parked_meanwhile)
    assert retention.drain_default(spark, path, day) == 2
    monkeypatch.undo()
    assert [r.event_id[-1] for r in tables.read_telemetry(spark, path, tables.PARKED).collect()] == ["3"]
    assert retention.drain_default(spark, path, day) == 1 and retention.drain_default(spark, path, day) == 0
    assert tables.scan_events(spark, path).count() == 3


def test_backfill_refuses_a_filled_table(spark, tmp_path):
    path = str(tmp_path / "t")
    retention.backfill_partitions(frame(spark, [event(1)]), path)
    with pytest.raises(ValueError):
        retention.backfill_partitions(frame(spark, [event(2)]), path)
    assert tables.scan_events(spark, path).count() == 1


def test_everybody_waiting_is_listed(spark):
    waiting = spark.range(120).select(F.col("id"), F.lit("open").alias("status"), F.lit(None).cast("timestamp").alias("alerted_at"), F.lit(DAY).alias("opened_at"))
    assert reads.unalerted_incidents(waiting).count() == 120 and reads.unalerted_incidents(waiting, limit=7).count() == 7


@pytest.mark.parametrize("time", ["20240105T000000Z", "2024-W01-1T00:00:00Z", "2024-01-05 00:00:00+00:00", "2024-01-05T00:00:00"])
def test_cursor_times_are_strict(time):
    token = base64.urlsafe_b64encode(f"{time},x".encode()).decode().rstrip("=")
    with pytest.raises(ValueError):
        read_cursor(token)


def _rows_scanned(df):
    """Rows that the scans of a query hand on: those of the row groups that pass the filters."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()

    def walk(node):
        own = node.metrics().apply("numOutputRows").value() if node.nodeName().startswith("Scan parquet") else 0
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(plan)


def test_a_stray_old_row_reads_back_its_own_hour(spark, tmp_path, monkeypatch):
    """Thirty stored days; a batch of today with one row of the first day reads hardly more than the batch without it."""
    path = str(tmp_path / "t")
    conf, small = spark._jsc.hadoopConfiguration(), {"parquet.block.size": str(1 << 14), "parquet.page.size": str(1 << 12), "parquet.block.size.row.check.min": "100"}
    for key, value in small.items():
        conf.set(key, value)
    try:
        days = spark.range(30 * 4_000).select(
            F.concat(F.lit("id-"), "id").alias("event_id"),
            (F.lit(DAY) - F.make_dt_interval(F.floor(F.col("id") / 4_000).cast("int"), F.lit(0), F.lit(0), F.pmod("id", F.lit(4_000)) * 5)).alias("event_timestamp"))
        tables.write_daily(frame(spark, []).unionByName(days, allowMissingColumns=True), path)
    finally:
        for key in small:
            conf.unset(key)
    near = [event(n, DAY - timedelta(seconds=n)) for n in range(50)]
    reads_back, plain = [], dedupe._near
    monkeypatch.setattr(dedupe, "_near", lambda *a: reads_back.append(_rows_scanned(plain(*a))) or plain(*a))
    assert dedupe.append_events(frame(spark, near), path) == (50, 0)
    more = [event(n, DAY - timedelta(seconds=n)) for n in range(100, 150)]
    assert dedupe.append_events(frame(spark, [*more, event(7, DAY - timedelta(days=29))]), path) == (51, 0)
    # One row group more, of the thirty days that lie between.
    assert 0 < reads_back[1] < reads_back[0] + 600 < 4_000
    # As many days as no plan should list: the same outcome by a join.
    monkeypatch.setattr(dedupe, "MOST_DAYS_IN_PLAN", 0)
    assert dedupe.append_events(frame(spark, [*more, event(7, DAY - timedelta(days=29)), event(8, DAY - timedelta(days=3))]), path) == (1, 51)


def test_redeliveries_are_dropped_before_the_sink(spark, tmp_path):
    """Copies within the delay are dropped, across triggers too; the same id at another time is another event."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([event(1), event(1), event(2)], [event(1), event(2, DAY + timedelta(seconds=5)), event(3)]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = dedupe_stream(spark.readStream.schema(TELEMETRY).parquet(source), timedelta(minutes=5))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted((r.event_id[-1], r.event_timestamp.second) for r in spark.read.parquet(out).collect())
    assert got == [("1", 0), ("2", 0), ("2", 5), ("3", 0)]


def test_topic_files_grow_with_the_events(spark, tmp_path, monkeypatch):
    """No task writes a fixed share of the topic; copies of an event lie in one file, and two triggers read all."""
    rows = [{"event_id": n, "ts": datetime(2024, 1, 2) + timedelta(minutes=n), "user_id": n % 7, "event_type": "view", "value": 1.0, "props": '{"k": 1}'} for n in range(1, 1_001)]
    given = local_frame(spark, rows, columns(event_id=LONG, ts=TIMESTAMP, user_id=LONG, event_type=STRING, value=T.DoubleType(), props=STRING))
    given.write.parquet(str(tmp_path / "sf/events.parquet"))
    monkeypatch.setattr(queries, "EVENTS_PER_FILE", 50)
    monkeypatch.setattr(queries, "scratch_path", lambda _, label: str(tmp_path / label))
    stored = queries.QUERIES["read_event_stream"](spark, str(tmp_path / "sf"))
    topic = spark.read.parquet(str(tmp_path / "topic/topic")).withColumn("file", F.input_file_name())
    sizes = [r["count"] for r in topic.groupBy("file").count().collect()]
    assert len(sizes) == 20 and sum(sizes) == 1_050 and max(sizes) < 150
    assert topic.groupBy(F.expr("offset div 2")).agg(F.count_distinct("file").alias("files")).filter("files > 1").count() == 0
    assert len(list((tmp_path / "topic/checkpoint/commits").glob("[0-9]*"))) == 2
    refused = {n for n in range(1, 1_001) if any(n % k == 0 for k in (90, 130, 150, 170, 190, 210, 70, 230)) or (n % 250 and (n % 270 == 0 or n % 290 == 0))}
    assert sorted(int(r.event_id[-12:]) for r in stored.collect()) == [n for n in range(1, 1_001) if n not in refused]
