"""Counters of streams against counts of the same batches."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tideline.functions.frames import local_frame
from tideline.schema import TELEMETRY
from tideline.sources import streams
from tideline.streaming.ingest import start_ingest
from tideline.streaming.metrics import StreamCounters, counted, read_counters, stream_metrics

DAY = datetime(2026, 7, 20, 12, tzinfo=timezone.utc)


def event(n, severity="info"):
    return {
        "event_id": f"00000000-0000-4000-8000-{n:012d}", "schema_version": "1.0", "tenant_id": "t", "service_name": "s", "environment": "prod", "event_type": "request",
        "severity": severity, "event_timestamp": DAY + timedelta(seconds=n), "trace_id": "", "attributes": "{}", "received_at": DAY, "processed_at": DAY,
    }


def test_three_triggers(spark, tmp_path):
    counters = StreamCounters(spark, str(tmp_path / "counters"))
    assert read_counters(spark, counters.path).collect() == []
    spark.streams.addListener(counters)
    batches = [[event(1), event(2, "error"), event(2, "error")], [event(3, "critical")], [event(2, "error"), event(5), event(6, "bad")]]
    try:
        for rows in batches:
            # One start a batch, from the checkpoint of the last; the topic has one file more each time.
            sent = streams.to_stream_records(local_frame(spark, rows, TELEMETRY), "topic").withColumns(
                {"partition": F.lit(0), "offset": F.monotonically_increasing_id(), "timestamp": F.lit(DAY)})
            sent.coalesce(1).write.mode("append").parquet(str(tmp_path / "topic"))
            topic = streams.read_event_stream(spark, "parquet", str(tmp_path / "topic"))
            start_ingest(topic, str(tmp_path / "table"), str(tmp_path / "refused"), str(tmp_path / "c1"), clock=lambda: DAY, available_now=True,
                         on_outcomes=counters.sink("c1")).awaitTermination()
            local_frame(spark, rows, TELEMETRY).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
            seen = counted(spark.readStream.schema(TELEMETRY).parquet(str(tmp_path / "events")), "cycle", failing=F.col("severity").isin("error", "critical"))
            seen.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(counters)
    rows = read_counters(spark, counters.path).collect()
    assert {(r.name, r.batch_id, r.outcome, r.records) for r in rows} == {
        *(("cycle", b, "rows", n) for b, n in enumerate((3, 1, 3))), *(("cycle", b, "failing", n) for b, n in enumerate((2, 1, 1))),
        *(("ingest", b, "stored", n) for b, n in enumerate((2, 1, 1))), *(("ingest", b, "duplicate", n) for b, n in enumerate((1, 0, 1))),
        *(("ingest", b, "invalid", n) for b, n in enumerate((0, 0, 1)))}
    assert all((r.took_us or 0) > 0 for r in rows if r.name == "cycle")
    # A trigger that is told again counts once.
    counters.sink("c1")(0, {"stored": 2, "duplicate": 1, "invalid": 0})
    summed = {(r.name, r.outcome): (r.triggers, r.records) for r in stream_metrics(read_counters(spark, counters.path)).collect()}
    assert summed == {("cycle", "rows"): (3, 7), ("cycle", "failing"): (3, 4), ("ingest", "stored"): (3, 4), ("ingest", "duplicate"): (3, 2), ("ingest", "invalid"): (3, 1)}
