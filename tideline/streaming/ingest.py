"""From the topic to the day-partitioned table, exactly once per key."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.contract import check_time_bounds, decode_events, normalize_events, split_valid, validate_events
from tideline.operators.dedupe import append_events
from tideline.sources.tables import staged

LOG_POSITION = ("topic", "partition", "offset")


def checked(records: DataFrame, now: datetime, max_future: timedelta | None = timedelta(minutes=5)) -> DataFrame:
    """Decode, normalise and validate topic records. Only the future bound applies on this side."""
    events = normalize_events(decode_events(records))
    return check_time_bounds(validate_events(events), now, max_future=max_future)


def store_batch(records: DataFrame, batch_id: int, table_path: str, quarantine_path: str, now: datetime, run: str = "run") -> dict[str, int]:
    """One micro-batch: append what is valid, set the rest aside, and count the outcomes.

    Safe to repeat. Valid rows are inserted if absent, and the refused ones overwrite the folder of
    their run and batch; ``run`` stands for one checkpoint, so batch 0 of another never replaces them. The record timestamp is when the event was received; storing it makes it processed.
    """
    with staged(checked(records, now), "ingest") as batch:
        accepted, refused = split_valid(batch)
        seen = Observation()
        refused = refused.observe(seen, F.count(F.lit(1)).alias("rows"))
        refused.write.mode("overwrite").parquet(f"{quarantine_path.rstrip('/')}/run={run}/batch_id={batch_id}")
        rows = accepted.withColumns({
            "received_at": F.coalesce("timestamp", F.lit(now)), "processed_at": F.lit(now),
        })
        appended = append_events(rows, table_path, order_by=LOG_POSITION, is_staged=True)
        return {"stored": appended.inserted, "duplicate": appended.duplicate, "invalid": seen.get["rows"]}


def start_ingest(
    records: DataFrame, table_path: str, quarantine_path: str, checkpoint: str,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), available_now: bool = False,
    on_outcomes: Callable[[int, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Run the ingest stream. The checkpoint advances only after the batch is in the table.

    No watermark stands before the table: a late event is stored however old it is.
    """
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def sink(batch: DataFrame, batch_id: int) -> None:
        outcomes = store_batch(batch, batch_id, table_path, quarantine_path, clock(), run)
        if on_outcomes is not None:
            on_outcomes(batch_id, outcomes)

    writer = records.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_quarantine(spark: SparkSession, quarantine_path: str) -> DataFrame:
    """Every refused record once, however many runs refused it: one row per log position."""
    return spark.read.parquet(quarantine_path).dropDuplicates(list(LOG_POSITION)).drop("run", "batch_id")


def dedupe_stream(events: DataFrame, delay: timedelta) -> DataFrame:
    """Drop redeliveries that arrive close together before they reach the sink.

    Only an optimisation for streams whose late events may be lost; the sink's insert-if-absent is
    what keeps the table free of duplicates.
    """
    return events.withWatermark("event_timestamp", f"{int(delay.total_seconds())} seconds").dropDuplicatesWithinWatermark(
        ["event_timestamp", "event_id"]
    )
