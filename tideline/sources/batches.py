"""Batch requests: one JSON envelope that holds many events, each judged on its own."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import contract
from tideline.operators.contract import FIELD_ERRORS, single_json


def explode_batches(requests: DataFrame, body: str = "body", max_events: int | None = None) -> DataFrame:
    """One row per event of an envelope ``{"events": [...]}`` with its ``index`` and its own JSON text ``raw``.

    With ``max_events`` a larger request is refused as a whole (an API would pass ``MAX_BATCH_EVENTS``).

    A request refused as a whole keeps a single row with a null index and a ``batch_error``.
    """
    kept = [c for c in requests.columns if c != body]
    parsed = requests.select(*kept, single_json(F.col(body)).alias("_doc"))
    fields = F.col("_doc").try_cast("map<string,variant>")
    opened = parsed.select(
        *kept,
        fields.alias("_fields"),
        F.try_variant_get("_doc", "$.events", "array<variant>").alias("_events"),
        F.schema_of_variant(F.try_variant_get("_doc", "$.events", "variant")).alias("_kind"),
    )
    size = F.coalesce(F.size("_events"), F.lit(0))
    refused = (
        F.when(F.col("_fields").isNull(), F.lit("invalid_json"))
        .when(F.exists(F.map_keys("_fields"), lambda k: k != "events"), F.lit("invalid_json"))
        .when(F.col("_kind").isNotNull() & ~F.col("_kind").startswith("ARRAY") & (F.col("_kind") != "VOID"),
              F.lit("invalid_json"))
        .when(F.col("_events").isNull() | (size == 0), F.lit("empty_batch"))
    )
    if max_events is not None:
        refused = refused.when(size > max_events, F.lit("batch_too_large"))
    judged = opened.select(*kept, "_events", refused.alias("batch_error"))
    items = F.when(F.col("batch_error").isNull(), F.col("_events"))
    exploded = judged.select(*kept, "batch_error", F.posexplode_outer(items).alias("index", "_item"))
    return exploded.select(*kept, "batch_error", "index", F.to_json("_item").alias("raw"))


def accept_batches(
    requests: DataFrame, now: datetime, max_future: timedelta | None = timedelta(minutes=5), max_age: timedelta | None = timedelta(days=7),
    max_events: int | None = None, request_trace: str = "request_trace",
) -> DataFrame:
    """The ingest side of one request: its events decoded strictly, traced, normalised, validated, and held to both time bounds.

    One row per event (and one per request refused as a whole) with ``decode_error`` and ``errors``; ``batch_result``
    sums them up.
    """
    events = contract.decode_events(explode_batches(requests, max_events=max_events), raw="raw", strict=True)
    events = contract.inherit_trace_id(contract.normalize_events(events), request_trace)
    return contract.check_time_bounds(contract.validate_events(events), now, max_future=max_future, max_age=max_age)


def batch_result(validated: DataFrame) -> DataFrame:
    """One row per request: counts, status and the per-index errors in request order.

    A request is one document, so its list of errors fits where the request did.
    """
    event = F.col("index").isNotNull()
    undecodable = F.col("decode_error").isNotNull()
    bad = event & (undecodable | (F.size("errors") > 0))
    item = F.when(bad, F.struct(
        F.col("index"),
        F.when(~undecodable & (F.col("event_id") != ""), F.col("event_id")).alias("event_id"),
        F.when(undecodable, F.lit("invalid_json")).otherwise(F.lit("validation_failed")).alias("error"),
        F.when(undecodable, F.col("decode_error")).alias("message"),
        F.when(~undecodable, F.col("errors")).otherwise(F.lit(None).cast(FIELD_ERRORS)).alias("details"),
    ))
    counted = validated.groupBy("request_id").agg(
        F.count_if(event & ~bad).cast("int").alias("accepted"),
        F.count_if(bad).cast("int").alias("rejected"),
        F.max("batch_error").alias("batch_error"),
        F.sort_array(F.collect_list(item)).alias("errors"),
    )
    status = F.when(F.col("accepted") > 0, F.lit("accepted")).otherwise(F.lit("rejected"))
    return counted.select("request_id", status.alias("status"), "accepted", "rejected", "batch_error", "errors")
