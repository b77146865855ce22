"""Request logs as telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import floor_div
from tideline.schema import SCHEMA_VERSIONS


def severity_from_status(status: Column) -> Column:
    return F.when(status >= 500, F.lit("error")).when(status >= 400, F.lit("warn")).otherwise(F.lit("info"))


def requests_to_events(requests: DataFrame) -> DataFrame:
    """One completed-request event per log row.

    Needs event_id, tenant_id, service_name, environment, at, trace_id, method, route, status,
    latency_us, outcome, object_id and detail (blank when there is nothing to say).
    """
    attributes = F.to_json(F.struct(
        F.nullif("detail", F.lit("")).alias("detail"), F.col("method").alias("http_method"),
        F.col("route").alias("http_route"), F.col("status").alias("http_status_code"),
        floor_div(F.col("latency_us"), 1000).alias("latency_ms"), "object_id", "outcome",
    ))
    return requests.select(
        "event_id", F.lit(SCHEMA_VERSIONS[0]).alias("schema_version"), "tenant_id", "service_name", "environment",
        F.lit("request.completed").alias("event_type"), severity_from_status(F.col("status")).alias("severity"),
        F.col("at").alias("event_timestamp"), "trace_id", attributes.alias("attributes"),
    )
