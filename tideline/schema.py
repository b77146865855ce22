"""Schemas, closed vocabularies and defaults shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: closed vocabularies and limits of the event contract -------------------------
SCHEMA_VERSIONS = ("1.0",)
SEVERITIES = ("debug", "info", "warn", "error", "critical")  # least to most urgent
ERROR_SEVERITIES = ("error", "critical")
INCIDENT_STATUSES = ("open", "acknowledged", "resolved")
NOTIFICATION_STATUSES = ("sent", "failed")
REMEDIATION_STATUSES = ("pending", "approved", "rejected", "timed_out", "succeeded", "failed", "skipped")
STEP_KINDS = ("noop", "webhook")
STEP_MODES = ("auto", "approval")
DEFAULT_ENVIRONMENT = "unknown"
MAX_IDENTIFIER_BYTES = 128
MAX_BATCH_EVENTS = 1000
FINGERPRINT_SEPARATOR = "\u001f"
NOTIFICATION_NAMESPACE = "1b4e28ba-2fa1-11d2-883f-0016d3cca427"
ACTION_NAMESPACE = "6f1c2d3e-4a5b-11ee-be56-0242ac120002"
# Ours: incidents get a name-based id so that a replay reproduces it.
INCIDENT_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
PAGE_DEFAULT = 50
PARTITION_PREFIX = "telemetry_events_"
DEFAULT_PARTITION = "telemetry_events_default"

WIRE_FIELDS = (
    "event_id", "schema_version", "tenant_id", "service_name", "environment",
    "event_type", "severity", "timestamp", "trace_id", "attributes",
)
EVENT_KEY = ("event_timestamp", "event_id")
# -------------------------------------------------------------------------------------------------


STRING, INT, LONG, DOUBLE, BOOLEAN = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
BINARY, DATE, TIMESTAMP = T.BinaryType(), T.DateType(), T.TimestampType()


def columns(**types: T.DataType) -> T.StructType:
    """A schema from ``name=type`` pairs, in order."""
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


TELEMETRY = columns(
    event_id=STRING, schema_version=STRING, tenant_id=STRING, service_name=STRING, environment=STRING,
    event_type=STRING, severity=STRING, event_timestamp=TIMESTAMP, trace_id=STRING, attributes=STRING,
    received_at=TIMESTAMP, processed_at=TIMESTAMP,
)
HEADERS = T.ArrayType(columns(key=STRING, value=BINARY))
STREAM_RECORD = columns(
    key=BINARY, value=BINARY, topic=STRING, partition=INT, offset=LONG, timestamp=TIMESTAMP, headers=HEADERS,
)
INCIDENT = columns(
    id=STRING, fingerprint=STRING, tenant_id=STRING, service_name=STRING, rule_id=STRING, title=STRING,
    severity=STRING, status=STRING, event_count=LONG, first_seen_at=TIMESTAMP, last_seen_at=TIMESTAMP,
    opened_at=TIMESTAMP, acknowledged_at=TIMESTAMP, resolved_at=TIMESTAMP, auto_resolved=BOOLEAN,
    updated_at=TIMESTAMP, details=STRING,
)
# As stored: with the markers of the pollers that alert and remediate.
STORED_INCIDENT = T.StructType([*INCIDENT.fields, *columns(alerted_at=TIMESTAMP, remediated_at=TIMESTAMP).fields])
NOTIFICATION = columns(
    id=STRING, incident_id=STRING, level=INT, target=STRING, contact=STRING, channel=STRING, status=STRING,
    detail=STRING, sent_at=TIMESTAMP,
)
REMEDIATION_ACTION = columns(
    id=STRING, incident_id=STRING, runbook_id=STRING, step_index=INT, step_name=STRING, action_kind=STRING,
    mode=STRING, status=STRING, actor=STRING, detail=STRING, created_at=TIMESTAMP, updated_at=TIMESTAMP,
)
OPERATOR_ACTION = columns(action_id=STRING, target=STRING, action=STRING, actor=STRING, at=TIMESTAMP)
DETECTION = columns(
    tick=TIMESTAMP, rule_id=STRING, tenant_id=STRING, service_name=STRING, fingerprint=STRING, title=STRING,
    severity=STRING, event_count=LONG, new_event_count=LONG, details=STRING,
)
POLICY_LEVEL = columns(
    level=INT, target=STRING, ack_timeout_us=LONG, contacts=T.ArrayType(columns(name=STRING, address=STRING)),
    start=TIMESTAMP, shift_us=LONG,
)
RUNBOOK_STEP = columns(
    ordinal=INT, runbook_id=STRING, name=STRING, match_rule_id=STRING, match_service=STRING, match_severity=STRING,
    approval_timeout_us=LONG, step_index=INT, step_name=STRING, kind=STRING, mode=STRING, target=STRING,
    params=T.MapType(STRING, STRING),
)
RULE = columns(
    id=STRING, name=STRING, kind=STRING, window_us=LONG, threshold=DOUBLE, min_events=LONG,
    incident_severity=STRING, window_text=STRING,
)
PARTITION = columns(name=STRING, event_date=DATE, rows=LONG, bytes=LONG)
LATENCY_SAMPLE = columns(path=STRING, work=STRING, status=INT, latency_us=LONG, failed=BOOLEAN, elapsed_us=LONG)

TABLES = {
    "telemetry_events": TELEMETRY,
    "incidents": STORED_INCIDENT,
    "notifications": NOTIFICATION,
    "remediation_actions": REMEDIATION_ACTION,
}
