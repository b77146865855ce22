"""The query catalogue: every operator over the given tables, by name.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame. Timestamps leave as zone-less UTC values.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import text
from tideline.functions.cursor import decode_cursor, encode_cursor
from tideline.functions.frames import instant
from tideline.operators import constraints, contract, dedupe, detect, incidents, oncall, reads, remediation, reports, requests, retention, stored_pages
from tideline.operators.windows import replay_windows, window_stats as window_stats_of
from tideline.schema import DETECTION, OPERATOR_ACTION, TELEMETRY
from tideline.session import configure, scratch_path
from tideline.sources import batches, config, driver_tables as given, streams, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SINCE = datetime(2024, 1, 20)
COUNT_SINCE = datetime(2024, 1, 22)
UNTIL = datetime(2024, 1, 25, 12)
MAX_AGE = timedelta(days=7)
TODAY = date(2024, 1, 28)


def plain(df: DataFrame) -> DataFrame:
    """Top-level timestamps as zone-less values."""
    zoned = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in zoned else F.col(c) for c in df.columns])


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows as a table in the shared folder.

    Incidents and what follows from them are far smaller than the events, and most queries below use
    them several times: writing them once cuts the lineage instead of repeating the detection.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _incidents(spark, sf):
    return written(given.incidents(spark, sf), "incidents")


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return plain(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


# --- sources, contract -------------------------------------------------------------------------------

@query
def scan_events(spark, sf):
    return given.telemetry(spark, sf)


@query
def scan_incidents(spark, sf):
    """Recorded, compacted, and recorded again with the alert marker: readers see the last state."""
    path = scratch_path(spark, "incident-table")
    found = _incidents(spark, sf)
    tables.record_incidents(found, path)
    tables.compact_changes(spark, "incidents", path)
    marked = found.filter("event_count % 3 = 0").withColumns({"alerted_at": F.col("updated_at"), "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 SECOND")})
    tables.record_incidents(marked, path)
    return tables.scan_incidents(spark, path).drop("details")


@query
def scan_notifications(spark, sf):
    """Recorded twice: a page is in the table once."""
    path = scratch_path(spark, "notification-table")
    notes = written(_notifications(_incidents(spark, sf)), "notifications")
    for _ in range(2):
        tables.record_notifications(notes, path)
    return tables.scan_notifications(spark, path).withColumn("error", F.get_json_object("detail", "$.error")).drop("detail")


@query
def scan_actions(spark, sf):
    """First what was so half-way through the month, then all: readers see the last status."""
    path = scratch_path(spark, "action-table")
    log = written(_remediation_log(_incidents(spark, sf)), "log")
    tables.record_actions(remediation.latest_action_status(log.filter(F.col("at") <= instant(PENDING_AT))), path)
    tables.record_actions(remediation.latest_action_status(log), path)
    return tables.scan_actions(spark, path).drop("detail")


@query
def stored_window_stats(spark, sf):
    """One window over the day table: the day of the window is read, and of it the row groups of its hours."""
    return window_stats_of(tables.scan_events(spark, _stored(spark, sf, "window")), SINCE, COUNT_SINCE)


@query
def write_event_stream(spark, sf):
    records = streams.to_stream_records(given.telemetry(spark, sf), "telemetry")
    return records.select(
        F.col("key").cast("string").alias("record_key"), F.col("value").cast("string").alias("record_value"), "topic",
        streams.header_value("headers", streams.SCHEMA_VERSION_HEADER).alias("version"),
        streams.header_value("headers", "traceparent").alias("traceparent"), F.size("headers").alias("n_headers"),
    )


def _decoded(spark, sf, strict):
    decoded = contract.decode_events(given.stream_records(spark, sf), strict=strict)
    return decoded.select(
        "offset", "event_id", "tenant_id", "severity", "event_timestamp", "attributes", "decode_error"
    )


@query
def decode_strict(spark, sf):
    return _decoded(spark, sf, True)


@query
def decode_lenient(spark, sf):
    return _decoded(spark, sf, False)


@query
def normalize_events(spark, sf):
    return contract.normalize_events(given.dirty_events(spark, sf)).select(
        "offset", "event_id", "schema_version", "tenant_id", "service_name", "environment", "event_type", "severity",
        "event_timestamp", "trace_id", "attributes",
    )


@query
def inherit_trace_id(spark, sf):
    with_request = given.telemetry(spark, sf).withColumn("request_trace", F.concat(F.lit("req-"), F.substring("event_id", -4, 4)))
    return contract.inherit_trace_id(with_request, "request_trace").select("event_id", "trace_id")


def _validated(spark, sf):
    return contract.validate_events(contract.normalize_events(given.dirty_events(spark, sf)))


@query
def validate_events(spark, sf):
    return _validated(spark, sf).select("offset", F.posexplode("errors").alias("pos", "e")).select(
        "offset", "pos", "e.field", "e.message"
    )


@query
def check_time_bounds(spark, sf):
    bounded = contract.check_time_bounds(_validated(spark, sf), given.NOW, max_age=MAX_AGE)
    return bounded.select("offset", F.posexplode("errors").alias("pos", "e")).select("offset", "pos", "e.field", "e.message")


def _accepted(spark, sf):
    return contract.split_valid(contract.check_time_bounds(_validated(spark, sf), given.NOW))[0]


@query
def split_valid(spark, sf):
    return _accepted(spark, sf).select("offset", "event_id", "tenant_id", "event_timestamp")


@query
def quarantine(spark, sf):
    from tideline.streaming.ingest import checked

    refused = contract.quarantine(checked(given.stream_records(spark, sf), given.NOW))
    return refused.select("reason", "error", "topic", "partition", "offset", "key", "value_bytes", F.size("errors").alias("n_errors"))


def _batch_items(spark, sf):
    return batches.explode_batches(given.batch_requests(spark, sf))


@query
def read_event_batches(spark, sf):
    items = _batch_items(spark, sf)
    event_id = F.get_json_object("raw", "$.event_id")
    return items.select("request_id", "index", "batch_error", event_id.alias("event_id"))


@query
def batch_result(spark, sf):
    judged = batches.accept_batches(given.batch_requests(spark, sf), given.NOW, max_age=MAX_AGE)
    result = batches.batch_result(judged)
    named = F.transform("errors", lambda e: F.concat_ws("|", e["index"].cast("string"), e["error"], e["message"]))
    return result.select("request_id", "status", "accepted", "rejected", "batch_error", F.array_join(named, ";").alias("errors"))


@query
def severity_from_status(spark, sf):
    return requests.requests_to_events(given.request_log(spark, sf)).select(
        "event_id", "severity", "event_type", "event_timestamp", "attributes"
    )


@query
def partition_key_and_fingerprint(spark, sf):
    service = [F.col("tenant_id"), F.col("service_name")]
    return given.telemetry(spark, sf).select(*service).distinct().select(
        text.partition_key(*service).alias("partition_key"),
        text.fingerprint(F.lit("error_rate"), *service).alias("fingerprint"),
        text.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", text.fingerprint(F.lit("error_rate"), *service)).alias("named_id"),
    )


# --- storage ------------------------------------------------------------------------------------------

@query
def dedupe_events(spark, sf):
    kept = dedupe.dedupe_events(_accepted(spark, sf), order_by=("offset",))
    return kept.select("event_timestamp", "event_id", "offset", "copy")


@query
def store_outcomes(spark, sf):
    """Outcome per row against a table that already holds the first half of the month."""
    arriving = _accepted(spark, sf)
    stored = given.telemetry(spark, sf).filter(F.col("event_timestamp") < instant(SINCE))
    return dedupe.label_outcomes(arriving, ("offset",), stored, is_unique=True).select("offset", "outcome")


@query
def insert_if_absent(spark, sf):
    stored = given.telemetry(spark, sf).filter(F.col("event_timestamp") < instant(SINCE))
    return dedupe.insert_if_absent(given.telemetry(spark, sf), stored).select("event_id", "event_timestamp")


@query
def append_events(spark, sf):
    """Append the accepted rows, append them again, read the table back."""
    path = scratch_path(spark, "append")
    arriving = _accepted(spark, sf)
    dedupe.append_events(arriving, path, order_by=("offset",))
    dedupe.append_events(arriving, path, order_by=("offset",))
    return tables.read_table(spark, "telemetry_events", path).select(
        "event_id", "event_timestamp", "tenant_id", "severity", "event_date"
    )


@query
def pipeline_metrics(spark, sf):
    labelled = dedupe.label_outcomes(_accepted(spark, sf), ("offset",), is_unique=True)
    took = F.unix_micros("processed_at") - F.unix_micros("received_at")
    return reports.pipeline_metrics(labelled.withColumn("elapsed_us", took))


# --- windows, detection, incidents ---------------------------------------------------------------------

@query
def window_stats(spark, sf):
    return window_stats_of(given.telemetry(spark, sf), SINCE, COUNT_SINCE)


@query
def window_stats_by_tick(spark, sf):
    return given.windows(spark, sf)


@query
def replay_windows_half_open(spark, sf):
    return replay_windows(given.telemetry(spark, sf), timedelta(hours=48), timedelta(hours=12), mode="half_open")


@query
def replay_long_lookbacks(spark, sf):
    """Lookbacks of 12 and 120 ticks, as running sums of what each tick gains and loses."""
    return replay_windows(
        given.telemetry(spark, sf), [timedelta(days=1), timedelta(days=10)], timedelta(hours=2), start=datetime(2024, 1, 10), until=datetime(2024, 2, 5)
    )


@query
def detect_error_rate(spark, sf):
    return _detections_flat(given.detections(spark, sf))


def _detections_flat(found):
    return found.select(
        "tick", "rule_id", "tenant_id", "service_name", "fingerprint", "title", "severity", "event_count", "new_event_count",
        F.get_json_object("details", "$.total_events").cast("bigint").alias("total_events"),
        F.get_json_object("details", "$.window").alias("window_text"),
        F.round(F.get_json_object("details", "$.error_rate").cast("double"), 9).alias("error_rate"),
        F.get_json_object("details", "$.threshold").cast("double").alias("threshold"),
    )


@query
def rules_x_windows(spark, sf):
    return _detections_flat(detect.detect(given.windows(spark, sf), given.SPARSE_RULES))


@query
def rules_two_lookbacks(spark, sf):
    """A rule set with two lookbacks, from one pass over the events."""
    start, until = given.span(spark, sf)
    found = detect.evaluate_rules(given.telemetry(spark, sf), given.TWO_LOOKBACKS, given.STEP, start=start, until=until)
    return _detections_flat(found)


@query
def incident_islands(spark, sf):
    """Grouping and auto-resolve alone."""
    bounds = given.span(spark, sf)
    found = incidents.incidents_from_detections(given.detections(spark, sf, bounds), given.STEP, given.RESOLVE_AFTER, bounds[1])
    return found.drop("details")


@query
def incidents_with_actions(spark, sf):
    return given.incidents(spark, sf).drop("details")


@query
def cycle_metrics(spark, sf):
    found = given.detections(spark, sf)
    found = written(found, "detections")
    return incidents.cycle_metrics(
        found, incidents.incidents_from_detections(found, given.STEP, given.RESOLVE_AFTER, given.span(spark, sf)[1])
    )


def _open_incidents(spark, sf):
    """What the detector alone leaves, as if nobody had acted: the input of the operator log."""
    found = incidents.incidents_from_detections(given.detections(spark, sf), given.STEP, given.RESOLVE_AFTER, given.span(spark, sf)[1])
    found = written(found, "open-incidents")
    return found.withColumn("status", F.when(F.pmod("event_count", F.lit(4)) == 0, F.col("status")).otherwise(F.lit("open")))


def _actions_by_id(stored):
    """Three requests per incident: two of one kind and one of the other; every ninth names a stranger."""
    n = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")
    base = stored.select("id", "opened_at", "event_count", n)
    kind = F.pmod(F.col("event_count") + F.col("n"), F.lit(2))
    return base.select(
        F.concat_ws("#", "id", F.col("n").cast("string")).alias("action_id"),
        F.when(F.pmod(F.col("event_count") * 3 + F.col("n"), F.lit(9)) == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("target"),
        F.when(kind == 0, F.lit("resolve")).otherwise(F.lit("acknowledge")).alias("action"), F.lit("someone").alias("actor"),
        F.timestamp_micros(F.unix_micros("opened_at") + F.pmod(F.col("event_count") * (F.col("n") + 2), F.lit(5)) * F.lit(3_600_000_000)).alias("at"),
    )


@query
def apply_actions_transitions(spark, sf):
    stored = _open_incidents(spark, sf)
    return incidents.apply_actions(stored, _actions_by_id(stored))[0]


@query
def apply_actions_rejected(spark, sf):
    stored = _open_incidents(spark, sf)
    return incidents.apply_actions(stored, _actions_by_id(stored))[1]


@query
def incident_status(spark, sf):
    stored = _open_incidents(spark, sf)
    asked = _actions_by_id(stored).select(F.col("target").alias("id")).distinct()
    return incidents.incident_status(stored, asked)


def _damaged_incidents(spark, sf):
    found = _incidents(spark, sf)

    def every(k):
        return F.pmod("event_count", F.lit(k)) == 0

    return found.withColumns({
        "title": F.when(every(3), F.lit("  ")).otherwise(F.col("title")),
        "status": F.when(every(5), F.lit("lost")).otherwise(F.col("status")),
        "severity": F.when(every(7), F.lit("huge")).otherwise(F.col("severity")),
        "rule_id": F.when(every(4), F.lit("")).otherwise(F.col("rule_id")),
    })


@query
def validate_incidents(spark, sf):
    return incidents.validate_incidents(_damaged_incidents(spark, sf)).select(
        "id", F.array_join("problems", "; ").alias("problems")
    )


@query
def check_constraints(spark, sf):
    found = _incidents(spark, sf)
    spoilt = F.pmod("level", F.lit(2)) == 0
    notes = _notifications(found).withColumns({"contact": F.when(spoilt, F.lit("")).otherwise(F.col("contact")), "status": F.when(spoilt, F.lit("lost")).otherwise(F.col("status"))})
    first = F.col("step_index") == 1
    actions = _remediation(found).withColumns({"mode": F.when(first, F.lit("never")).otherwise(F.col("mode")), "step_name": F.when(first, F.lit("")).otherwise(F.col("step_name"))})
    checked = {"incidents": _damaged_incidents(spark, sf), "telemetry_events": _validated(spark, sf), "notifications": notes, "remediation_actions": actions}
    reports_ = [constraints.check_constraints(df, name).select(F.lit(name).alias("table_name"), "*") for name, df in checked.items()]
    return reduce(DataFrame.unionByName, reports_)


@query
def check_references(spark, sf):
    """Some incidents are there twice, an hour apart, and some are gone; some steps were recorded twice."""
    found = _incidents(spark, sf)
    hour = F.expr("INTERVAL 1 HOUR")
    again = found.filter("event_count % 5 = 0").withColumns({"id": F.concat(F.lit("copy-"), "id"), "opened_at": F.col("opened_at") + hour, "resolved_at": F.col("resolved_at") + hour})
    actions = written(_remediation(found), "actions")
    repeated = actions.filter("step_index = 2").withColumn("id", F.concat(F.lit("copy-"), "id"))
    return constraints.check_references(
        found.unionByName(again).filter("event_count % 7 <> 3"), actions.unionByName(repeated), _notifications(found)
    )


# --- escalation and remediation --------------------------------------------------------------------------

def _pages(found):
    return oncall.escalation_timeline(found, given.levels(found.sparkSession), given.POLL)


@query
def on_call_at(spark, sf):
    """Who of each level was on call when each incident opened."""
    opened = _incidents(spark, sf).select("id", "opened_at", F.explode(oncall.policy_value(given.levels(spark))).alias("rung"))
    contact = oncall.on_call_at(F.col("rung"), F.col("opened_at"))
    return opened.select("id", F.col("rung.level").alias("level"), contact["name"].alias("contact"), F.col("rung.offset_us").alias("offset_us"))


def _document(spark, text, label):
    """A configuration file in the shared folder."""
    path = scratch_path(spark, label)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(path)
    return path


@query
def load_policy(spark, sf):
    """Every level of the policy file for every incident, with who was on call when it opened."""
    levels = config.load_policy(spark, _document(spark, given.POLICY, "policy"))
    opened = _incidents(spark, sf).select("id", "opened_at", F.explode(oncall.policy_value(levels)).alias("rung"))
    return opened.select(
        "id", F.col("rung.level").alias("level"), F.col("rung.target").alias("target"),
        oncall.on_call_at(F.col("rung"), F.col("opened_at"))["name"].alias("contact"), F.col("rung.offset_us").alias("offset_us"),
    )


@query
def load_runbooks(spark, sf):
    """The runbook of the catalog file that fits each incident."""
    steps = config.load_runbooks(spark, _document(spark, given.CATALOG, "catalog"))
    return remediation.match_runbook(_varied(spark, sf), steps).select("id", "runbook_id", F.size("steps").alias("n_steps"))


@query
def first_ack_or_resolve(spark, sf):
    return oncall.first_ack_or_resolve(_incidents(spark, sf)).select("id", "stopped_at", "signalled_at")


@query
def alert_starts(spark, sf):
    found = _incidents(spark, sf)
    marked = found.filter("event_count % 6 = 0").select(F.col("id").alias("incident_id"))
    return oncall.alert_starts(found, marked, given.POLL).select("id", "started_at")


@query
def escalation_timeline(spark, sf):
    return _pages(_incidents(spark, sf)).drop("title", "severity")


def _notifications(found):
    pages = _pages(found)
    return oncall.notification_rows(pages, given.deliveries(pages))


@query
def notification_rows(spark, sf):
    return _notifications(_incidents(spark, sf)).withColumn("error", F.get_json_object("detail", "$.error")).drop("detail")


def _varied(spark, sf):
    """Incidents of two severities, some of a rule no runbook is for."""
    return _incidents(spark, sf).withColumns({
        "severity": F.when(F.pmod("event_count", F.lit(5)) == 0, F.lit("critical")).otherwise(F.col("severity")),
        "rule_id": F.when(F.pmod("event_count", F.lit(7)) == 0, F.lit("another")).otherwise(F.col("rule_id")),
    })


@query
def match_runbook(spark, sf):
    return remediation.match_runbook(_varied(spark, sf), given.steps(spark)).select(
        "id", "runbook_id", F.size("steps").alias("n_steps")
    )


@query
def remediation_starts(spark, sf):
    return remediation.remediation_starts(_varied(spark, sf), given.steps(spark), poll=given.POLL).select(
        "id", "started_at", "outcome", "runbook_id"
    )


def _remediation_log(found):
    steps = given.steps(found.sparkSession)
    return remediation.remediation_timeline(found, steps, given.decisions(found), given.outcomes(found), given.POLL)


def _remediation(found):
    return remediation.latest_action_status(_remediation_log(found))


@query
def remediation_timeline(spark, sf):
    return _remediation_log(_incidents(spark, sf)).drop("detail", "id")


@query
def latest_action_status(spark, sf):
    return _remediation(_incidents(spark, sf)).drop("detail")


@query
def step_outcome(spark, sf):
    return _remediation(_incidents(spark, sf)).filter("status IN ('succeeded', 'failed')").select(
        "incident_id", "step_index", "status", F.get_json_object("detail", "$.error").alias("error"),
        F.get_json_object("detail", "$.executed").alias("executed"),
    )


@query
def decide(spark, sf):
    found = _incidents(spark, sf)
    return remediation.decide(given.decisions(found), _remediation_log(found))


@query
def decisions_asof(spark, sf):
    found = _incidents(spark, sf)
    return remediation.decisions_asof(given.decisions(found), _remediation_log(found))


@query
def pending_action(spark, sf):
    """What was waiting for a decision half-way through the month."""
    so_far = _remediation_log(_incidents(spark, sf)).filter(F.col("at") <= instant(PENDING_AT))
    return reads.pending_action(remediation.latest_action_status(so_far)).select("incident_id", "step_index", "step_name", "updated_at")


PENDING_AT = datetime(2024, 1, 17, 2, 30)


@query
def incident_detail(spark, sf):
    found = _incidents(spark, sf)
    detail = reads.incident_detail(found, _notifications(found), _remediation(found))
    pages = F.transform("timeline", lambda p: F.concat(F.lit("L"), p["level"], F.lit(":"), p["target"], F.lit(":"), p["status"]))
    steps = F.transform("actions", lambda a: F.concat(a["step_index"], F.lit(":"), a["status"]))
    return detail.select("id", "status", "event_count", F.array_join(pages, ";").alias("timeline"), F.array_join(steps, ";").alias("actions"), "pending_step")


@query
def cascade_filter(spark, sf):
    found = _incidents(spark, sf)
    return reads.cascade_filter(_notifications(found), found.filter("event_count % 3 <> 0")).select("id", "incident_id")


# --- reads ---------------------------------------------------------------------------------------------

@query
def filter_events(spark, sf):
    found = reads.filter_events(given.telemetry(spark, sf), tenant="tenant-1", severity="error", since=SINCE, until=UNTIL)
    return found.select("event_id", "service_name", "event_timestamp")


@query
def trace_events(spark, sf):
    return reads.trace_events(given.telemetry(spark, sf), "trace-7").select("event_id", "trace_id", "event_timestamp")


@query
def filter_incidents(spark, sf):
    return reads.filter_incidents(_incidents(spark, sf), status="resolved", tenant="tenant-2", severity="error").select("id", "service_name")


@query
def get_incident(spark, sf):
    found = _incidents(spark, sf)
    first = found.agg(F.min("id")).scalar()
    return reads.get_incident(found, first).select("id", "service_name", "status", "event_count")


@query
def page_events(spark, sf):
    """The third page of twenty, reached by its cursors."""
    events, token = given.telemetry(spark, sf), ""
    for _ in range(3):
        page, token = reads.page_events(events, {"tenant": "tenant-0"}, limit=20, cursor=token)
    return page.select("event_timestamp", "event_id", "severity")


@query
def page_events_offset(spark, sf):
    return reads.page_events(given.telemetry(spark, sf), limit=20, offset=40)[0].select("event_timestamp", "event_id")


@query
def stored_page_events(spark, sf):
    """The third page of twenty of the stored table, found from the newest day backwards."""
    path, token = _stored(spark, sf, "pages"), ""
    for _ in range(3):
        page, token = stored_pages.page_stored_events(spark, path, {"tenant": "tenant-0"}, limit=20, cursor=token)
    return page.select("event_timestamp", "event_id", "severity")


@query
def stored_trace(spark, sf):
    return stored_pages.stored_trace(spark, _stored(spark, sf, "trace"), "trace-7").select("event_id", "trace_id", "event_timestamp")


@query
def page_incidents(spark, sf):
    found = _incidents(spark, sf)
    _, token = reads.page_incidents(found, limit=15)
    return reads.page_incidents(found, limit=15, cursor=token)[0].select("last_seen_at", "id", "status")


@query
def cursor_codec(spark, sf):
    tokens = given.telemetry(spark, sf).select("event_id", "event_timestamp", encode_cursor(F.col("event_timestamp"), F.col("event_id")).alias("token"))
    back = decode_cursor(F.col("token"))
    return tokens.select("token", back["time"].alias("time"), back["id"].alias("id"))


@query
def notification_timeline(spark, sf):
    notes = written(_notifications(_incidents(spark, sf)), "notifications")
    some = notes.agg(F.max("incident_id")).scalar()
    return reads.notification_timeline(notes, some).select("incident_id", "sent_at", "level", "target", "status")


@query
def action_trail(spark, sf):
    done = written(_remediation(_incidents(spark, sf)), "actions")
    some = done.agg(F.max("incident_id")).scalar()
    return reads.action_trail(done, some).select("incident_id", "step_index", "status", "actor")


def _marked(spark, sf):
    found = _incidents(spark, sf)
    still_open = F.when(F.col("auto_resolved"), F.lit("open")).otherwise(F.col("status"))
    marker = F.when(F.pmod("event_count", F.lit(3)) == 0, F.col("opened_at"))
    return found.withColumns({"status": still_open, "alerted_at": marker, "remediated_at": F.when(F.pmod("event_count", F.lit(4)) == 0, F.col("opened_at"))})


@query
def unalerted_incidents(spark, sf):
    return reads.unalerted_incidents(_marked(spark, sf)).select("id", "opened_at")


@query
def unremediated_incidents(spark, sf):
    return reads.unremediated_incidents(_marked(spark, sf)).select("id", "opened_at")


@query
def count_events(spark, sf):
    return reads.count_events(given.telemetry(spark, sf))


@query
def events_by_service_severity(spark, sf):
    return reads.events_by_service_severity(given.telemetry(spark, sf))


@query
def id_uniqueness(spark, sf):
    return reads.id_uniqueness(_accepted(spark, sf))


@query
def duplicate_event_ids(spark, sf):
    return reads.duplicate_event_ids(_accepted(spark, sf))


@query
def pipeline_latency(spark, sf):
    return reads.pipeline_latency(given.telemetry(spark, sf))


@query
def recent_events(spark, sf):
    log = requests.requests_to_events(given.request_log(spark, sf))
    return reads.recent_events(log)


@query
def incidents_by_status_severity(spark, sf):
    return reads.incidents_by_status_severity(_incidents(spark, sf))


@query
def recent_incidents(spark, sf):
    return reads.recent_incidents(_incidents(spark, sf))


@query
def actions_by_runbook_status(spark, sf):
    return reads.actions_by_runbook_status(_remediation(_incidents(spark, sf)))


@query
def recent_actions(spark, sf):
    return reads.recent_actions(_remediation(_incidents(spark, sf)))


@query
def recent_notifications(spark, sf):
    return reads.recent_notifications(_notifications(_incidents(spark, sf)))


# --- retention -----------------------------------------------------------------------------------------

def _stored(spark, sf, label):
    path = scratch_path(spark, label)
    retention.backfill_partitions(given.telemetry(spark, sf), path)
    return path


@query
def backfill_partitions(spark, sf):
    return tables.scan_events(spark, _stored(spark, sf, "backfill")).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_timestamp").alias("first_at"), F.max("event_timestamp").alias("last_at")
    )


@query
def backfill_days(spark, sf):
    return retention.backfill_days(given.telemetry(spark, sf), TODAY)


@query
def list_partitions(spark, sf):
    return retention.list_partitions(spark, _stored(spark, sf, "list")).select("name", "event_date", "rows")


def _partitions(spark, sf):
    days = given.telemetry(spark, sf).groupBy(F.to_date("event_timestamp").alias("event_date")).agg(F.count(F.lit(1)).alias("rows"))
    return days.select(retention.partition_name(F.col("event_date")).alias("name"), "event_date", "rows")


@query
def partition_names(spark, sf):
    named = _partitions(spark, sf)
    return named.select("name", retention.partition_day(F.col("name")).alias("day"), retention.partition_day(F.concat("name", F.lit("x"))).alias("no_day"))


@query
def missing_partitions(spark, sf):
    return retention.missing_partitions(_partitions(spark, sf), TODAY)


@query
def partition_plan(spark, sf):
    return retention.partition_plan(_partitions(spark, sf), TODAY, retention=timedelta(days=20))


@query
def default_partition_rows(spark, sf):
    days = _partitions(spark, sf).filter(F.col("event_date") >= F.lit(date(2024, 1, 10)))
    return retention.default_partition_rows(given.telemetry(spark, sf), days)


@query
def expire_partitions(spark, sf):
    path = _stored(spark, sf, "expire")
    plan = retention.partition_plan(retention.list_partitions(spark, path), TODAY, retention=timedelta(days=20))
    retention.expire_partitions(path, plan)
    return tables.scan_events(spark, path).groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"))


@query
def drain_default(spark, sf):
    """Days from the 10th on have partitions; the 9th is created late and takes its parked rows along."""
    path = scratch_path(spark, "drain")
    days = _partitions(spark, sf).filter(F.col("event_date") >= F.lit(date(2024, 1, 10)))
    retention.route_events(given.telemetry(spark, sf), path, days)
    retention.drain_default(spark, path, date(2024, 1, 9))
    per_area = [
        tables.read_telemetry(spark, path, which).groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(which).alias("area"), "event_date", "rows")
        for which in (tables.DAILY, tables.PARKED)
    ]
    return per_area[0].unionByName(per_area[1])


@query
def collapse_partitions(spark, sf):
    return retention.collapse_partitions(_accepted(spark, sf).drop("offset", "copy")).select("event_id", "event_timestamp")


# --- reports -------------------------------------------------------------------------------------------

@query
def latency_report(spark, sf):
    return reports.latency_report(given.latency_samples(spark, sf))


@query
def latency_report_lines(spark, sf):
    return reports.report_lines(reports.latency_report(given.latency_samples(spark, sf)))


@query
def status_distribution(spark, sf):
    return reports.status_distribution(given.latency_samples(spark, sf)).drop("statuses")


# --- streaming: the same table as an unbounded input, run until it is used up ------------------------------

#: How far events may be out of order before the detector leaves them out.
LATE = timedelta(hours=12)


def _settle(spark, sf, label, build, *schemas):
    """Everything a stream says: it runs to the end of its input, then again from its checkpoint after a heartbeat.

    ``build`` gets a stream of heartbeats for each schema, to be added to its inputs. A heartbeat comes two months after
    the last event and belongs to nobody, so that every window, session and timer before it closes.
    """
    from tideline.streaming.stateful import STATE_STORE

    path = scratch_path(spark, label)
    beats = [f"{path}/beats-{i}" for i in range(len(schemas))]
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        for last in (False, True):
            for beat, (schema, moment, names) in zip(beats, schemas, strict=True):
                end = given.read_events(spark, sf).agg((F.max("ts") + F.expr("INTERVAL 60 DAY")).alias("_end")).filter("_end IS NOT NULL")
                row = end if last else end.filter("false")
                values = {moment: F.col("_end"), **{n: F.lit(v) for n, v in names.items()}}
                row.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(beat)
            stream = build(*[spark.readStream.schema(schema).parquet(beat) for beat, (schema, _, _) in zip(beats, schemas, strict=True)])
            writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
            writer.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _beat_of(schema, moment, **names):
    return schema, moment, names


BEAT = "nobody"


def _over_telemetry(spark, sf, label, build):
    """``build`` over the telemetry stream, to its very end."""
    live = given.telemetry(spark, sf, given.stream_events(spark, sf))
    beat = _beat_of(TELEMETRY, "event_timestamp", tenant_id=BEAT, service_name=BEAT)
    said = _settle(spark, sf, label, lambda beats: build(live.unionByName(beats.select(*live.columns))), beat)
    return said.filter(F.col("service_name") != BEAT)


@query
def stream_ingest(spark, sf):
    """The topic is consumed twice, as after a lost checkpoint; the table holds every event once."""
    from tideline.streaming.ingest import start_ingest

    path = scratch_path(spark, "ingest")
    for attempt in ("first", "again"):
        records = given.stream_records(spark, sf, given.stream_events(spark, sf)).drop("seq")
        start_ingest(
            records, f"{path}/table", f"{path}/quarantine", f"{path}/checkpoint-{attempt}", clock=lambda: given.NOW, available_now=True
        ).awaitTermination()
    return tables.scan_events(spark, f"{path}/table").select("event_id", "event_timestamp", "tenant_id", "severity", "event_date")


#: Events whose records one file of the topic holds, about.
EVENTS_PER_FILE = 100_000


def _topic_files(events: int) -> int:
    """An even number of files that grows with the events, so that no task writes a fixed share of the topic."""
    return 2 * max(2, -(-events // (2 * EVENTS_PER_FILE)))


@query
def read_event_stream(spark, sf):
    """The topic as files that carry its columns, half of them read and ingested in each of two triggers."""
    from tideline.streaming.ingest import start_ingest

    path = scratch_path(spark, "topic")
    files = _topic_files(given.read_events(spark, sf).count())
    # The copies of an event stay in one file, and so in one trigger.
    given.stream_records(spark, sf).repartition(files, "seq").drop("seq").write.parquet(f"{path}/topic")
    records = streams.read_event_stream(spark, "parquet", f"{path}/topic", maxFilesPerTrigger=str(files // 2))
    start_ingest(records, f"{path}/table", f"{path}/quarantine", f"{path}/checkpoint", clock=lambda: given.NOW, available_now=True).awaitTermination()
    return tables.scan_events(spark, f"{path}/table").select("event_id", "event_timestamp", "tenant_id", "severity", "event_date")


@query
def stream_windows(spark, sf):
    from tideline.streaming.detection import stream_windows as windows

    return _over_telemetry(spark, sf, "windows", lambda events: windows(events, given.WINDOW, given.STEP, LATE).drop("window"))


@query
def stream_rule_windows(spark, sf):
    """Every lookback of the rule set, from one stream of panes."""
    from tideline.streaming.panes import rule_windows

    lookbacks = sorted({r.window for r in given.TWO_LOOKBACKS})
    return _over_telemetry(spark, sf, "panes", lambda events: rule_windows(events, lookbacks, given.STEP, LATE))


@query
def stream_rules(spark, sf):
    """Detections of two rules of different lookbacks, in one streaming query."""
    from tideline.streaming.panes import rule_detections

    found = _over_telemetry(spark, sf, "rules", lambda events: rule_detections(events, given.TWO_LOOKBACKS, given.STEP, LATE))
    return _detections_flat(found)


@query
def stream_incidents(spark, sf):
    """Incidents of both rules as sessions over one stream of panes."""
    from tideline.streaming.detection import stream_incidents as sessions
    from tideline.streaming.panes import rule_windows

    lookbacks = sorted({r.window for r in given.TWO_LOOKBACKS})

    def build(events):
        return sessions(rule_windows(events, lookbacks, given.STEP, LATE), given.TWO_LOOKBACKS, given.STEP, given.RESOLVE_AFTER)

    return _over_telemetry(spark, sf, "sessions", build)


@query
def stateful_incidents(spark, sf):
    """The whole changelog of the stateful form, operator actions included."""
    from tideline.streaming.stateful import stateful_incidents as changelog

    log = scratch_path(spark, "detections")
    given.detections(spark, sf).write.parquet(log)
    fired = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    actions = given.operator_actions(spark, sf, given.stream_events(spark, sf))

    def build(fired_beats, action_beats):
        return changelog(
            fired.unionByName(fired_beats.select(*fired.columns)), given.STEP, given.RESOLVE_AFTER, LATE,
            actions.unionByName(action_beats.select(*actions.columns)),
        )

    changes = _settle(
        spark, sf, "changes", build, _beat_of(DETECTION, "tick", fingerprint=BEAT, event_count=1, new_event_count=1),
        _beat_of(OPERATOR_ACTION, "at", target=BEAT, action="resolve", action_id=BEAT),
    )
    mine = changes.filter((F.col("fingerprint") != BEAT) & (F.col("change") != "rejected"))
    refused = changes.filter((F.col("fingerprint") != BEAT) & (F.col("change") == "rejected"))
    columns = ("id", "fingerprint", "change", "at", "opened_at", "last_seen_at", "event_count", "action_id")
    # What a refused action met is told by its time alone.
    nothing = [F.lit(None).cast(changes.schema[c].dataType).alias(c) if c in ("id", "opened_at", "last_seen_at", "event_count") else F.col(c) for c in columns]
    return mine.select(*columns).unionByName(refused.select(*nothing))
