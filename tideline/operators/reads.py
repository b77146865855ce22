"""Read queries: filters, keyset pages, audit trails, roll-ups and the short reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.cursor import encode_cursor, read_cursor
from tideline.functions.frames import instant, within_dates
from tideline.schema import INCIDENT_STATUSES, PAGE_DEFAULT, SEVERITIES


# --- filters ---------------------------------------------------------------------------------------

def _one_of(value: str | None, allowed: tuple[str, ...], what: str) -> None:
    if value and value not in allowed:
        raise ValueError(f"no {what} is called {value!r}; there are {list(allowed)}")


def _equal(df: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df


def filter_events(
    df: DataFrame, tenant: str | None = None, service: str | None = None, severity: str | None = None,
    event_type: str | None = None, trace_id: str | None = None,
    since: datetime | None = None, until: datetime | None = None,
) -> DataFrame:
    """Every condition that is set must hold; both time bounds are inclusive."""
    _one_of(severity, SEVERITIES, "severity")
    df = _equal(
        within_dates(df, since, until),
        tenant_id=tenant, service_name=service, severity=severity, event_type=event_type, trace_id=trace_id,
    )
    if since is not None:
        df = df.filter(F.col("event_timestamp") >= instant(since))
    if until is not None:
        df = df.filter(F.col("event_timestamp") <= instant(until))
    return df


def filter_incidents(
    df: DataFrame, status: str | None = None, tenant: str | None = None, service: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    _one_of(status, INCIDENT_STATUSES, "status")
    _one_of(severity, SEVERITIES, "severity")
    return _equal(df, status=status, tenant_id=tenant, service_name=service, severity=severity)


def trace_events(df: DataFrame, trace_id: str) -> DataFrame:
    """All events of one trace; the blank id is no trace."""
    return df.filter((F.col("trace_id") == trace_id) & (F.col("trace_id") != ""))


def get_incident(df: DataFrame, id_: str) -> DataFrame:
    """Zero rows or one."""
    return df.filter(F.col("id") == id_)


# --- pages -----------------------------------------------------------------------------------------

def page_limit(limit: int | None) -> int:
    """The rows of a page: as many as asked for, ``PAGE_DEFAULT`` where nothing (or 0) is. Nothing is cut silently."""
    return limit or PAGE_DEFAULT


def _window(df: DataFrame, time: str, id_: str, limit: int | None, offset: int, cursor: str | None) -> tuple[DataFrame, int]:
    """The requested page and one row more, newest first."""
    if limit is not None and limit < 0:
        raise ValueError(f"a page of {limit} rows makes no sense")
    if offset < 0:
        raise ValueError(f"cannot start {-offset} rows before the first")
    after = read_cursor(cursor or "")
    if after is not None and offset:
        raise ValueError("give a cursor or an offset: both name a start")
    size = page_limit(limit)
    if after is not None:
        at = instant(after.time)
        # Split so that the time bound reaches the scan; a row-value comparison would not.
        df = within_dates(df, until=after.time).filter(
            (F.col(time) <= at) & ((F.col(time) < at) | (F.col(id_) < after.id))
        )
    ordered = df.orderBy(F.col(time).desc(), F.col(id_).desc())
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(size + 1), size


def _page(df: DataFrame, time: str, id_: str, limit: int | None, offset: int, cursor: str | None) -> tuple[DataFrame, str]:
    """One job: the page and the row beyond it come to the driver once, and page and token are taken from them."""
    fetched, size = _window(df, time, id_, limit, offset, cursor)
    token = encode_cursor(F.col(time), F.col(id_)).alias("_token")
    rows = fetched.select("*", token).toArrow()
    page = df.sparkSession.createDataFrame(rows.slice(0, size).drop_columns(["_token"]), schema=df.schema)
    return page, rows.column("_token")[size - 1].as_py() if rows.num_rows > size else ""


def page_events(
    df: DataFrame, filters: dict | None = None, limit: int | None = None, offset: int = 0, cursor: str | None = None
) -> tuple[DataFrame, str]:
    """One page of events, newest first, and the token of the next page (empty at the end)."""
    return _page(filter_events(df, **(filters or {})), "event_timestamp", "event_id", limit, offset, cursor)


def page_incidents(
    df: DataFrame, filters: dict | None = None, limit: int | None = None, offset: int = 0, cursor: str | None = None
) -> tuple[DataFrame, str]:
    """One page of incidents, latest activity first, and the token of the next page."""
    return _page(filter_incidents(df, **(filters or {})), "last_seen_at", "id", limit, offset, cursor)


# --- per incident ----------------------------------------------------------------------------------

def notification_timeline(notifications: DataFrame, incident_id: str) -> DataFrame:
    return notifications.filter(F.col("incident_id") == incident_id).orderBy("sent_at", "level")


def action_trail(actions: DataFrame, incident_id: str) -> DataFrame:
    return actions.filter(F.col("incident_id") == incident_id).orderBy("step_index")


def pending_action(actions: DataFrame) -> DataFrame:
    """Per incident the lowest step that waits for a decision; no row means nothing is pending."""
    waiting = actions.filter("status = 'pending'")
    row = F.struct(*[F.col(c) for c in actions.columns])
    return waiting.groupBy("incident_id").agg(F.min_by(row, "step_index").alias("row")).select("row.*")


def unalerted_incidents(incidents: DataFrame, limit: int | None = None, marker: str = "alerted_at") -> DataFrame:
    """All open incidents nobody has handled yet; with a ``limit``, so many of the oldest."""
    waiting = incidents.filter((F.col("status") == "open") & F.col(marker).isNull())
    return waiting if limit is None else waiting.orderBy("opened_at", "id").limit(limit)


def unremediated_incidents(incidents: DataFrame, limit: int | None = None) -> DataFrame:
    return unalerted_incidents(incidents, limit, marker="remediated_at")


def incident_detail(incidents: DataFrame, notifications: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per incident with its pages, its remediation steps and the step waiting for a decision.

    An incident has one page per level and one row per step, so the nested lists stay short.
    """
    pages = notifications.groupBy("incident_id").agg(F.sort_array(F.collect_list(
        F.struct("sent_at", "level", "target", "contact", "status"))).alias("timeline"))
    steps = actions.groupBy("incident_id").agg(
        F.sort_array(F.collect_list(F.struct("step_index", "step_name", "mode", "status", "actor"))).alias("actions"),
        F.min_by(
            F.when(F.col("status") == "pending", F.col("step_name")),
            F.when(F.col("status") == "pending", F.col("step_index")),
        ).alias("pending_step"),
    )
    joined = (
        incidents.join(pages, incidents["id"] == pages["incident_id"], "left").drop("incident_id")
        .join(steps, incidents["id"] == steps["incident_id"], "left").drop("incident_id")
    )
    return joined.withColumns({
        "timeline": F.coalesce("timeline", F.array().cast(pages.schema["timeline"].dataType)),
        "actions": F.coalesce("actions", F.array().cast(steps.schema["actions"].dataType)),
    })


def cascade_filter(audit: DataFrame, incidents: DataFrame) -> DataFrame:
    """Audit rows whose incident still exists."""
    return audit.join(incidents.select(F.col("id").alias("incident_id")), "incident_id", "left_semi")


# --- roll-ups and short reports ----------------------------------------------------------------------

def count_events(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_events"))


def events_by_service_severity(df: DataFrame) -> DataFrame:
    return df.groupBy("service_name", "severity").agg(F.count(F.lit(1)).alias("events")).orderBy("service_name", "severity")


def id_uniqueness(df: DataFrame) -> DataFrame:
    """Rows and distinct ids, which must be equal. The ids are counted where they are grouped."""
    per_id = df.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("event_id").alias("distinct_event_ids")
    )


def duplicate_event_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def pipeline_latency(df: DataFrame) -> DataFrame:
    """Mean and worst time from receipt to storage in milliseconds."""
    took = F.unix_micros("processed_at") - F.unix_micros("received_at")
    measured = df.agg(F.sum(took).alias("sum_us"), F.count(took).alias("n"), F.max(took).alias("max_us"))
    return measured.select(
        F.round(F.col("sum_us") / F.col("n") / 1000, 2).alias("avg_ms"), F.round(F.col("max_us") / 1000, 2).alias("max_ms")
    )


def _clock(name: str, time: str):
    return F.date_format(time, "HH:mm:ss").alias(name)


def _short(id_: str):
    """The first characters of an id, for a narrow table; the whole id stands beside them."""
    return F.left(F.col(id_), F.lit(8)).alias("short_id")


def _newest(df: DataFrame, n: int, *by: str) -> DataFrame:
    return df.orderBy(*(F.col(c).desc() for c in by)).limit(n)


def recent_events(df: DataFrame, n: int = 10) -> DataFrame:
    """The n newest request events with what they say about the request."""
    said = {"http_status": "$.http_status_code", "took_ms": "$.latency_ms"}
    return _newest(df, n, "event_timestamp", "event_id").select(
        "event_id", _short("event_id"), "service_name", "severity",
        *(F.get_json_object("attributes", path).alias(name) for name, path in said.items()), _clock("seen_at", "event_timestamp"),
    )


def incidents_by_status_severity(df: DataFrame) -> DataFrame:
    return df.groupBy("status", "severity").agg(F.count(F.lit(1)).alias("incidents")).orderBy("status", "severity")


def recent_incidents(df: DataFrame, n: int = 10) -> DataFrame:
    """The n incidents active last."""
    return _newest(df, n, "last_seen_at", "id").select(
        "id", _short("id"), "service_name", "severity", "status", "event_count", _clock("active_at", "last_seen_at")
    )


def actions_by_runbook_status(df: DataFrame) -> DataFrame:
    return df.groupBy("runbook_id", "status").agg(F.count(F.lit(1)).alias("actions")).orderBy("runbook_id", "status")


def recent_actions(df: DataFrame, n: int = 10) -> DataFrame:
    """The n remediation steps that changed last."""
    return _newest(df, n, "updated_at", "incident_id", "step_index").select(
        "incident_id", _short("incident_id"), "step_index", "step_name", "mode", "status", "actor", _clock("changed_at", "updated_at")
    )


def recent_notifications(df: DataFrame, n: int = 10) -> DataFrame:
    """The n pages sent last."""
    newest = df.orderBy(*(F.col(c).desc() for c in ("sent_at", "incident_id", "level")), "id").limit(n)
    return newest.select("incident_id", _short("incident_id"), "level", "target", "contact", "channel", "status", _clock("paged_at", "sent_at"))
