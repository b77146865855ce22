"""The given event table seen as telemetry, and the inputs derived from it.

Everything here is a projection of ``events.parquet`` (plus repeats by ``explode``), so the work of
every query grows with the table.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.frames import from_us
from tideline.functions.text import fingerprint, rfc3339_nano
from tideline.operators.detect import Rule, detect
from tideline.operators.incidents import incidents_from_detections
from tideline.operators.windows import replay_windows
from tideline.session import configure
from tideline.sources.config import parse_policy, parse_runbooks

EVENTS_DDL = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"

# Replay setting that suits the density of the given events (minutes apart, 30 days).
STEP = timedelta(hours=24)
WINDOW = timedelta(hours=72)
RESOLVE_AFTER = timedelta(hours=24)
NOW = datetime(2024, 1, 31)
RULES = (Rule(id="error_rate", window=WINDOW, threshold=0.4, min_events=5, incident_severity="error"),)
TWO_LOOKBACKS = (*RULES, Rule(id="error_spike", name="error spike", window=timedelta(hours=48), threshold=0.5, min_events=4, incident_severity="critical"))
SPARSE_RULES = (
    *RULES,
    Rule(id="error_burst", name="error burst", window=WINDOW, threshold=0.5, min_events=5, incident_severity="critical"),
    Rule(id="retired", name="retired rule", kind="anomaly", window=WINDOW),
)
POLL = timedelta(hours=1)

POLICY = """
{"levels": [
  {"target": "regional desk", "ack_timeout": "6h",
   "rotation": {"shift": "60h", "start": "2024-01-05T00:00:00Z",
                "contacts": [{"name": "desk east"}, {"name": "desk west", "address": "http://pager/west"}]}},
  {"target": "platform duty", "ack_timeout": "18h", "rotation": {"contacts": [{"name": "platform"}]}},
  {"target": "duty director", "ack_timeout": "30h", "rotation": {"contacts": [{"name": "director"}]}}
]}
"""

CATALOG = """
{"runbooks": [
  {"id": "tag-only", "match": {"rule_id": "error_rate", "service_name": "svc-7"}, "approval_timeout": "12h",
   "steps": [{"name": "tag the service", "kind": "noop", "mode": "auto", "params": {"label": "noisy"}}]},
  {"id": "hold-critical", "match": {"rule_id": "error_rate", "severity": "critical"}, "approval_timeout": "12h",
   "steps": [{"name": "freeze deploys", "kind": "noop", "mode": "auto"}]},
  {"id": "drain-then-fail-over", "match": {"rule_id": "error_rate"}, "approval_timeout": "12h",
   "steps": [
     {"name": "snapshot counters", "kind": "noop", "mode": "auto", "params": {"label": "before"}},
     {"name": "drain the pool", "kind": "webhook", "mode": "approval", "target": "http://fleet/drain",
      "params": {"pool": "blue"}},
     {"name": "fail over", "kind": "webhook", "mode": "approval", "target": "http://fleet/switch"}]}
]}
"""


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given table with its columns declared, so time filters reach the scan as plain timestamps."""
    configure(spark)
    return spark.read.schema(EVENTS_DDL).parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as an unbounded input."""
    configure(spark)
    return spark.readStream.schema(EVENTS_DDL).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def event_uuid(n: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))


def severity_of() -> Column:
    return (
        F.when((F.col("event_type") == "error") & (F.col("value") >= 100), F.lit("critical"))
        .when(F.col("event_type") == "error", F.lit("error"))
        .when(F.col("event_type") == "signup", F.lit("warn"))
        .when(F.col("event_type") == "view", F.lit("debug")).otherwise(F.lit("info"))
    )


def _shifted(ts: Column, us: Column) -> Column:
    return from_us(F.unix_micros(ts) + us)


def telemetry_columns() -> dict[str, Column]:
    n, user = F.col("event_id"), F.col("user_id")
    received = _shifted(F.col("ts"), F.pmod(n, F.lit(5)) * F.lit(1_000_000))
    return {
        "event_id": event_uuid(n),
        "schema_version": F.lit("1.0"),
        "tenant_id": F.concat(F.lit("tenant-"), F.pmod(user, F.lit(3))),
        "service_name": F.concat(F.lit("svc-"), user),
        "environment": F.when(F.pmod(user, F.lit(4)) == 0, F.lit("unknown")).otherwise(F.lit("prod")),
        "event_type": F.col("event_type"),
        "severity": severity_of(),
        "event_timestamp": F.col("ts"),
        "trace_id": F.when(F.pmod(n, F.lit(10)) == 0, F.lit("")).otherwise(
            F.concat(F.lit("trace-"), F.pmod(n, F.lit(500)))),
        "attributes": F.col("props"),
        "received_at": received,
        "processed_at": _shifted(received, F.pmod(n, F.lit(300)) * F.lit(1_000)),
    }


def telemetry(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    return (read_events(spark, sf_dir) if events is None else events).select(*[c.alias(n) for n, c in telemetry_columns().items()])


def dirty_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Telemetry as careless producers send it, every twentieth event twice.

    Adds ``seq`` (the event's number), ``copy`` and a log ``offset`` that tells any two rows apart.
    """
    n = F.col("seq")

    def every(k: int, rest: int = 0) -> Column:
        return F.pmod(n, F.lit(k)) == rest

    # Same columns, but repeated rows arrive as later copies of the same record.
    copies = F.when(F.pmod(F.col("event_id"), F.lit(20)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    base = (read_events(spark, sf_dir) if events is None else events).select(
        *[c.alias(name) for name, c in telemetry_columns().items()], F.col("event_id").alias("seq"), F.explode(copies).alias("copy")
    )
    return base.withColumns({
        "event_id": F.when(every(130), F.lit("not-a-uuid")).when(every(7), F.upper("event_id")).otherwise(F.col("event_id")),
        "schema_version": F.when(every(150), F.lit("2.0")).otherwise(F.lit(" 1.0 ")),
        "tenant_id": F.when(every(170), F.lit("  ")).when(every(50), F.concat(F.lit(" \t"), "tenant_id", F.lit("  "))).otherwise(F.col("tenant_id")),
        "service_name": F.when(every(190), F.repeat(F.lit("é"), F.lit(65))).otherwise(F.col("service_name")),
        "environment": F.when(every(4), F.lit(" ")).otherwise(F.col("environment")),
        "severity": F.when(every(70), F.lit("catastrophic")).when(every(3), F.upper("severity")).otherwise(F.col("severity")),
        "event_timestamp": F.when(every(90), _shifted(F.lit(NOW), n + F.lit(600_000_000))).when(every(210), F.lit(None).cast("timestamp")).otherwise(F.col("event_timestamp")),
        "attributes": F.when(every(11), F.lit(None).cast("string")).otherwise(F.col("attributes")),
        "offset": n * 2 + F.col("copy"),
    })


def stream_records(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The dirty events as topic records; some values are cut off, misspelt or of the wrong type."""
    dirty = dirty_events(spark, sf_dir, events)
    when = F.when(F.col("event_timestamp").isNotNull(), rfc3339_nano(F.col("event_timestamp")))
    value = F.to_json(F.struct(
        "event_id", "schema_version", "tenant_id", "service_name", "environment", "event_type", "severity",
        when.alias("timestamp"), "trace_id", F.try_parse_json("attributes").alias("attributes"),
    ))

    def every(k: int) -> Column:
        return F.pmod(F.col("seq"), F.lit(k)) == 0

    body = F.expr("substring(_value, 2)")
    broken = (
        F.when(every(230), F.expr("substring(_value, 1, length(_value) - 1)"))
        .when(every(250), F.concat(F.lit('{"extra":1,'), body))
        .when(every(270), F.concat(F.lit('{"tenant_id":5,'), F.expr("""replace(substring(_value, 2), '"tenant_id":', '"Tenant_ID":')""")))
        .when(every(290), F.concat(F.col("_value"), F.lit(" trailing"))).otherwise(F.col("_value"))
    )
    return dirty.select("*", value.alias("_value")).select(
        F.encode(F.concat_ws(":", "tenant_id", "service_name"), "UTF-8").alias("key"),
        F.encode(broken, "UTF-8").alias("value"), F.lit("telemetry").alias("topic"),
        F.pmod(F.col("seq"), F.lit(8)).cast("int").alias("partition"), "offset", F.col("received_at").alias("timestamp"),
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"), "seq",
    )


def span(spark: SparkSession, sf_dir: str) -> tuple[datetime, datetime]:
    """First and last tick of a replay: a day into the table, and when its last windows have emptied (one aggregate)."""
    low, high = read_events(spark, sf_dir).agg(F.date_trunc("day", F.min("ts")), F.date_trunc("day", F.max("ts"))).first()
    low, high = low or datetime(1970, 1, 1), high or datetime(1970, 1, 1)
    return low + STEP, high + STEP + WINDOW


def windows(spark: SparkSession, sf_dir: str, bounds: tuple[datetime, datetime] | None = None) -> DataFrame:
    """``bounds``: the ``span``, where the caller has it already."""
    start, until = bounds or span(spark, sf_dir)
    return replay_windows(telemetry(spark, sf_dir), WINDOW, STEP, start=start, until=until)


def detections(spark: SparkSession, sf_dir: str, bounds: tuple[datetime, datetime] | None = None) -> DataFrame:
    return detect(windows(spark, sf_dir, bounds), RULES)


def operator_actions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Sign-ups stand in for what people do: acknowledge or resolve the service's current incident."""
    t = telemetry_columns()
    return (read_events(spark, sf_dir) if events is None else events).filter("event_type = 'signup'").select(
        F.col("event_id").cast("string").alias("action_id"),
        fingerprint(F.lit("error_rate"), t["tenant_id"], t["service_name"]).alias("target"),
        F.when(F.pmod("event_id", F.lit(4)) == 0, F.lit("resolve")).otherwise(F.lit("acknowledge")).alias("action"),
        F.concat(F.lit("user-"), "user_id").alias("actor"), t["received_at"].alias("at"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = span(spark, sf_dir)
    return incidents_from_detections(
        detections(spark, sf_dir, bounds), STEP, RESOLVE_AFTER, bounds[1], operator_actions(spark, sf_dir)
    )


def levels(spark: SparkSession) -> DataFrame:
    return parse_policy(spark, POLICY)


def steps(spark: SparkSession) -> DataFrame:
    return parse_runbooks(spark, CATALOG)


def decisions(incidents_: DataFrame) -> DataFrame:
    """Three answers per incident, some early, some late, mostly approvals."""
    n = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")
    numbered = incidents_.select("id", "opened_at", "event_count", n)
    pace = F.pmod(F.col("event_count") + F.col("n"), F.lit(5)) * 5 + F.col("n") * 4 - 1
    return numbered.select(
        F.col("id").alias("incident_id"),
        F.when(F.pmod(F.col("event_count") * 3 + F.col("n"), F.lit(7)) == 0, F.lit("reject")).otherwise(F.lit("approve")).alias("action"),
        F.concat(F.lit("operator-"), F.col("n")).alias("actor"),
        _shifted(F.col("opened_at"), pace * F.lit(3_600_000_000)).alias("at"),
    )


def outcomes(incidents_: DataFrame) -> DataFrame:
    """What the targets answered: mostly 204, now and then 500."""
    step = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("step_index")
    return incidents_.select(F.col("id").alias("incident_id"), "event_count", step).select(
        "incident_id", "step_index",
        F.when(F.pmod(F.col("event_count") + F.col("step_index"), F.lit(6)) == 0, F.lit(500)).otherwise(F.lit(204)).alias("status_code"),
        F.lit(None).cast("string").alias("error"),
    )


def deliveries(pages: DataFrame) -> DataFrame:
    """What the webhooks answered: 200, or 503 for every page of an odd hour."""
    return pages.select(
        F.col("id").alias("notification_id"),
        F.when(F.pmod(F.hour("sent_at"), F.lit(2)) == 1, F.lit(503)).otherwise(F.lit(200)).alias("status_code"),
        F.lit(None).cast("string").alias("error"),
    )


def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per event: the event type is the path, the value its latency in milliseconds."""
    failed = F.pmod("event_id", F.lit(97)) == 0
    return read_events(spark, sf_dir).select(
        F.col("event_type").alias("path"), F.concat(F.lit("work of "), "event_type").alias("work"),
        F.when(~failed & (F.col("event_type") == "error"), F.lit(500)).when(~failed & (F.pmod("event_id", F.lit(10)) == 0), F.lit(429)).when(~failed, F.lit(200)).alias("status"),
        F.when(~failed, F.round(F.col("value") * 1000).cast("bigint")).alias("latency_us"),
        failed.alias("failed"), F.lit(10_000_000).cast("bigint").alias("elapsed_us"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry_columns()
    status = (
        F.when(F.col("event_type") == "error", F.lit(502)).when(F.col("event_type") == "signup", F.lit(409))
        .otherwise(F.lit(200))
    )
    return read_events(spark, sf_dir).select(
        t["event_id"].alias("event_id"), t["tenant_id"].alias("tenant_id"), t["service_name"].alias("service_name"),
        t["environment"].alias("environment"), F.col("ts").alias("at"), t["trace_id"].alias("trace_id"),
        F.lit("POST").alias("method"), F.concat(F.lit("/v1/"), "event_type").alias("route"), status.alias("status"),
        F.round(F.col("value") * 1000).cast("bigint").alias("latency_us"),
        F.when(status == 200, F.lit("completed")).otherwise(F.lit("failed")).alias("outcome"),
        F.concat(F.lit("obj_"), "event_id").alias("object_id"),
        F.when(status == 200, F.lit("")).otherwise(F.lit("request failed")).alias("detail"),
    )


def batch_requests(spark: SparkSession, sf_dir: str, events_per_request: int = 8) -> DataFrame:
    """The topic values in envelopes: a request carries a run of neighbouring events.

    Every thirteenth request is empty, every seventeenth is no JSON; a damaged value spoils its whole request.
    """
    records = stream_records(spark, sf_dir).select("seq", "offset", F.col("value").cast("string").alias("text"))
    request = F.call_function("div", F.col("seq"), F.lit(events_per_request).cast("bigint"))
    # A request holds at most twice ``events_per_request`` records.
    grouped = records.groupBy(request.alias("n")).agg(F.sort_array(F.collect_list(F.struct("offset", "text"))).alias("items"))
    body = F.concat(F.lit('{"events":['), F.array_join(F.transform("items", lambda i: i["text"]), ","), F.lit("]}"))
    return grouped.select(
        F.concat(F.lit("req-"), "n").alias("request_id"),
        F.when(F.pmod("n", F.lit(17)) == 0, F.lit('{"events":[')).when(F.pmod("n", F.lit(13)) == 0, F.lit('{"events":[]}'))
        .otherwise(body).alias("body"),
        F.concat(F.lit("request-trace-"), "n").alias("request_trace"),
    )
