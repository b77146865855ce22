"""The SQL each catalogue query is checked against, for DuckDB over the same tables.

The statements say what a query must return, from the given tables alone; they share no code with
the operators. ``_with`` picks the common table expressions a statement needs.
"""

from __future__ import annotations

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

SEVERITIES = "('debug','info','warn','error','critical')"


def ts(us: str) -> str:
    return f"make_timestamp(CAST({us} AS BIGINT))"


def uuid5(namespace: str, name: str) -> str:
    digest = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return (
        f"(substr({digest},1,8) || '-' || substr({digest},9,4) || '-5' || substr({digest},14,3) || '-'"
        f" || translate(substr({digest},17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr({digest},18,3)"
        f" || '-' || substr({digest},21,12))"
    )


def iso(expr: str) -> str:
    """RFC 3339 text with the shortest fraction."""
    return (
        f"(strftime({expr}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({expr}) % 1000000 = 0 THEN ''"
        f" ELSE '.' || rtrim(lpad(CAST(epoch_us({expr}) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z')"
    )


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (needs, sql)


def _with(body: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in CTE[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    listed = ",\n".join(f"{name} AS MATERIALIZED ({CTE[name][1]})" for name in ordered)
    return f"WITH {listed}\n{body}"


_cte("base", """
SELECT *, make_timestamp(epoch_us(ts) + (event_id % 5) * 1000000) AS received_at,
  make_timestamp(epoch_us(ts) + (event_id % 5) * 1000000 + (event_id % 300) * 1000) AS processed_at,
  '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS uid,
  'tenant-' || (user_id % 3) AS tenant_id, 'svc-' || user_id AS service_name,
  CASE WHEN user_id % 4 = 0 THEN 'unknown' ELSE 'prod' END AS environment,
  CASE WHEN event_type = 'error' AND value >= 100 THEN 'critical' WHEN event_type = 'error' THEN 'error'
       WHEN event_type = 'signup' THEN 'warn' WHEN event_type = 'view' THEN 'debug' ELSE 'info' END AS severity,
  CASE WHEN event_id % 10 = 0 THEN '' ELSE 'trace-' || (event_id % 500) END AS trace_id
FROM events""")

_cte("telemetry", """
SELECT uid AS event_id, '1.0' AS schema_version, tenant_id, service_name, environment, event_type, severity,
  ts AS event_timestamp, trace_id, props AS attributes, received_at, processed_at FROM base""", "base")

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

# The careless copies before normalisation (d_*) and what normalisation must make of them (n_*).
_cte("dirty", f"""
SELECT b.event_id AS n, c.copy, b.event_id * 2 + c.copy AS "offset", event_type, trace_id, received_at, processed_at,
  CASE WHEN event_id % 130 = 0 THEN 'not-a-uuid' ELSE uid END AS n_id,
  CASE WHEN event_id % 130 = 0 THEN 'not-a-uuid' WHEN event_id % 7 = 0 THEN upper(uid) ELSE uid END AS d_id,
  CASE WHEN event_id % 150 = 0 THEN '2.0' ELSE '1.0' END AS n_version,
  CASE WHEN event_id % 150 = 0 THEN '2.0' ELSE ' 1.0 ' END AS d_version,
  CASE WHEN event_id % 170 = 0 THEN '' ELSE tenant_id END AS n_tenant,
  CASE WHEN event_id % 170 = 0 THEN '  ' WHEN event_id % 50 = 0 THEN ' ' || chr(9) || tenant_id || '  ' ELSE tenant_id END AS d_tenant,
  CASE WHEN event_id % 190 = 0 THEN repeat('é', 65) ELSE service_name END AS service_name,
  CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE environment END AS n_env,
  CASE WHEN event_id % 4 = 0 THEN ' ' ELSE environment END AS d_env,
  CASE WHEN event_id % 70 = 0 THEN 'catastrophic' ELSE severity END AS n_severity,
  CASE WHEN event_id % 70 = 0 THEN 'catastrophic' WHEN event_id % 3 = 0 THEN upper(severity) ELSE severity END AS d_severity,
  CASE WHEN event_id % 90 = 0 THEN make_timestamp(epoch_us({NOW}) + event_id + 600000000)
       WHEN event_id % 210 = 0 THEN NULL ELSE ts END AS event_timestamp,
  CASE WHEN event_id % 11 = 0 THEN '{{}}' ELSE props END AS n_attr,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS d_attr
FROM base b, (VALUES (0), (1)) c(copy) WHERE c.copy = 0 OR b.event_id % 20 = 0""", "base")

_AHEAD = f"(epoch_us(event_timestamp) - epoch_us({NOW}))"
_problems = [
    ("n_id = 'not-a-uuid'", "'event_id'", "'must be a valid UUID'"),
    ("n_version = '2.0'", "'schema_version'", "'\"2.0\" is not a supported schema version (supported: 1.0)'"),
    ("n_tenant = ''", "'tenant_id'", "'is required'"),
    ("octet_length(encode(service_name)) > 128", "'service_name'", "'must be at most 128 characters'"),
    ("n_severity = 'catastrophic'", "'severity'",
     "'\"catastrophic\" is not a supported severity (supported: debug, info, warn, error, critical)'"),
    ("event_timestamp IS NULL", "'timestamp'", "'is required and must be an RFC3339 timestamp'"),
]
_clock = [
    (f"{_AHEAD} > 300000000", "'timestamp'",
     "'is 10m0s in the future, which exceeds the 5m0s limit (server time is 2024-01-31T00:00:00Z); check the sending host''s clock'"),
    (f"-{_AHEAD} > 7 * {DAY_US}", "'timestamp'",
     f"'is ' || printf('%.1f', -{_AHEAD} / 3600000000.0 / 24) || ' days old, which exceeds the 168h0m0s limit (server time is 2024-01-31T00:00:00Z)'"),
]


def _problem_rows(problems) -> str:
    return " UNION ALL ".join(
        f'SELECT "offset", n, copy, {i} AS ord, {f} AS field, {m} AS message FROM dirty WHERE {w}'
        for i, (w, f, m) in enumerate(problems)
    )


_cte("problems", _problem_rows(_problems), "dirty")
# Events whose number reaches 300 s land past "10m0s" of drift only beyond sf 3000, so the text is fixed.
_cte("stream_problems", _problem_rows(_problems + _clock[:1]), "dirty")
_cte("api_problems", _problem_rows(_problems + _clock), "dirty")
_cte("accepted", 'SELECT * FROM dirty WHERE "offset" NOT IN (SELECT "offset" FROM stream_problems)', "dirty", "stream_problems")

# Topic records: the JSON text, then how it is damaged.
_text = (
    "'{' || '\"event_id\":\"' || d_id || '\",\"schema_version\":\"' || d_version || '\",\"tenant_id\":\"'"
    " || replace(d_tenant, chr(9), '\\t') || '\",\"service_name\":\"' || service_name || '\",\"environment\":\"' || d_env"
    " || '\",\"event_type\":\"' || event_type || '\",\"severity\":\"' || d_severity || '\"'"
    f" || CASE WHEN event_timestamp IS NULL THEN '' ELSE ',\"timestamp\":\"' || {iso('event_timestamp')} || '\"' END"
    " || ',\"trace_id\":\"' || trace_id || '\"'"
    " || CASE WHEN d_attr IS NULL THEN '' ELSE ',\"attributes\":' || replace(d_attr, ': ', ':') END || '}'"
)
_cte("records", f"""
SELECT *, CASE WHEN n % 230 = 0 THEN 'cut' WHEN n % 250 = 0 THEN 'extra' WHEN n % 270 = 0 THEN 'typed'
  WHEN n % 290 = 0 THEN 'trailing' ELSE 'whole' END AS damage, {_text} AS whole_text FROM dirty""", "dirty")
_cte("values_", """
SELECT *, encode(CASE damage WHEN 'cut' THEN substr(whole_text, 1, length(whole_text) - 1)
  WHEN 'extra' THEN '{"extra":1,' || substr(whole_text, 2)
  WHEN 'typed' THEN '{"tenant_id":5,' || replace(substr(whole_text, 2), '"tenant_id":', '"Tenant_ID":')
  WHEN 'trailing' THEN whole_text || ' trailing' ELSE whole_text END) AS value FROM records""", "records")


def _decoded(strict: bool) -> str:
    extra = "WHEN damage = 'extra' THEN 'unknown field \"extra\"'" if strict else ""
    return _with(f"""
SELECT "offset", CASE WHEN damage IN ('cut','trailing') THEN '' ELSE d_id END AS event_id,
  CASE WHEN damage IN ('cut','trailing') THEN '' WHEN damage = 'typed' THEN '5' ELSE d_tenant END AS tenant_id,
  CASE WHEN damage IN ('cut','trailing') THEN '' ELSE d_severity END AS severity,
  CASE WHEN damage NOT IN ('cut','trailing') THEN event_timestamp END AS event_timestamp,
  CASE WHEN damage NOT IN ('cut','trailing') THEN replace(d_attr, ': ', ':') END AS attributes,
  CASE WHEN damage IN ('cut','trailing') THEN 'message is not a JSON object' {extra}
       WHEN damage = 'typed' THEN 'field tenant_id must be of type string' END AS decode_error
FROM records""", "records")


# Requests: eight neighbouring event numbers each.
_cte("requests_", """
SELECT n // 8 AS r, 'req-' || (n // 8) AS request_id, "offset", n, damage, d_id, n_id, trace_id,
  CASE WHEN (n // 8) % 17 = 0 THEN 'invalid_json' WHEN (n // 8) % 13 = 0 THEN 'empty_batch'
       WHEN bool_or(damage IN ('cut','trailing')) OVER (PARTITION BY n // 8) THEN 'invalid_json' END AS batch_error
FROM records""", "records")
_cte("items", """
SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY "offset") - 1 AS INTEGER) AS idx
FROM requests_ WHERE batch_error IS NULL""", "requests_")
_cte("request_heads", "SELECT r, request_id, max(batch_error) AS batch_error FROM requests_ GROUP BY r, request_id", "requests_")

START = "(SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events)"
HORIZON = "(SELECT date_trunc('day', max(ts)) + INTERVAL 4 DAY FROM events)"


def _windows(days: int) -> str:
    return f"""
SELECT t.tick, {days * DAY_US} AS window_us, tenant_id, service_name, count(*) AS total,
  count(*) FILTER (severity IN ('error','critical')) AS errors,
  count(*) FILTER (severity IN ('error','critical') AND (event_timestamp >= t.tick - INTERVAL 1 DAY OR t.tick = {START})) AS new_errors
FROM telemetry e, (SELECT unnest(generate_series({START}, {HORIZON}, INTERVAL 1 DAY)) AS tick) t
WHERE e.processed_at <= t.tick AND e.event_timestamp >= t.tick - INTERVAL {days} DAY
GROUP BY ALL"""


_cte("windows72", _windows(3), "telemetry")
_cte("windows48", _windows(2), "telemetry")


def _detect(rule: str, name: str, threshold: str, severity: str, windows: str = "windows72", least: int = 5, text: str = "72h0m0s") -> str:
    return f"""
SELECT tick, '{rule}' AS rule_id, tenant_id, service_name, '{rule}' || chr(31) || tenant_id || chr(31) || service_name AS fingerprint,
  '{name}: ' || CAST(round_even(errors / total * 100, 0) AS BIGINT) || '% error rate on ' || service_name || ' (' || errors
    || ' of ' || total || ' events over {text})' AS title,
  '{severity}' AS severity, errors AS event_count, new_errors AS new_event_count, total AS total_events, '{text}' AS window_text,
  round(errors / total, 9) AS error_rate, CAST({threshold} AS DOUBLE) AS threshold
FROM {windows} WHERE total >= {least} AND errors / total >= {threshold}"""


_cte("det", _detect("error_rate", "elevated error rate", "0.4", "error"), "windows72")
_cte("det_burst", _detect("error_burst", "error burst", "0.5", "critical"), "windows72")
_cte("det_spike", _detect("error_spike", "error spike", "0.5", "critical", "windows48", 4, "48h0m0s"), "windows48")
_cte("no_acts", "SELECT '' AS target, '' AS action, TIMESTAMP '2024-01-01' AS at WHERE false")
_cte("acts", """
SELECT 'error_rate' || chr(31) || tenant_id || chr(31) || service_name AS target,
  CASE WHEN event_id % 4 = 0 THEN 'resolve' ELSE 'acknowledge' END AS action, received_at AS "at", CAST(event_id AS VARCHAR) AS action_id
FROM base WHERE event_type = 'signup'""", "base")

INCIDENT_NS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
_INCIDENT_ID = uuid5(INCIDENT_NS, "fingerprint || chr(31) || strftime(opened_at, '%Y-%m-%dT%H:%M:%SZ')")


def _incidents(acts: str, suffix: str) -> None:
    """One day ticks, one quiet day: a gap of three ticks, or a resolve in between, starts a new incident."""
    _cte(f"fired{suffix}", "SELECT *, lag(tick) OVER (PARTITION BY fingerprint ORDER BY tick) AS prev FROM det", "det")
    _cte(f"numbered{suffix}", f"""
SELECT f.*, sum(CASE WHEN prev IS NULL OR epoch_us(tick) - epoch_us(prev) >= 3 * {DAY_US}
    OR EXISTS (SELECT 1 FROM {acts} a WHERE a.target = f.fingerprint AND a.action = 'resolve' AND a."at" > f.prev AND a."at" <= f.tick)
    THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY tick) AS run
FROM fired{suffix} f""", f"fired{suffix}", acts)
    _cte(f"runs{suffix}", f"""
SELECT fingerprint, run, min(tick) AS opened_at, max(tick) AS last_seen_at,
  arg_min(event_count, tick) + sum(new_event_count) - arg_min(new_event_count, tick) AS event_count,
  any_value(tenant_id) AS tenant_id, any_value(service_name) AS service_name, any_value(rule_id) AS rule_id,
  arg_min(title, tick) AS title, any_value(severity) AS severity
FROM numbered{suffix} GROUP BY fingerprint, run""", f"numbered{suffix}")
    _cte(f"closed{suffix}", f"""
SELECT r.*, r.last_seen_at + INTERVAL 2 DAY AS auto_at,
  (SELECT min(a."at") FROM {acts} a WHERE a.target = r.fingerprint AND a.action = 'resolve' AND a."at" > r.last_seen_at
     AND a."at" <= r.last_seen_at + INTERVAL 2 DAY AND a."at" <= {HORIZON}) AS hand_at
FROM runs{suffix} r""", f"runs{suffix}", acts)
    _cte(f"ended{suffix}", f"""
SELECT *, coalesce(hand_at, CASE WHEN auto_at <= {HORIZON} THEN auto_at END) AS resolved_at FROM closed{suffix}""",
         f"closed{suffix}")
    _cte(f"acked{suffix}", f"""
SELECT e.*, (SELECT min(a."at") FROM {acts} a WHERE a.target = e.fingerprint AND a.action = 'acknowledge' AND a."at" > e.opened_at
    AND a."at" <= coalesce(e.resolved_at, {HORIZON})) AS acknowledged_at FROM ended{suffix} e""", f"ended{suffix}", acts)
    _cte(f"inc{suffix}", f"""
SELECT {_INCIDENT_ID} AS id, fingerprint, tenant_id, service_name, rule_id, title, severity,
  CASE WHEN resolved_at IS NOT NULL THEN 'resolved' WHEN acknowledged_at IS NOT NULL THEN 'acknowledged' ELSE 'open' END AS status,
  CAST(event_count AS BIGINT) AS event_count, opened_at AS first_seen_at, last_seen_at, opened_at, acknowledged_at, resolved_at,
  CASE WHEN resolved_at IS NOT NULL THEN hand_at IS NULL END AS auto_resolved,
  greatest(last_seen_at, acknowledged_at, resolved_at) AS updated_at
FROM acked{suffix}""", f"acked{suffix}")


_incidents("no_acts", "_0")
_incidents("acts", "")

_cte("grown", """
SELECT fingerprint, run, tick, min(tick) OVER r AS opened_at,
  CAST(first_value(event_count - new_event_count) OVER r + sum(new_event_count) OVER r AS BIGINT) AS count_then
FROM numbered WINDOW r AS (PARTITION BY fingerprint, run ORDER BY tick)""", "numbered")
_cte("accepted_acts", """
SELECT r.fingerprint, r.run, r.opened_at, a."at", min(a.action_id) AS action_id,
  CASE a.action WHEN 'resolve' THEN 'resolved' ELSE 'acknowledged' END AS kind
FROM acked r JOIN acts a ON a.target = r.fingerprint
  AND ((a.action = 'resolve' AND a."at" = r.hand_at) OR (a.action = 'acknowledge' AND a."at" = r.acknowledged_at))
GROUP BY ALL""", "acked", "acts")
# What a stream sees: event-time windows, and the firings among them.
def _live(suffix: str, days: int, rule: str, severity: str, least: int, threshold: str) -> None:
    _cte(f"live_windows{suffix}", f"""
SELECT t.tick, {days * DAY_US} AS window_us, tenant_id, service_name, count(*) AS total,
  count(*) FILTER (severity IN ('error','critical')) AS errors,
  count(*) FILTER (severity IN ('error','critical') AND event_timestamp >= t.tick - INTERVAL 1 DAY) AS new_errors
FROM telemetry e, (SELECT unnest(generate_series({START} - INTERVAL 3 DAY, {HORIZON} + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS tick) t
WHERE e.event_timestamp < t.tick AND e.event_timestamp >= t.tick - INTERVAL {days} DAY GROUP BY ALL""", "telemetry")
    _cte(f"live_fired{suffix}", f"""
SELECT *, '{rule}' || chr(31) || tenant_id || chr(31) || service_name AS fingerprint, lag(tick) OVER (PARTITION BY tenant_id, service_name ORDER BY tick) AS prev
FROM live_windows{suffix} WHERE total >= {least} AND errors / total >= {threshold}""",
         f"live_windows{suffix}")
    _cte(f"live_numbered{suffix}", f"""
SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(tick) - epoch_us(prev) >= 3 * {DAY_US} THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY tick) AS run
FROM live_fired{suffix}""", f"live_fired{suffix}")
    _cte(f"live_runs{suffix}", f"""
SELECT fingerprint, '{rule}' AS rule_id, '{severity}' AS severity, run, any_value(tenant_id) AS tenant_id, any_value(service_name) AS service_name,
  min(tick) AS opened_at, max(tick) AS last_seen_at,
  arg_min(errors, tick) + sum(new_errors) - arg_min(new_errors, tick) AS event_count FROM live_numbered{suffix} GROUP BY fingerprint, run""", f"live_numbered{suffix}")


_cte("live_det", _detect("error_rate", "elevated error rate", "0.4", "error", "live_windows"), "live_windows")
_cte("live_det48", _detect("error_spike", "error spike", "0.5", "critical", "live_windows48", 4, "48h0m0s"), "live_windows48")
_live("", 3, "error_rate", "error", 5, "0.4")
_live("48", 2, "error_spike", "critical", 4, "0.5")

# The operator log by incident id.
_cte("stored_inc", "SELECT * REPLACE (CASE WHEN event_count % 4 = 0 THEN status ELSE 'open' END AS status) FROM inc_0", "inc_0")
_cte("id_acts", f"""
SELECT id || '#' || n AS action_id, CASE WHEN (event_count * 3 + n) % 9 = 0 THEN 'x' || id ELSE id END AS target,
  CASE WHEN (event_count + n) % 2 = 0 THEN 'resolve' ELSE 'acknowledge' END AS action, 'someone' AS actor,
  {ts(f"epoch_us(opened_at) + (event_count * (n + 2)) % 5 * {HOUR_US}")} AS "at"
FROM stored_inc, (VALUES (0), (1), (2)) v(n)""", "stored_inc")
# Order of the log per incident, and what stood before each entry.
_cte("ranked_acts", """
SELECT a.*, s.status AS stored, row_number() OVER (PARTITION BY target ORDER BY "at", action, action_id) AS pos
FROM id_acts a LEFT JOIN stored_inc s ON s.id = a.target""", "id_acts", "stored_inc")
_cte("judged_acts", """
SELECT a.*, CASE WHEN stored IS NULL THEN NULL
  WHEN stored = 'resolved' OR EXISTS (SELECT 1 FROM ranked_acts b WHERE b.target = a.target AND b.pos < a.pos AND b.action = 'resolve') THEN 'resolved'
  WHEN stored = 'acknowledged' OR EXISTS (SELECT 1 FROM ranked_acts b WHERE b.target = a.target AND b.pos < a.pos AND b.action = 'acknowledge') THEN 'acknowledged'
  ELSE 'open' END AS from_status FROM ranked_acts a""", "ranked_acts")
_LEGAL = "((action = 'resolve' AND from_status IN ('open','acknowledged')) OR (action = 'acknowledge' AND from_status = 'open'))"

_cte("damaged_inc", """
SELECT * REPLACE (CASE WHEN event_count % 3 = 0 THEN '  ' ELSE title END AS title,
  CASE WHEN event_count % 5 = 0 THEN 'lost' ELSE status END AS status,
  CASE WHEN event_count % 7 = 0 THEN 'huge' ELSE severity END AS severity,
  CASE WHEN event_count % 4 = 0 THEN '' ELSE rule_id END AS rule_id) FROM inc""", "inc")

# Escalation: three levels, one poll per hour.
_cte("levels_", f"""
SELECT * FROM (VALUES (1, 'regional desk', 0, 6 * {HOUR_US}), (2, 'platform duty', 6 * {HOUR_US}, 18 * {HOUR_US}),
  (3, 'duty director', 24 * {HOUR_US}, 30 * {HOUR_US})) v(level, target, offset_us, wait_us)""")


def _contact(level: str, at: str) -> str:
    since = f"(epoch_us({at}) - epoch_us(TIMESTAMP '2024-01-05'))"
    return (
        f"CASE {level} WHEN 2 THEN 'platform' WHEN 3 THEN 'director' ELSE"
        f" CASE WHEN {since} < 0 THEN 'desk east' WHEN ({since} // (60 * {HOUR_US})) % 2 = 0 THEN 'desk east' ELSE 'desk west' END END"
    )


_cte("watched", f"""
SELECT *, least(acknowledged_at, resolved_at) AS stopped_at,
  least(acknowledged_at, CASE WHEN NOT auto_resolved THEN resolved_at END) AS signalled_at,
  {ts(f"(epoch_us(opened_at) + {HOUR_US} - 1) // {HOUR_US} * {HOUR_US}")} AS started_at FROM inc""", "inc")
_cte("starts", "SELECT * FROM watched WHERE stopped_at IS NULL OR stopped_at > started_at", "watched")
NOTE_NS = "1b4e28ba-2fa1-11d2-883f-0016d3cca427"
_cte("pages_", f"""
SELECT {uuid5(NOTE_NS, "incident_id || ':' || level || ':' || reason")} AS id, *,
  CASE WHEN contact = 'desk west' THEN 'http://pager/west' ELSE '' END AS contact_address
FROM (
  SELECT s.id AS incident_id, l.level, l.target, {_contact('l.level', ts('epoch_us(s.started_at) + l.offset_us'))} AS contact,
    'escalation' AS reason, {ts('epoch_us(s.started_at) + l.offset_us')} AS sent_at
  FROM starts s, levels_ l WHERE s.stopped_at IS NULL OR epoch_us(s.stopped_at) > epoch_us(s.started_at) + l.offset_us
  UNION ALL
  SELECT id, 3, 'escalation exhausted', 'none', 'exhausted', started_at + INTERVAL 54 HOUR FROM starts
  WHERE (signalled_at IS NULL OR signalled_at > started_at + INTERVAL 54 HOUR)
    AND (stopped_at IS NULL OR stopped_at > started_at + INTERVAL 24 HOUR)
)""", "starts", "levels_")
_cte("notes", """
SELECT id, incident_id, level, target, contact, CASE WHEN contact = 'desk west' THEN 'webhook' ELSE 'log' END AS channel,
  CASE WHEN contact = 'desk west' AND hour(sent_at) % 2 = 1 THEN 'failed' ELSE 'sent' END AS status, sent_at,
  CASE WHEN contact = 'desk west' AND hour(sent_at) % 2 = 1 THEN 'webhook returned status 503' END AS error
FROM pages_""", "pages_")

# Remediation, step by step. Every incident but those of svc-7 runs the three-step runbook.
_cte("decisions_", f"""
SELECT id AS incident_id, CASE WHEN (event_count * 3 + n) % 7 = 0 THEN 'reject' ELSE 'approve' END AS action, 'operator-' || n AS actor,
  {ts(f"epoch_us(opened_at) + ((event_count + n) % 5 * 5 + n * 4 - 1) * {HOUR_US}")} AS "at"
FROM inc, (VALUES (0), (1), (2)) v(n)""", "inc")
_cte("answers", """
SELECT d.*, row_number() OVER (PARTITION BY d.incident_id ORDER BY "at", action DESC, actor) AS g
FROM decisions_ d JOIN starts s ON s.id = d.incident_id WHERE d."at" >= s.started_at""", "decisions_", "starts")
_cte("walk", """
SELECT s.id AS incident_id, s.started_at AS t0, s.resolved_at, s.event_count, s.service_name,
  a1."at" AS at1, a1.action AS do1, a1.actor AS who1, a2."at" AS at2, a2.action AS do2, a2.actor AS who2
FROM starts s LEFT JOIN answers a1 ON a1.incident_id = s.id AND a1.g = 1 LEFT JOIN answers a2 ON a2.incident_id = s.id AND a2.g = 2""",
     "starts", "answers")
_cte("step1", "SELECT *, CASE WHEN resolved_at <= t0 THEN 'skipped' ELSE 'succeeded' END AS s1 FROM walk", "walk")
_cte("step2", """
SELECT *, CASE WHEN s1 <> 'succeeded' OR service_name = 'svc-7' THEN NULL WHEN resolved_at <= t0 THEN 'skipped'
  WHEN at1 IS NULL OR at1 >= t0 + INTERVAL 12 HOUR THEN 'timed_out' WHEN do1 = 'reject' THEN 'rejected'
  WHEN (event_count + 2) % 6 = 0 THEN 'failed' ELSE 'succeeded' END AS s2 FROM step1""", "step1")
_cte("step3", """
SELECT *, CASE WHEN s2 IS NULL OR s2 <> 'succeeded' THEN NULL WHEN resolved_at <= at1 THEN 'skipped'
  WHEN at2 IS NULL OR at2 >= at1 + INTERVAL 12 HOUR THEN 'timed_out' WHEN do2 = 'reject' THEN 'rejected'
  WHEN (event_count + 3) % 6 = 0 THEN 'failed' ELSE 'succeeded' END AS s3 FROM step2""", "step2")


def _gated(n: int, name: str, since: str, at: str, who: str, s: str) -> str:
    common = f"SELECT incident_id, 'drain-then-fail-over' AS runbook_id, {n} AS step_index, '{name}' AS step_name, 'webhook' AS action_kind, 'approval' AS mode"
    return f"""
{common}, 1 AS seq, 'skipped' AS status, '' AS actor, {since} AS "at" FROM step3 WHERE {s} = 'skipped'
UNION ALL {common}, 1, 'pending', '', {since} FROM step3 WHERE {s} <> 'skipped'
UNION ALL {common}, 2, 'timed_out', '', {since} + INTERVAL 12 HOUR FROM step3 WHERE {s} = 'timed_out'
UNION ALL {common}, 2, 'rejected', {who}, {at} FROM step3 WHERE {s} = 'rejected'
UNION ALL {common}, 2, 'approved', {who}, {at} FROM step3 WHERE {s} IN ('succeeded','failed')
UNION ALL {common}, 3, {s}, {who}, {at} FROM step3 WHERE {s} IN ('succeeded','failed')"""


_cte("log_", f"""
SELECT incident_id, CASE WHEN service_name = 'svc-7' THEN 'tag-only' ELSE 'drain-then-fail-over' END AS runbook_id, 1 AS step_index,
  CASE WHEN service_name = 'svc-7' THEN 'tag the service' ELSE 'snapshot counters' END AS step_name, 'noop' AS action_kind, 'auto' AS mode,
  CASE WHEN s1 = 'skipped' THEN 1 ELSE 3 END AS seq, s1 AS status, '' AS actor, t0 AS "at" FROM step3
UNION ALL {_gated(2, 'drain the pool', 't0', 'at1', 'who1', 's2')}
UNION ALL {_gated(3, 'fail over', 'at1', 'at2', 'who2', 's3')}""", "step3")
ACTION_NS = "6f1c2d3e-4a5b-11ee-be56-0242ac120002"
_cte("actions_", f"""
SELECT {uuid5(ACTION_NS, "incident_id || ':' || step_index")} AS id, incident_id, runbook_id, step_index, step_name, action_kind, mode,
  status, actor, created_at, updated_at FROM (
  SELECT *, min("at") OVER w AS created_at, max("at") OVER w AS updated_at,
    row_number() OVER (PARTITION BY incident_id, step_index ORDER BY "at" DESC, seq DESC) AS k
  FROM log_ WINDOW w AS (PARTITION BY incident_id, step_index)) WHERE k = 1""", "log_")
_cte("planted_inc", """
SELECT id, fingerprint, opened_at, resolved_at FROM inc WHERE event_count % 7 <> 3
UNION ALL SELECT 'copy-' || id, fingerprint, opened_at + INTERVAL 1 HOUR, resolved_at + INTERVAL 1 HOUR FROM inc WHERE event_count % 7 <> 3 AND event_count % 5 = 0""", "inc")
_cte("planted_actions", """
SELECT id, incident_id, step_index FROM actions_ UNION ALL SELECT 'copy-' || id, incident_id, step_index FROM actions_ WHERE step_index = 2""", "actions_")
_cte("spans", """
SELECT incident_id, step_index, step_name, min("at") FILTER (status = 'pending') AS pending_at,
  min("at") FILTER (status IN ('approved','rejected','timed_out')) AS ended_at,
  bool_or(status = 'timed_out') AS silent
FROM log_ WHERE mode = 'approval' GROUP BY ALL HAVING count(*) FILTER (status = 'pending') > 0""", "log_")
_cte("decided", """
SELECT d.*, s.step_index, s.step_name FROM decisions_ d LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY step_index) AS k FROM spans) s
ON s.incident_id = d.incident_id AND d."at" >= s.pending_at AND (s.ended_at IS NULL OR d."at" < s.ended_at OR (d."at" = s.ended_at AND NOT s.silent))
QUALIFY row_number() OVER (PARTITION BY d.incident_id, d.actor ORDER BY s.pending_at, s.step_index) = 1""", "decisions_", "spans")

_cte("samples", """
SELECT event_type AS path, event_id % 97 = 0 AS failed, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 10 = 0 THEN 429 ELSE 200 END AS status,
  CAST(round(value * 1000) AS BIGINT) AS latency_us FROM events""")
_cte("report", """
SELECT path, 'work of ' || path AS work, count(*) FILTER (NOT failed) AS requests, count(*) FILTER (failed) AS failures,
  count(*) FILTER (NOT failed) / 10.0::DOUBLE AS requests_per_sec,
  CAST(sum(latency_us) FILTER (NOT failed) AS BIGINT) // count(*) FILTER (NOT failed) AS avg_us,
  quantile_disc(latency_us, 0.5) FILTER (NOT failed) AS p50_us, quantile_disc(latency_us, 0.95) FILTER (NOT failed) AS p95_us,
  quantile_disc(latency_us, 0.99) FILTER (NOT failed) AS p99_us
FROM samples GROUP BY path""", "samples")
_cte("days", "SELECT CAST(event_timestamp AS DATE) AS event_date, count(*) AS rows FROM telemetry GROUP BY 1", "telemetry")
_cte("marked", """
SELECT *, CASE WHEN auto_resolved THEN 'open' ELSE status END AS shown FROM inc""", "inc")

_MS = "CASE WHEN {0} > 0 AND {0} < 100 THEN {0} || ' µs' ELSE printf('%.1f', {0} / 1000.0::DOUBLE) || ' ms' END"
_QUARANTINE_TEXT = "string_agg(field || ': ' || message, '; ' ORDER BY ord)"

ORACLES: dict[str, str] = {
    "scan_events": _with("SELECT * FROM telemetry", "telemetry"),
    "scan_incidents": _with("""
SELECT * REPLACE (CASE WHEN event_count % 3 = 0 THEN updated_at + INTERVAL 1 SECOND ELSE updated_at END AS updated_at),
  CASE WHEN event_count % 3 = 0 THEN updated_at END AS alerted_at, NULL::TIMESTAMP AS remediated_at FROM inc""", "inc"),
    "scan_notifications": _with("SELECT * FROM notes", "notes"),
    "scan_actions": _with("SELECT * FROM actions_", "actions_"),
    "stored_window_stats": _with("""
SELECT tenant_id, service_name, count(*) AS total, count(*) FILTER (severity IN ('error','critical')) AS errors,
  count(*) FILTER (severity IN ('error','critical') AND event_timestamp >= TIMESTAMP '2024-01-22') AS new_errors
FROM telemetry WHERE event_timestamp >= TIMESTAMP '2024-01-20' GROUP BY 1, 2""", "telemetry"),
    "write_event_stream": _with(f"""
SELECT tenant_id || ':' || service_name AS record_key,
  '{{"event_id":"' || event_id || '","schema_version":"1.0","tenant_id":"' || tenant_id || '","service_name":"' || service_name
  || '","environment":"' || environment || '","event_type":"' || event_type || '","severity":"' || severity || '","timestamp":"'
  || {iso('event_timestamp')} || '","trace_id":"' || trace_id || '","attributes":' || replace(attributes, ': ', ':') || '}}' AS record_value,
  'telemetry' AS topic, '1.0' AS version, '' AS traceparent, 2 AS n_headers FROM telemetry""", "telemetry"),
    "decode_strict": _decoded(True),
    "decode_lenient": _decoded(False),
    "normalize_events": _with("""
SELECT "offset", n_id AS event_id, n_version AS schema_version, n_tenant AS tenant_id, service_name, n_env AS environment, event_type,
  n_severity AS severity, event_timestamp, trace_id, n_attr AS attributes FROM dirty""", "dirty"),
    "inherit_trace_id": _with("""
SELECT event_id, CASE WHEN trace_id = '' THEN 'req-' || right(event_id, 4) ELSE trace_id END AS trace_id FROM telemetry""", "telemetry"),
    "validate_events": _with("""
SELECT "offset", CAST(row_number() OVER (PARTITION BY "offset" ORDER BY ord) - 1 AS INTEGER) AS pos, field, message FROM problems""", "problems"),
    "check_time_bounds": _with("""
SELECT "offset", CAST(row_number() OVER (PARTITION BY "offset" ORDER BY ord) - 1 AS INTEGER) AS pos, field, message FROM api_problems""", "api_problems"),
    "split_valid": _with('SELECT "offset", n_id AS event_id, n_tenant AS tenant_id, event_timestamp FROM accepted', "accepted"),
    "quarantine": _with(f"""
SELECT CASE WHEN damage IN ('cut','trailing','typed') THEN 'message is not a valid telemetry event' ELSE 'message violates the telemetry event contract' END AS reason,
  CASE WHEN damage IN ('cut','trailing') THEN 'message is not a JSON object' WHEN damage = 'typed' THEN 'field tenant_id must be of type string'
       ELSE 'invalid event: ' || p.message END AS error,
  'telemetry' AS topic, CAST(n % 8 AS INTEGER) AS "partition", v."offset", d_tenant || ':' || service_name AS "key",
  CAST(octet_length(value) AS INTEGER) AS value_bytes,
  CAST(CASE WHEN damage IN ('cut','trailing','typed') THEN 0 ELSE p.n_errors END AS INTEGER) AS n_errors
FROM values_ v LEFT JOIN (SELECT "offset", {_QUARANTINE_TEXT} AS message, count(*) AS n_errors FROM stream_problems GROUP BY 1) p
  ON p."offset" = v."offset"
WHERE damage IN ('cut','trailing','typed') OR p.n_errors > 0""", "values_", "stream_problems"),
    "read_event_batches": _with("""
SELECT request_id, idx AS index, NULL::VARCHAR AS batch_error, d_id AS event_id FROM items
UNION ALL SELECT request_id, NULL, batch_error, NULL FROM request_heads WHERE batch_error IS NOT NULL""", "items", "request_heads"),
    "batch_result": _with("""
SELECT h.request_id, CASE WHEN coalesce(b.accepted, 0) > 0 THEN 'accepted' ELSE 'rejected' END AS status,
  CAST(coalesce(b.accepted, 0) AS INTEGER) AS accepted, CAST(coalesce(b.rejected, 0) AS INTEGER) AS rejected, h.batch_error,
  coalesce(b.errors, '') AS errors
FROM request_heads h LEFT JOIN (
  SELECT request_id, count(*) FILTER (why IS NULL) AS accepted, count(why) AS rejected, string_agg(idx || '|' || why, ';' ORDER BY idx) AS errors
  FROM (SELECT i.*, CASE WHEN damage = 'extra' THEN 'invalid_json|unknown field "extra"'
      WHEN damage = 'typed' THEN 'invalid_json|field tenant_id must be of type string'
      WHEN i."offset" IN (SELECT "offset" FROM api_problems) THEN 'validation_failed' END AS why FROM items i)
  GROUP BY request_id) b USING (request_id)""", "request_heads", "items", "api_problems"),
    "severity_from_status": _with("""
SELECT uid AS event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS severity,
  'request.completed' AS event_type, ts AS event_timestamp,
  '{' || CASE WHEN event_type IN ('error','signup') THEN '"detail":"request failed",' ELSE '' END || '"http_method":"POST","http_route":"/v1/'
  || event_type || '","http_status_code":' || CASE event_type WHEN 'error' THEN 502 WHEN 'signup' THEN 409 ELSE 200 END || ',"latency_ms":'
  || CAST(round(value * 1000) AS BIGINT) // 1000 || ',"object_id":"obj_' || event_id || '","outcome":"'
  || CASE WHEN event_type IN ('error','signup') THEN 'failed' ELSE 'completed' END || '"}' AS attributes FROM base""", "base"),
    "partition_key_and_fingerprint": _with(f"""
SELECT DISTINCT tenant_id || ':' || service_name AS partition_key, 'error_rate' || chr(31) || tenant_id || chr(31) || service_name AS fingerprint,
  {uuid5(INCIDENT_NS, "'error_rate' || chr(31) || tenant_id || chr(31) || service_name")} AS named_id FROM telemetry""", "telemetry"),
    "dedupe_events": _with("""
SELECT event_timestamp, n_id AS event_id, min("offset") AS "offset", CAST(arg_min(copy, "offset") AS INTEGER) AS copy FROM accepted GROUP BY 1, 2""", "accepted"),
    "store_outcomes": _with("""
SELECT "offset", CASE WHEN event_timestamp < TIMESTAMP '2024-01-20' OR copy = 1 THEN 'duplicate' ELSE 'stored' END AS outcome FROM accepted""", "accepted"),
    "insert_if_absent": _with("SELECT event_id, event_timestamp FROM telemetry WHERE event_timestamp >= TIMESTAMP '2024-01-20'", "telemetry"),
    "append_events": _with("""
SELECT DISTINCT n_id AS event_id, event_timestamp, n_tenant AS tenant_id, n_severity AS severity, CAST(event_timestamp AS DATE) AS event_date FROM accepted""", "accepted"),
    "pipeline_metrics": _with("""
SELECT CASE copy WHEN 1 THEN 'duplicate' ELSE 'stored' END AS outcome, count(*) AS records, CAST(sum(n % 300 * 1000) AS BIGINT) AS sum_us,
  min(n % 300 * 1000) AS min_us, max(n % 300 * 1000) AS max_us, round(sum(n % 300 * 1000)::DOUBLE / count(*) / 1000, 3) AS avg_ms
FROM accepted GROUP BY 1""", "accepted"),
    "window_stats": _with("""
SELECT tenant_id, service_name, count(*) AS total, count(*) FILTER (severity IN ('error','critical')) AS errors,
  count(*) FILTER (severity IN ('error','critical') AND event_timestamp >= TIMESTAMP '2024-01-22') AS new_errors
FROM telemetry WHERE event_timestamp >= TIMESTAMP '2024-01-20' GROUP BY 1, 2""", "telemetry"),
    "window_stats_by_tick": _with("SELECT * FROM windows72", "windows72"),
    "replay_windows_half_open": _with("""
SELECT t.tick, 172800000000 AS window_us, tenant_id, service_name, count(*) AS total,
  count(*) FILTER (severity IN ('error','critical')) AS errors,
  count(*) FILTER (severity IN ('error','critical') AND event_timestamp >= t.tick - INTERVAL 12 HOUR) AS new_errors
FROM telemetry e, (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-05', INTERVAL 12 HOUR)) AS tick) t
WHERE e.event_timestamp < t.tick AND e.event_timestamp >= t.tick - INTERVAL 48 HOUR GROUP BY ALL""", "telemetry"),
    "replay_long_lookbacks": _with("""
SELECT t.tick, w.days * 86400000000 AS window_us, tenant_id, service_name, count(*) AS total,
  count(*) FILTER (severity IN ('error','critical')) AS errors,
  count(*) FILTER (severity IN ('error','critical') AND (event_timestamp >= t.tick - INTERVAL 2 HOUR OR t.tick = TIMESTAMP '2024-01-10')) AS new_errors
FROM telemetry e, (VALUES (1), (10)) w(days), (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-02-05', INTERVAL 2 HOUR)) AS tick) t
WHERE e.processed_at <= t.tick AND e.event_timestamp >= t.tick - to_days(w.days) GROUP BY ALL""", "telemetry"),
    "detect_error_rate": _with("SELECT * FROM det", "det"),
    "rules_x_windows": _with("SELECT * FROM det UNION ALL SELECT * FROM det_burst", "det", "det_burst"),
    "rules_two_lookbacks": _with("SELECT * FROM det UNION ALL SELECT * FROM det_spike", "det", "det_spike"),
    "incident_islands": _with("SELECT * FROM inc_0", "inc_0"),
    "incidents_with_actions": _with("SELECT * FROM inc", "inc"),
    "cycle_metrics": _with("""
SELECT tick, CAST(sum(o) AS BIGINT) AS opened, CAST(sum(f) - sum(o) AS BIGINT) AS grouped, CAST(sum(r) AS BIGINT) AS resolved FROM (
  SELECT tick, 1 AS f, 0 AS o, 0 AS r FROM det UNION ALL SELECT opened_at, 0, 1, 0 FROM inc_0
  UNION ALL SELECT resolved_at, 0, 0, 1 FROM inc_0 WHERE auto_resolved) GROUP BY tick""", "det", "inc_0"),
    "apply_actions_transitions": _with(f"""
SELECT action_id, target, action, actor, "at", from_status, CASE action WHEN 'resolve' THEN 'resolved' ELSE 'acknowledged' END AS to_status
FROM judged_acts WHERE coalesce({_LEGAL}, false)""", "judged_acts"),
    "apply_actions_rejected": _with(f"""
SELECT action_id, target, action, actor, "at", from_status, CASE WHEN stored IS NULL THEN 'not_found' ELSE 'invalid_transition' END AS reason
FROM judged_acts WHERE NOT coalesce({_LEGAL}, false)""", "judged_acts"),
    "incident_status": _with("""
SELECT DISTINCT a.target AS id, coalesce(s.status, 'resolved') AS status FROM id_acts a LEFT JOIN stored_inc s ON s.id = a.target""", "id_acts", "stored_inc"),
    "validate_incidents": _with("""
SELECT id, concat_ws('; ', CASE WHEN rule_id = '' THEN 'rule_id is required' END, CASE WHEN trim(title) = '' THEN 'title is required' END,
  CASE WHEN status = 'lost' THEN 'status lost is not recognised' END, CASE WHEN severity = 'huge' THEN 'severity huge is not recognised' END) AS problems
FROM damaged_inc""", "damaged_inc"),
    "check_constraints": _with(f"""
SELECT 'incidents' AS table_name, 'status' AS rule, count(*) FILTER (status = 'lost') AS violations FROM damaged_inc
UNION ALL SELECT 'incidents', 'severity', count(*) FILTER (severity = 'huge') FROM damaged_inc
UNION ALL SELECT 'incidents', 'resolved_at', count(*) FILTER ((status = 'resolved') <> (resolved_at IS NOT NULL)) FROM damaged_inc
UNION ALL SELECT 'incidents', 'rule_id', count(*) FILTER (rule_id = '') FROM damaged_inc
UNION ALL SELECT 'incidents', r, 0 FROM (VALUES ('fingerprint'), ('tenant_id'), ('service_name')) v(r)
UNION ALL SELECT 'telemetry_events', 'severity', count(*) FILTER (n_severity NOT IN {SEVERITIES}) FROM dirty
UNION ALL SELECT 'telemetry_events', 'tenant_id', count(*) FILTER (n_tenant = '') FROM dirty
UNION ALL SELECT 'telemetry_events', r, 0 FROM (VALUES ('schema_version'), ('service_name'), ('event_type')) v(r)
UNION ALL SELECT 'notifications', r, count(*) FILTER (level % 2 = 0) FROM notes, (VALUES ('contact'), ('status')) v(r) GROUP BY r
UNION ALL SELECT 'notifications', r, 0 FROM (VALUES ('level'), ('target'), ('channel')) v(r)
UNION ALL SELECT 'remediation_actions', r, count(*) FILTER (step_index = 1) FROM actions_, (VALUES ('mode'), ('step_name')) v(r) GROUP BY r
UNION ALL SELECT 'remediation_actions', r, 0 FROM (VALUES ('step_index'), ('status'), ('runbook_id')) v(r)""", "damaged_inc", "dirty", "notes", "actions_"),
    "on_call_at": _with(f"""
SELECT i.id, l.level, {_contact('l.level', 'i.opened_at')} AS contact, CAST(l.offset_us AS BIGINT) AS offset_us FROM inc i, levels_ l""", "inc", "levels_"),
    "check_references": _with("""
SELECT 'active_twice' AS problem, id FROM planted_inc i WHERE EXISTS (
  SELECT 1 FROM planted_inc e WHERE e.fingerprint = i.fingerprint AND (e.opened_at, e.id) < (i.opened_at, i.id)
    AND (e.resolved_at IS NULL OR e.resolved_at > i.opened_at))
UNION ALL SELECT 'step_twice', id FROM planted_actions WHERE step_index = 2
UNION ALL SELECT 'orphan_action', id FROM planted_actions WHERE incident_id NOT IN (SELECT id FROM planted_inc)
UNION ALL SELECT 'orphan_notification', id FROM notes WHERE incident_id NOT IN (SELECT id FROM planted_inc)""", "planted_inc", "planted_actions", "notes"),
    "load_policy": _with(f"""
SELECT i.id, l.level, l.target, {_contact('l.level', 'i.opened_at')} AS contact, CAST(l.offset_us AS BIGINT) AS offset_us FROM inc i, levels_ l""", "inc", "levels_"),
    "first_ack_or_resolve": _with("SELECT id, stopped_at, signalled_at FROM watched", "watched"),
    "alert_starts": _with("SELECT id, started_at FROM starts WHERE event_count % 6 <> 0", "starts"),
    "escalation_timeline": _with("SELECT id, incident_id, level, target, contact, contact_address, reason, sent_at FROM pages_", "pages_"),
    "notification_rows": _with("SELECT * FROM notes", "notes"),
    "match_runbook": _with("""
SELECT id, CASE WHEN event_count % 7 = 0 THEN NULL WHEN service_name = 'svc-7' THEN 'tag-only' WHEN event_count % 5 = 0 THEN 'hold-critical'
    ELSE 'drain-then-fail-over' END AS runbook_id,
  CASE WHEN event_count % 7 = 0 THEN NULL WHEN service_name = 'svc-7' OR event_count % 5 = 0 THEN 1 ELSE 3 END AS n_steps FROM inc""", "inc"),
    "load_runbooks": _with("""
SELECT id, CASE WHEN event_count % 7 = 0 THEN NULL WHEN service_name = 'svc-7' THEN 'tag-only' WHEN event_count % 5 = 0 THEN 'hold-critical'
    ELSE 'drain-then-fail-over' END AS runbook_id,
  CASE WHEN event_count % 7 = 0 THEN NULL WHEN service_name = 'svc-7' OR event_count % 5 = 0 THEN 1 ELSE 3 END AS n_steps FROM inc""", "inc"),
    "remediation_starts": _with("""
SELECT id, started_at, CASE WHEN event_count % 7 = 0 THEN 'unmatched' ELSE 'started' END AS outcome,
  CASE WHEN event_count % 7 = 0 THEN NULL WHEN service_name = 'svc-7' THEN 'tag-only' WHEN event_count % 5 = 0 THEN 'hold-critical'
    ELSE 'drain-then-fail-over' END AS runbook_id FROM starts""", "starts"),
    "remediation_timeline": _with("SELECT * FROM log_", "log_"),
    "latest_action_status": _with("SELECT * FROM actions_", "actions_"),
    "step_outcome": _with("""
SELECT incident_id, step_index, status, CASE WHEN status = 'failed' THEN 'remediation target returned status 500' END AS error,
  CASE WHEN status = 'succeeded' THEN action_kind END AS executed FROM actions_ WHERE status IN ('succeeded','failed')""", "actions_"),
    "decide": _with("""
SELECT incident_id, action, actor, "at", CASE WHEN step_index IS NULL THEN 'no_pending_action' WHEN action = 'approve' THEN 'approved' ELSE 'rejected' END AS result,
  step_index, step_name FROM decided""", "decided"),
    "decisions_asof": _with("""
SELECT incident_id, step_index, action, actor, "at" FROM decided WHERE step_index IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY incident_id, step_index ORDER BY "at", action DESC, actor) = 1""", "decided"),
    "pending_action": _with("""
SELECT incident_id, min(step_index) AS step_index, arg_min(step_name, step_index) AS step_name, arg_min(pending_at, step_index) AS updated_at FROM spans
WHERE pending_at <= TIMESTAMP '2024-01-17 02:30:00' AND (ended_at IS NULL OR ended_at > TIMESTAMP '2024-01-17 02:30:00') GROUP BY incident_id""", "spans"),
    "incident_detail": _with("""
SELECT i.id, i.status, i.event_count, coalesce(n.timeline, '') AS timeline, coalesce(a.actions, '') AS actions, a.pending_step
FROM inc i LEFT JOIN (SELECT incident_id, string_agg('L' || level || ':' || target || ':' || status, ';' ORDER BY sent_at, level, target) AS timeline FROM notes GROUP BY 1) n ON n.incident_id = i.id
LEFT JOIN (SELECT incident_id, string_agg(step_index || ':' || status, ';' ORDER BY step_index) AS actions,
  arg_min(step_name, step_index) FILTER (status = 'pending') AS pending_step FROM actions_ GROUP BY 1) a ON a.incident_id = i.id""", "inc", "notes", "actions_"),
    "cascade_filter": _with("SELECT id, incident_id FROM notes WHERE incident_id IN (SELECT id FROM inc WHERE event_count % 3 <> 0)", "notes", "inc"),
    "filter_events": _with("""
SELECT event_id, service_name, event_timestamp FROM telemetry WHERE tenant_id = 'tenant-1' AND severity = 'error'
  AND event_timestamp BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-25 12:00:00'""", "telemetry"),
    "trace_events": _with("SELECT event_id, trace_id, event_timestamp FROM telemetry WHERE trace_id = 'trace-7'", "telemetry"),
    "filter_incidents": _with("SELECT id, service_name FROM inc WHERE status = 'resolved' AND tenant_id = 'tenant-2' AND severity = 'error'", "inc"),
    "get_incident": _with("SELECT id, service_name, status, event_count FROM inc WHERE id = (SELECT min(id) FROM inc)", "inc"),
    "page_events": _with("""
SELECT event_timestamp, event_id, severity FROM telemetry WHERE tenant_id = 'tenant-0' ORDER BY event_timestamp DESC, event_id DESC LIMIT 20 OFFSET 40""", "telemetry"),
    "stored_page_events": _with("""
SELECT event_timestamp, event_id, severity FROM telemetry WHERE tenant_id = 'tenant-0' ORDER BY event_timestamp DESC, event_id DESC LIMIT 20 OFFSET 40""", "telemetry"),
    "stored_trace": _with("SELECT event_id, trace_id, event_timestamp FROM telemetry WHERE trace_id = 'trace-7'", "telemetry"),
    "page_events_offset": _with("SELECT event_timestamp, event_id FROM telemetry ORDER BY event_timestamp DESC, event_id DESC LIMIT 20 OFFSET 40", "telemetry"),
    "page_incidents": _with("SELECT last_seen_at, id, status FROM inc ORDER BY last_seen_at DESC, id DESC LIMIT 15 OFFSET 15", "inc"),
    "cursor_codec": _with(f"""
SELECT translate(rtrim(base64(encode({iso('event_timestamp')} || ',' || event_id)), '='), '+/', '-_') AS token, event_timestamp AS time, event_id AS id FROM telemetry""", "telemetry"),
    "notification_timeline": _with("""
SELECT incident_id, sent_at, level, target, status FROM notes WHERE incident_id = (SELECT max(incident_id) FROM notes)""", "notes"),
    "action_trail": _with("""
SELECT incident_id, step_index, status, actor FROM actions_ WHERE incident_id = (SELECT max(incident_id) FROM actions_)""", "actions_"),
    "unalerted_incidents": _with("SELECT id, opened_at FROM marked WHERE shown = 'open' AND event_count % 3 <> 0", "marked"),
    "unremediated_incidents": _with("SELECT id, opened_at FROM marked WHERE shown = 'open' AND event_count % 4 <> 0", "marked"),
    "count_events": "SELECT count(*) AS total_events FROM events",
    "events_by_service_severity": _with("SELECT service_name, severity, count(*) AS events FROM telemetry GROUP BY 1, 2", "telemetry"),
    "id_uniqueness": _with("SELECT count(*) AS rows, count(DISTINCT n_id) AS distinct_event_ids FROM accepted", "accepted"),
    "duplicate_event_ids": _with("SELECT n_id AS event_id, count(*) AS copies FROM accepted GROUP BY 1 HAVING count(*) > 1", "accepted"),
    "pipeline_latency": _with("""
SELECT round(sum(event_id % 300 * 1000)::DOUBLE / count(*) / 1000, 2) AS avg_ms, round(max(event_id % 300)::DOUBLE, 2) AS max_ms FROM events"""
                              .replace("\n", " "), "base"),
    "recent_events": _with("""
SELECT uid AS event_id, substr(uid, 1, 8) AS short_id, service_name, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS severity,
  CASE event_type WHEN 'error' THEN '502' WHEN 'signup' THEN '409' ELSE '200' END AS http_status,
  CAST(CAST(round(value * 1000) AS BIGINT) // 1000 AS VARCHAR) AS took_ms, strftime(ts, '%H:%M:%S') AS seen_at
FROM base ORDER BY ts DESC, uid DESC LIMIT 10""", "base"),
    "incidents_by_status_severity": _with("SELECT status, severity, count(*) AS incidents FROM inc GROUP BY 1, 2", "inc"),
    "recent_incidents": _with("""
SELECT id, substr(id, 1, 8) AS short_id, service_name, severity, status, event_count, strftime(last_seen_at, '%H:%M:%S') AS active_at FROM (
  SELECT * FROM inc ORDER BY last_seen_at DESC, id DESC LIMIT 10)""", "inc"),
    "actions_by_runbook_status": _with("SELECT runbook_id, status, count(*) AS actions FROM actions_ GROUP BY 1, 2", "actions_"),
    "recent_actions": _with("""
SELECT incident_id, substr(incident_id, 1, 8) AS short_id, step_index, step_name, mode, status, actor, strftime(updated_at, '%H:%M:%S') AS changed_at FROM (
  SELECT * FROM actions_ ORDER BY updated_at DESC, incident_id DESC, step_index DESC LIMIT 10)""", "actions_"),
    "recent_notifications": _with("""
SELECT incident_id, substr(incident_id, 1, 8) AS short_id, level, target, contact, channel, status, strftime(sent_at, '%H:%M:%S') AS paged_at FROM (
  SELECT * FROM notes ORDER BY sent_at DESC, incident_id DESC, level DESC, id LIMIT 10)""", "notes"),
    "backfill_partitions": _with("""
SELECT CAST(event_timestamp AS DATE) AS event_date, count(*) AS rows, min(event_timestamp) AS first_at, max(event_timestamp) AS last_at FROM telemetry GROUP BY 1""", "telemetry"),
    "backfill_days": _with("""
SELECT 'telemetry_events_' || strftime(d, '%Y%m%d') AS name, CAST(d AS DATE) AS event_date FROM (SELECT unnest(generate_series(
  (SELECT min(event_date) FROM days)::TIMESTAMP, greatest((SELECT max(event_date) FROM days), DATE '2024-01-28')::TIMESTAMP + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS d)""", "days"),
    "list_partitions": _with("SELECT 'telemetry_events_' || strftime(event_date, '%Y%m%d') AS name, event_date, rows FROM days", "days"),
    "partition_names": _with("SELECT 'telemetry_events_' || strftime(event_date, '%Y%m%d') AS name, event_date AS day, NULL::DATE AS no_day FROM days", "days"),
    "missing_partitions": _with("""
SELECT 'telemetry_events_' || strftime(d, '%Y%m%d') AS name, CAST(d AS DATE) AS event_date FROM (
  SELECT unnest(generate_series(TIMESTAMP '2024-01-28', TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS d)
WHERE CAST(d AS DATE) NOT IN (SELECT event_date FROM days)""", "days"),
    "partition_plan": _with("""
SELECT 1 AS step, 'create' AS action, 'telemetry_events_' || strftime(d, '%Y%m%d') AS name, CAST(d AS DATE) AS event_date FROM (
  SELECT unnest(generate_series(TIMESTAMP '2024-01-28', TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS d)
WHERE CAST(d AS DATE) NOT IN (SELECT event_date FROM days)
UNION ALL SELECT 2, 'drop', 'telemetry_events_' || strftime(event_date, '%Y%m%d'), event_date FROM days WHERE event_date + 1 < DATE '2024-01-08'""", "days"),
    "default_partition_rows": _with("SELECT CAST(sum(rows) AS BIGINT) AS default_rows FROM days WHERE event_date < DATE '2024-01-10'", "days"),
    "expire_partitions": _with("SELECT event_date, rows FROM days WHERE event_date + 1 >= DATE '2024-01-08'", "days"),
    "drain_default": _with("""
SELECT CASE WHEN event_date >= DATE '2024-01-09' THEN 'daily' ELSE 'parked' END AS area, event_date, rows FROM days""", "days"),
    "collapse_partitions": _with("SELECT DISTINCT n_id AS event_id, event_timestamp FROM accepted", "accepted"),
    "latency_report": _with("SELECT * FROM report", "report"),
    "latency_report_lines": _with(f"""
SELECT path, '| `' || path || '` | ' || work || ' | ' || format('{{:,}}', CAST(round_even(requests_per_sec, 0) AS BIGINT)) || ' | '
  || {_MS.format('avg_us')} || ' | ' || {_MS.format('p50_us')} || ' | ' || {_MS.format('p95_us')} || ' | ' || {_MS.format('p99_us')} || ' |' AS line FROM report""", "report"),
    "status_distribution": _with("""
SELECT path, count(*) FILTER (NOT failed) AS requests, count(*) FILTER (NOT failed AND status = 200) AS successes, count(*) FILTER (failed) AS failures,
  (SELECT string_agg(n || '×' || status, ', ' ORDER BY status) FROM (
     SELECT status, count(*) AS n FROM samples i WHERE i.path = o.path AND NOT failed GROUP BY status)) AS statuses_text,
  count(*) FILTER (failed) = 0 AND bool_and(status = 200) AS is_clean FROM samples o GROUP BY path""", "samples"),
    "stream_ingest": _with("""
SELECT DISTINCT n_id AS event_id, event_timestamp, n_tenant AS tenant_id, n_severity AS severity, CAST(event_timestamp AS DATE) AS event_date
FROM accepted WHERE n % 230 <> 0 AND (n % 250 = 0 OR (n % 270 <> 0 AND n % 290 <> 0))""", "accepted"),
    "read_event_stream": _with("""
SELECT DISTINCT n_id AS event_id, event_timestamp, n_tenant AS tenant_id, n_severity AS severity, CAST(event_timestamp AS DATE) AS event_date
FROM accepted WHERE n % 230 <> 0 AND (n % 250 = 0 OR (n % 270 <> 0 AND n % 290 <> 0))""", "accepted"),
    "stream_windows": _with("SELECT * FROM live_windows", "live_windows"),
    "stream_rule_windows": _with("SELECT * FROM live_windows UNION ALL SELECT * FROM live_windows48", "live_windows", "live_windows48"),
    "stream_rules": _with("SELECT * FROM live_det UNION ALL SELECT * FROM live_det48", "live_det", "live_det48"),
    "stream_incidents": _with(f"""
SELECT {_INCIDENT_ID} AS id, fingerprint, tenant_id, service_name, rule_id, severity, CAST(event_count AS BIGINT) AS event_count,
  opened_at, last_seen_at, last_seen_at + INTERVAL 2 DAY AS resolved_at
FROM (SELECT * FROM live_runs UNION ALL SELECT * FROM live_runs48)""", "live_runs", "live_runs48"),
    # Each firing with the count it left behind, the first acknowledgement, what ended the incident, and every other action.
    "stateful_incidents": _with(f"""
SELECT {_INCIDENT_ID} AS id, * FROM (
  SELECT fingerprint, CASE WHEN tick = opened_at THEN 'opened' ELSE 'grouped' END AS change, tick AS at, opened_at, tick AS last_seen_at, count_then AS event_count, NULL AS action_id
  FROM grown
  UNION ALL SELECT fingerprint, kind, "at", opened_at,
    (SELECT max(tick) FROM grown g WHERE g.fingerprint = e.fingerprint AND g.run = e.run AND g.tick < e."at"),
    (SELECT max_by(count_then, tick) FROM grown g WHERE g.fingerprint = e.fingerprint AND g.run = e.run AND g.tick < e."at"), action_id
  FROM accepted_acts e
  UNION ALL SELECT fingerprint, 'auto_resolved', auto_at, opened_at, last_seen_at, CAST(event_count AS BIGINT), NULL FROM closed WHERE hand_at IS NULL)
UNION ALL SELECT NULL, target, 'rejected', "at", NULL, NULL, NULL, action_id FROM acts WHERE action_id NOT IN (SELECT action_id FROM accepted_acts)
""", "grown", "accepted_acts", "closed", "acts"),
}
