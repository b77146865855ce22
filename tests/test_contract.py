from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.functions.cursor import decode_cursor, encode_cursor, read_cursor
from tideline.functions.frames import local_frame
from tideline.operators import contract
from tideline.schema import LONG, STRING, TELEMETRY, columns
from tideline.sources import batches, streams

NOW = datetime(2026, 7, 25, 9, 30, tzinfo=timezone.utc)
UUID = "0b6f1c7e-6b1a-4a57-9d6e-2f9d3b7c1a10"
GOOD = {
    "event_id": UUID, "schema_version": "1.0", "tenant_id": "acme", "service_name": "orders", "environment": "prod",
    "event_type": "request", "severity": "info", "event_timestamp": NOW, "trace_id": "", "attributes": None,
    "received_at": NOW, "processed_at": NOW,
}
WIRE = (
    f'{{"event_id":"{UUID}","schema_version":"1.0","tenant_id":"acme","service_name":"orders","environment":"prod",'
    '"event_type":"request","severity":"info","timestamp":"2026-07-25T09:30:00Z","trace_id":"t1","attributes":{"k":1}}'
)


def events(spark, *changes):
    return local_frame(spark, [{**GOOD, **c} for c in changes], TELEMETRY)


CASES = [
    ({}, []),
    ({"event_id": ""}, ["event_id"]), ({"event_id": "nope"}, ["event_id"]),
    ({"schema_version": ""}, ["schema_version"]), ({"schema_version": "2.0"}, ["schema_version"]),
    ({"tenant_id": " "}, ["tenant_id"]), ({"service_name": ""}, ["service_name"]), ({"event_type": ""}, ["event_type"]),
    ({"tenant_id": "a" * 128}, []), ({"tenant_id": "a" * 129}, ["tenant_id"]), ({"tenant_id": "é" * 65}, ["tenant_id"]),
    ({"severity": ""}, ["severity"]), ({"severity": "catastrophic"}, ["severity"]), ({"severity": "  ERROR "}, []),
    ({"event_timestamp": None}, ["timestamp"]), ({"trace_id": "a" * 129}, ["trace_id"]), ({"environment": "a" * 129}, ["environment"]),
    ({"event_id": "", "tenant_id": "", "severity": ""}, ["event_id", "tenant_id", "severity"]),
    ({"event_id": UUID.replace("-", "")}, []), ({"event_id": "{" + UUID.upper() + "}"}, []), ({"event_id": "urn:uuid:" + UUID}, []),
]


def test_validation(spark):
    rows = contract.validate_events(contract.normalize_events(events(spark, *[c for c, _ in CASES]))).collect()
    for row, (change, fields) in zip(rows, CASES, strict=True):
        assert [e["field"] for e in row["errors"]] == fields, change
        if not fields:
            assert row["event_id"] == UUID


def test_normalize_is_idempotent(spark):
    messy = events(spark, {"tenant_id": "\t acme 　", "severity": " WARN", "event_id": UUID.upper(), "environment": " ", "attributes": None})
    once = contract.normalize_events(messy)
    row = once.first()
    assert (row.tenant_id, row.severity, row.event_id, row.environment, row.attributes) == ("acme", "warn", UUID, "unknown", "{}")
    assert contract.normalize_events(once).first() == row


@pytest.mark.parametrize("shift,future,age,n", [
    (timedelta(minutes=5), 5, None, 0), (timedelta(minutes=5, microseconds=1), 5, None, 1), (timedelta(days=1461), 5, None, 1),
    (timedelta(days=-900), 5, None, 0), (timedelta(days=-8), 5, 7, 1), (timedelta(days=-7), 5, 7, 0), (timedelta(days=400), 0, 0, 0),
])
def test_time_bounds(spark, shift, future, age, n):
    df = contract.validate_events(events(spark, {"event_timestamp": NOW + shift}))
    out = contract.check_time_bounds(df, NOW, timedelta(minutes=future), None if age is None else timedelta(days=age)).first()
    assert len(out["errors"]) == n
    if n and shift > timedelta(0):
        assert all(w in out["errors"][0]["message"] for w in ("future", "clock", "server time"))


def test_missing_time_has_no_clock_error(spark):
    df = contract.check_time_bounds(contract.validate_events(events(spark, {"event_timestamp": None})), NOW)
    assert [e["message"] for e in df.first()["errors"]] == ["is required and must be an RFC3339 timestamp"]


@pytest.mark.parametrize("us,shown", [
    (1_500_000, "1.5s"), (90_000_000, "1m30s"), (2 * text.HOUR, "2h0m0s"), (47 * text.HOUR, "47h0m0s"), (48 * text.HOUR, "2.0 days"),
    (30140 * text.HOUR + 20 * text.MINUTE, "1255.8 days"), (54 * text.HOUR, "2.2 days"), (60 * text.HOUR, "2.5 days"), (66 * text.HOUR, "2.8 days"),
])
def test_drift(spark, us, shown):
    assert local_frame(spark, [{"us": us}], columns(us=LONG)).select(text.drift_text(F.col("us"))).first()[0] == shown


def test_durations_agree(spark):
    values = [0, 1, 999, 1_500, 250_000, 1_000_000, 61_000_001, text.HOUR, 168 * text.HOUR, 3_661_500_000]
    shown = [r[0] for r in local_frame(spark, [{"us": v} for v in values], columns(us=LONG)).select(text.duration_text(F.col("us"))).collect()]
    assert shown == [text.duration_literal(v) for v in values]
    assert shown[-2:] == ["168h0m0s", "1h1m1.5s"] and shown[3] == "1.5ms"


@pytest.mark.parametrize("shown,ok", [
    ("2026-07-22T10:30:00Z", True), ("2026-07-22T12:30:00+02:00", True), ("2026-07-22T10:30:00.123456Z", True),
    ("2026-07-22", False), ("yesterday", False), ("", False), ("2026-02-30T00:00:00Z", False), ("2026-07-22 10:30:00Z", False),
])
def test_rfc3339(spark, shown, ok):
    got = local_frame(spark, [{"t": shown}], columns(t=STRING)).select(text.parse_rfc3339(F.col("t")).alias("t")).first()[0]
    assert (got is not None) == ok
    if ok:
        assert got.replace(microsecond=0) == datetime(2026, 7, 22, 10, 30)


def decoded(spark, bodies, strict=False):
    frame = local_frame(spark, [{"n": i, "value": b} for i, b in enumerate(bodies)], columns(n=LONG, value=STRING))
    checked = contract.check_time_bounds(contract.validate_events(contract.normalize_events(contract.decode_events(frame, strict=strict))), NOW)
    return checked.orderBy("n").collect()


def test_decode_good(spark):
    row = decoded(spark, [WIRE], strict=True)[0]
    assert (row.decode_error, row["errors"], row.attributes, row.trace_id) == (None, [], '{"k":1}', "t1")
    assert row.event_timestamp == datetime(2026, 7, 25, 9, 30)


BAD = {
    "not json": "nope", "array": "[1]", "blank": "", "two": WIRE + WIRE, "list": WIRE + "," + WIRE, "tail": WIRE + " x", "closed": WIRE + "] x",
    "closed twice": WIRE + "],[" + WIRE, "quotes": WIRE.replace('"', "'"), "number": WIRE.replace('"acme"', "5"), "object": WIRE.replace('"acme"', "{}"),
    "bool": WIRE.replace('"t1"', "true"), "time number": WIRE.replace('"2026-07-25T09:30:00Z"', "5"), "time null": WIRE.replace('"2026-07-25T09:30:00Z"', "null"),
    "date only": WIRE.replace("2026-07-25T09:30:00Z", "2026-07-25"), "attribute list": WIRE.replace('{"k":1}', "[1]"), "attribute text": WIRE.replace('{"k":1}', '"x"'),
    "earlier number": WIRE.replace('"tenant_id"', '"tenant_id":5,"Tenant_ID"'), "other case number": WIRE.replace('"tenant_id":"acme"', '"TENANT_ID":5'),
    "nested decoy": WIRE.replace('"acme"', "5").replace('{"k":1}', '{"tenant_id":"5"}'), "escaped key": WIRE.replace('"tenant_id":"acme"', '"tenant\\u005fid":5'),
}


def test_decode_refuses(spark):
    names = [n for n in BAD if n != "earlier number"]
    rows = decoded(spark, [BAD[n] for n in names])
    assert [n for n, r in zip(names, rows, strict=True) if r.decode_error is None] == []


def test_decode_lenient_and_strict(spark):
    extra, cased = WIRE.replace('"k":1', '"k":[{"a":1}]').replace('{"event', '{"zzz":1,"event', 1), WIRE.replace('"tenant_id"', '"Tenant_Id"')
    nulls, twice = WIRE.replace('"t1"', "null").replace('{"k":1}', "null"), WIRE.replace('"acme"', '"old","tenant_id":"acme"')
    lenient = decoded(spark, [extra, cased, nulls, twice, "{}", "null"])
    assert [r.decode_error for r in lenient] == [None] * 6
    assert [r.tenant_id for r in lenient[:4]] == ["acme"] * 4
    assert (lenient[2].trace_id, lenient[2].attributes) == ("", "{}")
    assert len(lenient[4]["errors"]) == len(lenient[5]["errors"]) == 7
    assert [r.decode_error for r in decoded(spark, [extra, cased], strict=True)] == ['unknown field "zzz"', None]


def test_batches(spark):
    bad_severity, extra = WIRE.replace('"info"', '"huge"'), WIRE.replace('{"event', '{"zzz":1,"event', 1)
    bodies = {
        "mixed": f'{{"events":[{WIRE},{bad_severity},{WIRE}]}}', "unknown": f'{{"events":[{WIRE},{extra}]}}', "none": f'{{"events":[{bad_severity}]}}',
        "empty": '{"events":[]}', "missing": "{}", "cut": '{"events":[', "key": f'{{"event":[{WIRE}]}}', "scalar": '{"events":[5,"x",null]}',
        "big": '{"events":[' + ",".join([WIRE] * 4) + "]}",
    }
    requests = local_frame(spark, [{"request_id": k, "body": v} for k, v in bodies.items()], columns(request_id=STRING, body=STRING))
    items = contract.decode_events(batches.explode_batches(requests, max_events=3), raw="raw", strict=True)
    judged = contract.check_time_bounds(contract.validate_events(contract.normalize_events(items)), NOW)
    got = {r.request_id: r for r in batches.batch_result(judged).collect()}
    assert {k: (r.status, r.accepted, r.rejected, r.batch_error) for k, r in got.items()} == {
        "mixed": ("accepted", 2, 1, None), "unknown": ("accepted", 1, 1, None), "none": ("rejected", 0, 1, None), "empty": ("rejected", 0, 0, "empty_batch"),
        "missing": ("rejected", 0, 0, "empty_batch"), "cut": ("rejected", 0, 0, "invalid_json"), "key": ("rejected", 0, 0, "invalid_json"),
        "scalar": ("rejected", 0, 3, None), "big": ("rejected", 0, 0, "batch_too_large"),
    }
    assert [(e["index"], e["error"], [d["field"] for d in e["details"]]) for e in got["mixed"]["errors"]] == [(1, "validation_failed", ["severity"])]
    assert [(e["index"], e["error"]) for e in got["unknown"]["errors"]] == [(1, "invalid_json")]
    assert [e["error"] for e in got["scalar"]["errors"]] == ["invalid_json", "invalid_json", "validation_failed"]


def test_stream_record_round_trip(spark):
    records = streams.to_stream_records(contract.normalize_events(events(spark, {"attributes": '{"a": [1]}'}, {})), "topic")
    back = contract.decode_events(records, strict=True).select(*contract.EVENT_COLUMNS, "decode_error").collect()
    assert [r.decode_error for r in back] == [None, None] and {r.attributes for r in back} == {'{"a":[1]}', None}
    head = records.select(F.col("key").cast("string"), streams.header_value("headers", "content-type"), streams.header_value("headers", "none")).first()
    assert tuple(head) == ("acme:orders", "application/json", "")


def test_cursor(spark):
    frame = events(spark, {"event_timestamp": NOW.replace(microsecond=120)}).select(encode_cursor(F.col("event_timestamp"), F.col("event_id")).alias("token"))
    token = frame.first()[0]
    assert not set(token) & set("+/=\n") and read_cursor(token) == (NOW.replace(microsecond=120), UUID)
    back = frame.select(decode_cursor(F.col("token")).alias("c")).first()["c"]
    assert (back.time, back.id) == (NOW.replace(microsecond=120, tzinfo=None), UUID)
    assert read_cursor("") is None
    junk = ["???", "YWJj", "bm90LWEtdGltZSxpZA", "MjAyNi0wNy0yNVQwOTozMDowMFos"]
    for bad in junk:
        with pytest.raises(ValueError):
            read_cursor(bad)
    shown = local_frame(spark, [{"t": j} for j in junk], columns(t=STRING)).select(decode_cursor(F.col("t")).alias("c")).collect()
    assert [r.c for r in shown] == [None] * 4


def test_uuid5(spark):
    import uuid

    space = "1b4e28ba-2fa1-11d2-883f-0016d3cca427"
    names = ["a:1:escalation", "é", ""] + [f"n{i}" for i in range(40)]
    got = [r[0] for r in local_frame(spark, [{"n": n} for n in names], columns(n=STRING)).select(text.uuid5(space, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(space), n)) for n in names]


def test_relative_and_latency_text(spark):
    ages = [(-5, "just now"), (59, "59s ago"), (60, "1m ago"), (7200, "2h ago"), (200_000, "2d ago")]
    frame = local_frame(spark, [{"us": s} for s, _ in ages], columns(us=LONG))
    now = F.timestamp_micros(F.lit(10**15))
    shown = frame.select(text.relative_time(F.timestamp_micros(F.lit(10**15) - F.col("us") * 1_000_000), now)).collect()
    assert [r[0] for r in shown] == [t for _, t in ages]
    us = [(2_400, "2.4 ms"), (40, "40 µs"), (0, "0.0 ms"), (34_850, "34.9 ms"), (2_050, "2.0 ms"), (250, "0.2 ms")]
    shown = local_frame(spark, [{"us": v} for v, _ in us], columns(us=LONG)).select(text.latency_text(F.col("us"))).collect()
    assert [r[0] for r in shown] == [t for _, t in us]
