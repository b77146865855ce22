"""The event contract: decode, normalise, validate, time bounds, split."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import messages
from tideline.functions import text
from tideline.functions.frames import instant, with_settled
from tideline.schema import (
    DEFAULT_ENVIRONMENT,
    MAX_IDENTIFIER_BYTES,
    SCHEMA_VERSIONS,
    SEVERITIES,
    WIRE_FIELDS,
)

FIELD_ERRORS = "array<struct<field:string,message:string>>"
TEXT_FIELDS = tuple(f for f in WIRE_FIELDS if f not in ("timestamp", "attributes"))
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

EVENT_COLUMNS = tuple("event_timestamp" if f == "timestamp" else f for f in WIRE_FIELDS)

# The type text of a record in Spark's alphabetical key order, after its attributes: every field may be
# missing, none may have another type or another name.
_TEXT_KINDS = "".join(
    rf"({n}: {'STRING' if n == 'timestamp' else '(STRING|VOID)'}(, |(?=>>$)))?" for n in sorted(WIRE_FIELDS) if n != "attributes"
)


def _as_declared(kinds: Column, own: Column) -> Column:
    """Whether ``kinds``, the type text of ``[record]``, is that of a record with only declared types.

    The attributes may hold anything. ``own``, their type text, comes first in the record's, so exactly
    that much is cut off before the rest is matched.
    """
    head = "ARRAY<OBJECT<"
    opened = F.concat(F.lit(f"{head}attributes: "), own)
    rest = F.when(own.isNull(), F.substr(kinds, F.lit(len(head) + 1))).when(
        F.startswith(kinds, opened) & own.rlike("^(OBJECT<|VOID$)"), F.substr(kinds, F.length(opened) + 1)
    )
    return F.coalesce(rest.rlike(rf"^(, )?{_TEXT_KINDS}>>$"), F.lit(False))


def _wrapped(raw: Column) -> Column:
    """As a one-element array: text after the JSON value makes the whole parse fail."""
    return F.concat(F.lit("["), raw, F.lit("]"))


def single_json(raw: Column) -> Column:
    """The one JSON value in ``raw`` as a variant, null when it is malformed, absent or followed by more."""
    array = F.try_parse_json(_wrapped(raw))
    # "x] y" would close the wrapper early; only text with a bracket pays for a second look.
    enclosed = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}"))).isNotNull()
    second = F.try_variant_get(array, "$[1]", "variant")
    return F.when(
        F.when(F.contains(raw, F.lit("]")), enclosed).otherwise(F.lit(True)) & second.isNull(),
        F.try_variant_get(array, "$[0]", "variant"),
    )


def _values_by_field(fields: Column) -> Column:
    """Variants in ``WIRE_FIELDS`` order, whatever the letter case of the key."""
    entries = F.map_entries(fields)
    return F.transform(
        F.array(*[F.lit(name) for name in WIRE_FIELDS]),
        lambda name: F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"],
    )


def decode_events(df: DataFrame, raw: str = "value", strict: bool = False) -> DataFrame:
    """Decode JSON records (text or binary) into event columns plus ``decode_error``, null when all is well.

    ``strict`` also refuses unknown keys. A value of the wrong JSON type is refused in both modes; a
    JSON null is a blank field. A record whose types are all as declared is read straight into columns;
    only the others go through the field-by-field decode, so its cost grows with the share of bad input.
    """
    body = F.col(raw).cast("string")
    wire = "array<struct<" + ",".join(f"{n}:{'variant' if n == 'attributes' else 'string'}" for n in WIRE_FIELDS) + ">>"
    parsed = df.select("*", body.alias("_body"), F.from_json(_wrapped(body), wire, STRICT_JSON).alias("_parsed"))
    parsed = parsed.select(
        "*", F.schema_of_variant(F.try_parse_json(_wrapped(F.col("_body")))).alias("_shape"),
        F.schema_of_variant(F.get("_parsed", F.lit(0))["attributes"]).alias("_own"),
    )
    # A bracket after an object may have closed the wrapper early; let the slow decode find out.
    closed = F.contains("_body", F.lit("]")) & F.col("_body").rlike(r"\}\s*\]")
    plain = (F.size("_parsed") == 1) & _as_declared(F.col("_shape"), F.col("_own")) & ~closed
    first = parsed.select("*", F.when(plain, F.get("_parsed", F.lit(0))).alias("_quick"))
    slow = F.col("_quick").isNull()
    second = first.select("*", F.when(slow, single_json(F.coalesce("_body", F.lit("")))).alias("_doc"))
    third = second.select("*", F.col("_doc").try_cast("map<string,variant>").alias("_map"))
    values = third.select("*", F.when(slow, _values_by_field(F.col("_map"))).alias("_values"))
    sifted = values.select(
        "*",
        F.transform("_values", F.schema_of_variant).alias("_kinds"),
        F.transform("_values", lambda v: F.try_variant_get(v, "$", "string")).alias("_texts"),
    )

    def at(column: str, name: str) -> Column:
        return F.get(column, F.lit(WIRE_FIELDS.index(name)))

    def text_of(name: str) -> Column:
        return F.coalesce(F.when(slow, at("_texts", name)).otherwise(F.col("_quick")[name]), F.lit(""))

    time_text = F.when(slow, at("_texts", "timestamp")).otherwise(F.col("_quick.timestamp"))
    attributes = F.to_json(F.when(slow, at("_values", "attributes")).otherwise(F.col("_quick.attributes")))
    opened = sifted.select(
        *df.columns, "_body", "_doc", "_map", "_kinds", slow.alias("_slow"), *[text_of(n).alias(n) for n in TEXT_FIELDS],
        time_text.alias("_time_text"), text.parse_rfc3339(time_text).alias("event_timestamp"),
        attributes.alias("attributes"),
    )

    # The slow decode alone can meet these; they are tested in this order.
    not_object = F.col("_doc").isNull() | (F.col("_map").isNull() & (F.schema_of_variant("_doc") != F.lit("VOID")))
    names = F.array(*[F.lit(n) for n in TEXT_FIELDS])
    wrong_text = F.get(F.filter(
        names, lambda n: ~F.get("_kinds", F.array_position(F.array(*[F.lit(w) for w in WIRE_FIELDS]), n).cast("int") - 1).isin("STRING", "VOID")
    ), F.lit(0))
    time_kind, tail_kind = at("_kinds", "timestamp"), at("_kinds", "attributes")
    slow_error = F.coalesce(
        F.when(not_object, F.lit("message is not a JSON object")),
        F.when(wrong_text.isNotNull(), F.concat(F.lit("field "), wrong_text, F.lit(" must be of type string"))),
        F.when(~time_kind.isin("STRING", "VOID"), F.lit("timestamp must be an RFC3339 string")),
        F.when((time_kind == "VOID"), F.lit('timestamp "" is not a valid RFC3339 timestamp')),
        F.when(~(tail_kind.startswith("OBJECT<") | (tail_kind == "VOID")), F.lit("field attributes must be of type object")),
    )
    bad_time = F.when(
        F.col("_time_text").isNotNull() & F.col("event_timestamp").isNull(),
        F.concat(F.lit('timestamp "'), F.col("_time_text"), F.lit('" is not a valid RFC3339 timestamp')),
    )
    errors = [F.when(F.col("_slow"), slow_error), bad_time]
    if strict:
        keys = F.when(F.col("_slow"), F.map_keys("_map")).otherwise(F.json_object_keys("_body"))
        unknown = F.get(F.filter(keys, lambda k: ~F.lower(k).isin(*WIRE_FIELDS)), F.lit(0))
        undecodable = F.when(F.col("_slow") & not_object, F.lit("message is not a JSON object"))
        errors = [undecodable, F.when(unknown.isNotNull(), F.concat(F.lit('unknown field "'), unknown, F.lit('"'))), *errors]
    # Year 1 at midnight is the zero time: present in the text, absent as a value.
    zero = F.lit("0001-01-01 00:00:00").cast("timestamp")
    return with_settled(
        opened, df.columns,
        **{name: F.col(name) for name in TEXT_FIELDS},
        event_timestamp=F.when(F.col("event_timestamp") != zero, F.col("event_timestamp")),
        attributes=F.when(F.col("attributes") != "null", F.col("attributes")),
        decode_error=F.coalesce(*errors),
    )


def normalize_events(df: DataFrame) -> DataFrame:
    """Trim, lower-case and default the contract's fields; running it twice changes nothing."""
    def trimmed(name: str) -> Column:
        return F.coalesce(text.trim_space(F.col(name)), F.lit(""))

    environment = trimmed("environment")
    return df.withColumns({
        "event_id": text.canonical_uuid(F.lower(trimmed("event_id"))),
        "schema_version": trimmed("schema_version"),
        "tenant_id": trimmed("tenant_id"),
        "service_name": trimmed("service_name"),
        "environment": F.when(environment == "", F.lit(DEFAULT_ENVIRONMENT)).otherwise(environment),
        "event_type": trimmed("event_type"),
        "severity": F.lower(trimmed("severity")),
        "trace_id": trimmed("trace_id"),
        "attributes": F.coalesce(F.col("attributes"), F.lit("{}")),
    })


def inherit_trace_id(df: DataFrame, request_trace: str) -> DataFrame:
    """A blank trace id takes the one of the request that carried the event."""
    own = F.nullif(F.col("trace_id"), F.lit(""))
    return df.withColumn("trace_id", F.coalesce(own, F.col(request_trace), F.lit("")))


def _problem(field: str, message: str | Column) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(field).alias("field"), message.alias("message"))


def _go_quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))


def _required_text(field: str) -> Column:
    c = F.coalesce(F.col(field), F.lit(""))
    return F.when(c == "", _problem(field, messages.REQUIRED)).when(
        F.octet_length(c) > MAX_IDENTIFIER_BYTES, _problem(field, messages.TOO_LONG.format(limit=MAX_IDENTIFIER_BYTES))
    )


def _bounded_text(field: str) -> Column:
    return F.when(
        F.octet_length(field) > MAX_IDENTIFIER_BYTES, _problem(field, messages.TOO_LONG.format(limit=MAX_IDENTIFIER_BYTES))
    )


def _vocabulary(field: str, noun: str, allowed: tuple[str, ...]) -> Column:
    c = F.coalesce(F.col(field), F.lit(""))
    complaint = F.concat(_go_quoted(c), F.lit(messages.NOT_SUPPORTED.format(noun=noun, allowed=", ".join(allowed))))
    return F.when(c == "", _problem(field, messages.REQUIRED)).when(~c.isin(*allowed), _problem(field, complaint))


def validate_events(df: DataFrame) -> DataFrame:
    """Add ``errors``: every contract violation of the row, in field order. Limits count bytes."""
    event_id = F.coalesce(F.col("event_id"), F.lit(""))
    checks = [
        F.when(event_id == "", _problem("event_id", messages.REQUIRED)).when(
            ~text.is_uuid(event_id), _problem("event_id", messages.NOT_A_UUID)
        ),
        _vocabulary("schema_version", "schema version", SCHEMA_VERSIONS),
        _required_text("tenant_id"),
        _required_text("service_name"),
        _required_text("event_type"),
        _bounded_text("environment"),
        _vocabulary("severity", "severity", SEVERITIES),
        F.when(F.col("event_timestamp").isNull(),
               _problem("timestamp", messages.NO_TIMESTAMP)),
        _bounded_text("trace_id"),
    ]
    found = F.array_compact(F.array(*checks))
    if "decode_error" in df.columns:
        found = F.when(F.col("decode_error").isNull(), found).otherwise(F.array().cast(FIELD_ERRORS))
    return with_settled(df, df.columns, errors=found)


def check_time_bounds(
    df: DataFrame,
    now: datetime | Column,
    max_future: timedelta | None = timedelta(minutes=5),
    max_age: timedelta | None = None,
) -> DataFrame:
    """Append clock problems to ``errors``. A bound that is absent, zero or negative is not checked.

    The stream side passes no ``max_age``: a backlog only ever gets older and must never be dropped.
    """
    now = instant(now)
    ahead = F.unix_micros("event_timestamp") - F.unix_micros(now)
    checks = []
    if max_future is not None and text.micros(max_future) > 0:
        limit = text.duration_literal(max_future)
        checks.append(F.when(ahead > text.micros(max_future), _problem("timestamp", F.concat(
            F.lit("is "), text.drift_text(ahead), F.lit(messages.IN_THE_FUTURE.format(limit=limit)),
            text.rfc3339(now), F.lit(messages.CHECK_THE_CLOCK)))))
    if max_age is not None and text.micros(max_age) > 0:
        limit = text.duration_literal(max_age)
        checks.append(F.when(-ahead > text.micros(max_age), _problem("timestamp", F.concat(
            F.lit("is "), text.drift_text(-ahead), F.lit(messages.TOO_OLD.format(limit=limit)),
            text.rfc3339(now), F.lit(")")))))
    if not checks:
        return df
    found = F.array_compact(F.array(*checks))
    if "decode_error" in df.columns:
        found = F.when(F.col("decode_error").isNull(), found).otherwise(F.array().cast(FIELD_ERRORS))
    return with_settled(df, [c for c in df.columns if c != "errors"], errors=F.concat("errors", found))


def _acceptable(df: DataFrame) -> Column:
    clean = F.size("errors") == 0
    return clean & F.col("decode_error").isNull() if "decode_error" in df.columns else clean


def error_text(errors: Column) -> Column:
    """All problems of a row as one line."""
    return F.concat(
        F.lit(messages.INVALID_EVENT),
        F.array_join(F.transform(errors, lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; "),
    )


def quarantine(df: DataFrame) -> DataFrame:
    """The refused records: why, and where in the source to find them again."""
    decoded = "decode_error" in df.columns
    undecodable = F.col("decode_error").isNotNull() if decoded else F.lit(False)
    where = [F.col(c) for c in ("topic", "partition", "offset") if c in df.columns]
    if "key" in df.columns:
        where.append(F.col("key").cast("string").alias("key"))
    if "value" in df.columns:
        where.append(F.octet_length("value").alias("value_bytes"))
    detail = F.col("decode_error") if decoded else F.lit(None).cast("string")
    return df.filter(~_acceptable(df)).select(
        F.when(undecodable, F.lit(messages.NOT_AN_EVENT))
        .otherwise(F.lit(messages.BREAKS_CONTRACT)).alias("reason"),
        F.coalesce(detail, error_text(F.col("errors"))).alias("error"),
        F.col("errors"),
        *where,
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the check columns, and the quarantine."""
    accepted = df.filter(_acceptable(df)).drop("errors", "decode_error")
    return accepted, quarantine(df)
