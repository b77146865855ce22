"""Column expressions for text, durations, ids and tokens. All stay inside the JVM."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.schema import FINGERPRINT_SEPARATOR

# fixed values: the Unicode White_Space characters
WHITE_SPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# fixed value: RFC 3339 date-time with upper-case T and Z
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
UUID_TEXT = (
    r"^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    r"|[0-9a-f]{32}"
    r"|\{[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}"
    r"|urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"
)

US = 1
MILLISECOND = 1_000
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(span: timedelta | int) -> int:
    """A duration as whole microseconds."""
    if isinstance(span, timedelta):
        return (span.days * 86_400 + span.seconds) * SECOND + span.microseconds
    return int(span)


def trim_space(c: Column) -> Column:
    """Strip Unicode white space at both ends (plain ``trim`` only strips 0x20)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_space(c), F.lit("")) == ""


def is_uuid(c: Column) -> Column:
    """``c`` is already lower case."""
    return c.rlike(UUID_TEXT)


def canonical_uuid(c: Column) -> Column:
    """The hyphenated 36-character form of any accepted spelling; other text is left alone."""
    digits = F.regexp_replace(c, r"^urn:uuid:|[{}-]", "")
    spelled = F.concat_ws(
        "-", *[F.substring(digits, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    return F.when((F.length(c) != 36) & is_uuid(c), spelled).otherwise(c)


def parse_rfc3339(c: Column) -> Column:
    """A timestamp, or null when the text is not RFC 3339 (Spark's own cast also takes bare dates)."""
    return F.when(c.rlike(RFC3339), F.translate(c, ",", ".").try_cast("timestamp"))


def _fraction(us: Column) -> Column:
    """``.123`` for the sub-second part, nothing for a whole second."""
    digits = F.rtrim(F.lpad(us.cast("string"), 6, "0"), F.lit("0"))
    return F.when(us == 0, F.lit("")).otherwise(F.concat(F.lit("."), digits))


def rfc3339_nano(ts: Column) -> Column:
    """UTC text with the shortest fraction that keeps every microsecond."""
    sub_second = F.pmod(F.unix_micros(ts), F.lit(SECOND))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), _fraction(sub_second), F.lit("Z"))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def floor_div(c: Column, unit: int) -> Column:
    """Floor division that is exact in long arithmetic for any sign."""
    return F.call_function("div", c - F.pmod(c, F.lit(unit).cast("long")), F.lit(unit).cast("long"))


def ceil_div(c: Column, unit: int) -> Column:
    return floor_div(c + F.lit(unit - 1), unit)


def duration_text(us: Column) -> Column:
    """``1h2m3.5s`` style rendering of a non-negative microsecond count."""
    hours = floor_div(us, HOUR)
    minutes = floor_div(F.pmod(us, F.lit(HOUR)), MINUTE)
    rest = F.pmod(us, F.lit(MINUTE))
    seconds = F.concat(floor_div(rest, SECOND), _fraction(F.pmod(rest, F.lit(SECOND))), F.lit("s"))
    millis = F.concat(floor_div(us, MILLISECOND), _fraction(F.pmod(us, F.lit(MILLISECOND)) * 1000), F.lit("ms"))
    return (
        F.when(us == 0, F.lit("0s"))
        .when(us < MILLISECOND, F.concat(us, F.lit("µs")))
        .when(us < SECOND, millis)
        .when(us < MINUTE, seconds)
        .when(us < HOUR, F.concat(minutes, F.lit("m"), seconds))
        .otherwise(F.concat(hours, F.lit("h"), minutes, F.lit("m"), seconds))
    )


def duration_literal(span: timedelta | int) -> str:
    """The same rendering for a driver-side constant such as a rule's window."""
    us = micros(span)
    if us == 0:
        return "0s"
    if us < SECOND:
        unit, name = (MILLISECOND, "ms") if us >= MILLISECOND else (US, "µs")
        return f"{us / unit:.6f}".rstrip("0").rstrip(".") + name
    minutes, rest = divmod(us, MINUTE)
    hours, minutes = divmod(minutes, 60)
    seconds = f"{rest // SECOND}.{rest % SECOND:06d}".rstrip("0").rstrip(".") + "s"
    if hours:
        return f"{hours}h{minutes}m{seconds}"
    return f"{minutes}m{seconds}" if minutes else seconds


def _nearest(us: Column, unit: int) -> Column:
    return floor_div(us + F.lit(unit // 2), unit) * F.lit(unit)


def _one_decimal(us: Column, unit: int, quotient: Column) -> Column:
    """``us / unit`` with one decimal, rounded the way printing the double ``quotient`` rounds.

    Only an exact half needs the double: its binary value lies a little above or below the half, and
    that decides; a double that is the half itself goes to the even digit.
    """
    tenths, rest = floor_div(us * 10, unit), F.pmod(us * 10, F.lit(unit).cast("long")) * 2
    wide = "decimal(38,0)"
    # The fraction of the double as a whole number of 2^-56 parts, which is exact.
    parts = ((quotient - F.floor(quotient)) * F.lit(float(2**56))).cast("long").cast(wide) * F.lit(unit).cast("decimal(12,0)")
    half = F.pmod(us, F.lit(unit).cast("long")).cast("decimal(12,0)") * F.lit(2**56).cast("decimal(18,0)")
    up = (
        F.when(rest != unit, (rest > unit).cast("long"))
        .when(parts > half, F.lit(1)).when(parts < half, F.lit(0)).otherwise(F.pmod(tenths, F.lit(2)))
    )
    rounded = tenths + up
    return F.concat(floor_div(rounded, 10), F.lit("."), F.pmod(rounded, F.lit(10)))


def drift_text(us: Column) -> Column:
    """How far a clock is off, at a readable precision: days, minutes, seconds or milliseconds."""
    days = _one_decimal(us, DAY, us / F.lit(float(HOUR)) / F.lit(24.0))
    return (
        F.when(us >= 48 * HOUR, F.concat(days, F.lit(" days")))
        .when(us >= HOUR, duration_text(_nearest(us, MINUTE)))
        .when(us >= MINUTE, duration_text(_nearest(us, SECOND)))
        .otherwise(duration_text(_nearest(us, MILLISECOND)))
    )


def relative_time(ts: Column, now: Column) -> Column:
    """``3m ago`` for a person reading a list."""
    seconds = floor_div(F.unix_micros(now) - F.unix_micros(ts) + F.lit(SECOND // 2), SECOND)
    return (
        F.when(ts.isNull(), F.lit("—"))
        .when(seconds < 0, F.lit("just now"))
        .when(seconds < 60, F.concat(seconds, F.lit("s ago")))
        .when(seconds < 3_600, F.concat(floor_div(seconds, 60), F.lit("m ago")))
        .when(seconds < 86_400, F.concat(floor_div(seconds, 3_600), F.lit("h ago")))
        .otherwise(F.concat(floor_div(seconds, 86_400), F.lit("d ago")))
    )


def latency_text(us: Column) -> Column:
    """Milliseconds with one decimal, or whole microseconds where that would read 0.0 ms."""
    return F.when((us > 0) & (us < 100), F.concat(us, F.lit(" µs"))).otherwise(
        F.concat(_one_decimal(us, MILLISECOND, us / F.lit(1000.0)), F.lit(" ms"))
    )


def fingerprint(rule_id: Column, tenant: Column, service: Column) -> Column:
    return F.concat_ws(FINGERPRINT_SEPARATOR, rule_id, tenant, service)


def partition_key(tenant: Column, service: Column) -> Column:
    return F.concat(tenant, F.lit(":"), service)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based (SHA-1) UUID of a text column."""
    space = F.lit(uuid.UUID(namespace).bytes)
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    # Clock-sequence nibble: keep the low two bits, set the variant.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )
