"""Position tokens for keyset paging: URL-safe base64 of ``<RFC 3339 time>,<id>``."""

from __future__ import annotations

import base64
import binascii
import re
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.text import RFC3339, parse_rfc3339, rfc3339_nano


class Cursor(NamedTuple):
    time: datetime
    id: str


def encode_cursor(ts: Column, id_: Column) -> Column:
    raw = F.concat(rfc3339_nano(ts), F.lit(","), id_)
    wrapped = F.base64(F.encode(raw, "UTF-8"))
    # Spark folds base64 text at 76 characters; a token is one unbroken word without padding.
    return F.when(ts.isNull() & id_.isNull(), F.lit("")).otherwise(F.translate(wrapped, "+/=\r\n", "-_"))


def decode_cursor(token: Column) -> Column:
    """``struct<time, id>``; null for a malformed token."""
    well_formed = token.rlike("^[A-Za-z0-9_-]+$") & (F.pmod(F.length(token), F.lit(4)) != 1)
    padded = F.rpad(
        F.translate(token, "-_", "+/"), F.length(token) + F.pmod(-F.length(token), F.lit(4)), F.lit("=")
    )
    raw = F.when(well_formed, F.unbase64(padded).cast("string"))
    time = parse_rfc3339(F.substring_index(raw, ",", 1))
    id_ = F.regexp_extract(raw, "^[^,]*,(?s)(.+)$", 1)
    return F.when(time.isNotNull() & (id_ != ""), F.struct(time.alias("time"), id_.alias("id")))


def read_cursor(token: str) -> Cursor | None:
    """Decode one request's token on the driver; ``None`` means the start of the list."""
    if not token:
        return None
    if not re.fullmatch(r"[A-Za-z0-9_-]+", token):
        raise ValueError("a token has letters, digits, - and _ only")
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError) as err:
        raise ValueError("the token cannot be read") from err
    time_text, comma, id_ = raw.partition(",")
    if not comma or not id_:
        raise ValueError("the token names no place in a list")
    try:
        if not re.match(RFC3339, time_text):
            raise ValueError(f"{time_text!r} is no RFC 3339 time")
        time = datetime.fromisoformat(time_text.replace(",", ".").replace("Z", "+00:00"))
    except ValueError as err:
        raise ValueError("the token names no time") from err
    return Cursor(time.astimezone(timezone.utc), id_)
