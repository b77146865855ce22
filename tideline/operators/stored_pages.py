"""Pages and traces of the stored telemetry that end early.

A page is the newest rows that match. Days are folders and files are in order of time, so a page is looked for from the
newest day backwards: in a day, slices of time are read newest first, each a scan whose bounds reach the row groups. The
first slice is as long as the rows of the page should take at the day's density (told by the sizes of its files alone);
where the page stays unfilled, slices grow eightfold. The walk stops when the page is full. So a page costs a few row
groups and not the table, and the number of scans grows with the logarithm of what the filters leave out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.cursor import encode_cursor, read_cursor
from tideline.functions.frames import epoch_us, from_us
from tideline.operators.reads import filter_events, page_limit, trace_events
from tideline.sources.tables import DAILY, area, exists, folder, read_telemetry

#: The first slice should hold so many times the rows of the page, at so many bytes a row; each further slice is so many
#: times longer. Wrong guesses cost a scan or a few row groups more.
AMPLE, ROW_BYTES, GROWTH = 4, 64, 8
DAY_US = 86_400_000_000


def stored_days(spark: SparkSession, path: str, which: str = DAILY) -> list[date]:
    """Days that have a folder, newest first: a listing of one level, as many names as days."""
    where = area(path, which)
    if not exists(spark, where):
        return []
    fs, root = folder(spark, where)
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted((date.fromisoformat(n.split("=", 1)[1]) for n in names if n.startswith("event_date=") and "__" not in n), reverse=True)


def _day_bytes(spark: SparkSession, path: str, day: date) -> int:
    """Size of a day's files: a listing, nothing is opened."""
    fs, where = folder(spark, f"{area(path)}/event_date={day.isoformat()}")
    return sum(s.getLen() for s in fs.listStatus(where))


def _slices(stored_bytes: int, low: int, high: int, wanted: int) -> Iterator[tuple[int, int]]:
    """Time ranges of a day, newest first: ``(from, to)`` in microseconds, both included."""
    length = max(1_000, DAY_US * AMPLE * wanted * ROW_BYTES // max(1, stored_bytes))
    end = high
    while end >= low:
        start = max(low, end - length)
        yield start, end
        end, length = start - 1, length * GROWTH


def page_stored_events(
    spark: SparkSession, path: str, filters: dict | None = None, limit: int | None = None, cursor: str | None = None,
) -> tuple[DataFrame, str]:
    """One page of stored events, newest first, and the token of the next page: the rows of ``reads.page_events``.

    Reads the day folders from the newest that the filters and the cursor allow, and stops at a full page.
    """
    if limit is not None and limit < 0:
        raise ValueError(f"a page of {limit} rows makes no sense")
    filters, size, after = dict(filters or {}), page_limit(limit), read_cursor(cursor or "")
    newest = [m for m in (filters.get("until"), after.time if after else None) if m is not None]
    last = min(map(epoch_us, newest)) if newest else None
    first = epoch_us(filters["since"]) if filters.get("since") is not None else None
    table = read_telemetry(spark, path)
    wanted = filter_events(table, **filters)
    if after is not None:
        at = from_us(F.lit(epoch_us(after.time)))
        wanted = wanted.filter((F.col("event_timestamp") < at) | ((F.col("event_timestamp") == at) & (F.col("event_id") < after.id)))
    token = encode_cursor(F.col("event_timestamp"), F.col("event_id")).alias("_token")
    found, held = [], 0
    for day in stored_days(spark, path):
        start = epoch_us(datetime(day.year, day.month, day.day, tzinfo=timezone.utc))
        low = start if first is None else max(start, first)
        high = start + DAY_US - 1 if last is None else min(start + DAY_US - 1, last)
        for begin, end in _slices(_day_bytes(spark, path, day) if low <= high else 0, low, high, size + 1):
            moment = F.col("event_timestamp")
            inside = wanted.filter((F.col("event_date") == F.lit(day)) & (moment >= from_us(F.lit(begin))) & (moment <= from_us(F.lit(end))))
            rows = inside.orderBy(moment.desc(), F.col("event_id").desc()).limit(size + 1 - held).select("*", token).toArrow()
            found, held = [*found, rows], held + rows.num_rows
            if held > size:
                whole = pa.concat_tables(found)
                return _as_page(spark, table, whole.slice(0, size)), whole.column("_token")[size - 1].as_py()
    if not found:
        return table.limit(0), ""
    return _as_page(spark, table, pa.concat_tables(found)), ""


def _as_page(spark: SparkSession, table: DataFrame, rows: pa.Table) -> DataFrame:
    return spark.createDataFrame(rows.drop_columns(["_token"]).combine_chunks(), schema=table.schema)


def stored_trace(spark: SparkSession, path: str, trace_id: str) -> DataFrame:
    """All stored events of one trace. Bloom filters on ``trace_id``, which every stored file has, leave the row groups that may hold it."""
    return trace_events(read_telemetry(spark, path), trace_id)
