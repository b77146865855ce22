"""Small helpers around DataFrames: literals, local config tables, date pruning."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def instant(moment: datetime | Column) -> Column:
    """A timestamp literal that does not depend on the driver's own time zone."""
    if isinstance(moment, Column):
        return moment
    return F.timestamp_micros(F.lit(epoch_us(moment)))


def epoch_us(moment: datetime) -> int:
    since = utc(moment) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


def from_us(us: Column) -> Column:
    return F.timestamp_micros(us)


def local_frame(spark: SparkSession, rows: Iterable[dict], schema: T.StructType) -> DataFrame:
    """Driver-side configuration as a local relation.

    Its exact size is known to Catalyst, so a join against it is broadcast only while it stays
    under ``spark.sql.autoBroadcastJoinThreshold`` and is shuffled beyond that.
    """
    table = pa.Table.from_pylist(list(rows), schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema=schema)


def with_settled(df: DataFrame, keep: Iterable[str], **computed: Column) -> DataFrame:
    """``keep`` plus computed columns that the optimizer treats as given values.

    A filter on a computed column is otherwise rewritten in terms of its inputs and pushed below the
    projection. For values built in several layers that copies the whole expression once per use.
    Passing the values through a one-element ``inline`` stops the copying; filters on the kept
    columns still reach the scan.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in computed.items()]))))


def within_dates(df: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Add the day predicate that a time bound implies, so only the touched partitions are listed."""
    if "event_date" not in df.columns:
        return df
    if since is not None:
        df = df.filter(F.col("event_date") >= F.lit(utc(since).date()))
    if until is not None:
        df = df.filter(F.col("event_date") <= F.lit(utc(until).date()))
    return df

