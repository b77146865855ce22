"""Stored tables: fixed-schema Parquet, telemetry split by UTC day.

Layout of the telemetry table below its root folder::

    daily/event_date=YYYY-MM-DD/...     one folder per day that has a partition
    parked/event_date=YYYY-MM-DD/...    rows of days that have none yet (the default area)
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.schema import TABLES
from tideline.session import scratch_path
from tideline.sources import latest
from tideline.sources.files import exists, folder

# Tables of which readers see the last state of each id.
LATEST = ("incidents", "remediation_actions")
DAILY = "daily"
PARKED = "parked"
DATE_FIELD = T.StructField("event_date", T.DateType())

# Every row group has a Bloom filter of its traces, as small as their number allows: a trace is looked up without a scan.
TRACE_BLOOM = {
    "parquet.bloom.filter.enabled#trace_id": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(1 << 20),
}


def area(path: str, name: str = DAILY) -> str:
    return f"{path.rstrip('/')}/{name}"


def read_telemetry(spark: SparkSession, path: str, which: str = DAILY) -> DataFrame:
    """The day-partitioned telemetry; empty when nothing was stored yet."""
    schema = T.StructType([*TABLES["telemetry_events"].fields, DATE_FIELD])
    where = area(path, which)
    if not exists(spark, where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", where).parquet(where)


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored table by name, with its declared columns and no schema inference."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    if name == "telemetry_events":
        return read_telemetry(spark, path)
    if name in LATEST:
        return latest.read_latest(spark, TABLES[name], path)
    return spark.read.schema(TABLES[name]).parquet(path)


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "telemetry_events", path)


def scan_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Each incident as it was recorded last."""
    return read_table(spark, "incidents", path)


def scan_notifications(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, "notifications", path)


def scan_actions(spark: SparkSession, path: str) -> DataFrame:
    """Each remediation step with its last status."""
    return read_table(spark, "remediation_actions", path)


def record_changes(df: DataFrame, name: str, path: str) -> None:
    """Append the present state of incidents or actions; readers see the last one of each id. Repeating it changes nothing."""
    latest.add_changes(_declared(df, name), path)


def compact_changes(spark: SparkSession, name: str, path: str) -> bool:
    """Fold the changes of incidents or actions into sorted base files, which are then read as they are."""
    return latest.compact(spark, TABLES[name], path)


def record_incidents(df: DataFrame, path: str) -> None:
    record_changes(df, "incidents", path)


def record_actions(df: DataFrame, path: str) -> None:
    record_changes(df, "remediation_actions", path)


def record_notifications(df: DataFrame, path: str) -> None:
    """Insert what is not there yet, by id: a page is sent once and never changes."""
    rows = _declared(df, "notifications").dropDuplicates(["id"])
    if exists(df.sparkSession, path):
        rows = rows.join(read_table(df.sparkSession, "notifications", path).select("id"), "id", "left_anti").select(*rows.columns)
    rows.write.mode("append").parquet(path)


def _declared(df: DataFrame, name: str) -> DataFrame:
    """The declared columns in order; one the frame lacks is null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields
    ])


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """The rows of a frame written once to the shared folder, for work that reads them several times; removed afterwards."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        fs, where = folder(spark, path)
        fs.delete(where, True)


def with_event_date(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date("event_timestamp"))


def write_daily(
    df: DataFrame, path: str, which: str = DAILY, mode: str = "append", rows_per_file: int = 20_000_000,
    written: Observation | None = None,
) -> None:
    """Write rows below one folder per day, in order of time: a short window reads the few row groups it touches.

    A day's rows are spread over many tasks: AQE splits a shuffled day that is larger than its
    advisory size, so one hot day does not become one task or one file. ``written`` receives the
    number of rows; it is taken last, where no empty input can optimise it away.
    """
    columns = [f.name for f in TABLES["telemetry_events"].fields]
    clustered = (
        with_event_date(df)
        .select(*columns, "event_date")
        .hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "event_timestamp", "tenant_id", "service_name")
    )
    if written is not None:
        clustered = clustered.observe(written, F.count(F.lit(1)).alias("rows"))
    (
        clustered.write.mode(mode).options(maxRecordsPerFile=rows_per_file, **TRACE_BLOOM).partitionBy("event_date")
        .parquet(area(path, which))
    )
