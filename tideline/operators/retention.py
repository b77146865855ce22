"""Daily partitions: names, plans, expiry, and moving rows to where they belong."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.frames import local_frame
from tideline.operators.dedupe import AppendResult, append_events, dedupe_events
from tideline.schema import DEFAULT_PARTITION, PARTITION, PARTITION_PREFIX, TABLES
from tideline.sources.tables import DAILY, PARKED, area, exists, folder, read_telemetry, with_event_date, write_daily


def partition_name(day: Column) -> Column:
    return F.concat(F.lit(PARTITION_PREFIX), F.date_format(day, "yyyyMMdd"))


def partition_day(name: Column) -> Column:
    """The day of a dated partition; null for anything else, above all the default one."""
    digits = F.when(name.rlike(f"^{PARTITION_PREFIX}[0-9]{{8}}$"), F.right(name, F.lit(8)))
    return F.try_to_date(digits, "yyyyMMdd")


def list_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Every day partition with its rows and bytes, plus the default area when it holds anything.

    Only file footers are read: no data column is selected.
    """
    def files(which: str) -> DataFrame:
        return read_telemetry(spark, path, which).groupBy("event_date", "_metadata.file_path").agg(
            F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")
        )

    found = None
    for which in (DAILY, PARKED):
        if not exists(spark, area(path, which)):
            continue
        totals = [F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")]
        if which == DAILY:
            part = files(which).groupBy("event_date").agg(*totals)
            part = part.select(partition_name(F.col("event_date")).alias("name"), "event_date", "rows", "bytes")
        else:
            part = files(which).groupBy(F.lit(DEFAULT_PARTITION).alias("name")).agg(*totals)
            part = part.select("name", F.lit(None).cast("date").alias("event_date"), "rows", "bytes")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], PARTITION)


def _wanted_days(spark: SparkSession, today: date, lookahead: timedelta) -> DataFrame:
    days = range(max(lookahead.days, 0) + 1)
    rows = [{"event_date": today + timedelta(days=n)} for n in days]
    return local_frame(spark, rows, T.StructType([PARTITION["event_date"]]))


def missing_partitions(partitions: DataFrame, today: date, lookahead: timedelta = timedelta(days=7)) -> DataFrame:
    """The days from today through the lookahead that have no partition yet."""
    wanted = _wanted_days(partitions.sparkSession, today, lookahead)
    named = wanted.select(partition_name(F.col("event_date")).alias("name"), "event_date")
    return named.join(partitions.select("name"), "name", "left_anti")


def partition_plan(
    partitions: DataFrame, today: date, lookahead: timedelta = timedelta(days=7), retention: timedelta = timedelta(days=30)
) -> DataFrame:
    """What one maintenance cycle does: ``create`` rows (order 1) before ``drop`` rows (order 2).

    A day is dropped only once it lies wholly before the retention horizon; names that are not dated
    partitions are never dropped.
    """
    cutoff = F.lit(today - retention)
    create = missing_partitions(partitions, today, lookahead).select(
        F.lit(1).alias("step"), F.lit("create").alias("action"), "name", "event_date"
    )
    dated = partitions.select("name", partition_day(F.col("name")).alias("event_date"))
    drop = dated.filter(F.date_add("event_date", 1) < cutoff).select(
        F.lit(2).alias("step"), F.lit("drop").alias("action"), "name", "event_date"
    )
    return create.unionByName(drop)


def default_partition_rows(df: DataFrame, partitions: DataFrame) -> DataFrame:
    """How many rows fall on a day without a partition. Rows are counted per day before the day list is met."""
    per_day = df.groupBy(F.to_date("event_timestamp").alias("event_date")).agg(F.count(F.lit(1)).alias("n"))
    days = partitions.select(partition_day(F.col("name")).alias("event_date"))
    return per_day.join(days, "event_date", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("default_rows"))


def route_events(df: DataFrame, path: str, partitions: DataFrame) -> tuple[AppendResult, AppendResult]:
    """Append rows to the day partition that exists for them, all others to the default area."""
    days = partitions.select(partition_day(F.col("name")).alias("event_date")).filter("event_date IS NOT NULL")
    dated = with_event_date(df)
    homed = dated.join(days, "event_date", "left_semi").drop("event_date")
    homeless = dated.join(days, "event_date", "left_anti").drop("event_date")
    return append_events(homed, path), append_events(homeless, path, which=PARKED)


def expire_partitions(path: str, plan: DataFrame) -> int:
    """Drop the partitions a plan marks for dropping and say how many there were. No data is read or rewritten."""
    spark = plan.sparkSession
    dropped = 0
    # One entry per expired day.
    for row in plan.filter("action = 'drop'").select("name", partition_day(F.col("name")).alias("day")).collect():
        if row["day"] is None:
            raise ValueError(f"refusing to drop {row['name']!r}: not a dated telemetry_events partition")
        fs, where = folder(spark, f"{area(path)}/event_date={row['day'].isoformat()}")
        if fs.exists(where):
            fs.delete(where, True)
            dropped += 1
    return dropped


def drain_default(spark: SparkSession, path: str, day: date) -> int:
    """Move the parked rows of one day to that day's partition.

    The rows are inserted first (insert-if-absent) and un-parked afterwards: a crash in between
    leaves both copies, and the next run moves nothing twice. The files are listed once; those are read
    and those alone are deleted, so a row that a writer parks meanwhile stays parked.
    """
    parked = f"{area(path, PARKED)}/event_date={day.isoformat()}"
    if not exists(spark, parked):
        return 0
    fs, where = folder(spark, parked)
    files = [s.getPath() for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    if not files:
        return 0
    rows = spark.read.schema(TABLES["telemetry_events"]).parquet(*(f.toString() for f in files))
    moved = append_events(rows, path)
    for file in files:
        fs.delete(file, False)
    if not list(fs.listStatus(where)):
        fs.delete(where, False)
    return moved.inserted + moved.duplicate


def backfill_partitions(df: DataFrame, path: str) -> None:
    """Write an un-partitioned table as daily partitions; a table that already holds something is refused."""
    if exists(df.sparkSession, area(path)) and not read_telemetry(df.sparkSession, path).isEmpty():
        raise ValueError(f"{path} already holds events: append to it, or backfill another folder")
    write_daily(df, path)


def backfill_days(df: DataFrame, today: date, ahead: int = 7) -> DataFrame:
    """The partitions a backfill needs: from the first stored day through the later of the last day and today, and a week on."""
    day = F.to_date("event_timestamp")
    bounds = df.agg(F.coalesce(F.min(day), F.lit(today)).alias("lo"), F.greatest(F.max(day), F.lit(today)).alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", F.date_add("hi", ahead), F.expr("INTERVAL 1 DAY"))).alias("event_date"))
    return days.select(partition_name(F.col("event_date")).alias("name"), "event_date")


def collapse_partitions(df: DataFrame) -> DataFrame:
    """Back to one table with one row per event id: the one stored first."""
    columns = [c for c in df.columns if c != "event_date"]
    return dedupe_events(df.select(*columns), keys=("event_id",), order_by=("processed_at", "event_timestamp"))
