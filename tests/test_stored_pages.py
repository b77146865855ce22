"""Pages and traces of the stored table: the rows of the plain operators, from a few row groups."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline.functions.frames import local_frame
from tideline.operators import reads, stored_pages
from tideline.schema import TELEMETRY
from tideline.sources import tables

NEWEST = datetime(2026, 7, 30, 23, 59, tzinfo=timezone.utc)
A_DAY = 3_000


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Thirty days, a row every 28 seconds, in small row groups."""
    path = str(tmp_path_factory.mktemp("stored") / "t")
    n = F.col("id")
    rows = spark.range(30 * A_DAY).select(
        F.format_string("%08d", n).alias("event_id"), (F.lit(NEWEST) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n - n % 2) * 28)).alias("event_timestamp"),
        F.when(n % 5_000 == 4_321, "rare").otherwise("t").alias("tenant_id"), F.lit("s").alias("service_name"),
        F.when(n % 40 == 0, "").otherwise(F.concat(F.lit("trace-"), F.floor(n / 9))).alias("trace_id"),
        F.when(n % 7 == 0, "error").otherwise("info").alias("severity"))
    conf = spark._jsc.hadoopConfiguration()
    for key, value in {"parquet.block.size": str(1 << 14), "parquet.page.size": str(1 << 12), "parquet.block.size.row.check.min": "100"}.items():
        conf.set(key, value)
    tables.write_daily(local_frame(spark, [], TELEMETRY).unionByName(rows, allowMissingColumns=True), path)
    for key in ("parquet.block.size", "parquet.page.size", "parquet.block.size.row.check.min"):
        conf.unset(key)
    return path


@pytest.fixture
def scans(spark, monkeypatch):
    """Row ranges that the page walk asked for: ``(day, filters)``; the walk itself is unchanged."""
    asked, plain = [], stored_pages._slices

    def counted(*args):
        for part in plain(*args):
            asked.append(part)
            yield part

    monkeypatch.setattr(stored_pages, "_slices", counted)
    return asked


def _rows(page):
    return page.select("event_timestamp", "event_id").collect()


@pytest.mark.parametrize("filters", [{}, {"severity": "error"}, {"tenant": "rare"}, {"until": NEWEST - timedelta(days=3, hours=2)}, {"since": NEWEST - timedelta(hours=3), "tenant": "rare"}])
def test_pages_are_those_of_the_table(spark, stored, filters):
    table, tokens = tables.scan_events(spark, stored), ["", ""]
    for _ in range(3):
        page, tokens[0] = stored_pages.page_stored_events(spark, stored, filters, limit=7, cursor=tokens[0])
        plain, tokens[1] = reads.page_events(table, filters, limit=7, cursor=tokens[1])
        assert _rows(page) == _rows(plain) and tokens[0] == tokens[1] and page.schema == plain.schema
        if not tokens[0]:
            break


def test_a_page_without_filters_reads_the_newest_day(spark, stored, scans):
    page, token = stored_pages.page_stored_events(spark, stored, limit=20)
    assert page.count() == 20 and token
    day = datetime(2026, 7, 30, tzinfo=timezone.utc).timestamp() * 1e6
    assert scans and all(begin >= day for begin, _ in scans) and len(scans) <= 4
    # Only row groups of the last slice are handed on: a page of 20 does not read the 3,000 rows of its day.
    begin, end = scans[-1]
    last = tables.scan_events(spark, stored).filter(
        (F.col("event_date") == F.lit(datetime(2026, 7, 30).date())) & (F.col("event_timestamp") >= F.timestamp_micros(F.lit(begin))) & (F.col("event_timestamp") <= F.timestamp_micros(F.lit(end))))
    assert _scanned(last) < A_DAY / 2


def _scanned(df):
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        own = node.metrics().apply("numOutputRows").value() if name.startswith("Scan parquet") else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_trace_reads_its_own_row_groups(spark, stored):
    found = stored_pages.stored_trace(spark, stored, "trace-5000")
    assert {r.trace_id for r in found.collect()} == {"trace-5000"} and found.count() in (8, 9)
    assert _scanned(stored_pages.stored_trace(spark, stored, "trace-5000")) < 30 * A_DAY / 10
    assert stored_pages.stored_trace(spark, stored, "").count() == 0


def test_no_table_and_bad_limits(spark, tmp_path):
    page, token = stored_pages.page_stored_events(spark, str(tmp_path / "none"))
    assert page.collect() == [] and token == "" and page.columns[-1] == "event_date"
    with pytest.raises(ValueError):
        stored_pages.page_stored_events(spark, str(tmp_path / "none"), limit=-1)
