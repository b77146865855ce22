"""Counters of running streams: what each trigger stored, refused, found or opened, kept in a table.

A stream carries named observations; a listener receives them with the progress of every trigger and writes a row per
outcome. The ingest sink, whose outcomes are known only after the append, reports them to the same table. A trigger that is
repeated after a failure writes its folder again, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tideline.functions.frames import local_frame
from tideline.schema import LONG, STRING, columns
from tideline.sources.files import exists

COUNTER = columns(outcome=STRING, records=LONG, took_us=LONG)
STORED = columns(stream=STRING, name=STRING, batch_id=LONG, **{f.name: f.dataType for f in COUNTER.fields})
ROWS = "rows"


def counted(stream: DataFrame, name: str, **outcomes: Column) -> DataFrame:
    """The same stream; of each trigger, all rows and those that meet each condition are counted under ``name``."""
    return stream.observe(name, F.count(F.lit(1)).alias(ROWS), *(F.count_if(c).alias(k) for k, c in outcomes.items()))


class StreamCounters(StreamingQueryListener):
    """Writes the observations of every stream of a session below ``path``; add it with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, stream: str, name: str, batch_id: int, counts: dict[str, int], took_us: int | None) -> None:
        rows = [{"outcome": k, "records": int(v or 0), "took_us": took_us} for k, v in counts.items()]
        folder = f"{self.path}/stream={stream}/name={name}/batch_id={batch_id}"
        local_frame(self.spark, rows, COUNTER).coalesce(1).write.mode("overwrite").parquet(folder)

    def sink(self, stream: str, name: str = "ingest") -> Callable[[int, dict[str, int]], None]:
        """For ``start_ingest(on_outcomes=...)``; ``stream`` stands for its checkpoint."""
        return lambda batch_id, outcomes: self._write(stream, name, batch_id, outcomes, None)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        took = progress.durationMs.get("triggerExecution")
        for name, counts in progress.observedMetrics.items():
            self._write(str(progress.id), name, progress.batchId, counts.asDict(), None if took is None else int(took) * 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """``stream, name, batch_id, outcome, records, took_us``: a row per trigger and outcome."""
    if not exists(spark, path):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).option("basePath", path).parquet(path)


def stream_metrics(counters: DataFrame) -> DataFrame:
    """Per name and outcome: triggers, records, and the time of triggers where it is known."""
    return counters.groupBy("name", "outcome").agg(
        F.count(F.lit(1)).alias("triggers"), F.sum("records").alias("records"), F.sum("took_us").alias("sum_us"),
        F.min("took_us").alias("min_us"), F.max("took_us").alias("max_us"),
    )
