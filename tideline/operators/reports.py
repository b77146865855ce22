"""Latency and throughput reports, and pipeline counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tideline.functions.text import MILLISECOND, SECOND, floor_div, latency_text

QUANTILES = (0.50, 0.95, 0.99)


def nearest_rank(samples: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES,
                 bucket: int = MILLISECOND) -> DataFrame:
    """Exact nearest-rank percentiles per key: the smallest sample at or below which q of the samples lie.

    q <= 0 is the smallest sample, q >= 1 the largest. Samples are first counted per distinct value,
    then ranked in two steps - across buckets of values, and inside the one bucket that holds the
    rank - so that no task sorts the samples of a busy key.
    """
    keys = list(keys)
    counted = samples.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    ).withColumn("_bucket", floor_div(F.col("_v"), bucket))
    buckets = counted.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = buckets.select(
        *keys, "_bucket", "_n", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all")
    )
    asked = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1), F.least(
        F.col("_all"), F.ceil(F.lit(float(q)) * F.col("_all")))).alias("rank")) for q in quantiles])
    wanted = ranked.select(*keys, "_bucket", (F.col("_upto") - F.col("_n")).alias("_below"), "_upto", F.inline(asked)).filter(
        (F.col("rank") > F.col("_below")) & (F.col("rank") <= F.col("_upto"))
    )
    # At most one bucket per key and quantile is left, with at most ``bucket`` distinct values each.
    within = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    needed = counted.join(wanted.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi")
    placed = needed.withColumn("_inside", F.sum("_n").over(within))
    hit = placed.join(wanted, [*keys, "_bucket"]).filter(
        (F.col("_below") + F.col("_inside") >= F.col("rank")) & (F.col("_below") + F.col("_inside") - F.col("_n") < F.col("rank"))
    )
    return hit.select(*keys, "q", F.col("_v").alias(value))


def latency_report(samples: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Per path: requests, throughput, whole-microsecond mean and nearest-rank percentiles."""
    answered = ~F.col("failed")
    totals = samples.groupBy("path", "work").agg(
        F.count_if(answered).alias("requests"),
        F.sum(F.when(answered, F.col("latency_us"))).alias("_sum"),
        F.max("elapsed_us").alias("elapsed_us"),
        F.count_if(F.col("failed")).alias("failures"),
    )
    ranks = nearest_rank(samples.filter(answered), ["path"], "latency_us", quantiles)
    columns = [F.max(F.when(F.col("q") == float(q), F.col("latency_us"))).alias(f"p{round(q * 100)}_us") for q in quantiles]
    seconds = F.col("elapsed_us") / F.lit(float(SECOND))
    return totals.join(ranks.groupBy("path").agg(*columns), "path", "left").select(
        "path", "work", "requests", "failures",
        F.when(seconds > 0, F.col("requests") / seconds).otherwise(F.lit(0.0)).alias("requests_per_sec"),
        F.when(F.col("requests") > 0, F.call_function("div", F.col("_sum"), F.col("requests"))).otherwise(F.lit(0)).alias("avg_us"),
        *[F.coalesce(f"p{round(q * 100)}_us", F.lit(0)).alias(f"p{round(q * 100)}_us") for q in quantiles],
    )


def report_lines(report: DataFrame) -> DataFrame:
    """The report as the rows of a Markdown table, with a readable unit in every cell."""
    cells = [F.concat(F.lit("`"), "path", F.lit("`")), F.col("work"), F.format_number(F.bround("requests_per_sec", 0), 0),
             *[latency_text(F.col(c)) for c in ("avg_us", "p50_us", "p95_us", "p99_us")]]
    return report.select("path", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def status_distribution(samples: DataFrame) -> DataFrame:
    """Per path: responses per status in code order, successes, and whether the run was clean.

    Status codes are a small vocabulary: the list per path has at most one entry per code.
    """
    by_status = samples.groupBy("path", "status", "failed").agg(F.count(F.lit(1)).alias("n"))
    answered = ~F.col("failed")
    good = answered & F.col("status").between(200, 299)
    none = F.lit(0).cast("long")
    summed = by_status.groupBy("path").agg(
        F.coalesce(F.sum(F.when(answered, F.col("n"))), none).alias("requests"),
        F.coalesce(F.sum(F.when(good, F.col("n"))), none).alias("successes"),
        F.coalesce(F.sum(F.when(F.col("failed"), F.col("n"))), none).alias("failures"),
        F.array_sort(F.collect_list(F.when(answered, F.struct("status", "n")))).alias("_pairs"),
    )
    clean = (F.col("failures") == 0) & (F.col("successes") == F.col("requests")) & (F.col("requests") > 0)
    text = F.array_join(F.transform("_pairs", lambda p: F.concat(p["n"], F.lit("×"), p["status"])), ", ")
    return summed.select(
        "path", "requests", "successes", "failures", F.map_from_entries("_pairs").alias("statuses"),
        F.when(F.size("_pairs") == 0, F.lit("none")).otherwise(text).alias("statuses_text"), clean.alias("is_clean"),
    )


def pipeline_metrics(outcomes: DataFrame, keys: Sequence[str] = ("outcome",), took: str = "elapsed_us") -> DataFrame:
    """Count and time per outcome (or operation and outcome, topic and outcome, ...)."""
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.sum(took).alias("sum_us"), F.min(took).alias("min_us"), F.max(took).alias("max_us"),
    ).withColumn("avg_ms", F.round(F.col("sum_us") / F.col("records") / 1000, 3))
