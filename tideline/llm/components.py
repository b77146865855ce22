"""Connected components of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import saved


def _roots(parents: DataFrame) -> DataFrame:
    """``v, parent`` with each parent replaced by the root above it; chains halve in every step."""
    while True:
        up = parents.toDF("p", "above")
        jumped = saved(parents.join(up, F.col("parent") == F.col("p")).select("v", F.col("parent").alias("was"), F.col("above").alias("parent")), "parents")
        parents = jumped.select("v", "parent")
        if jumped.filter("was <> parent").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """``id, label`` for every id of ``links`` (``a, b``, longs): the smallest id of its component.

    In each round an id hooks on to its smallest neighbour, if that is smaller (a minimum with map-side combine),
    chains of hooks collapse to their roots, and the links between roots are the next round's. Stars are gone after
    one round, and links shrink fast. Every round is written; only whether links are left reaches the driver. An id of
    many links is many rows of a join that Spark splits.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("parent"))
        parents = _roots(saved(hooked, "parents"))
        if labels is None:
            labels = parents.toDF("id", "label")
        else:
            rooted = labels.join(parents.toDF("v", "root"), F.col("label") == F.col("v"), "left")
            labels = saved(rooted.select("id", F.coalesce("root", "label").alias("label")), "labels")
        ends = edges.join(parents.toDF("x", "one"), F.col("a") == F.col("x")).join(parents.toDF("y", "other"), F.col("b") == F.col("y"))
        edges = saved(ends.filter("one <> other").select(F.greatest("one", "other").alias("a"), F.least("one", "other").alias("b")).distinct(), "edges")
    return labels
