"""Line deduplication by overlapping three-line windows, on DataFrame functions alone.

Every run of three consecutive lines is hashed (128 bits). A window that occurs again, in the same document or in a
later one, marks its three lines; marked lines of overlapping windows merge and go. The order of occurrences is
(doc_id, line), so each removed line has an equal line that stays.

Windows are counted with map-side combine, so a passage that a third of all documents share reaches its reducer once
per task; the join back to the windows is one that Spark splits on skew. Only hashes and positions are shuffled, and
each text once, to meet the positions it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _rows(docs: DataFrame) -> DataFrame:
    """Identity and lines of each row; the text's hash tells rows of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("version"), _lines(text).alias("lines"))


def line_windows(docs: DataFrame) -> DataFrame:
    """``id, version, at, a, b``: one row per window with any visible character, ``at`` its first line from 0."""
    rows = _rows(docs).select(
        "*",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("one"),
        F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("two"),
        F.transform("lines", lambda x: F.length(F.trim(x)) > 0).alias("seen"),
    )

    def window(i: Column) -> Column:
        each = [i + k for k in range(WINDOW)]
        seen = F.get("seen", each[0])
        for at in each[1:]:
            seen = seen | F.get("seen", at)
        return F.struct(
            i.alias("at"), F.xxhash64(*(F.get("one", at) for at in each)).alias("a"),
            F.xxhash64(*(F.get("two", at) for at in each)).alias("b"), seen.alias("seen"),
        )

    found = F.when(F.size("lines") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), window))
    return rows.select("id", "version", F.explode(found).alias("w")).filter("w.seen").select("id", "version", "w.at", "w.a", "w.b")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``id, version, removed``: per document that loses lines, the distinct numbers of those lines."""
    windows = line_windows(docs)
    place = F.struct("id", "version", "at")
    first = (
        windows.groupBy("a", "b")
        .agg(F.min(place).alias("first"), F.count("*").alias("times"))
        .filter("times > 1")
        .drop("times")
    )
    later = windows.join(first, ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    covered = F.flatten(F.transform(F.collect_set("at"), lambda p: F.array(*(p + k for k in range(WINDOW)))))
    return later.groupBy("id", "version").agg(F.array_distinct(covered).alias("removed"))


def drop_repeated_lines(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The rows of ``docs`` with every column, ``text`` without its repeated lines, and two counts beside them.

    The counts, of lines and of removed ones, replace columns of their names (``counts``). A document under three lines, or without text,
    stays as it is; one that only repeats others becomes the empty text. Rows that repeat id and text count as one
    occurrence, so they never remove each other. Null ids come first in the order.
    """
    mine = [c for c in docs.columns if c not in counts]
    text = F.col("text").cast("string")
    rows = docs.select(*mine, F.xxhash64(text).alias("__version"))
    lost = repeated_lines(docs).select(F.col("id").alias("__id"), F.col("version").alias("__other"), F.col("removed").alias("__removed"))
    joined = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__version") == F.col("__other")), "left")
    lines = _lines(text)
    count = F.coalesce(F.size(lines), F.lit(0))
    removed = F.coalesce(F.size("__removed"), F.lit(0))
    stays = F.array_except(F.sequence(F.lit(0), count - 1), F.col("__removed"))
    cleaned = F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n")
    new_text = F.when(F.col("__removed").isNotNull(), cleaned).otherwise(text)
    return joined.select(
        *(new_text.alias("text") if c == "text" else F.col(c) for c in mine),
        F.when(text.isNull(), 0).otherwise(count).cast("long").alias(counts[0]),
        F.when(F.col("__removed").isNull(), 0).otherwise(removed).cast("long").alias(counts[1]),
    )
