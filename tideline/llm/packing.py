"""Packing into optimal length buckets.

A dynamic program over the global length histogram chooses the bucket boundaries that pad least; batches of a fixed
token budget then form inside each bucket, in seeded order.

The histogram is exact up to ``EXACT_LENGTHS`` and has bins of eight leading bits beyond, each with the longest length
in it as its bound, so what reaches the driver is bounded whatever the corpus holds and boundaries are real lengths. Batches are numbered by the running count over blocks of the seeded order
and within them, so a bucket that holds most of the documents is many blocks, not one window.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import local_table, saved, word_count

#: Padded length buckets.
BUCKETS = 32
#: Tokens of a batch, padding included; a longer document is a batch of its own.
BATCH_TOKENS = 65_536
#: Up to here the histogram is exact.
EXACT_LENGTHS = 16_384
LEADING_BITS = 8
BLOCK_ROWS = 4_000


def histogram_length(length: Column) -> Column:
    """The histogram bin of a length: itself, or rounded up to ``LEADING_BITS`` leading bits."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(length)) - LEADING_BITS)
    return F.when(length <= EXACT_LENGTHS, length).otherwise(F.ceil(length / step) * step).cast("long")


def optimal_boundaries(histogram: Iterable[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise padded tokens; exact, in integers.

    ``histogram`` has (length, documents). With k buckets over the first j lengths the cost is the least of
    cost(k - 1, i) + length[j] * (documents in i..j), a lower envelope of lines met in order of slope and of length.
    """
    bins = sorted((int(n), int(c)) for n, c in histogram if c > 0)
    upto = [0]
    for _, c in bins:
        upto.append(upto[-1] + c)
    best, choices = [0] + [None] * len(bins), []
    for _ in range(min(buckets, len(bins))):
        hull: list[int] = []  # starts of a last bucket, in order of use
        nxt, choice, front = [0] + [None] * len(bins), [0] * (len(bins) + 1), 0
        for j in range(1, len(bins) + 1):
            i = j - 1
            if best[i] is not None:
                while len(hull) - front >= 2 and _useless(best, upto, hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
            if hull:
                x = bins[j - 1][0]
                front = min(front, len(hull) - 1)
                while front + 1 < len(hull) and best[hull[front + 1]] - x * upto[hull[front + 1]] <= best[hull[front]] - x * upto[hull[front]]:
                    front += 1
                choice[j] = hull[front]
                nxt[j] = best[hull[front]] + x * (upto[j] - upto[hull[front]])
        choices.append(choice)
        if nxt[-1] is not None and best[-1] is not None and nxt[-1] >= best[-1]:
            choices.pop()
            break
        best = nxt
    bounds, j = [], len(bins)
    for choice in reversed(choices):
        if j:
            bounds.append(bins[j - 1][0])
            j = choice[j]
    return bounds[::-1]


def _useless(best: list, upto: list, a: int, b: int, c: int) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
    return (best[c] - best[a]) * (upto[b] - upto[a]) <= (best[b] - best[a]) * (upto[c] - upto[a])


def pack(lengths: DataFrame, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, seed: str = "pack") -> DataFrame:
    """``doc_id, n_tokens, padded, bucket, batch, slot``: every row of ``lengths`` (``doc_id, n_tokens``) once.

    ``padded`` is the bucket's length; a batch is ``(bucket, batch)``, both from 0, and ``slot`` the place in it.
    Null or negative lengths count as 0; rows of length 0 go to the first bucket. The order in a bucket depends on
    ids, lengths and the seed alone; rows that agree in both are interchangeable.
    """
    spark = lengths.sparkSession
    rows = lengths.select("doc_id", F.greatest(F.lit(0), F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
    counts = rows.groupBy(histogram_length(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("length"), F.count("*").alias("count")).collect()
    bounds = optimal_boundaries(((r.length, r["count"]) for r in counts), buckets)
    bin_of = {r.length: next(i for i, b in enumerate(bounds) if r.length <= b) for r in counts}
    size = [0] * len(bounds)
    for r in counts:
        size[bin_of[r.length]] += r["count"]
    facts = local_table(
        spark, "b long, padded long, fits long, blocks long",
        [(i, b, max(1, batch_tokens // max(1, b)), max(1, -(-size[i] // BLOCK_ROWS))) for i, b in enumerate(bounds)],
    )
    bucket = F.array_size(F.filter(F.array(*(F.lit(b) for b in bounds)).cast("array<bigint>"), lambda b: b < F.col("n_tokens")))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    dealt = (
        rows.withColumn("bucket", bucket.cast("long"))
        .join(facts, F.col("bucket") == F.col("b"))
        .withColumn("place", place)
        .withColumn("block", F.pmod("place", "blocks"))
    )
    before = "sum(rows) OVER (PARTITION BY bucket ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rows"
    starts = dealt.groupBy("bucket", "block").agg(F.count("*").alias("rows")).select(
        F.col("bucket").alias("k"), F.col("block").alias("l"), F.expr(before).alias("start")
    )
    nth = F.expr("row_number() OVER (PARTITION BY bucket, block ORDER BY place, doc_id, n_tokens)") - 1
    numbered = dealt.withColumn("nth", nth).join(starts, (F.col("bucket") == F.col("k")) & (F.col("block") == F.col("l")))
    at = F.col("start") + F.col("nth")
    return numbered.select(
        "doc_id", "n_tokens", "padded", "bucket", F.floor(at / F.col("fits")).cast("long").alias("batch"), F.pmod(at, "fits").cast("long").alias("slot")
    )


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Packs ``docs`` by the words of each whole text (null text: 0). An empty table gives no rows."""
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("n_tokens"))
    return pack(saved(lengths, "pack-lengths"), buckets, batch_tokens)
