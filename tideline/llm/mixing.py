"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern offers its words as
often as repetition is allowed, every further lap at a higher cost; a min-cost flow routes them to the quotas of the
sources. Only patterns and sources, never documents, meet on the driver: their number follows the sources and how
they overlap, not the rows.

Documents then stand in seeded order on a line per pattern, at the running sum of their sizes. A flow is a stretch of
that line (lap after lap), and a document is taken by the source on whose stretch its middle lies, so a source misses
its quota by about half a document at most. Running sums are taken per block of the seeded order and then over the
blocks, so a source that holds a third of the rows is many blocks, not one window.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import local_table, saved, word_count

#: A document is used this often at most.
LAPS = 3
#: Source weights repeat in this order over the sources.
WEIGHTS = (1, 2, 3)
#: Rows of a block of the seeded order.
BLOCK_ROWS = 4_000
#: The seeded order has so many places.
PLACES = 1 << 52


def seeded_place(seed: str, key: Column) -> Column:
    """Place of a key in the seeded order, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def share_by_weight(sizes: dict, weights: dict, laps: int = LAPS) -> dict:
    """Targets that share all sizes by weight; one stops at ``laps`` times its source, the rest share the excess."""
    total = sum(sizes.values())
    open_to, targets = set(sizes), {}
    while open_to:
        left = total - sum(targets.values())
        weight = sum(weights[s] for s in open_to)
        full = {s for s in open_to if weight <= 0 or left * weights[s] >= laps * sizes[s] * weight}
        if not full:
            return targets | {s: left * weights[s] / weight for s in open_to}
        targets |= {s: laps * sizes[s] for s in full}
        open_to -= full
    return {s: float(t) for s, t in targets.items()}


def route(patterns: dict[tuple, int], quotas: dict, laps: int = LAPS) -> dict[tuple, list[tuple[object, int]]]:
    """Min-cost flow of words from patterns to sources: per pattern, ``(source, words)`` in source order.

    Lap number r of a pattern costs r squared a word. Quotas that nothing can fill stay short. Successive cheapest
    paths with potentials; every path ends a lap, a quota or a rerouting, so their number follows the pattern count.
    """
    names = {s: i for i, s in enumerate(quotas)}
    keys = list(patterns)
    sink, n = 1 + len(keys) + len(names), 2 + len(keys) + len(names)
    arcs: list[list] = []
    out = defaultdict(list)

    def arc(a: int, b: int, room: int, cost: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    for i, key in enumerate(keys):
        for lap in range(laps):
            arc(0, 1 + i, patterns[key], lap * lap)
        for s in key:
            if s in names:
                arc(1 + i, 1 + len(keys) + names[s], laps * patterns[key], 0)
    for s, i in names.items():
        arc(1 + len(keys) + i, sink, int(quotas[s]), 0)
    potential = [0] * n
    while True:
        far, via, heap = [None] * n, [-1] * n, [(0, 0)]
        far[0] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, cost = arcs[e]
                if room > 0 and (far[b] is None or d + cost + potential[a] - potential[b] < far[b]):
                    far[b], via[b] = d + cost + potential[a] - potential[b], e
                    heapq.heappush(heap, (far[b], b))
        if far[sink] is None:
            break
        potential = [p + (far[i] if far[i] is not None else far[sink]) for i, p in enumerate(potential)]
        path, at = [], sink
        while at:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        amount = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= amount
            arcs[e ^ 1][1] += amount
    flows: dict[tuple, list] = {}
    source_of = list(names)
    for i, key in enumerate(keys):
        used = [(source_of[arcs[e][0] - 1 - len(keys)], arcs[e ^ 1][1]) for e in out[1 + i] if arcs[e][0] > len(keys) and not e & 1]
        flows[key] = [(s, f) for s, f in used if f]
    return flows


def lay_out(docs: DataFrame, blocks: dict, seed: str) -> DataFrame:
    """``docs`` (``doc_id, pattern, size``) with ``middle``: twice the running size at each document's middle.

    ``blocks`` has the number of blocks of each pattern's line.
    """
    counts = local_table(docs.sparkSession, "p string, blocks long", blocks.items())
    dealt = (
        docs.withColumn("place", seeded_place(seed, F.col("doc_id")))
        .join(counts, F.col("pattern").eqNullSafe(F.col("p")))
        .withColumn("block", F.floor(F.col("place") / PLACES * F.col("blocks")).cast("long"))
        .drop("p", "blocks")
    )
    before = "sum(total) OVER (PARTITION BY pattern ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - total"
    starts = dealt.groupBy("pattern", "block").agg(F.sum("size").alias("total")).select(
        F.col("pattern").alias("p"), F.col("block").alias("b"), F.expr(before).alias("start")
    )
    inside = "sum(size) OVER (PARTITION BY pattern, block ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    at = dealt.withColumn("upto", F.expr(inside)).join(starts, F.col("pattern").eqNullSafe(F.col("p")) & (F.col("block") == F.col("b")))
    return at.select("doc_id", "pattern", "size", (2 * (F.col("start") + F.col("upto")) - F.col("size")).alias("middle"))


def mix(docs: DataFrame, quotas: dict, seed: str = "mix", laps: int = LAPS) -> DataFrame:
    """How often each document is taken: ``doc_id, pattern, size, laps_by_source`` (array of source and laps).

    ``docs`` has ``doc_id``, ``sources`` (array of strings, null elements allowed) and ``size`` (words); ``quotas``
    names the words each source is to get. Documents of no source, and of size 0, are taken by nobody. The result
    depends on ids, sizes and the seed alone; rows of one id and size are interchangeable.
    """
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))))
    rows = docs.select("doc_id", F.to_json(members).alias("pattern"), F.col("size").cast("long").alias("size"))
    found = rows.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    words = {tuple(json.loads(r.pattern)): r.words for r in found}
    name = {tuple(json.loads(r.pattern)): r.pattern for r in found}
    plan = []
    for key, parts in route(words, quotas, laps).items():
        at = 0
        stretches = []
        for source, flow in parts:
            stretches.append({"source": source, "lo": 2 * at, "hi": 2 * (at + flow), "total": 2 * words[key]})
            at += flow
        plan.append((name[key], stretches))
    stretch = "array<struct<source:string,lo:bigint,hi:bigint,total:bigint>>"
    parts = local_table(spark, f"p string, parts {stretch}", plan)
    blocks = {r.pattern: max(1, -(-r.rows // BLOCK_ROWS)) for r in found}
    placed = lay_out(rows, blocks, seed).join(parts, F.col("pattern") == F.col("p"))

    def laps_on(part: Column) -> Column:
        # Whole numbers k with lo <= middle + k * total < hi.
        first = F.greatest(F.lit(0), F.ceil((part["lo"] - F.col("middle")) / part["total"]))
        return F.greatest(F.lit(0), F.ceil((part["hi"] - F.col("middle")) / part["total"]) - first).cast("long")

    by_source = F.transform("parts", lambda p: F.struct(p["source"].alias("source"), laps_on(p).alias("laps")))
    nobody = F.array().cast("array<struct<source:string,laps:bigint>>")
    return placed.select("doc_id", "pattern", "size", F.when(F.col("size") > 0, by_source).otherwise(nobody).alias("laps_by_source"))


def weights_of(sources: list) -> dict:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]
    return {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(ordered)}


def mix_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``, each source weighed by ``weights_of``.

    Sizes count words (null text: 0). A source without words has target 0. An empty table gives no rows.
    """
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    sizes = {r.source: r.words for r in rows.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    targets = share_by_weight(sizes, weights_of(list(sizes)))
    mixed = mix(rows.withColumn("sources", F.array("source")), {s: round(t) for s, t in targets.items()}, seed)
    facts = local_table(
        docs.sparkSession, "name string, source_size long, target double", [(s, sizes[s], round(float(targets[s]), 6)) for s in sizes]
    ).select(F.to_json(F.array("name")).alias("p"), "source_size", "target")
    laps = F.aggregate("laps_by_source", F.lit(0).cast("long"), lambda a, x: a + x["laps"])
    return mixed.join(facts, F.col("pattern") == F.col("p")).select("doc_id", "size", "source_size", "target", (F.col("size") * laps).alias("taken"))
