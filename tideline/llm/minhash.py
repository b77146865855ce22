"""Near-duplicate detection by ProbMinHash.

The five-word shingles of a text are weighted by how often they occur. Each shingle sends arrivals of a Poisson process
of that rate to random registers, and a register keeps the shingle that arrived first; generation ends early, once no
later arrival can win. Two texts agree in a register with the probability Jaccard of their weighted shingles, which
for texts that repeat nothing is the plain Jaccard.

Texts of the same weighted shingles are made one first (copies cost nothing later). Bands of registers give candidates:

1. members of a band meet its hub (the one that shares most bands with others) and its smallest id, not one another;
   the registers estimate their similarity and clear misses go;
2. where a band still holds members that no such link connects, their registers are compared across what is
   connected, in blocks of the band, and the pairs near enough go on;
3. the similarity of every pair that is left is computed exactly from all shingles of both texts;
4. where exactness undid an estimated connection, the blocks are compared again across the exact components, with eight
   times as many registers of the texts concerned, and what is near enough is verified too.

So a band of near copies costs a few pairs a member, yet no pair of a band is left out unless its two texts are
already in one class. Comparisons in blocks make no rows but those of near pairs. Classes are connected components of
exact links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import saved
from tideline.llm.components import components

WORDS = 5
SIMILARITY = 0.8
#: Registers, and bands of rows: a pair of similarity 0.8 shares a band with probability 0.9998.
REGISTERS, BANDS, ROWS = 256, 36, 7
#: A pair is verified exactly from this estimate on: four standard deviations below the threshold.
ESTIMATE = 0.7
#: Registers of the texts that step 4 compares, and the estimate that is again four deviations below.
FINE_REGISTERS, FINE_ESTIMATE = 2048, 0.764
#: Bytes hashed at a time.
PIECE = 1 << 20
#: Members of a band that are compared at a time; a larger band is several blocks, which meet two by two.
BLOCK = 1024
#: The filter by which a scan finds the texts wanted has 16 bits an id, and so many at most (8 MB).
FILTER_BITS, FILTER_HASHES = 1 << 26, 4

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\v\f\r")] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_UP = _powers(int(_BASE), 0)
_DOWN = _powers(pow(int(_BASE), -1, 1 << 64), 0)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) <= n:
        size = 1 << n.bit_length()
        _UP, _DOWN = _powers(int(_BASE), size), _powers(pow(int(_BASE), -1, 1 << 64), size)
    return _UP, _DOWN


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes that aren't ASCII white space)."""
    if len(raw) > PIECE:
        # A piece ends at white space; a word longer than a piece makes its piece longer.
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + PIECE)
            while end < len(raw) and not _WHITE[raw[end]]:
                end += 1
            parts.append(_word_hashes(raw[at:end]))
            at = end
        return np.concatenate(parts)
    return _word_hashes(raw)


def _word_hashes(raw: bytes) -> np.ndarray:
    buf = np.frombuffer(raw, np.uint8)
    solid = ~_WHITE[buf]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _tables(len(buf) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct five-word shingles of a whole text (A-Z in lower case) and how often each occurs.

    A text of one to four words is one shingle; a text without words has none.
    """
    words = word_hashes((text or "").encode("utf-8", "replace").lower())
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    code = np.full(n, width, np.uint64)
    for k in range(width):
        code = _mix(code * _ODD + words[k : k + n])
    return np.unique(code, return_counts=True)


def registers(codes: np.ndarray, weights: np.ndarray, size: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first in each register (``size`` a power of two up to 2048)."""
    first, holder = np.full(size, np.inf), np.zeros(size, np.uint64)
    at, when, step = np.arange(len(codes)), np.zeros(len(codes)), 0
    while len(at):
        # Enough arrivals a round that a short text fills its registers in few rounds too.
        ahead = max(1, 4 * size // len(at))
        turn = (np.arange(step + 1, step + ahead + 1, dtype=np.uint64) * _ODD)[None, :]
        draw = _mix(codes[at][:, None] + turn)
        gaps = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weights[at][:, None]
        times = when[at][:, None] + np.cumsum(gaps, axis=1)
        when[at] = times[:, -1]
        x, slot = times.ravel(), (draw & np.uint64(size - 1)).astype(np.int64).ravel()
        early = np.flatnonzero(x < first[slot])
        x, slot = x[early], slot[early]
        order = np.argsort(-x)
        first[slot[order]] = x[order]  # of several, the last written is the earliest
        mine = first[slot] == x
        holder[slot[mine]] = codes[at[early[mine] // ahead]]
        step += ahead
        at = at[when[at] < first.max()]
    return holder


def band_codes(holder: np.ndarray) -> np.ndarray:
    rows = holder[: BANDS * ROWS].reshape(BANDS, ROWS)
    code = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        code = _mix(code * _ODD + rows[:, k])
    return code.astype(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets (sorted codes, weights); 1 for two empty ones.

    The sum over shared d of 1 / sum over all e of max(wa(e)/wa(d), wb(e)/wb(d)): with elements ordered by wa/wb, the
    maximum is the first term up from d and the second one below it, so running sums answer every d at once.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    shared = a[np.minimum(at, len(a) - 1)] == b
    ia, ib = at[shared], np.flatnonzero(shared)
    if not len(ia):
        return 0.0
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    rank = np.searchsorted(ratio[order], ratio, side="left")
    from_x = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0.0]])
    below_y = np.concatenate([[0.0], np.cumsum(y[order])])
    return float((1.0 / ((from_x[rank] + only_a) / x + (below_y[rank] + only_b) / y)).sum())


# The Spark jobs ------------------------------------------------------------------------------------------------------


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, content, n_shingles, bands, signs``: one row per row of ``docs``, made where the text is read.

    ``content`` is a 128-bit digest of the weighted shingles; ``signs`` has eight bits of each register.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                codes, times = shingles(text)
                digest = hashlib.blake2b(codes.tobytes() + times.tobytes(), digest_size=16).digest()
                holder = registers(codes, times.astype(np.float64))
                bands = band_codes(holder) if len(codes) else np.empty(0, np.int64)
                out.append((digest, len(codes), bands, _mix(holder).astype(np.uint8).tobytes()))
            if out:
                kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "content", "n_shingles", "bands", "signs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, "doc_id long, content binary, n_shingles long, bands array<long>, signs binary")


def estimated(pairs: DataFrame, texts: DataFrame, least: float = ESTIMATE) -> DataFrame:
    """The pairs (``a, b``) whose registers agree often enough; eight bits of a register agree by chance once in 256."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
                near = (x == y).mean(axis=1)
                keep = np.flatnonzero((near - 1 / 256) / (1 - 1 / 256) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], ["a", "b"])

    one, other = texts.select(F.col("id").alias("i"), F.col("signs").alias("x")), texts.select(F.col("id").alias("j"), F.col("signs").alias("y"))
    met = pairs.join(one, F.col("a") == F.col("i")).join(other, F.col("b") == F.col("j")).select("a", "b", "x", "y")
    return met.mapInArrow(agree, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (``a, b``) whose exact similarity reaches the threshold, with it."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for a, c, *parts in zip(*(col.to_pylist() for col in b.columns), strict=True):
                x, wx, y, wy = (np.frombuffer(p, np.uint64 if k % 2 == 0 else np.int32) for k, p in enumerate(parts))
                near = probability_jaccard(x, wx, y, wy)
                if near >= least - 1e-12:
                    out.append((a, c, near))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["a", "b", "similarity"])

    one = sets.select(F.col("id").alias("i"), F.col("codes").alias("x"), F.col("times").alias("wx"))
    other = sets.select(F.col("id").alias("j"), F.col("codes").alias("y"), F.col("times").alias("wy"))
    met = pairs.join(one, F.col("a") == F.col("i")).join(other, F.col("b") == F.col("j")).select("a", "b", "x", "wx", "y", "wy")
    return met.mapInArrow(exact, "a long, b long, similarity double")


def _filter_slots(key: str, bits: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(bits)) for k in range(FILTER_HASHES)))


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``id``, of bounded size: one that is full lets everything pass."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * ids.count()).bit_length()))
    slots = ids.select(F.explode(_filter_slots("id", bits)).alias("slot"))
    word = slots.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))).alias("bits")
    ).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[word.column("word").to_numpy()] = word.column("bits").to_numpy().view(np.uint64)
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, codes, times``: all shingles of the texts whose ``id`` is wanted, one row each.

    The scan passes by a Bloom filter, so only the sets of wanted texts (and a few others, which the join drops) move.
    """
    held = docs.sparkSession.sparkContext.broadcast(bloom_filter(wanted))
    bits = 64 * len(held.value)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            slots = b.column(1).flatten().to_numpy().reshape(b.num_rows, FILTER_HASHES).astype(np.uint64)
            seen = (held.value[slots // np.uint64(64)] >> (slots % np.uint64(64))) & np.uint64(1)
            at = pa.array(np.flatnonzero(seen.all(axis=1)))
            out = []
            for text in b.column(2).take(at).to_pylist():
                codes, times = shingles(text)
                out.append((codes.tobytes(), times.astype(np.int32).tobytes()))
            if out:
                columns = [pa.array(list(c), pa.binary()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), *columns], ["id", "codes", "times"])

    named = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = named.select("id", _filter_slots("id", bits).alias("slots"), "text").mapInArrow(made, "id long, codes binary, times binary")
    return sets.join(wanted.select("id"), "id", "left_semi")


def fine_signs(sets: DataFrame) -> DataFrame:
    """``id, signs``: eight bits of each of ``FINE_REGISTERS`` registers, from the shingle sets."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs = [
                _mix(registers(np.frombuffer(codes, np.uint64), np.frombuffer(times, np.int32).astype(np.float64), FINE_REGISTERS)).astype(np.uint8).tobytes()
                for codes, times in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signs, pa.binary())], ["id", "signs"])

    return sets.select("id", "codes", "times").mapInArrow(made, "id long, signs binary")


def across(members: DataFrame, labels: DataFrame, texts: DataFrame, least: float = ESTIMATE) -> DataFrame:
    """Pairs ``a, b`` of one band, of different labels, whose registers agree often enough; the labelled are one already.

    ``members`` has ``band`` and ``id``; an id without a label is its own. Bands of one label are left out. A band is
    cut into blocks of about ``BLOCK`` members, every two blocks meet in a group of their own, and a group gives
    nothing but its near pairs.
    """
    own = members.join(labels.toDF("l", "label"), F.col("id") == F.col("l"), "left").select("band", "id", F.coalesce("label", "id").alias("label"))
    open_bands = own.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low < high")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j")))
    placed = own.join(open_bands.select("band", blocks.alias("blocks")), "band").withColumn("mine", mine)
    placed = placed.join(texts.select(F.col("id").alias("t"), "signs"), F.col("id") == F.col("t"))
    dealt = placed.select("band", "id", "label", "signs", "mine", F.explode(meets).alias("m")).select("band", "m.i", "m.j", "mine", "id", "label", "signs")

    def near(group: pa.Table) -> pa.Table:
        ids, labels, mine = (group.column(c).to_numpy() for c in ("id", "label", "mine"))
        signs = np.frombuffer(b"".join(group.column("signs").to_pylist()), np.uint8).reshape(len(ids), -1)
        first, second = (np.flatnonzero(mine == group.column(c)[0].as_py()) for c in ("i", "j"))
        found = []
        for x in first:
            others = second[labels[second] != labels[x]]
            same = (signs[others] == signs[x]).mean(axis=1)
            for y in others[(same - 1 / 256) / (1 - 1 / 256) >= least]:
                found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        columns = list(zip(*set(found), strict=True)) or [(), ()]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return dealt.groupBy("band", "i", "j").applyInArrow(near, "a long, b long").distinct()


def near_links(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact links ``a, b`` between texts (``id, bands, signs``: one row per distinct content)."""
    members = saved(texts.select("id", F.explode("bands").alias("band")), "bands")
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = saved(members.join(sizes, "band"), "shared-bands")
    drawn = shared.groupBy("id").agg(F.sum("n").alias("drawn"))
    ranked = shared.join(drawn, "id")
    leads = ranked.groupBy("band").agg(F.max_by("id", F.struct("drawn", -F.col("id"))).alias("hub"), F.min("id").alias("low"))
    stars = shared.join(leads, "band").select("id", F.explode(F.array_distinct(F.array("hub", "low"))).alias("lead")).filter("id <> lead")
    pairs = stars.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    members = shared.select("band", "id")
    likely = saved(estimated(pairs, texts), "likely")
    likely = saved(likely.union(across(members, components(likely), texts)).distinct(), "all-likely")
    # Texts near enough to any other; a pair that exactness leaves open later is among them on both sides.
    sets = saved(shingle_sets(docs, likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "shingle-sets")
    links = saved(verified(likely, sets).select("a", "b"), "links")
    held = members.join(sets.select("id"), "id", "left_semi")
    again = across(held, components(links), saved(fine_signs(sets), "fine-signs"), FINE_ESTIMATE).join(likely, ["a", "b"], "left_anti")
    return links.union(verified(again, sets).select("a", "b"))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, kept, n_shingles``.

    ``class_id`` is the smallest ``doc_id`` of the class and the one kept. Texts without words are copies of one
    another. Rows that repeat an id and a text are one document; different texts of one id share their class. A row
    without an id has no class and is kept. An empty table gives no rows.
    """
    found = saved(sketches(docs), "sketches")
    named = found.filter(F.col("doc_id").isNotNull())
    texts = saved(
        named.groupBy("content").agg(
            F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.any_value("bands").alias("bands"), F.any_value("signs").alias("signs")
        ), "texts",
    )
    labels = components(near_links(docs, texts)).toDF("l", "label")
    classed = texts.select("content", "id", "rows").join(labels, F.col("id") == F.col("l"), "left").select(
        "content", F.coalesce("label", "id").alias("class_id"), "rows"
    )
    sizes = classed.groupBy("class_id").agg(F.sum("rows").alias("class_size"))
    of_content = classed.drop("rows").join(sizes, "class_id")
    rows = found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("content")).alias("content"), "n_shingles")
    return rows.join(of_content, "content", "left").select(
        "doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"), "n_shingles",
    )
