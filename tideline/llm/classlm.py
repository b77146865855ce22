"""Language-model scores by Brown's class-based bigrams.

Exchange clustering assigns words to classes; a text's probability is the product of class transitions and of word
emissions, both smoothed. Counts are taken over all training texts:

* ``word_counts``: every word type, by partial counts where the text is read and one shuffle.
* Words of a relative frequency from ``KNOWN`` on form a table that is sent to every task. There can be no more than
  ``1 / KNOWN`` of them in any corpus, so its size has a proven bound. Those from ``FREQUENT`` on are units of the
  clustering; all other words share ``SHAPES`` units by the hash of their last letters, clustered like words.
* ``unit_bigrams``: counts of neighbouring units, dealt by unit, so a pass of exchange finds all neighbours of a
  unit in one place and needs no shuffle. A unit has no more neighbours than there are units.

Scoring needs the count of every word, and rare words are unbounded: their (document, word) pairs meet the counts in a
join. Words of the bounded table are scored where the text is read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import saved, shuffle_partitions

#: Words from this share of the training tokens on are in the table every task gets (a million at most).
KNOWN = 1e-6
#: Words from this share on are units of their own (a hundred thousand at most).
FREQUENT = 1e-5
#: Units the other words share.
SHAPES = 512
#: Word classes, passes of exchange, and the share of units that may move in one pass.
CLASSES, PASSES, MOVING = 64, 10, 2
#: Weight of the unsmoothed class transitions against the class frequencies: n / (n + BACKOFF).
BACKOFF = 5.0
#: Distinct words a task holds, and tokens whose pairs it holds, before it passes its counts on.
HELD, HELD_PAIRS = 400_000, 8_000_000
#: The end of a text; no word contains a blank.
END = b" "


def tokens(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z in lower case, and one end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def shape(word: bytes) -> int:
    """The shared unit of a rare word: 1..SHAPES, by its last letters."""
    return 1 + zlib.crc32(word[-3:]) % SHAPES


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 1."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (binary), ``n``: every token of the training texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(tokens(text))
                if len(counts) > HELD:
                    yield _counts(counts)
                    counts = Counter()
        if counts:
            yield _counts(counts)

    def _counts(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    train = _texts(docs).filter(~held_out(F.col("doc_id"))).select("text")
    return train.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Units:
    """The bounded tables. A word's index is 0 for the end, 1..SHAPES for a word the table lacks, more for one it has."""

    number: dict[bytes, int]
    unit: np.ndarray  # unit of each index
    word_count: np.ndarray  # training tokens of each index, 0 where unknown
    count: np.ndarray  # training tokens of each unit
    types: np.ndarray  # distinct training words of each unit

    def index(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w) or (0 if w is END else shape(w)) for w in words), np.int64, len(words))


def units_of(counts: DataFrame, total: int) -> Units:
    """The known words go to the driver (at most ``1 / KNOWN``); what is no unit of its own is summed by shape."""
    words = counts.filter(F.col("word") != F.lit(END))
    table = words.filter(F.col("n") >= KNOWN * total).toArrow()
    known = sorted(zip(table.column(1).to_pylist(), table.column(0).to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    first = 1 + SHAPES
    own = sum(n >= FREQUENT * total for n, _ in known)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((SHAPES + 1, 2), np.int64)
        for b in batches:
            if b.num_rows:
                at = np.fromiter(map(shape, b.column(0).to_pylist()), np.int64, b.num_rows)
                np.add.at(sums, at, np.stack([b.column(1).to_numpy(), np.ones(b.num_rows, np.int64)], axis=1))
        at = np.nonzero(sums[:, 1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at, 0]), pa.array(sums[at, 1])], ["unit", "n", "types"])

    rest = words.filter(F.col("n") < FREQUENT * total).mapInArrow(shapes, "unit long, n long, types long")
    shared = rest.groupBy("unit").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()
    ends = counts.filter(F.col("word") == F.lit(END)).first()
    count, types = np.zeros(first + own, np.int64), np.ones(first + own, np.int64)
    types[:first] = 0
    for r in shared:
        count[r.unit], types[r.unit] = r.n, r.types
    count[0], types[0] = (ends.n, 1) if ends else (0, 0)
    count[first:] = [n for n, _ in known[:own]]
    unit = np.concatenate([np.arange(first + own), np.fromiter((shape(w) for _, w in known[own:]), np.int64, len(known) - own)])
    word_count = np.concatenate([np.zeros(first, np.int64), np.fromiter((n for n, _ in known), np.int64, len(known))])
    word_count[0] = count[0]
    return Units({w: first + i for i, (_, w) in enumerate(known)}, unit, word_count, count, types)


def unit_bigrams(docs: DataFrame, units) -> DataFrame:
    """``unit, side, other, n`` over the training texts, both ways round, dealt and written by unit.

    ``side`` 0: ``other`` follows; 1: it stands before. Every text starts after an end.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = units.value
        held, size = [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                at = table.unit[table.index(tokens(text))]
                held.append((np.concatenate([[0], at[:-1]]) << 32) | at)
                size += len(at)
                if size > HELD_PAIRS:
                    yield from _pairs(held)
                    held, size = [], 0
        if held:
            yield from _pairs(held)

    def _pairs(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        left, right = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n, pa.int64())], ["left", "right", "n"])

    train = _texts(docs).filter(~held_out(F.col("doc_id"))).select("text")
    pairs = train.mapInArrow(counted, "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
    sides = F.array(
        F.struct(F.col("left").alias("unit"), F.lit(0).alias("side"), F.col("right").alias("other")),
        F.struct(F.col("right").alias("unit"), F.lit(1).alias("side"), F.col("left").alias("other")),
    )
    both = pairs.select(F.explode(sides).alias("s"), "n").select("s.unit", "s.side", "s.other", "n")
    return both.repartition(shuffle_partitions(docs.sparkSession), "unit").sortWithinPartitions("unit")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def class_counts(bigrams: DataFrame, classes) -> np.ndarray:
    """CLASSES x CLASSES transition counts under the current classes."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = classes.value, np.zeros(CLASSES * CLASSES)
        for b in batches:
            sums += np.bincount(of[b.column(0).to_numpy()] * CLASSES + of[b.column(1).to_numpy()], b.column(2).to_numpy(), CLASSES * CLASSES)
        at = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["cell", "n"])

    rows = bigrams.filter("side = 0").select("unit", "other", "n").mapInArrow(summed, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES * CLASSES)
    for r in rows:
        out[r.cell] = r.n
    return out.reshape(CLASSES, CLASSES)


def best_moves(after: np.ndarray, before: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class each unit fits best, by the likelihood of the class bigrams once the unit has left its own.

    ``after`` and ``before``: units x classes counts of what follows and precedes; ``table``: transition counts.
    """
    best = np.empty(len(own), np.int64)
    rows, columns, left, right = table, table.T, table.sum(axis=1), table.sum(axis=0)
    for c in np.unique(own):
        mine = np.nonzero(own == c)[0]
        for lo in range(0, len(mine), 256):
            at = mine[lo : lo + 256]
            a, b = after[at], before[at]
            na, nb = a.sum(axis=1), b.sum(axis=1)
            gain = np.empty((len(at), CLASSES))
            for k in range(CLASSES):
                r, q, nl, nr = rows[k][None], columns[k][None], left[k], right[k]
                if k == c:
                    r, q, nl, nr = np.maximum(r - a, 0), np.maximum(q - b, 0), nl - na, nr - nb
                gain[:, k] = (
                    (_xlogx(r + a) - _xlogx(r)).sum(axis=1) + (_xlogx(q + b) - _xlogx(q)).sum(axis=1)
                    - _xlogx(nl + na) + _xlogx(nl) - _xlogx(nr + nb) + _xlogx(nr)
                )
            best[at] = gain.argmax(axis=1)
    return best


def exchange(bigrams: DataFrame, units: Units, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units and their transition counts.

    In each pass every ``MOVING``-th unit may move to its best class, all at once, given the transitions so far. What
    comes back is one number a unit, of which there are boundedly many.
    """
    spark = bigrams.sparkSession
    n = len(units.count)
    order = np.argsort(-units.count, kind="stable")
    classes = np.empty(n, np.int64)
    classes[order] = np.arange(n) % CLASSES
    for step in range(passes):
        of = spark.sparkContext.broadcast(classes)
        matrix = class_counts(bigrams, of)

        def moved(batches: Iterator[pa.RecordBatch], of=of, matrix=matrix, step=step) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            unit, side, other, count = (table.column(i).to_numpy() for i in range(4))
            ids, at = np.unique(unit, return_inverse=True)
            own = of.value[ids]
            sums = np.zeros((2, len(ids) * CLASSES))
            for k in (0, 1):
                here = side == k
                sums[k] = np.bincount(at[here] * CLASSES + of.value[other[here]], count[here], len(ids) * CLASSES)
            best = best_moves(sums[0].reshape(-1, CLASSES), sums[1].reshape(-1, CLASSES), own, matrix)
            change = best != own
            yield pa.RecordBatch.from_arrays([pa.array(ids[change], pa.int64()), pa.array(best[change])], ["unit", "class"])

        free = bigrams.filter((F.pmod(F.xxhash64("unit"), F.lit(MOVING)) == step % MOVING) & (F.col("unit") != 0))
        moves = free.select("unit", "side", "other", "n").mapInArrow(moved, "unit long, class long").collect()
        classes = classes.copy()
        for r in moves:
            classes[r.unit] = r["class"]
    return classes, class_counts(bigrams, spark.sparkContext.broadcast(classes))


@dataclass(frozen=True)
class ClassModel:
    """log10 of transitions and of units in their classes; and the counts base scores need."""

    units: Units
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray  # log10 p(unit | class)
    inside: np.ndarray  # log10 of the denominator of p(word | unit)
    total: int
    types: int


def model_of(units: Units, classes: np.ndarray, matrix: np.ndarray, total: int, types: int) -> ClassModel:
    share = (matrix.sum(axis=0) + 0.5) / (matrix.sum() + 0.5 * CLASSES)
    seen = matrix.sum(axis=1, keepdims=True)
    transition = np.log10((matrix + BACKOFF * share) / (seen + BACKOFF))
    size = np.bincount(classes, units.count + 0.5, CLASSES)
    emission = np.log10((units.count + 0.5) / size[classes])
    # Words of a shared unit: (count + 0.5) / (tokens + 0.5 * (types + 1)); a word that is a unit is certain.
    inside = np.log10(units.count + 0.5 * (units.types + 1))
    return ClassModel(units, classes, transition, emission, inside, total, types)


def train(docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model and ``word, n`` of the training texts."""
    counts = saved(word_counts(docs), "lm-counts")
    total, types = counts.agg(F.sum("n"), F.count("*")).first()
    units = units_of(counts, total or 0)
    shared = docs.sparkSession.sparkContext.broadcast(units)
    bigrams = saved(unit_bigrams(docs, shared), "lm-bigrams")
    classes, matrix = exchange(bigrams, units)
    return model_of(units, classes, matrix, total or 0, types), counts


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null text counts as empty: its one token is the end. Words never seen in training have count 0 in both scores.
    Rows that share a ``doc_id`` are scored each by its own text. Without any training text all counts are 0.
    """
    spark = docs.sparkSession
    model, counts = train(docs)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs = np.log10(m.units.word_count + 0.5)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out, words, times = [], [], []
            for text in b.column(0).to_pylist():
                said = tokens(text)
                at = m.units.index(said)
                unit = m.units.unit[at]
                cls = m.classes[unit]
                open_word = (at > 0) & (at <= SHAPES)
                in_shape = (unit > 0) & (unit <= SHAPES)
                score = m.transition[np.concatenate([[m.classes[0]], cls[:-1]]), cls].sum() + m.emission[unit].sum()
                # A word of a shared unit adds log10(count + 0.5) - inside; an open one has its count joined later.
                score += logs[at[in_shape & ~open_word]].sum() - m.inside[unit[in_shape]].sum()
                rare = Counter([said[i] for i in np.nonzero(open_word)[0].tolist()])
                known = int((m.units.word_count[at] > 0).sum())
                out.append((row, len(said), known, float(logs[at[~open_word]].sum()), float(score)))
                words.append(list(rare))
                times.append(list(rare.values()))
                row += 1
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(1), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)),
                     pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))],
                    ["doc_id", "row", "n_tokens", "known", "logs", "score", "words", "times"],
                )

    schema = "doc_id long, row long, n_tokens long, known long, logs double, score double, words array<binary>, times array<int>"
    parts = saved(_texts(docs).select("text", "doc_id").mapInArrow(scored, schema), "lm-parts")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    seen = counts.filter(F.col("n") < KNOWN * model.total)
    n = F.coalesce("n", F.lit(0))
    sums = rare.join(seen, "word", "left").groupBy(F.col("row").alias("r")).agg(
        F.sum(F.col("times") * F.log10(n + 0.5)).alias("rare_logs"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    whole = parts.drop("words", "times").join(sums, F.col("row") == F.col("r"), "left")
    more = F.coalesce("rare_logs", F.lit(0.0))
    denominator = float(np.log10(model.total + 0.5 * (model.types + 1)))
    return whole.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("logs") + more - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
