"""Quality classifier: ridge regression on random Fourier features, calibrated isotonically.

Statistics of a whole text are standardised and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel. Every partition of the training rows sums its part of the normal equations; the sums
are small and fixed in size, so the driver solves them. Scores of rows left out of that fit are calibrated by pooling
adjacent violators over a histogram of raw scores.

The fit uses at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of their id; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tideline.llm.common import saved

#: Labelled rows the fit uses, about; the rows are chosen by hash.
TRAIN_ROWS = 40_000
#: Random Fourier features, ridge penalty and their seed.
COSINES, PENALTY, SEED = 384, 1.0, 20_240
#: Partitions that sum the normal equations.
SUM_PARTS = 8
#: Bins of raw scores for calibration, per unit.
BINS = 500
#: From this score on a document counts as good.
GOOD = 0.7

STATISTICS = (
    "log_bytes", "log_words", "word_mean", "word_sd", "words_short", "words_long", "words_distinct", "top_word",
    "lines_log", "lines_distinct", "line_mean", "space", "lower", "upper", "digit", "wide", "stop", "comma", "symbol",
    "other", "entropy", "first_upper", "word_shape", "pair_distinct",
)


def _byte_classes() -> np.ndarray:
    """256 x 9: space, lower, upper, digit, non-ASCII, full stops, commas, symbols, the rest."""
    sets = (
        b" \t\n\v\f\r", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256)),
        b".!?", b",;:", b"#$%&*+<=>@^_|~/\\",
    )
    table = np.zeros((256, len(sets) + 1))
    for k, members in enumerate(sets):
        table[list(members), k] = 1
    table[:, -1] = table.sum(axis=1) == 0
    return table


CLASSES = _byte_classes()


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one whole text, in the order of ``STATISTICS``; all defined for the empty text."""
    raw = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts @ CLASSES / max(1, len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = max(1, len(words))
    seen = counts[counts > 0] / max(1, len(raw))
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    first = sum(w[:1].isupper() for w in words)
    plain = sum(w.isalpha() for w in words)
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean() if len(words) else 0.0, lengths.std() if len(words) else 0.0,
        float((lengths <= 3).sum()) / n, float((lengths > 12).sum()) / n, len(kinds) / n, max(kinds.values(), default=0) / n,
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)),
        *shares, -float((seen * np.log2(seen)).sum()), first / n, plain / n, pairs / max(1, len(words) - 1),
    ])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    sd: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.hstack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_scores(x), self.raw, self.calibrated), 0.0, 1.0)


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 4: fold 2 is held out, fold 3 calibrates, the others fit."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def labelled_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``fold, label, stats`` of the labelled documents the fit uses; never of fold 2.

    Null labels and ids are left out; a document labelled several times has the mean label. The chosen labels are
    at most about ``train_rows`` narrow rows, so they are broadcast and no text is shuffled.
    """
    mean = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).groupBy(
        F.col("doc_id").cast("long").alias("__id")
    ).agg(F.avg(F.col("quality").cast("double")).alias("label"))
    n = mean.count()
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("__id")), F.lit(1 << 40))
    chosen = mean.filter(draw < int((1 << 40) * min(1.0, train_rows / max(1, n))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("__id")
    ).select(fold(F.col("doc_id")).alias("fold"), "label", "text")

    def with_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stats, pa.list_(pa.float64()))], ["fold", "label", "stats"])

    return rows.mapInArrow(with_stats, "fold long, label double, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cosines: int = COSINES) -> Model:
    """Fits on folds 0 and 1 and calibrates on fold 3; without any label every score is 0.5."""
    rows = saved(labelled_rows(docs, labels, train_rows), "quality-train")
    moments = rows.agg(
        *(F.avg(F.get("stats", F.lit(i))) for i in range(len(STATISTICS))), *(F.stddev_pop(F.get("stats", F.lit(i))) for i in range(len(STATISTICS)))
    ).first()
    values = np.array([x or 0.0 for x in moments])
    mean, sd = values[: len(STATISTICS)], values[len(STATISTICS):]
    sd = np.where(sd > 1e-9, sd, 1.0)
    rng = np.random.default_rng(SEED)
    directions = rng.normal(0, 1 / np.sqrt(len(STATISTICS)), (len(STATISTICS), cosines))
    phases = rng.uniform(0, 2 * np.pi, cosines)
    blank = Model(mean, sd, directions, phases, np.zeros(cosines + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((cosines + 1, cosines + 1)), np.zeros(cosines + 1)
        for b in batches:
            if b.num_rows:
                phi = blank.cosines(np.stack(b.column(1).to_numpy(zero_copy_only=False)))
                left += phi.T @ phi
                right += phi.T @ b.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], ["a", "b"])

    parts = rows.filter("fold < 2").select("label", "stats").repartition(SUM_PARTS).mapInArrow(sums, "a binary, b binary").collect()
    left = sum((np.frombuffer(p.a).reshape(cosines + 1, -1) for p in parts), np.zeros((cosines + 1, cosines + 1)))
    right = sum((np.frombuffer(p.b) for p in parts), np.zeros(cosines + 1))
    if not left[-1, -1]:
        return Model(mean, sd, directions, phases, blank.weights, np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    fitted = Model(mean, sd, directions, phases, np.linalg.solve(left + PENALTY * np.eye(cosines + 1), right), blank.raw, blank.calibrated)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = fitted.raw_scores(np.stack(b.column(1).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(score, -1, 2))], ["label", "raw"])

    held = rows.filter("fold = 3").select("label", "stats").mapInArrow(raw, "label double, raw double")
    bins = held.groupBy(F.floor(F.col("raw") * BINS).alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count("*").alias("n")).collect()
    x, y = isotonic([(b.raw, b.label, b.n) for b in bins]) if bins else (blank.raw, blank.calibrated)
    return Model(mean, sd, directions, phases, fitted.weights, x, y)


def isotonic(points: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators; returns block centres and values, to be joined by straight lines.

    ``points`` has (raw score, mean label, weight). One pseudo-row of each label keeps values off 0 and 1.
    """
    total = sum(n for _, _, n in points)
    prior = sum(y * n for _, y, n in points) / total
    blocks: list[list[float]] = []
    for x, y, n in sorted(points):
        blocks.append([x * n, y * n + prior, n + 1, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[3] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Every row and column of ``docs``, read once, with its score (a column of that name is replaced)."""
    rest = docs.drop(name)
    schema = StructType([*rest.schema.fields, StructField(name, DoubleType())])
    text_at, arrow = rest.columns.index("text"), to_arrow_schema(schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([statistics(t) for t in b.column(text_at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(x), pa.float64())], names=arrow.names)

    return rest.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Scores depend on the text alone; null counts as empty. Equal texts have equal scores.
    """
    model = fit(docs, labels, train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_scores(rows, model).select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).cast("int").alias("predicted")
    )
