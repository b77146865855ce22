"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of its words and their character n-grams of 3 to 6, each hashed to one of ``BUCKETS`` vectors. The
vectors of the bag are averaged, and a linear softmax turns the mean into a score. Vectors and softmax are trained
together, by gradient descent in numpy. A misspelling that no training text has shares most n-grams with what it
misspells, and inflected forms share their stem, so they are scored alike.

``PRIOR`` further n-grams without a say are put in every bag, so that a text of three words isn't judged by chance.

Training texts are spread over ``PARTS`` groups. In each of ``ROUNDS`` rounds, every group goes over its own texts from
the same start; what the groups changed is then averaged bucket by bucket, over the groups that met the bucket. The
bags of training texts are worked out once and written as one row a group (a few kilobytes a text). A round passes the
model (4 MB) to the groups and back.

The softmax is linear, so a trained model is one number a bucket. Every text is scored where it is read, in pieces,
whatever its length. Scores of rows left out of the fit map them to probabilities, by a logistic curve.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import saved
from tideline.llm.quality import fold

#: Labelled rows the fit uses, about, chosen by hash; one in five of them calibrates.
TRAIN_ROWS, CALIBRATION = 12_000, 5
#: Vectors, their size, and the lengths of n-grams.
BITS, SIZE, SHORTEST, LONGEST = 17, 8, 3, 6
BUCKETS = 1 << BITS
PRIOR = 500
#: Groups that train side by side, how often they meet, how often each goes over its texts in between, and the steps it
#: takes then at least: few texts are gone over more often.
PARTS, ROUNDS, EPOCHS, STEPS = 6, 5, 2, 1_000
RATE, SOFTMAX_RATE, DAMPING, SEED = 10.0, 3.0, 1e-3, 4_711
#: Buckets that are averaged together.
BLOCK = 1 << 12
#: From this score on a text counts as toxic.
TOXIC = 0.3
#: Characters taken at a time. Pieces end at white space; a longer word is cut.
PIECE = 1 << 18

# Odd multipliers of the rolling hash; the second one undoes the first.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Stands before, between and after words.
_EDGE = 1


def _is_space(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def pieces(text: str) -> Iterator[np.ndarray]:
    """A lower-cased text as code points, in pieces that end at white space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    at = 0
    while at < len(codes):
        end = min(len(codes), at + PIECE)
        if end < len(codes):
            spaces = np.flatnonzero(_is_space(codes[at:end]))
            end = at + int(spaces[-1]) + 1 if len(spaces) else end
        yield codes[at:end]
        at = end


def grams(codes: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams and words of a piece, repeats included. The edges of a word count as characters of it."""
    space = _is_space(codes)
    space, codes = (np.concatenate([[x], y, [x]]) for x, y in ((True, space), (32, codes)))
    first = ~(space & np.concatenate([[False], space[:-1]]))
    edge, c = space[first], np.where(space[first], _EDGE, codes[first]).astype(np.uint64)
    n = len(c)
    found = []
    h, whole = c * _STEP, np.ones(n, bool)
    for length in range(2, min(LONGEST, n) + 1):
        h = (h[: n - length + 1] + c[length - 1:]) * _STEP
        whole = whole[: n - length + 1]
        if length > 2:
            whole = whole & ~edge[length - 2: n - 1]
        if length >= SHORTEST:
            found.append(h[whole])
    edges = np.flatnonzero(edge)
    if len(edges) > 1:
        powers = np.multiply.accumulate(np.full(n, _STEP, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * powers)])
        starts = edges[:-1] + 1
        found.append((sums[edges[1:]] - sums[starts]) * np.multiply.accumulate(np.full(n, _BACK, np.uint64))[starts])
    keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return ((keys * _SPREAD) >> np.uint64(64 - BITS)).astype(np.int32)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, ascending, and how often each occurs."""
    counts: np.ndarray | None = None
    for piece in pieces(text or ""):
        part = np.bincount(grams(piece), minlength=BUCKETS)
        counts = part if counts is None else counts + part
    if counts is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.int32), counts[buckets].astype(np.float32)


@dataclass
class Model:
    """Vectors, softmax (a row of weights and a bias per class), sums of squared steps, and the calibration."""

    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    vector_steps: np.ndarray
    softmax_steps: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, share: float) -> Model:
        """A model that knows the share of toxic texts."""
        rng = np.random.default_rng(SEED)
        odds = np.log(share / (1 - share))
        return cls(
            rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32), rng.normal(0, 0.3, (2, SIZE)), np.array([-odds / 2, odds / 2]),
            np.full(BUCKETS, DAMPING, np.float32), np.full(2, 1e-2),
        )

    def weights(self) -> np.ndarray:
        """What each bucket adds to the log odds of the toxic class."""
        return (self.vectors @ (self.softmax[1] - self.softmax[0])).astype(np.float64)

    def odds(self, text: str | None, weights: np.ndarray) -> float:
        total, n = 0.0, PRIOR
        for piece in pieces(text or ""):
            at = grams(piece)
            total, n = total + float(weights[at].sum()), n + len(at)
        return total / n + float(self.bias[1] - self.bias[0])

    def step(self, buckets: np.ndarray, counts: np.ndarray, label: float) -> None:
        """One text: the gradient of its cross entropy, for the softmax and for the vectors of its bag."""
        share = counts / (counts.sum() + PRIOR)
        held = self.vectors[buckets]
        mean = share @ held
        logits = self.softmax @ mean + self.bias
        p = np.exp(logits - logits.max())
        error = p / p.sum() - np.array([1 - label, label])
        # Both classes have opposite errors, so all vectors of the bag move along one direction, by their shares.
        along = error @ self.softmax
        self.vector_steps[buckets] += share * share * float(along @ along)
        self.vectors[buckets] = held - np.outer(RATE * share / np.sqrt(self.vector_steps[buckets]), along).astype(np.float32)
        self.softmax_steps += np.array([float(error @ error) * float(mean @ mean), float(error @ error)])
        pace = SOFTMAX_RATE / np.sqrt(self.softmax_steps)
        self.softmax = self.softmax - pace[0] * np.outer(error, mean)
        self.bias = self.bias - pace[1] * error


def written(kept: tuple[np.ndarray, np.ndarray]) -> bytes:
    """A bag as compressed bytes: steps between its buckets, then counts."""
    buckets, counts = kept
    return zlib.compress(np.diff(buckets, prepend=0).astype("<i4").tobytes() + np.minimum(counts, 1 << 31).astype("<f4").tobytes(), 1)


def read(kept: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(kept)
    return np.cumsum(np.frombuffer(raw, "<i4", len(raw) // 8), dtype=np.int32), np.frombuffer(raw, "<f4", offset=len(raw) // 2).copy()


def training_groups(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``part, draws, labels, bags``: a row for each group of labelled documents the fit uses; never of fold 2.

    Null labels and ids are left out; a document labelled several times has the mean label. The chosen labels are at
    most about ``train_rows`` narrow rows, so they are broadcast; of the texts only compressed bags are shuffled, once.
    """
    mean = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).groupBy(
        F.col("doc_id").cast("long").alias("__id")
    ).agg(F.avg(F.col("toxic").cast("double")).alias("label"))
    n = mean.count()
    chosen = mean.withColumn("draw", F.pmod(F.xxhash64(F.lit(SEED), F.col("__id")), F.lit(1 << 40))).filter(
        F.col("draw") < int((1 << 40) * min(1.0, train_rows / max(1, n)))
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("__id")
    ).select(F.pmod("draw", F.lit(PARTS)).alias("part"), "draw", "label", "text")

    def with_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = pa.array([written(bag(t.as_py())) for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], bags], ["part", "draw", "label", "bag"])

    one = F.sort_array(F.collect_list(F.struct("draw", "label", "bag")))
    groups = rows.mapInArrow(with_bags, "part long, draw long, label double, bag binary").groupBy("part").agg(one.alias("rows"))
    return groups.select("part", *(F.col(f"rows.{c}").alias(f"{c}s") for c in ("draw", "label", "bag")))


def _calibrates(draws: np.ndarray) -> np.ndarray:
    return draws // PARTS % CALIBRATION == 0


def _groups(batches: Iterator[pa.RecordBatch], calibrate: bool) -> Iterator[tuple[np.ndarray, list]]:
    """Labels and bags of one group after another: the rows that calibrate, or those that are learned from."""
    for b in batches:
        for draws, labels, bags in zip(*(b.column(k) for k in range(3)), strict=True):
            wanted = np.flatnonzero(_calibrates(draws.values.to_numpy()) == calibrate)
            yield labels.values.to_numpy()[wanted], [read(bags.values[int(i)].as_py()) for i in wanted]


def _round(groups: DataFrame, model: Model, number: int) -> Model:
    """Every group trains on from ``model``; the changes are averaged, a block of buckets at a time."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, bags in _groups(batches, calibrate=False):
            if not len(label):
                continue
            own = replace(model, vectors=model.vectors.copy(), vector_steps=model.vector_steps.copy(), softmax_steps=model.softmax_steps.copy())
            met = np.zeros(BUCKETS, np.float32)
            rng = np.random.default_rng([SEED, number])
            for _ in range(max(EPOCHS, STEPS // len(label))):
                for i in rng.permutation(len(label)):
                    own.step(*bags[i], label[i])
            for buckets, _ in bags:
                met[buckets] = 1
            head = np.concatenate([own.softmax.ravel(), own.bias, own.softmax_steps, [1.0]])
            moved = np.column_stack([own.vectors - model.vectors, own.vector_steps - model.vector_steps, met]).astype(np.float32)
            blocks = [head.astype(np.float32).tobytes(), *(moved[k: k + BLOCK].tobytes() for k in range(0, BUCKETS, BLOCK))]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(blocks) - 1), pa.int32()), pa.array(blocks, pa.binary())], ["block", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float32).astype(np.float64) for v in sorted(group.column("sums").to_pylist()))
        return pa.table({"block": group.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    trained = groups.select("draws", "labels", "bags").mapInArrow(train, "block int, sums binary")
    sums = {r["block"]: np.frombuffer(r["sums"]) for r in trained.groupBy("block").applyInArrow(add, "block int, sums binary").collect()}
    head = sums[-1][:-1] / sums[-1][-1]
    moved = np.concatenate([sums[k].reshape(-1, SIZE + 2) for k in range(BUCKETS // BLOCK)])
    moved /= np.maximum(1, moved[:, -1:])
    return replace(
        model, vectors=model.vectors + moved[:, :SIZE].astype(np.float32), vector_steps=model.vector_steps + moved[:, SIZE].astype(np.float32),
        softmax=head[: 2 * SIZE].reshape(2, SIZE), bias=head[2 * SIZE: 2 * SIZE + 2], softmax_steps=head[2 * SIZE + 2:],
    )


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A calibrated model; none where no row may be learned from."""
    groups = saved(training_groups(docs, labels, train_rows), "toxicity-groups")
    rows = groups.select(F.explode(F.arrays_zip("draws", "labels")).alias("row")).select("row.draws", "row.labels")
    learned = F.pmod(F.floor(F.col("draws") / PARTS), F.lit(CALIBRATION)) != 0
    known = rows.filter(learned).agg(F.avg("labels").alias("share"), F.count("*").alias("n")).first()
    if not known["n"]:
        return None
    model = Model.fresh((known["share"] * known["n"] + 0.5) / (known["n"] + 1))
    for number in range(ROUNDS):
        model = _round(groups, model, number)
    weights, bias = model.weights().astype(np.float32), float(model.bias[1] - model.bias[0])

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, bags in _groups(batches, calibrate=True):
            z = [float(weights[buckets] @ counts) / (float(counts.sum()) + PRIOR) + bias for buckets, counts in bags]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.float64()), pa.array(z, pa.float64())], ["label", "z"])

    scored = groups.select("draws", "labels", "bags").mapInArrow(odds, "label double, z double")
    bins = scored.groupBy(F.round(F.least(F.greatest("z", F.lit(-50.0)), F.lit(50.0)), 1).alias("z")).agg(F.avg("label").alias("label"), F.count("*").alias("n"))
    slope, shift = logistic([(b["z"], b["label"], b["n"]) for b in bins.collect()])
    return replace(model, slope=slope, shift=shift)


def logistic(points: list[tuple[float, float, int]], penalty: float = 1.0) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (odds, mean label, weight), drawn towards odds as they are."""
    z, y, n = (np.array(c, float) for c in zip(*points, strict=True)) if points else [np.zeros(0)] * 3
    at = np.array([1.0, 0.0])
    x = np.column_stack([z, np.ones(len(z))])

    def loss(w: np.ndarray) -> float:
        s = x @ w
        return float((n * (np.logaddexp(0, s) - y * s)).sum() + penalty / 2 * ((w - [1.0, 0.0]) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        grad = x.T @ (n * (p - y)) + penalty * (at - [1.0, 0.0])
        move = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(at - size * move) > loss(at):
            size /= 2
        at = at - size * move
        if np.abs(size * move).max() < 1e-9:
            break
    return max(0.0, float(at[0])), float(at[1])


def classify_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Scores depend on the text alone: null counts as empty, equal texts have equal scores, texts of any length are read
    whole. An empty text has the score of an empty bag, near the share of toxic rows. Without a label to learn from every
    score is 0.5. Repeated rows come out as often as they come in; an empty table gives none. Other columns are not read.
    """
    model = fit(docs, labels, train_rows)
    weights = None if model is None else model.weights()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None:
                score = np.full(b.num_rows, 0.5)
            else:
                z = np.array([model.odds(t.as_py(), weights) for t in b.column(1)], float)
                score = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    held: Column = (fold(F.col("doc_id")) == 2).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id", held, "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).cast("int").alias("predicted")
    )
