"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at step j the walk stands on a character, writes it, and moves on if a random bit of
(j, character) says so. Texts a few edits apart fall back into step soon after each edit, so edit distance becomes
Hamming distance between the written strings. The fingerprint keeps what the walk writes at sampled steps: those with
the smallest random priorities among the steps it took. Priorities are shared too, so texts of different length still
sample the same steps wherever both walked.

Walks are held as tables: for a class of characters and a step, how many steps the walk stays. One lookup replaces the
steps on a character, and a text is walked in pieces, whatever its length.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import minhash
from tideline.llm.common import discard, saved, shuffle_partitions, text_or_empty
from tideline.llm.components import components

#: Sampled steps of a fingerprint.
SAMPLES = 128
#: Characters share so many walks; walks repeat after so many steps.
WALKS, PERIOD = 256, 1 << 16
SEED = 77
#: Characters walked at a time, by one text and by texts side by side; fewer texts than so many go on one by one.
PIECE, SIDE_BY_SIDE, TOGETHER = 1 << 16, 1 << 21, 48
#: Blocks of consecutive ids for each shuffle partition, and in all: their heads are a constant of the plan. A larger
#: block takes a task longer and spills its sort; it is never held whole.
BLOCKS_A_PARTITION, MOST_BLOCKS = 4, 8_192
#: Bands of near_groups, and sampled steps a band hashes.
BANDS, BAND_STEPS = 24, 6
#: Members of a band that are compared at a time; a larger band is several blocks, which meet two by two.
BLOCK = 1024
#: Up to so many edits are counted along diagonals; beyond, a table of bits is filled.
FEW_EDITS = 100


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well-spread bits for consecutive inputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walk:
    """The shared walk and the shared priorities of steps; one per worker, made from ``SEED`` alone."""

    def __init__(self) -> None:
        moves = np.random.default_rng(SEED).random((WALKS, PERIOD)) < 0.5
        moves[:, -1] = True
        # Steps spent from j on: the distance to the next move, plus one; the period wraps.
        stay = np.empty((WALKS, PERIOD), np.uint8)
        ahead = np.full(WALKS, 255)
        for j in range(PERIOD - 1, -1, -1):
            ahead = np.where(moves[:, j], 1, np.minimum(ahead + 1, 255))
            stay[:, j] = ahead
        self.stay, self.flat = [row.tobytes() for row in stay], stay.ravel()
        # Steps that are ever among the SAMPLES smallest priorities of a prefix: [enters, leaves).
        self.steps: list[int] = []
        self.leaves: dict[int, int] = {}
        self.heap: list[tuple[int, int]] = []
        self.known = 0
        self._arrays = None

    def _extend(self, upto: int) -> None:
        while self.known < upto:
            steps = np.arange(self.known, self.known + PERIOD, dtype=np.uint64)
            priority = _mix(steps + np.uint64(SEED << 40))
            if len(self.heap) >= SAMPLES:
                keep = priority < np.uint64(-self.heap[0][0])
                steps, priority = steps[keep], priority[keep]
            for s, p in zip(steps.tolist(), priority.tolist(), strict=True):
                if len(self.heap) < SAMPLES:
                    heapq.heappush(self.heap, (-p, s))
                elif p < -self.heap[0][0]:
                    self.leaves[heapq.heapreplace(self.heap, (-p, s))[1]] = s
                else:
                    continue
                self.steps.append(s)
            self.known += PERIOD
            self._arrays = None

    def sampled(self, length: int) -> np.ndarray:
        """The sampled steps of a walk of ``length`` steps, ascending."""
        self._extend(length)
        if self._arrays is None:
            self._arrays = np.array(self.steps), np.array([self.leaves.get(s, 1 << 62) for s in self.steps])
        steps, leaves = self._arrays
        return steps[(steps < length) & (leaves >= length)]

    @staticmethod
    def kinds(codes: np.ndarray) -> np.ndarray:
        """The class of each character."""
        return (_mix(codes.astype(np.uint64) + np.uint64(SEED)) & np.uint64(WALKS - 1)).astype(np.uint8)

    def ends_of(self, many: list[np.ndarray], at: list[int]) -> list[np.ndarray]:
        """``ends`` of many texts (code points) that start at steps of their own, walked side by side.

        Texts are ranked by length, and characters laid out by place first, so that those of one place lie side by side:
        one lookup moves every text that is long enough. Where few are left, each goes on alone.
        """
        lengths = np.array([len(c) for c in many], np.int64)
        rank = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        # How many texts are longer than each place, and where the characters of a place start.
        active = np.searchsorted(-lengths[rank], -np.arange(longest), side="left")
        together = int(np.searchsorted(-active, -TOGETHER, side="right"))
        starts = np.concatenate([[0], np.cumsum(active[:together])])
        kinds = np.empty(starts[-1], np.uint32)
        place = np.arange(together)
        for r, k in enumerate(rank.tolist()):
            head = min(int(lengths[k]), together)
            if not head:
                break
            kinds[starts[:head] + r] = self.kinds(many[k][:head])
        kinds *= np.uint32(PERIOD)
        walked, position = np.empty(starts[-1], np.int64), np.array(at, np.int64)[rank]
        mask, flat = PERIOD - 1, self.flat
        for t in place.tolist():
            low, high = starts[t], starts[t + 1]
            now = position[: high - low]
            now += flat.take((now & mask) + kinds[low:high])
            walked[low:high] = now
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(many)
        for r, k in enumerate(rank.tolist()):
            head = min(int(lengths[k]), together)
            own = walked[starts[:head] + r]
            rest = many[k][head:]
            out[k] = np.concatenate([own, self.ends(rest, int(position[r]))[0]]) if len(rest) else own
        return out

    def ends(self, codes: np.ndarray, at: int) -> tuple[np.ndarray, int]:
        """The step after each character's last, for a walk that starts at step ``at``."""
        stay, mask = self.stay, PERIOD - 1
        out = np.empty(len(codes), np.int64)
        for lo in range(0, len(codes), PIECE):
            kinds = self.kinds(codes[lo : lo + PIECE]).tobytes()
            ends = []
            put = ends.append
            for k in kinds:
                at += stay[k][at & mask]
                put(at)
            out[lo : lo + len(ends)] = ends
        return out, at


_shared: list[Walk] = []


def shared_walk() -> Walk:
    if not _shared:
        _shared.append(Walk())
    return _shared[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint_of(codes: np.ndarray, ends: np.ndarray) -> str:
    """``steps:symbols``, the number of steps walked and two hex digits for each sampled step, in order."""
    total = int(ends[-1]) if len(ends) else 0
    sampled = shared_walk().sampled(total)
    on = codes[np.searchsorted(ends, sampled, side="right")]
    return f"{total}:{(_mix(on.astype(np.uint64) + np.uint64(SEED << 20)) >> np.uint64(56)).astype(np.uint8).tobytes().hex()}"


def fingerprint_text(text: str) -> str:
    """The fingerprint of one whole text; that of the empty text is ``0:``."""
    codes = code_points(text)
    return fingerprint_of(codes, shared_walk().ends(codes, 0)[0])


def _read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    total, symbols = fingerprint.split(":")
    return shared_walk().sampled(int(total)), np.frombuffer(bytes.fromhex(symbols), np.uint8)


def likeness(one: str, other: str) -> float:
    """Share of the longer walk's sampled steps at which both walks wrote the same; 1 for equal fingerprints.

    Steps the shorter walk never reached count as different. Every sampled step of the longer walk that the shorter
    one reached is among the latter's samples too.
    """
    if one == other:
        return 1.0
    short, long = sorted((one, other), key=lambda f: int(f.split(":")[0]))
    (steps, symbols), (steps2, symbols2) = _read(short), _read(long)
    reached = steps2 < int(short.split(":")[0])
    same = symbols[np.searchsorted(steps, steps2[reached])] == symbols2[reached]
    return float(same.sum() / len(steps2))


def _alike_from(a: str, b: str, i: int, j: int) -> int:
    """How many characters agree from ``a[i]`` and ``b[j]`` on."""
    if a[i : i + 1] != b[j : j + 1]:
        return 0
    most = min(len(a) - i, len(b) - j)
    at, step = 0, 32
    while step:
        if at + step <= most and a[i + at : i + at + step] == b[j + at : j + at + step]:
            at, step = at + step, step * 2
        elif at + step > most and at < most and a[i + at : i + most] == b[j + at : j + most]:
            return most
        else:
            step //= 2
            while step and at + step > most:
                step //= 2
            while step and a[i + at : i + at + step] != b[j + at : j + at + step]:
                step //= 2
            at, step = at + step, step // 2
    return at


def _few_edits(a: str, b: str, most: int) -> int | None:
    """The edit distance, by the furthest place each diagonal reaches; None if it is over ``most``."""
    goal = len(b) - len(a)
    reach = {0: _alike_from(a, b, 0, 0)}
    for d in range(most + 1):
        if d:
            last, reach = reach, {}
            for k in range(-d, d + 1):  # place i of a, i + k of b
                i = max(last.get(k, -2) + 1, last.get(k + 1, -2) + 1, last.get(k - 1, -2))
                i = min(i, len(a), len(b) - k)
                if i >= 0 and i + k >= 0:
                    reach[k] = i + _alike_from(a, b, i, i + k)
        if reach.get(goal) == len(a):
            return d
    return None


def _many_edits(a: str, b: str, most: int) -> int:
    """The edit distance, from columns of bits (Myers); any number over ``most`` if it is over that."""
    codes = code_points(a)
    kinds, at = np.unique(codes, return_inverse=True)
    order, starts = np.argsort(at, kind="stable"), np.searchsorted(np.sort(at), np.arange(len(kinds) + 1))
    held = {}
    for k, code in enumerate(kinds.tolist()):
        bits = np.zeros(len(codes), np.uint8)
        bits[order[starts[k] : starts[k + 1]]] = 1
        held[chr(code)] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full, last = (1 << len(codes)) - 1, len(codes) - 1
    up, down, score = full, 0, len(codes)
    for left, c in enumerate(b):
        eq = held.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(h | up)), up & h
        score += (more >> last & 1) - (less >> last & 1)
        if score - (len(b) - left - 1) > most:
            return most + 1
        more = more << 1 | 1
        up, down = (less << 1 | ~(x | more)) & full, more & x & full
    return score


def near_texts(a: str, b: str, at_least: float) -> bool:
    """Whether the edit distance of two whole texts is at most ``1 - at_least`` of the longer one's length."""
    most = int((1 - at_least) * max(len(a), len(b)) + 1e-9)
    if a == b or abs(len(a) - len(b)) > most:
        return a == b
    same = _alike_from(a, b, 0, 0)
    a, b = a[same:][::-1], b[same:][::-1]
    same = _alike_from(a, b, 0, 0)
    a, b = sorted((a[same:], b[same:]), key=len)
    if len(b) <= most or _few_edits(a, b, min(most, FEW_EDITS)) is not None:
        return True
    return most > FEW_EDITS and _many_edits(a, b, most) <= most


# One document and the next: the operator's own job -------------------------------------------------------------------

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "text_key string"
)


def text_key(text: str) -> str:
    """The digest that tells texts apart, as Spark's ``md5`` has it."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


class _Doc:
    def __init__(self, key: int | None, text: str) -> None:
        self.key, self.text, self.codes = key, text, code_points(text)
        self.ends: np.ndarray | None = None
        self.fingerprint = ""


def _rows_of(pairs: list[tuple[_Doc, _Doc]]) -> list[tuple]:
    """Rows (``RESULT``) of documents and the ones that follow; all their texts are walked side by side, then all edited ones.

    An edited text is the document's with its second half from the start of the next; the first half's walk is kept.
    """
    walk = shared_walk()
    fresh = list({id(d): d for pair in pairs for d in pair if d.ends is None}.values())
    for doc, ends in zip(fresh, walk.ends_of([d.codes for d in fresh], [0] * len(fresh)), strict=True):
        doc.ends, doc.fingerprint = ends, fingerprint_of(doc.codes, ends)
    halves = [len(doc.codes) // 2 for doc, _ in pairs]
    from_next = [following.codes[:half] for (_, following), half in zip(pairs, halves, strict=True)]
    at = [int(doc.ends[-half - 1]) if len(doc.codes) else 0 for (doc, _), half in zip(pairs, halves, strict=True)]
    rows = []
    for (doc, following), half, tail, ends in zip(pairs, halves, from_next, walk.ends_of(from_next, at), strict=True):
        stays = len(doc.codes) - half
        text = doc.text[:stays] + following.text[:half]
        edited = fingerprint_of(np.concatenate([doc.codes[:stays], tail]), np.concatenate([doc.ends[:stays], ends]))
        rows.append((
            doc.key, len(doc.codes), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), doc.fingerprint, edited,
            likeness(doc.fingerprint, edited), likeness(doc.fingerprint, following.fingerprint), text_key(doc.text),
        ))
    return rows


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, guest, doc_id, text) sorted by block, guests last: each document meets the one after it."""
    waiting, block, pairs, chars = None, None, [], 0
    for batch in batches:
        for b, guest, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != block:
                waiting, block = None, b
            elif waiting is None:
                continue
            following = _Doc(key, text)
            if waiting is not None:
                pairs.append((waiting, following))
                chars += len(following.codes)
                if chars > SIDE_BY_SIDE:
                    yield _batch(_rows_of(pairs))
                    pairs, chars = [], 0
            waiting = None if guest else following
    if pairs:
        yield _batch(_rows_of(pairs))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in RESULT.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def block_heads(docs: DataFrame, blocks: int) -> list[int | None]:
    """Ids that head a block, descending: the largest id and quantiles of the rest; ``[None]`` without any id."""
    shares = [1 - k / blocks for k in range(blocks)]
    largest, found = docs.agg(F.max("doc_id"), F.percentile_approx("doc_id", shares, 100 * blocks)).first()
    return sorted({largest, *(found or [])} - {None}, reverse=True) or [None]


def _block_of(heads: list) -> Column:
    """Number of the block an id falls in (binary search); ids below all heads, and null, are in the last."""
    table, last = F.array(*map(F.lit, heads)).cast("array<bigint>"), len(heads) - 1
    span = F.struct(F.lit(0).alias("lo"), F.lit(last).alias("hi"))

    def narrow(s: Column, _: Column) -> Column:
        mid = F.ceil((s["lo"] + s["hi"]) / 2).cast("int")
        inside = F.coalesce(F.get(table, mid) >= F.col("doc_id"), F.lit(True))
        return F.struct(F.when(inside, mid).otherwise(s["lo"]).alias("lo"), F.when(inside, s["hi"]).otherwise(F.greatest(s["lo"], mid - 1)).alias("hi"))

    rounds = F.sequence(F.lit(1), F.lit(max(1, last.bit_length())))
    return F.aggregate(rounds, span, narrow, lambda s: s["lo"])


def edited_fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness (see ``RESULT``).

    With ``keyed`` the digest of its text too.

    The edited text keeps all but the last ``n_chars // 2`` code points and goes on with as many of the next document
    (or all it has), in descending ``doc_id``, nulls last; after the last comes the first, which may be the same.
    Rows of one id are ordered by text. Null text counts as empty; equal texts have equal fingerprints.

    Blocks of consecutive ids are shuffled once; the document that heads the following block comes along as a guest,
    so no document waits for another task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = shuffle_partitions(spark)
    heads = block_heads(docs.select(F.col("doc_id").cast("long").alias("doc_id")), min(MOST_BLOCKS, BLOCKS_A_PARTITION * parts))
    table = F.array(*map(F.lit, heads)).cast("array<bigint>")
    block = _block_of(heads)
    placed = rows.withColumn("own", block)
    is_head = F.get(table, F.col("own")).eqNullSafe(F.col("doc_id"))
    home = F.struct(F.col("own").alias("block"), F.lit(False).alias("guest"))
    visit = F.struct(F.when(F.col("own") == 0, len(heads) - 1).otherwise(F.col("own") - 1).cast("int").alias("block"), F.lit(True).alias("guest"))
    copies = placed.select("doc_id", "text", F.explode(F.when(is_head, F.array(home, visit)).otherwise(F.array(home))).alias("c"))
    dealt = (
        copies.select("c.block", "c.guest", "doc_id", "text")
        .repartition(parts, "block")
        .sortWithinPartitions("block", "guest", F.col("doc_id").desc_nulls_last(), "text")
    )
    found = dealt.mapInArrow(_pairs, RESULT)
    return found if keyed else found.drop("text_key")


# Groups of near copies ---------------------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text, computed where it is read; with ``keyed`` the text's digest too."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            columns = [pa.array([of(t) for t in texts], pa.string()) for of in (fingerprint_text, text_key)[: 1 + keyed]]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "fingerprint", "text_key"][: 2 + keyed])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(made, "doc_id long, fingerprint string" + ", text_key string" * keyed)


def band_keys(fingerprint: str) -> list[int]:
    """One key a band: a hash of what the walk wrote at the band's steps, those of the smallest hash for this band."""
    steps, symbols = _read(fingerprint)
    if not len(steps):
        return [0] * BANDS
    steps = steps.astype(np.uint64)
    salts = _mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(SEED << 30))
    drawn = _mix(steps[None, :] ^ salts[:, None])
    order = np.argpartition(drawn, BAND_STEPS - 1, axis=1)[:, :BAND_STEPS] if len(steps) > BAND_STEPS else np.argsort(drawn, axis=1)
    said = _mix(_mix(steps) + symbols.astype(np.uint64))
    return _mix(said[order].sum(axis=1, dtype=np.uint64)).astype(np.int64).tolist()


def alike(pairs: DataFrame, prints: DataFrame, at_least: float) -> DataFrame:
    """The pairs (``doc_id, leader``) whose whole fingerprints are alike enough, with their ``likeness``."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [likeness(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.float64())], ["doc_id", "leader", "likeness"])

    mine, theirs = (prints.select(F.col("fingerprint").alias(f), F.col("doc_id").alias(i)) for f, i in (("f1", "i1"), ("f2", "i2")))
    met = pairs.join(mine, F.col("doc_id") == F.col("i1")).join(theirs, F.col("leader") == F.col("i2")).select("doc_id", "leader", "f1", "f2")
    return met.mapInArrow(compared, "doc_id long, leader long, likeness double").filter(F.col("likeness") >= at_least)


def edited_little(links: DataFrame, texts: DataFrame, at_least: float) -> DataFrame:
    """The links whose whole texts (``doc_id, text``) have an edit distance of ``1 - at_least`` of the longer one at most."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [near_texts(x, y, at_least) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:3], ["doc_id", "leader", "likeness"]).filter(pa.array(near, pa.bool_()))

    mine, theirs = (texts.select(F.col("text").alias(t), F.col("doc_id").alias(i)) for t, i in (("t1", "i1"), ("t2", "i2")))
    met = links.join(mine, F.col("doc_id") == F.col("i1")).join(theirs, F.col("leader") == F.col("i2"))
    return met.select("doc_id", "leader", "likeness", "t1", "t2").mapInArrow(compared, "doc_id long, leader long, likeness double")


def _sides(prints: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of fingerprints at all steps that any of them sampled (-1: not sampled), their walks' lengths and samples."""
    read = [_read(f) for f in prints]
    every = np.unique(np.concatenate([steps for steps, _ in read]))
    said = np.full((len(read), len(every)), -1, np.int16)
    for row, (steps, symbols) in zip(said, read, strict=True):
        row[np.searchsorted(every, steps)] = symbols
    return said, np.array([int(f.split(":")[0]) for f in prints]), np.array([len(steps) for steps, _ in read])


def across(members: DataFrame, labels: DataFrame, prints: DataFrame, at_least: float, whole: bool) -> DataFrame:
    """Pairs ``doc_id, leader`` of one band, of different labels and alike enough; the labelled are one already.

    An id without a label is its own. Bands of one label are left out. A band is cut into blocks of about ``BLOCK``
    members, and every two blocks meet in a group of their own. A group gives all its pairs if ``whole``, else as many
    as connect what they connect.
    """
    own = members.join(labels.toDF("l", "label"), F.col("doc_id") == F.col("l"), "left").select(
        "band", "code", "doc_id", F.coalesce("label", "doc_id").alias("label")
    )
    low_high = own.groupBy("band", "code").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    open_bands = low_high.filter("low < high").select("band", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j")))
    placed = own.join(open_bands, ["band", "code"]).withColumn("mine", mine)
    placed = placed.join(prints.select(F.col("doc_id").alias("t"), "fingerprint"), F.col("doc_id") == F.col("t"))
    dealt = placed.select("band", "code", "doc_id", "label", "fingerprint", "mine", F.explode(meets).alias("m")).select(
        "band", "code", "m.i", "m.j", "mine", "doc_id", "label", "fingerprint"
    )

    def near(group: pa.Table) -> pa.Table:
        ids, label, block = (group.column(c).to_numpy().copy() for c in ("doc_id", "label", "mine"))
        said, total, samples = _sides(group.column("fingerprint").to_pylist())
        other = np.where(said < 0, np.int16(-2), said)
        first, second = (np.flatnonzero(block == group.column(c)[0].as_py()) for c in ("i", "j"))
        found = set()
        for x in first:
            others = second[label[second] != label[x]]
            size = np.maximum(1, np.where(total[others] > total[x], samples[others], samples[x]))
            same = (other[others] == said[x]).sum(axis=1) / size
            for y in others[same >= at_least]:
                if label[x] != label[y]:
                    found.add((max(ids[x], ids[y]), min(ids[x], ids[y])))
                    if not whole:
                        label[label == label[y]] = label[x]
        columns = list(zip(*found, strict=True)) or [(), ()]
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "leader": pa.array(columns[1], pa.int64())})

    return dealt.groupBy("band", "code", "i", "j").applyInArrow(near, "doc_id long, leader long").distinct()


def near_links(prints: DataFrame, at_least: float = 0.8, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Verified links ``doc_id, leader, likeness``, which connect all near texts that share a band.

    A band's members meet its smallest id first. Members that no verified link connects are then compared with the
    rest of their band in blocks (``across``), first for as many pairs as connect them; where verification refuses such
    a pair, the bands that hold it give all their pairs. So no pair of a band is left out unless its two texts are
    connected already.

    Every link is verified on the whole fingerprints, and on the edit distance of the whole texts if ``texts`` gives
    these (``doc_id, text`` for a frame of ``doc_id``). Without texts, equal fingerprints are made one before banding.
    """
    unique = prints.select("doc_id", "fingerprint") if texts is not None else saved(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fingerprint"), "unique-prints"
    )

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [band_keys(f) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "keys"])

    def verified(links: DataFrame, label: str) -> DataFrame:
        if texts is None or links.isEmpty():
            return links
        wanted = links.select(F.explode(F.array("doc_id", "leader")).alias("doc_id")).distinct()
        return saved(edited_little(links, saved(texts(wanted), "wanted-texts"), at_least), f"{label}-verified")

    def ends(links: DataFrame) -> DataFrame:
        return links.select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))

    keyed = unique.mapInArrow(banded, "doc_id long, keys array<long>").select("doc_id", F.posexplode("keys").alias("band", "code"))
    members = saved(keyed, "print-bands")
    leads = members.groupBy("band", "code").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    shared = saved(members.join(leads.drop("n"), ["band", "code"]), "shared-print-bands")
    discard(members)
    stars = shared.filter("doc_id <> leader").select("doc_id", "leader").distinct()
    links = saved(alike(stars, unique, at_least), "star-links")
    if texts is not None:
        # One leader is enough to verify: what that leaves unconnected is compared again below.
        first = links.groupBy("doc_id").agg(F.min_by(F.struct("leader", "likeness"), "leader").alias("s"))
        links = verified(saved(first.select("doc_id", "s.leader", "s.likeness"), "first-links"), "star-links")
    pairs = across(shared.drop("leader"), components(ends(links)), unique, at_least, whole=False)
    found = saved(alike(pairs, unique, at_least), "links-across")
    more = verified(found, "links-across")
    links = links.unionByName(more)
    judged = found.select(F.col("doc_id").alias("x"), F.col("leader").alias("y"))
    refused = saved(judged.join(more.select(F.col("doc_id").alias("x"), F.col("leader").alias("y")), ["x", "y"], "left_anti"), "refused-links")
    if refused.isEmpty():
        return links
    # A band that does not hold both ends of a refused pair has connected what is near in it; the others give all pairs.
    held = shared.select("band", "code", "doc_id")
    both = refused.join(held.withColumnRenamed("doc_id", "x"), "x").join(held.withColumnRenamed("doc_id", "y"), ["band", "code", "y"])
    again = shared.drop("leader").join(both.select("band", "code").distinct(), ["band", "code"], "left_semi")
    pairs = across(again, components(ends(links)), unique, at_least, whole=True)
    new = pairs.join(refused, (F.col("doc_id") == F.col("x")) & (F.col("leader") == F.col("y")), "left_anti")
    return links.unionByName(verified(saved(alike(new, unique, at_least), "links-again"), "links-again"))


def wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, text`` for every row (``doc_id, text_key``) of ``wanted``: the text of that key, under that number.

    The scan passes by a Bloom filter, so only wanted texts (and a few others, which the join drops) are shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(minhash.bloom_filter(wanted.select(F.xxhash64("text_key").alias("id"))))
    bits = 64 * len(held.value)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                slots = b.column(1).flatten().to_numpy().reshape(b.num_rows, minhash.FILTER_HASHES).astype(np.uint64)
                seen = (held.value[slots // np.uint64(64)] >> (slots % np.uint64(64))) & np.uint64(1)
                at = pa.array(np.flatnonzero(seen.all(axis=1)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at)], ["key", "text"])

    keyed = docs.filter(F.col("doc_id").isNotNull()).select(text_or_empty().alias("text")).select(F.md5("text").alias("key"), "text")
    slots = keyed.select("key", F.xxhash64("key").alias("id"), "text").select("key", minhash._filter_slots("id", bits).alias("slots"), "text")
    once = slots.mapInArrow(passing, "key string, text string").dropDuplicates(["key"])
    return once.join(wanted, F.col("key") == F.col("text_key")).select("doc_id", "text")


def groups_of(prints: DataFrame, docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """``text_key, group_id`` for each distinct text of ``prints`` (``doc_id, text_key, fingerprint``), ids not null.

    ``group_id`` is the smallest id of the group, which verified links connect. Texts are numbered first, so that
    several texts of one id stay apart.
    """
    once = prints.filter(F.col("doc_id").isNotNull()).groupBy("text_key").agg(F.min("doc_id").alias("first"), F.any_value("fingerprint").alias("fingerprint"))
    nodes = saved(once.withColumn("number", F.monotonically_increasing_id()), "texts")
    numbered = nodes.select(F.col("number").alias("doc_id"), "fingerprint", "text_key")
    links = near_links(numbered, at_least, lambda ids: wanted_texts(docs, nodes.join(ids, F.col("number") == F.col("doc_id")).select("doc_id", "text_key")))
    labels = components(links.select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))).toDF("l", "label")
    labelled = nodes.join(labels, F.col("number") == F.col("l"), "left").select("text_key", "first", F.coalesce("label", "number").alias("label"))
    return labelled.select("text_key", "label").join(labelled.groupBy("label").agg(F.min("first").alias("group_id")), "label").select("text_key", "group_id")


def near_groups(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """``doc_id, group_id``, one row per document with an id: the smallest id that verified links lead to.

    Equal texts are in one group; one without any link is its own. Rows without an id are left out.
    """
    prints = saved(fingerprints(docs, keyed=True).filter(F.col("doc_id").isNotNull()), "fingerprints")
    return prints.join(groups_of(prints, docs, at_least), "text_key").select("doc_id", "group_id")


def fingerprint_documents(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """The rows of ``edited_fingerprints`` and ``group_id``, the smallest id of the document's group of near texts.

    A row without an id has no group.
    """
    prints = saved(edited_fingerprints(docs, keyed=True), "fingerprints")
    groups = groups_of(prints, docs, at_least).toDF("key", "group_id")
    mine = F.when(F.col("doc_id").isNotNull(), F.col("text_key"))
    return prints.join(groups, mine == F.col("key"), "left").drop("key", "text_key")
