"""Exact deduplication by Grace hashing.

Texts are dealt into buckets by the leading bits of a 64-bit hash; Spark's shuffle files are the spill files. A bucket
whose distinct content is over the memory bound is dealt again by the next bits, until every bucket fits an
open-addressing table. A table entry is claimed only by identical content, so colliding hashes never merge texts.

A copied text is first collapsed where it is read: each task passes it on once for each time its table fills up,
however many copies it saw. Nothing gathers the members of a group; every row looks up its group by the digest of
its text instead, in a join that Spark splits when one text holds many of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import shuffle_partitions, text_or_empty

#: Bytes of distinct content a table holds.
TABLE_BYTES = 32 << 20
#: Bits by which a bucket that doesn't fit is dealt again.
STEP_BITS = 4

PARTIAL = "hash long, text binary, members long, keep_id long"
FINAL = "text_sha256 string, group_size long, keep_id long"


class TextTable:
    """Open addressing with linear probing, from complete content to a member count and the largest id."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def _slot(self, code: int, text: bytes) -> int:
        mask = len(self.slots) - 1
        at = (code ^ (code >> 29)) & mask
        while (held := self.slots[at]) >= 0:
            entry = self.entries[held]
            if entry[0] == code and entry[1] == text:
                break
            at = (at + 1) & mask
        return at

    def add(self, code: int, text: bytes, members: int, keep_id: int | None) -> None:
        at = self._slot(code, text)
        if self.slots[at] >= 0:
            entry = self.entries[self.slots[at]]
            entry[2] += members
            if keep_id is not None and (entry[3] is None or keep_id > entry[3]):
                entry[3] = keep_id
            return
        self.slots[at] = len(self.entries)
        self.entries.append([code, text, members, keep_id])
        self.bytes += len(text) + 64
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, (held, content, _, _) in enumerate(self.entries):
                self.slots[self._slot(held, content)] = i


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, text, members, keep_id) with the copies seen by this task's table made one."""
    table = TextTable()
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            table.add(*row)
            if table.bytes > TABLE_BYTES:
                yield _partial(table)
                table = TextTable()
    if table.entries:
        yield _partial(table)


def _partial(table: TextTable) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
    columns = [pa.array(c, kind) for c, kind in zip(zip(*table.entries, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["hash", "text", "members", "keep_id"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct text; the input is sorted by bucket, and a table holds one bucket."""
    table, current = TextTable(), None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if bucket != current and table.entries:
                yield _final(table)
                table = TextTable()
            current = bucket
            table.add(*row)
    if table.entries:
        yield _final(table)


def _final(table: TextTable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([hashlib.sha256(e[1]).hexdigest() for e in table.entries], pa.string()),
            pa.array([e[2] for e in table.entries], pa.int64()),
            pa.array([e[3] for e in table.entries], pa.int64()),
        ],
        ["text_sha256", "group_size", "keep_id"],
    )


def _lead(bits: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")


def bucket_of(rows: DataFrame, table_bytes: int = TABLE_BYTES) -> Column:
    """The bucket of a hash, from the measured bytes of distinct content: dealt again until each fits a table.

    ``rows`` has ``hash`` and ``text``. A bucket that holds a single hash is never split further.
    """
    sizes = rows.groupBy("hash").agg(F.max(F.octet_length("text")).alias("bytes"))
    total = sizes.agg(F.sum(F.col("bytes") + 64)).first()[0] or 0
    bits = min(40, max(6, (8 * total // table_bytes).bit_length()))
    bucket = F.concat_ws(":", F.lit(bits), _lead(bits))
    while bits < 64:
        full = (
            sizes.groupBy(bucket.alias("bucket"))
            .agg(F.sum(F.col("bytes") + 64).alias("bytes"), F.count("*").alias("hashes"))
            .filter((F.col("bytes") > table_bytes) & (F.col("hashes") > 1))
        )
        over = [r.bucket for r in full.select("bucket").collect()]
        if not over:
            break
        bits = min(64, bits + STEP_BITS)
        bucket = F.when(bucket.isin(over), F.concat_ws(":", F.lit(bits), _lead(bits))).otherwise(bucket)
    return bucket


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct text: ``text_sha256, group_size, keep_id`` (the largest id).

    Needs ``doc_id`` and ``text``; other columns are not read. Null text counts as empty. A group whose ids are all
    null keeps null.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).select(
        F.xxhash64("text").alias("hash"), "text", "doc_id"
    )
    bucket = bucket_of(rows, table_bytes)
    partial = rows.select("hash", F.col("text").cast("binary"), F.lit(1).cast("long"), "doc_id").mapInArrow(_collapse, PARTIAL)
    dealt = (
        partial.select(bucket.alias("bucket"), "hash", "text", "members", "keep_id")
        .repartition(shuffle_partitions(docs.sparkSession), "bucket")
        .sortWithinPartitions("bucket")
    )
    return dealt.mapInArrow(_groups, FINAL)


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays. Rows that repeat both id and text are one document and
    share ``kept``; a row without an id stays only where its whole group has none. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.sha2(text_or_empty(), 256).alias("text_sha256"))
    return rows.join(exact_groups(docs, table_bytes), "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
