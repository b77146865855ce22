"""Tables of which readers want the last state of each id: sorted base files, and changes merged in while reading.

Layout below a table's folder::

    base-<name>/        every id once, in order of id
    change-<name>/      rows written by one call, any ids
    snapshot-<number>   a small file: the base that counts, and the changes it already holds

A write adds a change folder and nothing else. A reader takes the newest snapshot: of the base it passes on what no
later change touches, without a shuffle, and only rows of changed ids are compared. Compaction writes a new base and then
its snapshot, under the next free number, by one rename; so readers see the old state or the new one, and of two
compactions at once the second gives up. Changes that arrive meanwhile are in no snapshot yet and stay.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.sources.files import exists, folder

BASE, CHANGE, SNAPSHOT = "base-", "change-", "snapshot-"


class Snapshot(NamedTuple):
    number: int = 0
    base: str | None = None
    merged: tuple[str, ...] = ()


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    if not exists(spark, path):
        return []
    fs, where = folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().startswith(prefix))


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The newest snapshot; before the first compaction, one without a base."""
    found = _names(spark, path, SNAPSHOT)
    if not found:
        return Snapshot()
    told = json.loads(spark.read.text(f"{path}/{found[-1]}", wholetext=True).first()[0])
    return Snapshot(int(found[-1].removeprefix(SNAPSHOT)), told["base"], tuple(told["merged"]))


def _open_changes(spark: SparkSession, path: str, seen: Snapshot) -> list[str]:
    """Change folders that were written whole and are not in the base."""
    return [n for n in _names(spark, path, CHANGE) if n not in seen.merged and exists(spark, f"{path}/{n}/_SUCCESS")]


def add_changes(df: DataFrame, path: str) -> None:
    """The present state of some ids; readers see the last one of each. Repeating it changes nothing."""
    df.write.parquet(f"{path.rstrip('/')}/{CHANGE}{uuid.uuid4().hex}")


def newest(rows: DataFrame) -> DataFrame:
    """The row of each id that changed last; of equal times, the larger row."""
    whole = F.struct(*rows.columns)
    return rows.groupBy("id").agg(F.max_by(whole, F.struct("updated_at", whole)).alias("row")).select("row.*")


def read_latest(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """Each id in its last state. Without open changes this is a plain scan of the base."""
    path = path.rstrip("/")
    seen = snapshot(spark, path)
    return _state(spark, schema, path, seen, _open_changes(spark, path, seen))


def _state(spark: SparkSession, schema: StructType, path: str, seen: Snapshot, changes: list[str]) -> DataFrame:
    reader = spark.read.schema(schema)
    base = reader.parquet(f"{path}/{seen.base}") if seen.base else None
    if not changes:
        return base if base is not None else spark.createDataFrame([], schema)
    changed = newest(reader.parquet(*[f"{path}/{c}" for c in changes]))
    if base is None:
        return changed
    ids = changed.select(F.col("id").alias("_id"))
    touched = newest(changed.unionByName(base.join(ids, F.col("id") == F.col("_id"), "left_semi")))
    return base.join(ids, F.col("id") == F.col("_id"), "left_anti").unionByName(touched)


def compact(spark: SparkSession, schema: StructType, path: str) -> bool:
    """Folds the open changes into a new base, sorted by id; whether it did.

    False where nothing was open, or another compaction came first. Nothing that a reader may hold is removed: see
    ``vacuum``.
    """
    path = path.rstrip("/")
    seen = snapshot(spark, path)
    changes = _open_changes(spark, path, seen)
    if not changes:
        return False
    base = f"{BASE}{uuid.uuid4().hex}"
    state = _state(spark, schema, path, seen, changes)
    state.repartitionByRange(F.col("id")).sortWithinPartitions("id").write.parquet(f"{path}/{base}")
    kept = set(_names(spark, path, CHANGE)) & {*seen.merged, *changes}
    return _publish(spark, path, Snapshot(seen.number + 1, base, tuple(sorted(kept))))


def _publish(spark: SparkSession, path: str, new: Snapshot) -> bool:
    """The snapshot under its number, whole or not at all; False if that number is taken."""
    fs, draft = folder(spark, f"{path}/draft-{uuid.uuid4().hex}")
    _, final = folder(spark, f"{path}/{SNAPSHOT}{new.number:012d}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps({"base": new.base, "merged": new.merged}).encode()))
    finally:
        out.close()
    done = not fs.exists(final) and fs.rename(draft, final)
    if not done:
        fs.delete(draft, False)
    return done


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes what the newest snapshot no longer needs: other bases, merged changes, older snapshots. To be run when no
    reader holds an older snapshot and no compaction is under way."""
    path = path.rstrip("/")
    seen = snapshot(spark, path)
    if seen.base is None:
        return 0
    fs, _ = folder(spark, path)
    old = [n for n in _names(spark, path, BASE) if n != seen.base] + [n for n in _names(spark, path, CHANGE) if n in seen.merged]
    old += [n for n in _names(spark, path, SNAPSHOT) if int(n.removeprefix(SNAPSHOT)) < seen.number]
    for name in old:
        fs.delete(folder(spark, f"{path}/{name}")[1], True)
    return len(old)
