"""Latest-state tables: the same rows before, during and after compaction."""

from datetime import datetime, timedelta, timezone

from tideline.functions.frames import local_frame
from tideline.schema import TABLES
from tideline.sources import latest, tables

T0 = datetime(2026, 7, 20, tzinfo=timezone.utc)
SCHEMA = TABLES["incidents"]


def states(spark, *rows):
    return local_frame(spark, [{**{f.name: None for f in SCHEMA.fields}, "id": i, "status": s, "event_count": n, "updated_at": T0 + timedelta(seconds=at)} for i, s, n, at in rows], SCHEMA)


def seen(spark, path):
    return sorted((r.id, r.status, r.event_count) for r in tables.scan_incidents(spark, path).collect())


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_before_during_and_after(spark, tmp_path):
    path = str(tmp_path / "incidents")
    assert seen(spark, path) == [] and not tables.compact_changes(spark, "incidents", path)
    tables.record_incidents(states(spark, ("a", "open", 1, 1), ("b", "open", 1, 1), ("c", "open", 1, 1)), path)
    tables.record_incidents(states(spark, ("a", "resolved", 5, 9)), path)
    # An older state that comes late changes nothing; of equal times the larger row counts.
    tables.record_incidents(states(spark, ("a", "open", 3, 4), ("b", "open", 2, 1)), path)
    want = [("a", "resolved", 5), ("b", "open", 2), ("c", "open", 1)]
    assert seen(spark, path) == want
    held = tables.scan_incidents(spark, path)
    assert tables.compact_changes(spark, "incidents", path) and seen(spark, path) == want
    # After compaction a scan reads base files only, and shuffles nothing.
    after = tables.scan_incidents(spark, path)
    assert all("/base-" in f for f in after.inputFiles()) and "Exchange" not in plan_of(after)
    # A reader from before still finds its files.
    assert sorted((r.id, r.status, r.event_count) for r in held.collect()) == want
    tables.record_incidents(states(spark, ("c", "acknowledged", 4, 7), ("d", "open", 1, 8)), path)
    tables.record_incidents(states(spark, ("a", "open", 9, 2)), path)
    want = [("a", "resolved", 5), ("b", "open", 2), ("c", "acknowledged", 4), ("d", "open", 1)]
    assert seen(spark, path) == want
    assert tables.compact_changes(spark, "incidents", path) and seen(spark, path) == want
    assert latest.vacuum(spark, path) == 7 and seen(spark, path) == want and latest.snapshot(spark, path).number == 2
    assert latest.vacuum(spark, path) == 0


def test_changes_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "incidents")
    tables.record_incidents(states(spark, ("a", "open", 1, 1)), path)
    plain = latest._publish

    def busy(*args):
        # A change, and a whole compaction of somebody else's, arrive just before the snapshot.
        tables.record_incidents(states(spark, ("a", "resolved", 2, 2)), path)
        monkeypatch.setattr(latest, "_publish", plain)
        assert tables.compact_changes(spark, "incidents", path)
        return plain(*args)

    monkeypatch.setattr(latest, "_publish", busy)
    assert not tables.compact_changes(spark, "incidents", path)
    assert seen(spark, path) == [("a", "resolved", 2)] and latest.snapshot(spark, path).number == 1


def test_a_half_written_change_is_not_read(spark, tmp_path):
    path = str(tmp_path / "incidents")
    tables.record_incidents(states(spark, ("a", "open", 1, 1)), path)
    states(spark, ("a", "resolved", 2, 2)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/change-half")
    assert seen(spark, path) == [("a", "open", 1)]
