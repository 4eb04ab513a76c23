import os
from datetime import datetime

import pytest

from sluice.operators import maintenance as mt
from sluice.operators.table import CommitConflict, VersionedTable
from sluice.plans import queries as plans
from sluice.sources import snapshot as sn
from sluice.sources.connectors import SINKS, SOURCES
from sluice.streaming.apply import FlushPolicy, apply_stream, handoff, read_changes


def test_pages_cover_the_table_once_and_resume(spark):
    df = spark.createDataFrame([(t, i, "x") for t in (7, 8) for i in range(25)], "tenant_id int, id int, v string")
    plan = sn.plan_snapshot(df, ["TENANT_ID", "id"])
    progress, seen = sn.Progress("t"), []
    for n, rows in enumerate(sn.pages(df, plan, 10, progress)):
        seen += [(r["tenant_id"], r["id"]) for r in rows.collect()]
        if n == 1:
            saved = progress.cursor
    assert seen == sorted(seen) and len(seen) == 50 == len(set(seen))
    assert sn.restore_cursor(plan, saved)["tenant_id"] in (7, 8)
    assert sn.restore_cursor(plan, "") is None and sn.restore_cursor(plan, '{"other": {"kind": "null"}}') is None
    with pytest.raises(ValueError):
        sn.after(("id",), {"tenant_id": 1})
    with pytest.raises(ValueError):
        sn.plan_snapshot(df, ["nope"])


def test_keyset_filter_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = sn.page(df, sn.plan_snapshot(df, ["o_orderkey"]), 5, {"o_orderkey": 10})._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(o_orderkey,10)" in text


def test_cursor_round_trip():
    c = {"a": None, "b": 5, "c": 1 << 63, "d": 1.5, "e": True, "f": datetime(2024, 1, 2, 3, 4, 5, 6), "g": "x"}
    assert sn.decode_cursor(sn.encode_cursor(c)) == c
    with pytest.raises(ValueError):
        sn.decode_cursor(" ")


def test_resume_and_modes():
    assert sn.resume_from(["a", "b", "c"], sn.Progress("b", 5, "x")) == [("b", "x"), ("c", None)]
    assert sn.resume_from(["a"], sn.Progress("gone")) == [("a", None)] and sn.resume_from(["a"], sn.Progress(done=True)) == []
    assert sn.run_mode("initial", False, False, False) == ["capture-offset", "snapshot", "changes:captured"] and sn.run_mode("latest", True, False, False) == ["changes:saved"]


def test_versions_batches_conflicts_and_expiry(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *ks: spark.createDataFrame([(k, str(k)) for k in ks], "k long, v string")
    table.overwrite(rows(1, 2))
    table.append(rows(3))
    v = table.apply(rows(1), rows(2, 9), ["k"], batch=4)
    assert table.apply(rows(3), rows(), ["k"], batch=4) == v  # a batch that runs again
    assert sorted(r["k"] for r in table.read().collect()) == [2, 3, 9] and table.metadata_rows() == 3
    assert sorted(r["k"] for r in table.read(0).collect()) == [1, 2]
    with pytest.raises(CommitConflict):
        table._commit(table.versions()[0], [], rows().schema, 0, "x", None, {})
    table.compact()
    assert table.read().count() == 3 and all(p.endswith(".json") for p in os.listdir(tmp_path / "t/versions") if not p.startswith("."))
    assert table.expire(older_than_s=0, retain=2, now=table.current().at + 10) == [0, 1]
    gone = table.orphans(min_age_s=0, now=table.current().at + 10, dry_run=False)
    assert gone and table.read().count() == 3 and table.orphans(min_age_s=0, now=table.current().at + 10) == []
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "none")).read()


def test_of_two_writers_neither_loses_rows(spark, tmp_path):
    """A writer that began from a version that is no longer the newest fails if it replaces rows, and comes after the other if it only adds."""
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    rows = lambda *ks: spark.createDataFrame([(k, str(k)) for k in ks], "k long, v string")
    keys = lambda: sorted(r["k"] for r in one.read().collect())
    one.overwrite(rows(1, 2))
    write, meanwhile = one._write, [lambda: two.append(rows(100))]

    def slow(df, by=()):
        out = write(df, by)
        while meanwhile:
            meanwhile.pop()()
        return out

    one._write = slow
    for attempt in (lambda: one.apply(rows(1), rows(7), ["k"]), lambda: one.commit_delta(rows(1), rows(7), ["k"]), one.compact):
        before = keys()
        meanwhile.append(lambda: two.append(rows(100)))
        with pytest.raises(CommitConflict):
            attempt()
        assert keys() == sorted([*before, *[100] * (len(keys()) - len(before))]) and len(keys()) > len(before)
    meanwhile.append(lambda: two.append(rows(200)))
    one.append(rows(300))
    assert {1, 2, 100, 200, 300} == set(keys())


def test_deltas_are_merged_when_read(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *ks: spark.createDataFrame([(k, p) for k, p in ks], "k long, part string")
    table.commit_delta(rows(), rows((1, "a"), (2, "a"), (None, "a")), ["k"], batch=0)
    v = table.commit_delta(rows((1, "a")), rows((2, "b")), ["k"], batch=1)
    assert table.commit_delta(rows((9, "a")), rows((9, "b")), ["k"], batch=1) == v and (v.operation, v.rows) == ("delete-append", 4)
    assert sorted(map(str, (tuple(r) for r in table.read().collect()))) == ["(2, 'b')", "(None, 'a')"]
    assert table.commit_delta(rows((None, "a")), rows(), ["k"]).operation == "delete" and table.read().count() == 1 and table.read(1).count() == 2
    # a key goes in the partitions that it is listed with
    table.append(rows((2, "c")))
    table.commit_delta(rows((2, "b")), rows((5, None)), ["k"], by=("part",))
    assert sorted(map(str, (tuple(r) for r in table.read().collect()))) == ["(2, 'c')", "(5, None)"]
    assert table.orphans(min_age_s=0, now=table.current().at + 10) == []
    table.compact()
    assert table.current().deletes == [] and table.metadata_rows() == 2 == table.read().count()


def test_stream_goes_on_from_its_checkpoint_and_handoff_heals(spark, tmp_path, sf_dir):
    f = plans.feed(spark, sf_dir).limit(400)
    parts = [f.where("pos % 2 = 0 AND pos < 200"), f.where("pos >= 200")]
    changes, table = str(tmp_path / "changes"), VersionedTable(spark, str(tmp_path / "table"))
    parts[0].write.parquet(changes)
    snapshot = parts[0].where("op <> 'DELETE'").dropDuplicates(["k"]).select("k", "pos", "value")
    handoff(snapshot, read_changes(spark, changes, f.schema), table, str(tmp_path / "cp"), ["k"], ["k", "pos", "value"]).awaitTermination()
    parts[1].write.mode("append").parquet(changes)
    apply_stream(read_changes(spark, changes, f.schema), table, str(tmp_path / "cp"), ["k"], ["k", "pos", "value"]).awaitTermination()
    from sluice.operators.changes import live_rows

    want = {(r["k"], r["pos"]) for r in live_rows(parts[0].unionByName(parts[1]), ["k"]).collect()}
    assert {(r["k"], r["pos"]) for r in table.read().collect()} == want


def test_flush_policy():
    p = FlushPolicy()
    assert p.due(200, 0, 0, 0) and p.due(1, 128 << 20, 0, 0) and p.due(1, 1, 30, 0) and not p.due(1, 1, 29, 29) and p.due(1, 1, 10, 0, True) and not p.due(0, 0, 99, 99)


def test_maintenance_plans(spark):
    with pytest.raises(ValueError):
        mt.check_orphan_age(24, False, False)
    with pytest.raises(ValueError):
        mt.check_orphan_age(48, True, False)
    mt.check_orphan_age(48, True, True)
    assert mt.call_statement("c", "expire_snapshots", "n.t", {"retain_last": 5, "older_than": "2024-01-01"}) == "CALL c.system.expire_snapshots(table => 'n.t', older_than => TIMESTAMP '2024-01-01', retain_last => 5)"
    with pytest.raises(ValueError):
        mt.call_statement("c", "drop_table", "t", {})
    states = spark.createDataFrame([("ready",), ("scanning",)], "state string")
    assert mt.rollup(states).first()["state"] == "scanning"
    assert {"parquet", "jdbc"} <= set(SOURCES) and "table" in SINKS
