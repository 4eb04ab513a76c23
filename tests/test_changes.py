import random

import pytest
from pyspark.errors import PySparkException

from sluice.operators.apply import apply_delta, check_resume, operation_name, replace_where
from sluice.operators.changes import changed_columns, decode_rows, delete_keys, live_rows, merge_rows, partition_groups, require_keys, touches
from pyspark.sql import functions as F

FEED = "pos long, op string, old_k long, k long, v string"


def feed(spark, rows):
    return spark.createDataFrame(rows, FEED)


def test_collapse_of_insert_update_delete(spark):
    f = feed(spark, [(1, "INSERT", None, 10, "NEW"), (2, "UPDATE", 10, 10, "PAID"), (3, "DELETE", None, 20, None)])
    assert [tuple(r) for r in live_rows(f, ["k"]).select("k", "v").collect()] == [(10, "PAID")]
    assert sorted(r["k"] for r in delete_keys(f, ["k"]).collect()) == [10, 20]


def test_inserts_delete_their_keys_and_key_change_leaves_no_old_row(spark):
    f = feed(spark, [(1, "INSERT", None, 1, "a"), (2, "UPDATE", 1, 2, "b")])
    assert [tuple(r) for r in live_rows(f, ["k"]).select("k", "v").collect()] == [(2, "b")]
    # literal rule: the new key of an update is not deleted, the key of an insert is; here 1 by insert and as old key, 2 only as upsert
    assert sorted(r["k"] for r in delete_keys(f, ["k"]).collect()) == [1]
    assert sorted(r["k"] for r in merge_rows(f, ["k"]).collect()) == [1, 2]


def test_empty_feed_and_null_keys(spark):
    empty = feed(spark, [])
    assert live_rows(empty, ["k"]).count() == delete_keys(empty, ["k"]).count() == 0
    with pytest.raises(PySparkException):
        require_keys(feed(spark, [(1, "INSERT", None, None, "x")]), ["k"]).collect()
    with pytest.raises(ValueError):
        require_keys(empty, ["other"])


def test_a_key_that_moved_is_in_every_partition_it_was_in(spark):
    images = spark.createDataFrame([(10, "2026-06-08"), (10, "2026-06-09"), (10, "2026-06-08")], "k long, d string")
    assert sorted(tuple(r) for r in partition_groups(images, ["k"], F.col("d")).collect()) == [("2026-06-08", 10), ("2026-06-09", 10)]


def test_row_events(spark):
    e = spark.createDataFrame([("UPDATE", [(1, "a"), (1, "b"), (2, "c"), (2, "d")]), ("DELETE", [(3, "e")]), ("INSERT", [(4, "f"), (5, "g")]), ("INSERT", [])], "op string, rows array<struct<id long, v string>>")
    got = sorted((r["op"], r["row"], r["before"] and r["before"]["v"], r["after"] and r["after"]["v"]) for r in decode_rows(e).collect())
    assert got == [("DELETE", 0, "e", None), ("INSERT", 0, None, "f"), ("INSERT", 1, None, "g"), ("UPDATE", 0, "a", "b"), ("UPDATE", 1, "c", "d")]
    with pytest.raises(PySparkException):
        decode_rows(spark.createDataFrame([("UPDATE", [(1, "a")])], "op string, rows array<struct<id long, v string>>")).collect()


def test_changed_columns(spark):
    names = [f"c{i}" for i in range(10)]
    same = spark.createDataFrame([[None] * 20], ", ".join(f"{n} int, old_{n} int" for n in names))
    assert same.select(changed_columns(names)).first()[0] == "-"
    more = spark.createDataFrame([[1, 2] * 10], ", ".join(f"{n} int, old_{n} int" for n in names))
    assert more.select(changed_columns(names)).first()[0] == ",".join(names[:8]) + ",..."


def test_any_split_and_any_replay_give_the_same_table(spark):
    """Changes are made from a table that keeps its keys unique; batches are cut anywhere and some are applied again."""
    rng = random.Random(11)
    for _ in range(4):
        have, rows = {}, []
        for pos in range(30):
            op = rng.choice(("INSERT", "UPDATE", "DELETE"))
            free, held = [k for k in range(8) if k not in have], sorted(have)
            if op == "INSERT" and free:
                k = rng.choice(free)
                have[k] = str(pos)
                rows.append((pos, op, None, k, str(pos)))
            elif op == "UPDATE" and held:
                old = rng.choice(held)
                k = rng.choice([old, *free])
                del have[old]
                have[k] = str(pos)
                rows.append((pos, op, old, k, str(pos)))
            elif op == "DELETE" and held:
                k = rng.choice(held)
                del have[k]
                rows.append((pos, op, None, k, None))
        cut = sorted(rng.sample(range(len(rows) + 1), 2))
        batches = [rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :]]
        again = rng.randrange(3)
        order = [*range(again + 1), *range(again, 3)]  # one batch runs twice
        target = spark.createDataFrame([], "k long, v string")
        for i in order:
            f = feed(spark, batches[i])
            out = apply_delta(target, delete_keys(f, ["k"]), live_rows(f, ["k"]), ["k"]).collect()
            target = spark.createDataFrame(out, "k long, v string")
        assert {r["k"]: r["v"] for r in target.collect()} == have


def test_modes(spark):
    assert [operation_name(*x) for x in ((0, 0), (0, 1), (1, 0), (1, 1))] == ["noop", "append", "delete", "delete-append"]
    target = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k int, v int")
    got = replace_where(target, F.col("v") > 6, spark.createDataFrame([(4, 1)], "k int, v int"))
    assert sorted(r["k"] for r in got.collect()) == [1, 2, 4]
    with pytest.raises(ValueError):
        check_resume("truncate-append", 10, False)
    check_resume("truncate-append", 10, True)
    assert touches(feed(spark, [(1, "DELETE", None, 1, "x")]), ["k"]).count() == 1
