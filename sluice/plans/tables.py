"""Queries that go through a versioned table in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import changes as ch
from ..operators.table import VersionedTable
from ..streaming.apply import apply_stream, read_changes
from .queries import FEED, feed, query, t


def scratch(spark) -> str:
    """A new folder that driver and executors share: below the one named in spark.checkpoint.dir."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        import tempfile

        base = tempfile.mkdtemp(prefix="tables-")
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


LIVE = f"SELECT k, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS n FROM ({FEED})) WHERE n = 1 AND op <> 'DELETE'"


@query(f"""
    WITH f AS ({FEED}), l AS ({LIVE})
    SELECT c_custkey AS k, CAST(-1 AS BIGINT) AS pos, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT k FROM f) UNION ALL SELECT * FROM l""")
def equality_delta_read(spark, sf_dir):
    """A table, and the feed over it as three deltas of keys and rows, merged when read."""
    table = VersionedTable(spark, scratch(spark))
    table.overwrite(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("pos"), F.col("c_acctbal").alias("value")))
    f = feed(spark, sf_dir)
    for i, part in enumerate(("pos < 200", "pos BETWEEN 200 AND 500", "pos > 500")):
        own = f.where(part)
        table.commit_delta(ch.delete_keys(own, ["k"]).select("k"), ch.live_rows(own, ["k"]).select("k", "pos", "value"), ["k"], batch=i)
    return table.read()


@query("""
    WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS part, o_totalprice AS value FROM orders),
    m AS (SELECT k, part AS old_part, CASE part WHEN 'O' THEN 'F' ELSE 'P' END AS part, value + 1 AS value FROM b WHERE k % 3 = 0)
    SELECT k, part, value FROM b WHERE k % 3 <> 0 AND NOT (k % 5 = 0 AND part = 'F') UNION ALL SELECT k, part, value FROM m""")
def equality_delta_partitions(spark, sf_dir):
    """Rows move between partitions: a key is deleted in the partitions it is listed with, and there alone."""
    table = VersionedTable(spark, scratch(spark))
    base = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("part"), F.col("o_totalprice").alias("value"))
    table.overwrite(base)
    moved = base.where("k % 3 = 0")
    new = moved.select("k", F.when(F.col("part") == "O", "F").otherwise("P").alias("part"), (F.col("value") + 1).alias("value"))
    table.commit_delta(moved.select("k", "part"), new, ["k"], by=("part",))
    # a delete of keys in one partition leaves rows of the same keys elsewhere
    table.commit_delta(base.where("k % 5 = 0 AND k % 3 <> 0").select("k", F.lit("F").alias("part")), base.limit(0), ["k"], by=("part",))
    return table.read()


@query("""
    SELECT 0 AS version, 'overwrite' AS operation, (SELECT count(*) FROM customer) AS n_rows, 0 AS n_deleted UNION ALL SELECT 1, 'delete-append', (SELECT count(*) FROM customer) + 2, 5 UNION ALL
    SELECT 2, 'delete', (SELECT count(*) FROM customer) + 2, 3 UNION ALL SELECT 3, 'replace', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (1, 2, 3, 4, 5, 6, 7, 8)) + 2, 0""")
def delta_versions(spark, sf_dir):
    """What the versions say of themselves: rows count as in the data files, without what deletes hide, until these are written out."""
    table = VersionedTable(spark, scratch(spark))
    base = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    table.overwrite(base)
    table.commit_delta(base.where("k BETWEEN 1 AND 5").select("k"), base.where("k BETWEEN 1 AND 2"), ["k"])
    table.commit_delta(base.where("k BETWEEN 6 AND 8").select("k"), base.limit(0), ["k"])
    table.compact()
    return spark.createDataFrame([(v.number, v.operation, v.rows, int(v.summary.get("deleted_keys", 0))) for v in table.versions()], "version int, operation string, n_rows long, n_deleted int")


@query(LIVE)
def stream_apply(spark, sf_dir):
    """The feed in two files, the older first, streamed into a versioned table as two micro-batches."""
    root, f = scratch(spark), feed(spark, sf_dir)
    for part in ("pos <= 500", "pos > 500"):
        f.where(part).coalesce(1).write.mode("append").parquet(f"{root}/changes")
    table = VersionedTable(spark, f"{root}/table")
    apply_stream(read_changes(spark, f"{root}/changes", f.schema, 1), table, f"{root}/offsets", ["k"], ["k", "pos", "value"]).awaitTermination()
    return table.read()
