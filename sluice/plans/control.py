"""Queries of the control side: claims, tasks, owners, corrections and barriers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import apply as ap
from ..operators import changes as ch
from ..operators import ops
from .queries import FEED, feed, query, t

STATE = """SELECT c_custkey AS table_key, c_nationkey AS owner, CASE WHEN c_custkey % 4 = 0 THEN 'monitor' ELSE 'job' END AS owner_type, c_custkey % 5 <> 0 AS complete,
    c_custkey % 97 AS next_inventory, CAST(c_custkey % 3 * 50 AS INT) AS inventory_priority, CASE WHEN c_custkey % 6 = 0 THEN 'w1' END AS inventory_lease_owner,
    CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 130 END AS inventory_lease_until, c_custkey % 11 AS last_snapshot, c_mktsegment AS namespace, c_name AS table_name FROM customer"""
MONITORS = "SELECT n_nationkey AS owner, CASE WHEN n_regionkey % 2 = 0 THEN 'active' ELSE 'paused' END AS status FROM nation"
TASKS = """SELECT o_orderkey AS id, o_custkey AS table_key, o_custkey % 25 AS owner, CASE WHEN o_orderkey % 2 = 0 THEN 'compact' ELSE 'expire_snapshots' END AS operation,
    CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'failed' ELSE 'running' END AS status, CAST(o_orderkey % 7 AS INT) AS attempt, o_orderkey % 50 AS not_before FROM orders"""
RESULTS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS run_id, l_orderkey AS task_id FROM lineitem"


def view(spark, sf_dir, text: str, name: str):
    return spark.sql(text.replace(f"FROM {name}", "FROM {src}"), src=t(spark, sf_dir, name))


def state(spark, sf_dir):
    return view(spark, sf_dir, STATE, "customer")


def monitors(spark, sf_dir):
    return view(spark, sf_dir, MONITORS, "nation")


def tasks(spark, sf_dir):
    return view(spark, sf_dir, TASKS, "orders")


def results(spark, sf_dir):
    return view(spark, sf_dir, RESULTS, "lineitem").distinct()


@query(f"""
    WITH s AS ({STATE}), m AS ({MONITORS})
    SELECT table_key, inventory_priority, next_inventory FROM s WHERE complete AND next_inventory <= 90 AND inventory_priority >= 0 AND (inventory_lease_until IS NULL OR inventory_lease_until < 90)
      AND (owner_type <> 'monitor' OR EXISTS (SELECT 1 FROM m WHERE m.owner = s.owner AND m.status = 'active'))
    ORDER BY inventory_priority DESC, next_inventory, table_key LIMIT 25""")
def inventory_claim(spark, sf_dir):
    return ops.claim_inventory(state(spark, sf_dir), monitors(spark, sf_dir), F.lit(90), 0, 25).select("table_key", "inventory_priority", "next_inventory")


@query(f"""
    WITH s AS ({STATE})
    SELECT table_key, CASE WHEN inventory_lease_owner = 'w1' AND table_key % 12 = 0 THEN CASE WHEN last_snapshot <> 3 THEN 500 END ELSE next_inventory END AS next_inventory,
      CASE WHEN inventory_lease_owner = 'w1' AND table_key % 12 = 0 THEN CASE WHEN last_snapshot <> 3 THEN greatest(inventory_priority, 50) ELSE 0 END ELSE inventory_priority END AS inventory_priority,
      CASE WHEN inventory_lease_owner = 'w1' AND table_key % 12 = 0 THEN NULL ELSE inventory_lease_until END AS inventory_lease_until FROM s""")
def inventory_finish(spark, sf_dir):
    claimed = state(spark, sf_dir).where("table_key % 12 = 0").select("table_key", F.lit("w1").alias("worker"), F.lit(3).alias("snapshot"))
    return ops.finish_inventory(state(spark, sf_dir), claimed, F.lit(500)).select("table_key", "next_inventory", "inventory_priority", "inventory_lease_until")


JOBS = "SELECT s_suppkey AS job_id, CASE WHEN s_nationkey % 2 = 0 THEN 'snapshot' ELSE 'streaming' END AS role, CASE WHEN s_suppkey % 3 = 0 THEN 'paused' ELSE 'running' END AS desired, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 100 END AS lease_until, s_nationkey AS updated_at FROM supplier"


@query(f"SELECT job_id, updated_at FROM ({JOBS}) WHERE role = 'streaming' AND desired = 'running' AND (lease_until IS NULL OR lease_until < 50) ORDER BY updated_at, job_id LIMIT 20")
def job_claim(spark, sf_dir):
    return ops.claim_jobs(view(spark, sf_dir, JOBS, "supplier"), "streaming", F.lit(50), 20).select("job_id", "updated_at")


@query(f"""
    WITH s AS ({STATE}), k AS ({TASKS})
    SELECT table_key, 'compact' AS operation, 10 AS priority, 'queued' AS status, sha256(table_key || '|compact|' || next_inventory) AS idempotency_key FROM s
    WHERE complete AND next_inventory <= 40 AND NOT EXISTS (SELECT 1 FROM k WHERE k.table_key = s.table_key AND operation = 'compact' AND status IN ('queued', 'running', 'retry')) AND table_key % 9 <> 0""")
def enqueue_due(spark, sf_dir):
    due = state(spark, sf_dir).where("complete AND next_inventory <= 40")
    known = due.where("table_key % 9 = 0").select(s.idempotency_key(F.col("table_key").cast("string"), F.lit("compact"), F.col("next_inventory").cast("string")).alias("idempotency_key"), F.lit(None).cast("long").alias("table_key"), F.lit("compact").alias("operation"), F.lit("done").alias("status"))
    all_tasks = tasks(spark, sf_dir).withColumn("idempotency_key", F.lit(None).cast("string")).select(*known.columns).unionByName(known)
    return ops.enqueue(due, all_tasks, "compact", 10, F.col("next_inventory"), F.lit(0)).select("table_key", "operation", "priority", "status", "idempotency_key")


@query(f"""
    WITH k AS ({TASKS}), o AS (SELECT id, CASE id % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'skipped' ELSE 'failed' END AS result, id % 4 = 2 AS retryable FROM k WHERE status = 'running')
    SELECT k.id, CASE WHEN o.id IS NULL THEN status WHEN result = 'failed' AND retryable AND attempt < 5 THEN 'retry' ELSE result END AS status,
      CASE WHEN result = 'failed' AND retryable AND attempt < 5 THEN 1000 + 60 * CAST(2 ** least(greatest(attempt - 1, 0), 6) AS BIGINT) ELSE not_before END AS not_before FROM k LEFT JOIN o USING (id)""")
def task_outcomes(spark, sf_dir):
    k = tasks(spark, sf_dir)
    outcomes = k.where("status = 'running'").select("id", F.expr("CASE id % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'skipped' ELSE 'failed' END").alias("result"), (F.col("id") % 4 == 2).alias("retryable"))
    return ops.finish_tasks(k, outcomes, F.lit(1000), 60, 5).select("id", "status", "not_before")


@query(f"WITH r AS (SELECT DISTINCT * FROM ({RESULTS})), k AS ({TASKS}) SELECT r.id, r.task_id FROM r JOIN k ON k.id = r.task_id WHERE run_id = 3 AND owner = 7 ORDER BY r.id LIMIT 100")
def owner_results(spark, sf_dir):
    return ops.owned_results(results(spark, sf_dir), tasks(spark, sf_dir), 3, 7).select("id", "task_id")


@query(f"SELECT table_key, namespace, table_name FROM ({STATE}) WHERE owner = 7 ORDER BY namespace, table_name LIMIT 5000")
def owner_states(spark, sf_dir):
    return ops.owned_states(state(spark, sf_dir), 7).select("table_key", "namespace", "table_name")


@query(f"WITH r AS ({RESULTS}), k AS ({TASKS}) SELECT owner, count(DISTINCT run_id) AS runs FROM r JOIN k ON k.id = r.task_id GROUP BY owner")
def owner_run_totals(spark, sf_dir):
    return ops.run_totals(results(spark, sf_dir), tasks(spark, sf_dir))


@query("SELECT DISTINCT o_custkey + 50 AS table_key FROM orders WHERE o_custkey + 50 NOT IN (SELECT c_custkey FROM customer)")
def missing_requested(spark, sf_dir):
    return ops.missing_tables(t(spark, sf_dir, "orders").select((F.col("o_custkey") + 50).alias("table_key")), state(spark, sf_dir))


@query("SELECT lower(trim(' ' || p_brand || ' ')) AS target, count(*) AS sources, min(p_name) AS first_source, count(*) > 1 AS shared FROM part GROUP BY 1")
def fan_in_targets(spark, sf_dir):
    return ops.fan_in(t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("target")))


@query(f"""
    WITH f AS (SELECT *, 't' || k % 5 AS table_name FROM ({FEED})), r AS (SELECT *, row_number() OVER (PARTITION BY table_name, k ORDER BY pos DESC) AS n FROM f)
    SELECT table_name, k, pos, value FROM r WHERE n = 1 AND op <> 'DELETE'""")
def correct_tables(spark, sf_dir):
    events = feed(spark, sf_dir).withColumn("table_name", F.expr("'t' || k % 5"))
    return ch.reduce_tables(events, ["k"]).select("table_name", "k", "pos", "value")


DDL_AT = "SELECT * FROM (VALUES ('t0', 100), ('t0', 400), ('t2', 250), ('t3', 0), ('t9', 5)) AS d(table_name, pos)"


@query(f"""
    WITH f AS (SELECT *, 't' || k % 5 AS table_name FROM ({FEED})), d AS ({DDL_AT}),
    e AS (SELECT f.*, CAST((SELECT count(*) FROM d WHERE d.table_name = f.table_name AND d.pos < f.pos) AS INT) AS epoch FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY table_name, epoch, k ORDER BY pos DESC) AS n FROM e)
    SELECT table_name, epoch, k, pos, value FROM r WHERE n = 1 AND op <> 'DELETE'""")
def ddl_barriers(spark, sf_dir):
    events = feed(spark, sf_dir).withColumn("table_name", F.expr("'t' || k % 5"))
    parted = ch.ddl_epochs(events, spark.sql(DDL_AT))
    return ch.live_rows(parted, ["table_name", "epoch", "k"]).select("table_name", "epoch", "k", "pos", "value")


@query(f"""
    WITH f AS ({FEED}), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS n FROM f), l AS (SELECT k, pos, value, ts FROM r WHERE n = 1 AND op <> 'DELETE'),
    e AS (SELECT c_custkey AS k, c_acctbal AS old_balance, TIMESTAMP '2020-01-01 00:00:00' AS created_at FROM customer WHERE c_custkey % 2 = 0)
    SELECT k, pos, value, e.created_at, ts AS updated_at FROM l LEFT JOIN e USING (k) WHERE value > 1""")
def reduce_enrich(spark, sf_dir):
    """Reduced, given what the target has for the key, and filtered."""
    live = ch.live_rows(feed(spark, sf_dir), ["k"])
    old = t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.expr("TIMESTAMP_NTZ '2020-01-01'").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    out = ap.with_metadata(live, old, ["k"], loaded_at=F.lit(None).cast("timestamp_ntz"), event_time=F.col("ts"))
    return out.where("value > 1").select("k", "pos", "value", "created_at", "updated_at")


@query(f"""
    WITH f AS ({FEED}), p AS (SELECT k, pos, CASE WHEN op = 'INSERT' THEN NULL ELSE 'v' || pos END AS image FROM f WHERE op <> 'INSERT')
    SELECT k, string_agg(image, ',' ORDER BY pos) AS images, max_by(image, pos) AS last_image FROM p GROUP BY k""")
def delete_images(spark, sf_dir):
    out = ch.delete_images(feed(spark, sf_dir).where("op <> 'INSERT'"), ["k"], F.concat(F.lit("v"), F.col("pos")))
    return out.select("k", F.concat_ws(",", "images").alias("images"), "last_image")


@query("""
    WITH p AS (SELECT user_id % 9 AS k, count(*) AS n, CAST(sum(64 + length(props)) AS BIGINT) AS size, min(event_id) AS first_at, max(event_id) AS last_at FROM events WHERE event_id % 3 = 0 GROUP BY 1)
    SELECT k, n, size, (n >= 30 OR size >= 4000 OR 1000 - first_at >= 990 OR 1000 - last_at >= 20) AS due FROM p""")
def flush_due(spark, sf_dir):
    """Which tables' waiting changes are to be written now."""
    waiting = t(spark, sf_dir, "events").where("event_id % 3 = 0").select((F.col("user_id") % 9).alias("k"), (F.length("props") + 64).cast("long").alias("size"), F.col("event_id").alias("at"))
    return ops.pending_batches(waiting, ["k"], F.lit(1000), rows=30, size=4000, oldest=990, idle=20).select("k", "n", "size", "due")
