"""Operational queries over durable state: queues, claims, summaries and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACTIVE = ("queued", "running", "retry")


def due_tables(state: DataFrame, monitors: DataFrame, tasks: DataFrame, now: Column, limit: int, owner: str = "owner", key: str = "table_key") -> DataFrame:
    """Tables that are due, have an active monitor and no open task; the longest due first."""
    active = monitors.where("status = 'active'").select(owner)
    open_ = tasks.where(F.col("status").isin(*ACTIVE)).select(key)
    return state.where(F.col("due") <= now).join(active, owner, "left_semi").join(open_, key, "left_anti").orderBy("due", key).limit(limit)


def claimable(tasks: DataFrame, state: DataFrame, now: Column, limit: int, key: str = "table_key") -> DataFrame:
    """Tasks whose time has come and whose table isn't leased; by priority, time and id."""
    free = state.where(F.col("lease_until").isNull() | (F.col("lease_until") < now)).select(key)
    ready = tasks.where(F.col("status").isin("queued", "retry") & (F.col("not_before") <= now))
    return ready.join(free, key).orderBy("priority", "not_before", "id").limit(limit)


def cancel_without_monitor(tasks: DataFrame, monitors: DataFrame, owner: str = "owner") -> DataFrame:
    """Open tasks of missing or inactive monitors are cancelled."""
    m = monitors.select(owner, F.col("status").alias("_monitor"))
    joined = tasks.join(m, owner, "left")
    gone = F.col("status").isin(*ACTIVE) & (F.coalesce("_monitor", F.lit("")) != "active")
    return joined.withColumn("status", F.when(gone, "cancelled").otherwise(F.col("status"))).drop("_monitor")


def recover_leases(tasks: DataFrame, now: Column) -> DataFrame:
    stale = (F.col("status") == "running") & (F.col("lease_until") < now)
    return tasks.withColumns({"status": F.when(stale, "retry").otherwise(F.col("status")), "lease_until": F.when(~stale, F.col("lease_until"))})


def latest(df: DataFrame, by: list[str], order: str = "id") -> DataFrame:
    """The last row of each group."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_l")).select(*by, "_l.*")


def queue_summary(tasks: DataFrame, now: Column, by: list[str] = ()) -> DataFrame:
    """Counts by status, the oldest waiting and its age, and tables whose last task of an operation failed."""
    waiting = F.col("status").isin("queued", "retry")
    n = lambda s: F.coalesce(F.count_if(F.col("status") == s), F.lit(0)).alias(s)
    counts = tasks.groupBy(*by).agg(F.count("*").alias("total"), n("queued"), n("running"), n("retry"), n("failed"), F.min(F.when(waiting, F.col("created_at"))).alias("oldest"))
    counts = counts.withColumn("oldest_age", F.greatest(F.coalesce(now - F.col("oldest"), F.lit(0)), F.lit(0)))
    failed = latest(tasks, [*by, "table_key", "operation"]).where("status = 'failed'").groupBy(*by).agg(F.countDistinct("table_key").alias("failed_tables"))
    out = counts.join(failed, list(by), "left") if by else counts.join(failed, F.lit(True), "left")
    return out.withColumn("failed_tables", F.coalesce("failed_tables", F.lit(0)))


def runs_page(runs: DataFrame, results: DataFrame, where: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of runs, the last first, with the results of each by status."""
    limit = min(200, max(1, limit))
    chosen = (runs.where(where) if where is not None else runs).orderBy(F.desc("id")).offset(offset).limit(limit)
    n = lambda s: F.count_if(F.col("result") == s).alias(s)
    counts = results.join(chosen.select(F.col("id").alias("run_id")), "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("tasks"), n("succeeded"), n("failed"), n("skipped"))
    return chosen.join(counts.withColumnRenamed("run_id", "id"), "id", "left").na.fill(0, ["tasks", "succeeded", "failed", "skipped"])


def upsert_state(state: DataFrame, new: DataFrame, key: str = "table_key") -> DataFrame:
    """Merge states: a snapshot once complete stays so, and a time that is set stays."""
    a, b = state.select(key, F.col("complete").alias("_c"), F.col("due").alias("_d")), new.select(key, F.col("complete").alias("_c2"), F.col("due").alias("_d2"))
    return a.join(b, key, "full").select(key, F.greatest(F.coalesce("_c", F.lit(False)), F.coalesce("_c2", F.lit(False))).alias("complete"), F.coalesce("_d", "_d2").alias("due"))


def first_owner(targets: DataFrame, key: str = "table_key", order: str = "id") -> DataFrame:
    """Of several owners of a table the first has it."""
    rank = W.partitionBy(key).orderBy(order)
    return targets.withColumn("_r", F.row_number().over(rank)).withColumn("conflict", F.col("_r") > 1).drop("_r")


def commit_signals(signals: DataFrame, state: DataFrame, key: str = "table_key") -> DataFrame:
    """Coalesce commits of a table: another id counts as new, counters add up, the due time only moves earlier."""
    s = signals.groupBy(key).agg(F.max_by("snapshot", "at").alias("snapshot"), F.sum("added").alias("added"), F.min("due").alias("_due"), F.max("at").alias("at"))
    old = state.select(key, F.col("snapshot").alias("_old"), F.col("due").alias("_was"))
    joined = s.join(old, key, "left")
    new = (F.col("snapshot") != 0) & ~F.col("snapshot").eqNullSafe(F.col("_old"))
    return joined.select(key, "snapshot", "added", new.alias("changed"), F.least("_due", "_was").alias("due"))


def instances(expected: DataFrame, seen: DataFrame, now: Column, alive: int = 60) -> DataFrame:
    """Online against expected instances of each role."""
    online = seen.where(F.col("at") >= now - alive).groupBy("role").agg(F.countDistinct("instance").alias("online"))
    return expected.join(online, "role", "left").withColumn("online", F.coalesce("online", F.lit(0)))


def filter_runs(runs: DataFrame, results: DataFrame, tasks: DataFrame, *, status: str | None = None, search: str | None = None, operation: str | None = None, owner=None) -> DataFrame:
    """Runs by status, by text in their worker or a table of theirs, by an operation among their tasks, and by owner."""
    each = results.join(tasks.select(F.col("id").alias("task_id"), "table_key", "operation", "owner"), "task_id")
    out = runs.where(F.col("status") == status) if status else runs
    if search:
        hit = each.where(F.lower(F.col("table_key").cast("string")).contains(search.lower())).select(F.col("run_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
        out = out.join(hit, "id", "left").where(F.col("_hit") | F.lower(F.col("worker").cast("string")).contains(search.lower())).drop("_hit")
    if operation:
        out = out.join(each.where(F.col("operation") == operation).select(F.col("run_id").alias("id")), "id", "left_semi")
    if owner is not None:
        out = out.join(each.where(F.col("owner") == owner).select(F.col("run_id").alias("id")), "id", "left_semi")
    return out


def latest_results(results: DataFrame) -> DataFrame:
    """One result for each attempt of a task: a later one replaces it."""
    rank = W.partitionBy("task_id", "attempt").orderBy(F.desc("id"))
    return results.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def snapshot_complete(states: DataFrame, snapshots: DataFrame, job: str = "job_id") -> DataFrame:
    """A job's snapshot is complete if it has none, if it says so, or if a snapshot-only job is done."""
    s = snapshots.select(job, F.col("done").alias("_done"))
    joined = states.join(s, job, "left")
    no_snapshot = F.col("mode").isin("latest", "latest-offset")
    alone = (F.col("mode") == "snapshot-only") & (F.col("status") == "DONE")
    return joined.withColumn("complete", F.coalesce(no_snapshot | F.coalesce("_done", alone), F.lit(False))).drop("_done")


def seed_states(targets: DataFrame, states: DataFrame, key: str = "table_key") -> DataFrame:
    """Targets that have no state yet; of several owners the first takes it."""
    return first_owner(targets, key).where(~F.col("conflict")).drop("conflict").join(states.select(key), key, "left_anti")


def health_alerts(samples: DataFrame, job: str, at: str, lag_threshold: int) -> DataFrame:
    """Alerts of a stream of (status, lag, waiting) samples: a purged log once an incident, which silences the lag; a lag that reaches the threshold; back-pressure that begins."""
    before = W.partitionBy(job).orderBy(at)
    purged, lagging, pressed = F.col("status") == "purged", (F.col("status") != "purged") & (F.col("lag") >= lag_threshold), F.col("waiting")
    begins = lambda c: c & ~F.coalesce(F.lag(c).over(before), F.lit(False))
    names = F.array_compact(F.array(F.when(begins(purged), F.lit("purged")), F.when(begins(lagging), F.lit("lag")), F.when(begins(pressed), F.lit("back_pressure"))))
    return samples.withColumn("_names", names).select(job, at, F.explode("_names").alias("alert"))


def checkpoint_diagnostics(checkpoints: DataFrame, first: Column, last: Column, now: Column) -> DataFrame:
    """Age of saved positions and whether their log files lie within the available ones."""
    return checkpoints.withColumns({"age": F.greatest(now - F.col("saved_at"), F.lit(0)), "available": F.col("file").between(first, last)})


def log_range(logs: DataFrame, name: str = "file") -> DataFrame:
    return logs.agg(F.min(name).alias("first"), F.max(name).alias("last"), F.count("*").alias("n"))


def check_load(expected: Column, total: Column, loaded: Column, filtered: Column, unselected: Column) -> Column:
    """Whether a load took all of its rows."""
    return (filtered == 0) & (unselected == 0) & (total == loaded) & (loaded == expected)


def control(jobs: DataFrame, action: str, now: Column, owner: str | None = None) -> DataFrame:
    """A change of the desired state, only where the current one allows it; an owner may only change what it leases."""
    allowed = {"pause": ("running",), "resume": ("paused",), "cancel": ("running", "paused", "queued"), "delete": ("paused", "cancelled", "failed", "done")}[action]
    to = {"pause": "paused", "resume": "running", "cancel": "cancelled", "delete": "deleted"}[action]
    may = F.col("state").isin(*allowed)
    if owner is not None:
        may = may & (F.col("lease_owner") == owner) & (F.col("lease_until") >= now)
    return jobs.withColumn("state", F.when(may, to).otherwise(F.col("state")))


def expand_targets(operations: list[str], namespaces: list[str], tables: list[str]) -> list[tuple[str, str, str]]:
    """Every operation on every table of every namespace, each once and in order."""
    return list(dict.fromkeys((o, n.strip(), t.strip()) for o in operations for n in namespaces for t in tables if n.strip() and t.strip()))


def claim_inventory(state: DataFrame, monitors: DataFrame, now: Column, least_priority: int = 0, limit: int = 1) -> DataFrame:
    """Tables to be scanned next: snapshot done, due, not leased, and with an active monitor if one owns them; by priority, the longest due first."""
    active = monitors.where("status = 'active'").select("owner", F.lit(True).alias("_active"))
    free = F.col("inventory_lease_until").isNull() | (F.col("inventory_lease_until") < now)
    ready = state.where(F.col("complete") & (F.col("next_inventory") <= now) & (F.col("inventory_priority") >= least_priority) & free)
    ready = ready.join(active, "owner", "left").where((F.col("owner_type") != "monitor") | F.col("_active")).drop("_active")
    return ready.orderBy(F.desc("inventory_priority"), "next_inventory", "table_key").limit(limit)


def finish_inventory(state: DataFrame, claimed: DataFrame, now: Column, retry_at: Column | None = None) -> DataFrame:
    """Give up the leases of (table_key, worker, snapshot): a table that was written meanwhile is due again at once, others aren't; ``retry_at`` for scans that failed."""
    c = claimed.select("table_key", F.col("worker").alias("inventory_lease_owner"), F.col("snapshot").alias("_seen"), F.lit(True).alias("_mine"))
    joined = state.join(c, ["table_key", "inventory_lease_owner"], "left")
    mine, written = F.coalesce("_mine", F.lit(False)), F.col("last_snapshot") != F.col("_seen")
    due = retry_at if retry_at is not None else F.when(written, now)
    priority = F.col("inventory_priority") if retry_at is not None else F.when(written, F.greatest("inventory_priority", F.lit(50))).otherwise(0)
    freed = {c: F.when(~mine, F.col(c)) for c in ("inventory_lease_owner", "inventory_lease_until")}
    changed = {"next_inventory": F.when(mine, due).otherwise(F.col("next_inventory")), "inventory_priority": F.when(mine, priority).otherwise(F.col("inventory_priority"))}
    return joined.withColumns(freed | changed).select(*state.columns)


def claim_jobs(jobs: DataFrame, role: str, now: Column, limit: int = 100) -> DataFrame:
    """Jobs that should run in a role and that nobody holds; those untouched longest first."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") < now)
    return jobs.where((F.col("role") == role) & (F.col("desired") == "running") & free).orderBy("updated_at", "job_id").limit(limit if limit > 0 else 100)


def enqueue(due: DataFrame, tasks: DataFrame, operation: str, priority: int, window: Column, now: Column) -> DataFrame:
    """New tasks of tables that are due: one for each table, operation and window, and none beside an open one."""
    from ..functions.scalars import idempotency_key

    key = idempotency_key(F.col("table_key").cast("string"), F.lit(operation), window.cast("string"))
    new = due.select("table_key", F.lit(operation).alias("operation"), F.lit(priority).alias("priority"), F.lit("queued").alias("status"), F.lit(0).alias("attempt"), now.alias("not_before"), key.alias("idempotency_key"))
    known = tasks.select("idempotency_key").where("idempotency_key IS NOT NULL")
    open_ = tasks.where((F.col("operation") == operation) & F.col("status").isin(*ACTIVE)).select("table_key")
    return new.join(known, "idempotency_key", "left_anti").join(open_, "table_key", "left_anti")


def finish_tasks(tasks: DataFrame, outcomes: DataFrame, now: Column, base: int, retry_limit: int) -> DataFrame:
    """Claimed tasks after their outcomes (id, result, retryable): succeeded and skipped end; what failed is tried again after a growing delay while attempts are left."""
    from ..functions.scalars import retry_delay

    joined = tasks.join(outcomes.select("id", "result", "retryable"), "id", "left")
    again = (F.col("result") == "failed") & F.coalesce("retryable", F.lit(False)) & (F.col("attempt") < retry_limit)
    status = F.when(F.col("result").isNull(), F.col("status")).when(again, "retry").otherwise(F.col("result"))
    later = F.when(again, now + retry_delay(F.lit(base), F.col("attempt"))).otherwise(F.col("not_before"))
    return joined.withColumns({"status": status, "not_before": later}).drop("result", "retryable")


def owned_results(results: DataFrame, tasks: DataFrame, run: int, owner, limit: int = 100) -> DataFrame:
    """Results of a run whose tasks belong to an owner, in order."""
    mine = tasks.where(F.col("owner") == owner).select(F.col("id").alias("task_id"))
    return results.where(F.col("run_id") == run).join(mine, "task_id", "left_semi").orderBy("id").limit(limit if 0 < limit <= 500 else 100)


def owned_states(state: DataFrame, owner, limit: int = 5000) -> DataFrame:
    return state.where(F.col("owner") == owner).orderBy("namespace", "table_name").limit(limit if 0 < limit <= 5000 else 5000)


def run_totals(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs that each owner has a part in, for pages."""
    return results.join(tasks.select(F.col("id").alias("task_id"), "owner"), "task_id").groupBy("owner").agg(F.countDistinct("run_id").alias("runs"))


def missing_tables(requested: DataFrame, state: DataFrame, key: str = "table_key") -> DataFrame:
    return requested.select(key).distinct().join(state.select(key), key, "left_anti")


def fan_in(sources: DataFrame, target: str = "target") -> DataFrame:
    """Sources by the name of their target, told apart without regard to case and outer space; more than one feed it where ``shared``."""
    name = F.lower(F.trim(F.col(target)))
    return sources.groupBy(name.alias("target")).agg(F.count("*").alias("sources"), F.min("name").alias("first_source")).withColumn("shared", F.col("sources") > 1)


def pending_batches(waiting: DataFrame, by: list[str], now: Column, *, rows: int = 200, size: int = 128 << 20, oldest: int = 30, idle: int = 30) -> DataFrame:
    """Changes that wait, (size, at) by table: how many, how large, since when, and whether they are to be written now."""
    each = waiting.groupBy(*by).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return each.withColumn("due", (F.col("n") >= rows) | (F.col("size") >= size) | (now - F.col("first_at") >= oldest) | (now - F.col("last_at") >= idle))
