"""Table maintenance: file inventories, triggers, plans, expiry and orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86400


def inventory(files: DataFrame, by: list[str], small_below: int) -> DataFrame:
    """Counts of data files, small ones and their bytes, and delete files, from (content, bytes)."""
    data, small = F.col("content") == "data", (F.col("content") == "data") & (F.col("bytes") < small_below)
    return files.groupBy(*by).agg(
        F.count_if(data).alias("data_files"), F.count_if(small).alias("small_files"), F.coalesce(F.sum(F.when(small, F.col("bytes"))), F.lit(0)).cast("long").alias("small_bytes"),
        F.count_if(F.col("content") == "equality").alias("equality_deletes"), F.count_if(F.col("content") == "position").alias("position_deletes"),
    )


def workload(files: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """Files and bytes of a plan, with files counted once for each path."""
    each = files.groupBy(*by, path).agg(F.min("content").alias("content"), F.min("bytes").alias("bytes"))
    return each.groupBy(*by).agg(F.count_if(F.col("content") == "data").alias("files"), F.coalesce(F.sum(F.when(F.col("content") == "data", F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("content") != "data").alias("delete_files"))


def bin_pack(files: DataFrame, group: list[str], target: int = 128 << 20, smallest: int = 64 << 20, largest: float = 1.8, inputs: int = 10) -> DataFrame:
    """Files to be rewritten together: those of unfit size or with deletes, in order of size, each into the open bin or, if it is full, a new one, within a group.

    Adds ``bin``. A bin with fewer than ``inputs`` files and no deletes is left
    out. ``files`` has path, bytes and deletes. Each partition's sorted files
    go by once, with the bytes of the open bin alone held.
    """
    from .apply import split_rows

    unfit = files.where((F.col("bytes") < smallest) | (F.col("bytes") > F.lit(int(target * largest))) | (F.col("deletes") > 0))
    packed = split_rows(unfit, ["bytes", "path"], "bytes", 1 << 30, target, group).withColumnRenamed("chunk", "bin")
    size = W.partitionBy(*group, "bin")
    kept = packed.withColumn("_n", F.count("*").over(size)).withColumn("_d", F.max("deletes").over(size))
    return kept.where((F.col("_n") >= inputs) | (F.col("_d") > 0)).drop("_n", "_d")


def expired(versions: DataFrame, table: list[str], now: Column, retain: int = 10, max_age: int = 7 * DAY) -> DataFrame:
    """Versions that are old enough and not among the last ``retain``; ids are only compared for equality, order is by time."""
    rank = W.partitionBy(*table).orderBy(F.desc("at"), F.desc("version"))
    return versions.withColumn("_r", F.row_number().over(rank)).where((F.col("_r") > retain) & (F.col("at") < now - F.lit(max_age))).drop("_r")


def orphaned(listed: DataFrame, referenced: DataFrame, now: Column, min_age: int = 7 * DAY, path: str = "path") -> DataFrame:
    """Listed files, old enough, that nothing refers to."""
    return listed.where(F.col("modified") < now - F.lit(min_age)).join(referenced.select(path), path, "left_anti")


def check_orphan_age(hours: float, streaming: bool, dry_run: bool) -> None:
    """A table that is being written needs three days before its strange files may go."""
    if hours < 7 * 24 and not streaming:
        raise ValueError("files younger than 7 days are never orphans")
    if streaming and hours < 72 and not dry_run:
        raise ValueError("a table that is being written needs at least 72 hours")


def rollup(states: DataFrame) -> DataFrame:
    """One row for a set of tables: counters and the state that comes first."""
    n = lambda s: F.count_if(F.col("state") == s)
    agg = states.agg(*(n(s).alias(s) for s in ("running", "scanning", "error", "inventory_pending", "waiting_for_snapshot", "ready")), F.count("*").alias("tables"))
    state = F.when(F.col("running") > 0, "running").when(F.col("scanning") > 0, "scanning").when(F.col("error") > 0, "error").when((F.col("tables") > 0) & (F.col("waiting_for_snapshot") == F.col("tables")), "waiting_for_snapshot")
    state = state.when(F.col("inventory_pending") > 0, "inventory_pending").when(F.col("ready") > 0, "ready").otherwise("healthy")
    return agg.withColumn("state", state)


# Procedures that may be called, and the options of each.
PROCEDURES = {"rewrite_data_files": {"strategy", "sort_order", "where", "options"}, "rewrite_manifests": {"use_caching"}, "rewrite_position_delete_files": {"options"}, "expire_snapshots": {"older_than", "retain_last"}, "remove_orphan_files": {"older_than", "location", "dry_run"}}


def call_statement(catalog: str, procedure: str, table: str, options: dict) -> str:
    """CALL of an allowed procedure with its options sorted and written by type."""
    if procedure not in PROCEDURES:
        raise ValueError(f"{procedure} may not be called")
    if unknown := set(options) - PROCEDURES[procedure]:
        raise ValueError(f"{procedure} has no options {sorted(unknown)}")

    def literal(name: str, v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, dict):
            return "map(" + ", ".join(f"{literal('', k)}, {literal('', str(x))}" for k, x in sorted(v.items())) + ")"
        text = "'" + str(v).replace("'", "''") + "'"
        return f"TIMESTAMP {text}" if name == "older_than" else text

    given = [f"table => {literal('', table)}", *(f"{k} => {literal(k, v)}" for k, v in sorted(options.items()))]
    return f"CALL {catalog}.system.{procedure}({', '.join(given)})"
