"""Deltas and snapshots applied to a target, and what they are written with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of comparisons.
COMPARISONS = {"=": "=", "==": "=", "eq": "=", "!=": "!=", "<>": "!=", "ne": "!=", "neq": "!=", ">": ">", "gt": ">", ">=": ">=", "gte": ">=", "gteq": ">=", "<": "<", "lt": "<", "<=": "<=", "lte": "<=", "lteq": "<="}


def on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, (left[k].eqNullSafe(right[k]) for k in keys))


def without_keys(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The target without the keys listed; a null key matches a null key."""
    gone = gone.select(*(F.col(k).alias(f"_gone_{k}") for k in keys))
    return target.join(gone, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys)), "left_anti")


def apply_delta(target: DataFrame, deletes: DataFrame, upserts: DataFrame, keys: list[str]) -> DataFrame:
    """target - (deleted keys and keys of upserts) + upserts.

    The upserts' own keys go too, so that a batch replayed over a target that
    already has some of it gives the same rows.
    """
    gone = deletes.select(*keys).unionByName(upserts.select(*keys)).distinct()
    return without_keys(target, gone, keys).unionByName(upserts.select(*target.columns))


def operation_name(deletes: int, rows: int) -> str:
    return {(False, False): "noop", (False, True): "append", (True, False): "delete", (True, True): "delete-append"}[(deletes > 0, rows > 0)]


def comparison(column: str, op: str, value, kind: str) -> Column:
    op = COMPARISONS.get(op.strip().lower())
    if op is None:
        raise ValueError("unknown comparison")
    c, v = F.col(column), F.lit(value).cast(kind)
    return {"=": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]


def replace_where(target: DataFrame, where: Column, rows: DataFrame) -> DataFrame:
    """Rows for which the condition is true go, those for which it is false or null stay; then the new rows."""
    return target.where(~F.coalesce(where, F.lit(False))).unionByName(rows.select(*target.columns))


def delete_append(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the snapshot's rows go; its rows are added as they are, repeats included."""
    return without_keys(target, rows.select(*keys).distinct(), keys).unionByName(rows.select(*target.columns))


def write_mode(created: Column, has_filter: Column, truncated: Column) -> Column:
    return F.when(created, "append").when(has_filter, "replace-filter-append").when(truncated, "truncate-append").otherwise("delete-append")


def check_resume(mode: str, offset: int, confirmed: bool) -> None:
    """A mode that deletes first must not begin in the middle unless the deletion is known to be done."""
    if mode in ("replace-filter-append", "truncate-append") and offset > 0 and not confirmed:
        raise ValueError(f"{mode} can't resume at row {offset}: whether the target was cleared isn't known")


def write_snapshot(mode: str, target: DataFrame, rows: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    match mode:
        case "append":
            return target.unionByName(rows.select(*target.columns))
        case "replace-filter-append":
            return replace_where(target, where, rows)
        case "truncate-append":
            return rows.select(*target.columns)
        case "delete-append" | "overwrite":
            return delete_append(target, rows, keys)
    raise ValueError(f"unknown mode {mode!r}")


def with_metadata(rows: DataFrame, existing: DataFrame, keys: list[str], *, loaded_at: Column, event_time: Column | None, created_from: str | None = None) -> DataFrame:
    """Add created_at, updated_at and etl_loaded_at.

    created_at is the mapped source column, null or not; without one it is what
    the row brings, else what the target has for the key, else null. updated_at
    is the event's time where there is one, else what the target has, else what
    the row brings (``event_time`` is None for snapshots). A null key matches a
    null key.
    """
    own = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("timestamp_ntz")
    old = existing.select(*(F.col(k).alias(f"_old_{k}") for k in keys), F.col("created_at").alias("_created"), F.col("updated_at").alias("_updated"), F.lit(True).alias("_there"))
    joined = rows.join(old, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys)), "left")
    created = F.col(created_from) if created_from else F.coalesce(own("created_at"), F.col("_created"))
    kept = F.when(F.col("_there"), F.col("_updated")).otherwise(own("updated_at"))
    updated = F.coalesce(event_time, kept) if event_time is not None else kept
    return joined.withColumns({"created_at": created, "updated_at": updated, "etl_loaded_at": loaded_at}).drop("_created", "_updated", "_there", *(f"_old_{k}" for k in keys))


def row_bytes(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Estimated bytes of a row: 64, 32 a column, names, and values (16 a number or flag, 24 a time, text by length)."""
    total = F.lit(64)
    for f in df.schema.fields:
        if columns and f.name not in columns:
            continue
        kind = f.dataType.typeName()
        c = F.col(f.name)
        size = F.octet_length(c) if kind in ("string", "binary") else F.lit(24) if "timestamp" in kind or kind == "date" else F.lit(16)
        total = total + 32 + len(f.name) + F.when(c.isNull(), 0).otherwise(size)
    return total.cast("long")


def sizing(rows: Column, size: Column, target: int, ceiling: int) -> dict[str, Column]:
    """Rows of a row group and of a read, by the average row."""
    average = F.ceil(size / F.greatest(rows, F.lit(1)))
    group = F.least(F.lit(target // 2), F.lit(64 << 20))
    fitted = F.least(F.greatest(F.floor(F.lit(target // 2 if target // 2 < 64 << 20 else 64 << 20) / F.greatest(average, F.lit(1))), F.lit(1)), F.lit(ceiling))
    each = F.when(size > target, fitted).otherwise(F.lit(ceiling)).cast("long")
    return {"average_bytes": average.cast("long"), "group_bytes": F.when(size > target, group).cast("long"), "group_rows": each, "read_rows": F.least(F.lit(1000), each).cast("long")}


def split_rows(df: DataFrame, order: list[str], size: str, max_rows: int, max_bytes: int, group: list[str]) -> DataFrame:
    """Number the chunks of each group: rows in order fill a chunk up to either limit; a larger row stands alone.

    Whether a chunk is full depends on where it began, so a group is gone
    through in order, in Arrow batches of any number, with a few counters held.
    """
    import pyarrow as pa

    names = [*df.columns, "chunk"]

    def run(batches):
        key, chunk, rows, held = None, 0, 0, 0
        for b in batches:
            out = []
            keys = list(zip(*(b.column(g).to_pylist() for g in group), strict=True)) if group else [()] * b.num_rows
            for k, n in zip(keys, b.column(size).to_pylist(), strict=True):
                n = n or 0
                if k != key:
                    key, chunk, rows, held = k, 0, 0, 0
                elif rows >= max_rows or held + n > max_bytes:
                    chunk, rows, held = chunk + 1, 0, 0
                rows, held = rows + 1, held + n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    dealt = df.repartition(*group) if group else df.coalesce(1)
    return dealt.sortWithinPartitions(*group, *order).mapInArrow(run, f"{schema}, chunk int")
