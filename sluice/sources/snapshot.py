"""Snapshots: filtered, projected, paged by key or offset, and resumable."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SnapshotPlan:
    """How a table is read: the order, whether that order is a key, a filter and extra columns."""

    order: tuple[str, ...]
    keyset: bool
    where: str | None = None
    extra: tuple[tuple[str, str], ...] = ()


def clean_filter(text: str | None) -> str | None:
    """Without a trailing semicolon and a leading `where`."""
    text = re.sub(r"^\s*where\s+", "", (text or "").strip().rstrip(";").strip(), flags=re.I)
    return text or None


def render(text: str, schema: str, table: str) -> str:
    return text.replace("{{schema}}", schema).replace("{{table}}", table)


def plan_snapshot(df: DataFrame, keys: list[str], where: str | None = None, extra: list[tuple[str, str]] = ()) -> SnapshotPlan:
    """Page by the keys, or where there are none by offset in the order of all columns."""
    by_name = {c.lower(): c for c in df.columns}
    found = []
    for k in keys:
        if k.lower() not in by_name or by_name[k.lower()] in found:
            raise ValueError(f"key column {k!r} is missing or repeated")
        found.append(by_name[k.lower()])
    return SnapshotPlan(tuple(found) or tuple(df.columns), bool(found), clean_filter(where), tuple((e, n) for e, n in extra if e.strip() and n.strip()))


def after(columns: tuple[str, ...], cursor: dict[str, Any]) -> Column:
    """(a > x) OR (a = x AND b > y) ..., which reaches the scan as a filter."""
    if set(cursor) != set(columns):
        raise ValueError(f"the cursor's columns {sorted(cursor)} aren't the plan's {sorted(columns)}")
    steps = []
    for i, c in enumerate(columns):
        equal = [F.col(p) == F.lit(cursor[p]) for p in columns[:i]]
        steps.append(reduce(Column.__and__, [*equal, F.col(c) > F.lit(cursor[c])]))
    return reduce(Column.__or__, steps)


def snapshot(df: DataFrame, plan: SnapshotPlan) -> DataFrame:
    """The whole snapshot as one distributed read."""
    rows = df.where(plan.where) if plan.where else df
    return rows.select("*", *(F.expr(f"({e})").alias(n) for e, n in plan.extra)) if plan.extra else rows


def page(df: DataFrame, plan: SnapshotPlan, limit: int, cursor: dict[str, Any] | None = None, offset: int = 0) -> DataFrame:
    rows = df.where(plan.where) if plan.where else df
    if plan.keyset and cursor:
        rows = rows.where(after(plan.order, cursor))
    rows = rows.orderBy(*plan.order)
    if not plan.keyset and offset:
        rows = rows.offset(offset)
    rows = rows.limit(limit)
    return rows.select("*", *(F.expr(f"({e})").alias(n) for e, n in plan.extra)) if plan.extra else rows


def count_rows(df: DataFrame, where: str | None = None) -> int:
    where = clean_filter(where)
    return (df.where(where) if where else df).count()


def last_cursor(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The greatest key of a page, as one row."""
    return df.agg(F.max(F.struct(*columns)).alias("k")).select("k.*")


def encode_cursor(cursor: dict[str, Any]) -> str:
    """JSON with a tag for each value's kind, so that it reads back as it was."""
    def tag(v: Any) -> dict:
        match v:
            case None:
                return {"kind": "null"}
            case bool():
                return {"kind": "bool", "value": v}
            case int():
                return {"kind": "int64" if v < 1 << 63 else "uint64", "value": str(v)}
            case float():
                return {"kind": "float64", "value": repr(v)}
            case datetime():
                return {"kind": "time", "value": v.replace(tzinfo=v.tzinfo or UTC).isoformat()}
            case bytes():
                return {"kind": "string", "value": v.decode()}
        return {"kind": "string", "value": str(v)}

    return json.dumps({k: tag(v) for k, v in cursor.items()})


def decode_cursor(text: str) -> dict[str, Any]:
    if not text.strip():
        raise ValueError("the cursor is empty")
    read = {"null": lambda v: None, "bool": bool, "int64": int, "uint64": int, "float64": float, "time": lambda v: datetime.fromisoformat(v).astimezone(UTC).replace(tzinfo=None), "string": str}
    return {k: read[x["kind"]](x.get("value")) for k, x in json.loads(text).items()}


def restore_cursor(plan: SnapshotPlan, saved: str | None) -> dict[str, Any] | None:
    """The saved cursor, or None to begin again where it is missing, unreadable or of other columns."""
    try:
        cursor = decode_cursor(saved or "")
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    return cursor if plan.keyset and set(cursor) == set(plan.order) else None


@dataclass
class Progress:
    """Where a snapshot of several tables is: the table, rows read of it, its cursor."""

    table: str | None = None
    rows: int = 0
    cursor: str | None = None
    done: bool = False
    finished: list[str] = field(default_factory=list)


def resume_from(tables: list[str], progress: Progress) -> list[tuple[str, str | None]]:
    """(table, cursor) still to be read. If the saved table is no longer listed, all tables are."""
    if progress.done:
        return []
    if progress.table is None or progress.table not in tables:
        return [(t, None) for t in tables]
    at = tables.index(progress.table)
    return [(progress.table, progress.cursor), *((t, None) for t in tables[at + 1 :])]


def pages(df: DataFrame, plan: SnapshotPlan, limit: int, progress: Progress) -> Iterator[DataFrame]:
    """Pages for a consumer that acknowledges each before the next; progress is saved after it does."""
    cursor, offset = restore_cursor(plan, progress.cursor), 0 if plan.keyset else progress.rows
    while True:
        rows = page(df, plan, limit, cursor, offset).cache()
        n = rows.count()
        if n:
            yield rows
            if plan.keyset:
                cursor = last_cursor(rows, plan.order).first().asDict()
                progress.cursor = encode_cursor(cursor)
            offset += n
            progress.rows += n
        rows.unpersist()
        if n < limit:
            return


def run_mode(mode: str, saved_offset: bool, snapshot_done: bool, snapshot_started: bool) -> list[str]:
    """Steps of a run: which of snapshot, resumed snapshot and changes, and from where."""
    match mode:
        case "latest" | "latest-offset":
            return ["changes:saved"] if saved_offset else ["changes:latest"]
        case "snapshot-only":
            return [] if snapshot_done else ["resume-snapshot"] if snapshot_started else ["snapshot"]
        case "initial":
            if snapshot_done and saved_offset:
                return ["changes:saved"]
            # the offset is taken before the snapshot, so that changes meanwhile are replayed over it
            return (["resume-snapshot"] if snapshot_started else ["capture-offset", "snapshot"]) + ["changes:captured"]
    raise ValueError(f"unknown mode {mode!r}")
