"""Configuration rules: keys of jobs, retries, literals, and what defaults to what."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import quote_text, safe_column_names
from .types import SourceColumn, warehouse_type

#: Settings that don't make a job another one.
NOT_IN_KEY = ("cdc_delete_executor",)


class PermanentError(RuntimeError):
    """An error that no retry mends."""


def _without(value: Any, names: tuple[str, ...]) -> Any:
    if isinstance(value, dict):
        return {k: _without(v, names) for k, v in value.items() if k not in names}
    return [_without(v, names) for v in value] if isinstance(value, list) else value


def meta_key(job: str, mode: str, source: dict, sink: dict, prefix: str = "sluice/v1/") -> str:
    """The same for equal configurations, whatever the order of their settings; how deletes are run doesn't count."""
    text = json.dumps([1, job, mode, source, _without(sink, NOT_IN_KEY)], sort_keys=True, separators=(",", ":"))
    return prefix + hashlib.sha256(text.encode()).hexdigest()


def retry(run: Callable[[], Any], *, base: float = 0.5, most: float = 10.0, attempts: int = 0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Run until it succeeds, waiting twice as long each time up to ``most`` seconds; permanent errors and the last attempt's are raised."""
    wait, n = base, 0
    while True:
        try:
            return run()
        except PermanentError:
            raise
        except Exception:
            n += 1
            if attempts and n >= attempts:
                raise
        sleep(wait)
        wait = min(2 * wait, most)


def maintenance_time(text: Column) -> Column:
    """A timestamp in one of five layouts, without zone in UTC; null where none fits."""
    t = F.trim(text)
    layouts = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(p)) for p in layouts)).cast("timestamp_ntz")


def sql_literal(value: Any) -> str:
    """A value as a literal of its type."""
    match value:
        case None:
            return "NULL"
        case bool():
            return str(value).upper()
        case int() | float():
            return repr(value)
        case Decimal():
            return f"DECIMAL '{value}'"
        case datetime():
            at = value.astimezone(UTC) if value.tzinfo else value
            return f"TIMESTAMP '{at:%Y-%m-%d %H:%M:%S.%f}'"
        case date():
            return f"DATE '{value.isoformat()}'"
        case bytes():
            return f"X'{value.hex().upper()}'"
    return quote_text(str(value))


def metadata_names(given: dict[str, Any]) -> dict[str, str]:
    """Names of the metadata columns that are on: a mapped source turns created_at on, names default to the columns' own."""
    out = {}
    for name in ("created_at", "updated_at", "etl_loaded_at"):
        own = given.get(name) or {}
        if own.get("enabled") or (name == "created_at" and own.get("source")):
            out[name] = (own.get("name") or "").strip() or name
    return out


def extra_columns(given: list[dict[str, str]]) -> list[dict[str, str]]:
    """Computed columns with a name, an expression and a type; a column type that isn't given is the data type."""
    out = []
    for x in given:
        x = {k: str(v).strip() for k, v in x.items()}
        if x.get("name") and x.get("expression") and x.get("type"):
            out.append({"name": x["name"], "expression": x["expression"], "type": x["type"], "column_type": x.get("column_type") or x["type"]})
    return out


def split_target(text: str) -> tuple[str, str]:
    """`namespace.table`; a namespace may have dots of its own."""
    namespace, _, table = text.strip().rpartition(".")
    if not namespace or not table:
        raise ValueError(f"not namespace.table: {text!r}")
    return namespace, table


@dataclass(frozen=True)
class Binding:
    source: str
    target: str
    kind: str
    nullable: bool


def bindings(columns: list[SourceColumn]) -> list[Binding]:
    """Source columns and their names and types in a warehouse: keys first, else the first column is the key."""
    keys = [c for c in columns if c.key] or columns[:1]
    ordered = [*keys, *(c for c in columns if c not in keys)]
    names = safe_column_names([c.name for c in ordered])
    from dataclasses import replace

    return [Binding(c.name, n, warehouse_type(replace(c, key=c in keys)), c.nullable) for c, n in zip(ordered, names, strict=True)]


def create_warehouse_table(database: str, table: str, columns: list[SourceColumn], buckets: int = 10) -> str:
    """A table that is unique by its keys and dealt by the first of them."""
    if not columns:
        raise ValueError(f"{database}.{table} has no columns")
    own = bindings(columns)
    keys = [b.target for b in own[: max(1, sum(c.key for c in columns))]]
    listed = ", ".join(f"`{b.target}` {b.kind}{'' if b.nullable else ' NOT NULL'}" for b in own)
    unique = ", ".join(f"`{k}`" for k in keys)
    return f"CREATE TABLE IF NOT EXISTS {database}.{table} ({listed}) UNIQUE KEY({unique}) DISTRIBUTED BY HASH(`{keys[0]}`) BUCKETS {buckets}"


def delete_executor(name: str | None) -> str:
    """Who runs key deletes; a table can't without one."""
    own = (name or "").strip().lower()
    if own not in ("trino", "equality"):
        raise PermanentError("key deletes need an executor: trino or equality")
    return own


def task_settings(settings: dict[str, Any], manual: dict[str, Any] | None) -> dict[str, Any]:
    """A task asked for by hand may change the dry run and the age, nothing else."""
    return settings | {k: v for k, v in (manual or {}).items() if k in ("dry_run", "older_than_hours")}
