"""Table lists and names: wildcards, per-table settings, and routing to targets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def glob_regex(pattern: str, single: bool = False) -> str:
    """`*` any text and, with ``single``, `?` any character; everything else is literal."""
    return "^" + "".join(".*" if c == "*" else "." if single and c == "?" else re.escape(c) for c in pattern) + "$"


def matches(pattern: str, name: str) -> bool:
    return re.match(glob_regex(pattern), name, re.I | re.S) is not None


def specificity(pattern: str) -> int:
    return sum(c not in "*?" for c in pattern)


def expand_tables(entries: Iterable[str], tables_of: Callable[[str], Iterable[str]]) -> list[tuple[str, str]]:
    """(schema, table) of entries `db.table`, `db.*` and `db.pre*`, in order and told apart without regard to case."""
    out, seen = [], set()
    for entry in entries:
        schema, _, pattern = entry.strip().partition(".")
        if not schema or not pattern:
            raise ValueError(f"not a table: {entry!r}")
        found = [t for t in tables_of(schema) if matches(pattern, t)] if "*" in pattern else [pattern]
        if not found:
            raise ValueError(f"no table matches {entry!r}")
        for t in found:
            if (key := (schema.lower(), t.lower())) not in seen:
                seen.add(key)
                out.append((schema, t))
    return out


def base_tables(found: Iterable[tuple[str, str]], type_of: Callable[[str, str], str]) -> list[tuple[str, str]]:
    kept = [(s, t) for s, t in found if type_of(s, t).upper() == "BASE TABLE"]
    if not kept:
        raise ValueError("no base tables are left")
    return kept


def setting_for(settings: dict, schema: str, table: str):
    """By full name, then by table name, then by the most specific pattern; ties by pattern."""
    full = f"{schema}.{table}".lower()
    by_name = {k.lower(): v for k, v in settings.items()}
    for key in (full, table.lower()):
        if key in by_name:
            return by_name[key]
    fits = [k for k in by_name if re.match(glob_regex(k, single=True), full if "." in k else table.lower())]
    return by_name[min(fits, key=lambda k: (-specificity(k), k))] if fits else None


def route(names: DataFrame, rules: DataFrame, name: str = "name", default: Column | None = None, most_rules: int = 10_000) -> DataFrame:
    """Add ``target``: of the exact rule, else of the most specific pattern, else the default or the name.

    ``rules`` (pattern, target) is a configuration list of ``most_rules`` at
    most, which is checked before it is sent to all tasks. Distinct names are
    matched, so the comparison is bounded by names times rules, not by rows.
    """
    if rules.limit(most_rules + 1).count() > most_rules:
        raise ValueError(f"more than {most_rules} routing rules")
    distinct = names.select(name).distinct()
    p = F.col("pattern")
    like = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(p, r"([.+^$(){}|\[\]\\])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    listed = rules.select("pattern", "target", F.length(F.regexp_replace("pattern", r"[*?]", "")).alias("_n"), (~p.contains("*")).alias("_exact"), like.alias("_like"))
    rank = W.partitionBy(name).orderBy(F.desc("_exact"), F.desc("_n"), "pattern")
    fits = distinct.join(F.broadcast(listed), F.expr(f"`{name}` RLIKE _like")).withColumn("_r", F.row_number().over(rank)).where("_r = 1").select(name, "target")
    return names.join(fits, name, "left").withColumn("target", F.coalesce("target", default if default is not None else F.col(name)))


def warehouse_target(schema: str, table: str, routes: dict[str, str], default_db: str | None) -> tuple[str, str]:
    """Exact route, else `db.*`, else the default database."""
    by = {k.lower(): v for k, v in routes.items()}
    to = by.get(f"{schema}.{table}".lower()) or by.get(f"{schema}.*".lower())
    if to:
        db, _, name = to.partition(".")
        return db, name if name and name != "*" else table
    return default_db or schema, table


def selection(tables: list[str], databases: list[str], names: list[str], single: str | None = None) -> list[str]:
    """Listed tables and every database with every name; the single one only if nothing else is given."""
    out = list(dict.fromkeys(t.strip().lower() for t in [*tables, *(f"{d}.{n}" for d in databases for n in names)] if t.strip()))
    return out or ([single.strip().lower()] if single else [])


def truncated(table: str, listed: list[str], excluded: list[str], wildcard_allowed: bool) -> bool:
    """Whether a snapshot may empty the target; exclusions win and wildcards need leave."""
    if any("*" in x for x in listed) and not wildcard_allowed:
        raise ValueError("a wildcard in the truncate list needs to be allowed")
    return any(matches(p, table) for p in listed) and not any(matches(p, table) for p in excluded)
