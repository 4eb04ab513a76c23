"""Schema changes: DDL text to changes, changes to schemas, and rows to schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import SourceColumn, can_represent, lake_type, parameters, should_widen, warehouse_holds, warehouse_type, warehouse_widens


@dataclass(frozen=True)
class Change:
    action: str  # add, alter, drop, rename, create, drop-table, truncate
    table: str = ""
    schema: str = ""
    column: SourceColumn | None = None
    name: str = ""
    place: str = ""  # "", first, last, after:<name>


def _tokens(sql: str) -> list[str]:
    """Words, quoted names without their quotes (marked by a NUL), strings, and single signs."""
    sql = re.sub(r"/\*.*?\*/|--[^\n]*|#[^\n]*", " ", sql, flags=re.S)
    found = re.finditer(r"`((?:[^`]|``)+)`|('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")|([\w$]+)|(\S)", sql)
    return ["\0" + m[1].replace("``", "`") if m[1] else m[2] or m[3] or m[4] for m in found]


class _Reader:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self, n: int = 0) -> str:
        return self.tokens[self.at + n].upper() if self.at + n < len(self.tokens) else ""

    def take(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def name(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1].lstrip("\0")

    def qualified(self) -> tuple[str, str]:
        first = self.name()
        return (first, self.name()) if self.take(".") else ("", first)


def _column(name: str, tokens: list[str]) -> SourceColumn:
    kind = tokens[0].lower()
    size = ""
    if len(tokens) > 1 and tokens[1] == "(":
        size = "".join(tokens[1 : tokens.index(")") + 1])
    words = [t.upper() for t in tokens]
    full = kind + size + (" unsigned" if "UNSIGNED" in words else "")
    numbers = parameters(full)
    decimal = kind in ("decimal", "numeric")
    null = not any(words[i : i + 2] == ["NOT", "NULL"] for i in range(len(words)))
    return SourceColumn(name, kind, full, numbers[0] if numbers and not decimal else None, numbers[0] if numbers and decimal else None, numbers[1] if decimal and len(numbers) > 1 else None, null, any(words[i : i + 2] == ["PRIMARY", "KEY"] for i in range(len(words))))


def _clauses(tokens: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [c for c in out if c]


def _placed(tokens: list[str], default: str) -> tuple[list[str], str]:
    if tokens[-1:] and tokens[-1].upper() == "FIRST":
        return tokens[:-1], "first"
    if len(tokens) > 2 and tokens[-2].upper() == "AFTER":
        return tokens[:-2], "after:" + tokens[-1].lstrip("\0")
    return tokens, default


def parse_ddl(sql: str, schema: str = "") -> list[Change]:
    """Changes of a CREATE, DROP, TRUNCATE or ALTER TABLE statement; other statements and clauses give none."""
    r = _Reader(_tokens(sql.strip().rstrip(";")))
    if r.take("CREATE", "TABLE"):
        r.take("IF", "NOT", "EXISTS")
        own, table = r.qualified()
        return [Change("create", table, own or schema)]
    if r.take("DROP", "TABLE"):
        r.take("IF", "EXISTS")
        out = []
        while r.at < len(r.tokens):
            own, table = r.qualified()
            out.append(Change("drop-table", table, own or schema))
            if not r.take(","):
                break
        return out
    if r.take("TRUNCATE"):
        r.take("TABLE")
        own, table = r.qualified()
        return [Change("truncate", table, own or schema)]
    if not r.take("ALTER", "TABLE"):
        return []
    own, table = r.qualified()
    base = Change("", table, own or schema)
    out: list[Change] = []
    for clause in _clauses(r.tokens[r.at :]):
        c = _Reader(clause)
        verb = c.name().upper()
        if verb in ("ADD", "DROP", "MODIFY", "CHANGE", "ALTER", "RENAME") and c.peek() in ("INDEX", "KEY", "CONSTRAINT", "PRIMARY", "UNIQUE", "FOREIGN", "FULLTEXT", "SPATIAL", "CHECK", "PARTITION", "TO", "AS"):
            continue
        c.take("COLUMN")
        rest = clause[c.at :]
        if verb == "ADD" and rest[:1] == ["("]:
            for part in _clauses(rest[1:-1]):
                out.append(replace(base, action="add", column=_column(part[0].lstrip("\0"), part[1:]), name=part[0].lstrip("\0"), place="last"))
        elif verb == "ADD" and len(rest) > 1:
            tokens, place = _placed(rest, "last")
            out.append(replace(base, action="add", column=_column(tokens[0].lstrip("\0"), tokens[1:]), name=tokens[0].lstrip("\0"), place=place))
        elif verb == "MODIFY" and len(rest) > 1:
            tokens, place = _placed(rest, "")
            out.append(replace(base, action="alter", column=_column(tokens[0].lstrip("\0"), tokens[1:]), name=tokens[0].lstrip("\0"), place=place))
        elif verb == "CHANGE" and len(rest) > 2:
            tokens, place = _placed(rest, "")
            old, new = tokens[0].lstrip("\0"), tokens[1].lstrip("\0")
            if old != new:
                out.append(replace(base, action="rename", name=old, column=SourceColumn(new, "")))
            out.append(replace(base, action="alter", column=_column(new, tokens[2:]), name=new, place=place))
        elif verb == "DROP" and rest:
            out.append(replace(base, action="drop", name=rest[0].lstrip("\0")))
        elif verb == "RENAME" and len(rest) > 2 and rest[1].upper() == "TO":
            out.append(replace(base, action="rename", name=rest[0].lstrip("\0"), column=SourceColumn(rest[2].lstrip("\0"), "")))
    return out


def _move(columns: list, name: str, place: str, of=lambda c: c.name) -> list:
    if not place:
        return columns
    at = next(i for i, c in enumerate(columns) if of(c).lower() == name.lower())
    one, rest = columns[at], columns[:at] + columns[at + 1 :]
    if place == "first":
        return [one, *rest]
    if place.startswith("after:"):
        i = next((i for i, c in enumerate(rest) if of(c).lower() == place[6:].lower()), len(rest) - 1)
        return rest[: i + 1] + [one] + rest[i + 1 :]
    return [*rest, one]


def evolve_source(columns: list[SourceColumn], changes: list[Change]) -> list[SourceColumn]:
    """The source's columns after the changes; a key stays a key when its type changes."""
    out = list(columns)
    for c in changes:
        same = [i for i, x in enumerate(out) if x.name.lower() == c.name.lower()]
        if c.action == "add" and not same:
            out = _move([*out, c.column], c.name, c.place)
        elif c.action == "alter" and same:
            out[same[0]] = replace(c.column, key=out[same[0]].key)
            out = _move(out, c.name, c.place)
        elif c.action == "drop":
            out = [x for x in out if x.name.lower() != c.name.lower()]
        elif c.action == "rename" and same:
            out[same[0]] = replace(out[same[0]], name=c.column.name)
    return out


def apply_changes(df: DataFrame, changes: list[Change], *, allow_drop: bool = False, allow_rename: bool = False, allow_unsafe: bool = False) -> DataFrame:
    """A table's rows under the changed schema. Added columns are nullable; changes to whole tables are not for this."""
    for c in changes:
        have = {x.lower(): x for x in df.columns}
        if c.action == "add" and c.name.lower() not in have:
            df = df.withColumn(c.name, F.lit(None).cast(lake_type(c.column)))
        elif c.action == "alter" and c.name.lower() in have:
            old, new = df.schema[have[c.name.lower()]].dataType, lake_type(c.column)
            if should_widen(old, new) or allow_unsafe:
                df = df.withColumn(have[c.name.lower()], F.col(have[c.name.lower()]).cast(new))
            elif not can_represent(old, new):
                raise ValueError(f"{c.name}: {old.simpleString()} can't become {new.simpleString()}")
        elif c.action == "drop" and c.name.lower() in have:
            if not allow_drop:
                raise ValueError(f"dropping {c.name} isn't allowed")
            df = df.drop(have[c.name.lower()])
        elif c.action == "rename" and c.name.lower() in have:
            if not allow_rename:
                raise ValueError(f"renaming {c.name} isn't allowed")
            df = df.withColumnRenamed(have[c.name.lower()], c.column.name)
        if c.place and c.action in ("add", "alter"):
            df = df.select(*_move(df.columns, c.name, c.place, of=str))
    return df


def sync_schema(df: DataFrame, want: T.StructType) -> DataFrame:
    """Add what is missing as nulls, widen where no value is lost, drop nothing."""
    have = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for f in df.schema.fields:
        new = next((w.dataType for w in want.fields if w.name.lower() == f.name.lower()), None)
        out.append(F.col(f.name).cast(new) if new is not None and should_widen(f.dataType, new) else F.col(f.name))
    return df.select(*out, *(F.lit(None).cast(w.dataType).alias(w.name) for w in want.fields if w.name.lower() not in have))


def plan_warehouse(have: dict[str, tuple[str, bool]], keys: list[str], want: list[SourceColumn]) -> list[str]:
    """Statements that bring a warehouse table, of {name: (type, nullable)}, to the source's columns."""
    wanted = [c.name.lower() for c in want if c.key] or [want[0].name.lower()]
    if missing := [k for k in wanted if k not in {x.lower() for x in have}]:
        raise ValueError(f"key columns {missing} are missing")
    if [k.lower() for k in keys] != wanted:
        raise ValueError(f"the keys {keys} aren't {wanted}")
    own = {k.lower(): v for k, v in have.items()}
    out = []
    for c in want:
        kind = warehouse_type(c)
        if c.name.lower() not in own:
            out.append(f"ADD COLUMN `{c.name}` {kind} NULL")
            continue
        old, nullable = own[c.name.lower()]
        if warehouse_widens(old, kind):
            out.append(f"MODIFY COLUMN `{c.name}` {kind} {'NULL' if nullable or c.nullable else 'NOT NULL'}")
        elif not warehouse_holds(old, kind):
            raise ValueError(f"{c.name}: {old} can't become {kind}")
        elif c.nullable and not nullable and c.name.lower() not in wanted:
            out.append(f"MODIFY COLUMN `{c.name}` {old} NULL")
    return out


def warehouse_ddl(changes: list[Change], table: str) -> list[str]:
    """Statements for a warehouse; one that creates a table is left to the sink."""
    if any(c.action == "create" for c in changes):
        return []
    out = []
    for c in changes:
        match c.action:
            case "add":
                at = {"first": " FIRST"}.get(c.place, f" AFTER `{c.place[6:]}`" if c.place.startswith("after:") else "")
                out.append(f"ALTER TABLE {table} ADD COLUMN `{c.name}` {warehouse_type(c.column)} NULL{at}")
            case "alter":
                out.append(f"ALTER TABLE {table} MODIFY COLUMN `{c.name}` {warehouse_type(c.column)}")
            case "drop":
                out.append(f"ALTER TABLE {table} DROP COLUMN `{c.name}`")
            case "rename":
                out.append(f"ALTER TABLE {table} RENAME COLUMN `{c.name}` `{c.column.name}`")
            case "truncate":
                out.append(f"TRUNCATE TABLE {table}")
            case "drop-table":
                out.append(f"DROP TABLE {table}")
    return out
