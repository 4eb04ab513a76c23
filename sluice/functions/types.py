"""Source column types, what they become, and which types can hold which."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

MAX_PRECISION = 38


@dataclass(frozen=True)
class SourceColumn:
    name: str
    kind: str
    full: str = ""
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    nullable: bool = True
    key: bool = False

    @property
    def unsigned(self) -> bool:
        return "unsigned" in self.full.lower()


def parameters(text: str) -> list[int]:
    """Numbers in the parentheses of a type."""
    m = re.search(r"\(([^)]*)\)", text)
    return [int(x) for x in re.findall(r"\d+", m[1])] if m else []


def lake_type(c: SourceColumn) -> T.DataType:
    kind = c.kind.lower()
    if kind == "tinyint":
        return T.BooleanType() if parameters(c.full) == [1] and not c.unsigned else T.IntegerType()
    if kind in ("smallint", "mediumint", "year"):
        return T.IntegerType()
    if kind in ("int", "integer"):
        return T.LongType() if c.unsigned else T.IntegerType()
    if kind == "bigint":
        return T.DecimalType(20, 0) if c.unsigned else T.LongType()
    if kind == "float":
        return T.FloatType()
    if kind in ("double", "real"):
        return T.DoubleType()
    if kind in ("decimal", "numeric"):
        p, s = (c.precision or 38), (18 if c.scale is None and not c.precision else c.scale or 0)
        return T.StringType() if p > MAX_PRECISION else T.DecimalType(p, min(s, p))
    if kind in ("bool", "boolean"):
        return T.BooleanType()
    if kind == "bit":
        return T.BooleanType() if parameters(c.full) in ([], [1]) else T.BinaryType()
    if kind == "date":
        return T.DateType()
    if kind in ("datetime", "timestamp"):
        return T.TimestampNTZType()
    if kind in ("binary", "varbinary") or kind.endswith("blob"):
        return T.BinaryType()
    return T.StringType()


def warehouse_type(c: SourceColumn) -> str:
    """Type in a warehouse with variable-length text and integer families."""
    kind = c.kind.lower()
    text = f"VARCHAR({min(c.length or 1024, 65533)})" if c.key else "STRING"
    if kind == "tinyint":
        return "BOOLEAN" if parameters(c.full) == [1] and not c.unsigned else "BIGINT"
    if kind in ("smallint", "mediumint", "int", "integer", "bigint", "year"):
        return "BIGINT"
    if kind in ("float", "double", "real"):
        return "DECIMAL(27,9)" if c.key else "DOUBLE"
    if kind in ("decimal", "numeric"):
        p, s = c.precision or 27, c.scale if c.scale is not None else (9 if not c.precision else 0)
        return f"VARCHAR({p + 1 + (s > 0)})" if p > MAX_PRECISION else f"DECIMAL({p},{min(s, p)})"
    if kind in ("bool", "boolean"):
        return "BOOLEAN"
    if kind == "bit":
        return "BOOLEAN" if parameters(c.full) in ([], [1]) else text
    if kind == "date":
        return "DATE"
    if kind in ("datetime", "timestamp"):
        return "DATETIME"
    if kind in ("char", "varchar"):
        return "VARCHAR(1024)" if not c.length else f"VARCHAR({c.length})" if c.length <= 65533 else "STRING"
    return text


def table_schema(columns: list[SourceColumn]) -> T.StructType:
    return T.StructType([T.StructField(c.name, lake_type(c), c.nullable and not c.key, {"source_type": c.full or c.kind, "key": c.key}) for c in columns])


def key_columns(columns: list[SourceColumn], override: list[str] | None = None) -> list[str]:
    keys = override or [c.name for c in columns if c.key]
    if not keys:
        raise ValueError("the table has no primary key")
    return keys


def decimal_holds(a: T.DecimalType, b: T.DecimalType) -> bool:
    return a.scale >= b.scale and a.precision - a.scale >= b.precision - b.scale


def can_represent(have: T.DataType, want: T.DataType) -> bool:
    """Whether a column of type `have` holds all values of type `want`."""
    if have == want or isinstance(have, T.StringType):
        return True
    if isinstance(have, T.LongType):
        return isinstance(want, T.IntegerType)
    if isinstance(have, T.DoubleType):
        return isinstance(want, T.FloatType)
    if isinstance(have, T.DecimalType):
        if isinstance(want, T.DecimalType):
            return have.scale == want.scale and have.precision >= want.precision
        whole = {T.IntegerType: 10, T.LongType: 19}.get(type(want))
        return bool(whole) and have.scale == 0 and have.precision >= whole
    return False


def should_widen(have: T.DataType, want: T.DataType) -> bool:
    return not can_represent(have, want) and can_represent(want, have) and not isinstance(want, T.StringType)


# Names of one warehouse type, and the integers from narrow to wide.
SYNONYMS = {"TEXT": "STRING", "DECIMALV2": "DECIMAL", "DECIMALV3": "DECIMAL", "INTEGER": "INT", "DATETIMEV2": "DATETIME", "DATEV2": "DATE"}
INTEGERS = ["TINYINT", "SMALLINT", "INT", "BIGINT", "LARGEINT"]


def warehouse_name(text: str) -> str:
    name = re.match(r"\s*(\w+)", text)[1].upper()
    return SYNONYMS.get(name, name)


def warehouse_holds(have: str, want: str) -> bool:
    a, b, p, q = warehouse_name(have), warehouse_name(want), parameters(have), parameters(want)
    if a == "STRING":
        return b in ("STRING", "VARCHAR", "CHAR")
    if a in ("VARCHAR", "CHAR") and b in ("VARCHAR", "CHAR"):
        return (p or [1])[0] >= (q or [1])[0]
    if a in INTEGERS and b in INTEGERS:
        return INTEGERS.index(a) >= INTEGERS.index(b)
    if a == b == "DECIMAL":
        return decimal_holds(T.DecimalType(*(p or [27, 9])), T.DecimalType(*(q or [27, 9])))
    if a == "DOUBLE" and b == "FLOAT":
        return True
    return a == b


def warehouse_widens(have: str, want: str) -> bool:
    """Whether a change of type keeps all values."""
    return not warehouse_holds(have, want) and warehouse_holds(want, have)
