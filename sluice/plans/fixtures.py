"""Queries on small fixed inputs: rules of configuration, text and types that no test table reaches.

The SQL beside each lists the results that the rules call for, or has them by
expressions of its own.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import config as cf
from ..functions import scalars as s
from ..functions import types as ty
from ..operators import changes as ch
from ..operators import maintenance as mt
from ..operators import ops
from ..operators import schema as sc
from ..sources import snapshot as sn
from ..sources import tables as tb
from ..streaming.apply import FlushPolicy
from .queries import query, t


def listed(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(c if " " in c else f"{c} string" for c in columns.split(", ")))


def tried(f, *a) -> str:
    """The result as text, or that there is none."""
    try:
        return str(f(*a))
    except (ValueError, cf.PermanentError):
        return "error"


DATES = "(VALUES ('2014-05-00'), ('2014-00-00 12:30:00'), ('0000-00-00'), ('0000-00-00 00:00:00'), ('2014-05-20'), (' 2014-05-20 '), ('text')) AS d(x)"


@query(f"""
    SELECT x, CASE WHEN trim(x) IN ('2014-05-00', '2014-00-00 12:30:00', '0000-00-00', '0000-00-00 00:00:00') THEN NULL ELSE trim(x) END AS nullable,
      CASE trim(x) WHEN '2014-05-00' THEN '2014-05-01' WHEN '2014-00-00 12:30:00' THEN '2014-01-01 12:30:00' WHEN '0000-00-00' THEN '1970-01-01' WHEN '0000-00-00 00:00:00' THEN '1970-01-01 00:00:00' ELSE trim(x) END AS required,
      CASE trim(x) WHEN '0000-00-00' THEN '1970-01-01' WHEN '0000-00-00 00:00:00' THEN '1970-01-01 00:00:00' ELSE trim(x) END AS text FROM {DATES}""")
def load_values(spark, sf_dir):
    d = spark.sql(f"SELECT * FROM {DATES}")
    return d.select("x", s.load_value(F.col("x"), True, True).alias("nullable"), s.load_value(F.col("x"), True, False).alias("required"), s.load_value(F.col("x"), False, True).alias("text"))


TIMES = "(VALUES ('2024-01-02T03:04:05Z'), ('2024-01-02T03:04:05.250+02:00'), ('2024-01-02 03:04:05.000125'), ('2024-01-02 03:04:05'), ('2024-01-02'), ('nonsense')) AS d(x)"


@query("SELECT * FROM (VALUES ('2024-01-02T03:04:05Z', '2024-01-02 03:04:05'), ('2024-01-02T03:04:05.250+02:00', '2024-01-02 01:04:05.25'), ('2024-01-02 03:04:05.000125', '2024-01-02 03:04:05.000125'), ('2024-01-02 03:04:05', '2024-01-02 03:04:05'), ('2024-01-02', '2024-01-02 00:00:00'), ('nonsense', NULL)) AS d(x, parsed)")
def parse_times(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {TIMES}").select("x", s.parse_time(F.col("x")).cast("string").alias("parsed"))


@query("SELECT * FROM (VALUES ('2024-01-02T03:04:05Z', '2024-01-02 03:04:05'), ('2024-01-02T03:04:05.250+02:00', '2024-01-02 01:04:05.25'), ('2024-01-02 03:04:05.000125', '2024-01-02 03:04:05.000125'), ('2024-01-02 03:04:05', '2024-01-02 03:04:05'), ('2024-01-02', '2024-01-02 00:00:00'), ('nonsense', NULL)) AS d(x, parsed)")
def maintenance_times(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {TIMES}").select("x", cf.maintenance_time(F.col("x")).cast("string").alias("parsed"))


@query(r"SELECT n_nationkey, concat_ws(chr(31), CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 3 = 0 THEN '\N' ELSE n_name END, CASE WHEN n_regionkey = 1 THEN '1' ELSE '0' END) AS line FROM nation")
def stream_rows(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    return n.select("n_nationkey", s.stream_row([F.col("n_nationkey"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name"))], F.col("n_regionkey") == 1).alias("line"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'unknown' ELSE replace(replace(lower(trim(p_type)), ' ', '_'), '-', '_') END AS metric FROM part")
def metric_keys(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", s.metric_key(F.when(F.col("p_partkey") % 10 != 0, F.concat(F.lit(" "), "p_type"))).alias("metric"))


@query("SELECT * FROM (VALUES ('s3://a/x', 's3://a/y', true), ('s3://b/x', 's3://a/y', false), ('gs://a/x', 's3://a/y', false), ('s3://a/x/y', 's3://a', true)) AS d(path, location, same)")
def same_storage(spark, sf_dir):
    d = listed(spark, "path, location", [("s3://a/x", "s3://a/y"), ("s3://b/x", "s3://a/y"), ("gs://a/x", "s3://a/y"), ("s3://a/x/y", "s3://a")])
    return d.withColumn("same", s.same_storage(F.col("path"), F.col("location")))


@query("SELECT * FROM (VALUES ('no files', 0, 'no_binlogs'), ('no position', 3, 'missing'), ('before', 3, 'purged'), ('behind', 3, 'purged'), ('first', 3, 'available'), ('last', 3, 'available')) AS d(what, files, status)")
def checkpoint_states(spark, sf_dir):
    d = listed(spark, "what, at, files int", [("no files", "b.3", 0), ("no position", None, 3), ("before", "b.1", 3), ("behind", "b.5", 3), ("first", "b.2", 3), ("last", "b.4", 3)])
    return d.select("what", "files", s.checkpoint_status(F.col("at"), F.lit("b.2"), F.lit("b.4"), F.col("files")).alias("status"))


@query("SELECT * FROM (VALUES ('a.b', '`a.b`', 'it''s', '''it''''s'''), ('a`b', '`a``b`', 'x', '''x''')) AS d(name, quoted, text, literal)")
def quoting(spark, sf_dir):
    return listed(spark, "name, quoted, text, literal", [(n, s.quote_identifier(n), x, s.quote_text(x)) for n, x in (("a.b", "it's"), ("a`b", "x"))])


@query("SELECT * FROM (VALUES ('null', 'NULL'), ('flag', 'TRUE'), ('whole', '-5'), ('text', '''it''''s'''), ('time', 'TIMESTAMP ''2024-01-02 03:04:05.000006'''), ('bytes', 'X''00FF''')) AS d(kind, literal)")
def sql_literals(spark, sf_dir):
    values = {"null": None, "flag": True, "whole": -5, "text": "it's", "time": datetime(2024, 1, 2, 3, 4, 5, 6), "bytes": b"\x00\xff"}
    return listed(spark, "kind, literal", [(k, cf.sql_literal(v)) for k, v in values.items()])


@query("SELECT * FROM (VALUES ('128 MiB', '134217728'), ('1.5kb', '1536'), ('7', '7'), ('', '0'), ('2 GB', '2147483648'), ('-1', 'error'), ('3 furlongs', 'error')) AS d(text, bytes)")
def byte_sizes(spark, sf_dir):
    return listed(spark, "text, bytes", [(x, tried(s.parse_byte_size, x)) for x in ("128 MiB", "1.5kb", "7", "", "2 GB", "-1", "3 furlongs")])


@query("SELECT * FROM (VALUES (0, 'a b', 'a_b'), (1, 'A_B', 'A_B_2'), (2, '**', 'col_3'), (3, 'ok', 'ok'), (4, 'ok', 'ok_2')) AS d(place, name, safe)")
def safe_names(spark, sf_dir):
    names = ["a b", "A_B", "**", "ok", "ok"]
    return listed(spark, "place int, name, safe", [(i, n, x) for i, (n, x) in enumerate(zip(names, s.safe_column_names(names), strict=True))])


@query("SELECT * FROM (VALUES ('app.tbl_*', 'app.tbl_a,app.tbl_b'), ('app.*', 'app.tbl_a,app.tbl_b,app.other,app.a_view'), ('app.other', 'app.other'), ('app.zzz*', 'error'), ('nodot', 'error')) AS d(entry, tables)")
def table_expansion(spark, sf_dir):
    there = {"app": ["tbl_a", "tbl_b", "other", "a_view"]}
    return listed(spark, "entry, tables", [(e, tried(lambda: ",".join(".".join(x) for x in tb.expand_tables([e], there.__getitem__)))) for e in ("app.tbl_*", "app.*", "app.other", "app.zzz*", "nodot")])  # noqa: B023


@query("SELECT * FROM (VALUES ('app.*', 'app.tbl_a,app.tbl_b,app.other'), ('app.a_v*', 'error')) AS d(entry, tables)")
def base_tables(spark, sf_dir):
    there = {"app": ["tbl_a", "tbl_b", "other", "a_view"]}
    kind = lambda _, n: "VIEW" if n.endswith("view") else "BASE TABLE"
    return listed(spark, "entry, tables", [(e, tried(lambda: ",".join(".".join(x) for x in tb.base_tables(tb.expand_tables([e], there.__getitem__), kind)))) for e in ("app.*", "app.a_v*")])  # noqa: B023


@query("SELECT * FROM (VALUES ('app', 'tbl_a', '2'), ('app', 'tbl_b', '3'), ('app', 'other', '1'), ('App', 'TBL_C', '4'), ('zoo', 'x', 'None')) AS d(db, name, setting)")
def table_settings(spark, sf_dir):
    settings = {"app.*": 1, "app.tbl_?": 2, "tbl_b": 3, "app.tbl_c": 4}
    return listed(spark, "db, name, setting", [(a, b, str(tb.setting_for(settings, a, b))) for a, b in (("app", "tbl_a"), ("app", "tbl_b"), ("app", "other"), ("App", "TBL_C"), ("zoo", "x"))])


@query("SELECT * FROM (VALUES ('a', 't', 'db', 't'), ('a', 'u', 'x', 'y'), ('b', 't', 'main', 't')) AS d(source_db, name, db, target)")
def warehouse_routes(spark, sf_dir):
    routes = {"a.*": "db.*", "a.u": "x.y"}
    return listed(spark, "source_db, name, db, target", [(a, b, *tb.warehouse_target(a, b, routes, "main")) for a, b in (("a", "t"), ("a", "u"), ("b", "t"))])


@query("SELECT * FROM (VALUES ('a.b', 'True'), ('a.c', 'False'), ('z.b', 'False'), ('wild', 'error')) AS d(name, truncated)")
def truncate_lists(spark, sf_dir):
    rows = [(n, tried(tb.truncated, n, ["a.*"], ["a.c"], True)) for n in ("a.b", "a.c", "z.b")]
    return listed(spark, "name, truncated", [*rows, ("wild", tried(tb.truncated, "a.b", ["a.*"], [], False))])


@query("SELECT * FROM (VALUES ('both', 'a.t,d.x,d.y'), ('single', 'only'), ('none', '')) AS d(what, tables)")
def table_selection(spark, sf_dir):
    rows = [("both", tb.selection([" A.t "], ["d"], ["x", "y", "X"], "only")), ("single", tb.selection([], [], [], "Only ")), ("none", tb.selection([], [], []))]
    return listed(spark, "what, tables", [(n, ",".join(x)) for n, x in rows])


@query("SELECT * FROM (VALUES ('WHERE a = 1;', 'a = 1'), ('  where  b', 'b'), (';', 'None'), ('', 'None'), ('{{schema}}.{{table}} > 1', 'app.t > 1')) AS d(given, used)")
def snapshot_filters(spark, sf_dir):
    return listed(spark, "given, used", [(x, str(sn.clean_filter(sn.render(x, "app", "t")))) for x in ("WHERE a = 1;", "  where  b", ";", "", "{{schema}}.{{table}} > 1")])


@query("SELECT * FROM (VALUES ('a', 'null', NULL), ('b', 'bool', 'True'), ('c', 'int64', '-7'), ('d', 'uint64', '18446744073709551615'), ('e', 'float64', '0.1'), ('f', 'time', '2024-01-02 03:04:05'), ('g', 'string', 'x')) AS d(name, kind, value)")
def cursor_codec(spark, sf_dir):
    """Values by way of their tagged text."""
    import json

    cursor = {"a": None, "b": True, "c": -7, "d": 2**64 - 1, "e": 0.1, "f": datetime(2024, 1, 2, 3, 4, 5), "g": "x"}
    text = sn.encode_cursor(cursor)
    back, kinds = sn.decode_cursor(text), {k: x["kind"] for k, x in json.loads(text).items()}
    return listed(spark, "name, kind, value", [(k, kinds[k], None if back[k] is None else str(back[k])) for k in cursor])


@query("SELECT * FROM (VALUES ('saved', 'True'), ('other columns', 'False'), ('empty', 'False'), ('broken', 'False'), ('no key', 'False')) AS d(what, resumes)")
def cursor_restore(spark, sf_dir):
    plan, offset = sn.SnapshotPlan(("a",), True), sn.SnapshotPlan(("a",), False)
    rows = [("saved", plan, sn.encode_cursor({"a": 1})), ("other columns", plan, sn.encode_cursor({"b": 1})), ("empty", plan, ""), ("broken", plan, "{"), ("no key", offset, sn.encode_cursor({"a": 1}))]
    return listed(spark, "what, resumes", [(n, str(sn.restore_cursor(p, x) is not None)) for n, p, x in rows])


@query("SELECT * FROM (VALUES ('start', 'a,b,c'), ('middle', 'b@7,c'), ('table gone', 'a,b,c'), ('done', '')) AS d(what, left_)")
def snapshot_resume(spark, sf_dir):
    at = {"start": sn.Progress(), "middle": sn.Progress("b", 5, "7"), "table gone": sn.Progress("z", 5, "7"), "done": sn.Progress("b", done=True)}
    return listed(spark, "what, left_", [(n, ",".join(x + (f"@{c}" if c else "") for x, c in sn.resume_from(["a", "b", "c"], p))) for n, p in at.items()])


@query("""SELECT * FROM (VALUES ('latest', 'no', 'changes:latest'), ('latest', 'saved', 'changes:saved'), ('snapshot-only', 'no', 'snapshot'), ('snapshot-only', 'started', 'resume-snapshot'), ('snapshot-only', 'done', ''),
    ('initial', 'no', 'capture-offset,snapshot,changes:captured'), ('initial', 'started', 'resume-snapshot,changes:captured'), ('initial', 'both', 'changes:saved')) AS d(mode, saved, steps)""")
def run_modes(spark, sf_dir):
    cases = [("latest", "no", (False, False, False)), ("latest", "saved", (True, False, False)), ("snapshot-only", "no", (False, False, False)), ("snapshot-only", "started", (False, False, True)), ("snapshot-only", "done", (False, True, True)), ("initial", "no", (False, False, False)), ("initial", "started", (False, False, True)), ("initial", "both", (True, True, True))]
    return listed(spark, "mode, saved, steps", [(m, a, ",".join(sn.run_mode(m, *x))) for m, a, x in cases])


@query("""SELECT * FROM (VALUES (1, 'INSERT', 0, NULL, 'a', 'f:1:0'), (1, 'INSERT', 1, NULL, 'b', 'f:1:1'), (2, 'UPDATE', 0, 'a', 'a2', 'f:2:0'), (2, 'UPDATE', 1, 'b', 'b2', 'f:2:1'), (3, 'DELETE', 0, 'c', NULL, 'f:3:0')) AS d(pos, op, row, before, after, trace)""")
def decoded_rows(spark, sf_dir):
    e = spark.createDataFrame([(1, "INSERT", ["a", "b"]), (2, "UPDATE", ["a", "a2", "b", "b2"]), (3, "DELETE", ["c"]), (4, "INSERT", [])], "pos int, op string, rows array<string>")
    return ch.decode_rows(e).select("pos", "op", "row", "before", "after", ch.trace_id(F.lit("f"), F.col("pos").cast("string"), F.col("row").cast("string")).alias("trace"))


@query("SELECT n_nationkey, 'n_nationkey=' || n_nationkey || ',n_name=' || CASE WHEN n_nationkey % 4 = 0 THEN 'null' ELSE n_name END AS summary FROM nation")
def key_summaries(spark, sf_dir):
    n = t(spark, sf_dir, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")))
    return n.select("n_nationkey", ch.key_summary(["n_nationkey", "n_name"]).alias("summary"))


DDL = [
    "ALTER TABLE `t` ADD COLUMN `a` varchar(10) DEFAULT 'x,y' NOT NULL, ADD b decimal(40,4) unsigned FIRST", "alter table db2.t change column old new bigint after id, modify c int, drop column d, add index i (c), rename column e to f",
    "DROP TABLE IF EXISTS `a`, b", "TRUNCATE x", "CREATE TABLE IF NOT EXISTS q.t (a int)", "CREATE INDEX i ON t (a)",
]


@query("""SELECT * FROM (VALUES (0, 0, 'db.t', 'add', 'a', 'last', 'varchar(10)'), (0, 1, 'db.t', 'add', 'b', 'first', 'decimal(40,4) unsigned'), (1, 0, 'db2.t', 'rename', 'old', '', ''), (1, 1, 'db2.t', 'alter', 'new', 'after:id', 'bigint'),
    (1, 2, 'db2.t', 'alter', 'c', '', 'int'), (1, 3, 'db2.t', 'drop', 'd', '', ''), (1, 4, 'db2.t', 'rename', 'e', '', ''), (2, 0, 'db.a', 'drop-table', '', '', ''), (2, 1, 'db.b', 'drop-table', '', '', ''), (3, 0, 'db.x', 'truncate', '', '', ''), (4, 0, 'q.t', 'create', '', '', '')) AS d(statement, place, name, action, col, position, type)""")
def ddl_changes(spark, sf_dir):
    return listed(spark, "statement int, place int, name, action, col, position, type", [(i, k, f"{c.schema}.{c.table}", c.action, c.name, c.place, c.column.full if c.column else "") for i, x in enumerate(DDL) for k, c in enumerate(sc.parse_ddl(x, "db"))])


@query("""SELECT * FROM (VALUES ('add', 'id int,x string,n int'), ('widen', 'id int,n bigint'), ('narrow', 'error'), ('drop', 'error'), ('drop allowed', 'id int'), ('rename', 'error'), ('rename allowed', 'key1 int,n int'), ('table', 'id int,n int')) AS d(what, columns)""")
def ddl_applied(spark, sf_dir):
    df = spark.createDataFrame([], "id int, n int")
    cases = [("add", "ADD x varchar(5) AFTER id", {}), ("widen", "MODIFY n bigint", {}), ("narrow", "MODIFY n date", {}), ("drop", "DROP n", {}), ("drop allowed", "DROP n", {"allow_drop": True}), ("rename", "RENAME COLUMN id TO key1", {}), ("rename allowed", "RENAME COLUMN id TO key1", {"allow_rename": True})]
    rows = [(n, tried(lambda: ",".join(" ".join(c) for c in sc.apply_changes(df, sc.parse_ddl(f"ALTER TABLE t {x}"), **o).dtypes))) for n, x, o in cases]  # noqa: B023
    return listed(spark, "what, columns", [*rows, ("table", ",".join(" ".join(c) for c in sc.apply_changes(df, sc.parse_ddl("TRUNCATE t")).dtypes))])


@query("SELECT * FROM (VALUES (0, 'z', 'int', false), (1, 'id', 'bigint', true), (2, 'name', 'varchar', false)) AS d(place, name, kind, key)")
def evolved_source(spark, sf_dir):
    own = sc.evolve_source([ty.SourceColumn("id", "int", key=True), ty.SourceColumn("n", "varchar"), ty.SourceColumn("old", "int")], sc.parse_ddl("ALTER TABLE t MODIFY id bigint, ADD z int FIRST, RENAME COLUMN n TO name, DROP old"))
    return listed(spark, "place int, name, kind, key boolean", [(i, c.name, c.kind, c.key) for i, c in enumerate(own)])


@query("""SELECT * FROM (VALUES ('string', 'bigint', true, false), ('bigint', 'int', true, false), ('int', 'bigint', false, true), ('double', 'float', true, false), ('float', 'double', false, true), ('decimal(10,0)', 'int', true, false), ('decimal(18,0)', 'bigint', false, false),
    ('decimal(12,2)', 'decimal(10,2)', true, false), ('decimal(10,2)', 'decimal(12,2)', false, true), ('int', 'string', false, false), ('int', 'boolean', false, false)) AS d(have, want, holds, widens)""")
def type_lattice(spark, sf_dir):
    pairs = [("string", "bigint"), ("bigint", "int"), ("int", "bigint"), ("double", "float"), ("float", "double"), ("decimal(10,0)", "int"), ("decimal(18,0)", "bigint"), ("decimal(12,2)", "decimal(10,2)"), ("decimal(10,2)", "decimal(12,2)"), ("int", "string"), ("int", "boolean")]
    kind = T._parse_datatype_string
    return listed(spark, "have, want, holds boolean, widens boolean", [(a, b, ty.can_represent(kind(a), kind(b)), ty.should_widen(kind(a), kind(b))) for a, b in pairs])


@query("""SELECT * FROM (VALUES ('VARCHAR(10)', 'STRING', false, true), ('STRING', 'VARCHAR(9)', true, false), ('BIGINT', 'INT', true, false), ('SMALLINT', 'LARGEINT', false, true), ('DECIMAL(10,2)', 'DECIMAL(10,4)', false, false), ('DECIMALV3(12,4)', 'DECIMAL(10,2)', true, false), ('text', 'string', true, false), ('DATETIMEV2(6)', 'datetime', true, false)) AS d(have, want, holds, widens)""")
def warehouse_lattice(spark, sf_dir):
    pairs = [("VARCHAR(10)", "STRING"), ("STRING", "VARCHAR(9)"), ("BIGINT", "INT"), ("SMALLINT", "LARGEINT"), ("DECIMAL(10,2)", "DECIMAL(10,4)"), ("DECIMALV3(12,4)", "DECIMAL(10,2)"), ("text", "string"), ("DATETIMEV2(6)", "datetime")]
    return listed(spark, "have, want, holds boolean, widens boolean", [(a, b, ty.warehouse_holds(a, b), ty.warehouse_widens(a, b)) for a, b in pairs])


@query("""SELECT * FROM (VALUES ('tinyint', 'tinyint(1)', 'boolean', 'BOOLEAN'), ('tinyint', 'tinyint(1) unsigned', 'int', 'BIGINT'), ('bit', 'bit(1)', 'boolean', 'BOOLEAN'), ('bit', 'bit(8)', 'binary', 'STRING'), ('year', 'year', 'int', 'BIGINT'), ('int', 'int unsigned', 'bigint', 'BIGINT'),
    ('bigint', 'bigint unsigned', 'decimal(20,0)', 'BIGINT'), ('bigint', 'bigint', 'bigint', 'BIGINT'), ('json', 'json', 'string', 'STRING'), ('mediumblob', 'mediumblob', 'binary', 'STRING'), ('datetime', 'datetime', 'timestamp_ntz', 'DATETIME')) AS d(kind, full_type, lake, warehouse)""")
def column_types(spark, sf_dir):
    own = [("tinyint", "tinyint(1)"), ("tinyint", "tinyint(1) unsigned"), ("bit", "bit(1)"), ("bit", "bit(8)"), ("year", "year"), ("int", "int unsigned"), ("bigint", "bigint unsigned"), ("bigint", "bigint"), ("json", "json"), ("mediumblob", "mediumblob"), ("datetime", "datetime")]
    return listed(spark, "kind, full_type, lake, warehouse", [(k, f, ty.lake_type(c).simpleString(), ty.warehouse_type(c)) for k, f in own for c in [ty.SourceColumn("c", k, f)]])


@query("""SELECT * FROM (VALUES ('widen and add', 'MODIFY COLUMN `name` VARCHAR(50) NULL; ADD COLUMN `note` STRING NULL'), ('key missing', 'error'), ('other key', 'error'), ('wider stays', ''), ('null', 'MODIFY COLUMN `name` VARCHAR(80) NULL')) AS d(what, statements)""")
def warehouse_plan(spark, sf_dir):
    c, id_ = ty.SourceColumn, ty.SourceColumn("id", "bigint", key=True)
    name, note = c("name", "varchar", length=50), c("note", "text")
    cases = [("widen and add", {"id": ("BIGINT", False), "name": ("VARCHAR(20)", True)}, ["id"], [id_, name, note]), ("key missing", {"name": ("STRING", True)}, ["id"], [id_, name]), ("other key", {"id": ("BIGINT", False), "name": ("STRING", True)}, ["name"], [id_, name]),
             ("wider stays", {"id": ("LARGEINT", False), "name": ("STRING", True)}, ["id"], [id_, name]), ("null", {"id": ("BIGINT", False), "name": ("VARCHAR(80)", False)}, ["id"], [id_, name])]
    return listed(spark, "what, statements", [(n, tried(lambda: "; ".join(sc.plan_warehouse(h, k, w)))) for n, h, k, w in cases])  # noqa: B023


@query("""SELECT * FROM (VALUES ('ADD a int AFTER b', 'ALTER TABLE d.t ADD COLUMN `a` BIGINT NULL AFTER `b`'), ('DROP COLUMN c', 'ALTER TABLE d.t DROP COLUMN `c`'), ('RENAME COLUMN a TO b', 'ALTER TABLE d.t RENAME COLUMN `a` `b`'), ('MODIFY c varchar(9)', 'ALTER TABLE d.t MODIFY COLUMN `c` VARCHAR(9)')) AS d(clause, statement)""")
def warehouse_statements(spark, sf_dir):
    return listed(spark, "clause, statement", [(x, "; ".join(sc.warehouse_ddl(sc.parse_ddl(f"ALTER TABLE t {x}"), "d.t"))) for x in ("ADD a int AFTER b", "DROP COLUMN c", "RENAME COLUMN a TO b", "MODIFY c varchar(9)")])


@query("""SELECT * FROM (VALUES ('keyed', 'CREATE TABLE IF NOT EXISTS d.t (`id` BIGINT NOT NULL, `a_b` STRING) UNIQUE KEY(`id`) DISTRIBUTED BY HASH(`id`) BUCKETS 10'),
    ('no key', 'CREATE TABLE IF NOT EXISTS d.t (`n` DECIMAL(27,9), `a_b` STRING) UNIQUE KEY(`n`) DISTRIBUTED BY HASH(`n`) BUCKETS 10'), ('empty', 'error')) AS d(what, statement)""")
def warehouse_tables(spark, sf_dir):
    a_b, id_ = ty.SourceColumn("a b", "text"), ty.SourceColumn("id", "bigint", nullable=False, key=True)
    cases = [("keyed", [a_b, id_]), ("no key", [ty.SourceColumn("n", "double"), a_b]), ("empty", [])]
    return listed(spark, "what, statement", [(n, tried(cf.create_warehouse_table, "d", "t", c)) for n, c in cases])


@query("""SELECT * FROM (VALUES ('time and number', 'CALL c.system.expire_snapshots(table => ''n.t'', older_than => TIMESTAMP ''2024-01-01'', retain_last => 5)'), ('map', 'CALL c.system.rewrite_data_files(table => ''n.t'', options => map(''a'', ''1''), strategy => ''binpack'')'),
    ('procedure', 'error'), ('option', 'error')) AS d(what, statement)""")
def call_statements(spark, sf_dir):
    cases = [("time and number", "expire_snapshots", {"retain_last": 5, "older_than": "2024-01-01"}), ("map", "rewrite_data_files", {"strategy": "binpack", "options": {"a": 1}}), ("procedure", "drop_table", {}), ("option", "expire_snapshots", {"x": 1})]
    return listed(spark, "what, statement", [(n, tried(mt.call_statement, "c", p, "n.t", o)) for n, p, o in cases])


@query("SELECT * FROM (VALUES (24, false, false, 'error'), (168, false, false, 'None'), (48, true, false, 'error'), (48, true, true, 'None'), (72, true, false, 'None')) AS d(hours, streaming, dry_run, result)")
def orphan_ages(spark, sf_dir):
    cases = [(24, False, False), (168, False, False), (48, True, False), (48, True, True), (72, True, False)]
    return listed(spark, "hours int, streaming boolean, dry_run boolean, result", [(*c, tried(mt.check_orphan_age, *c)) for c in cases])


@query("SELECT * FROM (VALUES ('a', 'running'), ('b', 'error'), ('c', 'waiting_for_snapshot'), ('d', 'inventory_pending'), ('e', 'healthy')) AS d(job, state)")
def state_rollup(spark, sf_dir):
    states = {"a": ["ready", "running", "error"], "b": ["error", "ready"], "c": ["waiting_for_snapshot"] * 2, "d": ["waiting_for_snapshot", "inventory_pending"], "e": ["healthy"]}
    parts = [mt.rollup(spark.createDataFrame([(x,) for x in v], "state string")).select(F.lit(k).alias("job"), "state") for k, v in states.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT * FROM (VALUES ('running', 'pause', 'paused'), ('paused', 'pause', 'paused'), ('paused', 'resume', 'running'), ('failed', 'resume', 'failed'), ('queued', 'cancel', 'cancelled'), ('done', 'delete', 'deleted'), ('running', 'delete', 'running')) AS d(before, action, state)""")
def job_control(spark, sf_dir):
    cases = [("running", "pause"), ("paused", "pause"), ("paused", "resume"), ("failed", "resume"), ("queued", "cancel"), ("done", "delete"), ("running", "delete")]
    out = None
    for b, a in cases:
        one = ops.control(listed(spark, "state", [(b,)]), a, F.lit(0)).select(F.lit(b).alias("before"), F.lit(a).alias("action"), "state")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT * FROM (VALUES (200, 0, 0, 0, false, true), (1, 134217728, 0, 0, false, true), (1, 1, 30, 0, false, true), (1, 1, 29, 29, false, false), (1, 1, 10, 0, true, true), (0, 0, 99, 99, false, false)) AS d(n, size, oldest, idle, waits, due)""")
def flush_policy(spark, sf_dir):
    cases = [(200, 0, 0, 0, False), (1, 128 << 20, 0, 0, False), (1, 1, 30, 0, False), (1, 1, 29, 29, False), (1, 1, 10, 0, True), (0, 0, 99, 99, False)]
    return listed(spark, "n int, size int, oldest int, idle int, waits boolean, due boolean", [(*c, FlushPolicy().due(*c)) for c in cases])


@query("SELECT * FROM (VALUES (0, 'compact', 'a', 't'), (1, 'compact', 'a', 'u'), (2, 'expire', 'a', 't'), (3, 'expire', 'a', 'u')) AS d(place, operation, namespace, name)")
def expanded_targets(spark, sf_dir):
    return listed(spark, "place int, operation, namespace, name", [(i, *x) for i, x in enumerate(ops.expand_targets(["compact", "expire", "compact"], [" a ", ""], ["t", "u "]))])


@query("SELECT * FROM (VALUES ('same in another order', true), ('executor of deletes', true), ('another mode', false), ('another source', false)) AS d(what, same)")
def meta_keys(spark, sf_dir):
    own = cf.meta_key("j", "initial", {"a": 1, "b": [2]}, {"x": {"y": 1, "cdc_delete_executor": "trino"}})
    other = {"same in another order": ("j", "initial", {"b": [2], "a": 1}, {"x": {"cdc_delete_executor": "trino", "y": 1}}), "executor of deletes": ("j", "initial", {"a": 1, "b": [2]}, {"x": {"y": 1}}), "another mode": ("j", "latest", {"a": 1, "b": [2]}, {"x": {"y": 1}}), "another source": ("j", "initial", {"a": 2, "b": [2]}, {"x": {"y": 1}})}
    return listed(spark, "what, same boolean", [(k, cf.meta_key(*v) == own) for k, v in other.items()])


@query("SELECT * FROM (VALUES ('at last', 'ok after 0.5,1.0,2.0'), ('too often', 'failed after 0.5,1.0'), ('permanent', 'permanent after '), ('long', 'ok after 0.5,1.0,2.0,4.0,8.0,10.0,10.0')) AS d(what, waited)")
def retries(spark, sf_dir):
    def run(fails: int, attempts: int, kind: type) -> str:
        waits, left = [], [fails]

        def once() -> str:
            left[0] -= 1
            if left[0] >= 0:
                raise kind("no")
            return "ok"

        try:
            out = cf.retry(once, attempts=attempts, sleep=lambda x: waits.append(str(x)))
        except cf.PermanentError:
            out = "permanent"
        except OSError:
            out = "failed"
        return f"{out} after {','.join(waits)}"

    return listed(spark, "what, waited", [("at last", run(3, 0, OSError)), ("too often", run(9, 3, OSError)), ("permanent", run(9, 0, cf.PermanentError)), ("long", run(7, 0, OSError))])


@query("SELECT * FROM (VALUES ('trino', 'trino'), (' Equality ', 'equality'), ('', 'error'), ('native', 'error')) AS d(given, executor)")
def delete_executors(spark, sf_dir):
    return listed(spark, "given, executor", [(x, tried(cf.delete_executor, x)) for x in ("trino", " Equality ", "", "native")])


@query("SELECT * FROM (VALUES ('mapped', 'created_at=made'), ('named', 'updated_at=changed,etl_loaded_at=etl_loaded_at'), ('none', '')) AS d(what, names)")
def metadata_settings(spark, sf_dir):
    cases = {"mapped": {"created_at": {"source": "x", "name": "made"}}, "named": {"updated_at": {"enabled": True, "name": " changed "}, "etl_loaded_at": {"enabled": True}}, "none": {"created_at": {"name": "x"}}}
    return listed(spark, "what, names", [(k, ",".join(f"{a}={b}" for a, b in cf.metadata_names(v).items())) for k, v in cases.items()])


@query("SELECT * FROM (VALUES ('a', 'x + 1', 'bigint', 'bigint'), ('b', 'y', 'text', 'varchar(9)')) AS d(name, expression, type, column_type)")
def extra_columns(spark, sf_dir):
    given = [{"name": " a", "expression": "x + 1", "type": "bigint"}, {"name": "b", "expression": "y", "type": "text", "column_type": "varchar(9)"}, {"name": "", "expression": "z", "type": "int"}, {"name": "c", "type": "int"}]
    return listed(spark, "name, expression, type, column_type", [(x["name"], x["expression"], x["type"], x["column_type"]) for x in cf.extra_columns(given)])


@query("SELECT * FROM (VALUES ('a.b', 'a', 'b'), ('x.y.z', 'x.y', 'z'), ('none', 'error', ''), ('.t', 'error', '')) AS d(text, namespace, name)")
def target_names(spark, sf_dir):
    def parts(x: str) -> tuple[str, str]:
        try:
            return cf.split_target(x)
        except ValueError:
            return "error", ""

    return listed(spark, "text, namespace, name", [(x, *parts(x)) for x in ("a.b", "x.y.z", "none", ".t")])


@query("SELECT * FROM (VALUES ('dry_run', 'true'), ('older_than_hours', '80'), ('retain', '5')) AS d(name, value)")
def manual_settings(spark, sf_dir):
    own = cf.task_settings({"dry_run": "false", "older_than_hours": "168", "retain": "5"}, {"dry_run": "true", "older_than_hours": "80", "retain": "1", "x": "y"})
    return listed(spark, "name, value", sorted(own.items()))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day, year(o_orderdate) - 1970 AS year, CAST(floor(epoch(o_orderdate) / 3600) AS INTEGER) AS hour, o_orderstatus AS same, CAST(NULL AS VARCHAR) AS nothing FROM orders")
def partition_times(spark, sf_dir):
    at = F.col("o_orderdate")
    return t(spark, sf_dir, "orders").select("o_orderkey", s.partition_transform("day", at).alias("day"), s.partition_transform("year", at).cast("long").alias("year"), s.partition_transform("hour", at).alias("hour"), s.partition_transform("identity", F.col("o_orderstatus")).alias("same"), s.partition_transform("void", at).alias("nothing"))
