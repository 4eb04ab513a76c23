import pytest
from pyspark.sql import types as T

from sluice.functions.types import SourceColumn, can_represent, key_columns, lake_type, should_widen, table_schema, warehouse_holds, warehouse_type, warehouse_widens
from sluice.operators.schema import apply_changes, evolve_source, parse_ddl, plan_warehouse, sync_schema, warehouse_ddl


def col(kind, full=None, **k):
    return SourceColumn("c", kind, full or kind, **k)


@pytest.mark.parametrize(
    ("column", "lake", "warehouse"),
    [
        (col("tinyint", "tinyint(1)"), T.BooleanType(), "BOOLEAN"),
        (col("tinyint", "tinyint(1) unsigned"), T.IntegerType(), "BIGINT"),
        (col("bit", "bit(1)"), T.BooleanType(), "BOOLEAN"),
        (col("bit", "bit(8)"), T.BinaryType(), "STRING"),
        (col("year"), T.IntegerType(), "BIGINT"),
        (col("int", "int unsigned"), T.LongType(), "BIGINT"),
        (col("bigint", "bigint unsigned"), T.DecimalType(20, 0), "BIGINT"),
        (col("bigint"), T.LongType(), "BIGINT"),
        (col("decimal", precision=65, scale=2), T.StringType(), "VARCHAR(67)"),
        (col("decimal", precision=10, scale=2), T.DecimalType(10, 2), "DECIMAL(10,2)"),
        (col("decimal"), T.DecimalType(38, 18), "DECIMAL(27,9)"),
        (col("datetime"), T.TimestampNTZType(), "DATETIME"),
        (col("varchar", length=70000), T.StringType(), "STRING"),
        (col("varchar", length=32), T.StringType(), "VARCHAR(32)"),
        (col("mediumblob"), T.BinaryType(), "STRING"),
        (col("json"), T.StringType(), "STRING"),
        (col("double", key=True), T.DoubleType(), "DECIMAL(27,9)"),
    ],
)
def test_types(column, lake, warehouse):
    assert lake_type(column) == lake and warehouse_type(column) == warehouse


def test_lattice():
    assert can_represent(T.StringType(), T.LongType()) and can_represent(T.LongType(), T.IntegerType()) and not can_represent(T.IntegerType(), T.LongType())
    assert can_represent(T.DecimalType(10, 0), T.IntegerType()) and not can_represent(T.DecimalType(18, 0), T.LongType())
    assert should_widen(T.IntegerType(), T.LongType()) and not should_widen(T.IntegerType(), T.BooleanType())
    assert warehouse_widens("VARCHAR(10)", "STRING") and warehouse_holds("BIGINT", "INT") and not warehouse_holds("DECIMAL(10,2)", "DECIMAL(10,4)")
    with pytest.raises(ValueError):
        key_columns([col("int")])
    assert not table_schema([col("int", key=True)]).fields[0].nullable


def test_ddl():
    a = parse_ddl("ALTER TABLE `t` ADD COLUMN `a` varchar(10) DEFAULT 'x,y' NOT NULL, ADD b decimal(40,4) unsigned FIRST", "db")
    assert [(c.action, c.name, c.place, c.column.full) for c in a] == [("add", "a", "last", "varchar(10)"), ("add", "b", "first", "decimal(40,4) unsigned")] and not a[0].column.nullable
    b = parse_ddl("alter table db.t change column old new bigint after id, modify c int, drop column d, add index i (c), rename column e to f")
    assert [(c.action, c.name) for c in b] == [("rename", "old"), ("alter", "new"), ("alter", "c"), ("drop", "d"), ("rename", "e")]
    assert b[1].place == "after:id" and b[2].place == "" and b[0].schema == "db"
    assert [c.action for c in parse_ddl("DROP TABLE IF EXISTS `a`, b")] == ["drop-table", "drop-table"]
    assert parse_ddl("TRUNCATE x")[0].action == "truncate" and parse_ddl("CREATE INDEX i ON t (a)") == [] and parse_ddl("CREATE TABLE IF NOT EXISTS q.t (a int)")[0].table == "t"


def test_evolution(spark):
    df = spark.createDataFrame([(1, 2)], "id int, n int")
    out = apply_changes(df, parse_ddl("ALTER TABLE t ADD x varchar(5) AFTER id, MODIFY n bigint, RENAME COLUMN id TO key1"), allow_rename=True)
    assert out.dtypes == [("key1", "int"), ("x", "string"), ("n", "bigint")]
    with pytest.raises(ValueError):
        apply_changes(df, parse_ddl("ALTER TABLE t DROP n"))
    src = evolve_source([SourceColumn("id", "int", key=True), SourceColumn("n", "int")], parse_ddl("ALTER TABLE t MODIFY id bigint, ADD z int FIRST"))
    assert [(c.name, c.kind, c.key) for c in src] == [("z", "int", False), ("id", "bigint", True), ("n", "int", False)]
    synced = sync_schema(df, T.StructType([T.StructField("ID", T.LongType()), T.StructField("note", T.StringType())]))
    assert synced.dtypes == [("id", "bigint"), ("n", "int"), ("note", "string")]


def test_warehouse_plan():
    want = [SourceColumn("id", "bigint", key=True), SourceColumn("name", "varchar", length=50), SourceColumn("note", "text")]
    plan = plan_warehouse({"id": ("BIGINT", False), "name": ("VARCHAR(20)", True)}, ["id"], want)
    assert plan == ["MODIFY COLUMN `name` VARCHAR(50) NULL", "ADD COLUMN `note` STRING NULL"]
    with pytest.raises(ValueError):
        plan_warehouse({"name": ("STRING", True)}, ["id"], want)
    with pytest.raises(ValueError):
        plan_warehouse({"id": ("BIGINT", False)}, ["name"], want)
    assert warehouse_ddl(parse_ddl("ALTER TABLE t ADD a int AFTER b, DROP COLUMN c"), "d.t") == ["ALTER TABLE d.t ADD COLUMN `a` BIGINT NULL AFTER `b`", "ALTER TABLE d.t DROP COLUMN `c`"]
    assert warehouse_ddl(parse_ddl("CREATE TABLE t (a int)"), "t") == []
