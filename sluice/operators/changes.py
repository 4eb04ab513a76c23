"""Change-stream algebra: ordered changes to a delta of deletes and upserts.

A feed has the columns pos (total order), op (INSERT, UPDATE, DELETE), the key
columns, the old key columns (``old_<key>``, null where the change carries no
old image) and any payload.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OLD = "old_"


def touches(feed: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """What each change does to keys, as rows of (key, order, sub, touch): first D on the old key, then U on the new."""
    old = [F.coalesce(F.col(OLD + k), F.col(k)).alias(k) if OLD + k in feed.columns else F.col(k) for k in keys]
    both = F.array(F.struct(F.lit(0).alias("sub"), F.lit("D").alias("touch"), *old), F.struct(F.lit(1).alias("sub"), F.lit("U").alias("touch"), *(F.col(k) for k in keys)))
    each = F.when(F.col("op") == "DELETE", F.slice(both, 1, 1)).otherwise(both)
    rest = [c for c in feed.columns if c not in keys]
    return feed.select(*rest, F.explode(each).alias("_t")).select(*rest, "_t.sub", "_t.touch", *(F.col(f"_t.{k}").alias(k) for k in keys))


def last_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def live_rows(feed: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Rows that the changes leave: the last touch of the key is an upsert. One shuffle, on the key."""
    last = last_of(touches(feed, keys, order), keys, F.desc(order), F.desc("sub"))
    return last.where("touch = 'U'").drop("sub", "touch", *(OLD + k for k in keys))


def delete_keys(feed: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Keys that the changes delete, with the last position and the number of images; combined before the shuffle."""
    return touches(feed, keys, order).where("touch = 'D'").groupBy(*keys).agg(F.max(order).alias("last_pos"), F.count("*").alias("images"))


def delete_images(feed: DataFrame, keys: list[str], image: Column, order: str = "pos") -> DataFrame:
    """Deleted keys with the images that each had when it was deleted or replaced, in order and the last one."""
    gone = touches(feed.withColumn("_image", image), keys, order).where("touch = 'D'")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_image").alias("i")))), lambda x: x["i"])
    return gone.groupBy(*keys).agg(listed.alias("images")).withColumn("last_image", F.element_at("images", -1))


def ddl_epochs(feed: DataFrame, ddl: DataFrame, table: str = "table_name", order: str = "pos") -> DataFrame:
    """Add ``epoch``, the DDL statements of the table before each change: a barrier, between which changes may be reduced together.

    Only the statements are put in order; changes meet the few of their table.
    """
    own = W.partitionBy(table).orderBy(order)
    since = ddl.select(table, F.col(order).alias("_from"), F.lead(order).over(own).alias("_to"), F.row_number().over(own).alias("_epoch"))
    since = since.withColumnRenamed(table, "_table")
    during = (F.col(table) == F.col("_table")) & (F.col(order) > F.col("_from")) & (F.col("_to").isNull() | (F.col(order) <= F.col("_to")))
    return feed.join(since, during, "left").withColumn("epoch", F.coalesce("_epoch", F.lit(0))).drop("_table", "_from", "_to", "_epoch")


def reduce_tables(events: DataFrame, keys: list[str], table: str = "table_name", order: str = "pos") -> DataFrame:
    """Corrections of many tables reduced at once: (table, key) stands for the key. DDL among them is an error when rows are read."""
    ddl = F.raise_error(F.concat(F.lit("corrections can't have DDL: "), F.col(table).cast("string"))).cast("string")
    return live_rows(events.withColumn("op", F.when(F.col("op") == "DDL", ddl).otherwise(F.col("op"))), [table, *keys], order)


def require_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fails, when rows are read, on a null key; a missing column fails at once."""
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"key columns {missing} are missing")
    null = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    return df.withColumn(keys[0], F.when(null, F.raise_error(F.lit("a key is null")).cast(df.schema[keys[0]].dataType)).otherwise(F.col(keys[0])))


def merge_rows(feed: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Merge on the new key only, with a delete marker: the last change of a key wins and old keys stay."""
    return last_of(feed, keys, F.desc(order)).where("op <> 'DELETE'")


def with_delete_marker(feed: DataFrame, name: str = "__deleted") -> DataFrame:
    return feed.withColumn(name, (F.col("op") == "DELETE").cast("int"))


def partition_groups(images: DataFrame, keys: list[str], partition: Column, name: str = "part") -> DataFrame:
    """Deleted keys by partition of their images: a key that moved is in each partition that it was in."""
    return images.select(partition.alias(name), *keys).distinct()


def changed_columns(columns: list[str], old: str = OLD, most: int = 8) -> Column:
    """Names of the columns that differ, `,...` after the first ``most`` and `-` for none."""
    names = F.array_compact(F.array(*(F.when(~F.col(old + c).eqNullSafe(F.col(c)), F.lit(c)) for c in columns)))
    listed = F.concat_ws(",", F.slice(names, 1, most))
    return F.when(F.size(names) == 0, "-").when(F.size(names) > most, F.concat(listed, F.lit(",..."))).otherwise(listed)


def decode_rows(events: DataFrame, rows: str = "rows") -> DataFrame:
    """One change a row from events whose rows are an array; an update has (old, new) pairs, so an even number."""
    size = F.size(rows)
    odd = (F.col("op") == "UPDATE") & (size % 2 == 1)
    steps = F.when(odd, F.raise_error(F.lit("an update has an odd number of rows")).cast("array<int>")).when(size == 0, F.array().cast("array<int>"))
    steps = steps.when(F.col("op") == "UPDATE", F.sequence(F.lit(0), size - 2, F.lit(2))).otherwise(F.sequence(F.lit(0), size - 1))
    each = events.withColumn("_i", F.explode(steps))
    update, delete = F.col("op") == "UPDATE", F.col("op") == "DELETE"
    before = F.when(update | delete, F.get(rows, F.col("_i")))
    new = F.when(update, F.get(rows, F.col("_i") + 1)).when(~delete, F.get(rows, F.col("_i")))
    return each.withColumns({"before": before, "after": new, "row": F.when(update, (F.col("_i") / 2).cast("int")).otherwise(F.col("_i"))}).drop("_i", rows)


def trace_id(file: Column, pos: Column, row: Column) -> Column:
    return F.concat_ws(":", file, pos, row)


def key_summary(keys: list[str]) -> Column:
    return F.concat_ws(",", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys))
