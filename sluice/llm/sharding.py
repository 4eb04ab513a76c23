"""Sharding by a weighted hash tree: regions, racks, shards.

A document descends level by level. At each node every child draws
``-ln(u) / weight`` from a hash of the document's key and the child's own name,
where a rack weighs what its shards do and a region what its racks do; the least
draw wins, which is a draw by weight. Only the children of the chosen node are
drawn for, so a row costs the sum of the fan-outs on its path, not the number
of shards. A draw depends on nothing but the key, the child and its weight: if
a weight changes, rows move at each level only into or out of the subtree that
holds it, and in all other subtrees every row stays. A shard that is added in a
region of its own takes rows only into itself.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """Equal shards, filling racks and regions in order."""
    return [Shard(s // (shards_per_rack * racks_per_region), s // shards_per_rack, s) for s in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region and rack of its own, so that rows move into it alone."""
    return [*tree, Shard(max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1, max(s.shard for s in tree) + 1, weight)]


def with_shard(df: DataFrame, key: str, tree: list[Shard], out: str, seed: str = "shards") -> DataFrame:
    """Add the struct (region, rack, shard) that the key falls to. Shards of weight 0 take nothing; ties go to the smaller number."""
    regions: dict[int, float] = {}
    racks: dict[str, dict[int, float]] = {}
    shards: dict[str, dict[int, float]] = {}
    for s in sorted(s for s in tree if s.weight > 0):
        regions[s.region] = regions.get(s.region, 0.0) + s.weight
        own = racks.setdefault(str(s.region), {})
        own[s.rack] = own.get(s.rack, 0.0) + s.weight
        shards.setdefault(f"{s.region}/{s.rack}", {})[s.shard] = s.weight
    if not regions:
        raise ValueError("no shard has a positive weight")
    listed = lambda children: F.array(*(F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in children.items()))
    below = lambda level, at: F.element_at(F.create_map(*(x for k, v in level.items() for x in (F.lit(k), listed(v)))), at)

    def least(children: Column, level: str, at: Column) -> Column:
        def draw(c: Column) -> Column:
            bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.col(key).cast("string"), at, c["id"]), 12)
            return F.struct((-F.log((bits + 1) / F.lit(float(1 << 52))) / c["weight"]).alias("draw"), c["id"].alias("id"))

        return F.array_min(F.transform(children, draw))["id"]

    df = df.withColumn("_region", least(listed(regions), "region", F.lit("")))
    df = df.withColumn("_rack", least(below(racks, F.col("_region").cast("string")), "rack", F.col("_region").cast("string")))
    path = F.concat_ws("/", "_region", "_rack")
    df = df.withColumn("_shard", least(below(shards, path), "shard", path))
    return df.withColumn(out, F.struct(F.col("_region").alias("region"), F.col("_rack").alias("rack"), F.col("_shard").alias("shard"))).drop("_region", "_rack", "_shard")


def shard_documents(docs: DataFrame, *, shards: int = 16, tree: list[Shard] | None = None, grown_tree: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 100_000, seed: str = "shards") -> DataFrame:
    """Place every document and number the documents of each shard from 0.

    Law ``key``: the document's id and the tree decide the shard. Returns
    ``id_col``, size (UTF-8 bytes + 1; a null text has none, so 1),
    text_crc32 (unsigned; null for a null text), law, region, rack, shard, slot
    and grown_shard (with one more shard).

    Rows with equal id, size and checksum are counted first and numbered as one
    row. Slots are counted in hash buckets of about ``rows_per_bucket`` rows
    within each shard, then shifted by the rows of the buckets before, so no
    task holds a whole shard, whatever repeats. Repeated rows get slots of
    their own; null ids are a key like any other; an empty table gives an empty
    result; other columns are not read.
    """
    tree = tree or topology(shards)
    grown_tree = grown_tree or grown(tree)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"))
    rows = checkpointed(rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n")))
    all_ = rows.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    buckets = max(1, -(-(all_["rows"] or 0) // (rows_per_bucket * max(1, len(tree)))))
    bucket = F.pmod(F.xxhash64(F.lit(seed + " slots"), "id", "crc", "size"), F.lit(buckets))
    placed = with_shard(with_shard(rows, "id", tree, "at", seed), "id", grown_tree, "grown", seed)
    placed = placed.select("id", "size", "crc", "n", F.col("at.region").alias("region"), F.col("at.rack").alias("rack"), F.col("at.shard").alias("shard"), F.col("grown.shard").alias("grown_shard"), bucket.alias("bucket"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("shard", "bucket").orderBy("id", "crc", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = placed.withColumn("inside", inside).join(offsets, ["shard", "bucket"]).withColumn("first", F.col("offset") + F.col("inside"))
    if (all_["most"] or 0) > rows_per_bucket:  # what repeats very often is counted out by many tasks
        first = first.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rows_per_bucket).cast("long"))))
        first = first.withColumns({"first": F.col("first") + F.col("_from"), "n": F.least(F.col("n") - F.col("_from"), F.lit(rows_per_bucket))}).repartition("id", "_from")
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    return first.select(F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("key").alias("law"), "region", "rack", "shard", slot.alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, *, tree: list[Shard] | None = None, shards: int = 16, id_col: str = "doc_id", files_per_shard: int = 8, seed: str = "shards") -> None:
    """Write the documents, all columns, to folders region=/rack=/shard= below ``path``.

    A folder level whose name is one of the table's columns has underscores
    before it. Null ids are a key like any other, texts may be null, repeated
    rows are all written, and an empty table gives an empty folder.
    """
    names = []
    for n in ("region", "rack", "shard"):
        while n.lower() in {c.lower() for c in docs.columns}:
            n = f"_{n}"
        names.append(n)
    key = F.col(id_col).cast("string")
    held = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), F.xxhash64(F.lit(seed), *(F.col(c).cast("string") for c, k in docs.dtypes if not k.startswith(("map", "variant")))).alias("salt"))
    placed = with_shard(held, "key", tree or topology(shards), "at", seed)
    placed = placed.repartition(F.col("at.shard"), F.pmod("salt", F.lit(files_per_shard))).select("row.*", *(F.col(f"at.{level}").alias(n) for level, n in zip(("region", "rack", "shard"), names, strict=True)))
    placed.write.partitionBy(*names).parquet(path)
