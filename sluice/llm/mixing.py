"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets are shares of a token budget, held to a multiple of each source's size,
with what is left over shared again. The budget is cut into blocks of equal
tokens; sources, and then the shards of each source, get whole numbers of
blocks by highest quotients votes / (2 seats + 1). In a shard of a source the
documents lie end to end in a seeded order, which begins again at its end; full
rounds take all, and the blocks that remain are a run of them from a seeded
block on, so that all but the documents at the run's two ends are taken whole.

Everything is a DataFrame expression. Windows run over a source's cells or over
one cell; the number of shards grows with the rows, so a cell of a source with
any share of the rows stays below ``rows_per_shard`` or so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, word_count


def seeded(*parts: Column | str) -> Column:
    """A non-negative integer below 2^32 drawn from the parts."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def apportion(df: DataFrame, group: list[str], tie: str, votes: str, seats: str, most: str, out: str) -> DataFrame:
    """Add ``out``: seats by highest quotients votes/(2n+1) in each group.

    Start from rounded shares, which the divisor method gives but for a few
    seats; then hand out the highest next quotients, or take back the lowest
    last ones, until the group's ``seats`` are met. No row gets more than
    ``most``; ties go to the smaller ``tie``.

    With N rows and ``short`` seats to hand out a row's share of ``short + N``
    and two more is all that the method can give it, unless others stop at
    ``most``: so that many quotients a row are compared, some ``short + 3 N``
    in all. Where a row comes to the end of its list, lists four times as long
    are tried.
    """
    over = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    whole = F.sum(votes).over(over)
    first = F.least(F.col(most), F.floor(F.coalesce(F.col(votes) * F.col(seats) / F.when(whole > 0, whole), F.lit(0.0)) + 0.5)).cast("long")
    by = list(dict.fromkeys([*group, tie]))
    df = df.withColumn("_first", first).withColumns({"_short": F.col(seats) - F.sum("_first").over(over), "_share": F.col(votes) / F.when(whole > 0, whole), "_rows": F.count("*").over(over)})
    missing, extra = F.col("_short") > 0, F.col("_short") < 0
    could = F.when(missing, F.least(F.col("_short"), F.col(most) - F.col("_first"))).when(extra, F.least(-F.col("_short"), F.col("_first"))).otherwise(F.lit(0))
    length = 1
    while True:
        listed = F.least(could, (F.floor(F.col("_share") * (F.abs("_short") + F.col("_rows"))) + 2) * length)
        tries = df.where((could > 0) & (F.col(votes) > 0)).select("*", could.alias("_could"), listed.alias("_listed"))
        tries = tries.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_listed") - 1)).alias("_j"))
        quotient = F.when(missing, F.col(votes) / (2 * (F.col("_first") + F.col("_j")) + 1)).otherwise(-F.col(votes) / (2 * (F.col("_first") - F.col("_j")) - 1))
        tries = tries.withColumn("_rank", F.row_number().over(over.orderBy(quotient.desc(), tie, "_j")))
        taken = tries.where(F.col("_rank") <= F.abs("_short")).groupBy(*by).agg(F.sum(F.signum("_short")).cast("long").alias("_change"), F.first("_listed").alias("_listed"), F.first("_could").alias("_could"))
        taken = checkpointed(taken)
        if taken.where((F.abs("_change") >= F.col("_listed")) & (F.col("_listed") < F.col("_could"))).isEmpty():
            break
        length *= 4
    return df.join(taken.select(*by, "_change"), by, "left").withColumn(out, F.col("_first") + F.coalesce("_change", F.lit(0))).drop("_first", "_short", "_share", "_rows", "_change")


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Add weight and target to (key, source, source_size).

    Weights repeat over the sources in code point order, null last. The budget
    is ``share`` of all sizes; a target stops at ``most`` times its source's
    size and the excess is shared again by weight. Sorted by size for weight,
    the capped sources come first, so the level at which the rest stand is
    found from running sums.
    """
    order = W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sources.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    every = W.partitionBy(F.lit(1))
    df = df.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    up = every.orderBy("_ratio", "key")
    capped = F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing))
    df = df.withColumn("_level", (F.col("budget") - capped) / left)
    level = F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(every)
    return df.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap")))).drop("_cap", "_ratio", "_level")


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block_tokens: int = 64, rows_per_shard: int = 50_000, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of every document.

    Returns ``id_col``, source, size (words; null text 0), source_size, target
    (of the source), shard, quota (blocks of the source's shard) and taken
    (words, repeats counted), one row for each input row.

    A null source is a source of its own, last in order. Repeated rows are
    separate documents; a row's place is drawn from its id and its text, so
    that neither an id nor a text that many rows have fills a shard. Texts without words are kept with taken 0. Where all
    sizes are 0, every target is 0. An empty table gives an empty result.
    Other columns, whatever their names, are not read.
    """
    shards = max(1, -(-docs.count() // rows_per_shard))
    source, key = F.col(source_col), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    text = F.col(text_col).cast("string")
    draw = seeded(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    sized = docs.select(F.col(id_col).alias("id"), source.cast("string").alias("source"), key.alias("key"), word_count(text).alias("size"), draw.alias("draw"))
    sized = checkpointed(sized.withColumn("shard", F.pmod("draw", F.lit(shards))))

    cells = checkpointed(sized.groupBy("key", "source", "shard").agg(F.sum("size").alias("cell_size")))
    by_source = targets(cells.groupBy("key", "source").agg(F.sum("cell_size").alias("source_size")), list(weights), share, most)
    blocks = F.lit(float(block_tokens))
    by_source = by_source.withColumn("seats", F.floor(F.col("budget") / blocks + 0.5)).withColumn("most", F.ceil(F.col("source_size") * most / blocks))
    by_source = apportion(by_source, [], "key", "target", "seats", "most", "source_quota")
    cells = cells.join(by_source.select("key", "source_size", "target", "source_quota"), "key")
    cells = cells.withColumn("blocks", F.ceil(F.col("cell_size") / blocks)).withColumn("most", F.col("blocks") * most)
    cells = apportion(cells, ["key"], "shard", "cell_size", "source_quota", "most", "quota")
    # a quota is that many times the block's tokens of the cell's line, which begins again at its end
    wanted = F.least(F.col("quota") * block_tokens, F.col("cell_size") * most).cast("long")
    length = F.greatest(F.col("cell_size"), F.lit(1))
    begin = F.pmod(seeded(seed, "run", F.col("key"), F.col("shard")), F.greatest(F.col("blocks"), F.lit(1))) * block_tokens
    cells = cells.select("key", "shard", "source_size", "target", "quota", "cell_size", F.floor(wanted / length).alias("rounds"), F.pmod(wanted, length).alias("rest"), begin.alias("at"))

    cell = W.partitionBy("key", "shard").orderBy("draw", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    laid = sized.withColumn("end", F.sum("size").over(cell)).withColumn("start", F.col("end") - F.col("size")).join(cells, ["key", "shard"])

    def inside(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("end"), hi) - F.greatest(F.col("start"), lo))

    until = F.col("at") + F.col("rest")
    taken = F.col("rounds") * F.col("size") + inside(F.col("at"), F.least(until, F.col("cell_size"))) + inside(F.lit(0), until - F.col("cell_size"))
    return laid.select(F.col("id").alias(id_col), "source", "size", "source_size", F.col("target").cast("double").alias("target"), "shard", "quota", taken.cast("long").alias("taken"))
