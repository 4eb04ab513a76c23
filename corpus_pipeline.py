"""A corpus from raw documents: five stages, each applying one operator to all that came before.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontam, language, mixing, sharding, simhash
from sluice.llm.common import checkpointed, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that no language explains better than even draws of letters.

    A missing lang is filled in; a given one stays. Null and empty texts have
    no letter and go; repeated rows are judged alike; null ids stay; a tie
    between languages goes to the first name; without any labelled text nothing
    is known and all rows go. An empty table gives an empty result.
    """
    model = language.learn(docs, F.lit(True))
    found = language.identify(docs, model, keep=COLUMNS[1:])
    fits = (F.col("lang_pred") != "und") & (F.col("bits") < F.lit(model.uniform))
    return found.where(fits).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies: that with the least id, null last.

    Different texts under one id or null are different documents; null and
    empty texts are copies of one another. Rows equal in id and text are one
    document, of which any row stays.

    Candidates are SimHash links at 5 bits of one of three fingerprints, over
    distinct words and word pairs; a link holds where the sets of five-word
    shingles have a Jaccard similarity of 0.8 or more.
    """
    kept = checkpointed(simhash.representatives(docs.select(*COLUMNS)))
    keyed = docs.select(*COLUMNS, simhash.whole("text").alias("_whole"))

    def rows(some: DataFrame) -> DataFrame:
        return keyed.join(some, keyed["doc_id"].eqNullSafe(some["id"]) & (keyed["_whole"] == some["whole"]), "left_semi")

    left = rows(kept.where("n = 1"))
    if not (more := kept.where("n > 1")).isEmpty():
        left = left.unionByName(rows(more).dropDuplicates(["doc_id", "_whole"]))
    return left.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or a paraphrase of one.

    Texts are judged, whatever their ids: repeated rows of a text stay or go
    together, null and empty texts stay. An empty table, or an empty benchmark,
    changes nothing.
    """
    return decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it whole; a part of half or more counts as whole.

    Where ids repeat or more than one is null, a document is an id, a text and
    a source; rows that are equal in these get together what the mix takes of
    all. Null and empty texts, without words, can't be taken and go. An empty
    table gives an empty result.
    """
    docs = docs.select(*COLUMNS)
    row = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    ids = docs.agg(F.count("*").alias("n"), F.countDistinct(row).alias("d")).first()
    row = row if ids["n"] == ids["d"] else F.concat_ws("|", row, simhash.whole("text"), "source")
    docs = docs.withColumn("_row", row)
    taken = mixing.mix_sources(docs, id_col="_row").where("taken > 0").groupBy(F.col("_row").alias("_id")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = taken.select("_id", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_n")).where("_n > 0")
    mixed = docs.join(copies, docs["_row"] == copies["_id"])
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard of 16 by its id, and its slot there; nulls, repeats and empty tables as for `shard_documents`."""
    return sharding.shard_documents(docs, shards=16)


STAGES = [("language", identify_language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The language, SimHash and latent retrieval models can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i + 1 == len(STAGES) else checkpointed(docs)
    return docs
