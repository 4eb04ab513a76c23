"""What the corpus operators share: reliable checkpoints and text rules."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, lower-cased without regard to other scripts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; where
    that is unset a temporary folder serves a session of one process, and any
    other is refused, as its executors share no local folder.
    A reliable checkpoint outlives any executor and is removed by Spark's
    cleaner when no plan refers to it any more.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


#: ASCII characters that aren't letters or digits part words.
PARTS = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
LONGEST = 48


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text; one of over ``LONGEST`` bytes comes in pieces."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(PARTS).split()
    if words and len(max(words, key=len)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
