import pytest
from pyspark.sql import functions as F


@pytest.fixture
def documents(spark):
    def make(rows, extra=False):
        """(doc_id, text, lang, source) rows; with ``extra``, columns whose names operators use themselves."""
        df = spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
        if extra:
            for name in ("id", "fp", "size", "shard", "key", "words", "line", "host", "score", "bits", "_text", "whole", "draw"):
                df = df.withColumn(name, F.lit(1))
        return df

    return make
