import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward(spark, table):
    """Nulls in any column, empty and long texts, repeated rows, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, "a b c\nd e f"), (None, None), (5, " \n\t"), (6, "é" * 300), (7, "é" * 300), (8, "x")]
    clash = {"h": "h", "g": "g", "at": "at", "n": "n", "key": "key", "k1": "k1", "rep": "rep", "mark": "mark", "component": "c", "score": "s", "n_words": "n", "kept": "k", "bucket": "b", "block": "b", "length": "l", "part": "p", "links": "l", "word": "w", "ids": "i", "y": "y", "fold": "f"}
    return table(rows).withColumns({k: F.lit(v) for k, v in clash.items()}).withColumn("nothing", F.lit(None).cast("string"))
