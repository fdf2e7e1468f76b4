"""Sentences from lists, files, articles and prompts, and the endless feed over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.text import clean_markup, sentences
from turnloom.plans.registry import TEXT_SOURCES

PAYLOAD = "query struct<pages:map<string,struct<extract:string>>>"


@TEXT_SOURCES.register("static")
def static(spark: SparkSession, sentences: Sequence[str]) -> DataFrame:
    """(ord, sentence): the list as it is."""
    return spark.createDataFrame(list(enumerate(sentences)), "ord long, sentence string")


def numbered(texts: DataFrame) -> DataFrame:
    """(ord, sentence) of (ord, text): sentences in order of text and place. Places are numbered within texts, so ord has gaps."""
    return texts.select("ord", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).select((F.col("ord") * (1 << 32) + F.col("pos")).alias("ord"), "sentence")


@TEXT_SOURCES.register("plain_file")
def plain_file(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("ord"), F.col("value").alias("text")))


def extract(payload: Column) -> Column:
    """The article's text in an API's JSON answer: the first page's extract, "" if it has none."""
    pages = F.map_values(F.from_json(payload, PAYLOAD)["query"]["pages"])
    return F.coalesce(F.get(pages, F.lit(0))["extract"], F.lit(""))


@TEXT_SOURCES.register("wikipedia")
def wikipedia(spark: SparkSession, titles: Sequence[str], fetch: Callable[[str], str]) -> DataFrame:
    """Sentences of articles in order of the titles. ``fetch`` gives an answer's JSON for a title and runs in the tasks."""
    ask = F.udf(fetch, "string")
    rows = spark.createDataFrame(list(enumerate(titles)), "ord long, title string")
    return numbered(rows.select("ord", clean_markup(extract(ask("title"))).alias("text")))


@TEXT_SOURCES.register("llm")
def llm(spark: SparkSession, prompts: Sequence[str], generate: Callable[[str], str]) -> DataFrame:
    """Sentences of what ``generate`` makes of each prompt, anew in each run of the plan."""
    ask = F.udf(generate, "string").asNondeterministic()
    rows = spark.createDataFrame(list(enumerate(prompts)), "ord long, prompt string")
    return numbered(rows.select("ord", ask("prompt").alias("text")))


def endless(wanted: DataFrame, feed: DataFrame, place: str = "i") -> DataFrame:
    """``wanted`` (place) with the feed's sentences over and over, in order. An empty feed gives no rows.

    Sentences are ranked in parts of their order and the parts' sizes summed, so no window holds the whole feed.
    """
    from pyspark.sql import Window

    part = F.floor(F.col("ord") / 4096)
    sizes = feed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = feed.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("ord")) - 1).join(sizes, "part").select((F.col("r") + F.col("base")).alias("_k"), "sentence")
    n = feed.count()
    if not n:
        return wanted.withColumn("sentence", F.lit(None).cast("string")).where("false")
    return wanted.withColumn("_k", F.pmod(F.col(place), F.lit(n))).join(ranked, "_k").drop("_k")
