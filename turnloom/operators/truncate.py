"""Interrupted speech: words kept before a cut, and utterances placed in a clip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.bind import let, let_all
from turnloom.schemas import WORDS

#: Slack of the cut for words that end at it; the test for a cut inside a word has none.
EPSILON = 1e-6


def truncated(words: Column, cut: Column, marker: str = "-") -> Column:
    """Struct of kept words, text, whether words were dropped, and whether the cut fell inside one."""

    def cut_off(v: Column) -> Column:
        kept = F.filter(v["words"], lambda w: w["end_s"] <= v["cut"] + EPSILON)
        inside = F.exists(v["words"], lambda w: (w["start_s"] < v["cut"]) & (v["cut"] < w["end_s"]))
        return let_all(lambda u: named(v, u["kept"], u["inside"]), kept=kept, inside=inside)

    def named(v: Column, kept: Column, inside: Column) -> Column:
        texts = F.transform(kept, lambda w: w["text"])
        text = F.array_join(F.when(inside, F.concat(texts, F.array(F.lit(marker)))).otherwise(texts), " ")
        return F.struct(kept.alias("kept_words"), text.alias("text"), (F.size(kept) < F.size(v["words"])).alias("truncated"), inside.alias("mid_word"))

    return let_all(cut_off, words=words, cut=cut)


def shifted(words: Column, offset: Column) -> Column:
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), (w["start_s"] + offset).alias("start_s"), (w["end_s"] + offset).alias("end_s")))


def kept_seconds(duration: Column, cut: Column) -> Column:
    return F.when(cut.isNull(), duration).otherwise(F.least(duration, cut))


def placed(duration: Column, words: Column, text: Column, offset: Column, cut: Column, marker: str = "-") -> Column:
    """Struct start_s, end_s, text, words, truncated of a clip placed at ``offset`` and perhaps cut.

    Without word times the text stays whole, and any cut counts as truncation, even one at the clip's very end.
    """

    def put(v: Column) -> Column:
        bare = F.coalesce(F.size(v["words"]), F.lit(0)) <= 0
        kept = kept_seconds(v["duration"], v["cut"])
        return let(
            truncated(v["words"], F.coalesce(v["cut"], kept + 1.0), marker),
            lambda t: F.struct(
                v["offset"].alias("start_s"),
                (v["offset"] + kept).alias("end_s"),
                F.when(bare, v["text"]).otherwise(t["text"]).alias("text"),
                F.when(bare, F.array().cast(WORDS)).otherwise(shifted(t["kept_words"], v["offset"])).alias("words"),
                F.when(bare, v["cut"].isNotNull()).otherwise(t["truncated"]).alias("truncated"),
            ),
        )

    return let_all(put, duration=duration, words=words, text=text, offset=offset, cut=cut.cast("double"))
