"""Word times: by length, by equal shares, from a recogniser's segments, from a TextGrid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.bind import let, let_all
from turnloom.functions.text import words
from turnloom.schemas import WORDS


def _word(text: Column, start: Column, end: Column) -> Column:
    return F.struct(text.alias("text"), start.alias("start_s"), end.alias("end_s"))


def proportional(text: Column, duration: Column) -> Column:
    """Words with times from 0 to ``duration``, each as long as its share of the letters; the last ends exactly there.

    A blank text raises.
    """
    letters = lambda w: F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("double")
    start = lambda v: F.struct(F.lit(0.0).alias("at"), F.array().cast(WORDS).alias("done"))

    def put(v: Column, total: Column) -> Callable[[Column, Column], Column]:
        def step(a: Column, x: Column) -> Column:
            end = F.when(F.size(a["done"]) == F.size(v["w"]) - 1, v["d"]).otherwise(a["at"] + v["d"] * F.length(x) / total)
            return let(end, lambda e: F.struct(e.alias("at"), F.concat(a["done"], F.array(_word(x, a["at"], e))).cast(WORDS).alias("done")))

        return step

    def timed(v: Column) -> Column:
        return F.when(F.size(v["w"]) > 0, let(letters(v["w"]), lambda total: F.aggregate(v["w"], start(v), put(v, total))["done"])).otherwise(F.raise_error("a blank text has no words to align").cast(WORDS))

    return let_all(timed, w=words(text), d=duration)


def even(text: Column, start: Column, end: Column) -> Column:
    """Words with equal shares of the utterance's time; a blank text has none."""

    def timed(v: Column) -> Column:
        span = (v["e"] - v["s"]) / F.greatest(F.size(v["w"]), F.lit(1))
        return let_all(lambda u: F.transform(v["w"], lambda x, i: _word(x, u["s"] + i * u["span"], u["s"] + (i + 1) * u["span"])), s=v["s"], span=span)

    return let_all(timed, w=words(text), s=start, e=end)


def timed_words(existing: Column, text: Column, start: Column, end: Column) -> Column:
    """The utterance's own words where it has some, else equal shares."""
    return F.when(F.size(existing) > 0, existing).otherwise(even(text, start, end))


def clamped(tokens: Column, segments: Column, duration: Column) -> Column:
    """Words from a recogniser's (start_s, end_s) segments: monotone, not overlapping, within the clip."""
    pairs = F.arrays_zip(tokens.alias("t"), segments.alias("s"))
    empty = F.array().cast(WORDS)

    def put(done: Column, x: Column) -> Column:
        cursor = F.coalesce(F.get(done, F.size(done) - 1)["end_s"], F.lit(0.0))
        begin = F.least(F.greatest(x["s"]["start_s"], cursor), duration)
        return F.concat(done, F.array(_word(x["t"], begin, F.least(F.greatest(x["s"]["end_s"], begin), duration))).cast(WORDS))

    return F.when(F.size(tokens) == F.size(segments), F.aggregate(pairs, empty, put)).otherwise(F.raise_error("tokens and segments differ in number").cast(WORDS))


#: Labels of intervals without speech. Fixed values.
SILENCE = ("", "sil", "sp", "spn")
_ITEM = r"(?s)item \[\d+\]:(.*?)(?=item \[\d+\]:|\z)"
_INTERVAL = r'(?s)intervals \[\d+\]:\s*xmin = ([\d.]+)\s*xmax = ([\d.]+)\s*text = "(.*?)"'


def textgrid_words(raw: Column, tier: str = "words") -> Column:
    """Words of a TextGrid's interval tier, silence left out; no such tier or no word raises."""
    items = F.regexp_extract_all(raw, F.lit(_ITEM), F.lit(1))
    own = F.get(F.filter(items, lambda x: F.regexp_extract(x, r'name = "(.*?)"', 1) == tier), F.lit(0))

    def cells(block: Column) -> Column:
        at = lambda i: F.regexp_extract_all(block, F.lit(_INTERVAL), F.lit(i))
        rows = F.transform(F.arrays_zip(at(1).alias("a"), at(2).alias("b"), at(3).alias("c")), lambda x: _word(x["c"], x["a"].cast("double"), x["b"].cast("double")))
        return F.filter(rows, lambda x: ~F.lower(F.trim(x["text"])).isin(*SILENCE))

    return let(let(own, cells), lambda got: F.when(F.size(got) > 0, got).otherwise(F.raise_error(f"no words in the {tier} tier").cast(WORDS)))
