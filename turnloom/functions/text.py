"""Text expressions: white space, sentences, markup, float text, tokens, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.isspace() accepts, as a Java character class. Fixed value.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What Python's str.splitlines() splits at. Fixed value.
LINE_BREAK = r"[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def squeezed(c: Column) -> Column:
    """Runs of ASCII white space as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def words(c: Column) -> Column:
    """Tokens between white space, as str.split() has them."""
    return F.filter(F.split(c, rf"{SPACE}+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Sentences: a text is cut at white space after . ! or ?, blanks dropped."""
    return F.filter(F.transform(F.split(strip(c), rf"(?<=[.!?]){SPACE}+"), strip), lambda s: s != "")


def clean_markup(c: Column) -> Column:
    """Without heading lines (== x ==) and reference markers ([1])."""
    heading = rf"(?md)^{SPACE}*=+.*?=+{SPACE}*$"
    return F.regexp_replace(F.regexp_replace(c, heading, ""), r"\[\d+\]", "")


def float_text(c: Column) -> Column:
    """The shortest text of a double that reads back the same, in positional form from 1e-4 up to 1e16.

    Digits are the JVM's: before Java 19 some values beyond 1e15, where no time lies, have one more than they need.
    """
    s = c.cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_extract(s, r"^-?([\d.]+)E", 1)
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), r"(?<=.)0+$", "")
    e = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    large = F.concat(F.rpad(digits, e + 1, "0"), F.lit(".0"))
    large = F.when(F.length(digits) > e + 1, F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.length(digits)))).otherwise(large)
    power = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(""), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    return (
        F.when(F.isnan(c), "nan")
        .when(s == "Infinity", "inf")
        .when(s == "-Infinity", "-inf")
        .when(~s.contains("E"), s)
        .when((e >= -4) & (e < 0), F.concat(sign, small))
        .when((e >= 0) & (e < 16), F.concat(sign, large))
        .otherwise(F.concat(sign, power))
    )


def ends_with_marker(c: Column, marker: str) -> Column:
    """Whether the text's last token is the truncation marker."""
    return (c == marker) | c.endswith(f" {marker}")


def vocabulary_form(c: Column) -> Column:
    """A token in letters that a recogniser with A-Z and ' knows; null where none is left."""
    out = F.upper(F.regexp_replace(c, "[^A-Za-z']", ""))
    return F.when(out != "", out)


def speaker_prompt(text: Column, preset: Column | None = None) -> Column:
    """"[tag] text", the tag S1 by default; a tag in brackets stays as it is."""
    tag = F.coalesce(F.when(preset != "", preset), F.lit("S1")) if preset is not None else F.lit("S1")
    return F.concat(F.when(tag.startswith("["), tag).otherwise(F.concat(F.lit("["), tag, F.lit("]"))), F.lit(" "), text)


def preset_pitch(preset: Column) -> Column:
    """110 Hz and the sum of the preset's code points modulo 200; no preset, 110 Hz."""
    points = F.aggregate(F.transform(F.filter(F.split(preset, ""), lambda x: x != ""), _code_point), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(preset.isNull() | (preset == ""), F.lit(110.0)).otherwise(F.lit(110.0) + points % 200)


def _code_point(x: Column) -> Column:
    return F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")
