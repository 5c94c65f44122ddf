"""Catalogue text as column expressions. Patterns stay within what Java and RE2 share,
but for those named so, which need look-around or Unicode word characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(line: Column) -> Column:
    """No-break spaces as spaces, runs of spaces as one, none at the ends."""
    return F.trim(F.regexp_replace(F.replace(line, F.lit(" "), F.lit(" ")), "[ \\t]+", " "))


def first_match(text: Column, patterns: dict[str, str]) -> Column:
    """The label whose pattern matches earliest; of several at one place the longest
    label; NULL if none does."""
    hits = [F.when(F.regexp_instr(text, F.lit(p)) > 0, F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.lit(-len(k)).alias("n"), F.lit(k).alias("label"))) for k, p in patterns.items()]
    return F.array_min(F.array_compact(F.array(*hits)))["label"]


def cascade(text: Column, cases: list[tuple[str, str]], otherwise: Column) -> Column:
    """The label of the first pattern in order that matches."""
    out = None
    for label, pattern in cases:
        condition = F.regexp_like(text, F.lit(pattern))
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise)


def flags(text: Column, patterns: dict[str, str]) -> list[Column]:
    """0 / 1 columns by name."""
    return [F.regexp_like(text, F.lit(p)).cast("int").alias(k) for k, p in patterns.items()]


def kilometres(text: Column) -> Column:
    """The first distance in a text, km or m, comma or point, in km to 3 places."""
    km = F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?) km", 1)
    m = F.regexp_extract(text, r"([0-9]+) m(?:[^a-z]|$)", 1)
    number = lambda c: F.replace(c, F.lit(","), F.lit(".")).cast("double")
    return F.round(F.when(km != "", number(km)).when(m != "", number(m) / 1000), 3)


def unhyphenated(text: Column) -> Column:
    """Words parted by a hyphen at a line's end are joined."""
    return F.regexp_replace(text, "-\\n", "")


def name_key(name: Column) -> Column:
    """A name as a join key: lower case, Latin i as Cyrillic, apostrophes and runs of
    spaces alike."""
    low = F.translate(F.lower(name), "i", "і")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[’`ʼ]", "'"), " +", " "))


def titled(name: Column) -> Column:
    """Each part of a hyphenated name with a capital, and the district's suffix."""
    return F.concat(F.array_join(F.transform(F.split(name, "-"), F.initcap), "-"), F.lit(" district"))


def without_caption(text: Column) -> Column:
    """A figure caption that was set inside a word is taken out (look-around)."""
    return F.regexp_replace(text, r"(?U)(?<=\w)\s*Fig\. \d+\.?\s*(?=\p{Ll})", "")
