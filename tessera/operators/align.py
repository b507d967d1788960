"""Originals and translations of merged units: are they parallel, and pairs of their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.placeholders import separators
from tessera.functions.text import is_solid, literal_pattern, strip


def parts(c: Column, separator: str) -> Column:
    return F.split(strip(c), literal_pattern(separator))


def is_aligned(original: Column, translation: Column, separator: str = "\n\n") -> Column:
    """Blank translations are; others have as many parts as the original."""
    blank = translation.isNull() | ~is_solid(translation)
    return F.when(blank, F.lit(True)).otherwise(F.size(parts(original, separator)) == F.size(parts(translation, separator)))


def repair(original: Column, translation: Column, separator: str = "\n\n") -> Column:
    """A translation that isn't aligned, with an empty line between lines with text that follow each other."""
    mark = separator[0]
    found = F.split(translation, literal_pattern(mark))
    after = F.concat(F.slice(found, 2, F.size(found)), F.array(F.lit("")))
    spaced = F.zip_with(found, after, lambda x, y: F.when(is_solid(x) & is_solid(y), F.concat(x, F.lit(mark))).otherwise(x))
    return F.when(translation.isNull() | is_aligned(original, translation, separator), translation).otherwise(F.array_join(spaced, mark))


def align(original: Column, translation: Column, separator: str = "\n\n", position: str = "below") -> Column:
    """array<struct<original, translation>>: one pair a part of the original.

    Too few parts of a translation: beside the original (left, right) the rest is null; else all of it stands at the
    first (above) or last part. Too many: those over stand at the last part, a blank line apart. Numbered placeholders
    count as separators where the original doesn't end in one."""
    by_mark = F.substring(original, -2, 2) != separator
    original, translation = (F.when(by_mark, separators(c, separator)).otherwise(c) for c in (original, translation))
    a = parts(original, separator)
    b = parts(F.regexp_replace(translation, f"{literal_pattern(separator[:-1])}(?:{literal_pattern(separator[-1])})+", separator), separator)
    n, m = F.size(a), F.size(b)
    nulls = lambda k: F.array_repeat(F.lit(None).cast("string"), k)
    everything = F.array(F.array_join(b, "\n\n"))
    few = F.concat(b, nulls(n - m)) if position in ("left", "right") else F.concat(everything, nulls(n - 1)) if position == "above" else F.concat(nulls(n - 1), everything)
    many = F.concat(F.slice(b, 1, n - 1), F.array(F.array_join(F.slice(b, n, m), "\n\n")))
    other = F.when(translation.isNull(), nulls(n)).when(m < n, few).when(m > n, many).otherwise(b)
    return F.transform(F.arrays_zip(a.alias("x"), other.alias("y")), lambda p: F.struct(p["x"].alias("original"), p["y"].alias("translation")))
