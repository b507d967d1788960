"""Text functions as Catalyst expressions. Patterns are written so that Java and RE2 read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it for text, with the four separators 1C to 1F.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WIDE, _ZERO, _CONTROL = r"[\x{a0}\x{3000}]", r"[\x{200b}\x{feff}]", r"[\x{00}-\x{1f}\x{7f}-\x{a0}\x{ad}]"
#: Classes of many ranges are slow, so patterns look for what isn't plain ASCII, or not plain ASCII but a space, first.
_ODD, _ODD_OR_SPACE = r"(?=[^ -~])", r"(?=[^!-~])"
#: What few texts hold: wide and zero-width marks, and controls that are no white space.
_RARE = rf"{_ODD}[\x{{00}}-\x{{08}}\x{{0e}}-\x{{1b}}\x{{7f}}-\x{{84}}\x{{86}}-\x{{a0}}\x{{ad}}\x{{200b}}\x{{3000}}\x{{feff}}]"
#: Runs of white space that aren't one plain space already.
_RUNS = rf"{_ODD_OR_SPACE}(?: {_ODD_OR_SPACE}{WS}+|[\t-\r\x1c-\x1f\x{{85}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}]{WS}*)"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"{_ODD_OR_SPACE}(?:^{WS}+|(?<!{WS}){WS}+$)", "")


def is_solid(c: Column) -> Column:
    """Whether there is anything but white space."""
    return c.rlike(f"[^{WS[1:]}")


def trim_text(c: Column) -> Column:
    """One space for each run of white space, no zero-width marks, no controls, nothing at the ends. Controls go after
    runs are joined, so two spaces may meet where one stood."""
    every = F.regexp_replace(F.regexp_replace(c, _WIDE, " "), _ZERO, "")
    every = F.regexp_replace(F.regexp_replace(every, f"{WS}+", " "), _CONTROL, "")
    return F.trim(F.when(c.rlike(_RARE), every).otherwise(F.regexp_replace(c, _RUNS, " ")))


def uid(*parts: Column) -> Column:
    """MD5 of the joined parts."""
    return F.md5(F.concat(*[p.cast("string") for p in parts]))


def natural_key(c: Column) -> Column:
    """A sort key that takes runs of digits as numbers; a missing number is before all."""
    pairs = F.regexp_extract_all(c, F.lit(r"(\D*)(\d*)"), F.lit(0))
    number = lambda p: F.regexp_extract(p, r"\d*$", 0)
    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^\D*", 0).alias("t"), F.when(number(p) == "", F.lit(-1)).otherwise(number(p).cast("decimal(38,0)")).cast("decimal(38,0)").alias("n")))


def size_by_unit(n_bytes: Column, unit: str = "KB") -> Column:
    """Thousands (KB, or any other unit) or millions (MB) of bytes, to two places."""
    return F.round(n_bytes / (10**6 if unit == "MB" else 10**3), 2)


def shorten(c: Column, most: int = 200) -> Column:
    """Longer texts end in three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def digest_input(c: Column) -> Column:
    """What some services sign: texts of over 20 characters as their first 10, their length and their last 10."""
    return F.when(F.length(c) <= 20, c).otherwise(F.concat(F.substring(c, 1, 10), F.length(c).cast("string"), F.substring(c, -10, 10)))


def polish(c: Column) -> Column:
    """Line breaks as markup, and runs of one word character cut to four."""
    return F.regexp_replace(F.regexp_replace(c, "\n", "<br/>"), r"(?U)((\w)\2{3})\2*", "$1")


def clean_lines(c: Column, pattern: str = ".+") -> Column:
    """The trimmed lines of a setting that match pattern from their start on."""
    return F.filter(F.transform(F.split(c, "\n"), trim_text), lambda x: x.rlike(f"^(?:{pattern})"))


def literal_pattern(text: str) -> str:
    """A pattern that matches text itself, in Java and in RE2."""
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in text)


def literal_replacement(text: str) -> str:
    """A replacement that Java takes as it is."""
    return text.replace("\\", "\\\\").replace("$", "\\$")
