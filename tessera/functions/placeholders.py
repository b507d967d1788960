"""Placeholders such as {{id_00012}}, which services bring back with other braces and spaces."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import WS, literal_replacement
from tessera.runtime import ship

Glossary = Sequence[tuple[str, str]]


def placeholder(number: int, digits: int = 5) -> str:
    return "{{id_" + str(number).zfill(digits) + "}}"


def tolerant(number: str) -> str:
    """The pattern of a placeholder as it may come back: one brace or more, spaces anywhere."""
    return rf"(?:\{{{WS}*)+id{WS}*_{WS}*{number}{WS}*(?:{WS}*\}})+"


#: Terms up to which a glossary is an expression; a larger one is looked for by an automaton.
FEW_TERMS = 16


def glossary_replace(c: Column, glossary: Glossary) -> Column:
    """Terms become placeholders, in the glossary's order and each on what the ones before it left."""
    if len(glossary) > FEW_TERMS:
        return _by_automaton(glossary, "replace")(c)
    for k, (source, _) in enumerate(glossary):
        if source:
            c = F.replace(c, F.lit(source), F.lit(placeholder(k, 6)))
    return c


def glossary_restore(c: Column, glossary: Glossary) -> Column:
    """Placeholders become the terms' targets, in the glossary's order."""
    if len(glossary) > FEW_TERMS:
        return _by_automaton(glossary, "restore")(c)
    for k, (_, target) in enumerate(glossary):
        c = F.regexp_replace(c, tolerant(str(k).zfill(6)), literal_replacement(target))
    return c


class Terms:
    """A glossary of any size. Its time for a text is in proportion to the text and to the terms that are in it.

    One term after the other is replaced in what the ones before have left. A term that the text doesn't hold at the
    beginning can only come about where it meets a placeholder: then it has a brace, or is a part of one. Those
    few are looked for each time, the others by one pass of an automaton. Restoring looks for the least number that
    is still to come, as a target may itself hold a placeholder.
    """

    _INSIDE = re.compile(r"\{{0,2}(?:i?d?_?|(?:i?d)?_)[0-9]*\}{0,2}")
    _ANY = re.compile(r"(?:\{\s*)+id\s*_\s*([0-9]+)\s*(?:\s*\})+")

    def __init__(self, glossary: Glossary) -> None:
        self.glossary = list(glossary)
        self.automaton, self.risky, first = ahocorasick.Automaton(), [], {}
        for k, (source, _) in enumerate(self.glossary):
            if source and ("{" in source or "}" in source or self._INSIDE.fullmatch(source)):
                self.risky.append(k)
            elif source and first.setdefault(source, k) == k:  # a term that stands there again finds nothing left
                self.automaton.add_word(source, k)
        if len(self.automaton):
            self.automaton.make_automaton()

    def replace(self, text: str | None) -> str | None:
        if not text:
            return text
        found = {k for _, k in self.automaton.iter(text)} if len(self.automaton) else set()
        for k in sorted(found.union(self.risky)):
            source = self.glossary[k][0]
            if source in text:
                text = text.replace(source, placeholder(k, 6))
        return text

    def restore(self, text: str | None) -> str | None:
        last = -1
        while text and "{" in text:
            numbers = {m for m in self._ANY.findall(text) if last < int(m) < len(self.glossary) and m == str(int(m)).zfill(6)}
            if not numbers:
                break
            number = min(numbers, key=int)
            last = int(number)
            target = self.glossary[last][1]
            text = re.sub(rf"(?:\{{\s*)+id\s*_\s*{number}\s*(?:\s*\}})+", lambda m: target, text)  # noqa: B023
        return text


@functools.lru_cache(4)
def _terms(glossary: tuple[tuple[str, str], ...]) -> Terms:
    return Terms(glossary)


def _by_automaton(glossary: Glossary, what: str) -> Callable[[Column], Column]:
    spark = SparkSession.active()
    ship(spark)
    held = spark.sparkContext.broadcast(tuple(map(tuple, glossary)))  # a file that the driver has read

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(getattr(_terms(held.value), what), na_action="ignore")

    return F.pandas_udf(run, "string")


def unsafe_terms(glossary: Glossary) -> list[str]:
    """Terms that would change the placeholders of earlier terms."""
    return [s for k, (s, _) in enumerate(glossary) if s and any(s in placeholder(j, 6) for j in range(k))]


def separators(c: Column, separator: str) -> Column:
    """Numbered placeholders between paragraphs become the separator."""
    return F.regexp_replace(c, rf"{WS}*{tolerant(r'(?:0|[^0][0-9]*)')}{WS}*", literal_replacement(separator))


def restore_reserved(c: Column, reserved: Column) -> Column:
    """Put the markup of reserved elements (an array, by number) back into a translation whose own text is escaped."""
    escaped = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    spaced = rf"(?:\{{{WS}*)+id{WS}*_{WS}*"
    number = lambda i: F.array_join(F.split(F.lpad(i.cast("string"), 5, "0"), ""), f"{WS}*")
    numbered = F.transform(reserved, lambda x, i: F.struct(x.alias("x"), F.concat(F.lit(spaced), number(i), F.lit(rf"{WS}*(?:{WS}*\}})+")).alias("p")))
    quoted = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.aggregate(numbered, escaped, lambda acc, x: F.regexp_replace(acc, x["p"], quoted(x["x"])))


__all__ = ["Glossary", "Terms", "glossary_replace", "glossary_restore", "placeholder", "restore_reserved", "separators", "tolerant", "unsafe_terms"]
