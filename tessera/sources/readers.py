"""Readers of document formats, each from a column of text, and whole files decoded by charset."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip, trim_text
from tessera.operators.segments import METADATA
from tessera.runtime import materialise


#: Charsets that Spark's own decode() reads (fixed values).
SPARK_CHARSETS = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32")


def decoded(content: Column, charset: str) -> Column:
    """Bytes as text: by Spark, or by Python's codecs for charsets that it lacks."""
    if charset.upper() in SPARK_CHARSETS:
        return F.decode(content, charset)
    codecs.lookup(charset)

    @F.pandas_udf("string")
    def decode(values):  # noqa: ANN001, ANN202
        return values.map(lambda x: None if x is None else bytes(x).decode(charset, "replace"))

    return decode(content)


def read_files(spark: SparkSession, paths: str | list[str], charset: str = "UTF-8", name_filter: str | None = None) -> DataFrame:
    """path, modified, bytes, text of whole files, with line ends of one kind."""
    reader = spark.read.format("binaryFile")
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    text = F.regexp_replace(decoded(F.col("content"), charset), "\r\n?", "\n")
    return reader.load(paths).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), text.alias("text"))


def subtitles(text: Column) -> Column:
    """array<struct<number, time, text>> of an SRT text: sections between empty lines. A section without a time or text
    has null there."""
    sections = F.filter(F.split(strip(text), "\n\n"), lambda s: s != "")
    part = lambda s, k: F.get(F.split(s, "\n"), F.lit(k))
    rest = lambda s: F.when(F.size(F.split(s, "\n")) > 2, F.array_join(F.slice(F.split(s, "\n"), 3, 1 << 30), "\n"))
    return F.transform(sections, lambda s: F.struct(part(s, 0).alias("number"), part(s, 1).alias("time"), rest(s).alias("text")))


def game_comments(text: Column) -> Column:
    """The comments of a PGN text: braces with a letter (or one of the six signs between Z and a) inside."""
    return F.regexp_extract_all(text, F.lit(r"\{[^}]*[a-zA-z][^}]*\}"), F.lit(0))


def comment_text(comment: Column) -> Column:
    return F.regexp_replace(comment, r"^[{}]+|[{}]+$", "")


def metadata(books: DataFrame, key: str, items: str = "metadata", translate: bool = False) -> DataFrame:
    """key, name, seq, text, page, ignored of a map of names to texts: those of METADATA with an ASCII letter. They are
    ignored unless their translation is asked for."""
    named = books.select(key, F.explode(items).alias("name", "texts")).filter(F.col("name").isin(*METADATA))
    rows = named.select(key, "name", F.posexplode("texts").alias("seq", "text")).filter(F.col("text").rlike("[a-zA-Z]+"))
    return rows.select(key, "name", "seq", "text", F.lit("content.opf").alias("page"), F.lit(not translate).alias("ignored"))


def contents(nodes: DataFrame, key: str, node: str = "node", parent: str = "parent", order: str = "seq", title: str = "title") -> DataFrame:
    """key, place, title, page of a table of contents in rows (node, parent, seq), parents before their children and
    siblings by seq, of any depth. Nodes whose parents don't exist, and what is below them, are left out; a circle is an
    error.

    Each round doubles the part of its path that a node knows: it takes over the path of the ancestor that it has reached,
    so the rounds are as many as the logarithm of the depth. Each is written.
    """
    rows = nodes.select(key, F.col(node).alias("n"), F.col(parent).alias("up"), F.array(F.col(order).cast("long")).alias("place"), trim_text(F.col(title)).alias("title"))
    rows = materialise(rows, "contents")
    most = rows.count().bit_length() + 1
    for _ in range(most):
        if rows.filter("up is not null").isEmpty():
            return rows.select(key, "place", "title", F.lit("toc.ncx").alias("page"))
        above = rows.select(key, F.col("n").alias("up"), F.col("up").alias("further"), F.col("place").alias("before"))
        grown = rows.filter("up is not null").join(above, [key, "up"]).select(key, "n", F.col("further").alias("up"), F.concat("before", "place").alias("place"), "title")
        rows = materialise(rows.filter("up is null").unionByName(grown), "contents")
    raise ValueError("a table of contents has a circle")


def glossary(text: str) -> list[tuple[str, str]]:
    """Pairs of a glossary file: groups of lines between empty lines, a term and its target (itself if there is none)."""
    import re

    groups = re.split(r"\n{2,}", text.strip().strip("\ufeff"))
    rows = [g.split("\n") for g in groups if g.strip()]
    return [(r[0], r[1] if len(r) > 1 else r[0]) for r in rows]


def read_glossary(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """A glossary file, through Spark's file systems: one small file, whose terms go into the plan. None if unreadable."""
    from pyspark.errors import PySparkException

    try:
        rows = read_files(spark, path).select("text").take(1)
    except PySparkException:
        return []
    return glossary(rows[0].text) if rows else []
