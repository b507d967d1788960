"""Files of several formats as one table of segments, by the ending of their names."""

from __future__ import annotations

import codecs
import encodings.aliases
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pages import page_segments
from tessera.operators.segments import lines
from tessera.sources.readers import comment_text, game_comments, subtitles

#: Endings that have a reader of their own; all others are plain text.
MARKUP = ("xhtml", "html", "htm", "xml", "xht")


def ending(path: Column) -> Column:
    return F.regexp_extract(path, r"\.(\w+)$", 1)


def charsets() -> list[str]:
    """Names of text encodings that files may have."""
    found = set()
    for name in encodings.aliases.aliases.values():
        try:
            "a".encode(codecs.lookup(name).name).decode(name)
        except (LookupError, TypeError):  # of another system, or no text encoding
            continue
        found.add(name)
    return sorted(found)


def file_segments(files: DataFrame) -> DataFrame:
    """path, kind, seq, raw, text of the segments of files (path, text): subtitles, game comments, elements of markup
    pages, or lines. Each file is read by one reader, and the readers' filters part the files; null texts have none."""
    kind = F.when(ending(F.col("path")) == "srt", "srt").when(ending(F.col("path")) == "pgn", "pgn").when(ending(F.col("path")).isin(*MARKUP), "page").otherwise("text")
    rows = files.select("path", "text", kind.alias("kind"))
    of = lambda k: rows.filter(F.col("kind") == k)
    srt = of("srt").select("path", "kind", F.posexplode(subtitles(F.col("text"))).alias("seq", "e")).select("path", "kind", "seq", F.col("e.text").alias("raw"), F.col("e.text").alias("text"))
    pgn = of("pgn").select("path", "kind", F.posexplode(game_comments(F.col("text"))).alias("seq", "raw")).withColumn("text", comment_text(F.col("raw")))
    page = page_segments(of("page"), "path", "text").select("path", F.lit("page").alias("kind"), "seq", "raw", F.col("content").alias("text"))
    text = lines(of("text"), "path").select("path", F.lit("text").alias("kind"), "seq", "raw", "text")
    return reduce(DataFrame.unionByName, [srt, pgn, page, text])
