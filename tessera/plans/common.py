"""Registering queries, and the DuckDB twins of the text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import WS
from tessera.runtime import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a function (spark, read) under its name; read(table) gives a table of the run's folder."""

    def wrap(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda t: read_table(spark, f"{sf_dir}/{t}.parquet"))
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return wrap


def d_trim(x: str) -> str:
    """trim_text() in DuckDB."""
    x = rf"regexp_replace(regexp_replace({x}, '[\x{{a0}}\x{{3000}}]', ' ', 'g'), '[\x{{200b}}\x{{feff}}]', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '[\x{{00}}-\x{{1f}}\x{{7f}}-\x{{a0}}\x{{ad}}]', '', 'g'), ' ')"


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


#: Lines of documents with their text, as operators.segments.lines() has them.
D_LINES = f"""lines AS (SELECT * FROM (SELECT doc_id, k - 1 AS seq, line AS raw, {d_trim('line')} AS text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL)) WHERE text <> '')"""


def d_no_letters(x: str) -> str:
    from tessera.operators.segments import NO_LETTERS

    return f"regexp_matches({x}, '{NO_LETTERS.replace(chr(39), chr(39) * 2)}')"


#: Numbered segments: doc_id, oid, md5, text, ignored.
D_SEGMENTS = f"""{D_LINES}, segments AS (SELECT *, md5(oid::VARCHAR || text) AS md5 FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS oid, raw, text, {d_no_letters("replace(replace(text, '&lt;', ''), '&gt;', '')")} AS ignored FROM lines))"""

#: Turns of users with the assistant's next turn as their translation.
D_PAIRS = """pairs AS (SELECT conv_id, turn, text AS original, translation FROM (
  SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS translation, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations)
  WHERE role = 'user' AND next_role = 'assistant')"""


def pairs(read: Callable[[str], DataFrame]) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read("conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("translation"), F.lead("role").over(w).alias("next_role"))
    return rows.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("original"), "translation")


def cache_table(read: Callable[[str], DataFrame], more: DataFrame | None = None) -> DataFrame:
    """Segments of documents as a cache: a label's quality says whether a document has been translated. more: a table by
    doc_id whose columns are added. Documents are joined whole, before they become rows."""
    from tessera.operators.segments import segment

    docs = read("documents").select("doc_id", "text").join(read("labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs if more is None else docs.join(more, "doc_id")
    own = [c for c in docs.columns if c != "text"]
    rows = segment(docs.select(F.struct(*own).alias("of"), "text"), key="of").select("of.*", "oid", "md5", "raw", "text", "ignored")
    extra = [] if more is None else [c for c in more.columns if c != "doc_id"]
    done = F.when(F.col("quality") == 1, F.lower("text"))
    return rows.select(
        "doc_id", "oid", "md5", F.col("raw"), F.col("text").alias("original"), "ignored", F.to_json(F.struct(F.pmod("oid", F.lit(3)).cast("string").alias("class"))).alias("attributes"),
        F.concat(F.lit("page"), F.pmod("doc_id", F.lit(7)).cast("string")).alias("page"), done.alias("translation"), F.when(done.isNotNull(), "upper").alias("engine_name"), F.when(done.isNotNull(), "xx").alias("target_lang"), *extra,
    )


D_CACHE = f"""{D_SEGMENTS}, cache AS (SELECT s.doc_id, oid, md5, raw, text AS original, ignored, '{{"class":"' || (oid % 3) || '"}}' AS attributes, 'page' || (s.doc_id % 7) AS page,
  CASE WHEN quality = 1 THEN lower(text) END AS translation, CASE WHEN quality = 1 THEN 'upper' END AS engine_name, CASE WHEN quality = 1 THEN 'xx' END AS target_lang
  FROM segments s LEFT JOIN labels l USING (doc_id))"""


def hashed(*columns: Column) -> Column:
    return F.md5(F.concat_ws("|", *columns))
