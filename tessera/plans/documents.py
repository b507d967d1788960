"""Queries over documents, pages and conversations: text, segments, units, alignment."""

from __future__ import annotations

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.languages import with_direction
from tessera.functions.placeholders import separators
from tessera.operators import align as A
from tessera.operators import segments as S
from tessera.plans.common import D_LINES, D_PAIRS, D_SEGMENTS, d_no_letters, d_strip, d_trim, pairs, query


@query(f"SELECT doc_id, md5({d_trim('text')}) AS h, length({d_trim('text')}) AS n FROM documents")
def trim_text(spark, read):
    t = T.trim_text(F.col("text"))
    return read("documents").select("doc_id", F.md5(t).alias("h"), F.length(t).cast("long").alias("n"))


_HOST = r"regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
_KEY = r"list_transform(regexp_extract_all(url, '(\D*)(\d*)', 0), lambda p: {'t': regexp_extract(p, '^\D*'), 'n': CASE WHEN regexp_extract(p, '\d*$') = '' THEN -1 ELSE regexp_extract(p, '\d*$')::HUGEINT END})"


@query(f"SELECT page_id, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY {_KEY}, page_id) - 1 AS place FROM pages")
def natural_sort_pages(spark, read):
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    place = F.row_number().over(Window.partitionBy("host").orderBy(T.natural_key(F.col("url")), "page_id")) - 1
    return read("pages").select("page_id", "url", host.alias("host")).select("page_id", "host", place.cast("long").alias("place"))


@query("SELECT page_id, ((strlen(html) + 5) // 10) / 100.0::DOUBLE AS kb, ((strlen(html) + 5000) // 10000) / 100.0::DOUBLE AS mb FROM pages")
def size_by_unit(spark, read):
    n = F.octet_length("html")
    return read("pages").select("page_id", T.size_by_unit(n, "KB").alias("kb"), T.size_by_unit(n, "MB").alias("mb"))


#: Documents as files of several kinds, so that some are pages and others aren't: their source and id make the name.
_FILE = "lang || '/' || source || doc_id || CASE doc_id % 5 WHEN 0 THEN '.xhtml' WHEN 1 THEN '.html' WHEN 2 THEN '.HTML' WHEN 3 THEN '.html.png' ELSE '.css' END"


@query(rf"SELECT doc_id, {_FILE} AS href FROM documents WHERE regexp_matches({_FILE}, '\.(?:xhtml|html|htm|xml|xht)$')")
def page_entries(spark, read):
    return S.entries(read("documents").select("doc_id", F.expr(_FILE).alias("href")))


@query(f"WITH {D_SEGMENTS} SELECT doc_id, oid, md5, ignored FROM segments")
def segment_documents(spark, read):
    return S.segment(read("documents")).select("doc_id", F.col("oid").cast("long").alias("oid"), "md5", "ignored")


@query(f"WITH {D_LINES} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {d_no_letters('text')}) AS n_ignored FROM lines GROUP BY doc_id")
def default_rule_ignored(spark, read):
    rows = S.lines(read("documents")).select("doc_id", S.ignored(F.col("text")).alias("i"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("i").alias("n_ignored"))


def _filtered(condition: str) -> str:
    return f"WITH {D_LINES} SELECT doc_id, seq, ({d_no_letters('text')} OR {condition}) AS ignored FROM lines"


def _rule(read, rules, mode, scope="text"):
    rows = S.lines(read("documents"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), S.ignored(F.col("text"), F.col("raw"), rules, mode, scope).alias("ignored"))


@query(_filtered("contains(lower(text), 'license') OR contains(lower(text), 'the the')"))
def filter_normal(spark, read):
    return _rule(read, ["License", "the THE"], "normal")


@query(_filtered("contains(lower(text), 'ción') OR contains(lower(text), 'é') OR contains(lower(text), 'ñüß')"))
def filter_normal_accents(spark, read):
    return _rule(read, ["CIÓN", "É", "Ñüß"], "normal")


@query(_filtered("contains(text, 'MIT License')"))
def filter_case(spark, read):
    return _rule(read, ["MIT License"], "case")


@query(_filtered(r"regexp_matches(text, '^[A-Z][a-z]+\.$')"))
def filter_regex(spark, read):
    return _rule(read, [r"^[A-Z][a-z]+\.$"], "regex")


@query(_filtered(f"regexp_matches(raw, ' +$') OR regexp_matches(text, ' +$') OR {d_no_letters('raw')}"))
def filter_markup_scope(spark, read):
    return _rule(read, [" +$"], "regex", "html")


@query("SELECT doc_id, md5(doc_id::VARCHAR || 'upper' || lang || '1800' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'latin-1' END) AS cache_id FROM documents")
def cache_identity(spark, read):
    encoding = F.when(F.col("doc_id") % 2 == 0, "UTF-8").otherwise("Latin-1")
    return read("documents").select("doc_id", S.cache_identity(F.col("doc_id"), F.lit("upper"), F.col("lang"), F.lit(1800), encoding).alias("cache_id"))


_MERGE = f"""WITH RECURSIVE {D_SEGMENTS}, kept AS (SELECT doc_id, raw, text, row_number() OVER (PARTITION BY doc_id ORDER BY oid) AS rn FROM segments WHERE NOT ignored),
w AS (SELECT doc_id, rn, 0::BIGINT AS oid, length(text) + 2 AS len, length(text) + 2 < 1800 AS sep, raw, text FROM kept WHERE rn = 1
  UNION ALL SELECT k.doc_id, k.rn, CASE WHEN w.len + length(k.text) + 2 < 1800 THEN w.oid ELSE w.oid + 1 END, CASE WHEN w.len + length(k.text) + 2 < 1800 THEN w.len ELSE 0 END + length(k.text) + 2,
    w.len + length(k.text) + 2 < 1800, k.raw, k.text FROM w JOIN kept k ON k.doc_id = w.doc_id AND k.rn = w.rn + 1)
SELECT doc_id, oid, count(*) AS n, md5(oid::VARCHAR || string_agg(text || chr(10) || chr(10), '' ORDER BY rn)) AS md5,
  md5(string_agg(raw || CASE WHEN sep THEN chr(10) || chr(10) ELSE '' END, '' ORDER BY rn)) AS raw_md5 FROM w GROUP BY doc_id, oid"""


@query(_MERGE)
def merge_segments(spark, read):
    units = S.merge_documents(read("documents"), most=1800)
    return units.select("doc_id", F.col("oid").cast("long").alias("oid"), F.col("n").cast("long").alias("n"), "md5", F.md5("raw").alias("raw_md5"))


def _d_parts(x: str) -> str:
    return f"string_split({d_strip(x)}, chr(10))"


_D_ALIGNED = f"(translation IS NULL OR {d_strip('translation')} = '' OR len({_d_parts('original')}) = len({_d_parts('translation')}))"


@query(f"WITH {D_PAIRS} SELECT conv_id, turn, {_D_ALIGNED} AS aligned FROM pairs")
def is_aligned(spark, read):
    return pairs(read).select("conv_id", "turn", A.is_aligned(F.col("original"), F.col("translation"), "\n").alias("aligned"))


#: Documents whose lines are parted by empty lines against a version with one line end only.
_UNEVEN = "uneven AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS original, CASE WHEN doc_id % 3 = 0 THEN lower(text) ELSE lower(replace(text, chr(10), chr(10) || chr(10))) END AS translation FROM documents WHERE text IS NOT NULL)"


def _uneven(read):
    wide = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return read("documents").filter("text is not null").select("doc_id", wide.alias("original"), F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.lower(wide)).alias("translation"))


@query(f"""WITH {_UNEVEN}, p AS (SELECT *, len(string_split({d_strip('original')}, chr(10) || chr(10))) = len(string_split({d_strip('translation')}, chr(10) || chr(10))) OR {d_strip('translation')} = '' AS ok, string_split(translation, chr(10)) AS l FROM uneven)
SELECT doc_id, md5(CASE WHEN ok THEN translation ELSE list_aggregate(list_transform(l, lambda x, i: CASE WHEN {d_strip('x')} <> '' AND i < len(l) AND {d_strip("coalesce(l[i + 1], '')")} <> '' THEN x || chr(10) ELSE x END), 'string_agg', chr(10)) END) AS h FROM p""")
def repair_alignment(spark, read):
    return _uneven(read).select("doc_id", F.md5(A.repair(F.col("original"), F.col("translation"))).alias("h"))


def _align_sql(position: str) -> str:
    few = {"left": "b || list_transform(range(n - m), lambda i: NULL::VARCHAR)", "above": "[everything] || list_transform(range(n - 1), lambda i: NULL::VARCHAR)", "below": "list_transform(range(n - 1), lambda i: NULL::VARCHAR) || [everything]"}[position]
    return f"""WITH {D_PAIRS}, q AS (SELECT conv_id, turn, {_d_parts('original')} AS a, {_d_parts("regexp_replace(translation, '\\n+', chr(10), 'g')")} AS b FROM pairs),
r AS (SELECT *, len(a) AS n, len(b) AS m, list_aggregate(b, 'string_agg', chr(10) || chr(10)) AS everything, list_aggregate(b[n:], 'string_agg', chr(10) || chr(10)) AS over FROM q),
s AS (SELECT *, CASE WHEN m < n THEN {few} WHEN m > n THEN b[:n - 1] || [over] ELSE b END AS c FROM r)
SELECT conv_id, turn, unnest(range(n)) AS part, unnest(a) AS original, unnest(c) AS translation FROM s"""


def _align(position):
    def run(spark, read):
        rows = pairs(read).select("conv_id", "turn", F.posexplode(A.align(F.col("original"), F.col("translation"), "\n", position)).alias("part", "p"))
        return rows.select("conv_id", "turn", F.col("part").cast("long").alias("part"), "p.original", "p.translation")

    return run


for _position in ("below", "above", "left"):
    _f = _align(_position)
    _f.__name__ = f"align_pairs_{_position}"
    query(_align_sql(_position))(_f)


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, ' the ', ' {{{{id_00007}}}} ', 'g'), '\s*(?:\{{\s*)+id\s*_\s*(?:0|[^0][0-9]*)\s*(?:\s*\}})+\s*', chr(10), 'g')) AS h FROM documents WHERE text IS NOT NULL".replace(r"\s", "[" + T.WS[1:-1] + "]").replace("id_00007", "id_7"))
def placeholder_separators(spark, read):
    marked = F.regexp_replace("text", " the ", " {{id_7}} ")
    return read("documents").filter("text is not null").select("doc_id", F.md5(separators(marked, "\n")).alias("h"))


@query(f"WITH {D_PAIRS} SELECT original, arg_max(translation, (conv_id, turn)) AS translation FROM pairs WHERE coalesce(translation, '') <> '' GROUP BY original")
def translation_dict_last_wins(spark, read):
    return S.translation_map(pairs(read), ["conv_id", "turn"])


@query(f"""WITH {D_LINES}, t AS (SELECT text AS original, arg_max(lower(text) || doc_id, (doc_id, seq)) AS translation FROM lines WHERE doc_id % 2 = 0 GROUP BY text)
SELECT doc_id, seq, translation FROM lines LEFT JOIN t ON lines.text = t.original""")
def apply_translations(spark, read):
    rows = S.lines(read("documents"))
    known = S.translation_map(rows.filter("doc_id % 2 = 0").select("doc_id", "seq", F.col("text").alias("original"), F.concat(F.lower("text"), F.col("doc_id").cast("string")).alias("translation")), ["doc_id", "seq"])
    return S.apply_translations(rows, known).select("doc_id", F.col("seq").cast("long").alias("seq"), "translation")


@query("SELECT doc_id, CASE lang WHEN 'iw' THEN 'rtl' WHEN 'ar' THEN 'rtl' WHEN 'en' THEN 'ltr' WHEN 'es' THEN 'ltr' WHEN 'it' THEN 'ltr' WHEN 'de' THEN 'ltr' ELSE 'auto' END AS direction FROM documents")
def direction_lookup(spark, read):
    return with_direction(read("documents")).select("doc_id", "direction")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS head FROM documents")
def shorten_log(spark, read):
    return read("documents").select("doc_id", T.shorten(F.col("text")).alias("head"))


def _d_polish(x: str) -> str:
    """polish() in DuckDB, whose patterns have no back references: each character of words by itself."""
    for c in string.ascii_letters + string.digits + "_äöüßÄÖÜàâáçéèêëíîïñóôœúùûÉÀ":
        x = f"regexp_replace({x}, '{c}{{5,}}', '{c * 4}', 'g')"
    return x


@query(f"SELECT doc_id, md5(h) AS h FROM (SELECT doc_id, {_d_polish(chr(116))} AS h FROM (SELECT doc_id, replace(regexp_replace(text, '([a-z])\\.', '\\1\\1\\1\\1\\1\\1.', 'g'), chr(10), '<br/>') AS t FROM documents))")
def polish_repeats(spark, read):
    return read("documents").select("doc_id", F.md5(T.polish(F.regexp_replace("text", "([a-z])\\.", "$1$1$1$1$1$1."))).alias("h"))


@query(f"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {d_trim('x')}), lambda x: regexp_matches(x, '^(?:[A-Z])')) AS keys FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(keys) AS n, md5(array_to_string(keys, '|')) AS h FROM l")
def clean_setting_lines(spark, read):
    k = T.clean_lines(F.col("text"), "[A-Z]")
    return read("documents").filter("text is not null").select("doc_id", k.alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "|")).alias("h"))
