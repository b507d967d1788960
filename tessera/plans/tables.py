"""Queries over the cache, the translation stage, exchange formats and the review table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.placeholders import glossary_replace, glossary_restore
from tessera.operators import align as A
from tessera.operators import cache as C
from tessera.operators import exchange as X
from tessera.operators import grid as G
from tessera.operators import segments as S
from tessera.operators import translate as TR
from tessera.operators.store import CacheStore
from tessera.plans.common import D_CACHE, D_LINES, D_PAIRS, cache_table, d_no_letters, d_strip, d_trim, pairs, query
from tessera.runtime import materialise, shared_folder
from tessera.sources import readers as R
from tessera.sources import writers as W

# ---- the cache ------------------------------------------------------------------------------------------------------

_ROW = "md5(concat_ws('|', doc_id::VARCHAR, oid::VARCHAR, md5, original, ignored::VARCHAR, coalesce(translation, '-'), coalesce(engine_name, '-'))) AS h"


def _row():
    parts = ["doc_id", "oid", "md5", "original", F.col("ignored").cast("string"), F.coalesce("translation", F.lit("-")), F.coalesce("engine_name", F.lit("-"))]
    return F.md5(F.concat_ws("|", *[p if not isinstance(p, str) else F.col(p).cast("string") for p in parts])).alias("h")


@query(f"WITH {D_CACHE} SELECT doc_id, oid, {_ROW} FROM cache WHERE NOT ignored")
def cache_visible(spark, read):
    return C.visible(cache_table(read)).select("doc_id", F.col("oid").cast("long").alias("oid"), _row())


@query(f"WITH {D_CACHE} SELECT doc_id, oid, {_ROW} FROM cache WHERE coalesce(translation, '') <> ''")
def cache_translated_only(spark, read):
    return C.translated_only(cache_table(read)).select("doc_id", F.col("oid").cast("long").alias("oid"), _row())


_TOXIC = "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"


def _toxic(read):
    return read("labels").filter("toxic = 1").select("doc_id")


@query(f"WITH {D_CACHE} SELECT doc_id, oid, {_ROW} FROM cache WHERE {_TOXIC}")
def cache_get(spark, read):
    return C.get(cache_table(read), _toxic(read), "doc_id").select("doc_id", F.col("oid").cast("long").alias("oid"), _row())


@query(f"WITH {D_CACHE} SELECT doc_id, oid, {_ROW} FROM cache WHERE NOT ({_TOXIC})")
def cache_delete(spark, read):
    return C.delete(cache_table(read), _toxic(read), "doc_id").select("doc_id", F.col("oid").cast("long").alias("oid"), _row())


@query(f"WITH {D_CACHE} SELECT doc_id, oid, ignored OR {_TOXIC} AS ignored FROM cache")
def cache_ignore(spark, read):
    return C.ignore(cache_table(read), _toxic(read), "doc_id").select("doc_id", F.col("oid").cast("long").alias("oid"), "ignored")


@query(f"WITH {D_CACHE} SELECT doc_id, oid, CASE WHEN l.doc_id IS NOT NULL THEN 'again ' || toxic ELSE translation END AS translation, CASE WHEN l.doc_id IS NOT NULL THEN 'second' ELSE engine_name END AS engine_name FROM cache LEFT JOIN labels l USING (doc_id)")
def cache_update(spark, read):
    changes = read("labels").select("doc_id", F.concat(F.lit("again "), F.col("toxic").cast("string")).alias("translation"), F.lit("second").alias("engine_name"))
    return C.update(cache_table(read), changes, ["translation", "engine_name"], "doc_id").select("doc_id", F.col("oid").cast("long").alias("oid"), "translation", "engine_name")


@query(f"WITH {D_CACHE}, c AS (SELECT cache.*, lang FROM cache JOIN documents USING (doc_id)) SELECT c.lang AS cache_id, doc_id, oid, CASE WHEN c.lang = 'de' AND l.doc_id IS NOT NULL THEN 'again ' || toxic ELSE translation END AS translation FROM c LEFT JOIN labels l USING (doc_id)")
def cache_store_update(spark, read):
    """One cache a language, of which one is changed by its labels."""
    store = CacheStore(spark, shared_folder(spark, "store"))
    rows = cache_table(read, read("documents").select("doc_id", F.col("lang").alias("cache_id")))
    number = F.col("doc_id") * 1_000_000 + F.col("oid")
    store.write(rows.withColumn("oid", number))
    changes = rows.join(read("labels").select("doc_id", "toxic"), "doc_id").filter("cache_id = 'de'").select("cache_id", number.alias("oid"), F.concat(F.lit("again "), F.col("toxic").cast("string")).alias("translation"))
    store.update(changes, ["translation"])
    return store.read().select("cache_id", F.floor(F.col("oid") / 1_000_000).alias("doc_id"), (F.col("oid") % 1_000_000).alias("oid"), "translation")


#: Rows are tried one by one: state is the ids and hashes in use, and a row is accepted if neither is.
_INCOMING = """WITH RECURSIVE e AS (SELECT doc_id AS oid, md5(text) AS md5, 'old' AS origin FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0),
i AS (SELECT doc_id // 4 * 3 AS oid, md5(text) AS md5, doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 1),
f AS (SELECT i.*, row_number() OVER (ORDER BY k) AS n FROM i WHERE oid NOT IN (SELECT oid FROM e) AND md5 NOT IN (SELECT md5 FROM e)),
w AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS oid, NULL::VARCHAR AS md5, false AS taken, []::BIGINT[] AS oids, []::VARCHAR[] AS hashes
  UNION ALL SELECT f.n, f.oid, f.md5, NOT list_contains(w.oids, f.oid) AND NOT list_contains(w.hashes, f.md5),
    CASE WHEN list_contains(w.oids, f.oid) OR list_contains(w.hashes, f.md5) THEN w.oids ELSE list_append(w.oids, f.oid) END,
    CASE WHEN list_contains(w.oids, f.oid) OR list_contains(w.hashes, f.md5) THEN w.hashes ELSE list_append(w.hashes, f.md5) END
  FROM w JOIN f ON f.n = w.n + 1)"""


@query(f"{_INCOMING} SELECT * FROM e UNION ALL SELECT oid, md5, 'new' FROM w WHERE taken")
def cache_insert_ignore(spark, read):
    docs = read("documents").filter("text is not null")
    existing = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("oid"), F.md5("text").alias("md5"), F.lit("old").alias("origin"))
    incoming = docs.filter("doc_id % 2 = 1").select((F.floor(F.col("doc_id") / 4) * 3).alias("oid"), F.md5("text").alias("md5"), F.lit("new").alias("origin"), "doc_id")
    return C.insert_ignore(existing, incoming, ["doc_id"])


@query("""WITH o AS (SELECT user_id::VARCHAR || event_type AS key, arg_max(props, (ts, event_id)) AS value FROM events WHERE value < 50 GROUP BY 1),
n AS (SELECT user_id::VARCHAR || event_type AS key, arg_max(props, (ts, event_id)) AS value FROM events WHERE value >= 50 GROUP BY 1)
SELECT coalesce(n.key, o.key) AS key, CASE WHEN n.key IS NULL THEN o.value ELSE n.value END AS value FROM n FULL JOIN o ON n.key = o.key""")
def info_upsert(spark, read):
    rows = read("events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("key"), F.col("props").alias("value"), "ts", "event_id", F.col("value").alias("v"))
    none = rows.select("key", "value").limit(0)
    old = C.upsert(none, rows.filter("v < 50"), "key", ["ts", "event_id"])
    return C.upsert(old, rows.filter("v >= 50"), "key", ["ts", "event_id"])


@query(f"WITH {D_CACHE} SELECT min(oid) AS oid, page FROM (SELECT *, row_number() OVER (ORDER BY oid, doc_id) AS r FROM cache WHERE page = 'page3' AND NOT ignored) WHERE r = 1 GROUP BY page")
def cache_first(spark, read):
    return C.first(cache_table(read), page="page3", ignored=False).select(F.col("oid").cast("long").alias("oid"), "page")


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN '[Unknown]' ELSE 'Title ' || doc_id END AS title, source AS engine, lang, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE (doc_id % 2000)::INT END AS merge,
strlen(text) AS bytes, strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id * 61), '%Y-%m-%d %H:%M:%S') AS time, doc_id AS name FROM documents WHERE text IS NOT NULL""")
def cache_catalog(spark, read):
    docs = read("documents").filter("text is not null")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    id_, merged = F.col("doc_id"), F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise((F.col("doc_id") % 2000).cast("string"))
    every = F.array(pair("engine_name", F.col("source")), pair("target_lang", F.col("lang")), pair("merge_length", merged), pair("plugin_version", F.lit("1")))
    title = F.when(id_ % 5 == 0, every).otherwise(F.concat(every, F.array(pair("title", F.concat(F.lit("Title "), id_.cast("string"))))))
    info = docs.select(id_.alias("cache_id"), F.explode(title).alias("p")).select("cache_id", "p.key", "p.value")
    files = docs.select(id_.alias("cache_id"), F.octet_length("text").cast("long").alias("bytes"), F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + id_ * 61).alias("modified"))
    return C.catalog(info, files)


@query("SELECT (sum(strlen(text)) + 5000) // 10000 / 100.0::DOUBLE AS megabytes FROM documents")
def cache_total_size(spark, read):
    return C.total_megabytes(read("documents").select(F.octet_length("text").cast("long").alias("bytes")))


@query("SELECT doc_id, coalesce(strlen(text), 0) <= 50000 AS fresh FROM documents")
def cache_freshness(spark, read):
    return read("documents").select("doc_id", C.is_fresh(F.octet_length("text")).alias("fresh"))


# ---- translation ----------------------------------------------------------------------------------------------------

GLOSSARY = [("License", "Lizenz $1"), ("the ", "der\\die "), ("MIT", "MIT"), ("on", "auf")]
_TERMS = "replace(replace(replace(replace(text, 'License', '{{id_000000}}'), 'the ', '{{id_000001}}'), 'MIT', '{{id_000002}}'), 'on', '{{id_000003}}')"
_BACK = "replace(replace(replace(replace({x}, '{{{{id_000000}}}}', 'Lizenz $1'), '{{{{id_000001}}}}', 'der\\die '), '{{{{id_000002}}}}', 'MIT'), '{{{{id_000003}}}}', 'auf')"


@query(f"SELECT doc_id, md5({_TERMS}) AS h FROM documents")
def glossary_masking(spark, read):
    return read("documents").select("doc_id", F.md5(glossary_replace(F.col("text"), GLOSSARY)).alias("h"))


@query(f"SELECT doc_id, md5({_BACK.format(x=_TERMS)}) AS h FROM documents")
def glossary_round_trip(spark, read):
    loose = F.replace(F.replace(glossary_replace(F.col("text"), GLOSSARY), F.lit("{{id_000001}}"), F.lit("{ { id _ 000001 }")), F.lit("{{id_000003}}"), F.lit("{id_000003} }"))
    return read("documents").select("doc_id", F.md5(glossary_restore(loose, GLOSSARY)).alias("h"))


_SWAP = "translate({x}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')"


@query(f"WITH {D_CACHE} SELECT doc_id, oid, coalesce(translation, '') <> '' AS is_cache, md5(CASE WHEN coalesce(translation, '') <> '' THEN translation ELSE {d_strip(_SWAP.format(x='original'))} END) AS h, CASE WHEN coalesce(translation, '') <> '' THEN engine_name ELSE 'swap' END AS engine_name FROM cache WHERE NOT ignored")
def translate_stage(spark, read):
    rows = TR.translate(C.visible(cache_table(read)), TR.reversing, "swap", "xx")
    return rows.select("doc_id", F.col("oid").cast("long").alias("oid"), "is_cache", F.md5("translation").alias("h"), "engine_name")


@query(f"WITH {D_CACHE} SELECT doc_id, oid, false AS fresh FROM cache WHERE coalesce(translation, '') = ''")
def translate_all_policy(spark, read):
    return TR.to_translate(cache_table(read)).select("doc_id", F.col("oid").cast("long").alias("oid"), "fresh")


@query(f"WITH {D_CACHE} SELECT doc_id, oid, true AS fresh FROM cache WHERE page = 'page3'")
def translate_selected_policy(spark, read):
    return TR.to_translate_selected(cache_table(read), F.col("page") == "page3").select("doc_id", F.col("oid").cast("long").alias("oid"), "fresh")


@query("""WITH m AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
SELECT user_id, run::BIGINT AS run, count(*) AS n_errors, min(ts) AS first, max(ts) AS last FROM m WHERE event_type = 'error' GROUP BY user_id, run HAVING count(*) >= 3""")
def error_runs(spark, read):
    return TR.error_runs(read("events"), F.col("event_type") == "error", ["user_id"], ["ts", "event_id"], least=3)


@query("""WITH m AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
r AS (SELECT user_id, run, count(*) FILTER (WHERE event_type = 'error') AS n FROM m GROUP BY user_id, run)
SELECT user_id, run::BIGINT AS run, list_transform(range(1, n + 1), lambda i: 5 * i)::VARCHAR AS waits FROM r WHERE n > 0""")
def backoff_schedule(spark, read):
    runs = TR.error_runs(read("events"), F.col("event_type") == "error", ["user_id"], ["ts", "event_id"], least=1)
    waits = TR.backoff(F.col("n_errors").cast("int"))
    return runs.select("user_id", "run", F.concat(F.lit("["), F.array_join(F.transform(waits, lambda x: x.cast("string")), ", "), F.lit("]")).alias("waits"))


@query(f"WITH {D_LINES} SELECT count(*) AS items, sum(length(text))::BIGINT AS characters FROM lines")
def translation_totals(spark, read):
    return TR.totals(S.lines(read("documents")), "text")


@query(f"WITH {D_LINES} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) / count(*) OVER (PARTITION BY doc_id)::DOUBLE AS done FROM lines")
def translation_progress(spark, read):
    return TR.progress(S.lines(read("documents")), ["doc_id"], ["seq"]).select("doc_id", F.col("seq").cast("long").alias("seq"), "done")


# ---- exchange -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5('{\"custom_id\":\"' || md5(text) || '\",\"method\":\"POST\",\"url\":\"/v1/chat/completions\",\"body\":{\"model\":\"m\",\"messages\":[{\"role\":\"system\",\"content\":\"p\"},{\"role\":\"user\",\"content\":' || to_json(text) || '}]}}') AS h FROM documents WHERE text IS NOT NULL")
def batch_request_lines(spark, read):
    return read("documents").filter("text is not null").select("doc_id", F.md5(X.request_line(F.md5("text"), F.col("text"), "m", "p")).alias("h"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lower(text) END AS translation FROM documents WHERE text IS NOT NULL")
def batch_apply(spark, read):
    docs = read("documents").filter("text is not null").select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), "text")).alias("md5"), "text")
    message = F.struct(F.struct(F.lower("text").alias("content")).alias("message"))
    body = F.struct(F.when(F.col("doc_id") % 5 == 0, 500).otherwise(200).alias("status_code"), F.struct(F.array(message).alias("choices")).alias("body"))
    lines = docs.select(F.to_json(F.struct(F.col("md5").alias("custom_id"), body.alias("response"))).alias("value"))
    return docs.join(X.batch_answers(lines), "md5", "left").select("doc_id", "translation")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE turn < 4 AND text IS NOT NULL GROUP BY conv_id")
def stream_decode(spark, read):
    rows = read("conversations").select("conv_id", "turn", "text")
    chunk = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    line = F.when(F.col("turn") == 4, "data: [DONE]").otherwise(chunk)
    noise = rows.select("conv_id", (F.col("turn") * 2 + 1).alias("k"), F.lit(": keep-alive").alias("line"))
    broken = rows.select("conv_id", (F.col("turn") * 2 + 1).alias("k"), F.lit("data: {broken").alias("line"))
    events = rows.select("conv_id", (F.col("turn") * 2).alias("k"), line.alias("line")).union(noise).union(broken)
    return X.stream_texts(events, "conv_id", "k")


@query("SELECT conv_id, turn, text AS single, text AS nested, text AS chat, text AS messages, text AS pairs, text AS list, text AS result, text || '!' AS sentences, text || '?' AS candidates FROM conversations WHERE text IS NOT NULL")
def response_projection(spark, read):
    rows = read("conversations").filter("text is not null")
    one = lambda name: F.struct(F.col("text").alias(name))
    shapes = {
        "single": one("translation"), "nested": F.array(F.array("text")), "chat": F.struct(F.array(F.struct(one("content").alias("message"))).alias("choices")),
        "messages": F.struct(F.array(one("text")).alias("content")), "pairs": F.struct(F.array(one("text")).alias("translations")), "list": F.array(F.struct(F.array(one("text")).alias("translations"))),
        "result": F.struct(F.array(one("dst")).alias("trans_result")), "sentences": F.struct(F.array(one("trans"), F.struct(F.lit("!").alias("trans"))).alias("sentences")),
        "candidates": F.struct(F.array(F.struct(F.struct(F.array(one("text"), F.struct(F.lit("?").alias("text"))).alias("parts")).alias("content"))).alias("candidates")),
    }
    return rows.select("conv_id", "turn", *[X.answer(F.to_json(s), k).alias(k) for k, s in shapes.items()])


@query("SELECT doc_id, CASE WHEN length(text) <= 20 THEN text ELSE left(text, 10) || length(text) || right(text, 10) END AS short, sha256('app' || CASE WHEN length(text) <= 20 THEN text ELSE left(text, 10) || length(text) || right(text, 10) END || doc_id || '17' || 'key') AS sha, md5('app' || text || doc_id || 'key') AS md5, CASE WHEN length(text) <= 1800 THEN 'GET' ELSE 'POST' END AS method FROM documents WHERE text IS NOT NULL")
def request_signatures(spark, read):
    from tessera.functions.text import digest_input

    t, i = F.col("text"), F.col("doc_id")
    return read("documents").filter("text is not null").select("doc_id", digest_input(t).alias("short"), X.sha_signature("app", t, i, F.lit(17), "key").alias("sha"), X.md5_signature("app", t, i, "key").alias("md5"), X.http_method(t).alias("method"))


@query("SELECT doc_id, 1700000000000 + doc_id - (1700000000000 + doc_id) % (length(text) - length(replace(text, 'i', '')) + 1) + (length(text) - length(replace(text, 'i', '')) + 1) AS millis FROM documents WHERE text IS NOT NULL")
def rounded_time(spark, read):
    return read("documents").filter("text is not null").select("doc_id", X.rounded_time(F.col("text"), F.lit(1700000000000) + F.col("doc_id")).alias("millis"))


#: Definitions of engines made of texts, each spoilt in a way that the text's length chooses, with the error that it has.
_SPOILT = (
    ("text", "not JSON"), ("to_json([text])", "not an object"), ("""'{"languages":{}}'""", "no name"), ("""'{"name":"Taken"}'""", "name is taken"), ("""'{"name":' || to_json(text) || '}'""", "no languages"),
    ("""'{"name":' || to_json(text) || ',"languages":{"source":{}}}'""", "source or target missing"), ("""'{"name":' || to_json(text) || ',"languages":{"source":{},"target":{}}}'""", "no request"),
    ("""'{"name":' || to_json(text) || ',"languages":{"a":"b"},"request":{"data":"x"}}'""", "no url"), ("""'{"name":' || to_json(text) || ',"languages":{"a":"b"},"request":{"url":"u","data":{"t":1}}}'""", "no <text> in data"),
    ("""'{"name":' || to_json(text) || ',"languages":{"a":"b"},"request":{"url":"u","data":{"t":"<text>"},"headers":["x"]}}'""", "headers are no object"),
    ("""'{"name":' || to_json(text) || ',"languages":{"a":"b"},"request":{"url":"u","data":"<text>"}}'""", "no content type"),
    ("""'{"name":' || to_json(text) || ',"languages":{"a":"b"},"request":{"url":"u","data":{"t":"<text>"}}}'""", "no response expression"),
    ("""'{"name":' || to_json(text) || ',"languages":{"a":"b"},"request":{"url":"u","data":{"t":"<text>"}},"response":"response"}'""", None),
)


@query("SELECT doc_id, CASE length(text) % 13 " + " ".join(f"WHEN {k} THEN " + (f"'{e}'" if e else "NULL") for k, (_, e) in enumerate(_SPOILT)) + " END AS error FROM documents WHERE text IS NOT NULL AND length(text) > 9")
def engine_validation(spark, read):
    docs = read("documents").filter("text is not null and length(text) > 9").withColumn("q", F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1))
    case = "case length(text) % 13 " + " ".join(f"when {k} then {d.replace('to_json([text])', concat).replace('to_json(text)', 'q')}" for concat in ["concat('[', q, ']')"] for k, (d, _) in enumerate(_SPOILT)) + " end"
    return docs.select("doc_id", X.engine_error(F.expr(case), F.array(F.lit("taken"))).alias("error"))


@query("SELECT doc_id, 'Translate from ' || lang || ' to XX. Ensure that placeholders matching the pattern {{id_\\d+}} in the content are retained.' AS prompt FROM documents")
def prompt_templates(spark, read):
    return read("documents").select("doc_id", X.prompt("Translate from <slang> to <tlang>.", F.col("lang"), F.lit("XX"), True).alias("prompt"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;'), chr(39), '&#39;'), '|', '&#x7c;') AS sent, text AS answer FROM documents WHERE text IS NOT NULL")
def escaped_answers(spark, read):
    t = F.col("text")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("'", "&#39;"), ("|", "&#x7c;")):
        t = F.replace(t, F.lit(char), F.lit(name))
    rows = read("documents").filter("text is not null").select("doc_id", t.alias("sent"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("sent").alias("translatedText"))).alias("translations")).alias("data")))
    return rows.select("doc_id", "sent", X.answer(body, "data").alias("answer"))


@query("SELECT conv_id, turn, regexp_replace(text, ' ([a-z])', ' <m id=0000' || (turn % 10) || ' />\\1', 'g') AS sent, regexp_replace(text, ' ([a-z])', ' {{id_0000' || (turn % 10) || '}}\\1', 'g') AS back FROM conversations WHERE text IS NOT NULL")
def service_placeholders(spark, read):
    mark = F.concat(F.lit(" {{id_0000"), (F.col("turn") % 10).cast("string"), F.lit("}}$1"))
    rows = read("conversations").filter("text is not null").select("conv_id", "turn", F.regexp_replace("text", F.lit(" ([a-z])"), mark).alias("marked"))
    sent = X.service_marks(F.col("marked"))
    return rows.select("conv_id", "turn", sent.alias("sent"), X.from_service_marks(F.replace(sent, F.lit(" />"), F.lit("  />"))).alias("back"))


@query("SELECT c_custkey, n_nationkey AS used, floor(c_acctbal)::BIGINT AS total, floor(c_acctbal)::BIGINT - n_nationkey AS left FROM customer JOIN nation ON c_nationkey = n_nationkey")
def usage_quota(spark, read):
    rows = read("customer").select("c_custkey", F.to_json(F.struct(F.floor("c_acctbal").alias("character_limit"), F.col("c_nationkey").alias("character_count"))).alias("answer"))
    return rows.select("c_custkey", X.quota(F.col("answer")).alias("q")).select("c_custkey", "q.used", "q.total", "q.left")


# ---- review ---------------------------------------------------------------------------------------------------------

_GRID = f"""{D_CACHE}, grid AS (SELECT *, CASE WHEN oid % 11 = 5 THEN 'failed' END AS error, oid % 4 <> 3 OR coalesce(translation, '') = '' AS aligned FROM cache WHERE NOT ignored)"""


def _grid(read):
    rows = C.visible(cache_table(read))
    aligned = (F.col("oid") % 4 != 3) | C.untranslated(F.col("translation"))
    return rows.withColumn("error", F.when(F.col("oid") % 11 == 5, "failed")).withColumn("aligned", aligned)


@query(f"WITH {_GRID} SELECT CASE WHEN error IS NOT NULL THEN 'red' WHEN coalesce(translation, '') = '' THEN 'gray' WHEN NOT aligned THEN 'yellow' ELSE 'green' END AS status, count(*) AS n FROM grid GROUP BY 1")
def status_counts(spark, read):
    return _grid(read).groupBy(G.status(F.col("translation"), F.col("error"), F.col("aligned")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _category(name, condition):
    def run(spark, read):
        return G.by_category(_grid(read), name).select("doc_id", F.col("oid").cast("long").alias("oid"))

    run.__name__ = f"category_{name}"
    query(f"WITH {_GRID} SELECT doc_id, oid FROM grid WHERE {condition}")(run)


_category("non_aligned", "NOT aligned")
_category("translated", "coalesce(translation, '') <> ''")
_category("untranslated", "coalesce(translation, '') = ''")


@query(f"WITH {_GRID} SELECT doc_id, oid FROM grid WHERE coalesce(translation, '') <> '' AND contains(lower(coalesce(original, '')), 'license')")
def keyword_search(spark, read):
    return G.search(G.by_category(_grid(read), "translated"), "LICENSE", "original").select("doc_id", F.col("oid").cast("long").alias("oid"))


@query(f"WITH {_GRID} SELECT doc_id, oid FROM grid WHERE page = 'page3'")
def select_by_page(spark, read):
    return _grid(read).filter(F.col("page") == "page3").select("doc_id", F.col("oid").cast("long").alias("oid"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '3'")
def select_by_attribute(spark, read):
    return G.with_attribute(read("events"), "k", "3", "props").select("event_id")


@query(f"WITH {_GRID}, s AS (SELECT DISTINCT doc_id, oid FROM grid WHERE coalesce(translation, '') = '' AND oid % 5 <> 2), i AS (SELECT doc_id, oid, oid - row_number() OVER (PARTITION BY doc_id ORDER BY oid) AS g FROM s) SELECT doc_id, min(oid) AS first, max(oid) AS last FROM i GROUP BY doc_id, g")
def selection_ranges(spark, read):
    rows = G.by_category(_grid(read), "untranslated").filter("oid % 5 <> 2").select("doc_id", F.col("oid").cast("long").alias("oid"))
    return G.ranges(rows, "oid", ["doc_id"])


@query(f"WITH {D_LINES}, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM lines) SELECT doc_id, (((i + 1) * least(3, n) - 1) // n)::INT AS chunk, count(*) AS items FROM n GROUP BY 1, 2")
def chunk_bounds(spark, read):
    w = Window.partitionBy("doc_id")
    rows = S.lines(read("documents")).select("doc_id", (F.row_number().over(w.orderBy("seq")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.groupBy("doc_id", G.chunk_of(F.col("i"), F.col("n"), F.lit(3)).alias("chunk")).agg(F.count(F.lit(1)).alias("items"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang DESC, doc_id DESC) AS place FROM documents")
def catalog_sort_descending(spark, read):
    order = Window.partitionBy("source").orderBy(*G.catalog_order("lang", True, "doc_id"))
    return read("documents").select("source", "doc_id", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT doc_id, row_number() OVER (ORDER BY source DESC, doc_id DESC) - 1 AS row FROM documents")
def catalog_row_index(spark, read):
    return G.row_index(read("documents").select("doc_id", "source"), G.catalog_order("source", True, "doc_id")).select("doc_id", "row")


#: Letters of four languages as the entities that services may send them as.
_LETTERS = {"é": "&eacute;", "ü": "&uuml;", "ñ": "&ntilde;", "ß": "&szlig;", "ç": "&#231;", "è": "&#xE8;", "ö": "&ouml;", "ä": "&auml;", "ó": "&oacute;"}


@query("SELECT doc_id, md5(replace(text, '&', '')) AS h FROM documents")
def unescape_entities(spark, read):
    escaped = F.replace("text", F.lit("&"), F.lit(""))
    for letter, entity in _LETTERS.items():
        escaped = F.replace(escaped, F.lit(letter), F.lit(entity))
    return read("documents").select("doc_id", F.md5(X.unescape(escaped)).alias("h"))


@query(f"WITH {_GRID} SELECT count(*) AS items, sum(length(original))::BIGINT AS characters, count(*) FILTER (WHERE page = 'page1') AS selected_items, sum(length(original)) FILTER (WHERE page = 'page1')::BIGINT AS selected_characters FROM grid")
def grid_counts(spark, read):
    return G.counts(_grid(read), F.col("page") == "page1")


@query(f"WITH {_GRID} SELECT bool_or(coalesce(translation, '') <> '') AS ready, bool_or(NOT aligned) AS warn FROM grid")
def output_guard(spark, read):
    return G.can_output(_grid(read))


@query(f"WITH {D_PAIRS} SELECT count(*) FILTER (WHERE len(string_split({d_strip('original')}, chr(10))) <> len(string_split({d_strip('translation')}, chr(10))) AND {d_strip('translation')} <> '') AS n FROM pairs WHERE translation IS NOT NULL")
def misaligned_count(spark, read):
    return pairs(read).agg(F.count_if(~A.is_aligned(F.col("original"), F.col("translation"), "\n")).alias("n"))


@query(f"WITH {D_PAIRS} SELECT conv_id, turn, count(*) FILTER (WHERE len(string_split({d_strip('original')}, chr(10))) <> len(string_split({d_strip('translation')}, chr(10))) AND {d_strip('translation')} <> '') OVER (PARTITION BY conv_id ORDER BY turn) AS misaligned FROM pairs WHERE translation IS NOT NULL")
def misaligned_running(spark, read):
    rows = TR.running_misaligned(pairs(read).filter("translation is not null"), A.is_aligned(F.col("original"), F.col("translation"), "\n"), ["conv_id"], ["turn"])
    return rows.select("conv_id", "turn", "misaligned")


# ---- formats, over texts made of documents ----------------------------------------------------------------------------


def _subtitles(read):
    rows = S.lines(read("documents")).select("doc_id", F.col("seq").cast("int").alias("seq"), (F.col("seq") + 1).cast("string").alias("number"), F.concat(F.col("seq").cast("string"), F.lit(" --> x")).alias("time"), "text")
    return rows, W.subtitle_text(rows, "doc_id")


@query(f"WITH {D_LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS k, (seq + 1)::VARCHAR AS number, seq || ' --> x' AS time, text FROM lines")
def subtitle_round_trip(spark, read):
    _, files = _subtitles(read)
    return files.select("doc_id", F.posexplode(R.subtitles(F.col("text"))).alias("k", "e")).select("doc_id", F.col("k").cast("long").alias("k"), "e.number", "e.time", "e.text")


@query(f"WITH {D_LINES} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(replace(replace(text, '}}', ''), '{{', ''), '[a-zA-z]')) AS n, md5(string_agg('{{' || CASE WHEN regexp_matches(replace(replace(text, '}}', ''), '{{', ''), '[a-zA-z]') THEN lower(replace(replace(text, '}}', ''), '{{', '')) || ' | ' || replace(replace(text, '}}', ''), '{{', '') ELSE replace(replace(text, '}}', ''), '{{', '') END || '}}', ' e4 ' ORDER BY seq)) AS h FROM lines GROUP BY doc_id")
def game_comment_round_trip(spark, read):
    bare = F.replace(F.replace("text", F.lit("}")), F.lit("{"))
    rows = S.lines(read("documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("{"), bare, F.lit("}")).alias("c")))).alias("c"))
    games = rows.select("doc_id", F.array_join(F.transform("c", lambda x: x["c"]), " e4 ").alias("game"))
    games = games.withColumn("found", R.game_comments(F.col("game")))
    new = F.transform("found", lambda c: F.struct(c.alias("raw"), W.place_comment(c, R.comment_text(c), F.lower(R.comment_text(c)), "above").alias("new")))
    return games.select("doc_id", F.size("found").cast("long").alias("n"), F.md5(W.replace_comments(F.col("game"), new)).alias("h"))


@query("SELECT doc_id, name, md5(text) AS h, 'content.opf' AS page, true AS ignored FROM (SELECT doc_id, 'title' AS name, text FROM documents UNION ALL SELECT doc_id, 'subject', source FROM documents UNION ALL SELECT doc_id, 'subject', n_chars::VARCHAR FROM documents) WHERE regexp_matches(text, '[a-zA-Z]+')")
def metadata_entries(spark, read):
    texts = F.create_map(F.lit("title"), F.array("text"), F.lit("subject"), F.array("source", F.col("n_chars").cast("string")), F.lit("language"), F.array("lang"))
    return R.metadata(read("documents").select("doc_id", texts.alias("metadata")), "doc_id").select("doc_id", "name", F.md5("text").alias("h"), "page", "ignored")


@query("""WITH n AS (SELECT n_name, n_nationkey, n_regionkey FROM nation)
SELECT 0 AS book, k AS place, title, 'toc.ncx' AS page FROM (SELECT r_regionkey::VARCHAR AS k, r_name AS title FROM region UNION ALL SELECT n_regionkey || '.' || n_nationkey, n_name FROM n
 UNION ALL SELECT n_regionkey || '.' || n_nationkey || '.' || c_custkey, c_name FROM customer JOIN n ON c_nationkey = n_nationkey)""")
def contents_flatten(spark, read):
    none = F.lit(None).cast("string")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = read("region").select(key("r", "r_regionkey").alias("node"), none.alias("parent"), F.col("r_regionkey").alias("seq"), F.col("r_name").alias("title"))
    nodes = nodes.union(read("nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_nationkey", "n_name")).union(read("customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), "c_custkey", "c_name"))
    rows = R.contents(nodes.withColumn("book", F.lit(0)), "book")
    return rows.select("book", F.array_join(F.transform("place", lambda x: x.cast("string")), ".").alias("place"), "title", "page")


@query("SELECT doc_id, left(regexp_replace(text, '[\\\\/:*?\"<>|\\x{00}-\\x{1f}]', '_', 'g'), 200) AS name, left(text, 20) || ' [T]' AS title, lang AS language FROM documents")
def output_names(spark, read):
    title, language, _ = W.output_metadata(F.left("text", F.lit(20)), F.col("lang"), F.array("source"), "T", ["translated"])
    return read("documents").select("doc_id", W.file_name(F.col("text")).alias("name"), title, language)


@query(f"""WITH {D_LINES}, t AS (SELECT doc_id AS book, 0 AS rank, 0 AS a, 0 AS b, 'title' AS page, {d_trim("source || ' Book'")} AS text, true AS ignored FROM documents
  UNION ALL SELECT doc_id, 1, seq, 0, 'toc.ncx', text, {d_no_letters('text')} FROM lines WHERE seq % 3 = 0
  UNION ALL SELECT doc_id, 2, 20 - (seq % 20), seq, 'p' || (20 - (seq % 20)) || '.html', text, {d_no_letters('text')} FROM lines)
SELECT book, CASE rank WHEN 0 THEN 'metadata' WHEN 1 THEN 'contents' ELSE 'page' END AS part, oid, md5(oid::VARCHAR || text) AS md5, ignored FROM (
  SELECT *, row_number() OVER (PARTITION BY book ORDER BY rank, a, b) - 1 AS oid FROM t WHERE text <> '')""")
def book_numbering(spark, read):
    docs = read("documents")
    meta = R.metadata(docs.select(F.col("doc_id").alias("book"), F.create_map(F.lit("title"), F.array(F.concat("source", F.lit(" Book")))).alias("metadata")), "book")
    rows = materialise(S.lines(docs).withColumnRenamed("doc_id", "book"), "lines")  # trimmed once, read for contents and pages
    toc = rows.filter("seq % 3 = 0").select("book", F.array(F.col("seq").cast("long")).alias("place"), F.col("text").alias("title"), F.lit("toc.ncx").alias("page"))
    page = F.concat(F.lit("p"), (20 - F.col("seq") % 20).cast("string"), F.lit(".html"))
    pages = rows.select("book", page.alias("page"), "seq", "raw", "text", F.lit(False).alias("ignored"))
    return S.number_book(meta, toc, pages).select("book", "part", F.col("oid").cast("long").alias("oid"), "md5", "ignored")
