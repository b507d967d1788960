"""What goes to services and comes back: request lines, answers of many shapes, event streams, signatures."""

from __future__ import annotations

import html
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import digest_input, uid

#: Where the answers of services keep their text: paths tried in this order (fixed values of their formats).
ANSWER_PATHS = {
    "single": ("$.translation",),
    "nested": ("$[0][0]",),
    "chat": ("$.choices[0].message.content", "$.choices[0].message.content[0].text", "$.choices[0].text", "$.content[0].text"),
    "messages": ("$.content[0].text",),
    "pairs": ("$.translations[0].text",),
    "list": ("$[0].translations[0].text",),
    "result": ("$.trans_result[0].dst",),
}
#: Answers in many parts that are joined: the array and the field.
JOINED = {
    "sentences": ("$.sentences", "trans"),
    "data": ("$.data.translations", "translatedText"),
    "translations": ("$.translations", "translatedText"),
    "candidates": ("$.candidates[0].content.parts", "text"),
}


def answer(response: Column, kind: str) -> Column:
    """The text of a service's answer; null where it has none. Services that escape their text have it unescaped."""
    if kind in ANSWER_PATHS:
        return F.coalesce(*[F.get_json_object(response, p) for p in ANSWER_PATHS[kind]])
    path, field = JOINED[kind]
    parts = F.from_json(F.get_json_object(response, path), f"array<struct<{field}:string>>")
    texts = F.transform(parts, lambda x: x[field])
    return F.array_join(unescape_all(texts) if kind in ESCAPED else texts, "")


def unescape(c: Column) -> Column:
    """A text with the named and numbered entities of HTML replaced, each once from the left; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: html.unescape(x) if x and "&" in x else x)

    return F.pandas_udf(run, "string")(c)


def unescape_all(c: Column) -> Column:
    """An array of texts, each unescaped."""

    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: a if a is None else [html.unescape(x) if x else x for x in a])

    return F.pandas_udf(run, "array<string>")(c)


#: Kinds of JOINED whose texts are escaped.
ESCAPED = ("data",)


def service_marks(c: Column) -> Column:
    """Placeholders {{id_00012}} in the form that services of markup keep: <m id=00012 />."""
    return F.regexp_replace(c, r"\{\{id_(\d+)\}\}", "<m id=$1 />")


def from_service_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"<m\s+id=\s*(\d+)\s*/>", "{{id_$1}}")


def request_line(md5: Column, text: Column, model: str, prompt: str, url: str = "/v1/chat/completions") -> Column:
    """A line of a batch file for one paragraph."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(prompt)), message("user", text)).alias("messages"))
    return F.to_json(F.struct(md5.alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body")))


def batch_answers(lines: DataFrame, column: str = "value") -> DataFrame:
    """md5 and translation of the lines with status 200."""
    kind = "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>"
    rows = lines.select(F.from_json(column, kind).alias("r")).filter("r.response.status_code = 200")
    return rows.select(F.col("r.custom_id").alias("md5"), F.get("r.response.body.choices", F.lit(0))["message"]["content"].alias("translation"))


def stream_texts(events: DataFrame, by: str, order: str, line: str = "line", kind: str = "chat") -> DataFrame:
    """by, text: the pieces of each event stream (rows of lines) joined in order, up to its end mark. Lines that aren't
    data, and data that isn't JSON, give nothing. A payload may itself hold the mark 'data: '."""
    payload = F.regexp_extract(F.trim(F.col(line)), "(?s)^data: ?(.*)$", 1)
    paths = {
        "chat": ("$.choices[0].delta.content", "$.choices[0].content[0].text", "$.choices[0].content", "$.choices[0].text"),
        "messages": ("$.delta.text",),
        "candidates": ("$.candidates[0].content.parts[0].text",),
    }[kind]
    end = {"chat": payload == "[DONE]", "messages": F.get_json_object(payload, "$.type") == "message_stop", "candidates": F.get_json_object(payload, "$.candidates[0].finishReason") == "STOP"}[kind]
    rows = events.filter(F.col(line).startswith("data:")).select(by, order, F.coalesce(end, F.lit(False)).alias("end"), F.coalesce(*[F.get_json_object(payload, p) for p in paths]).alias("piece"))
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if kind != "candidates" else -1)
    rows = rows.withColumn("over", F.coalesce(F.max(F.col("end").cast("int")).over(before), F.lit(0)))
    pieces = F.array_sort(F.collect_list(F.when((F.col("over") == 0) & F.col("piece").isNotNull(), F.struct(F.col(order), F.col("piece")))))
    return rows.groupBy(by).agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("text"))


def sha_signature(app: str, text: Column, salt: Column, time: Column, secret: str) -> Column:
    return F.sha2(F.concat(F.lit(app), digest_input(text), salt.cast("string"), time.cast("string"), F.lit(secret)), 256)


def md5_signature(app: str, text: Column, salt: Column, secret: str) -> Column:
    return uid(F.lit(app), text, salt, F.lit(secret))


def rounded_time(text: Column, millis: Column) -> Column:
    """A time that is a multiple of one more than the number of i in the text, as one service expects."""
    n = F.length(text) - F.length(F.replace(text, F.lit("i"), F.lit(""))) + 1
    return millis - millis % n + n


def http_method(text: Column, most: int = 1800) -> Column:
    return F.when(F.length(text) <= most, "GET").otherwise("POST")


def quota(answer_json: Column) -> Column:
    """struct<total, used, left> of a usage answer, which is read once; null if it is none."""
    read = F.from_json(answer_json, "struct<character_limit:long,character_count:long>")
    return F.transform(F.array(read), lambda u: F.struct(u["character_limit"].alias("total"), u["character_count"].alias("used"), (u["character_limit"] - u["character_count"]).alias("left")))[0]


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """A template with <name> replaced, in the order given; JSON escapes are the caller's."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value)
    return out


def prompt(template: str, source: Column, target: Column, merged_marks: bool = False) -> Column:
    """A prompt for a language pair; with marks between paragraphs it asks to keep them."""
    p = fill(template, {"slang": source, "tlang": target})
    return F.concat(p, F.lit(" Ensure that placeholders matching the pattern {{id_\\d+}} in the content are retained.")) if merged_marks else p


def parse_custom(response: Column, path: str | None = None, xpath: str | None = None) -> Column:
    """The text of a custom service's answer: by a JSON path, an XPath, or as it is. Nothing is evaluated."""
    if path:
        return F.get_json_object(response, path)
    return F.xpath_string(response, F.lit(xpath)) if xpath else response


#: Why a custom engine's definition is refused, in the order of the checks.
ENGINE_ERRORS = (
    "not JSON", "not an object", "no name", "name is taken", "no languages", "source or target missing", "no request",
    "no url", "no <text> in data", "headers are no object", "no content type", "no response expression",
)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; null is none. try_parse_json() reads the first value and leaves
    what follows, so the text is read as the only item of an array and as the first of two: where it ends the array
    itself, or is several items, both have a second item or neither has."""
    second = lambda after: F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(after))), "$[1]", "variant")
    return second("]").isNull() & second(",0]").isNotNull()


def engine_error(text: Column, taken: Column) -> Column:
    """The first of ENGINE_ERRORS that a definition has, else null; taken: lower-case names in use. Each level of the
    definition is read once."""
    void = lambda c: c.isNull() | c.isin("", "{}", "[]", "0", "false")

    def first(text: Column, valid: Column, d: Column, languages: Column, request: Column) -> Column:
        data, headers = request["data"], request["headers"]
        names = F.transform(F.json_object_keys(headers), F.lower)
        typed = ~void(headers) & F.coalesce(F.array_contains(names, "content-type"), F.lit(False))
        checks = [
            ~valid, ~F.trim(text).startswith("{"), void(d["name"]), F.array_contains(taken, F.lower(d["name"])), void(d["languages"]),
            languages["source"].isNotNull() != languages["target"].isNotNull(), void(d["request"]), request["url"].isNull(), ~F.contains(data, F.lit("<text>")),
            ~void(headers) & ~F.trim(headers).startswith("{"), data.isNotNull() & ~data.rlike(r"^[\[{]") & ~typed, ~F.coalesce(F.contains(d["response"], F.lit("response")), F.lit(False)),
        ]
        out = F.when(checks[0], ENGINE_ERRORS[0])
        for c, name in zip(checks[1:], ENGINE_ERRORS[1:], strict=True):
            out = out.when(F.coalesce(c, F.lit(False)), name)
        return out

    def parts(t: Column, valid: Column) -> Column:
        tops = F.array(F.from_json(F.when(valid, t), "name string, languages string, request string, response string"))
        levels = F.transform(tops, lambda d: F.struct(
            d.alias("d"), F.from_json(d["languages"], "source string, target string").alias("languages"), F.from_json(d["request"], "url string, data string, headers string").alias("request")
        ))
        return F.transform(levels, lambda p: first(t, valid, p["d"], p["languages"], p["request"]))[0]

    read = F.transform(F.array(text), lambda t: F.struct(t.alias("text"), is_json(t).alias("valid")))
    return F.transform(read, lambda r: parts(r["text"], r["valid"]))[0]
