"""Documents to segments: lines, rules, numbers, and units of bounded length.

A document is a row. Its lines are trimmed, filtered, numbered and merged as an array inside the row and become rows last,
so that no text is shuffled. Everything carries its order; no step depends on the order in which Spark keeps rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.html import invalid_selectors
from tessera.functions.text import literal_pattern, natural_key, trim_text, uid
from tessera.runtime import ranged, row_index, ship

#: Names of metadata that hold text to translate (fixed values).
METADATA = ("title", "creator", "publisher", "rights", "subject", "contributor", "description")

#: Texts of these characters alone need no translation (fixed values of the rule).
NO_LETTERS = r"""^[-\p{Nd}\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.'\\"‘’“”,=~!@#$%^&º*|≈<>?/`—…+:–_(){}\[\]]+$"""


def _lines(text: Column) -> Column:
    """array<struct<seq, raw, text>>: the lines of a text, trimmed, but those without text."""
    rows = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("seq"), x.alias("raw"), trim_text(x).alias("text")))
    return F.filter(rows, lambda x: x["text"] != "")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq, raw, text: a row a line, trimmed; lines without text are dropped."""
    return docs.select(key, F.inline(_lines(F.col(text))))


def rule_pattern(rule: str, mode: str) -> str:
    """normal: the words in any case, of any alphabet; case: the words; regex: the pattern."""
    if mode not in ("normal", "case", "regex"):
        raise ValueError(f"no mode of rules: {mode}")
    return rule if mode == "regex" else ("(?iu)" if mode == "normal" else "") + literal_pattern(rule)


def rule_errors(rules: Sequence[str], mode: str) -> list[str]:
    """Rules that the engine that applies them can't compile: patterns by Spark's, or selectors (mode selector)."""
    if mode == "selector":
        return invalid_selectors(rules)
    if mode != "regex":
        return []
    spark = SparkSession.active()

    def compiles(rule: str) -> bool:
        try:
            spark._jvm.java.util.regex.Pattern.compile(rule)
        except (Py4JJavaError, IllegalArgumentException):
            return False
        return True

    return [r for r in rules if not compiles(r)]


def ignored(text: Column, raw: Column | None = None, rules: Sequence[str] = (), mode: str = "normal", scope: str = "text") -> Column:
    """Whether a segment matches the rule of no letters or one of rules; with scope html also by its markup. The escaped
    angle brackets of the text don't count."""
    bare = F.replace(F.replace(text, F.lit("&lt;"), F.lit("")), F.lit("&gt;"), F.lit(""))
    patterns = [NO_LETTERS, *(rule_pattern(r, mode) for r in rules)]
    found = [c.rlike(p) for p in patterns for c in ([bare, raw] if scope == "html" and raw is not None else [bare])]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def numbered(segments: DataFrame, key: str = "doc_id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """With oid, which counts all segments of a document from 0, ignored ones too, and md5 of oid and text. A document may be
    of any size: it is counted by ranges of its order."""
    rows = row_index(segments, [F.col(c).asc() for c in order], "oid", [key])
    return rows.withColumn("oid", F.col("oid").cast("int")).withColumn("md5", uid(F.col("oid"), F.col("text")))


def _segments(text: Column, rules: Sequence[str], mode: str, scope: str) -> Column:
    """array<struct<oid, md5, raw, text, ignored>> of a text. All segments count, ignored ones too."""
    one = lambda x, i: F.struct(i.alias("oid"), uid(i, x["text"]).alias("md5"), x["raw"].alias("raw"), x["text"].alias("text"), ignored(x["text"], x["raw"], rules, mode, scope).alias("ignored"))
    return F.transform(_lines(text), one)


def segment(docs: DataFrame, rules: Sequence[str] = (), mode: str = "normal", scope: str = "text", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, oid, md5, raw, text, ignored of every segment of docs; each row of docs counts from 0."""
    return docs.select(key, F.inline(_segments(F.col(text), rules, mode, scope)))


def _unit(part: Column, k: Column, most: int, separator: str) -> Column:
    """The k-th unit of a document, of an array of segments (text, raw)."""
    w, sep = len(separator), F.lit(separator)
    texts, raws, n = F.transform(part, lambda x: x["text"]), F.transform(part, lambda x: x["raw"]), F.size(part)
    text = F.concat(F.array_join(texts, separator), sep)
    fits_first = (k == 0) & (F.length(texts[0]) + w < most)
    # raw texts have a separator behind a segment that joined a unit; one that begins a unit behind another has none
    head = F.when(fits_first | (n == 1), F.lit("")).otherwise(raws[0])
    rest = F.array_join(F.when(fits_first | (n == 1), raws).otherwise(F.slice(raws, 2, F.greatest(n - 1, F.lit(0)))), separator)
    raw = F.concat(head, rest, F.when((n > 1) | fits_first, sep).otherwise(F.lit("")))
    return F.struct(k.alias("oid"), uid(k, text).alias("md5"), n.alias("n"), raw.alias("raw"), text.alias("text"))


def _merged(s: Column, most: int, separator: str) -> Column:
    """array<struct<oid, md5, n, raw, text>> of an array of segments (text, raw) in order. The walk keeps the places where
    units begin, so its time is in proportion to the segments."""
    w = len(separator)
    zero = F.struct(F.lit(0).alias("len"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        size = F.length(x["text"]) + w
        fits = (acc["i"] > 0) & (acc["len"] + size < most)
        return F.struct(
            F.when(fits, acc["len"] + size).otherwise(size).alias("len"), F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"), (acc["i"] + 1).alias("i")
        )

    def parts(acc: Column) -> Column:
        following = lambda k: F.coalesce(F.get(acc["starts"], k + 1), acc["i"])
        return F.transform(acc["starts"], lambda at, k: F.slice(s, at + 1, following(k) - at))

    return F.transform(F.aggregate(s, zero, step, parts), lambda part, k: _unit(part, k, most, separator))


def merge_documents(
    docs: DataFrame, most: int = 1800, separator: str = "\n\n", rules: Sequence[str] = (), mode: str = "normal", scope: str = "text", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """merge(segment(docs)) inside each row: no text is shuffled."""
    kept = docs.select(key, F.filter(_segments(F.col(text), rules, mode, scope), lambda x: ~x["ignored"]).alias("s"))
    return kept.select(key, F.inline(_merged(F.col("s"), most, separator)))


def merge(segments: DataFrame, most: int = 1800, separator: str = "\n\n", key: str = "doc_id") -> DataFrame:
    """Units of consecutive segments: key, oid, md5, n (segments), raw, text.

    A segment with its separator joins the unit before it while both together stay under `most` characters; a longer
    segment is a unit of its own. Ignored segments are left out and count for nothing. The raw text has a separator
    after a segment that joins a unit, but none after one that begins a unit behind another.
    The walk is in order within a document, and documents are walked side by side.
    """
    per_doc = segments.filter("not ignored").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("oid", "text", "raw"))).alias("s"))
    return per_doc.select(key, F.inline(_merged(F.col("s"), most, separator)))


def merge_long(segments: DataFrame, most: int = 1800, separator: str = "\n\n", key: str = "doc_id") -> DataFrame:
    """merge() where a document may be larger than a task: no task holds one, and the result is the same.

    Segments are dealt out by ranges of their order. All that a range needs to know of those before is how long the unit is
    that is open where it begins, which is a number up to `most`; so each range tells, for every such length, how long
    the unit is that it leaves open and how many it begins. These tables, one a range, are put one behind another, and
    each range then knows its units. Units are bounded, and each is put together for itself.
    """
    kept = segments.filter("not ignored").select(F.col(key).alias("k"), "oid", "text", "raw", (F.length("text") + len(separator)).cast("int").alias("size"))
    ship(segments.sparkSession)
    kind = dict(kept.dtypes)["k"]
    rows = ranged(kept, [F.col("k").asc(), F.col("oid").asc()], "part", "place")
    tables = rows.select("k", "part", "place", "size").groupBy("part").applyInArrow(lambda t: _open_units(t, most), "part long, turns boolean, opens array<int>, begins array<int>, ends string")
    tables = tables.groupBy().applyInArrow(_chained, "part long, open int, begun long")  # a row a range
    placed = rows.join(F.broadcast(tables.withColumnRenamed("part", "p")), F.col("part") == F.col("p")).drop("p")
    units = placed.groupBy("part").applyInArrow(lambda t: _in_units(t, most), f"k {kind}, oid long, text string, raw string, unit long")
    parts = F.array_sort(F.collect_list(F.struct("oid", "text", "raw")))
    return units.groupBy("k", "unit").agg(parts.alias("s")).select(F.col("k").alias(key), F.inline(F.array(_unit(F.col("s"), F.col("unit").cast("int"), most, separator))))


def _runs(t: pa.Table) -> tuple[pa.Table, list[int]]:
    """A range in order, and where each document begins in it, with its end."""
    t = t.sort_by("place")
    keys = t["k"].to_pylist()
    return t, [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]] + [len(keys)]


def _walked(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """(sums, next, open, begun) of a run of sizes: where the unit ends that begins at each, and how long the last unit is
    and how many begin if one does there."""
    sums, n = np.concatenate([[0], np.cumsum(sizes)]), len(sizes)
    following = np.maximum(np.searchsorted(sums, sums[:-1] + most) - 1, np.arange(1, n + 1))
    left, begun = [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        j = int(following[k])
        left[k], begun[k] = (left[j], begun[j] + 1) if j < n else (min(int(sums[n] - sums[k]), most), 1)
    return sums, following, left, begun


def _open_units(t: pa.Table, most: int) -> pa.Table:
    """A range's table: for each length of the open unit before it, the open unit behind it and the units that begin in the
    first document of it, then both if that begins here, and both of the last document. ends: the first and the last one."""
    t, at = _runs(t)
    sizes, keys = t["size"].to_numpy(), t["k"]
    _, _, left, begun = _walked(sizes[: at[1]], most)
    n = at[1]
    sums = np.concatenate([[0], np.cumsum(sizes[:n])])
    first = np.maximum(np.searchsorted(sums, most - np.arange(most + 1)) - 1, 0)  # where the first unit begins
    opens = [left[e] if e < n else min(k + int(sums[n]), most) for k, e in enumerate(first.tolist())]
    begins = [begun[e] if e < n else 0 for e in first.tolist()]
    fresh = [left[0], begun[0]]
    if len(at) > 2:  # the last document begins here
        _, _, left, begun = _walked(sizes[at[-2] :], most)
        tail = [left[0], begun[0]]
    else:
        tail = fresh
    row = {"part": t["part"][0].as_py(), "turns": len(at) > 2, "opens": [*opens, *fresh, *tail], "begins": begins, "ends": json.dumps([repr(keys[0].as_py()), repr(keys[len(keys) - 1].as_py())])}
    kinds = pa.schema([("part", pa.int64()), ("turns", pa.bool_()), ("opens", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())), ("ends", pa.string())])
    return pa.Table.from_pylist([row], kinds)


def _chained(t: pa.Table) -> pa.Table:
    """How long the open unit is before each range and how many units of its document have begun; -1: none is open."""
    rows, before, out = t.sort_by("part").to_pylist(), None, []
    length, begun = -1, 0
    for r in rows:
        mine, following = json.loads(r["ends"])
        goes_on = before == mine
        out.append({"part": r["part"], "open": length if goes_on else -1, "begun": begun if goes_on else 0})
        fresh, tail = r["opens"][-4:-2], r["opens"][-2:]
        if r["turns"]:
            length, begun = tail
        elif goes_on:
            length, begun = r["opens"][length], begun + r["begins"][length]
        else:
            length, begun = fresh
        before = following
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int64()), ("open", pa.int32()), ("begun", pa.int64())]))


def _in_units(t: pa.Table, most: int) -> pa.Table:
    """The rows of a range with the number of their unit in its document."""
    t, at = _runs(t)
    sizes, unit = t["size"].to_numpy(), np.zeros(t.num_rows, np.int64)
    for run, (a, z) in enumerate(zip(at, at[1:], strict=False)):
        sums, following, _, _ = _walked(sizes[a:z], most)
        length, begun = (t["open"][0].as_py(), t["begun"][0].as_py()) if not run else (-1, 0)
        k = 0 if length < 0 else max(int(np.searchsorted(sums, most - length)) - 1, 0)
        starts = np.zeros(z - a, np.int64)
        while k < z - a:
            starts[k] = 1
            k = int(following[k])
        unit[a:z] = begun - 1 + np.cumsum(starts)
    return t.select(["k", "oid", "text", "raw"]).set_column(1, "oid", t["oid"].cast(pa.int64())).append_column("unit", pa.array(unit))


#: The parts of a book in the order in which they are numbered.
PARTS = ("metadata", "contents", "page")


def number_book(metadata: DataFrame, contents: DataFrame, pages: DataFrame, key: str = "book") -> DataFrame:
    """key, part, place, seq, page, raw, text, ignored, oid, md5 of all segments of a book: its metadata (name, seq, text),
    its contents (place, title) and then its pages (page, seq, raw, text, ignored) in natural order, numbered together."""
    none = F.lit(None).cast("array<struct<t:string,n:decimal(38,0)>>")
    meta = metadata.select(key, F.lit(0).alias("rank"), none.alias("k"), F.array(F.array_position(F.array(*map(F.lit, METADATA)), F.col("name"))).cast("array<long>").alias("place"), F.col("seq").cast("int").alias("seq"), "page", F.col("text").alias("raw"), trim_text(F.col("text")).alias("text"), "ignored")
    toc = contents.select(key, F.lit(1), none, F.col("place").cast("array<long>"), F.lit(0), "page", F.col("title"), F.col("title"), F.lit(False))
    body = pages.select(key, F.lit(2), natural_key(F.col("page")), F.lit(None).cast("array<long>"), F.col("seq").cast("int"), "page", "raw", "text", "ignored")
    # most lines are their own markup, which needn't move beside them
    rows = meta.union(toc).union(body).filter("text != ''").withColumn("raw", F.when(~F.col("raw").eqNullSafe(F.col("text")), F.array("raw")))
    rows = numbered(rows, key, ("rank", "k", "place", "page", "seq"))
    raw = F.when(F.col("raw").isNull(), F.col("text")).otherwise(F.get("raw", F.lit(0))).alias("raw")
    skip = (F.col("ignored") | ignored(F.col("text"))).alias("ignored")
    return rows.select(key, F.element_at(F.array(*map(F.lit, PARTS)), F.col("rank") + 1).alias("part"), "page", "seq", raw, "text", skip, F.col("oid").cast("int").alias("oid"), "md5")


def cache_identity(path: Column, engine: Column, target: Column, merge_length: Column, encoding: Column) -> Column:
    """The name of a job's cache: its input, engine, language and merge length, and its encoding unless UTF-8."""
    enc = F.lower(encoding)
    return uid(path, engine, target, merge_length, F.when(enc == "utf-8", F.lit("")).otherwise(enc))


def translation_map(pairs: DataFrame, order: Sequence[str], original: str = "original", translation: str = "translation") -> DataFrame:
    """One translation a text, the last by `order`."""
    last = F.max_by(translation, F.struct(*order))
    return pairs.filter(F.coalesce(translation, F.lit("")) != "").groupBy(original).agg(last.alias(translation))


def apply_translations(segments: DataFrame, translations: DataFrame, text: str = "text", original: str = "original", translation: str = "translation") -> DataFrame:
    """Every segment with the translation of its text; those without one keep null."""
    known = translations.select(F.col(original).alias("_original"), F.col(translation).alias("_translation"))
    return segments.drop(translation).join(known, F.col(text) == F.col("_original"), "left").drop("_original").withColumnRenamed("_translation", translation)


def entries(pages: DataFrame, name: str = "href") -> DataFrame:
    """Pages that are markup files."""
    return pages.filter(F.col(name).rlike(r"\.(?:xhtml|html|htm|xml|xht)$"))
