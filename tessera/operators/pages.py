"""Pages of markup to segments and back. A tree lives in one row of an Arrow batch; all else is columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.operators.segments import ignored as filtered
from tessera.runtime import ship

_SEGMENT = "array<struct<seq:int,name:string,raw:string,text:string,content:string,attributes:string,ignored:boolean,reserved:array<string>>>"


def _tests(priority: Sequence[str], ignore: Sequence[str], reserve: Sequence[str], noise: Sequence[str]) -> tuple[Callable, ...]:
    return H.selector([*H.PRIORITY, *priority]), H.selector([*H.IGNORED, *ignore]), H.selector([*H.RESERVED, *reserve]), H.selector(["rt", "rp", *noise])


#: Bytes of markup whose trees' results a task holds at once; larger pages go by themselves.
SLICE_BYTES = 1 << 20


def _slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to slices of up to `most` bytes of markup (column 1), or one page, so that what a task holds doesn't grow
    with the rows of a batch, which are as many as the partition has."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, before + most, "right")), at + 1)
            yield b.slice(at, min(to - at, 1024))
            at += min(to - at, 1024)


def page_segments(pages: DataFrame, key: str = "page_id", markup: str = "html", priority: Sequence[str] = (), ignore: Sequence[str] = (), reserve: Sequence[str] = (), noise: Sequence[str] = (), rules: Sequence[str] = (), mode: str = "normal", scope: str = "text") -> DataFrame:
    """key, seq, name, raw, text, content, attributes, ignored, reserved of each segment of the pages' bodies.

    text is all of an element's text; content is what is to be translated, without noise and with a placeholder for
    each of `reserved`. Segments without text are dropped; those without content, without letters, or with a match of
    `rules` in text (or markup, by scope) are ignored. priority, ignore, reserve and noise are selectors.
    Null pages have no segments.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ign, res, noi = _tests(priority, ignore, reserve, noise)
        for b in _slices(batches):
            out = []
            for page in b.column(1).to_pylist():
                root, rows = H.parse(page or ""), []
                for node, ignored in H.segments(H.body(root), first, ign):
                    text = H.trim(node.text())
                    content, kept = H.mask(node, res, noi)
                    if text:
                        rows.append({"seq": len(rows), "name": node.name, "raw": H.trim(node.markup(strict=True)), "text": text, "content": content, "attributes": H.attributes(node), "ignored": ignored or not content, "reserved": kept})
                H.release(root.walk())
                out.append(rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _ARROW)], ["k", "s"])

    kind = dict(pages.dtypes)[key]
    rows = pages.select(F.col(key).alias("k"), F.col(markup).alias("m")).mapInArrow(run, f"k {kind}, s {_SEGMENT}")
    rows = rows.select(F.col("k").alias(key), F.inline("s"))
    return rows.withColumn("ignored", F.col("ignored") | filtered(F.col("text"), F.col("raw"), rules, mode, scope))


_ARROW = pa.list_(pa.struct([("seq", pa.int32()), ("name", pa.string()), ("raw", pa.string()), ("text", pa.string()), ("content", pa.string()), ("attributes", pa.string()), ("ignored", pa.bool_()), ("reserved", pa.list_(pa.string()))]))


def rewrite_pages(pages: DataFrame, translations: DataFrame, key: str = "page_id", markup: str = "html", position: str = "below", direction: str = "auto", lang: str | None = None, color: str | None = None, gap: tuple[str, int] | None = None, original_color: str | None = None, priority: Sequence[str] = (), ignore: Sequence[str] = (), reserve: Sequence[str] = (), noise: Sequence[str] = ()) -> DataFrame:
    """key and the pages' markup with translations (key, seq, translation) placed. seq is that of page_segments() with
    the same selectors; segments without a row, and pages without rows, stay as they are. A null translation is one that is
    missing: left and right still make columns. original_color is given to segments that have a row. A page's translations meet it by
    one join; no group is larger than a page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ign, res, noi = _tests(priority, ignore, reserve, noise)
        for b in _slices(batches):
            out = []
            for page, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if page is None or not found:
                    out.append(page)
                    continue
                root = H.parse(page)
                top, new = H.body(root), {x["seq"]: x["translation"] for x in found}
                nodes = [root, *root.walk()]
                parents = {id(c): n for n in nodes for c in n.elements}
                seq = 0
                for node, ignored in H.segments(top, first, ign):
                    if not H.trim(node.text()):
                        continue
                    if not ignored and seq in new and id(node) in parents and node is not top:
                        if original_color:
                            H.colour(node, original_color)
                        H.place(parents[id(node)], node, new[seq], H.mask(node, res, noi)[1], position, direction, lang, color, gap)
                    seq += 1
                out.append("".join(c if isinstance(c, str) else c.markup() for c in root.children))
                H.release(root.walk())  # those put in
                H.release(nodes)  # those left out too
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["k", "m"])

    kind = dict(pages.dtypes)[key]
    per_page = translations.groupBy(F.col(key).alias("k")).agg(F.collect_list(F.struct("seq", "translation")).alias("t"))
    rows = pages.select(F.col(key).alias("k"), F.col(markup).alias("m")).join(per_page, "k", "left").select("k", "m", "t")
    return rows.mapInArrow(run, f"k {kind}, m string").select(F.col("k").alias(key), F.col("m").alias(markup))
