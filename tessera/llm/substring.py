"""Substring dedup: passages of at least WINDOW words that a document with a smaller id has too are removed.

Every window of WINDOW words has a Rabin-Karp hash (two, 128 bits together), and Spark counts which of them occur in
more than one document. To leave the windows that can't repeat out of the shuffle, each window is first named by its
anchor, the least of the hashes of the short runs of ANCHOR words inside it. Equal windows have equal anchors, so a window whose
anchor stands in one distinct text only is unique, and is dropped with no loss. Repeated windows of a text merge into
maximal intervals of words, which are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed, packed_texts, split_join
from tessera.llm.words import mix, window_hashes, word_hashes
from tessera.runtime import ship

WINDOW, ANCHOR = 50, 16
_BASES = (0xD1342543DE82EF95, 0xC6BC279692B5C323, 0xAF251AF3B0F025B5)
_NEVER = (1 << 63) - 1
#: Windows whose least anchor is looked for at once.
_BLOCK = 1 << 15


def window_anchors(words: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The anchor of each window of a text."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    short, span = mix(window_hashes(words, anchor, _BASES[2])), window - anchor + 1
    n = len(words) - window + 1
    return np.concatenate([sliding_window_view(short[k : min(n, k + _BLOCK) + span - 1], span).min(axis=1) for k in range(0, n, _BLOCK)])


def _anchor_rows(window: int, anchor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            found = [np.unique(window_anchors(word_hashes(d.decompress(x.as_buffer()))[0], window, anchor)) for x in b.column(0)]
            n = [len(x) for x in found]
            rest = [np.repeat(b.column(k).to_numpy(zero_copy_only=False), n) for k in range(1, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)), *map(pa.array, rest)], ["a", "k1", "k2", "owner"])

    return run


def _window_rows(window: int, anchor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()

        def batch(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["h1", "h2", "k1", "k2", "owner", "pos"])

        for b in batches:
            parts, held = [], 0
            for packed, k1, k2, owner, known in zip(*b.columns, strict=True):
                w = word_hashes(d.decompress(packed.as_buffer()))
                pos = np.flatnonzero(np.isin(window_anchors(w[0], window, anchor), known.values.to_numpy().view(np.uint64)))
                same = [np.full(len(pos), x.as_py()) for x in (k1, k2, owner)]
                parts.append((*(window_hashes(w[k], window, _BASES[k])[pos].view(np.int64) for k in range(2)), *same, pos.astype(np.int32)))
                held += len(pos)
                if held > 1 << 18:
                    yield batch(parts)
                    parts, held = [], 0
            if parts:
                yield batch(parts)

    return run


def _removal(window: int, with_text: bool) -> Callable:
    names = ["k1", "k2", "owner", "n_words", "n_removed", "kept_sha256", "all_removed_sha256", "intervals"] + ["kept"] * with_text
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.list_(pa.int32()))] + [pa.string()] * with_text
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for k1, k2, owner, packed, starts in zip(*b.columns, strict=True):
                words = d.decompress(packed.as_buffer()).split()
                n, spans = len(words), []
                if starts.is_valid:
                    s = np.sort(starts.values.to_numpy())
                    first = np.flatnonzero(np.diff(s, prepend=-window - 1) > window)  # windows that touch or overlap are one interval
                    spans = list(zip(s[first].tolist(), (s[np.append(first[1:] - 1, len(s) - 1)] + window).tolist(), strict=True))
                kept, at = [], 0
                for x, y in spans:
                    kept += words[at:x]
                    at = y
                kept = b" ".join(kept + words[at:])
                row = [k1.as_py(), k2.as_py(), owner.as_py(), n, sum(y - x for x, y in spans), hashlib.sha256(kept).hexdigest(), nothing if n >= window else hashlib.sha256(kept).hexdigest(), [list(x) for x in spans]]
                for to, x in zip(cols, row + [kept.decode()] * with_text, strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names)

    return run


def remove_repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, intervals (maximal [first, end) runs of removed words) and, if asked for,
    kept (the kept words joined by one space) of each row of docs (doc_id, text).

    A word goes if it lies in a window of `window` words whose words also start in a document with a smaller doc_id. A
    null doc_id counts as larger than all others. A null text has no words. Rows that repeat a doc_id aren't smaller
    than each other. A row with the text of a smaller doc_id loses all its words if it has a window at all.
    Other columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = keyed(docs.select("doc_id", "text"))
    texts = packed_texts(rows).select("packed", "k1", "k2", F.coalesce("owner", F.lit(_NEVER)).alias("owner"))
    anchors = texts.mapInArrow(_anchor_rows(window, anchor), "a long not null, k1 long not null, k2 long not null, owner long not null")
    repeated = anchors.groupBy("a").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).filter("lo < hi").select("a")
    known = split_join(anchors.select("a", "k1", "k2"), repeated, ["a"]).groupBy("k1", "k2").agg(F.collect_list("a").alias("known"))
    windows = texts.join(known, ["k1", "k2"]).select("packed", "k1", "k2", "owner", "known")
    windows = windows.mapInArrow(_window_rows(window, anchor), "h1 long not null, h2 long not null, k1 long not null, k2 long not null, owner long not null, pos int not null")
    lowest = windows.groupBy("h1", "h2").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).filter("lo < hi").select("h1", "h2", "lo")
    later = split_join(windows, lowest, ["h1", "h2"]).filter("owner > lo").groupBy("k1", "k2").agg(F.collect_list("pos").alias("starts"))
    done = texts.join(later, ["k1", "k2"], "left").select("k1", "k2", "owner", "packed", "starts")
    schema = "k1 long not null, k2 long not null, owner long, n_words long, n_removed long, kept_sha256 string, all_removed_sha256 string, intervals array<array<int>>" + ", kept string" * with_text
    done = done.mapInArrow(_removal(window, with_text), schema)
    out = split_join(rows.select("doc_id", "k1", "k2"), done, ["k1", "k2"])
    copy = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NEVER)) > F.col("owner")
    whole = copy & (F.col("n_words") >= window)
    cols = [
        F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.col("all_removed_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(whole, F.array(F.array(F.lit(0), F.col("n_words").cast("int")))).otherwise(F.col("intervals")).alias("intervals"),
    ]
    return out.select("doc_id", "n_words", *cols, *([F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept")] * with_text))


__all__ = ["remove_repeated", "window_anchors"]
