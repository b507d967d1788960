"""Fill-in-the-middle: each text is cut at two places drawn from its id and written in another order between markers.

Places count code points, texts are bytes. A learned rank index turns one into the other: straight lines are fitted to
the byte offsets of all code points so that none is further than BOUND from its line, a line's prediction is at most one
byte less exact, and the difference of each offset from its prediction is kept in one byte, which makes it exact. A text
of plain letters is one line a block; letters of two to four bytes only bend it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import literal_pattern
from tessera.runtime import ship

MARKERS = ("<P>", "<S>", "<M>")

#: Bytes that an offset may be away from its line, and bytes of text that are looked at together: lines end with a block.
BOUND, BLOCK = 120, 1 << 17


class RankIndex:
    """The byte offset of each code point of a text in UTF-8, and of its end: `index[k]` for k from 0 to n."""

    def __init__(self, data: bytes) -> None:
        ranks: list[int] = []
        offsets: list[int] = []
        slopes: list[float] = []
        rest: list[np.ndarray] = []
        self.n, size = 0, len(data)
        for at in range(0, size + 1, BLOCK):
            part = np.frombuffer(data, np.uint8, min(BLOCK, size - at), at)
            y = np.flatnonzero((part & 0xC0) != 0x80) + at
            if at + BLOCK > size:
                y = np.append(y, size)
            for first, end, slope in _lines(y):
                line = y[first] + np.floor(slope * np.arange(end - first)).astype(np.int64)
                ranks.append(self.n + first)
                offsets.append(int(y[first]))
                slopes.append(slope)
                rest.append((y[first:end] - line).astype(np.int8))
            self.n += len(y)
        self.n -= 1
        self.ranks, self.offsets, self.slopes = np.array(ranks), np.array(offsets), np.array(slopes)
        self.residuals = rest[0] if len(rest) == 1 else np.concatenate(rest)

    def __getitem__(self, k: int) -> int:
        if not 0 <= k <= self.n:
            raise IndexError(k)
        s = int(np.searchsorted(self.ranks, k, "right")) - 1
        return int(self.offsets[s]) + int(np.floor(self.slopes[s] * (k - int(self.ranks[s])))) + int(self.residuals[k])


def _lines(y: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(first, end, slope) of lines through y[first] that all of y[first:end] is within BOUND of, each as long as it can
    be. The slopes that suit all points so far are an interval that each point narrows."""
    at, n = 0, len(y)
    while at < n:
        low, high, end, step = -np.inf, np.inf, at + 1, 256
        while end < n:
            stop = min(n, end + step)
            dx, dy = np.arange(end - at, stop - at), y[end:stop] - y[at]
            highs = np.minimum(np.minimum.accumulate((dy + BOUND) / dx), high)
            lows = np.maximum(np.maximum.accumulate((dy - BOUND) / dx), low)
            k = int(np.argmax(lows > highs))
            if lows[k] > highs[k]:
                if k:
                    low, high = lows[k - 1], highs[k - 1]
                end += k
                break
            low, high, end, step = lows[-1], highs[-1], stop, 2 * step
        yield at, end, float((low + high) / 2) if end > at + 1 else 1.0
        at = end


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four unsigned 32-bit numbers: the first groups of 8 digits of the sha256 of seed:doc_id. A null id is written as nothing."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def _cut(percent: int, spm_percent: int, markers: Sequence[str], seed: int) -> Callable:
    p, s, m = (x.encode() for x in markers)
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = text.as_py() or b""
                index, h = RankIndex(data), draws(doc_id, seed)
                n = index.n
                if not n or h[2] % 100 >= percent or p in data or s in data or m in data:
                    row = (doc_id, n, "plain", None, None, data)
                else:
                    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    i, j = index[a], index[z]
                    spm = h[3] % 100 < spm_percent
                    out = b"".join((s, data[j:], p, data[:i], m, data[i:j]) if spm else (p, data[:i], s, data[j:], m, data[i:j]))
                    row = (doc_id, n, "spm" if spm else "psm", a, z - a, out)
                for to, x in zip(cols, row, strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) if k.name != "output" else pa.array(x, pa.binary()).cast(pa.string()) for x, k in zip(cols, kinds, strict=True)], schema=kinds)

    return run


def fill_in_middle(docs: DataFrame, percent: int = 90, spm_percent: int = 20, markers: Sequence[str] = MARKERS, seed: int = 1) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output of every row of docs (doc_id, text).

    The prefix ends after the smaller and the middle after the larger of two places drawn from the id, the suffix is the
    rest. Form psm writes prefix, suffix, middle, each behind its marker, form spm suffix, prefix, middle. Form plain is
    the text itself: for texts that are empty or hold a marker, and for all but `percent` of a hundred ids; its lengths
    are null. A null text is empty. Rows are taken one by one, so repeated ids get the same draws, and a null id those of
    an empty one. Other columns are ignored, an empty table gives none.
    """
    if any(x[0] in y[1:] or x[0] != markers[0][0] for x in markers for y in markers) or len(set(markers)) < 3:
        raise ValueError("markers differ, and begin with one character that stands nowhere else in them")
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_cut(percent, spm_percent, markers, seed), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text from which an output was made. The texts of the forms psm and spm hold no marker, and none can arise where a
    text and a marker meet, as markers begin with a character that they hold once: each is found once."""
    part = F.split(output, "|".join(map(literal_pattern, markers)))
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
