"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt by population count to groups of bounded size, and every two groups whose counts can be
within the radius meet in one cell. There they are sorted by the population counts of their bytes and compared in tiles by
exclusive-or and bit count; a tile pair whose counts differ by more than the radius in total (over the bytes' ranges) can
hold no link and is skipped. A cell returns a spanning forest of its links, not the links, so a large group of near copies
costs rows in proportion to its size. Forests of all cells are joined to components by star contraction on Spark.

Where a similarity of texts is asked for, links are candidates: each is checked on the texts' shingles, and what joins by
the links that hold is looked at again for further links until there are none. Candidates are looked for among texts that
share one of their first shingles by hash, which similar sets must, so cells are left to those of common shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import split_join, text_keys
from tessera.llm.words import mix, window_hashes, word_hashes
from tessera.runtime import materialise, ship

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Groups of fingerprints up to the size from which there are more, between these bounds (a cell holds two groups), and
#: fingerprints of a tile.
GROUPS, LEAST_GROUP, GROUP, TILE = 16, 1 << 8, 1 << 17, 512
#: Rows up to which a small side is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Shingles of a group of candidates that one task looks through; larger groups are looked at in rounds.
MOST_ENTRIES = 4_000_000
#: Parts by which first shingles are dealt out, and rows and bytes of text whose first shingles go into them at once.
PARTS, SLICE, SLICE_BYTES = 1 << 10, 1 << 11, 1 << 23
#: Fingerprints up to which the holders of a shingle are compared where it is; those of commoner ones meet in cells.
#: Shingles that half as many texts hold are taken last, up to so many of the commonest.
MOST_HOLDERS, MOST_COMMON = 64, 1 << 20
#: A shingle's key is the low bits of a hash that is made of its words' for all texts of a slice at once; the lowest of them are
#: its part.
_BASE = 0xD6E8FEB86659FD93
_PART_BITS, _PART, _KEY = np.uint64(10), np.uint64(PARTS - 1), np.uint64((1 << 42) - 1)
#: A first shingle of a text: the rest of its key, the first word of the fingerprint, the size in steps of the similarity.
_ENTRY, _STEPS = np.dtype([("h", "<u4"), ("f", "<u8"), ("q", "u1")]), 2
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the distinct shingles of a text, ascending; no words: none."""
    starts, ends, joined = _shingles(text, shingle)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def _shingles(text: bytes, shingle: int) -> tuple[list[int], list[int], bytes]:
    """Where the shingles of a text begin and end in its words, joined by one space."""
    parts = text.translate(_LOWER).split()  # of bytes: at these six characters
    n = len(parts)
    if not n:
        return [], [], b""
    size = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(size + 1)
    k = min(n, shingle)
    return (ends - size - 1)[: n - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), b" ".join(parts)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits. Sums of up to 255 of them fit into a byte."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return sum((bits[k : k + 255].sum(axis=0, dtype=np.uint8).astype(np.int64) for k in range(0, len(bits), 255)), np.zeros(64, np.int64))


def set_fingerprint(text: bytes, shingle: int, words: int) -> bytes:
    """fingerprint() of the set of shingles: each counts once however often it stands there."""
    return _of_hashes(shingle_hashes(text, shingle), words)


def _of_hashes(h: np.ndarray, words: int) -> bytes:
    if not len(h):
        return bytes(8 * words)
    mixed = [mix(h ^ np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))) if w else h for w in range(words)]
    return np.packbits(np.array([_bit_counts(x) for x in mixed]) * 2 > len(h), bitorder="little").tobytes()


def fingerprint(text: bytes, shingle: int = SHINGLE, words: int = 1) -> bytes:
    """The SimHash of a text, 8 little-endian bytes a word: A-Z in lower case, words of [^\\x20\\x09-\\x0D]+, shingles joined
    by one space (fewer words: all of them as one), XXH64 with seed 42; a bit is 1 where more than half of the shingles
    have it. Further words of a wider fingerprint come from the same hashes, mixed anew. No words: 0."""
    starts, ends, joined = _shingles(text, shingle)  # all are slices of one joined text
    if not starts:
        return bytes(8 * words)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((words, 64), np.int64)
    for at in range(0, len(starts), 1 << 16):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)), np.uint64)
        for w in range(words):
            x = mix(h ^ np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))) if w else h
            counts[w] += _bit_counts(x)
    return np.packbits(counts * 2 > len(starts), bitorder="little").tobytes()


def _fingerprints(shingle: int, words: int, of: Callable) -> Callable:
    names = [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.frombuffer(b"".join([of(x.as_buffer().to_pybytes(), shingle, words) for x in b.column(0)]), "<i8").reshape(-1, words)
            yield pa.RecordBatch.from_arrays([*(pa.array(fp[:, w]) for w in range(words)), *b.columns[1:]], [*names, *b.schema.names[1:]])

    return run


def _join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Join the classes of i and j, pair by pair, in labels (the smallest index of a class). Returns the pairs that did:
    each takes a class to one with a smaller label, so they make no circle."""
    taken = []
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return taken
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        roots, pick = np.unique(np.maximum(a, b), return_index=True)
        labels[roots] = np.minimum(a, b)[pick]
        taken.append((i[pick], j[pick]))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def forest(
    fps: np.ndarray, side: np.ndarray | None, radius: int, screen: int | None = None, tile: int = TILE, joined: np.ndarray | None = None, refused: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) between fingerprints (rows of one or more 64-bit words) that join what all links join: at most radius
    differing bits, of which at most `screen` in the first word. side: 0 or 1 of each, then only links between the sides
    are looked for (others belong to other cells). joined: classes that are one already. refused: pairs (rows of two
    indices) that are no links."""
    n, screen = len(fps), radius if screen is None else screen
    by_byte = np.bitwise_count(fps[:, :1].copy().view(np.uint8)).astype(np.int16)
    quarters = by_byte[:, ::2] + by_byte[:, 1::2]
    order = np.lexsort((quarters[:, 2], quarters[:, 0], quarters[:, 2:].sum(axis=1), quarters[:, :2].sum(axis=1), np.zeros(n) if side is None else side))
    by_byte, first, rest = by_byte[order], fps[order, 0].copy(), fps[order, 1:]
    split = n if side is None else int((side == 0).sum())
    bounds = [(a, min(a + tile, split)) for a in range(0, split, tile)] + [(a, min(a + tile, n)) for a in range(split, n, tile)]
    low = np.array([by_byte[a:b].min(axis=0) for a, b in bounds]).reshape(-1, 8)
    high = np.array([by_byte[a:b].max(axis=0) for a, b in bounds]).reshape(-1, 8)
    total = by_byte.sum(axis=1)
    t_low = np.array([total[a:b].min() for a, b in bounds])
    t_high = np.array([total[a:b].max() for a, b in bounds])
    labels = np.arange(n)
    if joined is not None:
        _, first_of, which = np.unique(joined[order], return_index=True, return_inverse=True)
        labels = first_of[which.ravel()]
    no = np.zeros(0, np.int64)
    if refused is not None and len(refused):
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        pair = place[refused]
        no = np.sort(pair.min(axis=1) * n + pair.max(axis=1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n_left = sum(b <= split for _, b in bounds)
    for k, (a, b) in enumerate(bounds if side is None else bounds[:n_left]):
        others = np.arange(k, len(bounds)) if side is None else np.arange(n_left, len(bounds))
        gap = np.maximum(low[others] - high[k], 0) + np.maximum(low[k] - high[others], 0)
        near = (gap.sum(axis=1) <= screen) & (t_low[others] - t_high[k] <= screen) & (t_low[k] - t_high[others] <= screen)
        for o in others[near].tolist():
            c, d = bounds[o]
            i, j = np.nonzero(np.bitwise_count(first[a:b, None] ^ first[None, c:d]) <= screen)
            i, j = i + a, j + c
            keep = labels[i] != labels[j]
            i, j = i[keep], j[keep]
            if rest.shape[1] and len(i):
                bits = np.bitwise_count(first[i] ^ first[j]).astype(np.int64) + np.bitwise_count(rest[i] ^ rest[j]).sum(axis=1, dtype=np.int64)
                i, j = i[bits <= radius], j[bits <= radius]
            if len(no) and len(i):
                keep = ~np.isin(np.minimum(i, j) * n + np.maximum(i, j), no)
                i, j = i[keep], j[keep]
            if len(i):
                found += _join_labels(labels, i, j)
    x, y = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found, strict=True) if found else ((), ())))
    return order[x], order[y]


def _cell(words: int, radius: int, screen: int) -> Callable:
    def run(key: tuple, table: pa.Table, pairs: pa.Table | None = None) -> pa.Table:
        fps = np.column_stack([table.column(f"f{w}").to_numpy() for w in range(words)]).astype(np.int64).view(np.uint64)
        left, right = (x.as_py() for x in key)
        side = None if left == right else (table.column("grp").to_numpy() != left).astype(np.int8)
        node, refused = table.column("node").to_numpy(), None
        if pairs is not None and pairs.num_rows and len(node):
            by_node = np.argsort(node)
            refused = by_node[np.minimum(np.searchsorted(node[by_node], np.column_stack([pairs.column("a").to_numpy(), pairs.column("b").to_numpy()])), len(node) - 1)]
        x, y = forest(fps, side, radius, screen, joined=table.column("joined").to_numpy(), refused=refused) if len(node) else (node, node)
        return pa.table({"a": pa.array(node[x]), "b": pa.array(node[y])})

    return run


def _dealing(sizes: dict[int, int], radius: int, group: int) -> list[tuple[int, int, int, int]]:
    """For each population count from 0 on: the first group of its fingerprints, over how many groups they are dealt, and the
    first and last group that can hold a link to them. Neighbouring counts share a group while it stays under `group`."""
    ranges: list[list[int]] = []  # first count, last count, fingerprints
    for p in sorted(sizes):
        if ranges and ranges[-1][2] + sizes[p] <= group:
            ranges[-1][1:] = [p, ranges[-1][2] + sizes[p]]
        else:
            ranges.append([p, p, sizes[p]])
    parts = [-(-n // group) for _, _, n in ranges]
    begin = [sum(parts[:k]) for k in range(len(parts) + 1)]
    near = [[j for j, (c, d, _) in enumerate(ranges) if c - b <= radius and a - d <= radius] for a, b, _ in ranges]
    where = {p: k for k, (a, b, _) in enumerate(ranges) for p in range(a, b + 1)}
    return [(begin[k], parts[k], begin[near[k][0]], begin[near[k][-1] + 1] - 1) if (k := where.get(p)) is not None else (0, 1, 0, 0) for p in range(max(sizes, default=0) + 1)]


def links(
    distinct: DataFrame, words: int = 1, radius: int = RADIUS, screen: int | None = None, group: int | None = None, joined: DataFrame | None = None, refused: DataFrame | None = None
) -> DataFrame:
    """Edges a, b over the nodes of distinct fingerprints (node, f0, f1, ...), links themselves, whose components are those
    of all links. joined (node, component): what is one already. refused (a, b): pairs that are no links."""
    spark = distinct.sparkSession
    names = ["node", *(f"f{w}" for w in range(words))]
    bits = sum((F.bit_count(F.col(f"f{w}")) for w in range(1, words)), F.bit_count(F.col("f0")))
    sizes = {r[0]: r[1] for r in distinct.groupBy(bits.alias("bits")).count().collect()}  # at most 64 words + 1 rows
    group = group or max(LEAST_GROUP, min(GROUP, sum(sizes.values()) // GROUPS))
    table = _dealing(sizes, radius, group)
    at = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in table]), F.col("bits") + 1)
    dealt = distinct.select(*names, bits.alias("bits"))
    dealt = dealt.select(*names, (at(0) + F.pmod(F.xxhash64("node"), at(1))).cast("int").alias("grp"), at(2).alias("from"), at(3).alias("to"))
    if joined is not None:
        dealt = split_join(dealt, joined, ["node"], "left").withColumn("joined", F.coalesce("component", "node"))
    else:
        dealt = dealt.withColumn("joined", F.col("node"))
    cells = dealt.select(*names, "joined", "grp", F.explode(F.sequence("from", "to")).alias("other"))
    cells = cells.select(*names, "joined", "grp", F.least("grp", "other").alias("left"), F.greatest("grp", "other").alias("right"))
    n_cells = len({(min(g, o), max(g, o)) for b, n, first, last in set(table) for g in range(b, b + n) for o in range(first, last + 1)}) if len(table) and sum(t[1] for t in table) < 2000 else 1 << 20
    tasks = max(1, min(n_cells, 1 << 13))  # work is in the pairs, not in the bytes, so tasks are as many as cells
    cells = cells.repartition(tasks, "left", "right")
    run = _cell(words, radius, radius if screen is None else screen)
    if refused is None:
        return cells.groupBy("left", "right").applyInArrow(lambda key, t: run(key, t), "a long, b long")
    home = dealt.select("node", "grp")
    pairs = split_join(split_join(refused, home.select(F.col("node").alias("a"), F.col("grp").alias("ga")), ["a"]), home.select(F.col("node").alias("b"), F.col("grp").alias("gb")), ["b"])
    pairs = pairs.select("a", "b", F.least("ga", "gb").alias("left"), F.greatest("ga", "gb").alias("right")).repartition(tasks, "left", "right")
    return cells.groupBy("left", "right").cogroup(pairs.groupBy("left", "right")).applyInArrow(lambda key, t, p: run(key, t, p), "a long, b long")


def components(edges: DataFrame, name: str = "stars", most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node of its component) for every node of edges (a, b).

    Star contraction (large and small stars by turns): each round joins the edges to the least neighbour of their end,
    and its result is written to the shared folder, so no round depends on executors that ran an earlier one. Ends
    when a round changes nothing.
    """
    edges = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    sums = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = sums(edges)
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = large.union(least.filter("u != m").select("u", F.col("m").alias("v"))).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = split_join(large, small, ["u"]).select(F.col("v").alias("x"), "m").filter("x != m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        edges = materialise(stars.union(small.select("u", F.col("m").alias("v"))).distinct(), name)
        now = sums(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _nodes(docs: DataFrame, shingle: int, words: int, of: Callable) -> tuple[DataFrame, DataFrame]:
    """A row each of docs (doc_id, k1, k2, f0, ...), and the distinct fingerprints (node, f0, ..., least doc_id, best: the
    first row by doc_id and text key). A node is the fingerprint itself, or a number that is given to it once, when it is
    written."""
    rows = _texts(docs).mapInArrow(_fingerprints(shingle, words, of), _schema(words))
    rows = materialise(rows, "fingerprints")
    return rows, _distinct(rows, words)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(text.cast("binary").alias("t"), F.col("doc_id").cast("long").alias("doc_id"), *text_keys(text))


def _schema(words: int) -> str:
    return ", ".join(f"f{w} long" for w in range(words)) + ", doc_id long, k1 long, k2 long"


def _distinct(rows: DataFrame, words: int) -> DataFrame:
    names = [f"f{w}" for w in range(words)]
    first = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "k1", "k2")
    distinct = rows.groupBy(*names).agg(F.min("doc_id").alias("least"), F.min(first).alias("best"))
    node = F.col("f0") if words == 1 else F.monotonically_increasing_id()
    return materialise(distinct.withColumn("node", node), "distinct-fingerprints")


_NO_ID = (1 << 63) - 1


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, words: int = 1, screen: int | None = None, group: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits a word) and component_id (smallest doc_id reachable over links) of each row of
    docs. Fingerprints of `words` times 64 bits link at radius or fewer differing bits, of which `screen` or fewer in
    the first 64 (radius, if None).

    A null text is empty; texts without words have fingerprint 0 and are linked like any other. Rows with equal texts
    share all but their doc_id; a null doc_id is never the smallest unless all of a component are null. Other columns
    are ignored, and an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    names = [f"f{w}" for w in range(words)]
    rows, distinct = _nodes(docs, shingle, words, fingerprint)
    found = materialise(components(links(distinct, words, radius, screen, group)), "components")
    named = split_join(found, distinct.select("node", "least"), ["node"]).groupBy("component").agg(F.min("least").alias("component_id"))
    known = split_join(distinct.select("node", *names, "least"), split_join(found, named, ["component"]).select("node", "component_id"), ["node"], "left")
    known = known.select(*names, F.coalesce("component_id", "least").alias("component_id"))
    digits = F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in names]))
    return split_join(rows, known, names).select("doc_id", digits.alias("fingerprint"), "component_id")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, so many at once that their texts (the first column) have some bytes."""
    ends, at = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(max(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), at + 1), at + SLICE)
        yield batch.slice(at, end - at)
        at = end


def _shingle_keys(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the distinct shingles of each text, in the order of their hashes, and how many each has."""
    n = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
    words, begin = word_hashes(b"\n".join(texts).translate(_LOWER))[0], np.cumsum(n) - n
    windows, made, at = mix(window_hashes(words, shingle, _BASE)), np.where(n, np.maximum(n - shingle + 1, 1), 0), 0
    h = np.empty(int(made.sum()), np.uint64)
    for a, k, m in zip(begin.tolist(), n.tolist(), made.tolist(), strict=True):
        if m:
            h[at : at + m] = np.sort(windows[a : a + m] if k >= shingle else mix(window_hashes(words[a : a + k], k, _BASE)))
            at += m
    owner = np.repeat(np.arange(len(n)), made)
    own = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
    return h[own] & _KEY, np.bincount(owner[own], minlength=len(n))


def _firsts(sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of the rows of groups of some sizes are among the first n of their group."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(n, sizes)


def _n_first(n: np.ndarray, similarity: float) -> np.ndarray:
    """Of n shingles in some order, so many that every set of that similarity shares one of its own first ones."""
    return np.where(n, n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1, 0)


def _blobs(values: np.ndarray, keys: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """part, and the values of its keys as bytes. Parts go by the low bits of hashes, as the first ones in order are small."""
    part = (keys & _PART).astype(np.int16)
    order = np.argsort(part, kind="stable")
    found, begin = np.unique(part[order], return_index=True)
    ends = np.append(begin, len(values)).astype(np.int32) * values.dtype.itemsize
    return pa.array(found.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values[order].tobytes())])


def _counted_shingles(shingle: int, similarity: float) -> Callable:
    """The keys of the first shingles of each text and of half as many more (entries), by their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                keys, size = _shingle_keys(b.column(0).to_pylist(), shingle)
                keys = keys[_firsts(size, _n_first(size, similarity) * 3 // 2 + 4)]
                yield pa.RecordBatch.from_arrays(list(_blobs((keys >> _PART_BITS).astype(np.uint32), keys)), ["part", "entries"])

    return run


def _common_keys(blobs: list[bytes], part: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a part that stand there more than `most` times, and how often."""
    h, n = np.unique(np.frombuffer(b"".join(blobs), np.uint32), return_counts=True)
    return ((h[n > most].astype(np.uint64) << _PART_BITS) + np.uint64(part)).astype(np.int64), n[n > most].astype(np.int64)


def _dealt_shingles(shingle: int, words: int, similarity: float, common: object) -> Callable:
    """The rows of _fingerprints() of sets, and the first shingles of their texts (entries), by parts of their keys. Common
    ones are the last in order."""
    names, step = [f"f{w}" for w in range(words)], max(-np.log(similarity), 1e-3) / _STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in batches:
            for b in _slices(batch):
                texts = b.column(0).to_pylist()
                fp = np.frombuffer(b"".join([set_fingerprint(x, shingle, words) for x in texts]), "<i8").reshape(-1, words)
                spread = pa.array((np.arange(b.num_rows) % PARTS).astype(np.int32))  # they are needed in no certain place
                columns = ["part", *names, *b.schema.names[1:], "entries"]
                yield pa.RecordBatch.from_arrays([spread, *(pa.array(fp[:, w]) for w in range(words)), *b.columns[1:], pa.nulls(b.num_rows, pa.binary())], columns)
                every, size = _shingle_keys(texts, shingle)
                is_last = np.zeros(len(every), bool) if not len(last) else last[np.minimum(np.searchsorted(last, every), len(last) - 1)] == every
                order, n = np.argsort(np.repeat(np.arange(len(size)) * 2, size) + is_last, kind="stable"), _n_first(size, similarity)
                keys = every[order[_firsts(size, n)]]
                entries = np.empty(len(keys), _ENTRY)
                entries["h"], entries["f"] = keys >> _PART_BITS, np.repeat(fp[:, 0].astype(np.int64).view(np.uint64), n)
                entries["q"] = np.repeat(np.minimum(np.log(np.maximum(size, 1)) / step, 255).astype(np.uint8), n)
                part, blobs = _blobs(entries, keys)
                yield pa.RecordBatch.from_arrays([part, *[pa.nulls(len(part), pa.int64())] * (words + 3), blobs], columns)

    return run


def _holder_pairs(blobs: list[bytes], screen: int, most: int) -> tuple[np.ndarray, pa.Array]:
    """Pairs (a, b) of first words of fingerprints that hold a shingle in common and can be linked; those that hold a
    shingle of more than `most` of them, with a null."""
    entries = np.frombuffer(b"".join(blobs), _ENTRY)
    h, f, q = entries["h"].copy(), entries["f"].copy(), entries["q"].astype(np.int16)
    order = np.lexsort((q, f, h))
    h, f, q = h[order], f[order], q[order]
    own = np.append(True, (h[1:] != h[:-1]) | (f[1:] != f[:-1]) | (q[1:] != q[:-1])) if len(h) else np.zeros(0, bool)
    h, f, q = h[own], f[own], q[own]  # a copy counts once
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(h)))
    end, common = np.repeat(begin + size, size), np.repeat(size > most, size)
    i, d, found = np.flatnonzero(~common), 1, []
    while len(i := i[i + d < end[i]]):
        j = i + d
        ok = (np.bitwise_count(f[i] ^ f[j]) <= screen) & (np.abs(q[i] - q[j]) <= _STEPS + 1) & (f[i] != f[j])
        found.append(np.column_stack([np.minimum(f[i[ok]], f[j[ok]]), np.maximum(f[i[ok]], f[j[ok]])]))
        d += 1
    pairs = np.concatenate([np.zeros((0, 2), np.uint64), *found])
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))] if len(pairs) else pairs
    common = np.unique(f[common]).view(np.int64)
    a, b = (np.ascontiguousarray(pairs[:, c]).view(np.int64) for c in range(2))
    return np.append(a, common), pa.concat_arrays([pa.array(b), pa.nulls(len(common), pa.int64())])


def _by_part(names: list[str], of: Callable) -> Callable:
    """Rows (part, names, entries) that are sorted by part: those without entries as they are, and of the others a row
    (a, b) for each that of(entries, part) finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def found() -> pa.RecordBatch:
            a, b = of(held, at)
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(a), pa.int64())] * len(names), pa.array(a), pa.array(b)], [*names, "a", "b"])

        for batch in batches:
            alone = batch.column(len(names) + 1).is_null()
            b = batch.filter(alone)
            if names:
                yield pa.RecordBatch.from_arrays([*b.columns[1:-1], *[pa.nulls(b.num_rows, pa.int64())] * 2], [*names, "a", "b"])
            b = batch.filter(pc.invert(alone))
            for part, blob in zip(b.column(0).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
                if part != at and held:
                    yield found()
                    held = []
                at = part
                held.append(blob)
        if held:
            yield found()

    return run


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (a, b), some that join what all join."""
    most, held, n = 1 << 20, [], 0

    def joining() -> np.ndarray:
        every = np.concatenate(held)
        node, at = np.unique(every, return_inverse=True)
        at = at.reshape(-1, 2)
        taken = _join_labels(np.arange(len(node)), at[:, 0], at[:, 1])
        return np.concatenate([np.zeros((0, 2), np.int64), *(np.column_stack([node[i], node[j]]) for i, j in taken)])

    for b in batches:
        held.append(np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
        n += b.num_rows
        if n > most:
            held = [joining()]
            n, most = 0, max(1 << 20, len(held[0]))
    if held:
        edges = joining()
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["a", "b"])


def candidates(docs: DataFrame, similarity: float, shingle: int, words: int, radius: int, screen: int, group: int | None = None, holders: int = MOST_HOLDERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct fingerprints of docs as _nodes() has them, edges a, b over their nodes, and the components of these.
    Edges are links of fingerprints within the radius and the screen; nodes whose texts have that Jaccard similarity of
    their sets of shingles, and are linked so, are in one component.

    Of m shingles in any one order, two similar sets share one of the first m - similarity * m + 1 of each; here it is
    the order of the hashes, with those that many texts hold at the end (as they were counted among first ones). So only
    the holders of such a shingle are compared, which takes time in proportion to the text. Nodes with a first shingle of
    more than `holders` fingerprints all the same, or that share the first word of theirs with as many, are compared in
    the cells of links(), all with all.
    """
    names, spark = [f"f{w}" for w in range(words)], docs.sparkSession
    texts = _texts(docs)
    by_part = lambda df: df.repartition("part").sortWithinPartitions("part")
    counted = by_part(texts.select("t").mapInArrow(_counted_shingles(shingle, similarity), "part int, entries binary"))
    counted = materialise(counted.mapInArrow(_by_part([], lambda x, part: _common_keys(x, part, holders // 2)), "a long, b long"), "common-shingles")
    last = counted.orderBy(F.desc("b"), "a").limit(MOST_COMMON).select("a").toArrow().column(0).to_numpy()
    last = spark.sparkContext.broadcast(np.sort(last.astype(np.uint64)))  # of bounded size
    dealt = by_part(texts.mapInArrow(_dealt_shingles(shingle, words, similarity, last), f"part int, {_schema(words)}, entries binary"))
    met = materialise(dealt.mapInArrow(_by_part([*names, "doc_id", "k1", "k2"], lambda x, _: _holder_pairs(x, screen, holders)), f"{_schema(words)}, a long, b long"), "fingerprints")
    distinct = _distinct(met.filter("a is null"), words)
    alike = distinct.groupBy("f0").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = met.filter("b is not null").select("a", "b").distinct().union(alike.filter(F.col("n") <= holders).select(F.col("f0").alias("a"), F.col("f0").alias("b")))
    many = alike.filter(F.col("n") > holders).select("f0", F.lit(True).alias("many"))
    nodes = split_join(distinct.select("node", *names), many, ["f0"], "left")
    side = lambda x: nodes.select(F.col("f0").alias(x), F.struct("node", *names, F.coalesce("many", F.lit(False)).alias("many")).alias(f"n{x}"))
    both = split_join(split_join(pairs, side("a"), ["a"]), side("b"), ["b"])
    both = both.filter("(a != b or na.node < nb.node) and not (na.many and nb.many)")
    bits = [F.bit_count(F.col(f"na.{x}").bitwiseXOR(F.col(f"nb.{x}"))) for x in names]
    edges = both.filter((sum(bits[1:], bits[0]) <= radius) & (bits[0] <= screen)).select(F.col("na.node").alias("a"), F.col("nb.node").alias("b"))
    common = met.filter("a is not null and b is null").select(F.col("a").alias("f0")).union(many.select("f0")).distinct()
    common = materialise(split_join(distinct, common, ["f0"], "left_semi"), "common-fingerprints")
    if not common.isEmpty():
        edges = edges.union(links(common, words, radius, screen, group))
    edges = materialise(edges.distinct(), "candidate-pairs")
    classes = materialise(components(edges, "candidate-stars"), "candidate-groups")
    within = split_join(edges, classes.select(F.col("node").alias("a"), "component"), ["a"])
    return distinct, materialise(within.repartition("component").select("a", "b").mapInArrow(_forests, "a long, b long"), "candidate-links"), classes


def _sets(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [shingle_hashes(x.as_buffer().to_pybytes(), shingle).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return run


def _shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, s: the shingles of the text of each of nodes (node, k1, k2), from one reading of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows, small = docs.select(text.cast("binary").alias("t"), *text_keys(text)), nodes.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(nodes), ["k1", "k2"]) if small else split_join(rows, nodes, ["k1", "k2"])
    return materialise(rows.groupBy("node").agg(F.first("t").alias("t")).mapInArrow(_sets(shingle), "node long, s array<long>"), "shingle-sets")


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) with ok: whether their sets have that Jaccard similarity. Two empty sets are alike."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}"))
    both = split_join(split_join(pairs, side("a"), ["a"]), side("b"), ["b"])
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common >= similarity * (F.size("sa") + F.size("sb") - common) - 1e-9).alias("ok"))


def _within_group(similarity: float, words: int, radius: int, screen: int) -> Callable:
    """Links between the classes of a group of candidates that join all that can be joined.

    Two sets of that similarity share one of the rarest shingles of each: of m shingles, all but similarity * m are
    looked up, the rarest first. Shingles whose holders are all of one class already needn't be, so copies, which share
    their rare shingles, don't look at each other. What is found is screened by size and fingerprint before sets are
    compared. Rows of the largest class needn't be asked, as others ask them.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node, n = table.column("node").to_numpy(), table.num_rows
        sets = table.column("s").combine_chunks()
        size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        values = sets.values.to_numpy()[sets.offsets[0].as_py() : sets.offsets[-1].as_py()]
        ids = np.unique(values, return_inverse=True)[1].ravel()
        fps = np.column_stack([table.column(f"f{w}").to_numpy() for w in range(words)]).astype(np.int64).view(np.uint64)
        labels = np.unique(table.column("joined").to_numpy(), return_inverse=True)[1].ravel()
        owner, first = np.repeat(np.arange(n), size), np.concatenate([[0], np.cumsum(size)])
        held = np.bincount(ids, minlength=1)
        ids = ids[np.lexsort((ids, held[ids], owner))]  # the rarest first in each row
        looked = np.arange(len(ids)) - first[owner] <= size[owner] - np.ceil(similarity * size - 1e-6).astype(np.int64)[owner]
        ask, of = ids[looked], owner[looked]
        least, most = np.full(len(held), n), np.full(len(held), -1)
        np.minimum.at(least, ask, labels[of])
        np.maximum.at(most, ask, labels[of])
        mixed = least[ask] < most[ask]
        ask, of = ask[mixed], of[mixed]
        holders = of[np.argsort(ask, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(ask, minlength=len(held)))])
        mine = np.searchsorted(of, np.arange(n + 1))
        above = list(range(int(labels.max()) + 1 if n else 0))  # a class's next one on the way to the one that it has joined
        empty, mark, seen, found = np.flatnonzero(size == 0), np.zeros(len(held), bool), np.zeros(n, bool), []
        every, since = owner[np.argsort(ids, kind="stable")], np.concatenate([[0], np.cumsum(held)])  # who holds each shingle

        def top(c: int) -> int:
            while above[c] != c:
                above[c] = c = above[above[c]]
            return c

        for i in np.flatnonzero(labels != np.bincount(labels).argmax()).tolist() if n else ():
            near = [holders[begin[x] : begin[x + 1]] for x in ask[mine[i] : mine[i + 1]].tolist()] if size[i] else [empty]
            if not near:
                continue
            seen[:] = False
            for x in near:
                seen[x] = True
            j = np.flatnonzero(seen)
            j = j[(size[j] >= similarity * size[i] - 1e-6) & (size[i] >= similarity * size[j] - 1e-6)]
            bits = np.bitwise_count(fps[j] ^ fps[i])
            j = j[(bits.sum(axis=1, dtype=np.int64) <= radius) & (bits[:, 0] <= screen)]
            classes, back = np.unique(labels[j], return_inverse=True)
            tops = np.array([top(c) for c in classes.tolist()], np.int64)
            j = j[tops[back.ravel()] != top(int(labels[i]))] if len(j) else j
            if not len(j):
                continue
            own, ends = ids[first[i] : first[i + 1]], np.cumsum(size[j])
            if 3 * ends[-1] > held[own].sum():  # many candidates: counted by who holds the row's shingles
                common = np.bincount(np.concatenate([np.zeros(0, np.int64), *[every[since[x] : since[x + 1]] for x in own.tolist()]]), minlength=n)[j]
            else:
                mark[own] = True
                common = np.concatenate([[0], np.cumsum(mark[ids[np.repeat(first[j] + size[j] - ends, size[j]) + np.arange(ends[-1])]])])
                common = common[ends] - common[ends - size[j]]
                mark[own] = False
            for k in j[common >= similarity * (size[i] + size[j] - common) - 1e-9].tolist():
                a, b = top(int(labels[i])), top(int(labels[k]))
                if a != b:
                    found.append((i, k))
                    above[b] = a
        x, y = (np.array([p[c] for p in found], np.int64) for c in range(2))
        return pa.table({"a": pa.array(node[x]), "b": pa.array(node[y])})

    return run


def similar_groups(docs: DataFrame, similarity: float, shingle: int, words: int, radius: int, screen: int, group: int | None = None, most: int = MOST_ENTRIES, holders: int = MOST_HOLDERS) -> tuple[DataFrame, DataFrame]:
    """The distinct fingerprints of docs as _nodes() has them, and (node, component): groups over links whose texts have
    that Jaccard similarity of their sets of shingles, among links of fingerprints within the radius and the screen.

    A forest of candidate links is checked, and what the links that hold join is one from then on. Groups of candidates
    with a refused link may hold others: those of up to `most` shingles are looked through by a task each, and in larger
    ones links between what is still apart are looked for and checked again, but for the refused ones, until there are
    none. So no link is left out, and no group's pairs are all made.
    """
    ship(docs.sparkSession)
    names = [f"f{w}" for w in range(words)]
    distinct, found, classes = candidates(docs, similarity, shingle, words, radius, screen, group, holders)
    sets = _shingle_sets(docs, split_join(distinct, classes, ["node"]).select("node", "best.k1", "best.k2"), shingle)
    checked = materialise(_checked(found, sets, similarity), "checked-links")
    held, refused = checked.filter("ok").select("a", "b"), checked.filter("not ok").select("a", "b")
    joined = materialise(components(held), "similar-groups")
    if refused.isEmpty():
        return distinct, joined
    open_ = split_join(refused.select(F.col("a").alias("node")), classes, ["node"]).select("component").distinct()
    members = split_join(split_join(classes, open_, ["component"], "left_semi"), sets.select("node", F.size("s").alias("n")), ["node"])
    sizes = members.groupBy("component").agg(F.sum("n").alias("n"))
    members = materialise(split_join(members.select("node", "component"), sizes, ["component"]), "open-groups")
    small = split_join(members.filter(F.col("n") <= most).select("node", F.col("component").alias("among")), sets, ["node"])
    small = split_join(split_join(small, distinct.select("node", *names), ["node"]), joined, ["node"], "left").select("among", "node", "s", *names, F.coalesce("component", "node").alias("joined"))
    more = materialise(small.groupBy("among").applyInArrow(_by_key(_within_group(similarity, words, radius, screen)), "a long, b long"), "further-links")
    held = held.union(more)
    large = members.filter(F.col("n") > most).select("node")
    while not large.isEmpty():
        refused = materialise(split_join(refused, large.select(F.col("node").alias("a")), ["a"], "left_semi"), "refused-links")
        active = materialise(split_join(distinct, large, ["node"], "left_semi"), "active-groups")
        found = materialise(links(active, words, radius, screen, group, joined, refused).distinct(), "candidate-links")
        checked = materialise(_checked(found, sets, similarity), "checked-links")
        held = materialise(held.union(checked.filter("ok").select("a", "b")), "held-links")
        joined = materialise(components(held), "similar-groups")
        bad = checked.filter("not ok").select("a", "b")
        refused = refused.union(bad)
        open_ = split_join(bad.select(F.col("a").alias("node")), classes, ["node"]).select("component").distinct()
        large = materialise(split_join(classes, open_, ["component"], "left_semi").select("node"), "open-groups")
    return distinct, materialise(components(held), "similar-groups")


def _by_key(run: Callable) -> Callable:
    return lambda key, table: run(key, table)


def first_of_groups(docs: DataFrame, similarity: float, shingle: int, words: int, radius: int, screen: int, group: int | None = None) -> DataFrame:
    """One row of docs, all columns, of each of similar_groups(): that with the smallest doc_id (null is after all others),
    then with the smallest key of its text, then the smallest of rows that have both. Rows that share a doc_id but no
    text are judged apart. Texts without words are alike."""
    names = docs.columns
    distinct, joined = similar_groups(docs, similarity, shingle, words, radius, screen, group)
    best = split_join(distinct.select("node", "best"), joined, ["node"], "left").select(F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("alone"), "best")
    best = best.filter("alone").select("best").union(best.filter("not alone").groupBy("component").agg(F.min("best").alias("best")).select("best"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), *text_keys(text))
    kept = split_join(rows, best.select("best.*"), ["id", "k1", "k2"], "left_semi")
    # a struct that holds a map has no order of its own
    least = F.min_by("row", F.to_json("row")) if "map<" in kept.select("row").dtypes[0][1] else F.min("row")
    return kept.groupBy("id", "k1", "k2").agg(least.alias("row")).select(*[F.col("row").getField(c).alias(c) for c in names])


__all__ = ["candidates", "components", "fingerprint", "first_of_groups", "forest", "links", "near_duplicates", "similar_groups"]
