"""Substring, near-copy and line dedup against brute force."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash

from tessera.llm import queries as Q
from tessera.llm import simhash as SH
from tessera.llm import site_lines as SL
from tessera.llm import substring as SB
from tessera.llm import words as WD


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kept_by_force(rows, window):
    seen = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            seen[x] = min(seen.get(x, 1 << 63), (1 << 62) if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] < ((1 << 62) if i is None else i):
                gone[k : k + window] = [True] * window
        out.append((str(i), len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(rng.choice(list("abcde"), 4)) for _ in range(n))
    p, q = word(70), word(50)
    texts = ["", None, " \n\t", p, f"x {p} y", f"{word(20)} {q} {word(20)}", f"{q} {p}", p, p, " ".join(["la"] * 400), " ".join(["la"] * 200), q.replace(" ", "\u00a0 ", 3), word(60_000), "a\x1cb " * 60, "a\x1cb " * 60]
    return [(k if k != 8 else None, t) for k, t in enumerate(texts)] + [(3, p), (3, f"{q} again")]


def test_substring(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, owner int, k1 string")
    for window, anchor in ((50, 16), (5, 2), (3, 3)):
        got = SB.remove_repeated(df, window, anchor, with_text=True).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == kept_by_force(rows, window)
        assert all(sha(r.kept) == r.kept_sha256 and sum(b - a for a, b in r.intervals) == r.n_removed for r in got)
    assert SB.remove_repeated(df.filter("false")).collect() == []


def test_substring_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.QUERIES["op4_substring_windows"](spark, sf).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == kept_by_force(rows, 50)


def test_word_hashes_by_blocks(monkeypatch):
    text = ("ab  cd\n" * 500 + "x" * 3000 + " é漢 ab").encode()
    whole = WD.word_hashes(text)
    monkeypatch.setattr(WD, "_BLOCK", 64)
    assert np.array_equal(whole, WD.word_hashes(text)) and whole.shape[1] == len(text.split())
    h = WD.window_hashes(whole[0], 7, 0xD1342543DE82EF95)
    n = collections.Counter(tuple(text.split()[k : k + 7]) for k in range(len(h)))
    assert len(set(h.tolist())) == len(n)


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 4):
            up[top(k)] = top(int(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min((x for x in (least.get(top(k)), i) if x is not None), default=None)
    return sorted((str(i), f"{int(fps[k]):016x}", least[top(k)]) for k, (i, _) in enumerate(rows))


def test_simhash(spark):
    rng = np.random.default_rng(4)
    base = [str(x) for x in rng.integers(0, 10**6, 3000)]
    near = []
    for k in range(60):  # one large group of near copies
        w = list(base)
        w[int(rng.integers(0, 3000))] = f"new{k}"
        near.append(" ".join(w))
    rows = [*corpus(), *[(100 + k, t) for k, t in enumerate(near)], (None, ""), (400, "One TWO three"), (401, "one two\nthree"), (402, "one two")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    for group in (1 << 17, 2):
        got = SH.near_duplicates(df, group=group).collect()
        assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == components(rows)
    assert SH.near_duplicates(df.filter("false")).collect() == []


def test_simhash_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.QUERIES["op7_simhash_tiled"](spark, sf).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == components(rows)


def test_forest_skips_only_tiles_without_links():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    fps[1500:] = fps[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    x, y = SH.forest(fps[:, None], None, 4, tile=16)
    assert {frozenset(p) for p in zip(x.tolist(), y.tolist(), strict=True)} == {frozenset((k, k + 1500)) for k in range(1500) if fps[k] != fps[k + 1500]} | {frozenset((k, k + 1500)) for k in range(1500) if fps[k] == fps[k + 1500]}
    side = (np.arange(3000) >= 1500).astype(np.int8)
    assert len(SH.forest(fps[:, None], side, 4, tile=16)[0]) == 1500
    assert len(SH.forest(fps[:1500, None], None, 4, tile=16)[0]) == 0


def test_forest_of_links():
    rng = np.random.default_rng(6)
    fps = (rng.integers(0, 4, 400, dtype=np.uint64) << np.uint64(40)) ^ (np.uint64(1) << rng.integers(0, 30, 400).astype(np.uint64))
    x, y = SH.forest(fps[:, None], None, 2, tile=32)
    assert np.bitwise_count(fps[x] ^ fps[y]).max() <= 2  # links themselves
    links = {(a, b) for a in range(400) for b in range(a) if np.bitwise_count(fps[a] ^ fps[b]) <= 2}

    def classes(pairs, labels):
        labels = list(labels)
        for a, b in [*pairs, *pairs, *pairs] * 3:
            labels[a] = labels[b] = min(labels[a], labels[b])
        return [labels[labels[k]] for k in range(400)]

    assert len(x) == 400 - len(set(classes(links, range(400))))
    refused = np.array(sorted(links))[::2]
    x, y = SH.forest(fps[:, None], None, 2, tile=32, refused=refused)
    assert not {tuple(sorted(p, reverse=True)) for p in zip(x.tolist(), y.tolist(), strict=True)} & set(map(tuple, refused.tolist()))
    assert len(SH.forest(fps[:, None], None, 2, joined=np.zeros(400, np.int64))[0]) == 0


def test_dealing_by_population_count():
    rng = np.random.default_rng(7)
    sizes = {int(k): int(v) for k, v in zip(*np.unique(rng.binomial(64, 0.5, 20_000), return_counts=True), strict=True)}
    table = SH._dealing(sizes, 4, 500)
    groups = {p: set(range(table[p][0], table[p][0] + table[p][1])) for p in sizes}
    for p in sizes:
        for q in sizes:
            reach = set(range(table[p][2], table[p][3] + 1))
            assert abs(p - q) > 4 or groups[q] <= reach
            assert all((g in set(range(table[q][2], table[q][3] + 1))) == (groups[q].isdisjoint(reach) is False) for g in groups[p])
    assert max(v[3] - v[2] + 1 for v in table) < 0.8 * len(set().union(*groups.values()))
    assert SH._dealing({}, 4, 500) == [(0, 1, 0, 0)]


def test_a_host_of_few_pages(spark):
    df = spark.createDataFrame([(k, f"menu\nbody {k}", "small") for k in range(4)] + [(9, "menu\nalone", "one")], "doc_id long, text string, source string")
    assert {r.doc_id: r._n_dropped for r in SL.drop_site_lines(df).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 9: 0}


def test_components_of_a_chain(spark):
    n = 300
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in SH.components(edges).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 1000: 1000, 1001: 1000}


def site_rows():
    menu = "menu\nhome"
    rows = [(k, f"{menu}\nbody {k}\n\nbody {k}", "a") for k in range(8)] + [(20 + k, f"home\nother {k}", "b") for k in range(3)]
    return [*rows, (30, None, "a"), (31, "", None), (32, "home\nhome", "a"), (32, "home\nhome", "a"), (None, "x\n", "a")]


def test_site_lines(spark):
    rows = site_rows()
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, source string, host string")
    got = SL.drop_site_lines(df, ratio=0.5, min_pages=3)
    assert got.columns == ["doc_id", "text", "source", "host", "_n_lines", "_n_dropped"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append((r.text, r._n_lines, r._n_dropped))
    assert by[0] == [("body 0\n\nbody 0", 5, 2)] and by[21] == [("other 1", 2, 1)]
    assert by[30] == [(None, 1, 0)] and by[31] == [("", 1, 0)] and by[32] == [("", 2, 2)] * 2 and by[None] == [("x\n", 2, 0)]
    kept = {r.doc_id: r.text for r in SL.drop_site_lines(df, ratio=0.5, min_pages=3, max_loss=0.5).collect()}
    assert kept[32] == "home\nhome" and kept[0] == "body 0\n\nbody 0"
    assert SL.drop_site_lines(df.filter("false")).collect() == []


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracles(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = c.sql(Q.ORACLE[name])
    got = Q.QUERIES[name](spark, sf)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[x] for x in want.columns)) for r in got.collect())
