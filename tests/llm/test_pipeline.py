"""The pipeline's stages against brute force on whole small tables."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tessera.llm import simhash


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in C.STAGES:
        docs = C.materialise(stage(spark, docs, folder), name)
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in C.STAGES] == ["quality", "lines", "near_copies", "benchmark", "encoding"]
    for name, _ in C.STAGES[:-1]:
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = rows(stages["quality"])
    hidden = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([(i in kept) == bool(y) for i, y in hidden.items()]) > 0.95
    before = rows(stages["documents"])
    assert all(before[i] == r for i, r in kept.items())


def test_lines(stages):
    before, after = rows(stages["quality"]), rows(stages["lines"])
    texts = {(r.source, r.text or "") for r in before.values()}  # equal texts of a source count once
    pages, held = collections.Counter(source for source, _ in texts), collections.Counter()
    for source, text in texts:
        held.update({(source, x) for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")})
    for i, r in before.items():
        kept = [x for x in (r.text or "").split("\n") if not (held[(r.source, x)] >= 2 and held[(r.source, x)] > 0.05 * pages[r.source])]
        want = "\n".join(kept)
        assert after[i].text == want and after[i].n_chars == (r.n_chars if want == r.text else len(want))
    assert set(before) == set(after)


def similar(texts):
    """Links of at least the similarity between distinct texts, by the shingles that they share."""
    found = [set(simhash.shingle_hashes((t or "").encode(), C.SHINGLE).tolist()) for t in texts]
    where = collections.defaultdict(list)
    for k, s in enumerate(found):
        for x in s or {None}:
            where[x].append(k)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    return [(a, b) for a, b in pairs if len(found[a] & found[b]) >= C.SIMILARITY * len(found[a] | found[b]) - 1e-9]


def grouped(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in sorted(pairs):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(k) for k in range(n)]


def test_near_copies(stages):
    before, after = rows(stages["lines"]), rows(stages["near_copies"])
    ids = sorted(before)
    pairs = similar([before[i].text for i in ids])
    fps = np.array([np.frombuffer(simhash.set_fingerprint((before[i].text or "").encode(), C.SHINGLE, C.WORDS), "<u8") for i in ids])
    bits = {p: np.bitwise_count(fps[p[0]] ^ fps[p[1]]) for p in pairs}
    linked = [p for p in pairs if bits[p].sum() <= C.RADIUS and bits[p][0] <= C.SCREEN]
    assert len(pairs) > 50 and len(linked) == len(pairs)  # here radius and screen lose no link
    assert sorted(after) == sorted({ids[k] for k in grouped(len(ids), linked)})
    assert all(after[i] == before[i] for i in after)


def test_groups_of_similar_texts(spark):
    """Chains, large groups, links of fingerprints that don't hold, and texts of few words, in cells of any size."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    texts = []
    for k in range(60):  # a large group, each text with its own changes
        w = list(base)
        w[int(rng.integers(0, 300))] = f"new{k}"
        texts.append(" ".join(w))
    for k in range(0, 120, 4):  # a chain, whose ends aren't similar, and whose fingerprints link further than its texts do
        texts.append(" ".join(f"c{j}" for j in range(k, k + 60)))
    for k in range(40):  # fingerprints near each other, similarities on both sides of the bound
        w = [f"d{j}" for j in range(90)]
        for j in rng.choice(90, 3, replace=False):
            w[j] = f"e{k}x{j}"
        texts.append(" ".join(w))
    texts += ["a b c d e f g h", "a b c d e f g h i", "A b c d e f g H", "a b", "a  b", "", "\n", "x", "a b c d e f g h"]
    want = grouped(len(texts), similar(texts))
    df = spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, k1 string, node int").repartition(3)
    for group in (None, 15):
        got = simhash.first_of_groups(df, C.SIMILARITY, C.SHINGLE, C.WORDS, C.RADIUS, C.SCREEN, group)
        assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(want))


def test_groups_in_rounds(spark):
    """A group that is too large for a task: links are refused until only those that hold are left."""
    texts = [" ".join(f"c{j}" for j in range(k, k + 30)) for k in (0, 2, 5, 8, 30)] + ["other words that have nothing to do with it"]
    want = grouped(len(texts), similar(texts))
    distinct, joined = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), C.SIMILARITY, C.SHINGLE, C.WORDS, 110, 40, most=0)
    least, parts = {r.node: r.least for r in distinct.collect()}, collections.defaultdict(set)
    for r in joined.collect():
        parts[r.component].add(least[r.node])
    assert sorted(map(sorted, parts.values())) == sorted(sorted(k for k in range(len(texts)) if want[k] == x) for x in set(want) if want.count(x) > 1)


def groups(spark, texts, **settings):
    distinct, joined = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), C.SIMILARITY, C.SHINGLE, C.WORDS, C.RADIUS, C.SCREEN, **settings)
    least, parts = {r.node: r.least for r in distinct.collect()}, collections.defaultdict(set)
    for r in joined.collect():
        parts[r.component].add(least[r.node])
    return sorted(map(sorted, parts.values()))


def wanted(texts):
    own = {}
    for k, t in enumerate(texts):  # one of those with equal words
        own.setdefault(" ".join(t.lower().split()), k)
    ids = list(own.values())
    top = grouped(len(ids), similar([texts[k] for k in ids]))
    return sorted(sorted(ids[k] for k in range(len(ids)) if top[k] == x) for x in set(top) if top.count(x) > 1)


def test_cells_are_for_common_shingles(spark, monkeypatch):
    """Work that grows with the text: texts are compared if they share a first shingle, not all with all, whatever line
    stands in many of them."""
    rng, compared, links = np.random.default_rng(3), [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, *a: compared.append(nodes.count()) or links(nodes, *a))
    line = " ".join(f"menu{k}" for k in range(12))
    texts = [f"{line} " * (k % 2) + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for k in range(1500)]
    texts += [f"{t} end" for t in texts[:40]]
    assert groups(spark, texts) == wanted(texts) == [[k, 1500 + k] for k in range(40)]
    assert sum(compared) <= 100


@pytest.mark.parametrize("holders", [1, 2, 8])
def test_common_shingles_lose_no_link(spark, holders):
    """Shingles of more texts than are compared at once: these texts meet in cells, alone or beside others."""
    rng, texts = np.random.default_rng(4), []
    for k in range(12):
        base = [f"b{k}x{j}" for j in range(10 + 12 * k)]
        for c in range(k):
            w = list(base)
            for j in rng.integers(0, len(w), k // 4):
                w[j] = f"c{c}x{j}"
            texts.append(" ".join([*(["the", "same", "words", "in", "all", "of", "them"] * (c % 2)), *w]))
    texts += ["a b", "A  b", "", "\n", "x", "a b c d e f g h", "a b c d e f g h i"]
    assert groups(spark, texts, holders=holders) == wanted(texts)


def test_shingle_keys():
    rng = np.random.default_rng(5)
    texts = [b"", b" \n", b"a", b"A\x0bb c", b"x y " * 300, *(b" ".join(b"%d" % x for x in rng.integers(0, 30, n)) for n in rng.integers(0, 900, 40))]
    keys, sizes = simhash._shingle_keys(texts, C.SHINGLE)
    assert sizes.tolist() == [len(simhash.shingle_hashes(t, C.SHINGLE)) for t in texts]
    ends = np.cumsum(sizes)
    for k, t in enumerate(texts):  # wherever a text stands
        alone = simhash._shingle_keys([t], C.SHINGLE)[0]
        assert np.array_equal(alone, keys[ends[k] - sizes[k] : ends[k]])


def test_one_task_finds_what_joins_a_group():
    rng = np.random.default_rng(9)
    sets = [np.unique(np.concatenate([rng.choice(60, 40, replace=False), 1000 * (k % 3) + np.arange(30)])) for k in range(60)]
    joined = rng.integers(0, 25, 60)
    import pyarrow as pa

    table = pa.table({"node": pa.array(np.arange(60)), "s": pa.array([s.tolist() for s in sets], pa.list_(pa.int64())), "f0": pa.array(np.zeros(60, np.int64)), "joined": pa.array(joined)})
    got = simhash._within_group(0.5, 1, 4, 4)((0,), table)
    links = list(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True))
    same = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b]))
    assert all(same(a, b) for a, b in links)
    before = [(a, b) for a in range(60) for b in range(a) if joined[a] == joined[b]]
    assert grouped(60, before + links) == grouped(60, before + [(a, b) for a in range(60) for b in range(a) if same(a, b)])


@pytest.mark.parametrize("seed", range(6))
def test_one_task_against_all_pairs(seed):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    base, sets = rng.choice(500, 60, replace=False), []
    for _ in range(150):
        s = base[: rng.integers(20, 60)].copy()
        s[rng.random(len(s)) < rng.choice([0.02, 0.1, 0.3])] = rng.integers(500, 2000)
        sets.append(np.unique(s))
    sets += [np.zeros(0, np.int64), np.array([1]), np.array([1, 2])]
    n, joined = len(sets), rng.integers(0, 60, len(sets))
    table = pa.table({"node": pa.array(np.arange(n) + 7), "s": pa.array([s.tolist() for s in sets], pa.list_(pa.int64())), "f0": pa.array(np.zeros(n, np.int64)), "joined": pa.array(joined)})
    got = simhash._within_group(0.8, 1, 4, 4)((0,), table)
    links = [(a - 7, b - 7) for a, b in zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True)]
    same = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9
    before = [(a, b) for a in range(n) for b in range(a) if joined[a] == joined[b]]
    assert all(same(a, b) for a, b in links)
    assert grouped(n, before + links) == grouped(n, before + [(a, b) for a in range(n) for b in range(a) if same(a, b)])


def test_a_large_group_is_one_task_in_time():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = 50_000
    own = rng.integers(1 << 20, 1 << 50, (n, 10))
    own[1::1000] = own[0::1000]  # fifty pairs of near copies
    own[1::1000, 0] += 1
    sets = np.concatenate([np.tile(np.arange(30), (n, 1)), own], axis=1)
    table = pa.table({"node": pa.array(np.arange(n)), "s": pa.array(list(sets), pa.list_(pa.int64())), "f0": pa.array(np.zeros(n, np.int64)), "joined": pa.array(np.arange(n))})
    began = time.time()
    got = simhash._within_group(0.8, 1, 4, 4)((0,), table)
    assert time.time() - began < 30
    assert sorted(tuple(sorted(x)) for x in zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True)) == [(k, k + 1) for k in range(0, n, 1000)]


def test_rows_that_share_an_id(spark):
    long = " ".join(f"word{k}" for k in range(30))
    rows_ = [(5, long, "b"), (5, "another text of six words", "a"), (5, long, "a"), (None, long, "c"), (None, "alone without an id", "c"), (7, None, "n"), (3, "", "e"), (3, None, "d")]
    got = simhash.first_of_groups(spark.createDataFrame(rows_, "doc_id long, text string, source string"), C.SIMILARITY, C.SHINGLE, C.WORDS, C.RADIUS, C.SCREEN)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(5, long, "a"), (5, "another text of six words", "a"), (None, "alone without an id", "c"), (3, None, "d")]))


def test_benchmark(spark, stages):
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    before, after = rows(stages["near_copies"]), rows(stages["benchmark"])
    assert set(after) == {i for i, r in before.items() if not any(t in (r.text or "") for t in items)}


def test_encoding(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts, got = rows(stages["benchmark"]), rows(stages["encoding"])
    assert set(texts) == set(got)
    for i, r in texts.items():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_columns_that_stages_use_themselves(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"menu\nsome text {k} of a page", "en", "s", 3, 7, "x", 1.5) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long, _n_lines int, Lines string, Statistics double")
    lines = C.line_stage(spark, docs, "")
    assert lines.columns == docs.columns and {(r._n_lines, r.Lines, r.Statistics, "menu" in r.text) for r in lines.collect()} == {(7, "x", 1.5, False)}
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert C.quality_stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_stages_take_odd_rows(spark, tmp_path):
    passage = " ".join(f"word{k}" for k in range(40))
    texts = [None, "", " ", passage, passage, passage + " end", "z" * 50_000, "a\nb\na"]
    docs = spark.createDataFrame([(k if k != 4 else None, t, None, "s" if k else None, 1, "x", 2) for k, t in enumerate(texts)] + [(3, passage, "en", "s", 1, "x", 2)], "doc_id long, text string, lang string, source string, n_chars long, row string, k1 int")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in C.STAGES:
        for df in (docs, docs.filter("false")):
            out = stage(spark, df, str(tmp_path))
            out.collect()
            assert name == "encoding" or out.columns == docs.columns
    near = C.near_copy_stage(spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in near.collect()) == ["0", "3", "6", "7"]
    assert C.benchmark_stage(spark, docs, str(tmp_path)).filter(F.col("text").contains("word39")).count() == 0


def test_rows_with_a_map_column(spark):
    rows_ = [(1, "some words that are there twice", {"a": 1}), (1, "some words that are there twice", {"b": 2}), (2, "other words of which there is one", None)]
    got = simhash.first_of_groups(spark.createDataFrame(rows_, "doc_id long, text string, m map<string,int>"), C.SIMILARITY, C.SHINGLE, C.WORDS, C.RADIUS, C.SCREEN)
    assert sorted((r.doc_id, str(r.m)) for r in got.collect()) == [(1, "{'a': 1}"), (2, "None")]
