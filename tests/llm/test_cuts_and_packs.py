"""Fill-in-the-middle, importance resampling and packing against plain versions of the same rules."""

import bisect
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import fim, packing, queries, resampling

PATH = public_tokenizers.path("word_bpe_49k.json")
os.environ["TOKENIZERS_PARALLELISM"] = "false"
MIXED = st.text(alphabet="ab é漢😀<PSM>\n", max_size=300)


@given(MIXED, st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_rank_index_has_every_offset(text, times):
    text = text * (1 + 40 * times)
    index, at = fim.RankIndex(text.encode()), 0
    assert index.n == len(text)
    for k, c in enumerate(text):
        assert index[k] == at
        at += len(c.encode())
    assert index[len(text)] == at
    with pytest.raises(IndexError):
        index[len(text) + 1]


def test_lines_are_few_and_blocks_meet(monkeypatch):
    text = "plain letters " * 5000
    assert len(fim.RankIndex(text.encode()).ranks) == 1
    bent = "abc" * 50_000 + "漢é" * 60_000 + "z😀" * 70_000
    index = fim.RankIndex(bent.encode())
    assert len(index.ranks) < 20 and index.residuals.dtype == np.int8
    monkeypatch.setattr(fim, "BLOCK", 64)
    small, offsets = fim.RankIndex(bent[:2000].encode() + "é漢".encode()), np.cumsum([0, *(len(c.encode()) for c in bent[:2000] + "é漢")])
    assert [small[k] for k in range(2003)] == offsets.tolist()


def plain_fim(doc_id, text, percent=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in fim.MARKERS) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h[3] % 100 < spm:
        return n, "spm", a, z - a, "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return n, "psm", a, z - a, "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def rows(spark, extra=()):
    texts = [None, "", " ", "a", "<P", "S>", "x<S>y", "é" * 70_000, "日本語 text 😀", "<<<" * 9, "w " * 400_000, *["same words again and again"] * 40, *(f"number {k} of <M" for k in range(120)), *extra]
    data = [(None if k == 5 else k, t, k, "x") for k, t in enumerate(texts)] + [(7, "again", 0, "x"), (7, "again", 0, "x")]
    return spark.createDataFrame(data, "doc_id long, text string, _at int, rank string"), data


def test_fill_in_middle(spark):
    df, data = rows(spark)
    got = fim.fill_in_middle(df)
    found = got.withColumn("back", fim.restored(got["output"], got["form"])).collect()
    want = [(i, *plain_fim(i, t), t or "") for i, t, *_ in data]
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found))) == sorted(map(repr, want))
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    other = fim.fill_in_middle(df, 100, 50, ("[pre]", "[suf]", "[mid]"), seed=3)
    assert other.filter(fim.restored(other["output"], other["form"], ("[pre]", "[suf]", "[mid]")) != "").count() == sum(bool(t) for _, t, *_ in data)
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, markers=("aa", "ab", "ac"))


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(x.encode()) % 10000 for x in [*words, *map(" ".join, zip(words, words[1:], strict=False))]]


@given(st.text(alphabet="abAZé9漢-_ \n\x00", max_size=200), st.integers(8, 64))
@settings(max_examples=200, deadline=None)
def test_features(text, block):
    text = text + " " + "q" * 70 + " w " + "é" * 32 + " " + "r" * 63 + "\t" + "s" * 64
    held, resampling.BLOCK = resampling.BLOCK, block
    try:
        n, parts = resampling.features(text.encode(), resampling._Checksums())
    finally:
        resampling.BLOCK = held
    want = plain_features(text)
    assert n == want[0] and sorted(np.concatenate(parts).tolist()) == sorted(want[1])


@given(st.integers(1, 200_000), st.integers(0, 20_000), st.integers(0, 1000))
@settings(max_examples=40, deadline=None)
def test_bit_planes_sum_exactly(most, height, seed):
    rng = np.random.default_rng(seed)
    gain, counts = rng.integers(-height, height + 1, 10000), rng.integers(0, most + 1, 10000) * (rng.random(10000) < 0.1)
    counts[rng.integers(10000)] = most
    assert resampling.weight(counts, *resampling.gain_planes(gain)) == int(counts @ gain)


def plain_resample(data, target, percent, least):
    of = {k: plain_features(t) for k, (_, t, *_) in enumerate(data)}
    s, t = Counter(b for _, f in of.values() for b in f), Counter(b for x in target for b in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for k, (i, *_) in enumerate(data):
        n, f = of[k]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(may[: percent * len(may) // 100]):
        x[4] = k + 1
    return sorted(repr(tuple(x[:5])) for x in out)


@pytest.mark.parametrize(("percent", "least"), [(25, 20), (60, 1), (100, 0), (0, 3)])
def test_resample(spark, percent, least):
    rng = np.random.default_rng(5)
    extra = [" ".join(rng.choice(["law", "court", "sea", "ship", "Wind", "9"], rng.integers(1, 60))) for _ in range(150)]
    df, data = rows(spark, extra)
    target = [None, "", "the ship at sea", "a court of law the court"]
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, least)
    found = sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in got.collect())
    assert found == plain_resample(data, target, percent, least)


def test_resample_without_rows(spark):
    df, _ = rows(spark)
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(df.limit(0), none).count() == 0
    assert resampling.resample(df, none, 50, 2).filter("rank is not null").count() > 50


def test_registered_resampling_is_the_plain_one(spark, sf):
    import pyarrow.parquet as pq

    data = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    target = pq.read_table(f"{sf}/benchmark.parquet").column("text").to_pylist()
    got = queries.QUERIES["op12_resampling_bit_planes"](spark, sf).collect()
    assert sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == plain_resample(data, target, 25, 20)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return packing.WordCodec(open(PATH, "rb").read())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab's \n\t\x0b\x0c\r\x1c\x85  ́ΣςÉéſßİıÿŸ漢1.,-’﻿", max_size=60), st.text(alphabet="<|startofendx> aé", max_size=60)))
@settings(max_examples=400, deadline=None)
def test_word_codec_is_the_library(codec, library, text):
    for t in (text, text + "<|endoftext|>" + text, text + " <|startoftext|>x"):
        assert np.frombuffer(codec.encode(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_word_codec_on_texts_and_blocks(codec, library, sf, monkeypatch):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for block, kept in ((1 << 20, 300_000), (50, 64)):
        monkeypatch.setattr(packing, "BLOCK", block)
        monkeypatch.setattr(packing, "KEPT", kept)
        for t in [*texts, " " * 3000 + "x" * 500, "漢字 " * 300]:
            assert np.frombuffer(codec.encode(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        packing.WordCodec(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())


def plain_best_fit(lengths, most):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else most
        n += room == most
        bisect.insort(rooms, room - x)
    return n


@given(st.sampled_from([10, 50, 200]), st.lists(st.integers(1, 200), max_size=300), st.integers(1, 200))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit(most, lengths, top):
    lengths = [1 + x % min(most, top) for x in lengths]
    plan, seen, used = packing.best_fit(Counter(lengths), most), Counter(), {}
    for length, rank, n, sequence, each, at in plan:
        assert rank == seen[length] and n > 0
        seen[length] += n
        for k in range(n):
            used.setdefault(sequence + k // each, []).append((at + k % each * length, length))
    assert seen == Counter(lengths) and len(used) == plain_best_fit(lengths, most)
    for slots in used.values():
        ends = [0, *(a + n for a, n in sorted(slots))]
        assert [a for a, _ in sorted(slots)] == ends[:-1] and ends[-1] <= most


def test_plan_stays_small():
    rng = np.random.default_rng(3)
    counts = {int(k): int(n) for k, n in zip(range(1, 4097), rng.integers(1, 10**9, 4096), strict=True)}
    assert len(packing.best_fit(counts, 4096)) < 3 * 4096 * 12


def check_packed(found, data, library, most):
    want = []
    for i, t, *_ in data:
        ids = ids_of(library, t)
        want += [(i, k // most, k, len(ids[k : k + most]), zlib.crc32(np.array(ids[k : k + most], "<u4").tobytes())) for k in range(0, len(ids), most)]
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in found) == sorted(map(repr, want))
    used = {}
    for r in found:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in used.values():
        ends = [0, *(a + n for a, n in sorted(slots))]
        assert [a for a, _ in sorted(slots)] == ends[:-1] and ends[-1] <= most
    assert len(used) == plain_best_fit([x[3] for x in want], most)


@pytest.mark.parametrize("most", [16, 4096])
def test_pack_documents(spark, library, most):
    df, data = rows(spark, ["a few words"] * 300)
    found = packing.pack_documents(df, PATH, most=most).collect()
    check_packed(found, data, library, most)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_sequences_hold_the_ids(spark, library):
    df, data = rows(spark)
    pieces = packing.pack_documents(df.repartition(5), PATH, most=128, with_ids=True)
    whole = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert sum(map(len, whole.values())) == sum(len(ids_of(library, t)) for _, t, *_ in data)


def test_registered_packing(spark, sf, library):
    import pyarrow.parquet as pq

    data = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    check_packed(queries.QUERIES["op13_packing_best_fit"](spark, sf).collect(), data, library, 4096)
