"""BPE chunk reuse and token-id files."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe
from tessera.llm import token_files as TF

PATH = public_tokenizers.path("byte_bpe_50k.json")
os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def reference(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


ODD = ["", " ", "a", "a  b", "it's 'LL' we'd", "x" * 3000, "漢字" * 900, "<|endoftext|>", "a<|endoftext|> b <|endoftext|", "\u00a0\u2003 x\u3000", "\x1c\x1d \x85", "\U0001f600" * 50, "  \n\n\t x", "é" * 5]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab'sl \n\t\u00a0\u3000<|endoftxé漢1", max_size=120)))
def test_codec_is_the_library(codec, library, text):
    assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(codec.encode(text).tolist()) == library.decode(library.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab's \n\u00a0\u30001漢é<|endoftext|>.", min_size=1, max_size=150), st.lists(st.integers(1, 400), max_size=6))
def test_any_joins_are_repaired(codec, text, cuts):
    data = text.encode()
    places = sorted({c for c in cuts if c < len(data) and data[c] & 0xC0 != 0x80})
    borders = [0, *places, len(data)]
    pieces = [(a, codec.encode_bytes(data[a:b])) for a, b in zip(borders, borders[1:], strict=False)]
    assert bpe.join_pieces(data, pieces, codec)[0].tolist() == codec.encode(text).tolist()


def test_safe_cuts_are_exact(codec):
    text = "One two\nthree é 漢 four\u00a0 five\u2003 six's  seven"
    data = text.encode()
    for p in bpe.safe_cuts(data).tolist():
        assert codec.encode_bytes(data[:p]).tolist() + codec.encode_bytes(data[p:]).tolist() == codec.encode(text).tolist()


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(4000)]
    shared = " ".join(words[:3000])
    a, b = (" ".join(words[3000:3300]) + " " + shared).encode(), ("x y " + shared + " z").encode()
    parts = lambda d: {d[s:e] for s, e in zip([0, *bpe.chunk_borders(d)], bpe.chunk_borders(d), strict=False)}
    assert sum(map(len, parts(a) & parts(b))) > 0.9 * len(shared)
    for d in (a, b, "漢".encode() * 9000, b"x" * 2_000_000):
        ends = bpe.chunk_borders(d)
        assert ends[-1] == len(d) and max(np.diff([0, *ends])) <= bpe.MOST
        for s, e in zip([0, *ends], ends, strict=False):
            d[s:e].decode()


def documents(spark, extra=()):
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    passage = " ".join(f"shared{k}" for k in range(900))
    texts = [*ODD, None, long, long + " end", "start " + passage, passage + " other", passage, passage, *extra]
    rows = [(k if k != 3 else None, t, "x", k) for k, t in enumerate(texts)] + [(5, "again", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, k1 string, at int"), [(r[0], r[1] or "") for r in rows]


def test_encode_documents(spark, library):
    df, rows = documents(spark)
    got = bpe.encode_documents(df, PATH)
    want = sorted((str(i), *reference(library, t)) for i, t in rows)
    found = got.collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want
    assert sum(r.n_reused for r in found) > 0


def test_decode_documents(spark):
    df, rows = documents(spark)
    ids = bpe.encode_documents(df, PATH, with_ids=True).select("doc_id", "ids")
    assert sorted(map(str, map(tuple, bpe.decode_documents(ids, PATH).collect()))) == sorted(map(str, rows))


def test_empty_table(spark):
    df, _ = documents(spark)
    assert bpe.encode_documents(df.filter("false"), PATH).collect() == []
    assert TF.read_token_files(TF.write_token_files(df.filter("false"), PATH)).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-(1 << 40), 1 << 40), max_size=300).map(sorted))
def test_elias_fano(values):
    ef, _ = TF.EliasFano.read(TF.EliasFano.of(np.array(values, np.int64)).to_bytes(), 0)
    assert ef.block(0, len(values)).tolist() == values
    for i, j in ((0, 1), (1, 70), (63, 65), (64, 200), (130, 131), (250, 400), (7, 7)):
        assert ef.block(i, j).tolist() == values[i:j]
    assert [ef[k] for k in range(len(values))] == values


LONG = [" " * 2_000_000 + "a", "\n" * 1_000_000, "one" + " \n" * 600_000 + "<|endoftext|>", ("x" + " " * 4500) * 300, "y" + "\u3000\u00a0" * 4000, "\t" * 5000 + "'s"]


@pytest.mark.parametrize("k", range(len(LONG)))
def test_long_white_space(codec, library, k):
    text, data = LONG[k], LONG[k].encode()
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text).tolist() == want
    ends = bpe.chunk_borders(data)
    assert bpe.join_pieces(data, [(a, codec.encode_bytes(data[a:b])) for a, b in zip([0, *ends], ends, strict=False)], codec)[0].tolist() == want


def test_long_white_space_in_documents(spark, library):
    df = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    want = sorted((i, *reference(library, t)) for i, t in enumerate(LONG))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(df, PATH).collect()) == want
    got = {r.doc_id: r.n_tokens for r in TF.read_token_files(TF.write_token_files(df, PATH)).collect()}
    assert got == {i: n + 1 for i, n, _, _ in want}


def test_rows_of_one_id_are_dealt_to_shards(spark):
    df = spark.range(400).selectExpr("cast(null as long) doc_id", "concat(id, ' text') text")
    manifest = TF.write_token_files(df, PATH, shards=8)
    assert manifest.count() == 8 and max(r.n_docs for r in manifest.collect()) < 200
    assert TF.read_token_files(manifest).count() == 400


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(2).integers(1, 2000, 100_000))
    assert len(TF.EliasFano.of(ends).to_bytes()) * 8 / len(ends) < 2 + np.log2(1000) + 1.5


def test_token_files(spark, codec):
    df, rows = documents(spark)
    manifest = TF.write_token_files(df, PATH, end_id=0, shards=3)
    got = [tuple(r) for r in TF.read_token_files(manifest).collect()]
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.append(codec.encode(t), 0).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    first = min(manifest.collect(), key=lambda r: r.shard).asDict()
    assert TF.token_ids(first, 0).tolist() == [*codec.encode(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[0][1]).tolist(), 0]


def test_registered_queries_are_the_library(spark, library, sf):
    import pyarrow.parquet as pq

    from tessera.llm import queries

    docs = sorted((r["doc_id"], r["text"] or "") for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist())
    got = queries.QUERIES["op1_bpe_chunk_reuse"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == [(i, *reference(library, t)) for i, t in docs]
    want, start = [], 0
    for i, t in docs:
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.QUERIES["op8_token_files_elias_fano"](spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
