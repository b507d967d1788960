import base64
import hashlib

import pytest

from tessera.llm import warc as W


def pages(spark):
    big = "<p>" + "äé漢" * 60_000
    rows = [(3, "http://a", "x"), (1, "http://b", "x"), (2, "http://c\r\nd", big), (9, None, big), (4, "u", ""), (5, "u", None), (None, "u", "x"), (6, "u", "y"), (6, "u", "y"), (7, "u", "WARC/1.1\r\n\r\n")]
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, sha string"), rows


def base32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip(spark):
    df, rows = pages(spark)
    got = [r for r in W.read_warc(W.write_warc(W.chunked_records(df))).collect()]
    last = [r for r in got if r.is_last]
    first = {}
    for i, _, h in rows:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    seen, want = set(), []
    for i, _, h in rows:
        h = h or ""
        response = i == first[h] and (i, h) not in seen
        seen.add((i, h))
        want.append((str(i), len(h.encode()), base32(h), "response" if response else "revisit", None if response else first[h]))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in last) == sorted(want, key=lambda r: r)
    parts = {}
    for r in sorted((r for r in got if r.record_type == "response"), key=lambda r: r.chunk_no):
        parts[r.page_id] = parts.get(r.page_id, b"") + bytes(r.data)
        assert len(r.data) <= W.CHUNK and r.payload_digest == base64.b32encode(hashlib.sha1(parts[r.page_id]).digest()).decode()
    assert parts[2].decode() == rows[2][2] and parts[4] == b""


def test_bound_for_revisits(spark):
    df, _ = pages(spark)
    rows = [r for r in W.read_warc(W.write_warc(W.chunked_records(df, min_revisit_bytes=2)), with_data=False).collect() if r.is_last]
    assert sum(r.record_type == "revisit" for r in rows) == 1 and len(rows) == 10


def test_a_bound_gives_a_record_a_page(spark):
    rows = [(k, f"u{k}", "xy" if k % 4 == 0 else "z" if k % 2 else "long payload") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = [r for r in W.read_warc(W.archive_pages(df, min_revisit_bytes=2)).collect() if r.is_last]
    assert sorted(map(str, W.read_warc(W.write_warc(W.chunked_records(df, min_revisit_bytes=2))).select("page_id", "record_type", "refers_to", "payload_digest", "data").collect())) == sorted(
        str(tuple_) for tuple_ in W.read_warc(W.archive_pages(df, min_revisit_bytes=2)).select("page_id", "record_type", "refers_to", "payload_digest", "data").collect()
    )
    first = {"xy": 0, "long payload": 2}
    want = [(k, "response" if first.get(h, k) == k else "revisit", None if first.get(h, k) == k else first[h]) for k, _, h in rows]
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == want
    assert len({r.record_id for r in got}) == 40


def test_payloads_move_as_chunks(spark):
    """No payload in an aggregate, and none but chunks in a shuffle."""
    df, _ = pages(spark)
    records = W.chunked_records(df.repartition(3), chunk=1000)
    assert records.groupBy("record_id", "chunk_no").count().filter("count > 1").isEmpty() and records.filter("octet_length(data) > 1000").isEmpty()
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(payload" not in plan and "first(payload" not in plan


def test_segments_roll(spark):
    df, rows = pages(spark)
    archives = W.write_warc(W.chunked_records(df.coalesce(1)), segment=10)
    assert archives.count() >= 5
    assert W.read_warc(archives, with_data=False).filter("is_last").count() == len(rows)


def test_empty(spark):
    df, _ = pages(spark)
    assert W.read_warc(W.write_warc(W.chunked_records(df.filter("false")))).collect() == []


def test_damage_is_found(spark, tmp_path):
    df, _ = pages(spark)
    archives = W.write_warc(W.chunked_records(df.filter("page_id = 7").coalesce(1)))
    row = archives.first()
    path = f"{row.folder.removeprefix('file://')}/{row.name}"
    data = open(path, "rb").read()
    open(path, "wb").write(data[: len(data) - 12])
    with pytest.raises(Exception, match="ends inside|no end"):
        W.read_warc(archives).collect()
