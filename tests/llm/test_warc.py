import gzip
import os
import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from kinetable.llm import warc

SCHEMA = "place long, record_id string, uri string, payload string, chunk int, digest string"
BIG = "é<p>\r\n" + "0123456789" * 40 + "\n\r\n\r\nWARC/1.1\r\n" + "x" * 700


def page(place, payload, uri="http://a/b c\r\nWARC-Type: no"):
    return (place, f"urn:page:{'' if place is None else place}", uri, payload, 7, "clash")


ROWS = [
    page(5, BIG), page(3, BIG), page(3, BIG), page(9, BIG), page(None, BIG), page(2, "short"), page(1, "short"), page(7, None),
    page(8, ""), page(10, "y" * 100), page(11, "y" * 100), page(12, "z" * 99), page(13, "z" * 99), page(14, "a" * 64), page(15, "b" * 128),
    page(16, "\n" * 300), page(17, "0\r\n\r\n" * 60, None), page(18, "日本" * 333), page(None, "n" * 300), page(None, "n" * 300),
]


def expected(rows):
    first = {}
    for place, _, _, payload, *_ in rows:
        if place is not None:
            first[payload] = min(place, first.get(payload, place))
    out = []
    for place, _, _, payload, *_ in rows:
        raw = (payload or "").encode()
        revisit = len(raw) >= 100 and first.get(payload) is not None and (place is None or place > first[payload])
        out.append((place, len(raw), sha256(raw).hexdigest(), "revisit" if revisit else "response", first[payload] if revisit else None))
    return sorted(out, key=repr)


def found(chunks):
    number = lambda c: F.nullif(F.replace(F.col(c), F.lit("urn:page:"), F.lit("")), F.lit("")).cast("long")
    rows = warc.records(chunks).select(number("record_id"), "payload_bytes", "digest", "record_type", number("refers_to"))
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("chunk", [900, 1 << 16])
def test_round_trip(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    path = f"{tmp_path}/w"
    warc.write(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path)
    assert found(warc.read(spark, path, data=False)) == expected(ROWS)
    chunks = warc.read(spark, path)
    assert found(chunks) == expected(ROWS)
    parts = chunks.select("file", "record_no", "chunk", "last", "data", "record_type", "digest", "uri").collect()
    whole, sums = {}, {}
    for r in sorted(parts, key=lambda r: (r.file, r.record_no, r.chunk)):
        assert len(r.data) <= warc.CHUNK and "\n" not in (r.uri or "")
        whole[r.file, r.record_no] = whole.get((r.file, r.record_no), b"") + bytes(r.data)
        if r.record_type == "response":  # the digest so far
            assert r.digest == sha256(whole[r.file, r.record_no]).hexdigest()
        sums[r.file, r.record_no] = r.record_type
    texts = sorted(v for k, v in whole.items() if sums[k] == "response")
    assert texts == sorted((r[3] or "").encode() for r, e in zip(sorted(ROWS, key=lambda r: repr(expected([r])[0][:3])), expected(ROWS), strict=True) if e[3] == "response")


def test_archives_are_valid_records(spark, tmp_path, monkeypatch):
    """A plain walk by Content-Length alone meets a record at every step and the end of the file."""
    monkeypatch.setattr(warc, "CHUNK", 700)
    path = f"{tmp_path}/w"
    warc.write(spark.createDataFrame(ROWS, SCHEMA).repartition(2), path)
    records = 0
    for name in os.listdir(path):
        if name.startswith("part-"):
            raw, at = gzip.open(f"{path}/{name}").read(), 0
            while at < len(raw):
                end = raw.index(b"\r\n\r\n", at) + 4
                lines = raw[at:end].decode().split("\r\n")
                assert lines[0] == "WARC/1.1"
                fields = dict(x.split(": ", 1) for x in lines[1:] if x)
                assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
                at = end + int(fields["Content-Length"])
                assert raw[at : at + 4] == b"\r\n\r\n"
                at, records = at + 4, records + 1
    assert records == len(ROWS)


def foreign(body, kind="response", coding="", head="HTTP/1.1 200 OK\r\n"):
    block = (head + coding + "\r\n").encode() + body if head else body
    media = "application/http; msgtype=response" if head else "text/plain"
    return (
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{len(body)}>\r\nContent-Type: {media}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        + block + b"\r\n\r\n"
    )


def test_archives_of_others(spark, tmp_path):
    """One gzip member a record, binary payloads, other kinds of records, any transfer chunks."""
    random.seed(1)
    binary = random.randbytes(200_000)
    sized = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(x), x) for x in (binary[:70_000], binary[70_000:70_001], binary[70_001:])) + b"0\r\nTrailer: x\r\n\r\n"
    records = [
        (foreign(b"software: x\r\n", "warcinfo", head=""), b"software: x\r\n"),
        (foreign(binary), binary),
        (foreign(sized, coding="Transfer-Encoding: chunked\r\n"), binary),
        (foreign(b"0\r\n\r\n", coding="Transfer-Encoding: chunked\r\n"), b""),
        (foreign(b""), b""),
    ]
    os.makedirs(f"{tmp_path}/w")
    with open(f"{tmp_path}/w/a.warc.gz", "wb") as out:
        for raw, _ in records:
            out.write(gzip.compress(raw))
    got = warc.records(warc.read(spark, f"{tmp_path}/w")).orderBy("record_no").collect()
    assert [(r.payload_bytes, r.digest) for r in got] == [(len(x), sha256(x).hexdigest()) for _, x in records]
    chunks = warc.read(spark, f"{tmp_path}/w").where("record_no = 2").orderBy("chunk").collect()
    assert b"".join(bytes(r.data) for r in chunks) == binary and max(len(r.data) for r in chunks) <= warc.CHUNK


@pytest.mark.parametrize("raw", [foreign(b"x" * 500)[:-100], b"no archive at all\r\n" * 10])
def test_broken_archives_raise(spark, tmp_path, raw):
    os.makedirs(f"{tmp_path}/w")
    with gzip.open(f"{tmp_path}/w/a.gz", "wb") as out:
        out.write(raw)
    with pytest.raises(Exception, match="breaks off|no record starts"):
        warc.read(spark, f"{tmp_path}/w").collect()


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/w")
    assert warc.read(spark, f"{tmp_path}/w").count() == 0


def test_revisits_that_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Chunks that are shuffled to meet the revisits stand together and in order again."""
    monkeypatch.setattr(warc, "CHUNK", 300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        warc.write(spark.createDataFrame(ROWS, SCHEMA).repartition(3), f"{tmp_path}/w")
        monkeypatch.setattr(warc, "CHUNK", 900)
        assert found(warc.read(spark, f"{tmp_path}/w")) == expected(ROWS)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
