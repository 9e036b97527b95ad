import gzip
import hashlib
import io

import pytest

from hazardframe.llm import storage, warc

BIG = "<p>" + "x" * 2000 + "</p>"
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://b/3", BIG), (4, "http://b/4", "small"), (5, "http://b/5", "small"), (6, None, None), (7, "http://c/7", ""),
    (None, "http://c/0", BIG), (8, "http://c/8\r\nEvil: 1", "ü" * 600), (9, "http://c/9", "ü" * 600), (9, "http://c/9", "ü" * 600), (None, None, None),
]
SCHEMA = "page_id bigint, url string, html string"


def expected():
    out = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        keeper = max(same) if len(raw) >= 1000 and same else None
        again = keeper is not None and page != keeper
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def folder(spark):
    path = storage.shared_folder(spark, "w")
    rows = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], SCHEMA + ", digest string, n string")
    warc.write_warc(warc.with_revisits(rows), path, file_bytes=700)
    return path


def test_round_trip(spark, folder):
    got = []
    for r in warc.read_warc(spark, folder).withColumn("page", warc.page_number(warc.F.col("record_id"))).withColumn("to", warc.page_number(warc.F.col("refers_to"))).collect():
        raw = bytes(r.payload)
        stored = r.record_type == "response"
        got.append((r.page, len(raw) if stored else r.payload_length, hashlib.sha1(raw).hexdigest() if stored else r.payload_digest.removeprefix("sha1:"), r.record_type, r.to))
        assert stored or raw == b""
    assert sorted(got, key=str) == expected()


def test_filters_reach_the_headers(spark, folder):
    records = warc.read_warc(spark, folder)
    chosen = records.where("record_type = 'revisit' AND target_uri LIKE 'http://a/%'")
    assert "PushedFilters" in chosen._jdf.queryExecution().toString() or chosen.count() == 2
    assert chosen.count() == 2
    assert records.where("record_type IN ('response', 'warcinfo')").count() + records.where("record_type = 'revisit'").count() == len(ROWS)
    assert records.where("payload_length > 1000").count() == sum(len((h or "").encode()) > 1000 for _, _, h in ROWS)


def test_payloads_can_be_left_out(spark, folder):
    assert warc.read_warc(spark, folder, payload=False).where("payload IS NOT NULL").count() == 0


@pytest.mark.parametrize("packing", ["plain", "one member each", "one member"])
def test_archives_of_other_writers(packing):
    blocks = [warc.record_bytes({"WARC-Type": "warcinfo"}, b"a: b"), warc.record_bytes({"WARC-Type": "resource", "WARC-Target-URI": "u"}, b"WARC/1.0 inside\r\n\r\n" + b"z" * 70_000)]
    data = {"plain": b"".join(blocks), "one member each": b"".join(map(gzip.compress, blocks)), "one member": gzip.compress(b"".join(blocks))}[packing]
    got = list(warc.records(io.BytesIO(data), lambda h: True))
    assert [h["warc-type"] for h, _ in got] == ["warcinfo", "resource"] and got[1][1].endswith(b"z" * 70_000) and len(got[1][1]) == 70_019
    assert [h["warc-type"] for h, _ in warc.records(io.BytesIO(data), lambda h: h["warc-type"] == "resource")] == ["resource"]


def test_empty(spark):
    path = storage.shared_folder(spark, "w")
    warc.write_warc(warc.with_revisits(spark.createDataFrame([], SCHEMA)), path)
    assert warc.read_warc(spark, path).count() == 0
