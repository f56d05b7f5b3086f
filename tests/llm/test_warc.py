import io

import pytest
from pyspark.sql import functions as F

from docsift.llm import warc

SCHEMA = "page_id long, url string, html string, kept string"


def test_round_trip_of_every_case(spark):
    long = "é<p>" * 9000
    rows = [
        (1, "http://a", "same", "x"), (7, "http://b", "same", "x"), (3, None, "same", "x"),
        (4, "http://c\r\nX: y", None, None), (5, "u", "", None), (6, "u", long, ""), (8, "u", "one", ""),
        (9, "u", "twice", ""), (9, "u", "twice", ""), (None, "u", "same", ""), (None, "u", "null id", ""),
    ]
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and all(r["intact"] for r in found)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in found)
    size = lambda t: len((t or "").encode())
    response = {1: 7, 3: 7, 4: 5, 7: 7, 5: 5}
    expected = []
    for page, _, html, _ in rows:
        kept = 7 if html == "same" else response.get(page, page)
        revisit = kept is not None and kept != page
        expected.append((page or 0, "revisit" if revisit else "response", kept if revisit else None, size(html), warc.digest((html or "").encode())))
    assert got == sorted(expected)
    whole = {r["page_id"]: r["payload"] for r in found if r["record_type"] == "response"}
    assert bytes(whole[6]).decode() == long


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segments_in_any_order_and_missing_ones(spark):
    page = warc.Page(1, "u", bytes(range(256)) * 200, None)
    data = b"".join(warc.records_of(page, 1000))
    records = [
        (h.get("warc-segment-origin-id", h["warc-record-id"]), int(h.get("warc-segment-number", 0)), int(t) if (t := h.get("warc-segment-total-length")) else None, h, b)
        for h, b in warc.read_records(io.BytesIO(data))
    ]
    assert len(records) > 50
    whole = warc.payloads(warc.reassemble(spark.createDataFrame(records[::-1], warc.READ_SCHEMA))).collect()
    assert len(whole) == 1 and whole[0]["intact"] and bytes(whole[0]["payload"]) == page.payload
    cut = warc.payloads(warc.reassemble(spark.createDataFrame(records[:5] + records[6:], warc.READ_SCHEMA))).collect()
    assert not cut[0]["intact"]
    headless = warc.reassemble(spark.createDataFrame(records[1:], warc.READ_SCHEMA))
    assert headless.where(~F.col("complete")).count() == 1


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 100_000])
def test_chunked_framing(size):
    payload = bytes(i * 7 % 251 for i in range(size))
    assert warc.dechunked(warc.chunked(payload)) == payload


def test_chunk_extensions_and_damage():
    assert warc.dechunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")
