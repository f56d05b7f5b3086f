import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docsift.llm.sharding import rendezvous, shard_documents

SCHEMA = "doc_id long, text string, shard string, size string"


def test_contract_on_odd_rows(spark):
    rows = [(i, f"text {i}", "s", "z") for i in range(3000)] + [(5, "text 5", "s", "z"), (None, None, None, None), (None, "é", "", "")]
    found = shard_documents(spark.createDataFrame(rows, SCHEMA), [1.0] * 24, [1.0] * 25).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        if r["doc_id"] is not None:
            data = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 and r["law"] == "key"
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in found if r["doc_id"] == 5}) == 1
    sizes = Counter(r["shard"] for r in found)
    assert len(sizes) == 24 and max(sizes.values()) < 1.5 * len(rows) / 24
    moved = sum(r["grown_shard"] == 24 for r in found)
    assert 0.5 * len(rows) / 25 < moved < 1.6 * len(rows) / 25


def test_weights_and_empty_table(spark):
    counts = Counter(r[0] for r in spark.range(20000).select(rendezvous(F.col("id"), [1.0, 3.0])).collect())
    assert 0.22 < counts[0] / 20000 < 0.28
    assert shard_documents(spark.createDataFrame([], SCHEMA), [1.0] * 3).count() == 0
    with pytest.raises(ValueError):
        rendezvous(None, [])
    with pytest.raises(ValueError):
        rendezvous(None, [1.0, 0.0])
