"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: About so many rows are numbered together, in one sort group.
ROWS_PER_BUCKET = 50_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score for the key is highest: -weight / ln(u), u from hash(key, shard).

    Each score depends on its own shard alone, so a new shard can only take keys to itself
    and a changed weight only moves keys to or from that shard. A null key is a key.
    Raises ValueError without shards or for a weight that isn't positive.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive, one per shard")
    scores = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(0x5EED), key, F.lit(shard)), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("n")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["n"]).cast("int")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 8, a null text counting none. slot: place in the
    shard, gapless from 0, by (bucket, doc_id, crc, size); repeated rows get slots of their
    own. No shard is sorted as a whole: rows are numbered within buckets of about
    ROWS_PER_BUCKET rows, and each bucket's offset comes from the buckets' counts. Null
    doc_ids form one key but spread over the buckets by their texts' checksums. An empty
    table gives no rows; other columns aren't read.
    """
    rows = docs.count()
    buckets = max(64, rows // (ROWS_PER_BUCKET * len(weights)) + 1)
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    key = F.col("doc_id")
    placed = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    placed = placed.select(
        "*",
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(buckets)).alias("bucket"),
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("rn", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("rn") + F.col("offset")).cast("long").alias("slot"), "grown_shard"
    )
