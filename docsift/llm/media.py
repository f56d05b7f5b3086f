"""Media columns: payloads stored as lossless WebP, decoded to pixel arrays and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm import webp
from docsift.llm.shared import materialize
from docsift.llm.tokens import slices

ROW = webp.WIDTH


def padded(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of ROW."""
    return data + bytes(-len(data) % ROW if data else ROW)


def feature_of(pixels: np.ndarray) -> str:
    """64 bits as hex: which cells of an 8 x 8 grid are lighter than the whole image's mean.

    Images of fewer than 8 rows have fewer bands of cells; these count as not lighter.
    """
    rows = len(pixels)
    bands = np.unique(np.arange(8) * rows // 8)
    sums = np.add.reduceat(pixels.reshape(rows, 8, ROW // 8).sum(2, dtype="i8"), bands)
    sizes = np.diff([*bands, rows]) * (ROW // 8)
    light = sums * (rows * ROW) > int(sums.sum()) * sizes[:, None]
    bits = np.zeros((8, 8), bool)
    bits[: len(light)] = light
    return np.packbits(bits).tobytes().hex()


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes, padded, as lossless WebP files.

    A null text is empty. A text of over 1 MiB is several files in a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices([batch], limit=1 << 20):
                texts = [(t or "").encode() for t in some.column("text").to_pylist()]
                media = [webp.encode_payload(padded(t)) for t in texts]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.record_batch([some.column("doc_id"), sizes, pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, with_pixels: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error(, pixels).

    Everything but n_bytes comes from the decoded pixels or the stored bytes. Damaged or null
    media give an error and null values and don't end the job. pixels: the rows of ROW
    samples as one binary.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error", "pixels"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string, pixels binary"
    if not with_pixels:
        names, kinds, schema = names[:-1], kinds[:-1], schema.rpartition(",")[0]

    def describe(stored: bytes | None) -> tuple:
        stored = stored or b""
        about = (len(stored), hashlib.sha256(stored).hexdigest())
        try:
            pixels = webp.decode_payload(stored)
        except webp.Damaged as why:
            return (None, None, None, *about, None, str(why), None)
        data = pixels.tobytes()
        return (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), *about, feature_of(pixels), None, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices([batch], column="media", limit=1 << 20):
                rows = [describe(m)[: len(names)] for m in some.column("media").to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch([some.column("doc_id"), some.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, {schema}")


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text in a written media table and decode what that holds: see ``decode_media``.

    Rows are independent: repeated rows give equal values, an empty table gives no rows,
    null doc_ids are kept and other columns aren't read.
    """
    return decode_media(materialize(store_texts(docs), "media"))
