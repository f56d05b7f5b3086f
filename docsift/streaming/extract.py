"""Extraction over streams: stages work within a row, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docsift.engine import Extractor


def extract_stream(stream: DataFrame, extractor: Extractor, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and json for each document of a stream; no state is kept."""
    return extractor.json(extractor.from_text(stream, text, keys), *keys)


def start(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append records to JSON text files, each input once, until the input at hand is done."""
    return records.select("json").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
