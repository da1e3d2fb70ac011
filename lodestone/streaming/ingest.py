"""Pages that keep arriving: the same chunker on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.chunking import MAX_CHARS, OVERLAP, split_pages


def stream_chunks(pages: DataFrame, output: str, checkpoint: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, **trigger) -> StreamingQuery:
    """A streaming frame of pages (paper, page, text), chunked into Parquet, exactly once. Chunking keeps no state between pages;
    the indexes are rebuilt as a unit from what has been written."""
    chunks = split_pages(pages, max_chars, overlap)
    return chunks.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
