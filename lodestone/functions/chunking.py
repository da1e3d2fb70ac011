"""Pages into overlapping chunks that never cross a page, with stable ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS, OVERLAP, ID_LENGTH = 1200, 150, 16
#: Pages that a worker holds as Python strings at a time.
STEP = 256


def windows(text: str, max_chars: int, overlap: int) -> Iterator[str]:
    """Greedy windows of a cleaned page. A window that doesn't reach the end stops at the last space of its second half."""
    if text and not 0 <= overlap < max_chars:
        raise ValueError(f"max_chars ({max_chars}) must exceed overlap ({overlap}), which must not be negative")
    size, begin = len(text), 0
    while begin < size:
        stop = begin + max_chars
        if stop < size:
            space = text.rfind(" ", begin + max_chars // 2, stop)
            stop = space if space > begin else stop
        piece = text[begin:stop].strip()
        if piece:
            yield piece
        if stop >= size:
            return
        begin = max(stop - overlap, begin + 1)
        begin += len(text[begin:stop]) - len(text[begin:stop].lstrip())


def chunk_id(paper: Column, page: Column, position: Column, text: Column) -> Column:
    zero = F.char(F.lit(0))
    return F.substring(F.sha1(F.concat(paper, zero, page.cast("string"), zero, position.cast("string"), zero, text)), 1, ID_LENGTH)


def split_pages(pages: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """pages (paper, page, text) -> (chunk_id, paper, page, position, text). The loop depends on the data at every step, so it
    runs over Arrow batches; ids stay in the JVM. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            row, position, text = [], [], []
            for i, page in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                # as clean_text(): both take the same characters for white space
                for k, piece in enumerate(windows(" ".join((page or b"").decode(errors="replace").split()), max_chars, overlap)):
                    row.append(i)
                    position.append(k)
                    text.append(piece)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("paper").take(at), batch.column("page").take(at), pa.array(position, pa.int32()), pa.array(text, pa.string())], names=["paper", "page", "position", "text"])

    given = pages.select(F.col("paper").cast("string"), F.col("page").cast("int"), F.col("text").cast("string"))
    kind = T.StructType([*given.schema.fields[:2], T.StructField("position", T.IntegerType()), T.StructField("text", T.StringType())])
    return given.mapInArrow(run, kind).select(chunk_id(F.col("paper"), F.col("page"), F.col("position"), F.col("text")).alias("chunk_id"), "paper", "page", "position", "text")
