"""Papers into pages. Reading a PDF needs a parser, which the caller brings; everything after is Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.chunking import MAX_CHARS, OVERLAP, split_pages
from lodestone.sources.store import save_chunks

#: The bytes of a paper -> the text of its physical pages, in order.
PageReader = Callable[[bytes], list[str]]


def pdf_pages(content: bytes) -> list[str]:
    """A reader on top of pypdf or PyMuPDF, whichever is installed; ImportError if neither is."""
    try:
        import fitz
    except ImportError:
        import io

        from pypdf import PdfReader

        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    with fitz.open(stream=content, filetype="pdf") as document:
        return [p.get_text("text") for p in document]


def read_pages(spark: SparkSession, directory: str, reader: PageReader = pdf_pages, pattern: str = "*.pdf") -> DataFrame:
    """(paper, page, text) of all matching files; papers are file names, pages count from 1. One paper at a time is in memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no {pattern} in {directory}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for paper, content in zip(batch["paper"], batch["content"], strict=True):
                texts = reader(bytes(content))
                yield pd.DataFrame({"paper": paper, "page": range(1, len(texts) + 1), "text": texts})

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("paper"), "content")
    return named.mapInPandas(run, "paper string, page int, text string")


def ingest(spark: SparkSession, directory: str, output: str, reader: PageReader = pdf_pages, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Read, chunk and store a directory of papers; returns the chunks."""
    chunks = split_pages(read_pages(spark, directory, reader), max_chars, overlap).orderBy("paper", "page", "position")
    save_chunks(chunks, output)
    return chunks
