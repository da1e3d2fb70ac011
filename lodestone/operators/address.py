"""Rows by address: tables whose rows lie in blocks, and blocks in folders, so that a look-up reads the folders and row groups of its results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut

#: Chunks in one block.
BLOCK_CHUNKS = 4096
#: Blocks whose rows share a folder of a stored table.
SPAN = 1024
#: Look-ups for results in at most so many blocks name them; others are plain joins.
MOST_ADDRESSES = 10_000
#: Tables of fewer blocks are read whole: finding the addresses would take longer.
SMALL = 16


def block_of(chunk_id: Column, blocks: int) -> Column:
    """Where a chunk is: known from its id and the number of blocks alone."""
    return F.pmod(F.xxhash64(chunk_id), F.lit(blocks))


def span_of(block: Column) -> Column:
    return F.floor(block / SPAN).cast("int")


def number_of_blocks(chunks: int) -> int:
    return max(1, -(-chunks // BLOCK_CHUNKS))


def look_up(wanted: DataFrame, table: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """wanted (block, ...) joined with table (span, block, ...) by keys, which include block. Where wanted lies in few of many blocks, only their folders
    and row groups are read; wanted is then written once, for it names the blocks."""
    if blocks < SMALL:
        return wanted.join(table.drop("span"), keys)
    wanted = cut(wanted)
    named = [r["block"] for r in wanted.select("block").distinct().limit(MOST_ADDRESSES + 1).collect()]
    if len(named) <= MOST_ADDRESSES:
        table = table.where(F.col("span").isin(sorted({b // SPAN for b in named})) & F.col("block").isin(named))
    return wanted.join(table.drop("span"), keys)
