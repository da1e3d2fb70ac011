"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.session import cut, drop

__all__ = ["WORD", "batches_of", "columns_of", "components", "cut", "drop", "give_back", "held", "in_order", "numbered", "packed", "per_batch", "shuffles", "table", "text_bytes"]

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def packed(docs: DataFrame, name: str) -> DataFrame:
    """Each row as one struct of that name, so that operators' own columns clash with none of its."""
    return docs.select(F.struct(*columns_of(docs)).alias(name))


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column, b'' for nulls."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def give_back() -> None:
    """Memory that is free in this process goes back to the system, which counts it as the executor's otherwise."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)  # glibc has it


#: What operators keep in this Python worker from task to task.
HELD: dict[str, dict] = {}


def held(owner: str | None) -> dict:
    """The owner's dict, kept from task to task. A worker serves all stages of an application, so those of other owners are emptied
    and their memory is given back to the system."""
    for name, own in HELD.items():
        if name != owner and own:
            own.clear()
            gc.collect()
            give_back()
    return HELD.setdefault(owner, {}) if owner else {}


def batches_of(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their column holds about limit bytes at most. owner: whose held() stay; what else a batch took is given back."""
    held(owner)
    for batch in batches:
        size = max(1, batch.column(column).nbytes)
        rows = max(1, batch.num_rows * limit // size)
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            if owner:
                give_back()


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Callable:
    """mapInArrow's function for one that takes a batch; a batch's column holds about limit bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, column, limit):
            yield fn(batch)

    return run


#: Bits of a place in in_order() that count the rows of one partition; the others number the partitions.
PLACE_BITS = 33


def in_order(df: DataFrame, order: list[Column], place: str = "_place") -> DataFrame:
    """The rows sorted by the keys, written once, with their place: a long that rises along the order, with gaps between partitions.

    Rows are dealt by ranges of the keys, and of rows with equal keys by where they came from, so that no key, however frequent,
    goes to one task. Rows of equal keys are in any order. The place is written with the row: a lost executor can't change it.
    """
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    keys = [*order, F.col("_salt")]
    return cut(salted.repartitionByRange(shuffles(df.sparkSession), *keys).sortWithinPartitions(*keys).drop("_salt").withColumn(place, F.monotonically_increasing_id()))


def numbered(df: DataFrame, order: list[Column], number: str) -> DataFrame:
    """The rows with their number (long, from 0, gapless) in the order of the keys. No task holds more than a partition; the partitions' counts
    (a row each) are summed up in one."""
    placed = in_order(df, order)
    part = F.shiftright("_place", PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    # as many rows as partitions
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(number, F.col("_before") + own).drop("_part", "_before", "_place")


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Connected components of undirected edges between longs: one row (node, component) per node of an edge.

    component is the smallest node that is reachable. Alternates the large-star and small-star steps until the edges no
    longer change: rounds grow with the logarithm of the longest path, each round's edges are written to the checkpoint
    folder and the round's before are deleted, and minima are combined before the shuffle, so a node with very many links is
    no hot key (the joins are plain shuffle joins whose skewed partitions AQE splits). Null ends are ignored; an edgeless input gives no rows.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"), F.col(u).alias("_u"), F.col(v).alias("_v"))
    e = cut(e.where("_u is not null and _v is not null and _u <> _v").select("a", "b").distinct())
    seen = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == seen:
            break
        seen = (now["n"], now["h"])
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the node of each minimum is named anew: the join then has a shuffle of its own on both sides, which AQE can split at a hot node
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not(F.bitwise_not("a")).alias("a"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        drop(old)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
