"""Exact top-k search by integer inner product, with a KD-tree per shard.

Vectors become integers floor(scale * x). Rows are dealt into shards of about `shard_rows` (more, up to `most_rows`, where there
would be over `most_shards` shards: what is sent is queries x shards); each shard's tree splits at the
median of the widest dimension down to leaves of `leaf_rows`, with tight bounding boxes. It is built once and written as one
row of the index. Queries are packed into blocks of about `block_queries`, a row each. Every block meets every shard, as one
join, twice. First a shard scores each query's most promising leaf; the k-th best of these scores over all shards is a lower
bound of the k-th score of the answer and goes into the block. Then every shard traverses its tree best-first by the boxes'
upper bounds of the inner product, starting from that bound and raising it with its own k-th score, and stops where no box can
hold a better score or an equal one with a smaller id. The shards' lists meet in a top-k per query. Nothing is brought to the
driver but the number of rows by length of vector; a task holds one tree and one block at a time.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows with a null vec_id, take no part,
neither as queries nor as candidates; vectors of different lengths don't meet; a query's own row is no candidate, nor are
rows of its vec_id; rows of equal vec_id and embedding are candidates as often as they occur, queries once; a vec_id with
several different vectors asks with each of them, and its answer is the k best of all their pairs with candidates (a row that
several of them find counts for each); fewer candidates than k give fewer rows; scores are exact within 64 bits (larger ones
wrap, as Spark's long does without ANSI checks); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lodestone.llm.common import cut, drop, shuffles


class KdTree:
    """Nodes in breadth-first order; node i's children are kids[i] and kids[i] + 1 (-1: a leaf of rows start[i] : end[i])."""

    PARTS = ("ids", "x", "start", "end", "kids", "low", "high", "least")

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf_rows: int):
        order = np.arange(len(x))
        start, end, kids = [0], [len(x)], []
        at = 0
        while at < len(start):
            lo, hi = start[at], end[at]
            own = order[lo:hi]
            if hi - lo > leaf_rows:
                wide = int(np.argmax(x[own].max(axis=0) - x[own].min(axis=0)))
                middle = (hi - lo) // 2
                order[lo:hi] = own[np.argpartition(x[own, wide], middle)]
                kids.append(len(start))
                start += [lo, lo + middle]
                end += [lo + middle, hi]
            else:
                kids.append(-1)
            at += 1
        self.ids, self.x = ids[order], x[order]
        self.start, self.end, self.kids = start, end, kids
        self.low = np.stack([self.x[a:b].min(axis=0) for a, b in zip(start, end, strict=True)])
        self.high = np.stack([self.x[a:b].max(axis=0) for a, b in zip(start, end, strict=True)])
        self.least = np.array([self.ids[a:b].min() for a, b in zip(start, end, strict=True)])

    def written(self) -> bytes:
        return arrays_written(*(np.asarray(getattr(self, name)) for name in self.PARTS))

    @classmethod
    def read(cls, raw: bytes) -> KdTree:
        tree = cls.__new__(cls)
        for name, part in zip(cls.PARTS, arrays_read(raw), strict=True):
            setattr(tree, name, part.tolist() if part.ndim == 1 and name not in ("ids", "least") else part)
        return tree

    def fitting(self, q: np.ndarray) -> np.ndarray:
        """q as doubles if the inner products with all rows stay exact, else q and the tree as 64-bit integers."""
        if self.x.dtype != np.float64 or q.dtype != np.float64 or float(np.abs(self.x).max()) * float(np.abs(q).max()) * q.shape[1] >= 2**52:
            self.x, self.low, self.high, q = (v.astype(np.int64) for v in (self.x, self.low, self.high, q))
        return q

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product that a point of each node's box can have with each query."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def promising(self, ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """The k best scores in the leaf whose box allows the largest one, for each query."""
        leaves = np.flatnonzero(np.asarray(self.kids) < 0)
        best = leaves[self.bounds(q)[:, leaves].argmax(axis=1)]
        for i, leaf in enumerate(best.tolist()):
            a, b = self.start[leaf], self.end[leaf]
            scores = (self.x[a:b] @ q[i])[self.ids[a:b] != ids[i]]
            yield i, -np.sort(-scores)[:k]

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        """The k best (score, -id) of each query among those that reach its floor."""
        bounds = self.bounds(q)
        for i in range(len(q)):
            mine, least, found = bounds[i], float(floor[i]), []
            heap = [(-mine[0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if -bound < least:
                    break
                full = len(found) == k
                if full and -bound == found[0][0] and -self.least[node] <= found[0][1]:
                    continue
                kid = self.kids[node]
                if kid >= 0:
                    for c in (kid, kid + 1):
                        if mine[c] >= least:
                            heapq.heappush(heap, (-mine[c], c))
                    continue
                a, b = self.start[node], self.end[node]
                scores = self.x[a:b] @ q[i]
                keep = np.flatnonzero((scores >= least) & (self.ids[a:b] != ids[i]))
                for s, v in zip(scores[keep].tolist(), (-self.ids[a:b][keep]).tolist(), strict=True):
                    if len(found) < k:
                        heapq.heappush(found, (s, v))
                    elif (s, v) > found[0]:
                        heapq.heapreplace(found, (s, v))
                if len(found) == k:
                    least = max(least, found[0][0])
            yield i, sorted(found, reverse=True)


def arrays_written(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for x in arrays:
        np.save(out, x, allow_pickle=False)
    return out.getvalue()


def arrays_read(raw: bytes) -> list[np.ndarray]:
    file, out = io.BytesIO(raw), []
    while file.tell() < len(raw):
        out.append(np.load(file, allow_pickle=False))
    return out


def matrix(rows: pa.Array, dim: int) -> np.ndarray:
    """Integers as doubles where all inner products among such stay exact, else as 64-bit integers."""
    x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x.astype(np.float64) if not len(x) or float(np.abs(x).max()) ** 2 * dim < 2**52 else x


@dataclass(frozen=True)
class TopK:
    k: int = 5
    scale: int = 256
    #: Rows of a shard; from most_shards on shards grow to most_rows before there are more of them, as each query goes to every shard.
    shard_rows: int = 8192
    most_shards: int = 1024
    most_rows: int = 1 << 18
    leaf_rows: int = 256
    block_queries: int = 2048

    def integers(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, x array<long>) of the vectors that take part."""
        e = F.col("embedding")
        bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        whole = F.transform(e, lambda v: F.floor(F.lit(float(self.scale)) * v.cast("double")).cast("long"))
        return vectors.where(F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(e) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))

    def search(self, queries: DataFrame, vectors: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score): the k best vectors of each query. Both: columns vec_id, embedding."""
        rows = cut(self.integers(vectors).withColumn("dim", F.size("x")))
        asked = cut(self.integers(queries).withColumn("dim", F.size("x")).distinct())
        n = F.count("*")
        shards = F.greatest(F.least(F.ceil(n / self.shard_rows), F.lit(self.most_shards)), F.ceil(n / self.most_rows))
        sizes = rows.groupBy("dim").agg(shards.cast("int").alias("shards"))
        sizes = cut(sizes.join(asked.groupBy("dim").agg(F.ceil(F.count("*") / self.block_queries).cast("int").alias("blocks")), "dim"))  # lengths of vectors: usually one
        total = sizes.agg(F.coalesce(F.sum("shards"), F.lit(0)).alias("shards"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks")).first()
        # as many partitions as shards, up to a bound: rows are few, work per row is not
        spread = lambda n: max(shuffles(vectors.sparkSession), min(n, 4096))
        by_shard = spread(total["shards"])
        index = cut(self.index(rows.join(sizes.select("dim", "shards"), "dim"), by_shard))
        blocks = cut(self.blocks(asked.join(sizes, "dim"), spread(total["blocks"])))
        drop(rows, asked)
        k = self.k

        def first(ids: np.ndarray, q: np.ndarray, floor: np.ndarray, tree: KdTree, block: int) -> tuple:
            found = [(i, s) for i, scores in tree.promising(ids, q, k) for s in scores.tolist()]
            i, score = zip(*found, strict=True) if found else ((), ())
            return np.full(len(found), block), np.array(i, np.int64), np.array([int(s) for s in score], np.int64)

        place = F.row_number().over(W.partitionBy("dim", "block", "i").orderBy(F.col("score").desc()))
        kth = self.met(blocks.withColumn("floors", F.lit(None).cast("array<struct<i:long,score:long>>")), index, by_shard, first, "dim int, block long, i long, score long")
        kth = kth.withColumn("n", place).where(F.col("n") == k).groupBy("dim", "block").agg(F.collect_list(F.struct("i", "score")).alias("floors"))  # a row per query of a block

        def then(ids: np.ndarray, q: np.ndarray, floor: np.ndarray, tree: KdTree, block: int) -> tuple:
            found = [(ids[i], -v, int(s)) for i, best in tree.search(ids, q, k, floor) for s, v in best]
            return tuple(np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))

        out = self.met(blocks.join(kth, ["dim", "block"], "left"), index, by_shard, then, "dim int, query_id long, vec_id long, score long")
        best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return out.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

    def index(self, rows: DataFrame, partitions: int) -> DataFrame:
        """rows (vec_id, x, dim, shards) -> (dim, shard, tree), a row per shard."""
        leaf_rows = self.leaf_rows

        def build(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            dim, shard = (table.column(c)[0].as_py() for c in ("dim", "shard"))
            tree = KdTree(table.column("vec_id").to_numpy(), matrix(table.column("x").combine_chunks(), dim), leaf_rows)
            return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "tree": pa.array([tree.written()], pa.binary())})

        own = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), "shards").cast("int"))
        return own.select("dim", "shard", "vec_id", "x").repartition(partitions, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")

    def blocks(self, asked: DataFrame, partitions: int) -> DataFrame:
        """asked (vec_id, x, dim, shards, blocks) -> (dim, block, shards, queries), a row per block."""

        def pack(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            dim, block, shards = (table.column(c)[0].as_py() for c in ("dim", "block", "shards"))
            raw = arrays_written(table.column("vec_id").to_numpy(), matrix(table.column("x").combine_chunks(), dim))
            return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int64()), "shards": pa.array([shards], pa.int32()), "queries": pa.array([raw], pa.binary())})

        own = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), "blocks"))
        return own.select("dim", "block", "shards", "vec_id", "x").repartition(partitions, "dim", "block").groupBy("dim", "block").applyInArrow(pack, "dim int, block long, shards int, queries binary")

    def met(self, blocks: DataFrame, index: DataFrame, partitions: int, fn: Callable, schema: str) -> DataFrame:
        """What fn gives for each block (dim, block, shards, queries, floors) and each shard of its length of vectors, after a column dim."""
        names = [f.name for f in T.StructType.fromDDL(schema)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, tree = None, None
            for batch in batches:
                for row in range(batch.num_rows):
                    dim, shard, block, queries, floors, raw = (batch.column(c)[row] for c in ("dim", "shard", "block", "queries", "floors", "tree"))
                    if (dim.as_py(), shard.as_py()) != held:
                        held, tree = (dim.as_py(), shard.as_py()), KdTree.read(raw.as_buffer().to_pybytes())
                    ids, q = arrays_read(queries.as_buffer().to_pybytes())
                    q = tree.fitting(q)
                    floor = np.full(len(ids), -np.inf)
                    for f in floors.as_py() or ():
                        floor[f["i"]] = f["score"]
                    found = fn(ids, q, floor, tree, block.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), dim.as_py(), np.int32)), *(pa.array(c) for c in found)], names=names)

        sent = blocks.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "queries", "floors").repartition(partitions, "dim", "shard")
        # the trees' side is the one that a merge join holds: one row per key, however many blocks there are
        return sent.join(index.repartition(partitions, "dim", "shard").hint("merge"), ["dim", "shard"]).mapInArrow(run, schema)


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""
