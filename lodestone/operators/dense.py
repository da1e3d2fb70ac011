"""Dense retrieval: inner products, best of each partition first; over all vectors, or exactly over the cells of an index that can matter."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.ranking import best_first, top_k
from lodestone.session import cut, shuffles

#: Queries are sent to the vectors in blocks of so many (2,048 x 384 floats: 3 MB).
BLOCK = 2048
#: Vectors that a task scores at a time: with a block of queries 16 MB of scores.
STEP = 1024


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def stepped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, STEP) for batch in batches for i in range(0, batch.num_rows, STEP))


class Floors:
    """What a task knows of each query's k-th best score: the greatest k-th best of what it has scored. Scores below it by more than rounding can make up aren't among the k best."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.copy(), k

    def kept(self, scores: np.ndarray, own: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of the queries own) and columns of the scores that are positive and may be among the k best, ties at 9 decimals included."""
        floor = self.floor[own]
        row, at = np.nonzero((scores > 0) & (scores >= floor[:, None]))
        n = np.bincount(row, minlength=len(scores))
        full = np.flatnonzero(n >= self.k)  # only these can raise their floor or lose any
        if len(full):
            least = np.full(len(scores), -np.inf)
            least[full] = np.partition(np.round(scores[full], 9), -self.k, axis=1)[:, -self.k]
            self.floor[own] = np.maximum(floor, least - SLACK)
            keep = np.round(scores[row, at], 9) >= least[row]
            row, at = row[keep], at[keep]
        return row, at


def candidates(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(q, id, score): for each query vector (q, embedding) each partition's k best vectors (id, embedding) of positive score."""
    kind = T.StructType([T.StructField("q", queries.schema["q"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "embedding").toArrow().combine_chunks()
        if not len(own):
            continue
        names, width = own.column("q").combine_chunks(), len(own.column("embedding")[0])
        asked = matrix(own.column("embedding").combine_chunks(), width)

        def run(batches: Iterator[pa.RecordBatch], names=names, width=width, asked=asked) -> Iterator[pa.RecordBatch]:
            floors = Floors(np.zeros(len(asked)), k)
            for batch in stepped(batches):
                given = batch.column("embedding")
                if pa.compute.any(pa.compute.not_equal(pa.compute.list_value_length(given), width)).as_py():
                    raise ValueError("query and index vectors differ in length")
                scores = asked @ matrix(given, width).T
                q, i = floors.kept(scores)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column("id").take(pa.array(i)), pa.array(scores[q, i])], names=["q", "id", "score"])

        part = vectors.select("id", "embedding").mapInArrow(run, kind)
        out = part if out is None else out.union(part)
    return out if out is not None else queries.sparkSession.createDataFrame([], kind)


def search_many(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """One ranking per query vector. queries (qid, embedding), vectors (id, embedding) -> (qid, rank, id, score)."""
    found = candidates(queries.select(F.col("qid").alias("q"), "embedding"), vectors, k)
    return top_k(found, ["q"], [best_first(), F.col("id")], k).select(F.col("q").alias("qid"), "rank", "id", "score")


def search_max(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """One ranking per qid by a vector's best score over the qid's queries (qid, query_no, embedding)."""
    found = candidates(queries.select(F.struct("qid", "query_no").alias("q"), "embedding"), vectors, k)
    best = found.groupBy(F.col("q.qid").alias("qid"), "id").agg(F.max("score").alias("score"))
    return top_k(best, ["qid"], [best_first(), F.col("id")], k).select("qid", "rank", "id", "score")


#: An index has at most so many cells, which is what a search holds of it on the driver (1,024 x 384 doubles: 3 MB).
MOST_CELLS = 1024
#: Vectors per cell that an index aims at, at least.
CELL_ROWS = 1024
#: Cells' centres are found on so many vectors per cell at most, the smallest by a hash of their ids.
SAMPLE_ROWS = 64
#: Rows of a cell in one stored file.
FILE_ROWS = 262_144
#: Scores that differ by less may be equal at the decimals that are compared.
SLACK = 2e-9


def centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """k-means on a sample, from evenly spaced rows of it."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(np.int64)]
    for _ in range(rounds):
        own = nearest(sample, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)


@dataclass(frozen=True)
class DenseIndex:
    """vectors(cell, id, embedding) in cells; cells(cell, n, radius, centre): no vector of a cell is farther from its centre than the radius.

    The inner product of a query q and a vector of a cell is at most q.centre + |q| radius. A search compares each query with the cells of the
    greatest bounds until they hold k vectors; the k-th score is a floor, and only cells whose bound reaches it are compared after
    that. So the result is that of a scan over all vectors. Cells that no query needs are folders that aren't read. How much that saves
    depends on how clustered the vectors are: compared() tells.
    """

    vectors: DataFrame
    cells: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, cells: int | None = None) -> DenseIndex:
        """vectors (id, embedding), all of one length. Centres come from a bounded sample, cells and radii from all vectors."""
        vectors = cut(vectors.select("id", "embedding"))
        size = vectors.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
        if size["least"] != size["most"]:
            raise ValueError("dense index holds vectors of several lengths")
        width, n = size["most"], size["n"]
        cells = min(cells or math.isqrt(n), MOST_CELLS, max(1, n // CELL_ROWS) if cells is None else n)
        kind = T.StructType([T.StructField("cell", T.IntegerType()), vectors.schema["id"], vectors.schema["embedding"], T.StructField("distance", T.DoubleType())])
        if not n:
            placed, centre = vectors.sparkSession.createDataFrame([], kind), np.zeros((0, 0))
        else:
            sample = vectors.select("embedding", F.xxhash64("id").alias("h")).orderBy("h", "embedding").limit(SAMPLE_ROWS * cells).select("embedding").toArrow().combine_chunks()
            centre = centres(matrix(sample.column("embedding").combine_chunks(), width), cells)

            def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        x = matrix(batch.column("embedding"), width)
                        own = nearest(x, centre)
                        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("id"), batch.column("embedding"), pa.array(np.linalg.norm(x - centre[own], axis=1))], names=["cell", "id", "embedding", "distance"])

            placed = cut(vectors.mapInArrow(place, kind))
        told = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centre)], "cell int, centre array<double>")
        # the margin is for sums of another order
        found = placed.groupBy("cell").agg(F.count("*").alias("n"), (F.max("distance") * (1 + 1e-9) + 1e-12).alias("radius")).join(told, "cell")
        return cls(placed.drop("distance"), cut(found.select("cell", "n", "radius", "centre")))

    def spread(self) -> DataFrame:
        """vectors as they are written: by cell, large cells in several files."""
        files = self.cells.select("cell", F.ceil(F.col("n") / FILE_ROWS).alias("files"))
        salted = self.vectors.join(F.broadcast(files), "cell")  # MOST_CELLS at most
        return salted.repartition(shuffles(self.cells.sparkSession), "cell", F.pmod(F.xxhash64("id"), F.col("files"))).drop("files")

    def search_many(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """queries (qid, embedding) -> (qid, rank, id, score), as dense.search_many() over all vectors."""
        found, _ = self.candidates(queries.select(F.col("qid").alias("q"), "embedding"), k)
        return top_k(found, ["q"], [best_first(), F.col("id")], k).select(F.col("q").alias("qid"), "rank", "id", "score")

    def search_max(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """queries (qid, query_no, embedding) -> (qid, rank, id, score), as dense.search_max() over all vectors."""
        found, _ = self.candidates(queries.select(F.struct("qid", "query_no").alias("q"), "embedding"), k)
        best = found.groupBy(F.col("q.qid").alias("qid"), "id").agg(F.max("score").alias("score"))
        return top_k(best, ["qid"], [best_first(), F.col("id")], k).select("qid", "rank", "id", "score")

    def compared(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """queries (qid, embedding) -> (qid, compared, vectors): with how many of the vectors a search compares each query."""
        return self.candidates(queries.select(F.col("qid").alias("q"), "embedding"), k)[1].withColumnRenamed("q", "qid")

    def candidates(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(q, id, score): the k best vectors of positive score per query, and more; and (q, compared, vectors)."""
        spark = queries.sparkSession
        name = T.StructField("q", queries.schema["q"].dataType)
        kind = T.StructType([name, self.vectors.schema["id"], T.StructField("score", T.DoubleType())])
        counts = T.StructType([name, T.StructField("compared", T.LongType()), T.StructField("vectors", T.LongType())])
        cells = self.cells.orderBy("cell").toArrow().combine_chunks()  # MOST_CELLS at most
        found, told = spark.createDataFrame([], kind), spark.createDataFrame([], counts)
        queries = cut(queries)
        blocks = max(1, -(-queries.count() // BLOCK))
        for b in range(blocks if len(cells) else 0):
            own = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "embedding").toArrow().combine_chunks()
            if len(own):
                part, compared = self.block(own, cells, k, kind)
                found = found.union(part)
                told = told.union(spark.createDataFrame(pa.table({"q": own.column("q"), "compared": pa.array(compared), "vectors": pa.array(np.full(len(own), sum(cells.column("n").to_pylist())))}), counts))
        return found, told

    def block(self, own: pa.Table, cells: pa.Table, k: int, kind: T.StructType) -> tuple[DataFrame, np.ndarray]:
        centre = matrix(cells.column("centre").combine_chunks(), len(cells.column("centre")[0]))
        width = centre.shape[1]
        if pa.compute.any(pa.compute.not_equal(pa.compute.list_value_length(own.column("embedding")), width)).as_py():
            raise ValueError("query and index vectors differ in length")
        names, asked = own.column("q").combine_chunks(), matrix(own.column("embedding").combine_chunks(), width)
        n, radius = cells.column("n").to_numpy(), cells.column("radius").to_numpy()
        bound = asked @ centre.T + np.linalg.norm(asked, axis=1)[:, None] * radius + SLACK
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        first &= bound > 0
        one = self.scan(cells.column("cell").to_numpy(), first, names, asked, np.zeros(len(asked)), k, kind)
        if (first | (bound <= 0)).all():
            return one, first @ n
        one = cut(one)
        place = {q: i for i, q in enumerate(map(repr, names.to_pylist()))}
        floor = np.zeros(len(asked))
        for r in top_k(one, ["q"], [F.col("score").desc()], k).where(F.col("rank") == k).select("q", "score").toArrow().to_pylist():  # a row per query of the block
            floor[place[repr(r["q"])]] = r["score"] - SLACK
        then = (bound >= floor[:, None]) & (bound > 0) & ~first
        return one.union(self.scan(cells.column("cell").to_numpy(), then, names, asked, floor, k, kind)), (first | then) @ n

    def scan(self, cell: np.ndarray, wanted: np.ndarray, names: pa.Array, asked: np.ndarray, floor: np.ndarray, k: int, kind: T.StructType) -> DataFrame:
        """(q, id, score): of each query and the cells that it wants, a batch's k best of positive score that reach its floor, and ties."""
        some = wanted.any(axis=0)
        queries = {int(c): np.flatnonzero(wanted[:, i]) for i, c in enumerate(cell) if some[i]}
        width = asked.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floors = Floors(floor, k)
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                for c in np.unique(cells).tolist():
                    rows, q = np.flatnonzero(cells == c), queries[c]
                    for part in stepped([batch.take(pa.array(rows)) if len(rows) < batch.num_rows else batch]):
                        scores = asked[q] @ matrix(part.column("embedding"), width).T
                        i, at = floors.kept(scores, q)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q[i])), part.column("id").take(pa.array(at)), pa.array(scores[i, at])], names=["q", "id", "score"])

        return self.vectors.where(F.col("cell").isin(list(queries))).select("cell", "id", "embedding").mapInArrow(run, kind)


def normalised(vectors: DataFrame) -> DataFrame:
    """vectors with embedding scaled to length 1, as floats; zero vectors stay."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return vectors.withColumn("_norm", norm).withColumn("embedding", F.transform("embedding", lambda v: F.when(F.col("_norm") > 0, v / F.col("_norm")).otherwise(v).cast("float"))).drop("_norm")


def checked(vectors: DataFrame, chunks: int) -> DataFrame:
    """vectors, if there is one per chunk and all have one length; else ValueError."""
    r = vectors.agg(F.count("*").alias("n"), F.countDistinct(F.size("embedding")).alias("widths")).first()
    if r["n"] != chunks:
        raise ValueError(f"dense index holds {r['n']} vectors for {chunks} chunks")
    if r["widths"] > 1:
        raise ValueError("dense index holds vectors of several lengths")
    return vectors
