"""Embedding near-dedup by product quantisation, without loss.

Vectors of equal components are one (with a count of copies). A coarse quantiser deals the others into inverted lists, and
subspace codebooks encode what remains of each vector beside its list's centre. A vector is compared with its own list and
probes every other list in which a partner can be: if x lies in the list of c and y in that of c', then y's distance to
the plane between c and c' is at most |x - y|, so lists whose plane is farther away than the largest distance that still
links are skipped, and no others. In a list, table lookups give the distance from a visitor to each member's code;
a pair is reranked by exact cosine unless that distance exceeds the linking distance by more than the member's own coding
error, which loses nothing (triangle inequality). Recall is 1 by construction; the tests measure it against brute force.

Codebooks are fitted on a sample of at most `sample` vectors, those of smallest hash; every vector is indexed. Lists are cut
into blocks of `block` members, and their visitors into chunks as large; each block meets each chunk in a task of its own, so
a list may hold any share of the vectors. A task returns, per vector, the number of its links and one edge to the smallest
vector of its group there; pairs are never emitted.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths don't link; a row with a null vec_id takes no part (0 links, null component, not
kept); rows of equal vec_id and embedding are copies, and links count rows; rows that share a vec_id only count as one
vector with all their links; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, cut
from lodestone.llm.simhash import merge


def units(rows: pa.Array, dim: int) -> np.ndarray:
    """Vectors of equal length as rows of doubles of length 1."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """At most k centres; equal start for equal input."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.square(x).sum(axis=1)[:, None] - 2 * (x @ c.T) + np.square(c).sum(axis=1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    """Coarse centres and residual codebooks, one per subspace."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int):
        self.centres = kmeans(sample, lists)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.books = [kmeans(rest[:, p], 256) for p in self.parts]
        gap = np.sqrt(squared(self.centres, self.centres))
        self.gap = np.where(gap > 0, gap, np.inf)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's list, codes and coding error."""
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        left = rest - np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], axis=1)
        return own, codes, np.sqrt(np.square(left).sum(axis=1))

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """For each vector and list: whether a vector of that list can be within reach. Lists after the own one only: partners look from their side."""
        d = squared(x, self.centres)
        beyond = (d - d[np.arange(len(x)), own][:, None]) / (2 * self.gap[own])
        return (beyond <= reach + 1e-9) & (np.arange(len(self.centres)) > own[:, None])

    def tables(self, rest: np.ndarray) -> list[np.ndarray]:
        """Per subspace, squared distances from each residual to each code."""
        return [squared(rest[:, p], b).astype(np.float32) for p, b in zip(self.parts, self.books, strict=True)]


@dataclass(frozen=True)
class NearVectors:
    cosine: float = 0.9
    sample: int = 8192
    subspaces: int = 8
    #: None: probe every list that can hold a partner. A number: probe as far as that many standard deviations of a random
    #: direction's share of the linking distance, which skips most lists of unclustered vectors and may lose links.
    sigmas: float | None = None
    list_rows: int = 2048
    max_lists: int = 1024
    block: int = 4096

    def links(self, vectors: DataFrame, dim: int, n: int) -> DataFrame:
        """(rep, degree, root) from tasks. vectors: distinct ones, columns rep, copies, embedding of length dim."""
        reach, cosine = math.sqrt(max(0.0, 2 - 2 * self.cosine)), self.cosine
        rows = vectors.select("embedding").orderBy(F.xxhash64("rep"), "rep").limit(self.sample).toArrow().column(0).combine_chunks()
        far = reach if self.sigmas is None else min(reach, self.sigmas * reach / math.sqrt(dim))
        quantiser = Quantiser(units(rows, dim), min(self.max_lists, max(1, n // self.list_rows)), self.subspaces)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = units(batch.column("embedding"), dim)
                own, codes, error = quantiser.assign(x)
                probes = [np.flatnonzero(p).tolist() for p in quantiser.probes(x, own, far)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))], names=[*batch.schema.names, "own", "code", "error", "probes"])

        kind = vectors.schema["embedding"].dataType.simpleString()
        known = cut(vectors.mapInArrow(assign, f"rep long, copies long, embedding {kind}, own long, code binary, error double, probes array<int>"))
        # numbers per list: at most max_lists rows
        blocks = {r["own"]: -(-r["n"] // self.block) for r in known.groupBy("own").agg(F.count("*").alias("n")).collect()}
        visits = {r["l"]: r["n"] for r in known.select(F.explode("probes").alias("l")).groupBy("l").agg(F.count("*").alias("n")).collect()}
        chunks = {c: max(1, -(-(visits.get(c, 0) + (b - 1) * self.block) // self.block)) for c, b in blocks.items()}
        spark = vectors.sparkSession
        sizes = F.broadcast(spark.createDataFrame([(int(c), int(b), int(chunks[c])) for c, b in blocks.items()] or [(-1, 1, 1)], "list long, blocks int, chunks int"))
        place = known.join(sizes, F.col("own") == F.col("list")).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
        homes = place.select("list", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("home"), "rep", "copies", "embedding", "code", "error")
        mine = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("chunks")).cast("int").alias("chunk")
        none = [F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error")]
        later = place.where("block < blocks - 1").select("list", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), mine, F.lit(False).alias("home"), "rep", "copies", "embedding", *none)
        away = known.select(F.explode(F.col("probes").cast("array<long>")).alias("list"), "rep", "copies", "embedding").join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), mine, F.lit(False).alias("home"), "rep", "copies", "embedding", *none)

        def compare(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            home = table.column("home").to_numpy(zero_copy_only=False)
            rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
            x = units(table.column("embedding").combine_chunks(), dim)
            members = np.flatnonzero(home)
            first = table.column("chunk")[0].as_py() == 0  # members meet one another once
            visitors = np.arange(len(home)) if first else np.flatnonzero(~home)
            degree, parent = np.zeros(len(home), np.int64), np.arange(len(home))
            codes = np.array([np.frombuffer(c, np.uint8) for c in table.column("code").filter(pa.array(home)).to_pylist()]).reshape(len(members), -1)
            bound = np.square(reach + table.column("error").filter(pa.array(home)).to_numpy() + 1e-6).astype(np.float32) + np.float32(1e-5)
            centre = quantiser.centres[table.column("list")[0].as_py()]
            order = np.argsort(rep, kind="stable")  # position in order of rep, so that roots are smallest reps
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            for at in range(0, len(visitors) if len(members) else 0, 256):
                who = visitors[at : at + 256]
                distance = np.zeros((len(who), len(members)), np.float32)
                for s, t in enumerate(quantiser.tables(x[who] - centre)):
                    distance += np.take(t, codes[:, s], axis=1)
                a, b = np.nonzero(distance <= bound)
                for i in range(0, len(a), 1 << 16):
                    p, q = who[a[i : i + (1 << 16)]], members[b[i : i + (1 << 16)]]
                    once = ~home[p] | (p < q)  # of two members each pair once
                    p, q = p[once], q[once]
                    near = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                    p, q = p[near], q[near]
                    np.add.at(degree, p, copies[q])
                    np.add.at(degree, q, copies[p])
                    parent = merge(parent, rank[p], rank[q])
            hit = np.flatnonzero(degree)
            return pa.table({"rep": rep[hit], "degree": degree[hit], "root": rep[order[parent[rank[hit]]]]})

        sent = homes.unionByName(later).unionByName(away)
        return sent.groupBy("list", "block", "chunk").applyInArrow(compare, "rep long, degree long, root long")


def near_duplicates(vectors: DataFrame, method: NearVectors = NearVectors()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    x = F.col("embedding")
    finite = ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True)) & F.exists(x, lambda v: v != 0)
    given = vectors.select("vec_id", "embedding", F.when(F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull(), F.xxhash64("embedding")).alias("h"))
    reps = cut(given.where("h is not null").groupBy("h", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "rep long, degree long, root long")
    for r in reps.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect():  # lengths of vectors: usually one
        own = reps.where(F.size("embedding") == r["dim"]).select(F.col("rep").cast("long"), "copies", "embedding")
        found = found.union(method.links(own, r["dim"], r["n"]))
    found = cut(found)
    parts = components(found, "rep", "root")
    degree = found.groupBy("rep").agg(F.sum("degree").alias("degree"))
    named = reps.join(degree, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left").select("h", "embedding", "copies", "degree", F.coalesce("component", "rep").alias("root"))
    named = named.select(F.col("h").alias("_h"), F.col("embedding").alias("_e"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), "root")
    out = given.join(named, (F.col("h") == F.col("_h")) & (F.col("embedding") == F.col("_e")), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS ok FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, min(reach.b) AS component_id, v.vec_id = min(reach.b) AS kept
FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id
"""
