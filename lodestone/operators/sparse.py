"""Sparse retrieval: Okapi BM25 over postings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lodestone.functions.text import flat_bytes, token_lists, tokens
from lodestone.operators.address import MOST_ADDRESSES, SPAN, block_of, look_up, number_of_blocks, span_of
from lodestone.operators.ranking import best_first, top_k
from lodestone.schema import ORDER
from lodestone.session import cut, shuffles, stored

#: Postings are stored in folders by this many values of a hash of the term: a search reads those of its terms.
BUCKETS = 256
#: Of a term's impacts in a block the greatest so many are stored beside its hits.
TOPS = 20
#: From so many blocks on, bounds are worked out first and only the blocks that can hold a result are scored.
PRUNED_BLOCKS = 64
#: Queries go to the postings in blocks of about so many queries and weighted terms at most.
BLOCK_QUERIES, BLOCK_TERMS = 256, 30_000
#: Terms of at least so many queries of a block are scored by a matrix product, the others one by one.
COMMON = 8
#: Chunks scored at a time.
STEP = 512
#: Chunks whose texts are cut into words at a time, and rows of postings that are unpacked at a time.
TEXTS, ROWS = 1024, 256
#: Bytes of a posting: slot, tf and dl as 32-bit numbers.
HIT = 12


@dataclass(frozen=True)
class Okapi:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def impact(tf: np.ndarray, dl: np.ndarray, okapi: Okapi, average: float) -> np.ndarray:
    return tf * (okapi.k1 + 1) / (tf + okapi.k1 * (1 - okapi.b + okapi.b * dl / average))


def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (..., text) to (..., words, dl): the words joined by spaces, and their number."""
    for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
        words = token_lists(batch.column("text"))
        own = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*own, pc.binary_join(words, " "), pc.list_value_length(words)], names=[*(c for c in batch.schema.names if c != "text"), "words", "dl"])


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hits (term, tops) to (term, impact)."""
    for batch in batches:
        data, ends = flat_bytes(batch.column("tops"))
        row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends) // 8))
        yield pa.RecordBatch.from_arrays([batch.column("term").take(row), pa.array(data.view("<f8"))], names=["term", "impact"])


def unpacked(hits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many postings each row packs, and all of them (slot, tf, dl)."""
    data, ends = flat_bytes(hits)
    return np.diff(ends) // HIT, data.view("<i4").reshape(-1, 3)


def unpacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hits (term, block, hits) to (term, block, slot, tf)."""
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        n, hit = unpacked(batch.column("hits"))
        row = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([batch.column("term").take(row), batch.column("block").take(row), pa.array(hit[:, 0]), pa.array(hit[:, 1].astype(np.int64))], names=["term", "block", "slot", "tf"])


def inverter(okapi: Okapi, average: float) -> Callable[[pa.Table], pa.Table]:
    def invert(table: pa.Table) -> pa.Table:
        """applyInArrow on a block of chunks (block, slot, dl, words): a row (block, term, n, peak, tops, hits) per term."""
        block = table.column("block")[0].as_py()
        table = table.filter(pc.greater(table.column("dl"), 0)).combine_chunks()
        words = pc.split_pattern(table.column("words"), " ").combine_chunks()
        coded = pc.dictionary_encode(words.flatten())
        terms = len(coded.dictionary)
        row = np.repeat(np.arange(table.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        cell, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * table.num_rows + row, return_counts=True)
        term, row = np.divmod(cell, table.num_rows)
        ends = np.searchsorted(term, np.arange(terms + 1))
        slot, dl = (table.column(c).to_numpy()[row].astype(np.int32) for c in ("slot", "dl"))
        n = np.diff(ends).astype(np.int32)
        hits = binaries(np.stack([slot, tf, dl], axis=1).astype("<i4"), HIT * n)
        gain = impact(tf, dl, okapi, average)
        order = np.lexsort((-gain, term))  # a term's impacts stay at its places, the greatest first
        top = order[np.arange(len(order)) - ends[term] < TOPS]
        tops = binaries(gain[top].astype("<f8"), 8 * np.minimum(n, TOPS))
        return pa.table({"block": pa.array(np.full(terms, block, np.int64)), "term": coded.dictionary, "n": pa.array(n), "peak": pa.array(gain[order[ends[:-1]]]), "tops": tops, "hits": hits})

    return invert


@dataclass(frozen=True)
class SparseIndex:
    """lengths(span, block, slot, chunk_id, paper, page, position, dl): chunks by blocks, and their places there;
    hits(bucket, span, term, block, n, peak, tops, hits): the n postings, a row per term and block, packed (slot, tf, dl), the greatest
    impact and, packed, the greatest ones among them; terms(term, df, idf); corpus: one row (n, avgdl).

    A search takes a bounded block of weighted queries. It reads the buckets of its terms, and of these the rows of its terms;
    they are shuffled by block of chunks, compact as they are, and a task scores a block of chunks against all queries at once.
    It passes on only its best chunks of each query, so what is shuffled then doesn't grow with the terms that queries and
    chunks share. The chunks of the results are looked up by their blocks.

    An index of many blocks is first read without its hits. A term's k-th greatest impact, times its weight, is a score that k chunks
    reach by this term alone; the greatest of a query's terms is its floor. A block's greatest impacts, times their weights, add up to a bound
    of all its scores. Blocks whose bound is below the floor aren't scored for the query, and those that no query needs aren't read: common terms then
    cost no more than the blocks that a rarer one leaves.
    """

    lengths: DataFrame
    hits: DataFrame
    terms: DataFrame
    corpus: DataFrame
    okapi: Okapi = Okapi()

    @classmethod
    def build(cls, chunks: DataFrame, okapi: Okapi = Okapi()) -> SparseIndex:
        """Chunks are tokenised once; tokens and postings are written to the checkpoint folder."""
        texts = chunks.select("chunk_id", *ORDER, "text")
        words = stored(texts.mapInArrow(worded, T.StructType([*texts.schema.fields[:-1], T.StructField("words", T.StringType()), T.StructField("dl", T.IntegerType())])))
        size = words.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))
        n, average = size.first()
        place = (F.row_number().over(W.partitionBy("block").orderBy("chunk_id", *ORDER)) - 1).cast("int")
        spread = words.withColumn("block", block_of(F.col("chunk_id"), number_of_blocks(n))).repartition(shuffles(chunks.sparkSession), "block")
        placed = spread.withColumn("slot", place)
        inverted = placed.select("block", "slot", "dl", "words").groupBy("block").applyInArrow(inverter(okapi, average), "block long, term string, n int, peak double, tops binary, hits binary")
        hits = stored(inverted.select(bucket_of(F.col("term")).alias("bucket"), span_of(F.col("block")).alias("span"), "term", "block", "n", "peak", "tops", "hits"))
        lengths = placed.select(span_of(F.col("block")).alias("span"), "block", "slot", "chunk_id", *ORDER, "dl")
        corpus = chunks.sparkSession.createDataFrame([(n, average)], size.schema)
        return cls(lengths, hits, cut(weigh(hits, corpus, okapi)), corpus, okapi)

    @property
    def postings(self) -> DataFrame:
        """(term, chunk_id, tf)"""
        flat = self.hits.select("term", "block", "hits").mapInArrow(unpacking, "term string, block long, slot int, tf long")
        return flat.join(self.lengths.select("block", "slot", "chunk_id"), ["block", "slot"]).select("term", "chunk_id", "tf")

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """queries (qid, text) -> (qid, rank, chunk_id, score): the k best chunks of positive score per query."""
        found = self.candidates(queries.select(F.col("qid").alias("q"), "text"), k)
        return top_k(found, ["q"], [best_first(), *map(F.col, ORDER)], k).select(F.col("q").alias("qid"), "rank", "chunk_id", "score")

    def search_max(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """queries (qid, query_no, text), several per qid -> (qid, rank, chunk_id, score): a chunk's score is its best query's.
        A chunk among the k best of all is among the k best of the query that it scores best for."""
        found = self.candidates(queries.select(F.struct("qid", "query_no").alias("q"), "text"), k)
        best = found.groupBy(F.col("q.qid").alias("qid"), "chunk_id", *ORDER).agg(F.max("score").alias("score"))
        return top_k(best, ["qid"], [best_first(), *map(F.col, ORDER)], k).select("qid", "rank", "chunk_id", "score")

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """(q, chunk_id, paper, page, position, score): the k best chunks of positive score per query (q, text), more where
        scores tie. A repeated query word counts repeatedly."""
        asked = queries.select("q", F.explode(tokens(F.col("text"))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
        weighted = cut(asked.join(self.terms, "term").select("q", "term", (F.col("times") * F.col("idf")).alias("weight")).groupBy("q").agg(F.collect_list(F.struct("term", "weight")).alias("terms")))
        size = weighted.agg(F.count("*").alias("queries"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
        blocks = max(1, -(-size["queries"] // BLOCK_QUERIES), -(-size["terms"] // BLOCK_TERMS))
        spark = queries.sparkSession
        kind = T.StructType([T.StructField("q", queries.schema["q"].dataType), T.StructField("block", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("score", T.DoubleType())])
        corpus = self.corpus.first() if size["queries"] else None
        out = spark.createDataFrame([], kind)
        for b in range(blocks if size["queries"] else 0):
            own = weighted.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
            rows = own.toArrow().combine_chunks()
            if len(rows):
                scorer = Scorer(rows.column("q").combine_chunks(), rows.column("terms").to_pylist(), k, self.okapi, corpus["avgdl"])
                # a bound is none where a weight is negative, which only happens in tiny collections
                pruned = number_of_blocks(corpus["n"]) >= PRUNED_BLOCKS and scorer.weight.min() >= 0
                read = self.matching(own, self.promising(own, k) if pruned else None)
                out = out.union(read.groupBy("block").applyInArrow(scorer.function(), kind))
        best = F.rank().over(W.partitionBy("q").orderBy(best_first()))
        found = out.withColumn("n", best).where(F.col("n") <= k)
        return look_up(found, self.lengths, ["block", "slot"], number_of_blocks(corpus["n"]) if corpus else 1).select("q", "chunk_id", *ORDER, "score")

    def read(self, weighted: DataFrame) -> DataFrame:
        """The rows of hits of a bounded block of queries' terms (q, terms)."""
        terms = weighted.select(F.explode("terms.term").alias("term")).distinct()
        buckets = [r["bucket"] for r in terms.select(bucket_of(F.col("term")).alias("bucket")).distinct().collect()]  # 256 at most
        return self.hits.where(F.col("bucket").isin(buckets)).join(F.broadcast(terms), "term", "left_semi")  # BLOCK_TERMS at most

    def promising(self, weighted: DataFrame, k: int) -> DataFrame:
        """(block, terms): the blocks that can hold one of the k best chunks of a query (q, terms), and the terms of those queries."""
        terms = weighted.select("q", F.explode("terms").alias("t")).select("q", "t.term", "t.weight")
        peaks = self.read(weighted).select("term", "block", "peak", "tops")
        kth = top_k(peaks.select("term", "tops").mapInArrow(impacts, "term string, impact double"), ["term"], [F.col("impact").desc()], k, "n").where(F.col("n") == k)
        floors = terms.join(F.broadcast(kth), "term").groupBy("q").agg(F.max(F.col("weight") * F.col("impact")).alias("floor"))
        bounds = F.broadcast(terms).join(peaks, "term").groupBy("q", "block").agg(F.sum(F.col("weight") * F.col("peak")).alias("bound"))
        alive = bounds.join(F.broadcast(floors), "q", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-6))
        return alive.join(F.broadcast(terms), "q").groupBy("block").agg(F.collect_set("term").alias("terms"))

    def matching(self, weighted: DataFrame, promising: DataFrame | None = None) -> DataFrame:
        """The hits of the terms of a bounded block of queries (q, terms), with all rows of a block of chunks in one partition. promising: the blocks, and
        their terms, that are enough."""
        read, spread = self.read(weighted), shuffles(weighted.sparkSession)
        if promising is None:
            return read.repartition(spread, "block")  # work per row is more than its bytes tell: no partitions are put together
        promising = cut(promising.withColumnRenamed("terms", "_terms"))
        blocks = [r["block"] for r in promising.select("block").limit(MOST_ADDRESSES + 1).collect()]
        if len(blocks) <= MOST_ADDRESSES:
            read = read.where(F.col("span").isin(sorted({b // SPAN for b in blocks})) & F.col("block").isin(blocks))
        return read.repartition(spread, "block").join(promising.repartition(spread, "block"), "block").where(F.array_contains("_terms", F.col("term"))).drop("_terms")


class Scorer:
    """Queries as weighted words, to be scored against blocks of chunks."""

    def __init__(self, names: pa.Array, terms: list[list[dict]], k: int, okapi: Okapi, average: float):
        self.names, self.k, self.okapi, self.average = names, k, okapi, average
        times: dict[str, int] = {}
        for own in terms:
            for t in own:
                times[t["term"]] = times.get(t["term"], 0) + 1
        # common words first: the first `common` columns are dense
        place = {term: i for i, term in enumerate(sorted(times, key=lambda t: (-times[t], t)))}
        self.common = sum(n >= COMMON for n in times.values())
        self.vocabulary = pa.array(list(place))
        cells = sorted((place[t["term"]], q, t["weight"]) for q, own in enumerate(terms) for t in own)
        self.term, self.query, self.weight = (np.array(x) for x in zip(*cells, strict=True))
        self.begin = np.searchsorted(self.term, np.arange(len(place) + 1))

    def function(self):
        return lambda table: self.best(table)

    def best(self, table: pa.Table) -> pa.Table:
        """For applyInArrow on a block's hits: of each query the k best chunks, more where scores tie at 9 decimals."""
        table = table.combine_chunks()
        o, many = self.okapi, len(self.names)
        n, hit = unpacked(table.column("hits").combine_chunks())
        slot, tf, dl = hit.T
        term = np.repeat(pc.index_in(table.column("term").combine_chunks(), value_set=self.vocabulary).to_numpy(zero_copy_only=False), n)
        gain = impact(tf, dl, o, self.average)
        order = np.argsort(slot, kind="stable")
        slot, term, gain = slot[order], term[order], gain[order]
        chunks, row = np.unique(slot, return_inverse=True)
        dense = np.zeros((self.common, many))
        m = self.begin[self.common]
        dense[self.term[:m], self.query[:m]] = self.weight[:m]
        cuts = np.searchsorted(row, np.arange(0, len(chunks) + STEP, STEP))
        found = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            scores = self.scores(row[a:b] - i * STEP, term[a:b], gain[a:b], min(STEP, len(chunks) - i * STEP), dense)
            q, at = self.kept(scores)
            found.append((q, at + i * STEP, scores[at, q]))
        q, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"q": self.names.take(pa.array(q)), "block": pa.array(np.full(len(q), table.column("block")[0].as_py(), np.int64)), "slot": pa.array(chunks[at].astype(np.int32)), "score": pa.array(score)})

    def scores(self, row: np.ndarray, term: np.ndarray, gain: np.ndarray, rows: int, dense: np.ndarray) -> np.ndarray:
        """Chunks x queries."""
        many = len(self.names)
        common = term < self.common
        whole = np.zeros((rows, self.common))
        whole[row[common], term[common]] = gain[common]
        scores = whole @ dense
        row, term, gain = row[~common], term[~common], gain[~common]
        n = self.begin[term + 1] - self.begin[term]
        at = np.repeat(self.begin[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return scores + np.bincount(np.repeat(row, n) * many + self.query[at], np.repeat(gain, n) * self.weight[at], rows * many).reshape(-1, many)

    def kept(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and chunks of the scores that are positive and among the k best of their query, or tie with these."""
        rounded = np.round(scores, 9).T
        keep = rounded > 0
        if rounded.shape[1] > self.k:
            keep &= rounded >= np.partition(rounded, -self.k, axis=1)[:, -self.k][:, None]
        return np.nonzero(keep)


def weigh(hits: DataFrame, corpus: DataFrame, okapi: Okapi = Okapi()) -> DataFrame:
    """(term, df, idf). Negative idf becomes epsilon times the mean of all idf before the replacement."""
    df = hits.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("df"))
    raw = df.crossJoin(F.broadcast(corpus.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * okapi.epsilon).otherwise(F.col("raw")).alias("idf"))
