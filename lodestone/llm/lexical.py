"""Ranked lexical search: postings are traversed in fixed windows of documents, scores are added up in small arrays.

Texts are read once. What a text leaves is a short row: its doc_id, its number of terms, and those of its terms that any query asks
for, with their counts. These rows are sorted by doc_id over the whole cluster and written; sums over them give the collection's
statistics. Then every task walks its range in windows of `window` consecutive documents: the window's rows are inverted to
postings by term, each with its impacts worked out once; for each query its terms' postings are added to an array with a cell per
document of the window (it fits a core's cache) while a bitset marks the cells that were touched; the marked cells are harvested
into the query's heap of k, whose least score skips most of them. A task passes on k rows per query, whatever it read.

Queries are a stated set: equal texts are searched once, and they go to the tasks in blocks of about `block_pairs` pairs of query and
term (some 50,000 queries of 40 words), which bounds what is sent. Each block reads the texts once.

Defined cases: a null or empty text, or one without terms, is no document (it counts in no statistic and is never found); a null
query text finds nothing; a term of a query that no document holds adds nothing; documents with a null doc_id count and are found
like others, before the smallest doc_id where scores tie; documents that share a doc_id are ranked each by itself; queries that
share a name are answered each by itself; scores are 64-bit integers; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lodestone.llm.common import batches_of, cut, drop, in_order, text_bytes

#: Bytes as terms have them: letters A-Z are lowered, digits, letters and all bytes beyond ASCII stay, the others part terms.
BYTES = bytes(b if b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))
#: Texts are split into terms this many bytes at a time.
SLICE = 1 << 20


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in its order, in lists of bounded size."""
    flat = text.translate(BYTES)
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + SLICE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def counted(text: bytes) -> Counter:
    out: Counter = Counter()
    for some in terms_of(text):
        out.update(some)
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Distinct queries with their terms as numbers, to be scored against windows of documents in the order of their ids."""

    def __init__(self, names: list[str], queries: list[dict[int, int]], weights: dict[int, int], k: int):
        self.names, self.k = names, k
        self.terms = np.array(sorted(weights), np.int64)
        self.weights = np.array([weights[t] for t in self.terms.tolist()], np.int64)
        column = {t: i for i, t in enumerate(self.terms.tolist())}
        self.queries = [[(column[t], times) for t, times in q.items() if t in column] for q in queries]

    def window(self, terms: np.ndarray, slot: np.ndarray, impact: np.ndarray, ids: list, heaps: list[list], first: int) -> None:
        """Adds a window of documents to the heaps. terms, slot, impact: its postings by document; ids: of its documents; first: how
        many documents came before. A heap holds (score, -place, id)."""
        own = np.searchsorted(self.terms, terms)
        order = np.argsort(own, kind="stable")
        own, slot = own[order], slot[order]
        gain = impact[order] * self.weights[own]
        begin = np.searchsorted(own, np.arange(len(self.terms) + 1))
        scores, touched = np.zeros(len(ids), np.int64), np.zeros(-(-len(ids) // 8) * 8, np.bool_)
        for query, heap in zip(self.queries, heaps, strict=True):
            for t, times in query:
                a, b = begin[t], begin[t + 1]
                if a < b:
                    at = slot[a:b]  # holds a document once at most
                    scores[at] += gain[a:b] * times
                    touched[at] = True
            found = np.flatnonzero(touched)
            if not len(found):
                continue
            value = scores[found]
            scores[found], touched[found] = 0, False
            # later documents have larger ids, so they must be better than the k-th
            least = max(0, heap[0][0]) if len(heap) == self.k else 0
            better = np.flatnonzero(value > least)
            if len(better) > self.k:
                better = better[value[better] >= np.partition(value[better], -self.k)[-self.k]]
            for i in better.tolist():
                place = int(found[i])
                item = (int(value[i]), -(first + place), ids[place])
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, item)


def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, text) -> (query, term, times)."""
    for batch in batches_of(batches, "text"):
        rows = [(q, t, n) for q, text in zip(batch.column("query").to_pylist(), text_bytes(batch.column("text")), strict=True) for t, n in counted(text).items()]
        query, term, times = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.string()), pa.array(term, pa.binary()), pa.array(times, pa.int64())], names=["query", "term", "times"])


@dataclass(frozen=True)
class LexicalSearch:
    k: int = 10
    #: how much a document's length counts, in hundredths
    b: int = 75
    window: int = 16_384
    block_pairs: int = 2_000_000

    def search(self, queries: DataFrame, docs: DataFrame) -> DataFrame:
        """queries (qid, text), docs (doc_id, text) -> (qid, rank, doc_id, score): the k best documents of each query."""
        asked = cut(queries.select("qid", F.sha2(F.coalesce("text", F.lit("")), 256).alias("query"), "text"))
        pairs = cut(asked.groupBy("query").agg(F.first("text").alias("text")).mapInArrow(query_terms, "query string, term binary, times long"))
        blocks = max(1, -(-pairs.count() // self.block_pairs))
        found = None
        for b in range(blocks):
            part = self.block(pairs.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b), docs)
            found = part if found is None else found.union(part)
        best = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))
        top = found.withColumn("rank", best.cast("int")).where(F.col("rank") <= self.k)
        return asked.drop("text").join(top, "query").select("qid", "rank", "doc_id", "score")

    def block(self, pairs: DataFrame, docs: DataFrame) -> DataFrame:
        """pairs (query, term, times), as many as block_pairs says -> (query, doc_id, score): each task's k best of each query."""
        own: dict[str, dict[int, int]] = {}
        number: dict[bytes, int] = {}
        for batch in pairs.toArrow().to_batches():
            for query, term, times in zip(*(batch.column(c).to_pylist() for c in ("query", "term", "times")), strict=True):
                own.setdefault(query, {})[number.setdefault(term, len(number))] = times
        slim = cut(docs.select("doc_id", "text").mapInArrow(matched(number), T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n long, terms array<int>, times array<int>")])))
        size = slim.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        counts = slim.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weights = {r["term"]: weight(size["docs"], r["df"]) for r in counts.toLocalIterator()}  # of the block's terms
        rows = in_order(slim.where(F.size("terms") > 0), [F.col("doc_id").asc_nulls_first()])
        drop(slim)
        block = Block(list(own), list(own.values()), weights, self.k)
        kind = T.StructType([T.StructField("query", T.StringType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
        return rows.select("doc_id", "n", "terms", "times").mapInArrow(self.walk(block, size["docs"], size["terms"]), kind)

    def walk(self, block: Block, n_docs: int, n_terms: int) -> Callable:
        """mapInArrow's function: a task's documents (doc_id, n, terms, times), in order, by windows."""
        size, b = self.window, self.b

        def spread(n: np.ndarray) -> np.ndarray:
            if not len(n) or b * int(n.max()) * n_docs < 2**63:
                return 100 - b + b * n * n_docs // n_terms
            return np.array([100 - b + b * x * n_docs // n_terms for x in n.tolist()], np.int64)

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
            kept: list[pa.RecordBatch] = []
            rows = 0
            for batch in batches_of(batches, "terms", 64 << 20):
                while rows + batch.num_rows >= size:
                    kept.append(batch.slice(0, size - rows))
                    yield pa.Table.from_batches(kept)
                    batch, kept, rows = batch.slice(size - rows), [], 0
                kept.append(batch)
                rows += batch.num_rows
            if rows:
                yield pa.Table.from_batches(kept)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heaps: list[list] = [[] for _ in block.names]
            first, kind = 0, pa.int64()
            for window in windows(batches):
                window = window.combine_chunks()
                terms = window.column("terms").combine_chunks()
                slot = np.repeat(np.arange(len(window)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
                tf = window.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * spread(window.column("n").to_numpy())[slot])
                kind = window.schema.field("doc_id").type
                block.window(terms.flatten().to_numpy(zero_copy_only=False), slot, impact, window.column("doc_id").to_pylist(), heaps, first)
                first += len(window)
            rows = [(name, item[2], item[0]) for name, heap in zip(block.names, heaps, strict=True) for item in heap]
            for at in range(0, len(rows), 65_536):
                query, ids, scores = zip(*rows[at : at + 65_536], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.string()), pa.array(ids, kind), pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])

        return run


def matched(number: dict[bytes, int]) -> Callable:
    """mapInArrow's function: (doc_id, text) -> (doc_id, n, terms, times) of the texts with any term: their number of terms, and
    the numbered terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text"):
            keep, n, terms, times = [], [], [], []
            for row, text in enumerate(text_bytes(batch.column("text"))):
                counts = counted(text)
                if counts:
                    keep.append(row)
                    n.append(counts.total())
                    known = [(i, c) for t, c in counts.items() if (i := number.get(t)) is not None]
                    terms.append([i for i, _ in known])
                    times.append([c for _, c in known])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, ints), pa.array(times, ints)], names=["doc_id", "n", "terms", "times"])

    return run


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT row_number() OVER () AS row, doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
q AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS times FROM q GROUP BY ALL),
words AS (SELECT row, unnest(w) AS term FROM d),
p AS (SELECT row, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, size GROUP BY term),
s AS (
  SELECT item, item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN p USING (term) JOIN d USING (row), size GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
