"""The registered queries: each operator over whole test tables, with its equivalent SQL for DuckDB.

Inputs are mapped onto the test tables: a document is a page of the paper named after its source; benchmark passages are the
questions; embeddings are the dense index. Where an operator needs a model's answer, it is made of table values.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lodestone.functions import citations as cite
from lodestone.functions.chunking import split_pages
from lodestone.functions.text import casefold, clean_text, entities, flat_bytes, folds, target_matches, tokens, unique_strings
from lodestone.operators import dense
from lodestone.operators.fusion import merge_evidence, reciprocal_rank_fusion, rerank, unique_counts
from lodestone.operators.graph import EntityGraph
from lodestone.operators.select import select_evidence
from lodestone.operators.sparse import SparseIndex
from lodestone.plans import answering, coverage, planning, workflow
from lodestone.session import Settings, cut, shared_folder, stored
from lodestone.sources.store import Indexes, build_indexes, faults, invalid, load_chunks, load_indexes, manifests, read_lines, save_chunks, save_indexes, summary

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Documents of one source are numbered in blocks of so many doc_ids.
PAGE_IDS = 4096


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """A source's documents are numbered within blocks of doc_ids, and a block begins where those before it end: no task holds a source."""
    block = F.floor(F.col("doc_id") / PAGE_IDS)
    # keys without nulls, for the join
    keys = [F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), F.coalesce(block, F.lit(2**63 - 1)).alias("_block")]  # null ids last
    docs = table(spark, sf, "documents").select("*", *keys)
    by = ("_source", "_none", "_block")
    earlier = F.sum("n").over(W.partitionBy("_source", "_none").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    starts = docs.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.coalesce(earlier, F.lit(0)).alias("_start"))
    numbered = docs.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy("doc_id"))).join(starts, list(by))
    return numbered.select(F.concat("source", F.lit(".pdf")).alias("paper"), (F.col("_start") + F.col("_place")).cast("int").alias("page"), "text")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return split_pages(pages(spark, sf))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def words_of(text: Column) -> Column:
    return F.split(text, " ")


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


# ---------------------------------------------------------------- SQL fragments

PAGES = r"""pages_ AS (SELECT source || '.pdf' AS paper, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INTEGER AS page, text FROM documents),
cleaned AS (SELECT paper, page, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM pages_)"""


def _end(s: str) -> str:
    back = f"instr(reverse(substr(t, {s} + 601, 600)), ' ')"
    return f"CASE WHEN {s} + 1200 >= length(t) THEN length(t) WHEN {back} > 0 THEN {s} + 1200 - {back} ELSE {s} + 1200 END"


CHUNKS = PAGES + f""",
cut(paper, page, t, position, s, e) AS (
  SELECT paper, page, t, 0, 0::BIGINT, {_end('0::BIGINT')} FROM cleaned WHERE t <> ''
  UNION ALL
  SELECT paper, page, t, position + 1, s, {_end('s')} FROM (
    SELECT paper, page, t, position, greatest(e - 150, s + 1) + if(substr(t, greatest(e - 150, s + 1) + 1, 1) = ' ', 1, 0) AS s FROM cut WHERE e < length(t))),
pieces AS (SELECT paper, page, position::INTEGER AS position, trim(substr(t, s + 1, e - s)) AS text FROM cut),
chunks AS (SELECT substr(sha1(paper || chr(0) || page || chr(0) || position || chr(0) || text), 1, 16) AS chunk_id, paper, page, position, text FROM pieces)"""


def fold(x: str) -> str:
    return f"lower(replace(replace({x}, 'ß', 'ss'), 'ẞ', 'ss'))"


def toks(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[a-z0-9]+(?:-[a-z0-9]+)?')"


def matches(target: str, text: str) -> str:
    words = f"regexp_extract_all({fold(target)}, '[a-z0-9]+')"
    return f"(len({words}) > 0 AND regexp_matches({fold(text)}, '(^|[^a-z0-9-])' || array_to_string({words}, '[\\s-]+') || '($|[^a-z0-9-])'))"


BM25 = CHUNKS + f""",
postings AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({toks('text')}) AS term FROM chunks) GROUP BY ALL),
lengths AS (SELECT chunk_id, paper, page, position, len({toks('text')}) AS dl FROM chunks),
corpus AS (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM lengths),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM postings, corpus GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM raw) * 0.25::DOUBLE ELSE raw END AS idf FROM raw)"""

SCORES = BM25 + f""",
asked AS (SELECT qid, query_no, term, count(*) AS times FROM (SELECT item_id AS qid, 0 AS query_no, unnest({toks('text')}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT qid, query_no, p.chunk_id, paper, page, position, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM asked JOIN terms USING (term) JOIN postings p USING (term) JOIN lengths l ON l.chunk_id = p.chunk_id, corpus GROUP BY ALL HAVING round(score, 9) > 0),
sparse AS (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, paper, page, position))::INTEGER AS rank, chunk_id, score FROM scores QUALIFY rank <= 20)"""

ENTITY_SQL = r"\b(?:[A-Z][A-Za-z0-9]*(?:-[A-Z][A-Za-z0-9]+)+|[A-Z]{2,10}|[A-Z][a-z]+(?:\s+[A-Z][A-Za-z-]+){1,3})\b"


def ents(key: str, text: str, source: str) -> str:
    return rf"""SELECT {key}, entity, (row_number() OVER (PARTITION BY {key} ORDER BY min(p)))::INTEGER AS pos FROM (
    SELECT {key}, trim(regexp_replace(lower(trim(found[p], ' ,.;:()[]')), '\s+', ' ', 'g')) AS entity, p FROM (SELECT {key}, regexp_extract_all(regexp_replace({text}, '[^\x00-\x7F]', '_', 'g'), '{ENTITY_SQL}') AS found FROM {source}), unnest(range(1, len(found) + 1)) AS u(p))
  WHERE entity NOT IN ('abstract', 'introduction', 'related work', 'large language models', 'retrieval augmented generation') GROUP BY {key}, entity QUALIFY pos <= 20"""


GRAPH = CHUNKS + f""",
members AS ({ents('chunk_id', 'text', 'chunks')}),
nodes AS (SELECT DISTINCT entity, array_to_string(regexp_extract_all(entity, '[a-z0-9]+'), ' ') AS word_form, array_to_string(regexp_extract_all(entity, '[a-z0-9]+'), '') AS compact FROM members),
edges AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM members a JOIN members b ON a.chunk_id = b.chunk_id AND a.entity < b.entity GROUP BY ALL)"""

NAMES = f"""names AS (SELECT item_id AS qid, i AS entity_no, string_split(text, ' ')[i] AS name FROM benchmark, unnest([1, 2, 3]) AS u(i) WHERE i <= len(string_split(text, ' '))),
asked_names AS (SELECT qid, entity_no, array_to_string(regexp_extract_all({fold('name')}, '[a-z0-9]+'), ' ') AS word_form, array_to_string(regexp_extract_all({fold('name')}, '[a-z0-9]+'), '') AS compact FROM names),
equal AS (SELECT qid, entity_no, entity FROM asked_names JOIN nodes USING (word_form)),
matched AS (SELECT * FROM equal UNION ALL
  SELECT qid, entity_no, entity FROM asked_names a JOIN nodes n ON contains(n.compact, a.compact) OR contains(a.compact, n.compact)
  WHERE length(a.compact) >= 5 AND NOT EXISTS (SELECT 1 FROM equal e WHERE e.qid = a.qid AND e.entity_no = a.entity_no))"""

GRAPH_SEARCH = GRAPH + ",\n" + NAMES + """,
both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
weight AS (SELECT qid, entity, 1.0::DOUBLE AS part FROM matched UNION ALL SELECT qid, dst, 0.5::DOUBLE FROM matched JOIN both_ways ON entity = src),
gscores AS (SELECT qid, chunk_id, sum(part) AS score FROM weight JOIN members USING (entity) GROUP BY ALL),
graph_ AS (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id))::INTEGER AS rank, chunk_id, score FROM gscores QUALIFY rank <= 20)"""

LISTS = SCORES + GRAPH_SEARCH[len(CHUNKS) :] + """,
lists AS (SELECT qid, 'sparse' AS retriever, 0 AS list_ord, rank, chunk_id, score FROM sparse WHERE rank <= 8
  UNION ALL SELECT qid, 'graph', 2000, rank, chunk_id, score FROM graph_ WHERE rank <= 8)"""

FUSED = LISTS + """,
rrf_ AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(list_ord * 1000 + rank) AS first, arg_max(score, list_ord) AS score FROM lists GROUP BY ALL),
fused AS (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, first))::INTEGER AS fused_rank, chunk_id, rrf, score FROM rrf_)"""


def overlap_sql(query: str, text: str) -> str:
    q, t = f"list_distinct({toks(query)})", f"list_distinct({toks(text)})"
    return f"CASE WHEN len({q}) = 0 THEN 0::DOUBLE ELSE len(list_intersect({q}, {t}))::DOUBLE / len({q}) END"


# queries of a question: the passage, its first and its last five words
ASKED = """queries_ AS (SELECT item_id AS qid, 0 AS query_no, text AS query FROM benchmark
  UNION ALL SELECT item_id, 1, array_to_string(string_split(text, ' ')[1:5], ' ') FROM benchmark
  UNION ALL SELECT item_id, 2, '  ' FROM benchmark)"""

RERANKED = FUSED + ",\n" + ASKED + f""",
rescored AS (SELECT f.qid, f.fused_rank, f.chunk_id, c.paper, c.page, c.text, max({overlap_sql('q.query', 'c.text')}) AS score
  FROM fused f JOIN chunks c USING (chunk_id) JOIN queries_ q ON q.qid = f.qid WHERE trim(q.query) <> '' AND fused_rank <= 30 GROUP BY ALL),
reranked AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, fused_rank))::INTEGER AS rank FROM rescored)"""

MERGED = RERANKED + """,
evidence_ AS (SELECT qid, chunk_id, fused_rank AS slot, round(rrf * 20, 9) AS score, 0 AS round FROM fused WHERE fused_rank <= 10
  UNION ALL SELECT qid, chunk_id, rank, score, 1 FROM reranked WHERE rank <= 10),
merged AS (SELECT qid, chunk_id, (row_number() OVER (PARTITION BY qid ORDER BY min(round * 1000 + slot)))::INTEGER AS merged_slot, max(score) AS score FROM evidence_ GROUP BY qid, chunk_id)"""


def select_sql(match: list[str]) -> str:
    """CTEs from items(qid, chunk_id, paper, page, score, slot) to selected(..., evidence_no): one CTE chain per phase. match: SQL per phase, over items."""
    out = ["p0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, slot) AS rk, NULL::INTEGER AS phase FROM items)"]
    for i, m in enumerate(match):
        limit = "2" if i < len(match) - 1 else "8 - sum(if(phase IS NULL, 0, 1)) OVER (PARTITION BY qid)"
        out += [
            f"a{i} AS (SELECT *, ({m}) AND NOT bool_or(phase IS NOT NULL) OVER (PARTITION BY qid, paper, page) AS f1, sum(if(phase IS NULL, 0, 1)) OVER (PARTITION BY qid, paper) AS np, {limit} AS lim FROM p{i})",
            f"b{i} AS (SELECT *, f1 AND row_number() OVER (PARTITION BY qid, paper, page, f1 ORDER BY rk) = 1 AS f2 FROM a{i})",
            f"c{i} AS (SELECT *, f2 AND row_number() OVER (PARTITION BY qid, paper, f2 ORDER BY rk) <= 4 - np AS f3 FROM b{i})",
            f"p{i + 1} AS (SELECT * EXCLUDE (phase, f1, f2, f3, np, lim), if(f3 AND row_number() OVER (PARTITION BY qid, f3 ORDER BY rk) <= lim, {i}, phase) AS phase FROM c{i})",
        ]
    out.append(f"selected AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY phase, rk))::INTEGER AS evidence_no FROM p{len(match)} WHERE phase IS NOT NULL)")
    return ",\n".join(out)


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


# ---------------------------------------------------------------- pages and chunks


@register(with_(PAGES, "SELECT paper, page, t AS text FROM cleaned"))
def clean_pages(spark, sf):
    return pages(spark, sf).select("paper", "page", clean_text(F.col("text")).alias("text"))


@register(with_(CHUNKS, "SELECT paper, page, position, text FROM chunks"))
def split_chunks(spark, sf):
    return chunks(spark, sf).select("paper", "page", "position", "text")


@register(with_(CHUNKS, "SELECT chunk_id, paper, page, position FROM chunks"))
def chunk_ids(spark, sf):
    return chunks(spark, sf).select("chunk_id", "paper", "page", "position")


@register(
    """WITH c AS (SELECT lang || '-' || n_chars AS chunk_id, source AS paper, (doc_id % 3)::INTEGER AS page, text FROM documents),
n AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS copies FROM c),
r AS (SELECT CASE WHEN coalesce(length(chunk_id), 0) = 0 THEN 'chunk_id is empty' WHEN coalesce(length(paper), 0) = 0 THEN 'paper is empty' WHEN coalesce(length(text), 0) = 0 THEN 'text is empty' WHEN page < 1 THEN 'page is below 1' WHEN copies > 1 THEN 'duplicate chunk_id' END AS reason FROM n)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason"""
)
def chunk_integrity(spark, sf):
    given = table(spark, sf, "documents").select(F.concat("lang", F.lit("-"), F.col("n_chars").cast("string")).alias("chunk_id"), F.col("source").alias("paper"), (F.col("doc_id") % 3).cast("int").alias("page"), "text")
    return invalid(given).groupBy("reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- stores


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def letters(rows: DataFrame) -> DataFrame:
    """An encoder that needs no model: how often each letter occurs, as a unit vector."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in dense.stepped(batches):
            data, ends = flat_bytes(batch.column("text"))
            letter = (data | 32) - np.uint8(ord("a"))  # either case
            for character, low in (("\u212a", "k"), ("\u0130", "i")):  # the only others whose lower case holds one of the letters
                own = character.encode()
                n = max(0, len(data) - len(own) + 1)
                there = np.logical_and.reduce([data[i : i + n] == b for i, b in enumerate(own)])
                letter[:n][there] = ord(low) - ord("a")
            of = np.repeat(np.arange(batch.num_rows) * 26, np.diff(ends))[letter < 26]
            counts = np.bincount(of + letter[letter < 26], minlength=batch.num_rows * 26).reshape(-1, 26)
            norm = np.sqrt((counts * counts).sum(axis=1, dtype=np.float64))
            units = (counts / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, units.size + 1, 26, dtype=np.int32)), pa.array(units.ravel()))], names=["id", "embedding"])

    kind = T.StructType([rows.schema["id"], T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return rows.select("id", "text").mapInArrow(counted, kind)


LETTERS = """counts(key, c) AS ({source}), letters AS (SELECT key, list_transform(c, lambda x: (CASE WHEN list_inner_product(c, c) > 0 THEN x / sqrt(list_inner_product(c, c)) ELSE x END)::FLOAT::DOUBLE) AS v FROM counts)"""


def letters_sql(name: str, key: str, text: str, source: str) -> str:
    counts = f"SELECT {key}, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda l: (length(lower({text})) - length(replace(lower({text}), l, '')))::DOUBLE) FROM {source}"
    return LETTERS.format(source=counts).replace("counts", f"{name}_counts").replace("letters AS", f"{name} AS")


def stored_indexes(spark, sf) -> tuple[DataFrame, Indexes]:
    c = stored(chunks(spark, sf))
    path = place(spark, "indexes")
    save_indexes(build_indexes(c, letters), path)
    return c, load_indexes(spark, path, c.count())


@register(with_(CHUNKS, "SELECT chunk_id, paper, page, text, 0.0::DOUBLE AS score FROM chunks"))
def store_chunks(spark, sf):
    path = place(spark, "chunks")
    save_chunks(chunks(spark, sf), path)
    return load_chunks(spark, path)


@register(
    """WITH d AS (SELECT doc_id, (doc_id % 4)::INTEGER AS part, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS line, text, CASE WHEN doc_id % 50 = 13 THEN 0 ELSE doc_id END AS own FROM documents),
r AS (SELECT part, line, CASE WHEN doc_id % 50 = 7 THEN 'no JSON' WHEN text = '' THEN 'text is empty' WHEN doc_id % 50 = 11 THEN 'page is below 1'
  WHEN row_number() OVER (PARTITION BY own, doc_id % 50 = 7 ORDER BY part, line) > 1 AND doc_id % 50 <> 7 THEN 'duplicate chunk_id' END AS reason FROM d)
SELECT part, line, reason FROM r WHERE reason IS NOT NULL"""
)
def store_faults(spark, sf):
    """Documents as stores for each remainder by four, some lines cut off, on page 0 or with the chunk_id of another. A store's files follow one
    another by name, and its lines are counted through them."""
    own = F.concat(F.lit("d"), F.when(F.col("doc_id") % 50 == 13, 0).otherwise(F.col("doc_id")))
    line = F.to_json(F.struct(own.alias("chunk_id"), F.lit("p.pdf").alias("paper"), F.when(F.col("doc_id") % 50 == 11, 0).otherwise(1).alias("page"), "text"))
    lines = table(spark, sf, "documents").select((F.col("doc_id") % 4).alias("part"), "doc_id", F.when(F.col("doc_id") % 50 == 7, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    path = place(spark, "lines")
    lines.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(path)
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("int").alias("part")
    earlier = F.sum("n").over(W.partitionBy("part").orderBy("file").rowsBetween(W.unboundedPreceding, -1))  # a row per file
    starts = read_lines(spark, path).groupBy("file").agg(F.count("*").alias("n")).select("*", part).select("file", F.coalesce(earlier, F.lit(0)).alias("start"))
    return faults(spark, path).join(F.broadcast(starts), "file").select(part, (F.col("start") + F.col("line")).alias("line"), "reason")


# ---------------------------------------------------------------- sparse


SPECIAL = list(folds().items())


@register(
    f"""WITH f(i, c, f) AS (VALUES {", ".join(f"({i}, '{c}', '{f}')" for i, (c, f) in enumerate(SPECIAL))})
SELECT doc_id, md5(replace(replace(lower(replace(text, 'e', chr(1))), 'ß', 'ss'), chr(1), f.f)) AS folded FROM documents JOIN f ON f.i = doc_id % {len(SPECIAL)}"""
)
def fold_texts(spark, sf):
    """Texts in which every e is one of the characters that lower case doesn't fold."""
    character = F.element_at(F.split(F.lit(" ".join(c for c, _ in SPECIAL)), " "), (F.col("doc_id") % len(SPECIAL) + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.md5(casefold(F.replace("text", F.lit("e"), character))).alias("folded"))


@register(with_(BM25, "SELECT term, chunk_id, tf FROM postings"))
def tokenize_terms(spark, sf):
    return SparseIndex.build(chunks(spark, sf)).postings.select("term", "chunk_id", "tf")


@register(with_(BM25, "SELECT term, df, round(idf, 6) AS idf FROM terms"))
def bm25_stats(spark, sf):
    return SparseIndex.build(chunks(spark, sf)).terms.select("term", "df", r6("idf"))


@register(with_(SCORES, "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM sparse"))
def bm25_search(spark, sf):
    return SparseIndex.build(chunks(spark, sf)).search(questions(spark, sf)).select("qid", "rank", "chunk_id", r6("score"))


@register(with_(SCORES.replace("item_id AS qid, 0 AS query_no", "item_id % 8 AS qid, item_id AS query_no"), "SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY round(max(score), 9) DESC, paper, page, position))::INTEGER AS rank, chunk_id, round(max(score), 6) AS score FROM scores GROUP BY qid, chunk_id, paper, page, position QUALIFY rank <= 20"))
def bm25_search_max(spark, sf):
    q = questions(spark, sf).select((F.col("qid") % 8).alias("qid"), F.col("qid").alias("query_no"), "text")
    return SparseIndex.build(chunks(spark, sf)).search_max(q).select("qid", "rank", "chunk_id", r6("score"))


@register(with_(SCORES, "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM sparse"))
def store_sparse(spark, sf):
    return stored_indexes(spark, sf)[1].sparse.search(questions(spark, sf)).select("qid", "rank", "chunk_id", r6("score"))


@register(with_(GRAPH, "SELECT 1::BIGINT AS generation, 'lodestone.queries.letters' AS model, 'injected' AS backend, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM nodes) AS entities, (SELECT count(*) FROM edges) AS edges, 26 AS width"))
def index_manifest(spark, sf):
    path = place(spark, "indexes")
    save_indexes(build_indexes(stored(chunks(spark, sf)), letters), path)
    return manifests(spark, path).drop("folder")


# ---------------------------------------------------------------- graph


def names(spark, sf) -> DataFrame:
    w = F.slice(words_of(F.col("text")), 1, 3)
    return questions(spark, sf).select("qid", F.posexplode(w).alias("i", "name")).select("qid", (F.col("i") + 1).alias("entity_no"), "name")


@register(with_(GRAPH, "SELECT chunk_id, (pos - 1)::INTEGER AS pos, entity FROM members"))
def entity_extract(spark, sf):
    return chunks(spark, sf).select("chunk_id", F.posexplode(entities(F.col("text"))).alias("pos", "entity"))


@register(with_(GRAPH, "SELECT entity, string_agg(chunk_id, ' ' ORDER BY paper, page, position) AS chunks FROM members JOIN chunks USING (chunk_id) GROUP BY entity"))
def entity_nodes(spark, sf):
    c = chunks(spark, sf)
    return EntityGraph.build(c).node_lists(c).select("entity", F.array_join("chunks", " ").alias("chunks"))


@register(with_(GRAPH, "SELECT src, dst, weight FROM edges"))
def entity_edges(spark, sf):
    return EntityGraph.build(chunks(spark, sf)).edges


@register(with_(GRAPH, "SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM nodes) AS entities, (SELECT count(*) FROM edges) AS edges"))
def index_summary(spark, sf):
    c = chunks(spark, sf)
    return summary(c, EntityGraph.build(c))


@register(with_(GRAPH + ",\n" + NAMES, "SELECT qid, entity_no::INTEGER AS entity_no, entity FROM matched"))
def graph_match(spark, sf):
    return EntityGraph.build(chunks(spark, sf)).match(names(spark, sf))


@register(with_(GRAPH_SEARCH, "SELECT qid, rank, chunk_id, score FROM graph_"))
def graph_search(spark, sf):
    return EntityGraph.build(chunks(spark, sf)).search(names(spark, sf))


@register(with_(GRAPH_SEARCH, "SELECT qid, rank, chunk_id, score FROM graph_"))
def store_graph(spark, sf):
    return stored_indexes(spark, sf)[1].graph.search(names(spark, sf))


# ---------------------------------------------------------------- dense

DENSE = "d AS (SELECT q.vec_id AS query, q.label, v.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v), pos AS (SELECT * FROM d WHERE score > 0)"


@register(f"WITH {DENSE} SELECT query AS qid, (row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id))::INTEGER AS rank, id, round(score, 6) AS score FROM pos QUALIFY rank <= 20")
def dense_search_many(spark, sf):
    e = table(spark, sf, "embeddings")
    return dense.search_many(e.select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding")).select("qid", "rank", "id", r6("score"))


@register(f"WITH {DENSE}, m AS (SELECT label AS qid, id, max(score) AS score FROM pos GROUP BY ALL) SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id))::INTEGER AS rank, id, round(score, 6) AS score FROM m QUALIFY rank <= 20")
def dense_search_max(spark, sf):
    e = table(spark, sf, "embeddings")
    return dense.search_max(e.select(F.col("label").alias("qid"), F.col("vec_id").alias("query_no"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding")).select("qid", "rank", "id", r6("score"))


@register(SQL["dense_search_many"])
def dense_cells(spark, sf):
    """The same over an index of cells, of which only those that can matter are compared."""
    e = table(spark, sf, "embeddings")
    index = dense.DenseIndex.build(e.select(F.col("vec_id").alias("id"), "embedding"), 16)
    return index.search_many(e.select(F.col("vec_id").alias("qid"), "embedding")).select("qid", "rank", "id", r6("score"))


@register("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings")
def dense_normalise(spark, sf):
    return dense.normalised(table(spark, sf, "embeddings")).select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


DENSE_LISTS = ",\n" + letters_sql("asked_letters", "item_id", "text", "benchmark") + ",\n" + letters_sql("chunk_letters", "chunk_id", "text", "chunks") + """,
dense_scores AS (SELECT a.key AS qid, chunk_id, paper, page, position, list_inner_product(a.v, c.v) AS score FROM asked_letters a, chunk_letters c JOIN chunks ON c.key = chunk_id),
dense_ AS (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, paper, page, position))::INTEGER AS rank, chunk_id, score FROM dense_scores WHERE score > 0 QUALIFY rank <= 20)"""


@register(with_(CHUNKS + DENSE_LISTS, "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM dense_"))
def store_dense(spark, sf):
    c, indexes = stored_indexes(spark, sf)
    return workflow.RetrievalEngine(c, indexes, letters).dense_search_many(questions(spark, sf)).select("qid", "rank", "chunk_id", r6("score"))


# ---------------------------------------------------------------- fusion and reranking


def rank_lists_of(spark, sf, c: DataFrame | None = None) -> DataFrame:
    c = c or stored(chunks(spark, sf))
    sparse = SparseIndex.build(c).search(questions(spark, sf)).select("qid", F.lit("sparse").alias("retriever"), F.lit(0).alias("list_ord"), "rank", "chunk_id", "score")
    graph = EntityGraph.build(c).search(names(spark, sf)).select("qid", F.lit("graph").alias("retriever"), F.lit(2000).alias("list_ord"), "rank", "chunk_id", "score")
    return sparse.unionByName(graph).where(F.col("rank") <= workflow.PER_QUERY)


def fused_of(spark, sf, c: DataFrame | None = None) -> DataFrame:
    return reciprocal_rank_fusion(rank_lists_of(spark, sf, c))


def asked_of(spark, sf) -> DataFrame:
    first = F.array_join(F.slice(words_of(F.col("text")), 1, 5), " ")
    return questions(spark, sf).select("qid", F.explode(F.array(F.col("text"), first, F.lit("  "))).alias("query"))


def overlap(query: Column, text: Column) -> Column:
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)).cast("double") / F.size(q))


def reranked_of(spark, sf, fused: DataFrame | None = None, c: DataFrame | None = None) -> DataFrame:
    c = c or stored(chunks(spark, sf))
    top = (fused or fused_of(spark, sf, c)).where(F.col("fused_rank") <= workflow.MAX_CANDIDATES).select("qid", "fused_rank", "chunk_id")
    return rerank(asked_of(spark, sf), top.join(c.select("chunk_id", "paper", "page", "text"), "chunk_id"), overlap)


def two_rounds(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The ten best fused candidates, and the ten best reranked ones."""
    c = stored(chunks(spark, sf))
    fused = cut(fused_of(spark, sf, c))
    return fused.where(F.col("fused_rank") <= 10), reranked_of(spark, sf, fused, c).where(F.col("rank") <= 10)


@register(with_(LISTS, "SELECT qid, retriever, list_ord, rank, chunk_id, round(score, 6) AS score FROM lists"))
def rank_lists(spark, sf):
    return rank_lists_of(spark, sf).select("qid", "retriever", "list_ord", "rank", "chunk_id", r6("score"))


@register(with_(LISTS, "SELECT qid, retriever, count(DISTINCT chunk_id) AS chunks FROM lists GROUP BY qid, retriever"))
def retriever_counts(spark, sf):
    return unique_counts(rank_lists_of(spark, sf))


@register(with_(FUSED, "SELECT qid, fused_rank, chunk_id, round(rrf, 9) AS rrf, round(score, 6) AS score FROM fused"))
def rrf_fusion(spark, sf):
    return fused_of(spark, sf).select("qid", "fused_rank", "chunk_id", F.round("rrf", 9).alias("rrf"), r6("score"))


@register(with_(RERANKED, "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM reranked"))
def rerank_maxpool(spark, sf):
    return reranked_of(spark, sf).select("qid", "rank", "chunk_id", r6("score"))


@register(with_(RERANKED, "SELECT qid, count(*) AS retained FROM reranked WHERE score >= 0.5 GROUP BY qid"))
def rerank_threshold(spark, sf):
    return reranked_of(spark, sf).where(F.col("score") >= Settings(min_rerank_score=0.5).min_rerank_score).groupBy("qid").agg(F.count("*").alias("retained"))


def merged_of(spark, sf) -> DataFrame:
    fused, again = two_rounds(spark, sf)
    old = fused.select("qid", "chunk_id", F.col("fused_rank").alias("slot"), F.round(F.col("rrf") * 20, 9).alias("score"))
    return merge_evidence(old, again.select("qid", "chunk_id", F.col("rank").alias("slot"), "score"))


@register(with_(MERGED, "SELECT qid, chunk_id, merged_slot, round(score, 6) AS score FROM merged"))
def evidence_merge(spark, sf):
    return merged_of(spark, sf).select("qid", "chunk_id", "merged_slot", r6("score"))


@register(with_(MERGED, "SELECT qid, list_sort(list(chunk_id) FILTER (round = 0)) = list_sort(list(chunk_id) FILTER (round = 1)) AS no_new FROM evidence_ GROUP BY qid"))
def retry_no_new(spark, sf):
    fused, again = two_rounds(spark, sf)
    pack = lambda df, n: df.groupBy("qid").agg(F.collect_list(F.struct("chunk_id")).alias(n))
    states = pack(fused, "evidence").join(pack(again, "_new"), "qid")
    states = states.withColumns({"verification": F.struct(F.lit("again").alias("corrective_query")), "retry_count": F.lit(0)})
    return workflow.concluded(states).select("qid", (F.col("stop_reason") == "no_new_evidence").alias("no_new"))


# ---------------------------------------------------------------- selection

ITEMS = RERANKED + ",\nitems AS (SELECT qid, chunk_id, paper, page, text, score, rank AS slot FROM reranked)"
NAMED = RERANKED + f""",
tg AS (SELECT item_id AS qid, string_split(text, ' ') AS w FROM benchmark),
named AS (SELECT r.qid, chunk_id, paper, page, text, score, rank AS slot, {matches('w[1]', 'text')} AS m1, {matches('w[2]', 'text')} AS m2, {matches('w[3]', 'text')} AS m3 FROM reranked r JOIN tg USING (qid)),
items AS (SELECT * FROM named QUALIFY bool_or(coalesce(m1, false) OR coalesce(m2, false) OR coalesce(m3, false)) OVER (PARTITION BY qid))"""


def items_of(spark, sf) -> DataFrame:
    return reranked_of(spark, sf).select("qid", "chunk_id", "paper", "page", "text", "score", F.col("rank").alias("slot"))


@register(with_(ITEMS + ",\n" + select_sql(["true"]), "SELECT qid, evidence_no, chunk_id, paper, page FROM selected"))
def select_open(spark, sf):
    return select_evidence(items_of(spark, sf)).select("qid", "evidence_no", "chunk_id", "paper", "page")


@register(with_(NAMED + ",\n" + select_sql(["coalesce(m1, false)", "coalesce(m2, false)", "coalesce(m3, false)", "true"]), "SELECT qid, evidence_no, chunk_id, paper, page FROM selected"))
def select_targets(spark, sf):
    targets = questions(spark, sf).select("qid", F.slice(words_of(F.col("text")), 1, 3).alias("targets"))
    return select_evidence(items_of(spark, sf).join(targets, "qid"), F.col("targets")).select("qid", "evidence_no", "chunk_id", "paper", "page")


@register(f"WITH t AS (SELECT doc_id, text, array_to_string(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[2:3], ' ') AS target FROM documents) SELECT doc_id, target, {matches('target', 'text')} AS named, {matches('target', chr(39) + 'x-' + chr(39) + ' || target')} AS within_longer FROM t")
def target_match(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", "text", F.array_join(F.slice(F.split("text", r"\s+"), 2, 2), " ").alias("target"))
    return t.select("doc_id", "target", target_matches(F.col("target"), F.col("text")).alias("named"), target_matches(F.col("target"), F.concat(F.lit("x-"), F.col("target"))).alias("within_longer"))


# ---------------------------------------------------------------- planning


@register("WITH w AS (SELECT item_id AS qid, string_split(text, ' ') AS w FROM benchmark), u AS (SELECT qid, w[i] AS x, i FROM w, unnest(range(1, len(w) + 1)) AS r(i)), f AS (SELECT qid, trim(x) AS x, min(i) AS i FROM u WHERE trim(x) <> '' GROUP BY qid, trim(x) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY min(i)) <= 5) SELECT qid, string_agg(x, '|' ORDER BY i) AS kept FROM f GROUP BY qid")
def unique_strings_first(spark, sf):
    return questions(spark, sf).select("qid", F.array_join(unique_strings(words_of(F.col("text")), 5), "|").alias("kept"))


@register("WITH v AS (SELECT doc_id, doc_id % 2 = 1 AS g, doc_id // 2 % 2 = 1 AS d, doc_id // 4 % 2 = 1 AS s FROM documents) SELECT doc_id, CASE WHEN NOT (s OR d OR g) THEN 'sparse,dense' WHEN g AND NOT s AND NOT d THEN 'dense,graph' ELSE array_to_string(list_filter([if(s, 'sparse', NULL), if(d, 'dense', NULL), if(g, 'graph', NULL)], lambda x: x IS NOT NULL), ',') END AS retrievers FROM v")
def retriever_routes(spark, sf):
    bit = lambda n, name: F.when(F.floor(F.col("doc_id") / n) % 2 == 1, F.lit(name)).otherwise("web")
    raw = F.array(bit(1, "graph"), bit(2, "dense"), bit(4, "sparse"), F.lit("graph ")).alias("raw")
    return table(spark, sf, "documents").select("doc_id", F.array_join(planning.sanitize_retrievers(raw), ",").alias("retrievers"))


EXPLICIT = f"""v AS (SELECT item_id AS qid, text, string_split(text, ' ')[2] AS a, string_split(text, ' ')[3] || ' methods' AS b, 'Absent Name (' || upper(regexp_replace(string_split(text, ' ')[4], '[^A-Za-z]', '', 'g')) || ')' AS c FROM benchmark),
u AS (SELECT qid, text, unnest([a, b, c]) AS x, unnest([1, 2, 3]) AS i FROM v),
y AS (SELECT qid, i, CASE WHEN {matches('x', 'text')} THEN x WHEN {matches("regexp_extract(x, '\\(([A-Z][A-Z0-9-]{1,9})\\)', 1)", 'text')} THEN regexp_extract(x, '\\(([A-Z][A-Z0-9-]{{1,9}})\\)', 1) END AS x FROM u),
z AS (SELECT qid, x, min(i) AS i FROM y WHERE x IS NOT NULL AND coalesce(regexp_extract_all({fold('x')}, '[a-z0-9]+')[-1], '') NOT IN ('method', 'methods', 'approach', 'approaches', 'frameworks') GROUP BY qid, x)""".replace("{{", "{").replace("}}", "}")


@register(f"WITH {EXPLICIT} SELECT item_id AS qid, coalesce(string_agg(x, '|' ORDER BY i), '') AS targets FROM benchmark LEFT JOIN z ON qid = item_id GROUP BY item_id")
def explicit_targets(spark, sf):
    w = words_of(F.col("text"))
    values = F.array(F.get(w, F.lit(1)), F.concat(F.get(w, F.lit(2)), F.lit(" methods")), F.concat(F.lit("Absent Name ("), F.upper(F.regexp_replace(F.get(w, F.lit(3)), "[^A-Za-z]", "")), F.lit(")")))
    return questions(spark, sf).select("qid", F.array_join(planning.explicit_targets(values, F.col("text")), "|").alias("targets"))


@register("SELECT item_id AS qid, string_split(text, ' ')[1] AS query, CASE WHEN item_id % 4 = 0 THEN 'no facets' WHEN item_id % 4 = 1 THEN 'a list is missing' WHEN item_id % 4 = 2 THEN 'no valid output language' END AS plan_error FROM benchmark")
def plan_payloads(spark, sf):
    q = questions(spark, sf)
    whole = lambda facets, language: F.concat(F.lit('{"queries": ['), F.to_json(F.array(F.get(words_of(F.col("text")), F.lit(0)))).substr(F.lit(2), F.lit(10**6)), F.lit(', "entities": [5], "targets": [], "facets": '), F.lit(facets), F.lit(', "output_language": '), F.lit(language), F.lit("}"))
    n = F.col("qid") % 4
    payload = F.when(n == 0, whole("[7, {}]", '"English"')).when(n == 1, whole("null", '"English"')).when(n == 2, whole('["aim"]', "3")).otherwise(whole('["aim"]', '"English"'))
    planned = planning.plan_questions(q.select("qid", F.col("text").alias("question"), payload.alias("payload")))
    return planned.select("qid", F.get("plan.queries", F.lit(0)).alias("query"), "plan_error")


# ---------------------------------------------------------------- coverage and answers

# every question: targets are its first two words, facets aim and limit, evidence its own passage and another text
STATE = f"""st AS (SELECT item_id AS qid, string_split(text, ' ')[1] AS t1, string_split(text, ' ')[2] AS t2, text FROM benchmark),
raw_cells AS (SELECT qid, t1 AS target, 'aim' AS facet, unnest([1, 2, 9, 1]) AS n, unnest([1, 2, 3, 4]) AS i FROM st
  UNION ALL SELECT qid, t2, 'limit', unnest([2, 1]), unnest([1, 2]) FROM st WHERE qid % 3 <> 0 UNION ALL SELECT qid, 'nowhere', 'aim', 1, 1 FROM st),
ok AS (SELECT c.qid, target, facet, n, min(i) AS i FROM raw_cells c JOIN st USING (qid)
  WHERE lower(target) IN (lower(t1), lower(t2)) AND n IN (1, 2) AND (target = 'question' OR ({matches('target', "if(n = 1, text, 'nothing of the kind')")} AND NOT (target = t1 AND t2 <> t1 AND len({toks('t2')}) > len({toks('t1')}) AND {matches('t2', 'text')}) AND NOT (target = t2 AND t2 <> t1 AND len({toks('t1')}) > len({toks('t2')}) AND {matches('t1', 'text')}))) GROUP BY ALL),
cells AS (SELECT qid, if(lower(target) = lower(t2), t2, t1) AS target, facet, string_agg('E' || n, ',' ORDER BY i) AS ids FROM ok JOIN st USING (qid) GROUP BY ALL)"""


def states_of(spark, sf) -> DataFrame:
    w = words_of(F.col("text"))
    q = questions(spark, sf).select("qid", "text", F.get(w, F.lit(0)).alias("t1"), F.get(w, F.lit(1)).alias("t2"))
    second = F.when(F.col("qid") % 3 != 0, F.struct(F.upper("t2").alias("target"), F.lit("Limit").alias("facet"), F.lit('"E2", "E1"').alias("ids")))
    cell = lambda c: F.concat(F.to_json(F.array(c["target"])).substr(F.lit(2), F.length(F.to_json(F.array(c["target"]))) - 2), F.lit(': {"'), c["facet"], F.lit('": ['), c["ids"], F.lit("]}"))
    first = F.struct(F.col("t1").alias("target"), F.lit("aim").alias("facet"), F.lit('"E1", "E2", "E9", 4, "x", "E01"').alias("ids"))
    other = F.struct(F.lit("nowhere").alias("target"), F.lit("aim").alias("facet"), F.lit('"E1"').alias("ids"))
    covered = F.array_join(F.transform(F.filter(F.array(first, second, other), lambda c: c.isNotNull()), cell), ", ")
    query = F.when(F.col("qid") % 2 == 0, F.lit(" more ")).otherwise(F.lit(""))
    evidence = F.array(*[F.struct(F.lit(i).cast("string").alias("chunk_id"), F.lit("a.pdf").alias("paper"), F.lit(i).alias("page"), t.alias("text"), F.lit(1.0).alias("score")) for i, t in ((1, F.col("text")), (2, F.lit("nothing of the kind")))])
    plan = F.struct(F.array_distinct(F.array("t1", "t2")).alias("targets"), F.array(F.lit("aim"), F.lit("limit")).alias("facets"))
    return q.select("qid", plan.alias("plan"), evidence.alias("evidence"), F.concat(F.lit('{"covered": {'), covered, F.lit('}, "corrective_query": "'), query, F.lit('"}')).alias("payload"))


@register(with_(STATE, "SELECT qid, target, facet, ids FROM cells"))
def coverage_sanitize(spark, sf):
    flat = states_of(spark, sf).select("qid", "plan.targets", "plan.facets", "evidence", "payload")
    return coverage.sanitize_coverage(flat).select("qid", "target", "facet", F.array_join("ids", ",").alias("ids"))


NEEDED = STATE + """,
targets_ AS (SELECT qid, t1 AS target, 1 AS i FROM st UNION ALL SELECT qid, t2, 2 FROM st WHERE t2 <> t1),
needed AS (SELECT qid, target, facet, i * 10 + j AS o FROM targets_, (VALUES ('aim', 1), ('limit', 2)) AS f(facet, j)),
gaps AS (SELECT n.*, c.ids IS NULL AS gap FROM needed n LEFT JOIN cells c USING (qid, target, facet)),
verified AS (SELECT qid, coalesce(string_agg(target || ': ' || facet, '|' ORDER BY o) FILTER (gap), '') AS missing, CASE WHEN count(*) FILTER (NOT gap) = 0 THEN 'insufficient' WHEN count(*) FILTER (gap) = 0 THEN 'complete' ELSE 'partial' END AS status FROM gaps GROUP BY qid)"""


@register("SELECT doc_id AS qid, 'question' AS target, 'aim' AS facet, CASE WHEN doc_id % 3 > 0 THEN 'E' || (doc_id % 3) WHEN doc_id % 2 = 0 THEN 'E1' ELSE 'E2' END AS ids FROM documents")
def coverage_repeated(spark, sf):
    """Payloads whose keys repeat, or differ only in case: a repeated key has its last value at its first place, and later keys count."""
    i = F.col("doc_id")
    payload = F.format_string('{"covered": 1, "covered": {"question": {"aim": ["E9"]}, "QUESTION": {"Aim": [%s], "AIM": ["E%d"]}, "question": {"aim": ["E2"]}}}', F.when(i % 2 == 0, '"E1"').otherwise(""), i % 3)
    item = F.struct(F.lit("c").alias("chunk_id"), F.lit("p.pdf").alias("paper"), F.lit(1).alias("page"), "text", F.lit(1.0).alias("score"))
    none = F.array().cast("array<string>")
    states = table(spark, sf, "documents").select(i.alias("qid"), none.alias("targets"), F.array(F.lit("aim")).alias("facets"), F.array(item, item).alias("evidence"), payload.alias("payload"))
    return coverage.sanitize_coverage(states).select("qid", "target", "facet", F.array_join("ids", " ").alias("ids"))


@register(with_(NEEDED, "SELECT qid, missing FROM verified"))
def coverage_missing(spark, sf):
    return coverage.verify(states_of(spark, sf)).select("qid", F.array_join("verification.missing", "|").alias("missing"))


@register(with_(NEEDED, "SELECT qid, status, if(qid % 2 = 0, 'more', '') AS corrective_query FROM verified"))
def coverage_status(spark, sf):
    return coverage.verify(states_of(spark, sf)).select("qid", "verification.status", "verification.corrective_query")


@register("SELECT doc_id, if(doc_id % 3 = 0, 'verifier', 'writer') AS route FROM documents")
def route_research(spark, sf):
    reason = F.element_at(F.array(F.lit(""), F.lit("no_relevant_evidence"), F.lit("no_new_evidence")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", coverage.route_after_research(reason).alias("route"))


@register(with_(NEEDED, "SELECT qid, if(status = 'complete' OR qid % 2 <> 0 OR qid % 5 = 0, 'writer', 'researcher') AS route FROM verified"))
def route_verification(spark, sf):
    v = coverage.verify(states_of(spark, sf))
    retries = F.when(F.col("qid") % 5 == 0, 1).otherwise(0)
    return v.select("qid", coverage.route_after_verification(F.col("verification.status"), F.col("verification.corrective_query"), retries, 1).alias("route"))


@register(with_(NEEDED, "SELECT v.qid, coalesce(string_agg(DISTINCT n::VARCHAR, ',' ORDER BY n::VARCHAR), '') AS allowed FROM verified v LEFT JOIN ok USING (qid) GROUP BY v.qid"))
def allowed_ids(spark, sf):
    v = coverage.verify(states_of(spark, sf))
    return v.select("qid", F.array_join(F.transform(answering.allowed_ids(F.col("verification.covered")), lambda n: n.cast("string")), ",").alias("allowed"))


@register("WITH s AS (SELECT doc_id, ['complete', 'partial', 'insufficient'][doc_id % 3 + 1] AS status, list_filter([doc_id % 4], lambda n: n BETWEEN 1 AND 3) AS used FROM documents) SELECT doc_id, CASE WHEN status = 'insufficient' AND len(used) > 0 THEN 'evidence cited while abstaining' WHEN status <> 'insufficient' AND len(used) = 0 THEN 'no valid evidence cited' WHEN status <> 'insufficient' AND len(list_filter(used, lambda n: n > 2)) > 0 THEN 'evidence cited that was not approved' END AS write_error FROM s")
def writer_checks(spark, sf):
    status = F.element_at(F.array(F.lit("complete"), F.lit("partial"), F.lit("insufficient")), (F.col("doc_id") % 3 + 1).cast("int"))
    draft = F.concat(F.lit("see [E"), (F.col("doc_id") % 4).cast("string"), F.lit("]."))
    used = cite.valid_evidence_ids(draft, F.lit(3).cast("bigint"))
    return table(spark, sf, "documents").select("doc_id", answering.draft_error(status, used, F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("write_error"))


# a draft per document: a known id, a group with an unknown one, a real and an invented page, spaces to tidy
DRAFT = "'First  [E' || doc_id % 9 || '] , then [E1, E' || doc_id % 5 || '] and [p' || doc_id % 4 || '.pdf p.' || doc_id % 4 || '] ; end  .'"
DRAFTS = f"""dr AS (SELECT doc_id, {DRAFT} AS draft, [{{'paper': 'p1.pdf', 'page': 1}}, {{'paper': 'p2.pdf', 'page': 2}}, {{'paper': 'notes.txt', 'page': 3}}] AS ev FROM documents),
lab AS (SELECT doc_id, draft, ev, list_transform(range(0, 10), lambda n: CASE WHEN n BETWEEN 1 AND 3 THEN '[' || ev[n].paper || ' p.' || ev[n].page || ']' ELSE '' END) AS label FROM dr),
ren AS (SELECT doc_id, draft, 'First  ' || label[doc_id % 9 + 1] || ' , then ' || label[2] || label[doc_id % 5 + 1] || ' and ' || if(doc_id % 4 IN (1, 2), '[p' || doc_id % 4 || '.pdf p.' || doc_id % 4 || ']', '') || ' ; end  .' AS raw FROM lab),
ans AS (SELECT doc_id, draft, trim(regexp_replace(regexp_replace(raw, '[ \\t]{{2,}}', ' ', 'g'), ' +([,.;:])', '\\1', 'g')) AS answer FROM ren)"""


def drafts_of(spark, sf) -> DataFrame:
    s = lambda n: (F.col("doc_id") % n).cast("string")
    draft = F.concat(F.lit("First  [E"), s(9), F.lit("] , then [E1, E"), s(5), F.lit("] and [p"), s(4), F.lit(".pdf p."), s(4), F.lit("] ; end  ."))
    evidence = F.array(*[F.struct(F.lit(p).alias("paper"), F.lit(n).alias("page")) for p, n in (("p1.pdf", 1), ("p2.pdf", 2), ("notes.txt", 3))])
    return table(spark, sf, "documents").select("doc_id", draft.alias("draft"), evidence.alias("evidence"))


@register(with_(DRAFTS, "SELECT doc_id, answer FROM ans"))
def render_citations(spark, sf):
    return drafts_of(spark, sf).select("doc_id", cite.validate_citations(F.col("draft"), F.col("evidence")).alias("answer"))


@register("WITH n AS (SELECT doc_id, doc_id % 9 AS a, doc_id % 5 AS b FROM documents), l AS (SELECT doc_id, list_filter([a, 1, b], lambda x: x BETWEEN 1 AND 3) AS l FROM n) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS ids FROM l")
def evidence_ids(spark, sf):
    ids = cite.valid_evidence_ids(F.col("draft"), F.lit(3).cast("bigint"))
    return drafts_of(spark, sf).select("doc_id", F.array_join(F.transform(ids, lambda n: n.cast("string")), ",").alias("ids"))


@register(with_(DRAFTS, r"SELECT doc_id, p[1] AS paper, p[2]::INTEGER AS page FROM (SELECT doc_id, string_split(regexp_replace(unnest(regexp_extract_all(answer, '\[[^\[\]]+\.pdf p\.\d+\]')), '[\[\]]', '', 'g'), ' p.') AS p FROM ans)"))
def cited_pages(spark, sf):
    d = drafts_of(spark, sf)
    return d.select("doc_id", F.explode(cite.cited_pages(cite.validate_citations(F.col("draft"), F.col("evidence")))).alias("c")).select("doc_id", "c.paper", "c.page")


@register(with_(DRAFTS, r"SELECT doc_id, len(p)::INTEGER AS citations, len(list_distinct(list_transform(p, lambda x: string_split(x, ' p.')[1])))::INTEGER AS sources, len(p) > 0 AND len(list_filter(p, lambda x: x NOT IN ('[p1.pdf p.1]', '[p2.pdf p.2]'))) = 0 AS all_grounded FROM (SELECT doc_id, regexp_extract_all(draft, '\[[^\[\]]+\.pdf p\.\d+\]') AS p FROM ans)"))
def citation_summary(spark, sf):
    return drafts_of(spark, sf).select("doc_id", cite.citation_summary(F.col("draft"), F.col("evidence")).alias("s")).select("doc_id", "s.*")


# ---------------------------------------------------------------- end to end

HYBRID = (
    SCORES
    + f""",
seeds AS ({ents('item_id', 'text', 'benchmark')})"""
    + GRAPH[len(CHUNKS) :]
    + """,
asked_names AS (SELECT item_id AS qid, pos AS entity_no, array_to_string(regexp_extract_all(entity, '[a-z0-9]+'), ' ') AS word_form, array_to_string(regexp_extract_all(entity, '[a-z0-9]+'), '') AS compact FROM seeds)"""
    + GRAPH_SEARCH[GRAPH_SEARCH.index(",\nequal AS") :]
    + LISTS[LISTS.index(",\nlists AS") :]
    + FUSED[len(LISTS) :]
    + ",\n"
    + ASKED.split("\n")[0]
    + ")"
    + RERANKED[RERANKED.index(",\nrescored AS") :]
    + ",\nitems AS (SELECT qid, chunk_id, paper, page, text, score, rank AS slot FROM reranked WHERE score >= 0.2),\n"
    + select_sql(["true"])
)


@register(with_(HYBRID, "SELECT qid, evidence_no, chunk_id, round(score, 6) AS score FROM selected"))
def hybrid_search(spark, sf):
    found = _researched(spark, sf)
    return found.select("qid", F.posexplode("evidence").alias("i", "e")).select("qid", (F.col("i") + 1).alias("evidence_no"), "e.chunk_id", F.round("e.score", 6).alias("score"))


HYBRID_DENSE = HYBRID.replace(",\nlists AS (SELECT", DENSE_LISTS + ",\nlists AS (SELECT qid, 'dense' AS retriever, 1000 AS list_ord, rank, chunk_id, score FROM dense_ WHERE rank <= 8 UNION ALL SELECT")


@register(with_(HYBRID_DENSE, "SELECT qid, evidence_no, chunk_id, round(score, 6) AS score FROM selected"))
def hybrid_dense(spark, sf):
    """All three retrievers, the dense one with letter vectors."""
    found = _researched(spark, sf, "sparse", "dense", "graph")
    return found.select("qid", F.posexplode("evidence").alias("i", "e")).select("qid", (F.col("i") + 1).alias("evidence_no"), "e.chunk_id", F.round("e.score", 6).alias("score"))


def _engine(spark, sf, vectors: bool = False) -> workflow.RetrievalEngine:
    c = stored(chunks(spark, sf))
    none = spark.createDataFrame([], "id string, embedding array<float>")
    return workflow.RetrievalEngine(c, Indexes(SparseIndex.build(c), letters(c.select(F.col("chunk_id").alias("id"), "text")) if vectors else none, EntityGraph.build(c)), letters)


def _researched(spark, sf, *retrievers: str) -> DataFrame:
    states = workflow.initial_states(questions(spark, sf).select("qid", F.col("text").alias("question")))
    plan = F.col("plan").withField("queries", F.array("question")).withField("retrievers", F.array(*map(F.lit, retrievers or ("sparse", "graph"))))
    return workflow.research(states.withColumn("plan", plan), _engine(spark, sf, "dense" in retrievers), Settings(min_rerank_score=0.2), overlap)


ASK = SCORES + ",\nlists AS (SELECT qid, 'sparse' AS retriever, 0 AS list_ord, rank, chunk_id, score FROM sparse WHERE rank <= 8)" + FUSED[len(LISTS) :] + HYBRID[HYBRID.index(",\nqueries_ AS") :]


def _asked(spark, sf, corrective: str) -> DataFrame:
    """The whole workflow with recorded answers: one facet, which the first evidence covers in every second question; in the
    others nothing is covered and the corrective query, if there is one, is tried."""
    from lodestone.sources.providers import Recorded

    q = questions(spark, sf).select("qid", F.col("text").alias("question"))
    none = F.array().cast("array<string>")
    plan = F.to_json(F.struct(F.array("question").alias("queries"), none.alias("entities"), none.alias("targets"), F.array(F.lit("aim")).alias("facets"), F.array(F.lit("sparse"), F.lit("web")).alias("retrievers"), F.lit("English").alias("output_language")))
    good = F.col("qid") % 2 == 0
    verdict = F.when(good, F.lit('{"covered": {"question": {"aim": ["E1"]}}, "corrective_query": ""}')).otherwise(F.lit('{"covered": {}, "corrective_query": "' + corrective + '"}'))
    draft = F.when(good, F.lit("It is so [E1].")).otherwise(F.lit("The corpus does not say."))
    turn = lambda node, n, text: q.select("qid", F.lit(node).alias("node"), F.lit(n).alias("round"), text.alias("payload"))
    answers = turn("planner", 0, plan).unionByName(turn("verifier", 0, verdict)).unionByName(turn("verifier", 1, verdict)).unionByName(turn("writer", 0, draft))
    done = workflow.ask(q, _engine(spark, sf), Settings(min_rerank_score=0.2), Recorded(answers), overlap)
    return done.select("qid", "verification.status", F.size("evidence").alias("evidence"), "retry_count", "stop_reason", "answer")


@register(
    with_(
        ASK,
        """SELECT item_id AS qid, if(n > 0 AND item_id % 2 = 0, 'complete', 'insufficient') AS status, coalesce(n, 0)::INTEGER AS evidence, 0 AS retry_count, if(n > 0, '', 'no_relevant_evidence') AS stop_reason,
  if(item_id % 2 = 0, 'It is so' || coalesce(' [' || paper || ' p.' || page || ']', '') || '.', 'The corpus does not say.') AS answer
FROM benchmark LEFT JOIN (SELECT qid, count(*) AS n, arg_min(paper, evidence_no) AS paper, arg_min(page, evidence_no) AS page FROM selected GROUP BY qid) ON qid = item_id""",
    )
)
def ask_batch(spark, sf):
    return _asked(spark, sf, "")


AGAIN = "the of and"


def later(sql: str) -> str:
    """The CTEs of a selection, named for the second round."""
    return re.sub(r"\b([pabc]\d|items|selected)\b", r"\1_again", sql)


# the second round asks the question and the corrective query; what was selected before comes first in the merge
RETRY = (
    ASK
    + f""",
asked_again AS (SELECT qid, query_no, term, count(*) AS times FROM (SELECT item_id AS qid, 0 AS query_no, unnest({toks('text')}) AS term FROM benchmark UNION ALL SELECT item_id, 1, unnest({toks(f"'{AGAIN}'")}) FROM benchmark) WHERE qid % 2 = 1 GROUP BY ALL),
scores_again AS (SELECT qid, query_no, p.chunk_id, paper, page, position, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM asked_again JOIN terms USING (term) JOIN postings p USING (term) JOIN lengths l ON l.chunk_id = p.chunk_id, corpus GROUP BY ALL HAVING round(score, 9) > 0),
lists_again AS (SELECT qid, query_no AS list_ord, (row_number() OVER (PARTITION BY qid, query_no ORDER BY round(score, 9) DESC, paper, page, position))::INTEGER AS rank, chunk_id FROM scores_again QUALIFY rank <= 8),
rrf_again AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(list_ord * 1000 + rank) AS first FROM lists_again GROUP BY ALL),
fused_again AS (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, first))::INTEGER AS fused_rank, chunk_id FROM rrf_again QUALIFY fused_rank <= 30),
rescored_again AS (SELECT f.qid, fused_rank, f.chunk_id, greatest({overlap_sql('b.text', 'c.text')}, {overlap_sql(f"'{AGAIN}'", 'c.text')}) AS score FROM fused_again f JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = f.qid),
found_again AS (SELECT qid, chunk_id, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, fused_rank))::INTEGER AS slot, score FROM rescored_again QUALIFY score >= 0.2),
both_rounds AS (SELECT qid, chunk_id, evidence_no AS slot, score, 0 AS round FROM selected WHERE qid % 2 = 1 UNION ALL SELECT qid, chunk_id, slot, score, 1 FROM found_again WHERE qid IN (SELECT qid FROM selected)),
merged_again AS (SELECT qid, chunk_id, (row_number() OVER (PARTITION BY qid ORDER BY min(round * 1000 + slot)))::INTEGER AS slot, max(score) AS score FROM both_rounds GROUP BY qid, chunk_id),
items_again AS (SELECT m.qid, m.chunk_id, c.paper, c.page, c.text, m.score, m.slot FROM merged_again m JOIN chunks c USING (chunk_id)),
"""
    + later(select_sql(["true"]))
    + """,
old_set AS (SELECT qid, count(*) AS n, list_sort(list(chunk_id)) AS ids, arg_min(paper, evidence_no) AS paper, arg_min(page, evidence_no) AS page FROM selected GROUP BY qid),
new_set AS (SELECT qid, count(*) AS n, list_sort(list(chunk_id)) AS ids FROM selected_again GROUP BY qid)"""
)


@register(
    with_(
        RETRY,
        """SELECT item_id AS qid, if(o.n > 0 AND item_id % 2 = 0, 'complete', 'insufficient') AS status, coalesce(if(item_id % 2 = 1, s.n, o.n), o.n, 0)::INTEGER AS evidence, if(item_id % 2 = 1 AND o.n > 0, 1, 0) AS retry_count,
  CASE WHEN o.n IS NULL THEN 'no_relevant_evidence' WHEN item_id % 2 = 1 AND s.ids = o.ids THEN 'no_new_evidence' ELSE '' END AS stop_reason,
  if(item_id % 2 = 0, 'It is so' || coalesce(' [' || o.paper || ' p.' || o.page || ']', '') || '.', 'The corpus does not say.') AS answer
FROM benchmark LEFT JOIN old_set o ON o.qid = item_id LEFT JOIN new_set s ON s.qid = item_id""",
    )
)
def ask_retry(spark, sf):
    return _asked(spark, sf, AGAIN)
