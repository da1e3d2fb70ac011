"""Stored relations: the chunk store (JSON lines) and the indexes (Parquet).

Indexes are written as generations: each into a folder of its own, and when all of it is there, a manifest that names the folder and tells what
was built (encoder, counts). Readers take the newest manifest and stay with its folder, so one that begins while an index is written
sees the one before, and nothing of two.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.operators.address import block_of, number_of_blocks, span_of
from lodestone.operators.dense import DenseIndex
from lodestone.operators.graph import EntityGraph
from lodestone.operators.sparse import Okapi, SparseIndex
from lodestone.schema import CHUNK_FIELDS, ORDER
from lodestone.session import shuffles
from lodestone.sources.providers import ModelUnavailableError, encodings
from lodestone.sources.responses import opened


class StoreError(ValueError):
    """A store that is missing, empty, malformed or inconsistent."""


def blank_fields() -> list[Column]:
    """For each rule on a chunk's fields what is wrong, or null."""
    return [*(F.when(F.coalesce(F.length(c), F.lit(0)) == 0, f"{c} is empty") for c in ("chunk_id", "paper", "text")), F.when(F.coalesce(F.col("page"), F.lit(0)) < 1, "page is below 1")]


def invalid(chunks: DataFrame) -> DataFrame:
    """The rows that break a rule, with the reason: empty or missing fields, pages below 1, repeated ids."""
    copies = F.count("*").over(W.partitionBy("chunk_id"))
    reason = F.coalesce(*blank_fields(), F.when(copies > 1, "duplicate chunk_id"))
    return chunks.withColumn("reason", reason).where("reason is not null")


def validated(chunks: DataFrame, name: str = "chunks") -> DataFrame:
    bad = invalid(chunks).head()
    if bad is not None:
        raise StoreError(f"{name}: {bad['reason']} (chunk_id {bad['chunk_id']!r})")
    return chunks


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Validated chunks as JSON lines of exactly the four fields."""
    validated(chunks.select(*CHUNK_FIELDS), path).write.mode("overwrite").json(path, ignoreNullFields=False)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start, at): the lines of a text file or a folder of such; start: of the split that a line is in; at: rises along a file's split."""
    try:
        return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    except AnalysisException as e:
        raise StoreError(f"chunk store not found: {path}; run ingest first") from e


def numbered_lines(lines: DataFrame) -> DataFrame:
    """read_lines() with line, counted from 1 in each file. Splits are read by different tasks: each counts its lines, and a line's number is
    the sum of the splits before its own and its place there."""
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per split
    placed = splits.select("file", "start", "first", before.alias("before"))
    return lines.join(F.broadcast(placed), ["file", "start"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1).drop("before", "first")


def parsed(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank, with c, the chunk, and malformed, what keeps the line from being one (null if nothing does)."""
    fields = "chunk_id string, paper string, page int, text string"
    v = F.try_parse_json("value")
    keys = F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    well = (keys == F.array_sort(F.array(*map(F.lit, CHUNK_FIELDS)))) & (kind("chunk_id") == "STRING") & (kind("paper") == "STRING") & (kind("text") == "STRING") & (kind("page") == "BIGINT")
    malformed = F.when(v.isNull(), "no JSON").when(~F.coalesce(well, F.lit(False)), "other fields than " + ", ".join(CHUNK_FIELDS))
    return lines.where(~F.col("value").rlike(r"^\s*$")).select("*", F.from_json("value", fields).alias("c"), malformed.alias("malformed"))


def faults(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, chunk_id, reason): every line of a store that is no valid chunk, and every repetition of a chunk_id."""
    rows = parsed(numbered_lines(read_lines(spark, path)))
    own = rows.select("file", "line", "malformed", F.when(F.col("malformed").isNull(), F.col("c")).alias("c")).select("file", "line", "malformed", "c.*")
    # texts stay where they are read: what is sorted by chunk_id is an address and a reason
    told = own.select("file", "line", "chunk_id", F.coalesce("malformed", *blank_fields()).alias("reason"))
    copy = F.when(F.row_number().over(W.partitionBy("chunk_id").orderBy("file", "line")) > 1, "duplicate chunk_id")
    return told.withColumn("reason", F.coalesce("reason", copy)).where("reason is not null").select("file", "line", "chunk_id", "reason")


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, paper, page, text, score 0.0). Blank lines are skipped; the first line that is no chunk, or repeats one, is named as path:line."""
    rows = parsed(read_lines(spark, path))
    chunks = rows.select("c.*").withColumn("score", F.lit(0.0))
    sizes = rows.agg(F.count("*").alias("n"), F.count("malformed").alias("bad")).first()
    if not sizes["n"]:
        raise StoreError(f"chunk store is empty: {path}")
    if sizes["bad"] or invalid(chunks).head() is not None:
        worst = faults(spark, path).orderBy("file", "line").first()
        what = "duplicate chunk_id" if worst["reason"] == "duplicate chunk_id" else "invalid chunk"
        raise StoreError(f"{what} at {re.sub('^file:(//)?', '', worst['file'])}:{worst['line']}: {worst['chunk_id'] if what.startswith('duplicate') else worst['reason']}")
    return chunks


@dataclass(frozen=True)
class Indexes:
    """vectors (id, embedding) is what dense holds, or the plain vectors of an engine without it; passages(span, block, chunk_id, paper, page,
    position, text): the chunks by address; model, backend: what encoded them."""

    sparse: SparseIndex
    vectors: DataFrame
    graph: EntityGraph
    dense: DenseIndex | None = None
    passages: DataFrame | None = None
    model: str | None = None
    backend: str | None = None


def identity(encoder) -> tuple[str, str]:
    """(model, backend) by which an index knows its encoder."""
    model = getattr(encoder, "path", None) or f"{getattr(encoder, '__module__', '')}.{getattr(encoder, '__qualname__', type(encoder).__name__)}"
    load = getattr(encoder, "load", None)
    return model, "injected" if load is None else load.__name__


TABLES = {"sparse": ("lengths", "hits", "terms", "corpus"), "dense": ("vectors", "cells"), "graph": ("members", "nodes", "edges", "places", "spots", "keys")}
#: Given, for a table in folders that has no rows has no file either, and chunks may name nothing.
KEYS = "kind int, bucket int, key string, entity string, own string"
MANIFEST = "generation long, folder string, model string, backend string, chunks long, entities long, edges long, width int"


def index_paths(folder: str) -> dict[str, str]:
    return {f"{kind}.{t}": f"{folder}/{kind}/{t}" for kind, own in TABLES.items() for t in own} | {"passages": f"{folder}/passages"}


def manifests(spark: SparkSession, index_dir: str) -> DataFrame:
    """The manifests of an index folder, a row per generation; none where nothing was indexed."""
    try:
        return spark.read.schema(MANIFEST).json(f"{index_dir}/manifests/*")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def save_indexes(indexes: Indexes, index_dir: str) -> dict:
    """A new generation of all tables, and its manifest. Postings are in folders by bucket and span of blocks, sorted by term, so a search
    reads few row groups of few files; other tables by block or cell."""
    spark = indexes.vectors.sparkSession
    newest = manifests(spark, index_dir).agg(F.max("generation")).first()[0] or 0
    folder = f"{index_dir}/generation-{newest + 1:06d}-{uuid.uuid4().hex[:8]}"
    n, spread = indexes.sparse.corpus.first()["n"], shuffles(spark)
    for name, path in index_paths(folder).items():
        kind, _, t = name.partition(".")
        df = getattr(getattr(indexes, kind), t) if t else getattr(indexes, name)
        if t == "hits":
            packed = {f"parquet.enable.dictionary#{c}": "false" for c in ("hits", "tops")}  # they hardly repeat
            df.repartition("bucket", "span").sortWithinPartitions("bucket", "term", "block").write.options(**packed).partitionBy("bucket", "span").parquet(path)
        elif t == "lengths" or name == "passages":
            df.repartition(spread, "span", F.col("block") % spread).sortWithinPartitions("span", "block").write.partitionBy("span").parquet(path)
        elif name == "dense.vectors":
            indexes.dense.spread().sortWithinPartitions("cell").write.partitionBy("cell").parquet(path)
        elif t == "keys":  # by ranges, so that a key of very many names isn't one task's
            by = ("kind", "bucket", "key", "entity")
            df.repartitionByRange(spread, *by).sortWithinPartitions(*by).write.partitionBy("kind", "bucket").parquet(path)
        else:
            by = {"terms": "term", "spots": "entity", "places": "place"}.get(t)
            (df.sort(by) if by else df).write.parquet(path)
    graph = load_generation(spark, {"folder": folder, "model": indexes.model, "backend": indexes.backend}).graph
    width = F.size(F.first("centre")) if n else F.lit(0)
    told = indexes.dense.cells.agg(F.lit(newest + 1).cast("long").alias("generation"), F.lit(folder).alias("folder"), F.lit(indexes.model).cast("string").alias("model"), F.lit(indexes.backend).cast("string").alias("backend"), F.lit(n).cast("long").alias("chunks"), width.cast("int").alias("width"))
    counts = graph.nodes.agg(F.count("*").alias("entities")).crossJoin(graph.edges.agg(F.count("*").alias("edges")))  # one row each
    manifest = told.crossJoin(counts).select(*[f.strip().split(" ")[0] for f in MANIFEST.split(",")]).first().asDict()
    spark.createDataFrame([tuple(manifest.values())], MANIFEST).coalesce(1).write.json(f"{index_dir}/manifests/{newest + 1:06d}")
    return manifest


def forget(index_dir: str, keep: int = 2) -> None:
    """Delete generations but the newest `keep`, whose readers may still be at work."""
    files, root = opened(index_dir)
    own = [i.path for i in files.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("generation-")]
    for path in sorted(own)[:-keep]:
        files.delete_dir(path)


def load_indexes(spark: SparkSession, index_dir: str, n_chunks: int | None = None, okapi: Okapi = Okapi()) -> Indexes:
    """The newest generation; with n_chunks its size is compared with the chunk store. Its tables aren't read for that."""
    manifest = manifests(spark, index_dir).orderBy(F.col("generation").desc()).first()
    if manifest is None:
        raise StoreError(f"no index in {index_dir}; run index first")
    if n_chunks is not None and manifest["chunks"] != n_chunks:
        raise StoreError(f"the index holds {manifest['chunks']} chunks, the store {n_chunks}; run index")
    return load_generation(spark, manifest.asDict(), okapi)


def load_generation(spark: SparkSession, manifest: dict, okapi: Okapi = Okapi()) -> Indexes:
    t = {name: (spark.read.schema(KEYS) if name == "graph.keys" else spark.read).parquet(path) for name, path in index_paths(manifest["folder"]).items()}
    if "peak" not in t["sparse.hits"].columns:
        raise StoreError("the index is of an earlier form; run index")
    sparse, dense, graph = ([t[f"{kind}.{name}"] for name in TABLES[kind]] for kind in TABLES)
    dense = DenseIndex(*dense)
    return Indexes(SparseIndex(*sparse, okapi), plain(dense), EntityGraph(*graph), dense, t["passages"], manifest["model"], manifest["backend"])


def plain(dense: DenseIndex) -> DataFrame:
    return dense.vectors.select(F.col("id.chunk_id").alias("id"), "embedding")


def build_indexes(chunks: DataFrame, encoder, okapi: Okapi = Okapi()) -> Indexes:
    """All indexes of positioned chunks. encoder: chunks (id, text) -> (id, embedding), a vector for each chunk."""
    vectors = encodings(encoder, chunks.select(F.col("chunk_id").alias("id"), "text"))
    sparse = SparseIndex.build(chunks, okapi)
    n = sparse.corpus.first()["n"]
    # the order that breaks ties is stored beside the vector
    order = chunks.select(F.col("chunk_id").alias("id"), F.struct(*ORDER, "chunk_id").alias("_order"))
    dense = DenseIndex.build(vectors.join(order, "id").select(F.col("_order").alias("id"), "embedding"))
    held = dense.cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if held != n:
        raise StoreError(f"the encoder gave {held} vectors for {n} chunks")
    passages = chunks.select("chunk_id", *ORDER, "text", block_of(F.col("chunk_id"), number_of_blocks(n)).alias("block")).withColumn("span", span_of(F.col("block")))
    return Indexes(sparse, plain(dense), EntityGraph.build(chunks), dense, passages, *identity(encoder))


def same_encoder(indexes: Indexes, encoder) -> None:
    """ModelUnavailableError if the index was built with another encoder."""
    own = identity(encoder)
    if indexes.model is not None and (indexes.model, indexes.backend) != own:
        raise ModelUnavailableError(f"the index was built with {indexes.model} ({indexes.backend}), not {own[0]} ({own[1]}); run index")


def summary(chunks: DataFrame, graph: EntityGraph, dense_backend: str | None = None) -> DataFrame:
    """One row: chunks, entities, edges, and dense_backend if it is given."""
    counts = [df.agg(F.count("*").alias(n)) for n, df in (("chunks", chunks), ("entities", graph.nodes), ("edges", graph.edges))]
    row = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each
    return row if dense_backend is None else row.withColumn("dense_backend", F.lit(dense_backend))
