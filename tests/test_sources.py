import json

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions.chunking import split_pages
from lodestone.session import Settings, read_dotenv
from lodestone.sources import store
from lodestone.sources.pages import ingest, read_pages
from lodestone.sources.providers import HttpCompleter, ModelUnavailableError, model_path
from lodestone.streaming.ingest import stream_chunks

ROWS = [("c1", "a.pdf", 1, "Ünï text"), ("c2", "a.pdf", 2, "two")]
KIND = "chunk_id string, paper string, page int, text string"


def test_chunks_round_trip(spark, tmp_path):
    path = str(tmp_path / "chunks.jsonl")
    store.save_chunks(spark.createDataFrame(ROWS, KIND).withColumn("extra", F.lit(1)), path)
    got = store.load_chunks(spark, path)
    assert sorted(map(tuple, got.collect())) == [(*r, 0.0) for r in ROWS]


@pytest.mark.parametrize("bad", [("", "p", 1, "t"), ("c", "", 1, "t"), ("c", "p", 0, "t"), ("c", "p", 1, ""), ("c1", "p", 1, "t"), (None, "p", 1, "t")])
def test_invalid_chunks_are_not_stored(spark, tmp_path, bad):
    with pytest.raises(store.StoreError):
        store.save_chunks(spark.createDataFrame([*ROWS, bad], KIND), str(tmp_path / "x"))


@pytest.mark.parametrize("line", ['{"chunk_id": "c9"}', "nonsense", '{"chunk_id": "c9", "paper": "p", "page": 1, "text": "t", "more": 1}', '{"chunk_id": "c9", "paper": "p", "page": "1", "text": "t"}', '{"chunk_id": "c9", "paper": "p", "page": 0, "text": "t"}'])
def test_malformed_lines_are_named(spark, tmp_path, line):
    path = tmp_path / "chunks.jsonl"
    path.write_text(json.dumps(dict(zip(("chunk_id", "paper", "page", "text"), ROWS[0], strict=True))) + "\n\n" + line + "\n")
    with pytest.raises(store.StoreError):
        store.load_chunks(spark, str(path)).collect()


def test_missing_and_empty_stores(spark, tmp_path):
    with pytest.raises(store.StoreError, match="not found"):
        store.load_chunks(spark, str(tmp_path / "none"))
    (tmp_path / "empty.jsonl").write_text("\n\n")
    with pytest.raises(store.StoreError, match="empty"):
        store.load_chunks(spark, str(tmp_path / "empty.jsonl"))


def encoder(rows):
    return rows.select("id", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))


def test_indexes_round_trip_and_mismatch(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "a.pdf", 1, 0, "Self-RAG and CRAG"), ("c2", "a.pdf", 2, 0, "tokens")], "chunk_id string, paper string, page int, position int, text string")
    built = store.build_indexes(chunks, encoder)
    store.save_indexes(built, str(tmp_path / "i"))
    got = store.load_indexes(spark, str(tmp_path / "i"), 2)
    assert sorted(map(tuple, got.sparse.postings.collect())) == sorted(map(tuple, built.sparse.postings.collect()))
    assert tuple(store.summary(chunks, got.graph).first()) == (2, 2, 1)
    with pytest.raises(store.StoreError):
        store.load_indexes(spark, str(tmp_path / "i"), 3)


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    from lodestone.operators.sparse import SparseIndex

    words = [f"w{i}" for i in range(400)]
    chunks = spark.createDataFrame([(f"c{i:03}", "a.pdf", i, 0, " ".join(words[i : i + 20])) for i in range(300)], "chunk_id string, paper string, page int, position int, text string")
    store.save_indexes(store.build_indexes(chunks, encoder), str(tmp_path / "i"))
    index = store.load_indexes(spark, str(tmp_path / "i"), 300).sparse
    question = spark.createDataFrame([("q", "w7 w7 w311 nowhere")], "qid string, text string")
    want = SparseIndex.build(chunks).search(question).collect()
    assert len(want) == 16 and sorted(index.search(question).collect()) == sorted(want)
    weighted = spark.createDataFrame([("q", [("w7", 1.0), ("w311", 1.0)])], "q string, terms array<struct<term string, weight double>>")
    read = index.matching(weighted)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    files = {r.f for r in index.hits.where(F.col("bucket").isin([r.bucket for r in read.select("bucket").distinct().collect()])).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert len(files) <= 2 < len(index.hits.inputFiles())
    assert read.count() == 2


def make_reader():
    # a local function travels to the workers by value; they can't import this module
    return lambda content: content.decode().split("\f")


reader = make_reader()


def test_pages_come_from_matching_files(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "a.pdf").write_bytes(b"three")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = sorted(map(tuple, read_pages(spark, str(tmp_path), reader).collect()))
    assert got == [("a.pdf", 1, "three"), ("b.pdf", 1, "one"), ("b.pdf", 2, "two")]
    chunks = ingest(spark, str(tmp_path), str(tmp_path / "out.jsonl"), reader)
    assert chunks.count() == store.load_chunks(spark, str(tmp_path / "out.jsonl")).count() == 3
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        read_pages(spark, str(tmp_path / "none"), reader)


def test_streamed_pages_give_the_same_chunks(spark, tmp_path):
    pages = spark.createDataFrame([("a.pdf", 1, "word " * 500), ("a.pdf", 2, "short")], "paper string, page int, text string")
    pages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    stream_chunks(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, split_pages(pages).collect()))


@pytest.mark.parametrize("bad", [{"llm_model": " "}, {"embedding_model": ""}, {"reranker_model": ""}, {"min_rerank_score": float("nan")}, {"top_k": 0}, {"top_k": 101}, {"max_retries": -1}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def test_settings_come_from_the_environment(spark, tmp_path):
    (tmp_path / ".env").write_text("# x\nLODESTONE_TOP_K='7'\nLODESTONE_MAX_RETRIES=2\n")
    s = Settings.from_env({"LODESTONE_MAX_RETRIES": "3", "LODESTONE_DATA_DIR": "d"}, str(tmp_path / ".env"))
    assert (s.top_k, s.max_retries, s.chunks_path, s.index_dir) == (7, 3, "d/processed/chunks.jsonl", "d/indexes")
    assert s.describe(spark).first()["top_k"] == 7 and read_dotenv(str(tmp_path / "no")) == {}


def test_providers(tmp_path):
    assert HttpCompleter.from_env("m", {}) is None
    both = {"OPENAI_API_KEY": "o", "DEEPSEEK_API_KEY": "d"}
    assert HttpCompleter.from_env("m", both).key == "d" and HttpCompleter.from_env("m", both | {"DEEPSEEK_API_KEY": " "}).key == "o"
    assert model_path(str(tmp_path)) == str(tmp_path)
    with pytest.raises(ModelUnavailableError):
        model_path("somewhere/else")


def test_cli_exit_codes(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("LODESTONE_DATA_DIR", str(tmp_path / "data"))
    for name in ("DEEPSEEK_API_KEY", "OPENAI_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert cli.main(["ask", "what?"]) == 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.pdf").write_bytes(b"Self-RAG and CRAG\ftwo")
    monkeypatch.setattr(cli, "named", lambda variable, default: reader if "READER" in variable else default)
    assert cli.main(["ingest", str(tmp_path / "p")]) == 0
    assert cli.main(["index"]) == 1
    monkeypatch.setattr(cli, "named", lambda variable, default: encoder if "ENCODER" in variable else default)
    assert cli.main(["index"]) == 0
    err = capsys.readouterr()
    assert "no API key" in err.err and "no encoder" in err.err and "indexed 2 chunks, 2 entities, 1 edges" in err.out
