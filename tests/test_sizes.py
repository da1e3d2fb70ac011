"""Steps of registered queries whose tasks must not grow with one source, one store or one block of vectors."""

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.operators import dense


@contextlib.contextmanager
def whole_shuffles(spark):
    """Several small partitions, which are not put together."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_a_source_is_numbered_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "PAGE_IDS", 10)
    rows = [(i * 3 - 50, f"{i * 3 - 50}", "a") for i in range(200)] + [(i, str(i), None) for i in range(5)] + [(None, "none", "a"), (7, "7", "")]
    with whole_shuffles(spark):
        got = queries.pages(spark, documents(spark, tmp_path, rows)).select("*", F.spark_partition_id().alias("task")).collect()
    assert [r.text for r in sorted((r for r in got if r.paper == "a.pdf"), key=lambda r: r.page)] == [str(i * 3 - 50) for i in range(200)] + ["none"]
    assert sorted((r.page, r.text) for r in got if r.paper is None) == [(i + 1, str(i)) for i in range(5)]
    assert [r.page for r in got if r.paper == ".pdf"] == [1] and {r.page for r in got if r.paper == "a.pdf"} == set(range(1, 202))
    assert len({r.task for r in got if r.paper == "a.pdf"}) > 1


def test_a_store_of_several_files_counts_its_lines_through_them(spark, tmp_path, monkeypatch):
    store = f"{tmp_path}/store"
    monkeypatch.setattr(queries, "place", lambda spark, name: store)
    sf = documents(spark, tmp_path, [(i, "" if i % 30 == 4 else "text", "a") for i in range(600)])
    with whole_shuffles(spark):
        got = {(r.part, r.line): r.reason for r in queries.store_faults(spark, sf).collect()}
    want, seen = {}, set()
    for part in range(4):
        for line, i in enumerate(range(part, 600, 4), 1):
            own = 0 if i % 50 == 13 else i
            reason = "no JSON" if i % 50 == 7 else "text is empty" if i % 30 == 4 else "page is below 1" if i % 50 == 11 else "duplicate chunk_id" if own in seen else None
            if i % 50 != 7:
                seen.add(own)
            if reason:
                want[part, line] = reason
    assert got == want
    files = spark.read.text(store).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 150


def test_vectors_are_scored_a_few_at_a_time(monkeypatch):
    """A block of 2,048 queries and a batch of 10,000 vectors were one matrix of scores, several times over."""
    draw, largest = np.random.default_rng(4), []
    kept = dense.Floors.kept
    monkeypatch.setattr(dense.Floors, "kept", lambda self, scores, own=slice(None): largest.append(scores.shape[1]) or kept(self, scores, own))
    vectors, asked = draw.integers(-3, 4, (10_000, 8)) / 4, draw.integers(-3, 4, (50, 8)) / 4
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(vectors.tolist())], names=["id", "embedding"])
    floors, found = dense.Floors(np.zeros(50), 20), []
    for start, part in enumerate(dense.stepped([batch])):
        row, at = floors.kept(asked @ dense.matrix(part.column("embedding"), 8).T)
        found += zip(row.tolist(), (at + start * dense.STEP).tolist(), strict=True)
    whole = asked @ vectors.T
    for q in range(50):  # many ties: all that reach the 20th best score are there
        least = np.sort(whole[q])[-20]
        assert set(np.flatnonzero(whole[q] >= least).tolist()) <= {i for r, i in found if r == q}
    assert max(largest) == dense.STEP and len(found) < 50 * 10_000 / 10
