"""Steps of indexes that were worked out element by element: words, letters, white space, postings."""

import random
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.functions.chunking import split_pages
from lodestone.functions.text import ENTITY, clean_text, entities, token_lists, tokens
from lodestone.operators.sparse import HIT, SparseIndex


def test_words_of_all_bytes_at_once_are_those_of_the_pattern(spark):
    draw = random.Random(7)
    texts = ["", "-", "a", "-a", "a-", "a-b", "a-b-c", "a-b-c-d-e", "a--b", "a- b", "ab-1 c-2-d", "é-a", "a-é-b", "Straße-ẞ x", "K-İ ſ-ﬁ", "", "a", "-b", "c-", "-"]
    texts += [f"{c}a-{c}-b{c} {c}" for c in map(chr, range(1, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c]
    texts += ["".join(draw.choice("ab9Z-- é日") for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(tokens(F.col("text")).alias("words")).collect()
    want = [r.words for r in rows]
    assert token_lists(pa.array(texts)).to_pylist() == want
    assert token_lists(pa.array(texts).slice(3, 700)).to_pylist() == want[3:703]
    assert token_lists(pa.array(["a", None, "-b"])).to_pylist() == [["a"], [], ["b"]] and token_lists(pa.array([], pa.string())).to_pylist() == []


def test_letters_are_counted_in_one_pass(spark):
    every = [c for c in map(chr, range(1, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ["", "aab", "Zebra ÄÖ K", "123", "xyz" * 500, "@[`{ \u212a", "\u0130"] + ["".join(every[i : i + 5000]) for i in range(0, len(every), 5000)]
    rows = queries.letters(spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "id string, text string"))
    assert "replace(" not in rows._jdf.queryExecution().optimizedPlan().toString()  # 26 copies of each text
    got = {r.id: r.embedding for r in rows.collect()}
    low = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(F.lower("text")).collect()]
    for i, t in enumerate(low):
        n = np.array([t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"], float)
        assert got[f"c{i}"] == (n / (np.sqrt((n * n).sum()) or 1)).astype(np.float32).tolist()


def test_pages_are_cleaned_as_by_clean_text(spark):
    every = [c for c in map(chr, range(1, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and not c.isalnum()]
    texts = [" ".join(f"{c}a{c}{c}b{c}" for c in every[i : i + 50]) for i in range(0, len(every), 50)] + ["  \n ", " x\x1c\x85y　", None]
    pages = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "paper string, page int, text string")
    split = split_pages(pages, 10**6, 0)
    assert "regexp_replace" not in split._jdf.queryExecution().optimizedPlan().toString()
    want = {(r.page, r.text) for r in pages.select("page", clean_text(F.col("text")).alias("text")).where("text <> ''").collect()}
    assert {(r.page, r.text) for r in split.collect()} == want


def test_postings_are_packed(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["a", "b-c", "dd", "e1"]) for _ in range(draw.randint(0, 9))) for _ in range(500)]
    chunks = spark.createDataFrame([(f"c{i:03}", "p.pdf", i, 0, t) for i, t in enumerate(texts)], "chunk_id string, paper string, page int, position int, text string")
    index = SparseIndex.build(chunks)
    want = {(w, f"c{i:03}"): t.split().count(w) for i, t in enumerate(texts) for w in t.split()}
    assert index.hits.agg(F.sum(F.octet_length("hits"))).first()[0] == HIT * len(want)
    assert {(r.term, r.chunk_id): r.tf for r in index.postings.collect()} == want
    assert {r.term: r.df for r in index.terms.collect()} == {w: sum(k[0] == w for k in want) for w in ("a", "b-c", "dd", "e1")}
    assert {r.chunk_id: r.dl for r in index.lengths.collect()} == {f"c{i:03}": len(t.split()) for i, t in enumerate(texts)}


def test_names_begin_with_a_capital_whatever_stands_before(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice(["A", "Bc", "-", " ", "é", "É", "_", "x", "GPT", "1", "\u0301"]) for _ in range(draw.randint(0, 25))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.regexp_extract_all("text", F.lit("(?U)" + ENTITY), F.lit(0))
    capital = F.regexp_extract_all("text", F.lit("(?U)(?=[A-Z])" + ENTITY), F.lit(0))
    assert rows.where(plain != capital).count() == 0 and rows.where(F.size(plain) > 0).count() > 100
    assert "(?=[A-Z])" in rows.select(entities(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
