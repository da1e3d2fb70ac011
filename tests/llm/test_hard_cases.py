"""Hard cases of the operators: long texts, hot keys, clashing names, null and shared ids, sizes that grow."""

import math
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_vectors import brute_top, clustered, vectors_of
from test_words import EDGES, docs_of, edge_docs, library  # noqa: F401

from lodestone.llm import bpe, mixing, quality, simhash, substrings, tokens, topk, urls
from lodestone.llm.common import components, cut, drop, held
from lodestone.session import CLEAN

# ---------------------------------------------------------------- written tables


def test_written_tables_free_their_shuffles_and_can_be_dropped(spark):
    before = spark.conf.get(CLEAN)
    df = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert spark.conf.get(CLEAN) == before and df.agg(F.sum("n")).first()[0] == 1000
    drop(df)
    with pytest.raises(Exception, match="(?i)checkpoint|not exist|not found"):
        df.collect()


def test_components_with_a_hot_node_and_a_long_path(spark):
    edges = spark.range(1, 3000).selectExpr("id as u", "0L as v").union(spark.range(10_000, 10_300).selectExpr("id", "id + 1"))
    got = {r.component: r.n for r in components(edges, "u", "v").groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 3000, 10_000: 301}


# ---------------------------------------------------------------- op1


def plain_statistics(text):
    """The sixteen statistics as their names say, character by character."""
    words = text.encode().split()
    n, lines = len(words), [x for x in text.split("\n") if x]
    latin = [chr(c) for c in range(0xC0, 0xDF)]
    capital = lambda c: c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or c in latin
    small = lambda c: c in "abcdefghijklmnopqrstuvwxyz"
    symbol = lambda c: c in "#$%&*+/<=>@[\\]^_`{|}~"
    # of other letters every byte counts that may begin one
    small_bytes = lambda t: sum(small(c) for c in t) + sum(b >= 0xC0 for c in t if not capital(c) for b in c.encode())
    capitals = sum(map(capital, text))
    other = sum(b in range(0x80, 0xC0) for c in text if not capital(c) for b in c.encode()) + sum(ord(c) < 0x20 and c not in "\t\n\v\f\r" or ord(c) == 0x7F for c in text)
    chars = len(text.encode()) - other - sum(c in latin for c in text)
    # a Latin capital is two bytes that count as one capital each its first; the second is none of the sorts
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n if n else 0.0
    same = [x == y for x, y in zip(words, words[1:])]
    starts = list(range(0, n, 48))
    if n > 48 and n % 48:
        starts[-1] = n - 48
    plain = [w.decode() for w in words]
    size = min(48, n)
    stretches = [plain[a:b] for a, b in zip(starts, [*starts[1:], n], strict=False)]
    odd = lambda t: sum(symbol(c) or c == "!" for c in t)
    return {
        "length": math.log(40 + n),
        "symbols": math.log((sum(map(symbol, text)) + 1) / (chars + 300)),
        "exclamations": math.log((text.count("!") + 1) / (chars + 300)),
        "digits": math.log((sum(c in "0123456789" for c in text) + 3) / (chars + 300)),
        "punctuation": math.log((sum(c in ".,;:'\"?-()" for c in text) + 6) / (n + 40)),
        "capitals": math.log((capitals + 4) / (capitals + small_bytes(text) + 150)),
        "word_length": (sum(sizes) + 200) / (n + 40),
        "spread": math.log((sum((x - mean) ** 2 for x in sizes) + 360) / (n + 40)) if n else math.log(9.0),
        "variety": math.log((20 + len(set(words))) / (20 + n)),
        "repeats": math.log((sum(same) + 1) / (n + 50)),
        "lines": math.log((len(lines) - len(set(lines)) + 1) / (len(lines) + 5)),
        "worst_symbols": math.log((max(sum(map(odd, s)) for s in stretches) / size if n else 0.0) + 0.1),
        "worst_capitals": math.log(max((sum(capital(c) for w in s for c in w) + 4) / (sum(capital(c) for w in s for c in w) + sum(map(small_bytes, s)) + 150) for s in stretches)) if n else math.log(4 / 150),
        "worst_repeats": math.log((max(sum(same[a : a + 48]) for a in range(0, n - 1, 48)) / size if n > 1 else 0.0) + 0.1),
        "marked_words": math.log((sum(odd(w) > 0 for w in plain) + 1) / (n + 50)),
        "longest": math.log(12 + max(sizes, default=0)),
    }


def test_statistics_are_what_their_names_say():
    draw = random.Random(1)
    texts = ["", " ", "One two, two two!! ## A1 (B)", "x\nx\n\ny", "É é ÀB", *(" ".join(draw.choice(["the", "THE", "a##", "12", "é", "É.", "no-no", "!!", "x\n"]) for _ in range(n)) for n in (1, 47, 48, 49, 96, 130, 400))]
    for t in texts:
        got = dict(zip(quality.NAMES, quality.statistics(t.encode()), strict=True))
        want = plain_statistics(t)
        assert set(want) == set(got)
        for name, value in want.items():
            assert got[name] == pytest.approx(value, abs=1e-9), (name, t)


def test_the_fit_takes_a_bounded_share_of_labels(spark):
    df = docs_of(spark, [f"text {i}" for i in range(2000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(None, 1), (5, None)], "doc_id long, quality int")
    some, known = quality.teaching(df, labels, most=300)
    ids = {r.doc_id for r in some.collect()}
    assert 220 <= len(ids) <= 380 and ids == {r.doc_id for r in known.collect()}
    everything = quality.teaching(df, labels)
    assert everything[0].count() == 2000 and everything[1].where("doc_id is not null").count() == 2001


# ---------------------------------------------------------------- op3


def test_redirects_at_scale_equal_sql(spark, tmp_path):
    """Chains, rings, relative and commented links, and a third of all pages with one canonical address."""
    draw = random.Random(11)
    hosts = ["a.example.com", "example.net", "x.org", "neutral.io", "b.neutral.io", "EXAMPLE.net"]
    folders = ["", "en/", "de/", "es/", "p/", "p/q/", "de/8/"]
    url = lambda i: f"http://{draw.choice(hosts)}/{draw.choice(folders)}{i}"
    places = [url(i) for i in range(12_000)]
    target = lambda i: draw.choice([places[draw.randrange(len(places))], f"/{draw.choice(folders)}{draw.randrange(12_000)}", f"../{i}", "./x?y=1", f"?id={i % 50}", "//neutral.io/p/1", "q:1"])
    pages = []
    for i, u in enumerate(places):
        if i % 3 == 0:
            html = "<html><link rel='canonical' href='http://hub.neutral.io/'>"
        elif i % 3 == 1 and i + 3 < len(places) and i % 40:
            html = f'<meta http-equiv="refresh" content="0; url={places[i + 3]}">'  # chains of some dozen pages
        else:
            html = draw.choice(["", f"<link rel=canonical href='{target(i)}'>", f"<!-- <link rel=canonical href='http://x.org/es/1'> --><p>", f"<script>'<link rel=canonical href=/es/1>'</script><link rel=canonical href='{target(i)}'>"])
        pages.append((i, u, html))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = urls.judge(df)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.SQL})").fetchall())
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == want
    reached = Counter(v for _, _, _, rule, v in want if rule is None)
    assert reached["block"] > 500 and reached["allow"] > 500


def test_links_in_comments_scripts_and_open_comments_dont_count(spark):
    tag = "<link rel=canonical href='http://x.org/es/1'>"
    htmls = [f"<!--{tag}-->", f"<!-- a --> {tag}", f"<!--{tag}", f"<SCRIPT>{tag}</script >", f"<style>{tag}", f"<styles>{tag}", "x" * 200_000 + tag, "<!--" + "y" * 200_000 + "-->" + tag]
    df = spark.createDataFrame([(i, f"http://n{i}.io/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    assert {r.page_id for r in urls.judge(df).where("verdict = 'block'").collect()} == {1, 5, 6, 7}


# ---------------------------------------------------------------- op5


def test_sketch_counts_every_seed_whatever_the_partitions(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choices("abcdefgh", k=draw.randint(0, 50))) for _ in range(60)] + ["p q r s t u v w " * 40] * 30
    method = substrings.Windows(window=7, seed_words=3, cells=64)
    df = docs_of(spark, texts).select("text")
    one, many = method.ranks(df.repartition(1)), method.ranks(df.repartition(9))
    assert (one[0] == many[0]).all() and one[1] == many[1] and one[0].max() > one[0].min()
    monkey = pytest.MonkeyPatch()
    monkey.setattr(substrings, "FAN_IN", 2)  # several levels of sums
    assert (method.ranks(df.repartition(9))[0] == one[0]).all()
    monkey.undo()


def test_a_worker_keeps_only_what_it_works_with():
    mine = held("a")
    mine[1] = 2
    assert held("a") is mine and mine
    assert held("b") == {} and not mine


def test_common_phrases_are_no_minimisers_where_rarer_seeds_are(spark):
    phrase = "to be or not to be"
    draw = random.Random(5)
    texts = [" ".join([f"u{draw.randrange(10**9)}" for _ in range(20)] + phrase.split() + [f"u{draw.randrange(10**9)}" for _ in range(20)]) for _ in range(400)]
    method = substrings.Windows(window=20, seed_words=6, cells=1 << 16)
    ranks, _ = method.ranks(docs_of(spark, texts).select("text"))
    hot = [least for *_, least in method.super_kmers([t.encode() for t in texts], ranks) for least in [least]]
    counts = Counter(np.concatenate(hot).tolist())
    assert max(counts.values()) < 10


# ---------------------------------------------------------------- op6


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.default_path(), public_tokenizers.PATTERN)


def unspaced(n):
    draw = random.Random(n)
    letter = lambda a, b: chr(draw.randint(a, b))
    return {
        "Han": "".join(letter(0x4E00, 0x9FA5) for _ in range(n)), "Thai": "".join(letter(0xE01, 0xE2E) for _ in range(n)), "kana": "あ" * (n // 2) + "い" * (n // 2), "Latin": "".join(draw.choices("etaoinshrdlu", k=n)),
        "period": ("abcdefghijklm" * n)[:n], "pair": "ab" * (n // 2), "digits": "".join(draw.choices("0123456789", k=n)),
    }


@pytest.mark.parametrize("n", [1_000, 20_000])
def test_long_matches_equal_the_library(codec, library, n):  # noqa: F811
    for kind, text in unspaced(n).items():
        began = time.perf_counter()
        ids, counts = codec.encode([text])
        seconds = time.perf_counter() - began
        assert ids.tolist() == library.encode_ordinary(text), kind
        assert codec.decode(ids, counts) == [text.encode()]
        assert seconds < 5, (kind, seconds)  # about 0.3 s alone
        codec.forget()


def test_matches_of_200_000_characters(codec, library):  # noqa: F811
    for kind, text in unspaced(200_000).items():
        if kind in ("Han", "Latin", "pair"):
            ids, counts = codec.encode([text])
            if kind != "pair":  # the library is quadratic in equal letters
                assert ids.tolist() == library.encode_ordinary(text), kind
            assert codec.decode(ids, counts) == [text.encode()]
            codec.forget()


def test_windows_without_a_common_token_are_widened(monkeypatch, codec, library):  # noqa: F811
    for name, value in (("LONG", 12), ("WINDOW", 12), ("STRIDE", 6), ("RESTART", 14)):
        monkeypatch.setattr(bpe, name, value)
    wider = []
    whole = codec.whole
    monkeypatch.setattr(codec, "whole", lambda word: wider.append(len(word)) or whole(word))
    draw = random.Random(3)
    texts = ["".join(draw.choices(["tion", "ing", "the", "日本", "a", "é", "ss"], k=60)) for _ in range(8)] + [("".join(draw.choices("etaoinß日", k=draw.randint(1, 60))) * 30)[:200] for _ in range(8)]
    ids, _ = codec.encode(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
    assert wider
    codec.forget()


def test_a_text_of_20_megabytes(codec, library):  # noqa: F811
    draw = random.Random(8)
    words = ["".join(draw.choices("etaoinshrdlucmfwyp", k=draw.randint(2, 10))) for _ in range(20_000)]
    text = " ".join(draw.choices(words, k=2_900_000))
    assert len(text) > 18 << 20
    ids, counts = codec.encode(["a  b", text, "", text[: 3 << 20]])
    assert ids.tolist() == [i for t in ("a  b", text, text[: 3 << 20]) for i in library.encode_ordinary(t)]
    assert codec.decode(ids, counts) == ["a  b".encode(), text.encode(), b"", text[: 3 << 20].encode()]


# ---------------------------------------------------------------- op7


def test_null_ids_meet_the_target_too(spark):
    for same in (False, True):
        rows = [(None, "w " * 5 + ("" if same else f"x{i}"), s) for s in ("a", "b") for i in range(100)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        got = mixing.mix(df, mixing.Mixer(weights=(1.0, 3.0)))
        taken = {r.target: r.n for r in got.groupBy("target").agg(F.sum("taken").alias("n")).collect()}
        assert len(taken) == 2 and all(abs(n - t) <= 3 for t, n in taken.items())
        again = mixing.mix(df.repartition(3), mixing.Mixer(weights=(1.0, 3.0)))
        assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
        out = mixing.mixed_documents(df, mixing.Mixer(weights=(1.0, 3.0)))
        assert sum(len(r.text.split()) for r in out.collect()) == sum(taken.values())


def test_names_dont_clash(spark):
    names = ["plan", "row", "mix", "bucket", "_plan", "key", "once", "repeats", "n", "at", "part", "a.b", "words", "first", "fp", "fp2"]
    df = docs_of(spark, ["one two three", "four five", None, "one two three"]).select("doc_id", "text", "source", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() > 0
    left = simhash.NearCopies().deduplicated(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 2]
    assert simhash.deduplicated(df).columns == df.columns and substrings.removed(df).count() == 4


@pytest.mark.parametrize("seed", range(4))
def test_each_source_is_within_half_a_document_of_its_target(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice([i, i, None, i // 2]), "w " * draw.choice([0, 1, 3, 50, 400]) + draw.choice(["", "## !"]), draw.choice("aaabc")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    largest = max(len((t or "").split()) for _, t, _ in rows)
    got = mixing.mix(df, mixing.Mixer(weights=(1.0, 2.0, 3.0), buckets=draw.choice([4, 4096])))
    for r in got.groupBy("target", "source_size").agg(F.sum("taken").alias("n")).collect():
        assert abs(r.n - r.target) <= largest / 2 + 1e-9 or r.n == 3 * r.source_size


# ---------------------------------------------------------------- op8


def test_limits_take_time_in_proportion(spark):
    seconds = []
    for n in (20_000, 200_000, 1_000_000):
        hist = spark.range(n).selectExpr("id as n_tokens", "1 + id % 3 as n_docs")
        began = time.perf_counter()
        r = tokens.limits(hist).agg(F.count("*").alias("n"), F.max("tokens_within").alias("t"), F.max("docs_beyond").alias("b"), F.sum("percentile_to").alias("p")).first()
        seconds.append(time.perf_counter() - began)
        assert r.n == n and r.t == sum(i * (1 + i % 3) for i in range(n))
    assert seconds[2] < 20 * max(1.0, seconds[0])  # fifty times the lengths


def test_percentiles(spark):
    lengths = [0, 0, 3, 5000, 5000, 9000, 12_288]
    hist = spark.createDataFrame(sorted(Counter(lengths).items()), "n_tokens long, n_docs long")
    rows = tokens.limits(hist).collect()
    of = {p: r.context_limit for r in rows if r.percentile_from for p in range(r.percentile_from, r.percentile_to + 1)}
    assert of == {p: sorted(lengths)[-(-p * 7 // 100) - 1] for p in range(1, 101)}


# ---------------------------------------------------------------- op9 and the pipeline's near copies


def test_ids_of_any_type_and_columns_that_cant_be_hashed(spark):
    df = docs_of(spark, [*EDGES, "one two three four five six"]).withColumn("doc_id", F.concat(F.lit("id-"), F.lpad(F.col("doc_id").cast("string"), 3, "0"))).withColumn("more", F.create_map(F.lit("k"), "source"))
    for method in (simhash.deduplicated, simhash.NearCopies().deduplicated):
        left = method(df)
        assert left.schema == df.schema
        assert sorted(r.doc_id for r in left.collect()) == [f"id-{i:03}" for i in (0, 3, 4, 5, 7, 8, 9, 10)]
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} >= {"id-000"}


def test_unrelated_texts_with_a_common_passage_are_no_candidates(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    passage = draw.choices(words, k=12)
    texts = [" ".join(draw.choices(words, k=60) + passage) for _ in range(300)]
    method = simhash.NearCopies()
    marked = method.described(docs_of(spark, texts), np.zeros(0, np.uint64)).withColumn("node", F.col("doc_id"))
    assert method.candidates(marked).count() < 300 * 299 / 2 / 100  # with 64 bits alone ten times as many


# ---------------------------------------------------------------- op10


def test_trees_are_built_once_and_blocks_meet_all_shards(spark, tmp_path):
    rows = clustered(400, 8, 4) + [(50, [0.5] * 8), (100, [-0.5] * 8)]  # two vectors more of a vec_id each
    df = vectors_of(spark, rows)
    method = topk.TopK(shard_rows=40, leaf_rows=6, block_queries=2)
    built = str(tmp_path / "built")
    open(built, "w").close()
    original = topk.KdTree.__init__

    class Counted(topk.KdTree):
        def __init__(self, *args):
            with open(built, "a") as f:
                f.write("x")
            original(self, *args)

    index = method.index(method.integers(df).withColumn("dim", F.size("x")).withColumn("shards", F.lit(5)), 4)
    assert index.count() == 5
    got = sorted(map(tuple, method.search(df.where("vec_id % 50 = 0"), df).collect()))
    db = duckdb.connect()
    df.select("vec_id", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(db.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.SQL})").fetchall())
    plan = method.search(df.where("vec_id % 50 = 0"), df)._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") <= 12 and "Union" not in plan  # blocks are rows, not plans


def test_a_tree_survives_being_written():
    draw = np.random.default_rng(0)
    x = draw.integers(-100, 100, (500, 6)).astype(np.float64)
    tree = topk.KdTree(np.arange(500), x, 16)
    read = topk.KdTree.read(tree.written())
    q = x[:7]
    assert [b for _, b in tree.search(np.arange(7), q, 5, np.full(7, -np.inf))] == [b for _, b in read.search(np.arange(7), q, 5, np.full(7, -np.inf))]


# ---------------------------------------------------------------- pipeline


def test_stages_take_very_long_texts_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(draw.choices(words, k=n)) for n in (200_000, 50, 60, 70)] + ["中" * 30_000, None, ""]
    df = docs_of(spark, texts).withColumn("plan", F.lit(1)).withColumn("words", F.lit("x"))
    spark.createDataFrame([(i, 1, 0) for i in range(7)] + [(99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        df = cut(out)
    assert Counter(bytes(r.decoded).decode() for r in corpus_pipeline.encode(spark, df, str(tmp_path)).collect()) == Counter(r.text or "" for r in df.collect())
    assert {zlib.crc32((t or "").encode()) for t in texts[:4]} <= {zlib.crc32((r.text or "").encode()) for r in df.collect()}
