"""Operators on vectors and pages, the pipeline and the entry file, against brute force and on edge cases."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest

from lodestone.llm import embeddings, topk, urls

sys.path.insert(0, str(Path(__file__).parents[2]))

VECTORS = "vec_id long, embedding array<float>, label int, degree long, own int, x string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], 0, 5, 5, "x") for i, v in rows], VECTORS)


ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [None]), (904, [1.0] * 7 + [math.inf]), (905, [math.nan] * 8), (None, [1.0] * 8), (906, [1.0, 2.0, 3.0]), (907, [1e30] + [0.0] * 7), (908, [-1e-30] + [0.0] * 7)]


def clustered(n, dim, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    x = [centres[draw.integers(6)] + draw.normal(size=dim) * draw.choice([0.05, 0.25, 0.35]) if draw.random() < 0.6 else draw.normal(size=dim) for _ in range(n)]
    x += [x[3]] * 5 + [x[4] * 2]
    return [(i, v.astype(np.float32)) for i, v in enumerate(x)]


def brute_links(rows, cosine=0.9):
    good = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = {i: 0 for i, _ in rows if i is not None}
    root = {i: i for i in links}
    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and (x / abs(x).max()) @ (y / abs(y).max()) / np.linalg.norm(x / abs(x).max()) / np.linalg.norm(y / abs(y).max()) >= cosine:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    return {i: (links[i], root[i], root[i] == i) for i in links}


SMALL = embeddings.NearVectors(sample=120, list_rows=40, block=16, subspaces=3)


@pytest.mark.parametrize("method", [embeddings.NearVectors(), SMALL, embeddings.NearVectors(list_rows=10**6, block=16)])
def test_near_vectors_equal_brute_force(spark, method):
    rows = clustered(330, 8, 1) + [(i, v) for i, v in ODD]
    got = embeddings.near_duplicates(vectors_of(spark, rows), method).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == brute_links(rows)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]


def test_recall_with_fewer_probes(spark):
    rows = clustered(400, 8, 2)
    method = embeddings.NearVectors(sample=200, list_rows=25, sigmas=1.5)
    got = sum(r.n_links for r in embeddings.near_duplicates(vectors_of(spark, rows), method).collect())
    assert got >= 0.9 * sum(n for n, _, _ in brute_links(rows).values())


def test_near_vectors_edge_cases(spark):
    assert embeddings.near_duplicates(vectors_of(spark, [])).count() == 0
    one = embeddings.near_duplicates(vectors_of(spark, [(5, [1.0, 2.0])])).collect()
    assert [tuple(r) for r in one] == [(5, 0, 5, True)]
    twice = embeddings.near_duplicates(vectors_of(spark, [(5, [1.0, 2.0]), (5, [1.0, 2.0])])).collect()
    assert [tuple(r) for r in twice] == [(5, 1, 5, True)] * 2


def brute_top(rows, k=5):
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in sorted({i: q for i, q in good if i % 50 == 0}.items()):
        best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in good if j != i and len(x) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("method", [topk.TopK(), topk.TopK(shard_rows=40, leaf_rows=4, block_queries=3)])
def test_top_k_equals_brute_force(spark, method):
    rows = clustered(330, 8, 3) + [(i, v) for i, v in ODD if not v or max(abs(c or 0) for c in v) < 1e20] + [(50 * i, [0.5] * 8) for i in range(20, 28)] + [(1100 + i, [0.5] * 8) for i in range(1, 9)]
    df = vectors_of(spark, rows)
    got = method.search(df.where("vec_id % 50 = 0"), df).collect()
    assert sorted(map(tuple, got)) == brute_top(rows)


def test_top_k_edge_cases(spark):
    none = vectors_of(spark, [])
    assert topk.TopK().search(none, none).count() == 0
    few = vectors_of(spark, [(0, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0])])
    assert [tuple(r) for r in topk.TopK().search(few.where("vec_id = 0"), few).collect()] == [(0, 1, 1, 65536)]
    huge = vectors_of(spark, [(0, [1e6, 1e6]), (1, [1e6, 1e6])])
    assert [r.score for r in topk.TopK().search(huge.where("vec_id = 0"), huge).collect()] == [2 * 256000000**2]


# ---------------------------------------------------------------- URLs


def brute_verdicts(pages, redirects=()):
    def parts(u):
        if not u or "://" not in u:
            return "", "", ""
        rest = u.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:].split("#")[0]
        path, q, query = tail.partition("?")
        return host, path, q + query

    def rule(host, path):
        fit = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    address = lambda u: "".join(parts(u)) if parts(u)[0] else None
    links = [(address(a), address(b)) for a, b in redirects]
    for _, u, links_of in pages:
        links += [(address(u), address(b)) for b in links_of]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a and b:
            root[find(a)] = find(b)
    bad = {find(x) for x in list(root) if rule(*parts("x://" + x)[:2])[1] == "block"}
    out = []
    for i, u, _ in pages:
        host, path, _ = parts(u)
        name, action = rule(host, path)
        out.append((i, host, path, name, action or ("block" if address(u) in root and find(address(u)) in bad else "allow")))
    return out


def test_verdicts_equal_brute_force(spark):
    draw = random.Random(7)
    hosts = ["a.example.com", "EXAMPLE.net", "x.org", "neutral.io", "b.neutral.io", "com", "notcom"]
    url = lambda: draw.choice(["http://", "https://"]) + draw.choice(hosts) + draw.choice(["", "/", "/en/", "/en/7", "/de/8", "/es/x", "/p", "/q?u=1", "/p#top", "?a=1", "#f"])
    pages = []
    for i in range(150):
        links = [url() for _ in range(draw.randint(0, 2))] if draw.random() < 0.5 else []
        pages.append((i, url(), links))
    pages += [(900, None, []), (901, "no scheme", []), (902, "", []), (903, "http://neutral.io/p", [])]
    html = lambda links: "<html>" + (f"<LINK href='{links[0]}' data-x rel=canonical>" if links else "") + (f'<meta http-equiv="Refresh" content="0; url={links[1]}">' if len(links) > 1 else "")
    redirects = [("http://neutral.io/p", "https://x.org/es/x"), ("http://b.neutral.io", None)]
    df = spark.createDataFrame([(i, u, html(x) if x or i % 2 else None, "clash", "clash") for i, u, x in pages], "page_id long, url string, html string, host string, _rule string")
    more = spark.createDataFrame(redirects, "from_url string, to_url string")
    got = urls.judge(df, redirects=more).orderBy("page_id").collect()
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got] == brute_verdicts(pages, redirects)
    assert any(r.rule is None and r.verdict == "block" for r in got)
    assert urls.judge(df.limit(0)).count() == 0


def test_many_rules_are_joined_alike(spark):
    rules = [*urls.RULES, *(("block", f"h{i}.net", "/") for i in range(300))]
    rows = [(1, "http://a.example.com/en/71"), (2, "http://z.h7.net/x"), (3, "http://b.com/en/9"), (4, "http://q.net/de/8"), (5, "http://example.net/de/8"), (6, None)]
    df = spark.createDataFrame([(i, u, None) for i, u in rows], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rules).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: ("h7.net/", "block"), 3: ("com/en/", "block"), 4: ("net/de/", "allow"), 5: ("example.net/de/8", "block"), 6: (None, "allow")}


def test_relative_links_are_of_the_page(spark):
    rows = [(1, "https://x.org/es/a", "<link rel='canonical' href='/plain'>"), (2, "http://x.org/plain", None), (3, "http://y.org/plain", "<link rel=canonical href='mailto:x'>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(df).collect()} == {1: "block", 2: "block", 3: "allow"}


# ---------------------------------------------------------------- pipeline and entry


def test_pipeline_against_brute_force(spark, tmp_path):
    import base64
    import re

    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from lodestone.llm import bpe, mixing, quality

    draw = random.Random(1)
    word = lambda: "".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 8)))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(draw.randint(30, 90))]
        bad = i % 5 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + "."
        if not bad and i % 7 == 0:
            text += " token = \"" + "".join(draw.choices("0123456789abcdef", k=40)) + "\" end"
        if i >= 200 and not bad:
            text = rows[i - 200][1]  # copies
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(None, "null doc id " * 8, None, None, None), (500, None, "en", "s0", 0), (501, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names, name
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append([tuple(r) for r in docs.collect()])
    good = {i for i, q, _ in labels if q}
    ids = {r[0] for r in kept[0]}
    assert good <= ids and not ids & ({i for i, q, _ in labels if not q})
    from test_words import brute_fingerprint, groups_of

    own = sorted((r for r in kept[0]), key=lambda r: (r[0] is None, r[0] or 0))
    roots = groups_of([brute_fingerprint(r[1]) for r in own])
    assert sorted((r[0] is None, r[0] or 0) for r in kept[1]) == sorted((own[i][0] is None, own[i][0] or 0) for i in set(roots))
    secret = re.compile(r'token = "[0-9a-f]{40}"?')
    before = {r[0]: r[1] for r in kept[1]}
    for r in kept[2]:
        assert not re.search("[0-9a-f]{24}", r[1] or "")
        assert r[1] == before[r[0]] or secret.search(before[r[0]])
    assert len(kept[2]) == len(kept[1])
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(spark.read.parquet(str(tmp_path / "out2"))).collect()}
    for i, (t, n) in taken.items():
        assert sum(r[0] == i for r in kept[3]) == (t // n if n else 0)
    with open(bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = sorted(((r[0] or -1), r[1]) for r in kept[3])
    assert sorted(((r[0] or -1), bytes(r[2]).decode()) for r in kept[4]) == texts
    assert all(r[1] == library.encode_ordinary(bytes(r[2]).decode()) for r in kept[4])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r[0] or -1), r[1]) for r in whole) == sorted(((r[0] or -1), r[1]) for r in kept[4])
    assert quality.NAMES


def test_stages_take_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
