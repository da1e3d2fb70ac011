"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_words import EDGES, WORD, docs_of, edge_docs

from lodestone.llm import queries, secrets, simhash, tokens, urls
from lodestone.llm.common import components

# ---------------------------------------------------------------- near copies (pipeline)


def brute_groups(texts, similar=0.8):
    """The smallest position of each text's group, by all pairs' Jaccard similarity in five-word shingles."""
    sets = []
    for t in texts:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def near_texts(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    passage = draw.choices(words, k=25)
    texts = []
    for k in range(45):
        own = draw.choices(words, k=draw.choice([3, 12, 60, 200]))
        if k % 3 == 0:
            own[1:1] = passage
        texts.append(" ".join(own))
        for _ in range(draw.randint(0, 3)):
            near = list(own)
            for _ in range(draw.randint(0, max(1, len(own) // 40))):
                near[draw.randrange(len(near))] = draw.choice(words)
            texts.append(draw.choice([str, str.upper])(" ".join(near)))
    base = draw.choices(words, k=150)
    for _ in range(90):  # a group above the limits of one step
        near = list(base)
        near[draw.randrange(150)] = draw.choice(words)
        texts.append(" ".join(near))
    return texts + ["", "  \n", None]


@pytest.mark.parametrize("method", [simhash.NearCopies(), simhash.NearCopies(block_texts=7, common=10**6, max_common=3), simhash.NearCopies(block_texts=7, hubs=1), simhash.NearCopies(block_bytes=3000), simhash.NearCopies(most_texts=5, common=10**6)])
def test_near_copies_equal_brute_force(spark, method):
    texts = near_texts(3)
    df = docs_of(spark, texts).repartition(3)
    got = method.deduplicated(df)
    assert got.columns == df.columns
    want = brute_groups(texts)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))
    assert len(set(want)) < len(set(texts)) - 60


def test_near_copies_edge_cases(spark):
    df, _ = edge_docs(spark)
    left = simhash.NearCopies().deduplicated(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == [(False, i) for i in (0, 3, 4, 5, 7, 8, 9)] + [(True, 0)]
    assert {r.text for r in left} <= {*EDGES, "null id"}
    assert simhash.NearCopies().deduplicated(df.limit(0)).count() == 0


def test_pipeline_drops_edited_copies(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(5)
    words = [f"w{draw.randint(0, 999)}" for _ in range(300)]
    edited = list(words)
    for at in (20, 90, 160, 230, 280):  # 25 of 296 shingles: a similarity of 0.84
        edited[at] = "other"
    df = docs_of(spark, [" ".join(words), " ".join(edited), " ".join(reversed(words))])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, str(tmp_path)).collect()) == [0, 2]


def test_distance_is_wide_enough_for_the_similarity():
    draw, method = random.Random(2), simhash.NearCopies()
    words = [f"w{i}" for i in range(3000)]
    far = []
    for _ in range(150):
        own = draw.choices(words, k=120)
        near = list(own)
        for at in draw.sample(range(5, 115), 2):
            near[at] = "x"
        a, b = (set(simhash.shingle_set(" ".join(x).encode(), 5).tolist()) for x in (own, near))
        assert len(a & b) >= 0.8 * len(a | b)
        far.append((simhash.simhash(" ".join(own).encode(), 5) ^ simhash.simhash(" ".join(near).encode(), 5)).bit_count())
    assert max(far) <= method.distance and np.mean(np.array(far) > 4) > 0.5


# ---------------------------------------------------------------- glued credentials (op2, pipeline)


@pytest.fixture(scope="module")
def grammar(spark):
    draw = random.Random(4)
    pick = lambda alphabet, n: "".join(draw.choices(alphabet, k=n))
    texts = [f"see {pick(secrets.LOWER, draw.randint(16, 24))} and {pick(secrets.LOWER, 9)}/{pick(secrets.LOWER, 12)}.html ok token = \"{pick('0123456789abcdef', 40)}\"" for _ in range(300)]
    return secrets.learnt(docs_of(spark, texts))


FRAMES = ["see {} now", "see {}.", "GH={}", "https://x.io/cb?code={}", "path/{}", "a.b/{}/c", "x-{}", "'{}'", "AKIA" + "Q" * 16 + "/{}", "{}+" + "0f" * 12]


@pytest.mark.parametrize("name,alternatives", secrets.FORMATS)
def test_glued_credentials_are_found(grammar, name, alternatives):
    draw = random.Random(name)
    for frame in FRAMES:
        hits = 0
        for _ in range(60):
            token = "".join(p if isinstance(p, str) else "".join(draw.choices(p[0], k=draw.randint(p[1], p[2]))) for p in draw.choice(alternatives))
            text = frame.format(token)
            a = text.index(token)
            found = any(x <= a and a + len(token) <= y for x, y, _ in secrets.all_spans(text, grammar)[1])
            hits += found
            assert not found or token not in secrets.redact(text, grammar)
        assert hits >= 57, (frame, hits)


def test_ordinary_tokens_are_left_alone(grammar):
    draw = random.Random(5)
    pick = lambda alphabet, least, most: "".join(draw.choices(alphabet, k=draw.randint(least, most)))
    hexes = lambda n: "%0*x" % (n, draw.getrandbits(4 * n))
    uuid = lambda: "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
    kinds = {
        "words": lambda: pick(secrets.LOWER, 6, 30), "uuids": uuid, "UUIDs": lambda: uuid().upper(), "SHA-1": lambda: hexes(40).upper(), "SHA-256": lambda: hexes(64).upper(), "numbers": lambda: pick(secrets.DIGITS, 8, 30),
        "paths": lambda: "/".join(pick(secrets.LOWER, 3, 12) for _ in range(5)) + ".html", "names": lambda: "-".join(pick(secrets.LOWER, 3, 8) for _ in range(6)), "random": lambda: pick(secrets.ALNUM, 20, 60), "assigned": lambda: f"{pick(secrets.LOWER, 9, 9)}={pick(secrets.LOWER, 20, 20)}",
    }
    for kind, one in kinds.items():
        assert sum(any(k == "format" for _, _, k in secrets.all_spans(f"the {one()} is.", grammar)[1]) for _ in range(300)) <= 3, kind


def test_lengths_are_part_of_the_grammar(grammar):
    assert len(grammar.credentials["assign"].automaton.arcs) > 40
    assert grammar.is_credential("0123456789" * 3 + "abcdef0123") and not grammar.is_credential("0123456789" * 3 + "abcdef012")


def brute_spans(text, model):
    """All spans by trying every substring between glue characters, scored by following the arcs one symbol at a time."""

    def score(form, token):
        n = max([0, *(i for i in range(1, 33) if token[:i] in form.beginnings and len(token) >= i)])
        code = 0
        for c in token[n:]:
            code |= 1 if c in "0123456789" else 2 if c in "abcdef" else 6 if c.islower() else 8 if c in "ABCDEF" else 24 if c.isupper() else 32 if c in "_-" else 64 if c in "+/" else 128 if c == "=" else 256
        size = sum(k for i, k in enumerate((10, 6, 20, 6, 20, 2, 2, 1, 1)) if code >> i & 1)
        m = len(token) - n
        word = token[:n] + chr(0xE000 + code) * min(m, 128) + (chr(0xF000 + len(bin(m - 128)) - 2) if m > 128 else "")
        state, total = 0, 0.0
        for c in word:
            if c in form.automaton.arcs[state]:
                state, p = form.automaton.arcs[state][c]
                total += p
            else:
                total += form.automaton.other[state]
        return total + form.automaton.end[state] - m * np.log(max(1, size))

    def credential(token):
        return len(token) >= model.least and any(score(f, token) >= f.floor * (len(token) + 1) and score(f, token) >= model.ordinary.loglik(token) + model.margin for f in model.credentials.values())

    import re

    free = [c in secrets.TOKEN_CHARS for c in text]
    for pattern in (r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]{6,}""", "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"):
        for m in re.finditer(pattern, text):
            free[m.start() : m.end()] = [False] * (m.end() - m.start())
    out, a = [], 0
    while a < len(text):
        b = a
        while b < len(text) and free[b]:
            b += 1
        run = text[a:b]
        if credential(run):
            out.append((a, b))
        else:
            cuts = [i for i in range(len(run) + 1) if i in (0, len(run)) or run[i] in "=/.+-_" or run[i - 1] in "=/.+-_"]
            parts = sorted(((i, j) for i in cuts for j in cuts if i < j and run[i] not in "=/.+-_" and run[j - 1] not in "=/.+" and (j == len(run) or run[j] in "=/.+-_") and (i == 0 or run[i - 1] in "=/.+-_")), key=lambda x: (x[0] - x[1], x[0]))
            mine = []
            for i, j in parts:
                single = not any(c in "=/.+-_" for c in run[i:j])
                if (single or j - i <= model.most) and all(j <= x or i >= y for x, y in mine) and credential(run[i:j]):
                    mine.append((i, j))
            out += [(a + i, a + j) for i, j in mine]
        a = b + 1
    return sorted(out)


def test_format_spans_equal_brute_force(grammar):
    draw = random.Random(6)
    examples = [v for own in secrets.published(3).values() for v in own]
    texts = []
    for _ in range(60):
        words = [draw.choice([draw.choice(examples), draw.choice(examples) + draw.choice([".", "_.", "-", "=x"]), "x" * draw.randint(1, 30), "a/b.c", "é", "=" * 40, "token=" + draw.choice(examples), "0f" * draw.choice([6, 13])]) for _ in range(8)]
        texts.append(draw.choice([" ", "/", "=", "-", ", "]).join(words))
    found = 0
    for t in texts:
        got = [(a, b) for a, b, k in secrets.all_spans(t, grammar)[1] if k == "format"]
        assert got == brute_spans(t, grammar), t
        found += len(got)
    assert found > 100


def test_parts_cover_every_piece():
    run = "a" * 20 + "=" + "b" * 3 + "/" + "c" * 16
    assert secrets.parts_of(run, 16, 1024) == [(0, 24), (0, 20), (21, 41), (25, 41)]
    long = "/".join(["x" * 500, "y" * 2000, "z" * 16])
    assert set(secrets.parts_of(long, 16, 100)) == {(0, 500), (501, 2501), (2502, 2518)}
    assert secrets.parts_of("=" * 5000, 16, 100) == [] and (2, 7) in secrets.parts_of("=-aaa_-.=", 2, 9)


# ---------------------------------------------------------------- relative links (op3)


@pytest.mark.parametrize("target,want", [("index.html", "/d/e/index.html"), ("./x", "/d/e/x"), ("../x", "/d/x"), ("../../../x", "/x"), ("?id=3", "/d/e/p?id=3"), ("..", "/d/"), (".", "/d/e/"), ("/a/./b/../c?u=../v", "/a/c?u=../v"), ("q:1", None), ("mailto:x", None), ("#f", None), ("x/y#f", "/d/e/x/y"), ("//X.org/z", "x.org/z"), ("http://X.org/z", "x.org/z"), (".hidden/..x", "/d/e/.hidden/..x")])
def test_targets_are_resolved_against_the_address(spark, target, want):
    from pyspark.sql import functions as F

    got = spark.range(1).select(urls.resolved(F.lit(target), F.lit("https://n.io/d/e/p?q=/a/b#f")).alias("b")).first().b
    assert got == (want if want is None or want[0] != "/" else "n.io" + want)


def test_block_reaches_aliases_by_relative_links_and_later_tags(spark):
    rows = [
        (1, "https://x.org/es/a", "<meta http-equiv=refresh content='0; url=../index.html'>"), (2, "http://x.org/index.html", None),
        (3, "http://n.io/", "<link rel=canonical href='/one'><link rel=canonical href='http://x.org/es/b'>"), (4, "http://n.io/one", "<link rel='canonical' href='?id=3'>"), (5, "http://n.io/one?id=3", None),
        (6, "http://m.io", "<meta http-equiv='refresh' content='0; url=p'><meta http-equiv='refresh' content='5; url=//x.org/es/c'>"), (7, "http://m.io/p", None), (8, "http://m.io/q", "<link rel=canonical href='r'>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(df).collect()} == {i: "allow" if i == 8 else "block" for i in range(1, 9)}


# ---------------------------------------------------------------- quantiles of token counts (op8)


def test_histogram_query_answers_quantiles(spark, tmp_path):
    df, n = edge_docs(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(queries.op8_token_histogram(spark, str(tmp_path)).collect(), key=lambda r: r.context_limit)
    assert [r.share_within for r in rows] == [r.docs_within / n for r in rows] and rows[-1].share_within == 1.0
    shares = [0.1, 0.5, 0.9, 1.0]
    want = {r.share: r.n_tokens for r in tokens.quantiles(tokens.limits(tokens.histogram(df)), shares).collect()}
    assert {q: next(r.context_limit for r in rows if r.share_within >= q) for q in shares} == want


# ---------------------------------------------------------------- common shingles (pipeline)


@pytest.mark.parametrize("most", [64, 700])
def test_a_bucket_of_many_texts_is_cut_into_blocks(spark, most):
    """3,000 texts in one bucket, a tenth of them near copies: blocks connect what one task would connect."""
    draw = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = [draw.choices(words, k=draw.choice([20, 25, 31, 39, 49, 60])) for _ in range(2700)]
    for _ in range(300):
        near = list(draw.choice(texts))
        near[draw.randrange(len(near))] = "other"
        texts.append(near)
    line = "one line that all texts share"
    df = docs_of(spark, [line + " " + " ".join(t) for t in texts])
    method = simhash.NearCopies(most_texts=most, common=10**9)
    marked = method.described(df, np.zeros(0, np.uint64)).withColumn("node", F.col("doc_id"))
    # one shingle of the common line stands first in every text
    hot = marked.withColumn("first", F.concat(F.array(F.lit(7).cast("long")), "first"))
    parts = lambda m: {(r.node, r.component) for r in components(m.candidates(hot), "u", "v").collect()}
    want = parts(simhash.NearCopies(most_texts=10**9))
    assert parts(method) == want and len(want) > 400


def test_equal_and_unequal_fingerprints_over_blocks(spark):
    n = 4000
    rows = spark.range(n).select(F.col("id").alias("node"), F.xxhash64("id").alias("fp"), F.xxhash64("id", F.lit(1)).alias("fp2"), F.lit(100).cast("long").alias("size"), F.array(F.lit(5).cast("long")).alias("first"))
    method = simhash.NearCopies(most_texts=500)
    parts = lambda m: {(r.node, r.component) for r in components(m.candidates(rows), "u", "v").collect()}
    assert parts(method) == parts(simhash.NearCopies(most_texts=n))
    same = rows.withColumn("fp", F.lit(1).cast("long")).withColumn("fp2", F.lit(1).cast("long"))
    got = components(method.candidates(same), "u", "v").collect()
    assert len(got) == n and {r.component for r in got} == {0}


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_buckets_of_near_copies_are_searched_by_their_gray_order_trees(most, monkeypatch):
    draw, method, trees = np.random.default_rng(5), simhash.NearCopies(), []
    h = np.sort(np.repeat(draw.integers(-(2**62), 2**62, 40), [1, 2, 16, 17, 300] * 8))
    fps = tuple(draw.integers(0, 2**63, len(h), dtype=np.uint64) for _ in range(2))
    near = draw.random(len(h)) < 0.5
    for f in fps:
        f[near] = f[0] ^ (np.uint64(1) << draw.integers(0, 60, near.sum()).astype(np.uint64))
    size, node = draw.integers(90, 130, len(h)), np.arange(len(h))
    linked = simhash.GrayIndex.linked
    monkeypatch.setattr(simhash.GrayIndex, "linked", lambda self, distance, close: trees.append(distance) or linked(self, distance, close, most))
    edges = method.links(h, node, fps, size)
    a, b = np.triu_indices(len(h), 1)
    some = (h[a] == h[b]) & method.close(fps, size, a, b)
    want = simhash.merge(node.copy(), a[some], b[some])
    assert some.sum() > 1000 and (simhash.merge(node.copy(), edges[:, 0], edges[:, 1]) == want).all()
    assert trees == [method.distance] and len(edges) == (want != node).sum()
