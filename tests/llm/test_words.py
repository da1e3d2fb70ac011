"""Operators on texts: SimHash, substrings, secrets, BPE, token counts, mixing, quality, against brute force and on edge cases."""

import base64
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing, quality, secrets, simhash, substrings, tokens
from lodestone.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, _row long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names operators might use themselves."""
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "x", 7, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", "  \n", "one", "Ünï word\x1cx", "a b c d", "a b c d", "word " * 5000, "x" * 3000, "日本語 テキスト"]


def edge_docs(spark):
    df = docs_of(spark, EDGES)
    odd = spark.createDataFrame([(None, "null id", None, None, None, None, None, None), (None, "null id", None, None, None, None, None, None), (3, "one", "en", "s0", 3, "x", 7, 1)], DOCS)
    return df.union(odd), len(EDGES) + 3


# ---------------------------------------------------------------- connected components


def test_components_of_random_graphs(spark):
    draw = random.Random(2)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 5)], "u long, v long"), "u", "v").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long"), "u", "v").count() == 0


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(shingles))


def groups_of(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprints_equal_brute_force(spark):
    got = [(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(docs_of(spark, EDGES)).orderBy("doc_id").collect()]
    assert got == [(i, f"{brute_fingerprint(t):016x}") for i, t in enumerate(EDGES)]


@pytest.mark.parametrize("method", [simhash.SimHash(), simhash.SimHash(bucket_rows=50, bucket_limit=20)])
def test_links_equal_brute_force_also_in_split_buckets(spark, method):
    draw = random.Random(4)
    centres = [draw.getrandbits(64) for _ in range(12)]
    fps = list({c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for c in centres for _ in range(25)} | {draw.getrandbits(64) for _ in range(80)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.fp: r.root for r in method.groups(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = groups_of(fps)
    assert len({(want[i], got[s]) for i, s in enumerate(signed)}) == len(set(want)) == len(set(got.values()))


def test_index_finds_every_pair():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 2**64, 3000, dtype=np.uint64)
    x[1500:] = x[:1500] ^ (np.uint64(1) << draw.integers(0, 64, 1500, dtype=np.uint64))
    mask = simhash.block_masks(10**6, 4)[1]
    moved = simhash.bits_first(x, mask)
    assert (np.bitwise_count(moved[:-1] ^ moved[1:]) == np.bitwise_count(x[:-1] ^ x[1:])).all()
    got = {(int(a), int(b)) for p, q in simhash.GrayIndex(moved).search(moved, 4, chunk=700) for a, b in zip(p, q, strict=True)}
    want = {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4)}
    assert got == want


@pytest.mark.parametrize("n", [10, 2**30, 2**40, 2**60])
def test_block_masks_cover_every_difference(n):
    masks, draw = simhash.block_masks(n, 4), random.Random(n)
    for _ in range(2000):
        differ = sum(1 << b for b in draw.sample(range(64), 4))
        assert any(not m & differ for m in masks)


def test_simhash_edge_cases(spark):
    df, n = edge_docs(spark)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == n
    zero = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {0}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    left = kept.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == [(False, i) for i in (0, 3, 4, 5, 7, 8, 9)] + [(True, 0)]
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.deduplicated(df.limit(0)).count() == 0


# ---------------------------------------------------------------- substrings


def brute_removed(texts, k):
    words = [WORD.findall(t or "") for t in texts]
    starts = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        hit = [False] * len(w)
        for i in range(len(w) - k + 1):
            if starts[tuple(w[i : i + k])] > 1:
                hit[i : i + k] = [True] * k
        out.append((len(w), sum(hit), " ".join(x for x, h in zip(w, hit, strict=True) if not h)))
    return out


@pytest.mark.parametrize("method", [substrings.Windows(window=7, seed_words=3), substrings.Windows(window=7, seed_words=7, bucket_bytes=2000, group_bytes=500), substrings.Windows(window=35), substrings.Windows(window=7, seed_words=2, cells=1 << 17), substrings.Windows(window=7, seed_words=3, cells=4)])
def test_removed_words_equal_brute_force(spark, method):
    draw = random.Random(method.window)
    passage = [draw.choice("abcdefghij") + str(draw.randint(0, 9)) for _ in range(60)]
    texts = []
    for _ in range(60):
        own = draw.choices(["x", "yy", "zé", "w1", "w2", "w3"], k=draw.randint(0, 80))
        if draw.random() < 0.5:
            a = draw.randint(0, 20)
            at = draw.randint(0, len(own))
            own[at:at] = passage[a : a + draw.randint(0, 45)]
        texts.append(draw.choice([" ", "\n", " \t "]).join(own))
    texts += ["rep " * 90, "only once " * 3, *EDGES]
    rows = substrings.removed(docs_of(spark, texts), method).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in rows] == brute_removed(texts, method.window)


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch, spark):
    monkeypatch.setattr(substrings.Rolling, "__call__", lambda self, first, last: np.zeros(len(first), np.uint64))
    method = substrings.Windows(window=3, seed_words=2)
    import struct

    import pyarrow as pa
    import zstandard

    strings = [b"a b c d", b"b c d", b"x y z"]
    blob = zstandard.ZstdCompressor().compress(struct.pack("<I", 3) + bytes(3) + b"\n".join(strings) + b"\n")
    got = method.count(pa.table({"bucket": [0], "packed": pa.array([blob], pa.binary())}))
    assert sorted(got.column("bits").to_pylist()) == [b"\x00\x01", b"\x01"]


def test_substring_edge_cases(spark):
    df, n = edge_docs(spark)
    rows = substrings.removed(df).collect()
    assert len(rows) == n
    assert [(r.n_words, r.n_removed) for r in rows if r.doc_id == 7] == [(5000, 5000)]
    assert substrings.removed(df.limit(0)).count() == 0
    twice = docs_of(spark, [" ".join(f"w{i}" for i in range(50))])
    assert [(r.n_words, r.n_removed, r.kept) for r in substrings.removed(twice.union(twice)).collect()] == [(50, 50, "")] * 2


# ---------------------------------------------------------------- secrets


def brute_base(t):
    t = t or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SECRETS = ["é token = \"" + "0f" * 20 + "\" x", "PassWord:abcdef API_KEY='zzzzzzz'", "token=token: abcdefgh", "secret=ab secret=abcdefg", "AKIA" + "Q" * 15 + " AKIA" + "Q" * 16, "ab" * 12, "ab" * 11 + "a", "paſſword=abcdefgh toKen=abcdefgh", "apikey==abc123", "日本 passwd  =  \"a.b-c_d/e+f=\""]


def test_base_spans_equal_brute_force(spark):
    texts = SECRETS + EDGES
    df = docs_of(spark, texts)
    rows = secrets.found(df, secrets.learnt(df)).orderBy("doc_id").collect()
    assert [r.base for r in rows] == [brute_base(t) for t in texts]
    assert [(r.n_assign, r.n_access, r.n_hex) for r in rows][0] == (1, 0, 1)


def test_automata_know_formats_and_leave_words_alone(spark):
    draw = random.Random(9)
    pick = lambda alphabet, n: "".join(draw.choices(alphabet, k=n))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    ordinary = [pick(letters, draw.randint(16, 24)) for _ in range(400)] + [pick(digits, 16) for _ in range(200)]
    texts = [f"see {o} and password={pick('0123456789abcdef', draw.choice([18, 20]))} ok" for o in ordinary]
    model = secrets.learnt(docs_of(spark, texts))
    assert sum(model.is_credential("ghp_" + pick(letters + digits + letters.upper(), 36)) for _ in range(100)) >= 90
    assert sum(model.is_credential(pick("0123456789abcdef", 20)) for _ in range(100)) >= 90
    assert sum(model.is_credential(pick(letters, 18)) for _ in range(200)) <= 2
    assert sum(model.is_credential(pick(digits, 16)) for _ in range(200)) <= 4


def test_automaton_is_a_distribution():
    a = secrets.infer(Counter({"ab": 50, "abb": 30, "b": 20}))
    assert -30 < a.loglik("ab") < -0.3 and a.loglik("ab") > a.loglik("ba") and a.loglik("") < -1
    for arcs, end, other in zip(a.arcs, a.end, a.other, strict=True):
        assert abs(sum(np.exp(p) for _, p in arcs.values()) + np.exp(end) + len(secrets.TOKEN_CHARS) * np.exp(other) - 1) < 0.05


def test_redaction_keeps_rows_columns_and_clean_texts(spark):
    df, n = edge_docs(spark)
    df = df.union(docs_of(spark, ["x token=abcdefgh y", "a " + "0f" * 20 + " b AKIA" + "Q" * 16]))
    got = secrets.redacted(df, secrets.learnt(df))
    assert got.columns == df.columns and got.count() == n + 2
    texts = {r.text: r.n_chars for r in got.collect()}
    assert texts["x [REDACTED] y"] == 14 and "a [REDACTED] b [REDACTED]" in texts
    assert {t for t in EDGES} <= set(texts)
    none = df.limit(0)
    assert secrets.found(none, secrets.learnt(none)).count() == secrets.redacted(none, secrets.learnt(none)).count() == 0


# ---------------------------------------------------------------- BPE and token counts


@pytest.fixture(scope="module")
def library():
    with open(bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz():
    draw = random.Random(6)
    alphabet = "ab \n\t'sé日🎉1٣.,  \x1c\x85　\xa0\x0b<|endoftext|>tion"
    return ["".join(draw.choices(alphabet, k=draw.randint(0, 50))) for _ in range(400)] + ["y" * 5000, "ab" * 700, "".join(draw.choices("etaoin", k=900)), *[t for t in EDGES if t is not None], *SECRETS]


def test_ids_equal_the_library_and_decode_back(spark, library):
    texts = [*fuzz(), None]
    df = docs_of(spark, texts)
    for encoded in (bpe.decode(bpe.encode(df)), bpe.round_trip(df)):
        rows = encoded.orderBy("doc_id").collect()
        assert [r.ids for r in rows] == [library.encode_ordinary(t or "") for t in texts]
        assert [bytes(r.decoded) for r in rows] == [(t or "").encode() for t in texts]


def test_codec_forgets_and_goes_on(monkeypatch, library):
    monkeypatch.setattr(bpe, "PIECES", 50)
    monkeypatch.setattr(bpe, "STEP_ROWS", 64)
    codec = bpe.Codec(bpe.default_path(), public_tokenizers.PATTERN)
    for _ in range(3):
        for at in range(0, 200, 20):
            texts = fuzz()[at : at + 20]
            ids, counts = codec.encode(texts)
            assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
            assert codec.decode(ids, counts) == [t.encode() for t in texts]


def test_bpe_edge_cases(spark):
    df, n = edge_docs(spark)
    assert bpe.encode(df).count() == n and bpe.round_trip(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(odd).orderBy("doc_id").collect()] == [b"", b"", b"!"]
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(3, [99999999, 0])], "doc_id long, ids array<int>")).collect()


def test_token_histogram(spark, library):
    df, n = edge_docs(spark)
    lengths = sorted(len(library.encode_ordinary(r.text or "")) for r in df.collect())
    table = tokens.limits(tokens.histogram(df)).orderBy("context_limit").collect()
    assert [(r.context_limit, r.n_docs) for r in table] == sorted(Counter(lengths).items())
    for r in table:
        limit = r.context_limit
        assert (r.docs_within, r.docs_beyond) == (sum(x <= limit for x in lengths), sum(x > limit for x in lengths))
        assert (r.tokens_within, r.tokens_beyond, r.truncated_total) == (sum(x for x in lengths if x <= limit), sum(x for x in lengths if x > limit), sum(min(x, limit) for x in lengths))
    frame = tokens.limits(tokens.histogram(df))
    asked = [0, 1, 2, 3, 100, 10**6]
    assert {r.context_limit: r.truncated_total for r in tokens.at(frame, asked).collect()} == {x: sum(min(y, x) for y in lengths) for x in asked}
    got = {r.share: r.n_tokens for r in tokens.quantiles(frame, [0.5, 1.0]).collect()}
    assert got == {0.5: lengths[-(-n // 2) - 1], 1.0: lengths[-1]}
    none = tokens.limits(tokens.histogram(df.limit(0)))
    assert none.count() == 0 and tokens.at(none, [5]).first().truncated_total == 0 and tokens.quantiles(none, [0.5]).first().n_tokens is None


# ---------------------------------------------------------------- mixing


def filled(sizes, weights, times=3):
    """Targets by sharing and resharing."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / w >= times * sizes[i]}
        if not full:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in full:
            target[i] = times * sizes[i]
            left -= target[i]
        open_ -= full
    return target


@pytest.mark.parametrize("buckets", [4096, 4])
def test_mix_meets_its_targets(spark, buckets):
    draw = random.Random(8)
    source = lambda: draw.choices(["é", "a", "b", None, "zz"], [40, 30, 3, 20, 7])[0]
    rows = [(i, "w " * draw.randint(0, 60), source()) for i in range(1500)] + [(5000, "", "empty"), (5001, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    method = mixing.Mixer(buckets=buckets)
    got = mixing.mix(df, method).collect()
    assert sorted(got) == sorted(mixing.mix(df.repartition(7), method).collect())
    size = {i: len((t or "").split()) for i, t, _ in rows}
    order = ["a", "b", "empty", "zz", "é", None]
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in order}
    target = dict(zip(order, filled([total[s] for s in order], [1, 2, 3, 1, 2, 3]), strict=True))
    by = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = by[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[s] += r.taken
        epochs = int(target[s] // total[s]) if total[s] else 0
        assert r.size == 0 or r.taken // r.size in (epochs, epochs + 1)
    for s in order:
        assert abs(taken[s] - target[s]) <= 30


def test_mixed_documents_repeat_rows_with_all_columns(spark):
    df, _ = edge_docs(spark)
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect())[7] >= 1
    want = {(r.doc_id, r.size): r.taken for r in mixing.mix(df).collect()}
    for i, n in Counter(r.doc_id for r in got.collect() if r.doc_id == 7).items():
        assert n * 5000 == want[i, 5000]
    assert mixing.mix(df.limit(0)).count() == mixing.mixed_documents(df.limit(0)).count() == 0


def test_heavier_documents_come_first(spark):
    rows = [(i, ("ok " * 20) if i % 2 else ("## ok " * 10), "a") for i in range(2000)] + [(i, "w " * 20, "b") for i in range(2000, 2400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.Mixer(weights=(1.0, 2.0)))
    share = {r.odd: r.n for r in got.where("doc_id < 2000 and taken > 0").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.count("*").alias("n")).collect()}
    assert share[1] > 1.5 * share[0]


# ---------------------------------------------------------------- quality


def corpus(n, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 8)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(draw.randint(20, 200))]
        good = draw.random() < 0.75
        if not good:
            words = draw.choice([[w.upper() + "!!" for w in words], [w + draw.choice(["###", "%%%"]) for w in words], [words[i // 9] for i in range(len(words))]])
        out.append((" ".join(words).capitalize() if good else " ".join(words), int(good)))
    return out


def test_discriminant_on_held_out_documents(spark):
    rows = corpus(900, 3)
    df = docs_of(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(rows)] + [(None, 1), (99999, 0), (1, None)], "doc_id long, quality int")
    described = quality.described(df)
    model = quality.learnt(described, quality.taught(labels))
    got = quality.scored(described, model).select("doc_id", "score", quality.held_out().alias("held")).collect()
    held = [(r.score >= 0.7, rows[r.doc_id][1]) for r in got if r.held]
    assert len(got) == 900 and len(held) > 150 and sum(p == q for p, q in held) / len(held) > 0.97
    kept = quality.accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score >= 0.7}


def test_density_equals_the_definition():
    draw = np.random.default_rng(0)
    d = len(quality.NAMES)
    x, y = draw.normal(size=(400, d)) @ draw.normal(size=(d, d)), (draw.random(400) < 0.7).astype(int)
    x[y == 0] += 2
    m = quality.fit_arrays(x, y, shrink=0.0, ridge=0.0, temperature=1.0)
    z = (x - m.centre) / m.scale
    density = []
    for k in (0, 1):
        own = z[y == k]
        c = np.cov(own.T, bias=True)
        diff = z - own.mean(axis=0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", diff, np.linalg.inv(c), diff) + np.linalg.slogdet(c)[1]))
    odds = density[1] - density[0] + np.log(y.mean() / (1 - y.mean()))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-np.clip(odds, -500, 500))), atol=1e-6)


def test_quality_edge_cases(spark):
    df, n = edge_docs(spark)
    described = quality.described(df)
    for labels in ([], [(3, 1)], [(3, 0)], [(3, 1), (5, 0)]):
        model = quality.learnt(described, spark.createDataFrame(labels, "doc_id long, quality int"))
        scores = [r.score for r in quality.scored(described, model).collect()]
        assert len(scores) == n and all(0 <= s <= 1 for s in scores)
    assert quality.scored(quality.described(df.limit(0)), model).count() == 0
    assert len(quality.statistics(b"")) == len(quality.NAMES) and all(np.isfinite(quality.statistics(b"\xc3" * 3)))


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(200).select("id", quality.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


