"""Search by windows, permuted shards and repaired conversations against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversations, lexical, sharding
from lodestone.llm.common import numbered

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked search ---------------------------------------------------------------------------------------------------------


def brute_search(queries, docs, k=10):
    words = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    words = [(i, Counter(w)) for i, w in words if w]
    n_docs, total = len(words), sum(w.total() for _, w in words)
    out = []
    for qid, text in queries:
        scores = []
        for i, own in words:
            score = 0
            for term, times in Counter(TERM.findall((text or "").translate(LOWER))).items():
                if own[term]:
                    df = sum(term in w for _, w in words)
                    m = 25 + 75 * own.total() * n_docs // total
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * own[term] // (1000 * own[term] + 8 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(qid, r, i if some else None, -s) for r, (s, some, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("window, pairs", [(16_384, 2_000_000), (3, 7), (8, 1)])
def test_search_equals_brute_force(spark, window, pairs):
    pick = random.Random(window)
    vocabulary = ["the", "of", "Äpfel", "ß7", "x", "YES", "no", "漢字", *(f"w{i}" for i in range(40))]
    text = lambda n: pick.choice([" ", "-", "\x00", "__", "\n\t"]).join(pick.choices(vocabulary, [20, 10] + [1] * (len(vocabulary) - 2), k=n))
    docs = [(i, text(pick.randint(1, 40))) for i in range(120)]
    docs += [(i + 200, docs[i][1]) for i in range(30)]  # ties
    docs += [(5, "the the w1"), (5, "the w1 w1"), (None, "w1 the"), (None, "w1 the"), (300, None), (301, ""), (302, "-.!"), (303, "the " * 30_000)]
    queries = [(i, text(pick.randint(1, 12))) for i in range(25)] + [(3, "the w1"), (None, "w1 w1 the"), (90, None), (91, "unseen"), (92, ""), (93, "the w1")]
    search = lexical.LexicalSearch(window=window, block_pairs=pairs)
    found = search.search(spark.createDataFrame(queries, "qid long, text string").withColumn("score", F.lit(1)), spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("n", F.lit("own")))
    assert ordered(found.collect()) == ordered(brute_search(queries, docs))


def test_search_without_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "qid long, text string")
    some = spark.createDataFrame([(1, "a")], "qid long, text string")
    search = lexical.LexicalSearch()
    assert search.search(none, docs).count() == 0
    assert search.search(some, docs.where("false")).count() == 0
    assert search.search(some, docs.select("doc_id", F.lit(None).cast("string").alias("text"))).count() == 0


def test_long_texts_are_split_between_terms():
    text = (b"ab1 " * 400_000) + b"z" * (3 << 20) + b" End"
    parts = list(lexical.terms_of(text))
    assert len(parts) > 2 and [t.decode() for part in parts for t in part] == TERM.findall(text.decode().translate(LOWER))


# --- shards ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 24, 25, 26, 1000, 40_000])
def test_permutation_and_its_inverse(n):
    p = sharding.Permutation(n)
    there = p.position(np.arange(n))
    assert sorted(there.tolist()) == list(range(n))
    assert p.number(there).tolist() == list(range(n))
    if n > 1000:
        assert (sharding.Permutation(n, seed=1).position(np.arange(n)) != there).mean() > 0.99
        assert abs(np.corrcoef(np.arange(n), there)[0, 1]) < 0.03  # shuffled
        assert np.bincount(there[:4000] % 40).min() > 50  # neighbours are dealt over all shards


def test_permutation_of_very_many():
    p = sharding.Permutation(10**18)
    x = np.array([0, 1, 10**18 - 1, 123_456_789_012_345_678])
    assert p.number(p.position(x)).tolist() == x.tolist() and p.position(x).max() < 10**18
    with pytest.raises(ValueError):
        p.position(np.array([10**18]))
    with pytest.raises(ValueError):
        sharding.Permutation(2**63)


def test_numbers_follow_the_order(spark):
    rows = [(i % 7 if i % 3 else None, f"t{i}") for i in range(500)] + [(3, "same")] * 400
    df = spark.createDataFrame(rows, "k long, t string")
    got = {(r.number, r.k, r.t) for r in numbered(df.repartition(9), [F.col("k").asc_nulls_first(), F.col("t")], "number").collect()}
    assert got == {(i, k, t) for i, (k, t) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}


def test_shards(spark):
    rows = [(i, f"text {i}" if i % 4 else "hot text", i) for i in range(997)] + [(None, None, 1), (7, "again", 2), (8, "hot text", 8), (None, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    first = sharding.Shards().placed(docs, ["doc_id"]).collect()
    again = sharding.Shards().placed(docs.repartition(11), ["doc_id"]).collect()
    assert ordered((r.number, r.shard, r.slot, *r.row) for r in first) == ordered((r.number, r.shard, r.slot, *r.row) for r in again)
    sizes = Counter(r.shard for r in first)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in first if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert ordered(tuple(r.row) for r in first) == ordered(rows)
    place = {(r.shard, r.slot): r.number for r in first}
    asked = spark.createDataFrame([*place, (40, 0), (-1, 0), (0, 26), (3, -1)], "shard int, slot long")
    assert {(r.shard, r.slot): r.number for r in sharding.Shards().numbers(asked, len(rows)).collect()} == place | {(40, 0): None, (-1, 0): None, (0, 26): None, (3, -1): None}
    assert sharding.Shards().placed(docs.where("false"), ["doc_id"]).count() == 0
    one = docs.where("doc_id = 3").select(sharding.size_of(F.col("text")).alias("s"), sharding.crc_of(F.col("text")).alias("c")).first()
    assert tuple(one) == (22, zlib.crc32(b"text 3"))


# --- conversations ---------------------------------------------------------------------------------------------------------


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            out += [(conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    return out


def brute_repair(rows):
    """The report of one conversation, by trying all insertions and edits, a turn at a time."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    def state(initials):
        return initials[:1] if initials in ("s", "") else initials[-1]

    def legal(initials):
        return re.fullmatch(r"s?(ua)*u?", initials)

    def grown(best):
        for _ in range(4):
            for own in [x for xs in best.values() for x in xs]:
                for role in ("user", "assistant"):
                    initials = own[3] + role[0]
                    if legal(initials):
                        add(best, (own[0] + 2, own[1] + "I", (*own[2], f"{role}:"), initials))
        return best

    def add(best, way):
        key = state(way[3])
        if key not in best or way[:2] < best[key][0][:2]:
            best[key] = [way]

    best = grown({"": [(0, "", (), "")]})  # by the last initial: (cost, audit, lines, initials)
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        now = {}
        for cost, audit, lines, initials in [x for xs in best.values() for x in xs]:
            add(now, (cost + 3, audit + "D", lines, initials))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and legal(initials + role[0]):
                    add(now, (cost + more, audit + "K", (*lines, f"{role}:{text}"), initials + role[0]))
                for new in ("user", "assistant"):
                    if legal(initials + new[0]):
                        add(now, (cost + 2 + more, audit + "R", (*lines, f"{new}:{text}"), initials + new[0]))
        best = grown(now)
    cost, audit, lines, _ = min(x for key in ("", "a") for x in best.get(key, []))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(pick, conv, n):
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", "s", None]
    texts = ["Yes.", "No", "Why?\n", " \t", "", None, "Same text.", "Ende!\x0b", "a ", "x.  ", "ends:with\nlines."]
    out = [(conv, t, pick.choice(roles[:3] if pick.random() < 0.8 else roles), pick.choice(texts) if pick.random() < 0.4 else f"turn {t}{pick.choice('.!?:')}") for t in range(n)]
    return [(c, None if pick.random() < 0.05 else t + pick.choice((0, 0, 0, 1)), r, x) for c, t, r, x in out]


def expected(rows):
    hit = {}
    for r in brute_damage(rows):
        hit.setdefault(r[0], []).append(r)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {conv: brute_repair(hit[conv]) if conv in hit else none for conv in {r[0] for r in rows}}


@pytest.mark.parametrize("repair", [conversations.Repair(), conversations.Repair(long_rows=5, segment=4, fan_in=2), conversations.Repair(long_rows=0, segment=2, fan_in=3), conversations.Repair(long_bytes=60, segment=1)])
def test_repair_equals_brute_force(spark, repair):
    pick = random.Random(5)
    rows = [r for conv in range(120) for r in made(pick, conv, pick.randint(1, 9))] + made(pick, None, 6) + made(pick, -1, 70) + [(500, None, None, None), (501, 3, "user", "Only one.")]
    rows += [(502, None, "user", "The same.")] * 40 + [(503, 0, "user", "u."), (503, 0, "user", "u."), (503, 0, "assistant", "u.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).repartition(6)
    got = conversations.digests(repair.repaired(conversations.damaged(table)), table).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected(rows) and len(got) == len({r[0] for r in rows})


def test_all_small_conversations(spark):
    """Every sequence of up to four roles, right and truncated."""
    rows = []
    for conv, roles in enumerate(itertools.chain.from_iterable(itertools.product(("system", "user", "assistant", "x"), repeat=n) for n in range(1, 5))):
        rows += [(conv, t, role, f"text {t}" + "."[: (conv + t) % 2]) for t, role in enumerate(roles)]
    got = conversations.Repair().repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("not long").collect()
    own = {}
    for r in rows:
        own.setdefault(r[0], []).append(r)
    assert {r.conv_id: tuple(r.report) for r in got} == {c: brute_repair(rs)[:-1] for c, rs in own.items()}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.turns)) for r in got)


def test_products_are_associative():
    pick = random.Random(1)
    for _ in range(50):
        turns = [conversations.turn_matrix(pick.choice(["s", "u", "a", ""]), pick.random() < 0.3, pick.random() < 0.3) for _ in range(pick.randint(1, 9))]
        left = conversations.UNIT
        for t in turns:
            left = conversations.times(left, t)
        assert left == conversations.product(turns)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digests(conversations.Repair().repaired(conversations.damaged(none)), none).count() == 0


def test_a_long_text_makes_a_conversation_long(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "?"), (1, 1, "assistant", "Yes."), (2, 0, "user", "a?"), (2, 1, "assistant", "b.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = conversations.Repair(long_bytes=1 << 20).repaired(table).collect()
    assert {(r.conv_id, r.long) for r in done} == {(1, True), (2, False)}
    assert [r.report.audit for r in done if r.report] == ["KK", "KK"]
