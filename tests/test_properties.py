"""Random inputs against independent one-row-at-a-time versions."""

import random
import re

from pyspark.sql import functions as F

from lodestone.functions import citations as cite
from lodestone.operators.fusion import reciprocal_rank_fusion
from lodestone.operators.graph import EntityGraph


def test_fusion_of_random_rankings(spark):
    draw = random.Random(11)
    rows, want = [], {}
    for q in range(40):
        total, first, last = {}, {}, {}
        for n in range(draw.randint(1, 6)):
            for rank, c in enumerate(draw.sample("abcdefghij", draw.randint(1, 8)), 1):
                score = draw.random()
                rows.append((q, n, rank, c, score))
                total[c] = total.get(c, 0) + 1 / (60 + rank)
                first.setdefault(c, (n, rank))
                last[c] = score
        order = sorted(total, key=lambda c: (-round(total[c], 12), first[c]))
        want[q] = [(c, last[c]) for c in order]
    got = {}
    for r in reciprocal_rank_fusion(spark.createDataFrame(rows, "qid int, list_ord int, rank int, chunk_id string, score double")).orderBy("qid", "fused_rank").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, r.score))
    assert got == want


def render(draft, evidence):
    """Citations rendered by scanning the draft once per kind."""
    label = {n: f"[{p} p.{k}]" for n, (p, k) in enumerate(evidence, 1) if p}
    out, at = "", 0
    for m in re.finditer(r"\[E\d+(?:\s*,\s*E\d+)*\]", draft):
        out += draft[at : m.start()] + "".join(label.get(int(n), "") for n in re.findall(r"\d+", m[0]))
        at = m.end()
    draft, out, at = out + draft[at:], "", 0
    for m in re.finditer(r"\[([^\[\]]+\.pdf) p\.(\d+)\]", draft):
        out += draft[at : m.start()] + (m[0] if (m[1], int(m[2])) in evidence else "")
        at = m.end()
    text = out + draft[at:]
    while re.search(r"[ \t][ \t]", text):
        text = re.sub(r"[ \t][ \t]+", " ", text, count=1)
    for mark in ",.;:":
        while " " + mark in text:
            text = text.replace(" " + mark, mark)
    return text.strip()


def test_rendering_of_random_drafts(spark):
    draw = random.Random(12)
    parts = ["[E1]", "[E2, E1]", "[E3 ,E9]", "[E0]", "[e1]", "[E]", "[a.pdf p.1]", "[a.pdf p.2]", "[b.txt p.3]", "[c.pdf p.x]", " ", "  ", "\t", ",", ".", ";", "word", "\n", "[[E1]]", "$1", "\\"]
    evidence = [("a.pdf", 1), ("b.txt", 3), ("", 4), ("d e.pdf", 7)]
    drafts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, d, [{"paper": p, "page": k} for p, k in evidence]) for i, d in enumerate(drafts)], "i int, d string, e array<struct<paper:string,page:int>>")
    got = [r.a for r in df.select("i", cite.validate_citations(F.col("d"), F.col("e")).alias("a")).orderBy("i").collect()]
    assert got == [render(d, evidence) for d in drafts]


def test_graph_scores_of_random_corpora(spark):
    draw = random.Random(13)
    names = ["AA", "BB", "CC", "DD", "EE", "FF"]
    held = {f"c{i:02}": draw.sample(names, draw.randint(0, 4)) for i in range(25)}
    df = spark.createDataFrame([(c, "p", 1, i, ", ".join(n)) for i, (c, n) in enumerate(held.items())], "chunk_id string, paper string, page int, position int, text string")
    asked = draw.choices([*names, "ZZ"], k=3)
    score = {}
    for name in asked:
        if not any(name in n for n in held.values()):
            continue
        near = {o for n in held.values() if name in n for o in n if o != name}
        for c, n in held.items():
            s = (name in n) + 0.5 * len(near & set(n))
            if s:
                score[c] = score.get(c, 0) + s
    q = spark.createDataFrame([("q", i, n) for i, n in enumerate(asked)], "qid string, entity_no int, name string")
    got = [(r.chunk_id, r.score) for r in EntityGraph.build(df).search(q, 10).orderBy("rank").collect()]
    assert got == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:10]
