"""Runs of one kind of character that are as long as texts get."""

import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, queries, secrets, tokens


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000, " \t\r\n\x0b　" * 200_000, "word" + " " * 1_000_000 + "word", " " * 600_000 + "."])
def test_histogram_takes_runs_of_white_space(spark, tmp_path, run):
    """The library's own matcher panics at these; op6's counts are compared with the library's up to its limit elsewhere."""
    rows = [(1, run), (2, "plain text"), (3, None), (4, run[: tokens.WHITE_RUN + 7] + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    by_id = {r.doc_id: r.n for r in bpe.encode(docs).select("doc_id", F.size("ids").alias("n")).collect()}
    library = tokens.encoding(bpe.default_path(), bpe.public_tokenizers.PATTERN)
    assert by_id[4] == len(library.encode_ordinary(rows[3][1]))
    got = {r.context_limit: r.n_docs for r in queries.op8_token_histogram(spark, str(tmp_path)).collect()}
    want = {}
    for n in by_id.values():
        want[n] = want.get(n, 0) + 1
    assert got == want


def test_histogram_of_ten_million_spaces(spark):
    docs = spark.createDataFrame([(1, 1)], "doc_id long, x long").select("doc_id", F.expr("repeat(' ', 10000000)").alias("text"))
    assert [tuple(r) for r in tokens.histogram(docs).collect()] == [(len(bpe.codec(bpe.default_path(), bpe.public_tokenizers.PATTERN).encode([" " * 10_000_000])[0]), 1)]


@pytest.fixture(scope="module")
def grammar(spark):
    """A corpus whose longest label has 20,000 characters: its length must not matter to other texts."""
    draw = random.Random(4)
    pick = lambda alphabet, n: "".join(draw.choices(alphabet, k=n))
    texts = [f"see {pick(secrets.LOWER, draw.randint(16, 24))} and {pick(secrets.LOWER, 9)}/{pick(secrets.LOWER, 12)}.html ok token = \"{pick('0123456789abcdef', 40)}\"" for _ in range(300)]
    texts += ["token=" + base64.b64encode(draw.randbytes(15_000)).decode()]
    return secrets.learnt(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_parts_scored_together_are_judged_as_one_by_one(grammar, monkeypatch):
    draw = random.Random(8)
    examples = [v for own in secrets.published(3).values() for v in own]
    plain = ["x" * 30, "q", "index", base64.b64encode(draw.randbytes(60)).decode(), "AKIA", "0f" * 11, "y" * 700, "__--"]
    found = 0
    for size, together in ((8, 1 << 18), (40, 64), (40, 1 << 18)):
        monkeypatch.setattr(secrets, "PARTS_AT_ONCE", together)
        for _ in range(6):
            run = "".join(draw.choice([draw.choice(examples), draw.choice(plain)]) + draw.choice("=/.+-_") for _ in range(size))
            want = [(a, b) for a, b in secrets.parts_of(run, grammar.least, grammar.most) if grammar.judged(run[a:b])]
            monkeypatch.setattr(secrets, "FEW_PARTS", 0)
            assert secrets.accepted(run, grammar) == want
            monkeypatch.undo()
            monkeypatch.setattr(secrets, "PARTS_AT_ONCE", together)
            assert secrets.accepted(run, grammar) == want
            found += len(want)
    assert found > 100


@pytest.mark.parametrize("glue", ["", "=/.+-_", "/", "-"])
def test_a_megabyte_of_base64_takes_time_in_proportion(grammar, glue):
    """Whatever the longest label; and a credential inside is found."""
    draw = random.Random(9)
    text = base64.b64encode(draw.randbytes(750_000)).decode()
    if glue:
        text = "".join(c if draw.random() < 0.9 else draw.choice(glue) for c in text)
    secret = secrets.published(1)["github"][0]
    assert grammar.most == secrets.LONGEST
    began = time.process_time()
    spans = secrets.all_spans(text[:500_000] + "/" + secret + "=" + text[500_000:], grammar)[1]
    took = time.process_time() - began
    assert any(a <= 500_001 and b >= 500_001 + len(secret) for a, b, k in spans if k == "format")
    assert len(spans) < 200 and took < 20  # seconds: about 2 where pieces are as long as base64 makes them


def test_long_values_are_not_remembered(grammar):
    grammar.seen.clear()
    secrets.all_spans("z" * 5000 + " " + "xy" * 20, grammar)
    assert set(map(len, grammar.seen)) == {40}
