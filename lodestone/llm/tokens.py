"""Token counts: the exact histogram of encoded lengths, and what its running sums answer.

Every whole text is encoded once, and only its length goes on: counts per length are added up before the shuffle, so the
histogram has as many rows as there are different lengths, whatever the corpus. Suffix sums over it answer, exactly and for
every context limit, how many documents and tokens are within or beyond it, what is left when documents are cut at it,
and every quantile.

The library's matcher keeps a state for every character of a run of white space and gives up at some 10^6, so texts with runs of
WHITE_RUN characters or more are encoded by op6's codec, which gives the same ids at any length.

Defined cases: a null or empty text has length 0; repeated rows count as often as they occur; an empty table gives an empty
histogram, totals 0 and null quantiles; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm.bpe import codec, default_path
from lodestone.llm.common import cut, per_batch

#: So many lengths share a block of the running sums.
BLOCK = 64
#: Runs of white space of so many characters go to op6's codec.
WHITE_RUN = 10_000
LONG_WHITE = re.compile(rf"\s{{{WHITE_RUN}}}")


@functools.cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(n_tokens), one row per document."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, texts = encoding(path, pattern).encode_ordinary, batch.column("text").to_pylist()
        wide = [i for i, t in enumerate(texts) if t and len(t) >= WHITE_RUN and LONG_WHITE.search(t)]
        n = np.zeros(len(texts), np.int64)
        if wide:
            n[wide] = codec(path, pattern).encode([texts[i] for i in wide])[1]
        for i in set(range(len(texts))).difference(wide):
            n[i] = len(encode(texts[i])) if texts[i] else 0
        return pa.RecordBatch.from_arrays([pa.array(n)], names=["n_tokens"])

    return docs.select("text").mapInArrow(per_batch(run), "n_tokens long")


def histogram(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(n_tokens, n_docs), one row per length that occurs."""
    return lengths(docs, path, pattern).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length as context limit: documents and tokens within it, beyond it, the tokens left if all are cut at it, and
    share_within, the share of all documents within it (the length is the q-quantile for every q up to that and above the share
    before). percentile_from and percentile_to: it is the p-th percentile for the whole p from the one to the other; null if for none.

    What is beyond a length is the total less the running sum. Running sums are taken over blocks of lengths first (a row per
    block) and then within each block, so no task holds the whole histogram, however many lengths there are.
    """
    h = cut(hist).select(F.col("n_tokens").alias("context_limit"), "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("_tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("_block"))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    total = blocks.agg(F.sum("_d").alias("_docs"), F.sum("_t").alias("_all"))
    earlier, up = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("_block").orderBy("context_limit").rowsBetween(W.unboundedPreceding, 0)
    sums = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    before = blocks.select("_block", sums("_d").alias("_d_before"), sums("_t").alias("_t_before")).crossJoin(F.broadcast(total))  # one row
    h = h.join(before, "_block").withColumns({"docs_within": F.col("_d_before") + F.sum("n_docs").over(up), "tokens_within": F.col("_t_before") + F.sum("_tokens").over(up)})
    h = h.withColumns({"docs_beyond": F.col("_docs") - F.col("docs_within"), "tokens_beyond": F.col("_all") - F.col("tokens_within"), "_from": F.expr("(docs_within - n_docs) * 100 div _docs + 1"), "_to": F.expr("docs_within * 100 div _docs")})
    some = F.col("_from") <= F.col("_to")
    return h.select(
        "context_limit", "n_docs", "docs_within", "docs_beyond", "tokens_within", "tokens_beyond", (F.col("tokens_within") + F.col("context_limit") * F.col("docs_beyond")).alias("truncated_total"),
        (F.col("docs_within") / F.col("_docs")).alias("share_within"), F.when(some, F.col("_from")).cast("int").alias("percentile_from"), F.when(some, F.col("_to")).cast("int").alias("percentile_to"),
    )


def at(table: DataFrame, context_limits: list[int]) -> DataFrame:
    """What limits() gives, for any context limits: (context_limit, docs_within, tokens_within, truncated_total)."""
    spark = table.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in context_limits], "wanted long").distinct()
    sums = table.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("n_docs") * F.col("context_limit")), F.lit(0)).alias("tokens"))
    below = table.join(F.broadcast(wanted), F.col("context_limit") <= F.col("wanted"), "right").groupBy("wanted").agg(F.coalesce(F.max("docs_within"), F.lit(0)).alias("docs_within"), F.coalesce(F.max("tokens_within"), F.lit(0)).alias("tokens_within"))
    return below.crossJoin(F.broadcast(sums)).select(F.col("wanted").alias("context_limit"), "docs_within", "tokens_within", (F.col("tokens_within") + F.col("wanted") * (F.col("docs") - F.col("docs_within"))).alias("truncated_total"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least that share of the documents doesn't exceed; null without documents."""
    wanted = table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    total = table.agg(F.sum("n_docs").alias("docs"))
    enough = F.col("docs_within") >= F.ceil(F.col("share") * F.col("docs"))
    return wanted.crossJoin(F.broadcast(total)).join(table, enough, "left").groupBy("share").agg(F.min("context_limit").alias("n_tokens"))
