"""Rankings put together: reciprocal rank fusion, reranking, evidence of two rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import clean_text
from lodestone.operators.ranking import best_first, top_k

RRF_K = 60


def reciprocal_rank_fusion(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """rankings (qid, list_ord, rank, chunk_id, score) -> (qid, fused_rank, chunk_id, rrf, score).

    rrf adds 1 / (k + rank) over all appearances; ties keep the order of first appearance; score is the last list's.
    """
    fused = rankings.groupBy("qid", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"),
        F.min(F.struct("list_ord", "rank")).alias("first"),
        F.max_by("score", F.struct("list_ord", "rank")).alias("score"),
    )
    return top_k(fused, ["qid"], [best_first("rrf", 12), F.col("first")], 2**31 - 1, "fused_rank").select("qid", "fused_rank", "chunk_id", "rrf", "score")


def rerank(queries: DataFrame, candidates: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """queries (qid, query), candidates (qid, fused_rank, text, ...) -> candidates with score and rank.

    A candidate's score is its best over the qid's non-blank queries. scorer(query, text) is a column: an expression or a
    pandas UDF, which gives as many scores as it gets pairs or fails. Ties keep the candidates' order. A scorer that has an attempt() is
    asked by that: the candidates then have a column error, null where there is none, and those without a score stay, ranked last.
    """
    asked = queries.select("qid", clean_text(F.col("query")).alias("query")).where("query <> ''")
    pairs = candidates.drop("score").join(asked, "qid")
    keys = [c for c in candidates.columns if c != "score"]
    attempt = getattr(scorer, "attempt", None)
    if attempt is None:
        best = pairs.withColumn("score", scorer(F.col("query"), F.col("text")).cast("double")).groupBy(*keys).agg(F.max("score").alias("score"))
    else:
        tried = pairs.withColumn("tried", attempt(F.col("query"), F.col("text")))
        best = tried.groupBy(*keys).agg(F.max("tried.score").alias("score"), F.max("tried.error").alias("error"))
    return top_k(best, ["qid"], [F.col("score").desc(), F.col("fused_rank")], 2**31 - 1)


def merge_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (qid, slot, chunk_id, score, ...) -> one row per chunk: the better score (old if equal), at the place of its first
    appearance, old evidence before new. Adds merged_slot."""
    both = old.withColumn("round", F.lit(0)).unionByName(new.withColumn("round", F.lit(1)))
    rest = [c for c in old.columns if c not in ("qid", "chunk_id", "slot")]
    best = F.max_by(F.struct(*rest), F.struct("score", -F.col("round")))
    kept = both.groupBy("qid", "chunk_id").agg(F.min(F.struct("round", "slot")).alias("place"), best.alias("best"))
    return top_k(kept, ["qid"], [F.col("place")], 2**31 - 1, "merged_slot").select("qid", "chunk_id", "merged_slot", *[F.col(f"best.{c}").alias(c) for c in rest])


def unique_counts(rankings: DataFrame) -> DataFrame:
    """(qid, retriever, chunks): different chunks per retriever."""
    return rankings.groupBy("qid", "retriever").agg(F.countDistinct("chunk_id").alias("chunks"))
