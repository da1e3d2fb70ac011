"""Questions answered in batches: plan, retrieve, verify, retry a bounded number of times, write.

Each step takes and returns one row per question, and all questions that are at a step take it together. The loop over
retries runs on the driver and looks at no data but whether any question goes on.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import entities
from lodestone.operators import dense
from lodestone.operators.address import block_of, look_up, number_of_blocks
from lodestone.operators.fusion import merge_evidence, reciprocal_rank_fusion, rerank
from lodestone.operators.ranking import top_k
from lodestone.operators.select import select_evidence
from lodestone.plans import prompts
from lodestone.plans.answering import allowed_ids, write
from lodestone.plans.coverage import route_after_research, route_after_verification, verify
from lodestone.plans.planning import RETRIEVERS, plan_questions
from lodestone.schema import EVIDENCE, ORDER, PLAN, VERIFICATION
from lodestone.session import Settings, cut
from lodestone.sources.providers import Completer, Encoder, ModelUnavailableError, Scorer, ServiceError, encodings
from lodestone.sources.store import Indexes, same_encoder

PER_QUERY, MAX_CANDIDATES = 8, 30

#: queries (qid, query), candidates (qid, fused_rank, chunk_id, paper, page, text), scorer -> candidates with score and rank.
Reranker = Callable[[DataFrame, DataFrame, Scorer | None], DataFrame]


class PlanError(ValueError):
    """A model's answer that breaks its contract."""


#: What stopped a question: the step, whether the service gave no answer (service) or one that breaks its contract (contract), and what was wrong.
ERROR = "struct<step:string,kind:string,message:string>"


@dataclass(frozen=True)
class RetrievalEngine:
    """chunks (chunk_id, paper, page, position, text), their indexes, and the encoder of queries."""

    chunks: DataFrame
    indexes: Indexes
    encoder: Encoder | None = None
    top_k: int = 20

    def sparse_search(self, queries: DataFrame) -> DataFrame:
        return self.indexes.sparse.search(queries, self.top_k)

    def dense_search_many(self, queries: DataFrame) -> DataFrame:
        """queries (qid, text) -> (qid, rank, chunk_id, score)."""
        if self.encoder is None:
            raise ModelUnavailableError("no encoder given for queries")
        same_encoder(self.indexes, self.encoder)
        encoded = encodings(self.encoder, queries.select(F.col("qid").alias("id"), "text")).select(F.col("id").alias("qid"), "embedding")
        if self.indexes.dense is not None:
            found = self.indexes.dense.search_many(encoded, self.top_k)
        else:
            placed = self.indexes.vectors.join(self.chunks.select(F.col("chunk_id").alias("id"), *ORDER), "id")
            order = F.struct(*ORDER, F.col("id").alias("chunk_id"))  # ties in reading order
            found = dense.search_many(encoded, placed.select(order.alias("id"), "embedding"), self.top_k)
        return found.select("qid", "rank", "id.chunk_id", "score")

    def passages(self, found: DataFrame) -> DataFrame:
        """found (chunk_id, ...) with paper, page and text, which an index holds by the chunks' addresses."""
        table = self.indexes.passages
        if table is None:
            return found.join(self.chunks.select("chunk_id", "paper", "page", "text"), "chunk_id")
        blocks = number_of_blocks(self.indexes.sparse.corpus.first()["n"])
        wanted = found.withColumn("block", block_of(F.col("chunk_id"), blocks))
        return look_up(wanted, table.select("span", "block", "chunk_id", "paper", "page", "text"), ["block", "chunk_id"], blocks).drop("block")

    def graph_search(self, names: DataFrame) -> DataFrame:
        return self.indexes.graph.search(names, self.top_k)

    def rank_lists(self, queries: DataFrame) -> DataFrame:
        """queries (qid, query_no, query, entities, retrievers) -> (qid, retriever, query_no, list_ord, rank, chunk_id, score):
        the best of every selected retriever for every query."""
        key = F.struct("qid", "query_no")
        uses = lambda r: queries.where(F.array_contains("retrievers", r))
        own = entities(F.col("query"))
        seeds = uses("graph").select(key.alias("qid"), F.posexplode(F.when(F.size(own) > 0, own).otherwise(F.col("entities"))).alias("entity_no", "name"))
        lists = {
            "sparse": lambda: self.sparse_search(uses("sparse").select(key.alias("qid"), F.col("query").alias("text"))),
            "dense": lambda: self.dense_search_many(uses("dense").select(key.alias("qid"), F.col("query").alias("text"))),
            "graph": lambda: self.graph_search(seeds),
        }
        out = None
        used = {r[0] for r in queries.select(F.explode("retrievers")).distinct().collect()}  # of three names; what no question asks for needs no plan and no model
        for i, name in enumerate(RETRIEVERS):
            if name not in (used or RETRIEVERS[:1]):
                continue
            rows = lists[name]().where(F.col("rank") <= PER_QUERY)
            rows = rows.select("qid.qid", F.lit(name).alias("retriever"), "qid.query_no", (F.lit(i * 1000) + F.col("qid.query_no")).alias("list_ord"), "rank", "chunk_id", "score")
            out = rows if out is None else out.unionByName(rows)
        return out


def initial_states(questions: DataFrame) -> DataFrame:
    """questions (qid, question) -> states with every field at its default."""
    none = F.array().cast("array<string>")
    plan = F.struct(none.alias("queries"), none.alias("entities"), none.alias("targets"), none.alias("facets"), F.array(F.lit("sparse"), F.lit("dense")).alias("retrievers"), F.lit("English").alias("output_language"))
    verification = F.struct(F.lit("insufficient").alias("status"), F.create_map().cast("map<string,map<string,array<string>>>").alias("covered"), none.alias("missing"), F.lit("").alias("corrective_query"))
    return questions.select("qid", "question", plan.cast(PLAN).alias("plan"), F.array().cast(f"array<{EVIDENCE}>").alias("evidence"), verification.cast(VERIFICATION).alias("verification"), F.lit(0).alias("retry_count"), F.lit("").alias("stop_reason"), F.lit("").alias("answer"))


def asked_queries(states: DataFrame) -> DataFrame:
    """(qid, query_no, query, entities, retrievers): the plan's queries and, last, the corrective one."""
    more = F.when(F.col("verification.corrective_query") != "", F.array("verification.corrective_query")).otherwise(F.array().cast("array<string>"))
    return states.select("qid", F.posexplode(F.concat("plan.queries", more)).alias("query_no", "query"), "plan.entities", "plan.retrievers")


def research(states: DataFrame, engine: RetrievalEngine, settings: Settings, scorer: Scorer, reranker: Reranker = rerank) -> DataFrame:
    """One round: retrieve, fuse, rerank, merge with earlier evidence, select. reranker: instead of fusion.rerank, with its contract."""
    queries = asked_queries(states)
    fused = reciprocal_rank_fusion(engine.rank_lists(queries)).where(F.col("fused_rank") <= MAX_CANDIDATES)
    found = engine.passages(fused.select("qid", "fused_rank", "chunk_id"))
    scored = reranker(queries.select("qid", "query"), found, scorer)
    if "error" in scored.columns:
        scored = cut(scored)
        bad = scored.where("error is not null").select("error").head()
        if bad is not None:
            raise ModelUnavailableError(f"the scorer failed: {bad['error']}")
    scored = scored.where(F.col("score") >= settings.min_rerank_score)
    new = scored.select("qid", F.col("rank").alias("slot"), "chunk_id", "paper", "page", "text", "score")
    old = states.select("qid", F.posexplode("evidence").alias("slot", "e")).select("qid", "slot", "e.*")
    merged = merge_evidence(old, new).where(F.col("score") >= settings.min_rerank_score).withColumnRenamed("merged_slot", "slot")
    chosen = select_evidence(merged.join(states.select("qid", F.col("plan.targets").alias("targets")), "qid"), F.col("targets"))
    packed = chosen.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("evidence_no", F.struct("chunk_id", "paper", "page", "text", "score").alias("e")))).alias("_new"))
    rows = states.join(packed, "qid", "left").withColumn("_new", F.coalesce(F.transform("_new", lambda x: x["e"]), F.array().cast(f"array<{EVIDENCE}>")))
    return concluded(rows)


def concluded(rows: DataFrame) -> DataFrame:
    """states with _new evidence -> states: a retry that finds the same chunks keeps the old evidence, so its numbers stay valid."""
    ids = lambda c: F.array_sort(F.transform(c, lambda e: e["chunk_id"]))
    retry = F.col("verification.corrective_query") != ""
    same = retry & (ids(F.col("_new")) == ids(F.col("evidence")))
    reason = F.when(same, "no_new_evidence").when(F.size("_new") == 0, "no_relevant_evidence").otherwise("")
    return rows.withColumns({"stop_reason": reason, "evidence": F.when(same, F.col("evidence")).otherwise(F.col("_new")), "retry_count": F.col("retry_count") + F.when(retry, 1).otherwise(0)}).drop("_new")


def answered(states: DataFrame, completer: Completer, node: str, turn: int, prompt: Column) -> DataFrame:
    """states with payload, and unanswered: why there is none, if the completer tells (has an attempt()). Written at once: what follows
    reads the answers more than once, and an error is not kept, so it could become an answer in between."""
    asked = states.select(F.col("qid"), F.lit(node).alias("node"), F.lit(turn).alias("round"), prompt.alias("prompt"))
    attempt = getattr(completer, "attempt", None)
    got = attempt(asked).withColumnRenamed("error", "unanswered") if attempt else completer.complete(asked).withColumn("unanswered", F.lit(None).cast("string"))
    return cut(states.join(got, "qid"))


def settled(states: DataFrame, node: str, error: str) -> DataFrame:
    """states with error (a struct or null) instead of the step's own columns."""
    fault = F.when(F.col("unanswered").isNotNull(), F.struct(F.lit(node).alias("step"), F.lit("service").alias("kind"), F.col("unanswered").alias("message")))
    fault = fault.when(F.col(error).isNotNull(), F.struct(F.lit(node).alias("step"), F.lit("contract").alias("kind"), F.col(error).alias("message")))
    return cut(states.withColumn("_fault", fault).drop(error, "payload", "unanswered").withColumnRenamed("_fault", "error"))


def raised(states: DataFrame) -> None:
    bad = states.where("error is not null").select("qid", "error").head()
    if bad is not None:
        kind = ServiceError if bad["error"]["kind"] == "service" else PlanError
        raise kind(f"question {bad['qid']}, {bad['error']['step']}: {bad['error']['message']}")


def ask(questions: DataFrame, engine: RetrievalEngine, settings: Settings, completer: Completer | None, scorer: Scorer | None, reranker: Reranker = rerank) -> DataFrame:
    """questions (qid, question) -> states with answers. The first question that a step fails for raises, before the next step asks anything."""
    return answers(questions, engine, settings, completer, scorer, reranker, raised).drop("error")


def ask_each(questions: DataFrame, engine: RetrievalEngine, settings: Settings, completer: Completer | None, scorer: Scorer | None, reranker: Reranker = rerank) -> DataFrame:
    """questions (qid, question) -> states with answers and error. A question that a step fails for ends there, with an empty answer; the others go on."""
    return answers(questions, engine, settings, completer, scorer, reranker, lambda states: None)


def answers(questions: DataFrame, engine: RetrievalEngine, settings: Settings, completer: Completer | None, scorer: Scorer | None, reranker: Reranker, check: Callable[[DataFrame], None]) -> DataFrame:
    if completer is None:
        raise ValueError("a completer is required")
    if scorer is None and reranker is rerank:
        raise ModelUnavailableError(f"no scorer given for {settings.reranker_model!r}")
    ended: list[DataFrame] = []

    def going(states: DataFrame, node: str, error: str) -> DataFrame:
        done = settled(states, node, error)
        check(done)
        ended.append(done.where("error is not null").withColumn("answer", F.lit("")))
        return done.where("error is null").drop("error")

    asked = initial_states(questions)
    blank = asked.schema["plan"].dataType
    planned = plan_questions(answered(asked.drop("plan"), completer, "planner", 0, prompts.planner(F.col("question"))))
    active = going(planned.withColumn("plan", F.when(F.col("plan_error").isNull(), F.col("plan")).otherwise(F.lit(None).cast(blank))), "planner", "plan_error")
    ready: list[DataFrame] = []
    for turn in range(settings.max_retries + 1):
        active = cut(research(active, engine, settings, scorer, reranker))
        to_writer = route_after_research(F.col("stop_reason")) == "writer"
        ready.append(active.where(to_writer))
        rest = active.where(~to_writer)
        verified = going(verify(answered(rest, completer, "verifier", turn, prompts.verifier(rest))), "verifier", "verify_error")
        route = route_after_verification(F.col("verification.status"), F.col("verification.corrective_query"), F.col("retry_count"), settings.max_retries)
        ready.append(verified.where(route == "writer"))
        active = verified.where(route == "researcher")
        if active.isEmpty():
            break
    together = cut(functools.reduce(DataFrame.unionByName, ready))
    written = write(answered(together, completer, "writer", 0, prompts.writer(F.col("verification"), allowed_ids(F.col("verification.covered"))))).drop("summary")
    good = going(written, "writer", "write_error").withColumn("error", F.lit(None).cast(ERROR))
    return functools.reduce(DataFrame.unionByName, [good, *ended])
