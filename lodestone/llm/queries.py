"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, conversations, embeddings, lexical, mixing, quality, secrets, sharding, simhash, substrings, tokens, topk, urls
from lodestone.llm.common import cut, table


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(quality.described(table(spark, sf_dir, "documents")))
    model = quality.learnt(docs, quality.taught(table(spark, sf_dir, "labels")))
    return quality.scored(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = secrets.found(docs, secrets.learnt(docs))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_substring_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.removed(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_bpe_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_mix_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.limits(tokens.histogram(table(spark, sf_dir, "documents")))


def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.TopK().search(vectors.where("vec_id % 50 = 0"), vectors)


def op11_lexical_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    found = lexical.LexicalSearch().search(items, table(spark, sf_dir, "documents"))
    return found.select(F.col("qid").alias("item_id"), "rank", F.col("doc_id").cast("long").alias("doc_id"), "score")


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", sharding.size_of(text).alias("size"), sharding.crc_of(text).alias("text_crc32"))
    placed = sharding.Shards().placed(docs, ["doc_id", "size", "text_crc32"])
    return placed.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.digests(conversations.Repair().repaired(conversations.damaged(rows)), rows)


QUERIES = {f.__name__: f for f in (op1_quality_qda, op2_secret_grammar, op3_url_redirects, op4_embedding_pq, op5_substring_superkmer, op6_bpe_duckdb, op7_mix_sampling, op8_token_histogram, op9_simhash_gray, op10_kdtree_topk, op11_lexical_windows, op12_feistel_shards, op13_conversation_repair)}
SQL = {"op3_url_redirects": urls.SQL, "op4_embedding_pq": embeddings.SQL, "op5_substring_superkmer": substrings.SQL, "op7_mix_sampling": mixing.SQL, "op10_kdtree_topk": topk.SQL, "op11_lexical_windows": lexical.SQL, "op12_feistel_shards": sharding.SQL, "op13_conversation_repair": conversations.SQL}
