"""Entity co-occurrence graph: nodes are entities, edges join entities of one chunk; retrieval goes one hop."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import compact_form, entities, word_form
from lodestone.operators.ranking import placed, top_k
from lodestone.session import cut, drop, shuffles

#: Compact names of fewer characters are not searched for as parts.
LEAST_PART = 5
#: What a key of a node is: its word form, a compact name below LEAST_PART, a longer one's first LEAST_PART characters, its other pieces of that length.
FORM, SHORT, HEAD, INNER = range(4)
#: Folders of the stored keys of a kind; short names, of which there can't be many, share one.
KEY_BUCKETS = 128
#: Chunks in a block of places, and so bits in a bitmap.
PLACES = 4096
#: Questions whose scores in a block are added up in one group.
QUESTIONS = 512


def packed(slots: np.ndarray) -> bytes:
    """Slots of a block, ascending: as 16-bit numbers, or a bitmap where that is shorter."""
    if len(slots) < PLACES // 16:
        return slots.astype("<u2").tobytes()
    bits = np.zeros(PLACES, np.uint8)
    bits[slots] = 1
    return np.packbits(bits).tobytes()


def cells(slots: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and slots of packed slots, all at once."""
    ends = np.frombuffer(slots.buffers()[1], np.int32)[slots.offset : slots.offset + len(slots) + 1]
    size, raw = np.diff(ends), np.frombuffer(slots.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    whole = size == PLACES // 8
    of_byte = np.repeat(whole, size)
    short = np.flatnonzero(~whole)
    row, slot = np.nonzero(np.unpackbits(raw[of_byte].reshape(-1, PLACES // 8), axis=1))
    return np.concatenate((np.repeat(short, size[short] // 2), np.flatnonzero(whole)[row])), np.concatenate((raw[~of_byte].view("<u2").astype(np.int64), slot))


def spots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of their places (place, names) to (entity, block, slots). A task holds a block at a time."""
    block, own = None, {}

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([block] * len(own), pa.int64()), pa.array([packed(np.array(s)) for s in own.values()], pa.binary())], names=["entity", "block", "slots"])

    for batch in batches:
        for place, names in zip(batch.column("place").to_pylist(), batch.column("names").to_pylist(), strict=True):
            if place // PLACES != block:
                if own:
                    yield closed()
                block, own = place // PLACES, {}
            for name in names:
                own.setdefault(name, []).append(place % PLACES)
    if own:
        yield closed()


def best_of(k: int) -> Callable[[pa.Table], pa.Table]:
    def best(table: pa.Table) -> pa.Table:
        """applyInArrow on a block's slots of at most some QUESTIONS' entities (no, block, part, slots): each question's k best places, ties by place."""
        table = table.combine_chunks()
        block = table.column("block")[0].as_py()
        names, question = np.unique(table.column("no").to_numpy(), return_inverse=True)
        row, slot = cells(table.column("slots").combine_chunks().cast(pa.binary()))
        # twice the score is a whole number, and with the slot behind it a key by which places of a question are ranked
        twice = np.bincount(question[row] * PLACES + slot, 2 * table.column("part").to_numpy()[row], len(names) * PLACES).astype(np.int64).reshape(-1, PLACES)
        key = twice * PLACES + np.arange(PLACES - 1, -1, -1)
        own = np.argpartition(key, PLACES - k, axis=1)[:, PLACES - k :] if k < PLACES else np.tile(np.arange(PLACES), (len(names), 1))
        no = np.repeat(np.arange(len(names)), own.shape[1])
        at = own.ravel()
        some = twice[no, at] > 0
        no, at = no[some], at[some]
        return pa.table({"no": pa.array(names[no]), "place": pa.array(block * PLACES + at), "score": pa.array(twice[no, at] / 2)})

    return best


def pieces(c: str, n: int) -> Column:
    """All different substrings of n characters, an array."""
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(n))))


def key(kind: int, value: Column) -> Column:
    bucket = F.lit(0) if kind == SHORT else F.pmod(F.xxhash64(value), F.lit(KEY_BUCKETS)).cast("int")
    return F.struct(F.lit(kind).alias("kind"), bucket.alias("bucket"), value.alias("key"))


def keys_of(nodes: DataFrame) -> DataFrame:
    """nodes (entity, word_form, compact) -> (kind, bucket, key, entity, own): a row per key by which a node is found; own is its compact form."""
    own, head = F.col("compact"), F.substring("compact", 1, LEAST_PART)
    form = F.array(key(FORM, F.col("word_form")))
    short = F.filter(F.array(key(SHORT, own)), lambda k: F.length(k["key"]).between(1, LEAST_PART - 1))
    long = F.filter(F.array(key(HEAD, head)), lambda k: F.length(k["key"]) == LEAST_PART)
    inner = F.transform(F.array_remove(pieces("compact", LEAST_PART), head), lambda p: key(INNER, p))
    return nodes.select(F.explode(F.concat(form, short, long, inner)).alias("k"), "entity", own.alias("own")).select("k.*", "entity", "own")


@dataclass(frozen=True)
class EntityGraph:
    """members(entity, chunk_id), nodes(entity, word_form, compact), edges(src, dst, weight), each edge once, src < dst;
    places(place, chunk_id): a number of each chunk that rises with its id; spots(entity, block, slots): an entity's chunks, packed by blocks of places; keys(kind, bucket, key, entity, own): what nodes are found by.

    A search adds up packed blocks: an entity of very many chunks sends a bitmap per block and question, not a row per chunk, and of each
    block only a question's k best chunks go on. Names are looked up by key: of a stored graph's keys only the asked buckets' folders are read, never all nodes.
    """

    members: DataFrame
    nodes: DataFrame
    edges: DataFrame
    places: DataFrame
    spots: DataFrame
    keys: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame) -> EntityGraph:
        """Names are found once; they are written to the checkpoint folder."""
        found = cut(chunks.select("chunk_id", entities(F.col("text")).alias("names")))  # sorting samples its input, which reads it twice
        named = placed(found, [F.col("chunk_id")])
        drop(found)
        members = named.select(F.explode("names").alias("entity"), "chunk_id")
        e = F.col("entity")
        nodes = cut(members.select("entity").distinct().select("entity", word_form(e).alias("word_form"), compact_form(e).alias("compact")))
        # pairs are made inside the row (20 names at most), so nothing is joined
        ordered = named.select(F.array_sort("names").alias("names"))
        pairs = ordered.select(F.posexplode("names").alias("i", "src"), "names").select("src", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("dst"))
        spots = named.where(F.size("names") > 0).select("place", "names").mapInArrow(spots_of, "entity string, block long, slots binary")
        return cls(members, nodes, pairs.groupBy("src", "dst").agg(F.count("*").alias("weight")), named.select("place", "chunk_id"), spots, keys_of(nodes))

    def node_lists(self, chunks: DataFrame) -> DataFrame:
        """(entity, chunks): each node's chunk ids in reading order."""
        placed = self.members.join(chunks.select("chunk_id", "paper", "page", "position"), "chunk_id")
        own = F.array_sort(F.collect_set(F.struct("paper", "page", "position", "chunk_id")))
        return placed.groupBy("entity").agg(F.transform(own, lambda c: c["chunk_id"]).alias("chunks"))

    def match(self, names: DataFrame) -> DataFrame:
        """names (qid, entity_no, name) -> (qid, entity_no, entity): nodes of equal word form; where there is none and the
        compact form is long enough, nodes that contain it or that it contains."""
        n = F.col("name")
        # written, so that the forms aren't worked out anew for every piece of a name
        asked = cut(names.select("qid", "entity_no", word_form(n).alias("word_form"), compact_form(n).alias("compact")))
        equal = self.keyed(asked.select("qid", "entity_no", key(FORM, F.col("word_form")).alias("k"))).select("qid", "entity_no", "entity")
        rest = asked.where(F.length("compact") >= LEAST_PART).join(equal.select("qid", "entity_no").distinct(), ["qid", "entity_no"], "left_anti")
        within = self.sharing_parts(rest.select("compact").distinct())
        return equal.unionByName(rest.join(within, "compact").select("qid", "entity_no", "entity"))

    def folders(self, asked: DataFrame) -> DataFrame:
        """The keys of the buckets that asked (k) names."""
        buckets: dict[int, list[int]] = {}
        for r in asked.select("k.kind", "k.bucket").distinct().collect():  # 3 * KEY_BUCKETS + 1 at most
            buckets.setdefault(r["kind"], []).append(r["bucket"])
        some = [(F.col("kind") == kind) & F.col("bucket").isin(sorted(own)) for kind, own in sorted(buckets.items())]
        return self.keys.where(functools.reduce(operator.or_, some, F.lit(False)))

    def keyed(self, asked: DataFrame) -> DataFrame:
        """asked (k, ...) with the nodes of its keys: (..., entity, own)."""
        asked = cut(asked)
        return asked.select("*", "k.*").drop("k").join(self.folders(asked), ["kind", "bucket", "key"]).drop("kind", "bucket", "key")

    def sharing_parts(self, names: DataFrame) -> DataFrame:
        """names (compact, of LEAST_PART characters or more, each once) -> (compact, entity): nodes whose compact form contains the name's or
        is contained in it. Of two names of which one contains the other, the larger holds the smaller's first LEAST_PART
        characters, or, if that is shorter, all of it: what equal keys bring together is verified."""
        c, own = F.col("compact"), F.col("own")
        within = F.transform(pieces("compact", LEAST_PART), lambda p: key(HEAD, p))
        short = F.transform(F.flatten(F.array(*[pieces("compact", n) for n in range(1, LEAST_PART)])), lambda p: key(SHORT, p))
        around = F.array(key(INNER, F.substring("compact", 1, LEAST_PART)))  # as a larger name's own head it is among the former
        found = self.keyed(names.select("compact", F.explode(F.concat(within, short, around)).alias("k")))
        return found.where(own.contains(c) | c.contains(own)).select("compact", "entity").distinct()

    def search(self, names: DataFrame, k: int = 20) -> DataFrame:
        """names (qid, entity_no, name) -> (qid, rank, chunk_id, score): 1 per matched node's chunk, 0.5 per chunk of a neighbour,
        added up over names, nodes and neighbours. Edge weights don't count."""
        matched = cut(self.match(names))
        ends = F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        both = self.edges.select(ends.alias("e")).select("e.src", "e.dst")
        own = matched.select("qid", "entity", F.lit(1.0).alias("part"))
        near = matched.join(both, F.col("entity") == F.col("src")).select("qid", F.col("dst").alias("entity"), F.lit(0.5).alias("part"))
        # per node first: a node that many names reach meets its chunks once
        weight = cut(own.union(near).groupBy("qid", "entity").agg(F.sum("part").alias("part")))
        asked = placed(weight.select("qid").distinct(), [F.col("qid")], "no")
        groups = max(1, -(-asked.count() // QUESTIONS))
        sent = weight.join(asked, "qid").select("no", "entity", "part").join(self.spots, "entity").withColumn("group", F.pmod(F.xxhash64("no"), F.lit(groups)))
        scores = sent.repartition(shuffles(names.sparkSession), "block", "group").groupBy("block", "group").applyInArrow(best_of(k), "no long, place long, score double")
        best = top_k(scores, ["no"], [F.col("score").desc(), F.col("place")], k)
        return best.join(asked, "no").join(self.places, "place").select("qid", "rank", "chunk_id", "score")
