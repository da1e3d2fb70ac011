"""SimHash near-dedup with a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint: a bit is 1 if over half of the XXH64 values (seed 42) of its shingles have it.
Fingerprints link at `distance` or fewer differing bits; linked ones form groups.

Distribution: copies share a fingerprint, so only distinct fingerprints go on. 64 bits are cut into blocks; two
fingerprints that differ in at most 4 bits agree in all but 4 blocks, so each is sent once for every choice of blocks
that may agree, to the bucket of those blocks' value. A bucket above `bucket_limit` is split into sub-blocks, and every
two sub-blocks meet in a task of their own, so no task holds more than two limits' worth, however hot the value is.

In a task, fingerprints are sorted by Gray rank (neighbours then share many bits) and grouped sixteen by sixteen into a
tree. A node stores the bits that all below it share and that no ancestor has stored. A search goes down level by level,
adds up the differing bits on the way and drops a whole group once they exceed the distance; that loses no link. Links
within a task are merged at once, and the task returns one edge per fingerprint to its local group's smallest, not pairs.

NearCopies is the pipeline's stage: five-word shingles, distances as wide as a Jaccard similarity of 0.8 needs, and an exact
check of that similarity before anything is merged. No choice of blocks tells fingerprints apart at such a distance, so its
buckets are shingles instead: with the shingles of all texts in one order (common
ones last), two sets of similarity 0.8 or more always share one of their first n - ceil(0.8 n) + 1. A bucket's fingerprints are
searched by its Gray-order tree, all buckets of a task at once; a node all of whose texts are connected with the query already is dropped as a distant one is.
Texts of a bucket whose fingerprints link, by 64 bits and by 128, and whose sizes allow the similarity are candidates. A bucket of more than `most_texts` is
never held by one task: its rows are passed on, dealt by size, and blocks of them meet pairwise. Each connected set of candidates
is compared in a task of its own, where a pair's shingle sets are intersected unless it is merged already. A set of more than
a block's texts is cut into blocks: all are compared with its hubs, a few of its texts, first, and then only those that hubs
did not put into the set's largest group with all blocks. So near copies of one text, however many, cost work in proportion. At a similarity of 0.8 a bit differs with a probability of 0.15, of short texts 0.2; the limits,
24 of 64 and 44 of 128, are 3.5 to 6 standard deviations above. Two unrelated texts are within the second one in 1 of 4,000
cases, so sets of candidates don't run together. Only the distances can lose a pair, and rarely do (README, Limits).

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text shorter than a shingle is one
shingle; a null doc_id is never a component_id unless its whole group has none; repeated rows are copies; an empty table
gives no rows; extra columns are ignored by fingerprints() and near_duplicates() and kept by deduplicated() and
NearCopies.deduplicated(), which takes texts of the same words, apart from ASCII case, for copies (by a 128-bit hash). doc_id may be
of any type that has an order, other columns of any type.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lodestone.llm.common import columns_of, components, cut, drop, held, per_batch, shuffles, text_bytes

FAN_OUT = 16


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The XXH64 values of a text's shingles in their order, repeats included; of fewer words all are one shingle, none have none."""
    words = text.lower().split()  # on bytes both touch ASCII only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, m = xxhash.xxh64_digest, n - shingle + 1
    first, last = starts[:m].tolist(), ends[shingle - 1 :].tolist()
    return np.frombuffer(b"".join([digest(whole[a:b], 42) for a, b in zip(first, last, strict=True)]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero of none."""
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits for each hash."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(32))


def simhash(text: bytes, shingle: int = 4) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and fp: the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((simhash(t, shingle) for t in text_bytes(batch.column("text"))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    given = docs.select(*keep, "text")
    schema = T.StructType([*(given.schema[k] for k in keep), T.StructField("fp", T.LongType())])
    return given.mapInArrow(per_batch(run), schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def bits_first(x: np.ndarray, mask: int) -> np.ndarray:
    """The same codes with the mask's bits moved to the top; differences stay as many."""
    out = np.zeros(len(x), np.uint64)
    for bit in sorted(range(64), key=lambda b: (mask >> b & 1, b)):  # the lowest place first
        out = (out >> np.uint64(1)) | ((x >> np.uint64(bit) & np.uint64(1)) << np.uint64(63))
    return out


class GrayIndex:
    """Levels of (own mask, pattern, children) from the top down; the last level is the fingerprints themselves. The children of a node i of the level above are
    nodes children[i] to children[i + 1]. Where buckets are given, each has a tree of its own in these levels."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray | None = None):
        bucket = np.zeros(len(fps), np.int64) if bucket is None else bucket
        self.order = np.lexsort((gray_rank(fps), bucket))
        own, children, self.groups = bucket[self.order], [], []
        masks, patterns = [np.full(len(fps), ~np.uint64(0))], [fps[self.order]]
        while True:
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            sizes = np.diff(np.append(starts, len(own)))
            if sizes.max() <= FAN_OUT:
                break
            begins = (np.arange(len(own)) - np.repeat(starts, sizes)) % FAN_OUT == 0
            at, group = np.flatnonzero(begins), np.cumsum(begins) - 1
            first = patterns[-1][at]
            differ = np.bitwise_or.reduceat(patterns[-1] ^ first[group], at)
            mask = np.bitwise_and.reduceat(masks[-1], at) & ~differ
            masks.append(mask)
            patterns.append(first & mask)
            children.append(np.append(at, len(own)))
            self.groups.append(group)
            own = own[at]
        #: Of each top node the end of its bucket's top nodes.
        self.ends = np.repeat(starts + sizes, sizes)
        own_masks = [m & ~up[group] for m, up, group in zip(masks, masks[1:], self.groups, strict=False)] + [masks[-1]]
        self.levels = list(zip(own_masks, patterns, [*children, None], strict=True))[::-1]

    def below(self, q: np.ndarray, who: np.ndarray, node: np.ndarray, distance: int, wanted=None) -> tuple[np.ndarray, np.ndarray]:
        """From pairs of a query and a top node down to pairs within the distance: differing bits are added up on the way, and a group is dropped once they
        exceed it. wanted(depth, who, node): which pairs are looked for at all."""
        acc = np.zeros(len(who), np.uint8)
        for depth, (own, pattern, children) in enumerate(self.levels):
            if depth:
                n = children[node + 1] - children[node]
                node = np.repeat(children[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                who, acc = np.repeat(who, n), np.repeat(acc, n)
            if wanted is not None:
                some = wanted(depth, who, node)
                who, node, acc = who[some], node[some], acc[some]
            acc = acc + np.bitwise_count((q[who] ^ pattern[node]) & own[node])
            close = acc <= distance
            who, node, acc = who[close], node[close], acc[close]
            if not who.size:
                break
        return who, node

    def search(self, queries: np.ndarray, distance: int, chunk: int = 2048):
        """Yields (query positions, index positions) of all pairs within the distance; both as given, not as sorted. For an index of one bucket."""
        for q0 in range(0, len(queries), chunk):
            q = queries[q0 : q0 + chunk]
            for top in range(len(self.levels[0][0])):
                who, node = self.below(q, np.arange(len(q)), np.full(len(q), top), distance)
                if who.size:
                    yield who + q0, self.order[node]

    def linked(self, distance: int, close, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Positions (a, b), as given: edges that connect all pairs of one bucket that are within the distance and close(a, b). About `most` pairs at a time at most
        are looked at, and then groups in which all is connected with the query are dropped like distant ones."""
        n = len(self.order)
        place = top = np.arange(n)
        ends = [place + 1]  # of each node the end of what is below it
        for group, (_, _, children) in zip(self.groups, self.levels[:0:-1], strict=True):
            top = group[top]
            ends.append(ends[-1][children[1:] - 1])
        ends = ends[::-1]
        parent, fps = place.copy(), self.levels[-1][1]
        # a query meets what follows it in its bucket
        weight = ends[0][self.ends[top] - 1] - place
        cuts = np.flatnonzero(np.diff(np.cumsum(weight) // most, prepend=-1))
        whole = None
        for begin, end in zip(cuts, np.append(cuts[1:], n), strict=True):
            some = place[begin:end]
            if whole is None:
                whole = self.connected(parent)
            many = self.ends[top[some]] - top[some]
            node = np.repeat(top[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            known = parent
            who, at = self.below(fps, np.repeat(some, many), node, distance, lambda depth, who, node, whole=whole, known=known: (ends[depth][node] - 1 > who) & (whole[depth][node] != known[who]))
            good = close(self.order[who], self.order[at])
            if good.any():
                parent, whole = merge(parent, who[good], at[good]), None
        joined = np.flatnonzero(parent != place)
        return self.order[joined], self.order[parent[joined]]

    def connected(self, parent: np.ndarray) -> list[np.ndarray]:
        """For the levels from the top down: the group that all below a node is in, or -1."""
        out = [parent]
        for _, _, children in self.levels[:0:-1]:
            low, high = (f.reduceat(out[-1], children[:-1]) for f in (np.minimum, np.maximum))
            out.append(np.where(low == high, low, -1))
        return out[::-1]


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the groups of a[i] and b[i]; parent[i] is the smallest position of i's group, before and after."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def block_masks(n: int, distance: int) -> list[int]:
    """Masks such that any two fingerprints within the distance agree under one of them; longer masks for more fingerprints."""
    for blocks in range(distance + 1, 2 * distance + 1):
        agree = blocks - distance
        if n <= 1 << (64 * agree // blocks + 11):
            break
    edge = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(parts, agree)]


@dataclass(frozen=True)
class SimHash:
    shingle: int = 4
    distance: int = 4
    bucket_rows: int = 8192
    bucket_limit: int = 32768

    def links(self, fps: DataFrame) -> DataFrame:
        """Edges (u, v) between distinct fingerprints, the column fp of fps, enough to connect all that link."""
        n = fps.count()
        masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(n, self.distance)]
        spread = max(1, -(-n // self.bucket_rows))
        sent = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("mask", "bits"))
        sent = sent.select("fp", "mask", F.pmod(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("bits"))), F.lit(spread)).cast("int").alias("bucket"))
        counts = sent.groupBy("mask", "bucket").agg(F.ceil(F.count("*") / self.bucket_limit).cast("int").alias("subs"))
        sent = sent.join(counts, ["mask", "bucket"]).withColumn("sub", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("subs")).cast("int"))
        sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        # as many partitions as buckets, up to a bound: rows are few, work per row is not
        sent = sent.repartition(max(shuffles(fps.sparkSession), min(spread * len(masks), 4096)), "mask", "bucket", F.least("sub", "other"), F.greatest("sub", "other"))
        sent = sent.select("mask", "bucket", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", "fp")
        distance, all_masks = self.distance, block_masks(n, self.distance)

        def link(table: pa.Table) -> pa.Table:
            fp = table.column("fp").to_numpy().view(np.uint64)
            # what a bucket's values differ in comes first in the order, so that upper nodes tell the values apart
            moved = bits_first(fp, all_masks[table.column("mask")[0].as_py()])
            sub, i, j = table.column("sub").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
            left, right = np.flatnonzero(sub == i), np.flatnonzero(sub == j)
            parent = np.arange(len(fp))
            if left.size and right.size:
                for a, b in GrayIndex(moved[left]).search(moved[right], distance):
                    parent = merge(parent, right[a], left[b])
            joined = np.flatnonzero(parent != np.arange(len(fp)))
            return pa.table({"u": fp[joined].view(np.int64), "v": fp[parent[joined]].view(np.int64)})

        return sent.groupBy("mask", "bucket", "i", "j").applyInArrow(link, "u long, v long")

    def groups(self, fps: DataFrame) -> DataFrame:
        """(fp, root) of each distinct fingerprint; root is the same for all that are reachable."""
        parts = components(self.links(fps), "u", "v")
        return fps.join(parts, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, method: SimHash = SimHash()) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    marked = cut(fingerprints(docs, method.shingle))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = cut(method.groups(fps.select("fp")))
    least = cut(groups.join(fps, "fp").groupBy("root").agg(F.min("least").alias("component_id")))  # written, so that AQE can split the next join at a large group
    group_of = groups.join(least, "root").select("fp", "component_id")
    return marked.join(group_of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_of(docs: DataFrame) -> Column:
    """A hash that tells rows of one doc_id apart; JSON takes columns of any type, also those that can't be hashed."""
    rest = [c for c, name in zip(columns_of(docs), docs.columns, strict=True) if name not in ("doc_id", "text")]
    return F.xxhash64("text", F.to_json(F.struct(*rest))) if rest else F.xxhash64("text")


def deduplicated(docs: DataFrame, method: SimHash = SimHash()) -> DataFrame:
    """docs' own columns: of each group the document with the smallest doc_id (nulls last); of repeated rows one."""
    named = docs.select("doc_id", "text", row_of(docs).alias("_row"))
    marked = cut(fingerprints(named, method.shingle, ("doc_id", "_row")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    fps = cut(marked.groupBy("fp").agg(first.alias("first")))
    kept = method.groups(fps.select("fp")).join(fps, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return of_keys(docs, kept.select("first.*")).select("_doc.*")


def of_keys(docs: DataFrame, keys: DataFrame, *keep: str) -> DataFrame:
    """(_doc, *keep): docs' rows whose doc_id and row_of() (_row) are among keys, with the keys' columns; of repeated rows one."""
    # keys without nulls: the join and the window then need one and the same shuffle of the texts
    names = [F.col("_id").isNull().alias("_none"), F.coalesce("_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("_id"), "_row"]
    keys = keys.select(F.col("doc_id").alias("_id"), "_row", *keep).select(*names, *keep)
    whole = docs.select(F.struct(*columns_of(docs)).alias("_doc"), F.col("doc_id").alias("_id"), row_of(docs).alias("_row")).select("_doc", *names)
    out = whole.join(keys, ["_none", "_id", "_row"], "inner" if keep else "left_semi")
    one = F.row_number().over(W.partitionBy("_none", "_id", "_row").orderBy(F.lit(1)))
    return out.withColumn("_n", one).where("_n = 1").select("_doc", *keep)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The XXH64 values of a text's different shingles, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which values of one ascending array are in another."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)


@dataclass(frozen=True)
class NearCopies:
    shingle: int = 5
    distance: int = 24
    #: The same for 128 bits: these 64 and 64 others.
    wide_distance: int = 44
    #: Similarity as a fraction of whole numbers, so that its bounds are exact.
    similar: tuple[int, int] = (4, 5)
    #: Shingles in over one of so many documents of a sample come last in the order.
    common: int = 1000
    sample: int = 20_000
    max_common: int = 100_000
    #: Texts that share one first shingle are compared in one task up to so many, beyond that in blocks of so many.
    most_texts: int = 8192
    block_texts: int = 1024
    block_bytes: int = 16 << 20
    #: Texts of a set of several blocks with which all others are compared first.
    hubs: int = 16

    def common_shingles(self, docs: DataFrame) -> np.ndarray:
        """Up to max_common of the most common shingles, ascending; which these are changes the work, not the outcome."""
        n, k = docs.count(), self.shingle

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, k) for t in text_bytes(batch.column("text"))]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["h"])

        some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // self.sample))) == 0)
        counts = some.mapInArrow(per_batch(run), "h long").groupBy("h").agg(F.count("*").alias("n"))
        rows = counts.where(F.col("n") > max(10, min(n, self.sample) // self.common)).orderBy(F.desc("n"), "h").limit(self.max_common).collect()
        return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))

    def described(self, docs: DataFrame, common: np.ndarray) -> DataFrame:
        """(doc_id, _row, words, fp, fp2, size, first): a 128-bit hash of the words, the fingerprint and 64 more bits, the shingle set's size and its first shingles."""
        k, (above, below) = self.shingle, self.similar

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, fps, others, sizes, firsts = [], [], [], [], []
            for t in text_bytes(batch.column("text")):
                hashes = shingle_hashes(t, k)
                own = np.unique(hashes)
                n = len(own) - (above * len(own) + below - 1) // below + 1 if len(own) else 0
                often = shared(own, common)
                words.append(xxhash.xxh3_128_digest(b" ".join(t.lower().split())))
                fps.append(majority(hashes))
                others.append(majority(mixed(hashes)))
                sizes.append(len(own))
                firsts.append(np.concatenate([own[~often], own[often]])[:n].view(np.int64))
            ends = np.cumsum([0, *map(len, firsts)])
            first = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, others, sizes)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row"), pa.array(words, pa.binary()), *numbers, first], names=["doc_id", "_row", "words", "fp", "fp2", "size", "first"])

        named = docs.select("doc_id", "text", row_of(docs).alias("_row"))
        schema = T.StructType([named.schema["doc_id"], T.StructField("_row", T.LongType()), T.StructField("words", T.BinaryType()), *(T.StructField(x, T.LongType()) for x in ("fp", "fp2", "size")), T.StructField("first", T.ArrayType(T.LongType()))])
        return named.mapInArrow(per_batch(run), schema)

    def close(self, fps: tuple[np.ndarray, np.ndarray], size: np.ndarray, a, b) -> np.ndarray:
        """Whether the fingerprints link and the sizes allow the similarity, for positions a and b."""
        above, below = self.similar
        near = np.bitwise_count(fps[0][a] ^ fps[0][b])
        wide = near + np.bitwise_count(fps[1][a] ^ fps[1][b])
        return (near <= self.distance) & (wide <= self.wide_distance) & (np.minimum(size[a], size[b]) * below >= np.maximum(size[a], size[b]) * above)

    def links(self, h: np.ndarray, node: np.ndarray, fps: tuple[np.ndarray, np.ndarray], size: np.ndarray) -> np.ndarray:
        """Of rows in the order of their shingles h: edges (u, v), each once, that connect all nodes of a shingle which close() allows. The shingles' Gray-order trees find them."""
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(h)))
        some = np.flatnonzero(np.repeat(lengths > 1, lengths))
        if not len(some):
            return np.zeros((0, 2), np.int64)
        node, size, fps = node[some], size[some], (fps[0][some], fps[1][some])
        a, b = GrayIndex(fps[0], h[some]).linked(self.distance, lambda a, b: self.close(fps, size, a, b))
        return np.unique(np.stack([node[a], node[b]], axis=1), axis=0)

    def candidates(self, texts: DataFrame) -> DataFrame:
        """Edges (u, v) between nodes that share a first shingle and whose sizes and fingerprints allow the similarity; enough to connect all such.

        A task passes on, as they come, the rows of a shingle that more than most_texts texts have. They are dealt into classes of size, each
        text into its own and the next one (whose sizes the similarity can't reach farther), and classes into blocks that meet pairwise.
        """
        most, link = self.most_texts, self.links

        def rows_of(edges: np.ndarray, passed: list[np.ndarray] | None = None) -> pa.RecordBatch:
            """Edges, after the rows that are passed on."""
            passed = passed or [np.zeros(0, np.int64)] * len(names)
            n, e = len(passed[0]), len(edges)
            columns = [pa.array(np.concatenate([c, np.zeros(e, np.int64)])) for c in passed]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.concatenate([np.zeros(n, np.int64), c])) for c in edges.T), pa.array(np.arange(n + e) < n)], names=[*names, "u", "v", "passed"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held(None)
            rest: list[list[np.ndarray]] = []
            kept, hot = 0, None
            for batch in itertools.chain(batches, [None]):
                if batch is not None:
                    columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                    if hot is not None:  # more of a shingle whose rows are passed on
                        n = int(np.searchsorted(columns[0], hot, "right"))
                        if n:
                            yield rows_of(np.zeros((0, 2), np.int64), [c[:n] for c in columns])
                        columns = [c[n:] for c in columns]
                    if not len(columns[0]):
                        continue
                    hot = None
                    rest.append(columns)
                    kept += len(columns[0])
                    if rest[0][0][0] == columns[0][-1]:  # one shingle so far, and perhaps beyond
                        if kept > most:
                            hot = columns[0][-1]
                            yield rows_of(np.zeros((0, 2), np.int64), [np.concatenate(c) for c in zip(*rest, strict=True)])
                            rest, kept = [], 0
                        continue
                if not rest:
                    continue
                columns = [np.concatenate(c) for c in zip(*rest, strict=True)]
                h = columns[0]
                end = len(h) if batch is None else int(np.flatnonzero(h != h[-1])[-1]) + 1
                rest, kept = ([[c[end:] for c in columns]], len(h) - end) if end < len(h) else ([], 0)
                starts = np.flatnonzero(np.concatenate(([True], h[1:end] != h[: end - 1])))
                lengths = np.diff(np.append(starts, end))
                many = np.repeat(lengths > most, lengths)
                passed = [c[:end][many] for c in columns]
                h, node, fp, fp2, size = (c[:end][~many] for c in columns)
                edges = link(h, node, (fp.view(np.uint64), fp2.view(np.uint64)), size)
                if len(edges) or len(passed[0]):
                    yield rows_of(edges, passed)

        names = ("h", "node", "fp", "fp2", "size")
        own = texts.select(F.explode("first").alias("h"), "node", "fp", "fp2", "size").repartition("h").sortWithinPartitions("h")
        found = cut(own.mapInArrow(run, ", ".join(f"{c} long" for c in (*names, "u", "v")) + ", passed boolean"))
        edges, hot = found.where("not passed").select("u", "v"), found.where("passed").select(*names)
        if hot.isEmpty():
            return edges.distinct()
        above, below = self.similar
        step = math.log(below / above) * (1 + 1e-9)  # a little more: rounding must not put a size beyond the next class
        own_class = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(step))
        classes = hot.withColumn("class", F.explode(F.array(own_class, own_class + 1)))
        blocks = cut(classes.groupBy("h", "class").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("blocks")))
        dealt = classes.join(blocks, ["h", "class"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ("h", "class", "low", "high")
        met = dealt.select("h", "class", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *names[1:])

        def compare(table: pa.Table) -> pa.Table:
            held(None)
            h, node, fp, fp2, size = (table.column(c).to_numpy() for c in names)
            edges = link(h, node, (fp.view(np.uint64), fp2.view(np.uint64)), size)
            return pa.table({"u": edges[:, 0].copy(), "v": edges[:, 1].copy()})

        more = met.repartition(shuffles(texts.sparkSession), *keys).groupBy(*keys).applyInArrow(compare, "u long, v long")
        return edges.union(more).distinct()

    def merged(self, docs: DataFrame, texts: DataFrame) -> DataFrame:
        """(node, component) of every text that is linked with another: pairs of candidates at the similarity or more."""
        parts = cut(components(self.candidates(texts), "u", "v"))
        own = ("node", "fp", "fp2", "size")
        keys = texts.join(parts, "node").select("first_row.doc_id", "first_row._row", "component", *own)
        rows = cut(of_keys(docs, keys, "component", *own).select("component", *own, "_doc.text"))
        blocks = F.ceil(F.greatest(F.count("*") / self.block_texts, F.sum(F.length("text")) / self.block_bytes, F.lit(1.0))).cast("int")
        sizes = cut(rows.groupBy("component").agg(blocks.alias("subs"), F.count("*").alias("n")))
        placed = rows.join(sizes, "component").withColumn("sub", F.pmod(F.xxhash64("node", F.lit(7)), F.col("subs")).cast("int"))
        spread = shuffles(docs.sparkSession)  # not fewer: work per row is more than its bytes tell
        # a set of one block is compared whole; of a larger one every text with a few texts of the set, its hubs (about as many as asked for)
        share = F.xxhash64("node", F.lit(9)) / F.lit(2.0**64) + 0.5
        hubs = placed.where("subs > 1").where(share <= F.lit(float(self.hubs)) / F.col("n"))
        first = placed.select("component", "sub", "subs", F.lit(False).alias("hub"), *own, "text").unionByName(hubs.select("component", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "subs", F.lit(True).alias("hub"), *own, "text"))
        link = self.linking()

        def with_hubs(table: pa.Table) -> pa.Table:
            hub, n = table.column("hub").to_numpy(zero_copy_only=False), table.num_rows
            left, right = (np.flatnonzero(hub), np.flatnonzero(~hub)) if table.column("subs")[0].as_py() > 1 else (np.arange(n), np.arange(n))
            return link(table, left, right, np.arange(n))

        edges = cut(first.repartition(spread, "component", "sub").groupBy("component", "sub").applyInArrow(with_hubs, "u long, v long"))
        big = placed.where("subs > 1").select("component", "sub", "subs", *own, "text")
        if big.isEmpty():
            return components(edges, "u", "v")
        # what the hubs haven't put into the set's largest group is compared with all of the set, block by block
        roots = components(edges, "u", "v").withColumnRenamed("component", "root")
        big = cut(big.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        main = cut(big.groupBy("component", "root").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("root", F.struct("n", "root")).alias("main")))
        rest = cut(big.join(main, "component").where("root <> main").drop("main"))
        others = rest.groupBy("component").agg(blocks.alias("others"))
        visits = rest.join(others, "component").withColumn("other", F.pmod(F.xxhash64("node", F.lit(8)), F.col("others")).cast("int")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        homes = big.join(others, "component").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        columns = ("component", "sub", "other", *own, "text", "root")
        second = homes.select(*columns, F.lit(True).alias("home")).unionByName(visits.select(*columns, F.lit(False).alias("home")))

        def with_rest(table: pa.Table) -> pa.Table:
            home, (_, at, group) = table.column("home").to_numpy(zero_copy_only=False), np.unique(table.column("root").to_numpy(), return_index=True, return_inverse=True)
            return link(table, np.flatnonzero(~home), np.flatnonzero(home), at[group])

        more = second.repartition(spread, "component", "sub", "other").groupBy("component", "sub", "other").applyInArrow(with_rest, "u long, v long")
        return components(edges.union(more), "u", "v")

    def linking(self):
        """A function of a table of texts, two lists of positions and the groups known (smallest positions): edges that connect all pairs
        of one position of each list that are similar and not of one group."""
        k, close, (above, below) = self.shingle, self.close, self.similar

        def link(table: pa.Table, left: np.ndarray, right: np.ndarray, parent: np.ndarray) -> pa.Table:
            held(None)
            node, fp, fp2, size = (table.column(c).to_numpy() for c in ("node", "fp", "fp2", "size"))
            fps = (fp.view(np.uint64), fp2.view(np.uint64))
            sets = [shingle_set(t, k) for t in text_bytes(table.column("text"))]
            known = parent.copy()
            for a in left.tolist():
                others = right[parent[right] != parent[a]]
                for b in others[close(fps, size, a, others)].tolist():
                    if parent[a] != parent[b]:
                        n = int(shared(sets[a], sets[b]).sum())
                        if n * below >= (size[a] + size[b] - n) * above:
                            low, high = sorted((parent[a], parent[b]))
                            parent = np.where(parent == high, low, parent)
            joined = np.flatnonzero(parent != known)
            return pa.table({"u": node[joined], "v": node[parent[joined]]})

        return link

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """docs' own columns: of each group the document with the smallest doc_id (nulls last); of repeated rows one."""
        marked = cut(self.described(docs, self.common_shingles(docs)))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
        # one row per text; a document without words has no shingle and links with its copies only
        texts = marked.groupBy("words").agg(first.alias("first_row"), *[F.first(c).alias(c) for c in ("fp", "fp2", "size", "first")])
        texts = cut(texts.withColumn("node", F.monotonically_increasing_id()))
        drop(marked)
        groups = texts.select("node", "first_row").join(self.merged(docs, texts), "node", "left")
        kept = groups.groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("first_row").alias("first"))
        return of_keys(docs, kept.select("first.*")).select("_doc.*")
