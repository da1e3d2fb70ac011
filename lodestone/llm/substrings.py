"""Substring dedup by super-k-mers: words covered by a window of words that occurs elsewhere too are removed.

A window is `window` consecutive words of one document. Its minimiser is the smallest hash among the runs of `seed_words`
words in it. Consecutive windows with one minimiser form a super-k-mer: all their words as one packed string, which goes
to the minimiser's bucket. Equal windows have equal minimisers, so they meet in one bucket, and there sorting counts them
exactly: windows are sorted by a hash of their bytes, and neighbours with equal hashes are compared byte by byte.

The order of seeds is by how often they occur, the rarest first (then by hash), so the windows around a common phrase go to the
buckets of their own words, and only windows inside it, of which there are few different ones, stay with its seeds. For that,
all seeds of all documents are counted in a sketch: `cells` counters, each of the seeds whose hash falls on it, added up within
tasks and then over tasks; what goes to every task is the binary logarithm of each, a byte a cell, whatever the corpus. No seed
is left out for being beyond a list or below a threshold; seeds that share a cell share its rank, which changes buckets, not results.

First pass: each task packs its super-k-mers by bucket and sends a repeated one once, with a mark that it repeats, so a
passage in a third of all documents costs a bucket one string per task, not one per document. Buckets answer with a bit
per window for strings that hold a repeated window, keyed by the string's 128-bit hash. Second pass: documents look their
super-k-mers up by that hash (a join whose skewed keys AQE splits) and get the covered stretches of words. Last, the
stretches join the documents, and the words are removed. The whole text of every document takes part.

Memory: a task of the first pass holds one Arrow batch and its packed strings (48 MB) at a time; a bucket holds about
`bucket_bytes` of packed text. Shuffled strings are removed as soon as the buckets have answered.

Defined cases: a null text has no words; texts shorter than a window keep all words; a window repeated inside one document
counts; repeated rows (equal doc_id and text) repeat each other's windows and come out as rows of their own; a null doc_id
is a value like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import batches_of, cut, drop, text_bytes

#: Odd, so it has an inverse modulo 2^64: byte hashes of stretches come from one running sum.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


#: Counters travel in chunks of so many, and so many chunks meet in one task.
CELLS_CHUNK, FAN_IN = 1 << 16, 256
CHUNK = 1 << 18
UP, DOWN = powers(BASE, CHUNK), powers(INVERSE, CHUNK)


class Rolling:
    """Hashes of stretches from word to word, equal for equal bytes wherever they stand: differences of a running sum, moved to place 0."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.at_start, self.at_end, self.back = (np.empty(len(starts), np.uint64) for _ in range(3))
        carry, up, down = 0, 1, 1
        with np.errstate(over="ignore"):
            for o in range(0, len(buffer), CHUNK):
                part = buffer[o : o + CHUNK].astype(np.uint64) + np.uint64(1)
                sums = np.cumsum(part * UP[: len(part)], dtype=np.uint64) * np.uint64(up) + np.uint64(carry)
                before = np.concatenate((np.array([carry], np.uint64), sums[:-1]))
                for points, out in ((starts, self.at_start), (ends, self.at_end)):
                    lo, hi = np.searchsorted(points, (o, o + len(part)))
                    out[lo:hi] = before[points[lo:hi] - o]
                lo, hi = np.searchsorted(starts, (o, o + len(part)))
                self.back[lo:hi] = DOWN[starts[lo:hi] - o] * np.uint64(down)
                carry, up, down = int(sums[-1]), up * pow(BASE, CHUNK, 1 << 64) % (1 << 64), down * pow(INVERSE, CHUNK, 1 << 64) % (1 << 64)

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.at_end[last] - self.at_start[first]) * self.back[first]
            x = (x ^ (x >> np.uint64(32))) * MIX
            x = (x ^ (x >> np.uint64(29))) * MIX
            return x ^ (x >> np.uint64(32))


def bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts whose words are joined by one space and which each end with a newline."""
    ends = np.flatnonzero((buffer == 32) | (buffer == 10))
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    return starts, ends


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i that has w values."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - span :][: len(x) - w + 1]) if w > span else out


@dataclass(frozen=True)
class Windows:
    window: int = 35
    seed_words: int = 6
    bucket_bytes: int = 6 << 20
    #: Counters of the sketch, a power of two: 4 bytes each in a task that counts, one byte each in a task that packs.
    cells: int = 1 << 22
    #: Texts are worked on in groups of about so many bytes.
    group_bytes: int = 2 << 20

    def groups(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts by groups of about group_bytes: number of the first, bytes, the same as array, starts and ends of the words."""
        at = 0
        while at < len(texts):
            group, size, first = [], 0, at
            while at < len(texts) and (not group or size < self.group_bytes):
                group.append(texts[at])
                size += len(texts[at]) + 1
                at += 1
            raw = b"\n".join(group) + b"\n"
            buffer = np.frombuffer(raw, np.uint8)
            yield first, raw, buffer, *bounds(buffer)

    def seed_hashes(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """63 bits for each run of seed_words words; runs across two texts are among them, and are part of no window."""
        first = np.arange(max(0, len(starts) - self.seed_words + 1))
        return Rolling(buffer, starts, ends)(first, first + self.seed_words - 1) >> np.uint64(1)

    def super_kmers(self, texts: list[bytes], ranks: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For groups of texts (words joined by single spaces): buffer, number of each super-k-mer's text, word position in it, windows, byte start, byte end, minimiser."""
        for first, raw, buffer, starts, ends in self.groups(texts):
            line_of = np.cumsum(buffer[ends] == 10) - (buffer[ends] == 10)  # the text each word is of
            n = len(starts)
            if n < self.window:
                continue
            hashes = self.seed_hashes(buffer, starts, ends)
            hashes = (ranks[self.cell(hashes)].astype(np.uint64) << np.uint64(58)) | (hashes >> np.uint64(5))
            least = sliding_min(hashes, self.window - self.seed_words + 1)
            whole = line_of[: n - self.window + 1] == line_of[self.window - 1 :]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1]) | (line_of[1 : len(least)] != line_of[: len(least) - 1])
            begin = np.flatnonzero(new & whole)
            if not len(begin):
                continue
            cuts = np.append(np.flatnonzero(new), len(least))
            count = cuts[np.searchsorted(cuts, begin, side="right")] - begin
            word0 = np.searchsorted(line_of, line_of[begin])
            yield raw, line_of[begin] + first, begin - word0, count, starts[begin], ends[begin + count + self.window - 2], least[begin]

    def cell(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(63 - self.cells.bit_length() + 1)).astype(np.int64)

    def ranks(self, texts: DataFrame) -> tuple[np.ndarray, int]:
        """The binary logarithm of the number of seeds on each cell, and the bytes of all texts."""
        pack, unpack = (lambda x: zstandard.ZstdCompressor(level=1).compress(x.tobytes())), (lambda raw: np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64))
        chunk = min(CELLS_CHUNK, self.cells)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, size = np.zeros(self.cells, np.int32), 0
            for batch in batches_of(batches, "text"):
                for _, raw, buffer, starts, ends in self.groups([b" ".join(t.split()) for t in text_bytes(batch.column("text"))]):
                    line_of, hashes = np.cumsum(buffer[ends] == 10) - (buffer[ends] == 10), self.seed_hashes(buffer, starts, ends)
                    np.add.at(counts, self.cell(hashes[line_of[: len(hashes)] == line_of[len(line_of) - len(hashes) :]]), 1)  # of one text
                    size += len(raw)
            if size:
                some = [c for c in range(self.cells // chunk) if counts[c * chunk : (c + 1) * chunk].any()]
                blobs = [pack(np.array([size], np.int64)), *(pack(counts[c * chunk : (c + 1) * chunk].astype(np.int64)) for c in some)]
                yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "counts"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(unpack(blob.as_py()) for blob in table.column("counts"))
            return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([pack(total)], pa.binary())})

        sent = texts.mapInArrow(count, "chunk int, counts binary").withColumn("part", F.spark_partition_id())
        n = texts.rdd.getNumPartitions()
        while True:
            n = -(-n // FAN_IN)
            sent = sent.select("chunk", F.floor(F.col("part") / FAN_IN).cast("int").alias("part"), "counts").groupBy("chunk", "part").applyInArrow(add, "chunk int, part int, counts binary")
            if n <= 1:
                break
        ranks, size = np.zeros(self.cells, np.uint8), 0
        for r in sent.select("chunk", "counts").toLocalIterator():  # a row per chunk of cells, whatever the input
            if r["chunk"] < 0:
                size = int(unpack(r["counts"])[0])
            else:
                ranks[r["chunk"] * chunk :][:chunk] = np.log2(unpack(r["counts"]) + 1.0)
        return ranks, size

    def send(self, buckets: int, ranks: np.ndarray):
        """mapInArrow: texts -> (bucket, packed); packed is compressed and holds marks and strings."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = zstandard.ZstdCompressor(level=3)
            held: dict[int, dict[bytes, bool]] = {}
            size = 0

            def flush() -> pa.RecordBatch:
                keys, blobs = list(held), []
                for k in keys:
                    strings = list(held[k])
                    marks = bytes(held[k].values())
                    blobs.append(pack.compress(struct.pack("<I", len(strings)) + marks + b"\n".join(strings) + b"\n"))
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

            for batch in batches_of(batches, "text"):
                texts = [b" ".join(t.split()) for t in text_bytes(batch.column("text"))]
                for raw, _, _, _, start, end, least in self.super_kmers(texts, ranks):
                    for a, b, k in zip(start.tolist(), end.tolist(), (least % np.uint64(buckets)).tolist(), strict=True):
                        s = raw[a:b]
                        own = held.get(k)
                        if own is None:
                            own = held[k] = {}
                        if s in own:
                            own[s] = True
                        else:
                            own[s] = False
                            size += b - a + 120
                    if size > 48 << 20:
                        yield flush()
                        size = 0
            if held:
                yield flush()

        return run

    def count(self, table: pa.Table) -> pa.Table:
        """applyInArrow on a bucket: its strings -> those with repeated windows, as hash and a byte per window."""
        merged: dict[bytes, bool] = {}
        unpack = zstandard.ZstdDecompressor()
        for blob in table.column("packed"):
            raw = unpack.decompress(blob.as_py())
            n = struct.unpack_from("<I", raw)[0]
            for mark, s in zip(raw[4 : 4 + n], raw[4 + n :].split(b"\n"), strict=False):
                merged[s] = bool(mark) or s in merged
        strings, twice = list(merged), np.fromiter(merged.values(), bool, len(merged))
        del merged
        raw = b"\n".join(strings) + b"\n"
        buffer = np.frombuffer(raw, np.uint8)
        starts, ends = bounds(buffer)
        last = np.flatnonzero(buffer[ends] == 10)  # each string's last word
        n_windows = np.diff(np.concatenate(([-1], last))) - self.window + 1
        string_of = np.repeat(np.arange(len(strings)), n_windows)
        offset = np.arange(len(string_of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        word = np.repeat(np.concatenate(([0], last[:-1] + 1)), n_windows) + offset
        a, b = starts[word], ends[word + self.window - 1]
        hashes = Rolling(buffer, starts, ends)(word, word + self.window - 1)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        repeated = np.repeat(twice, n_windows)
        # neighbours in a run of equal hashes are compared; a run with different windows is counted by its bytes
        edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            run = order[lo : hi + 1]
            p, q = a[run].tolist(), b[run].tolist()
            base = raw[p[0] : q[0]]
            if all(y - x == len(base) and raw[x:y] == base for x, y in zip(p[1:], q[1:], strict=True)):
                repeated[run] = True
            else:
                seen: dict[bytes, list[int]] = {}
                for i, x, y in zip(run.tolist(), p, q, strict=True):
                    seen.setdefault(raw[x:y], []).append(i)
                for own in seen.values():
                    if len(own) > 1:
                        repeated[own] = True
        hit = np.unique(string_of[repeated])
        first = np.cumsum(n_windows) - n_windows
        flags = repeated.astype(np.uint8).tobytes()
        digests = [xxhash.xxh3_128_digest(strings[i]) for i in hit.tolist()]
        return pa.table({"h": pa.array(digests, pa.binary()), "bits": pa.array([flags[first[i] : first[i] + n_windows[i]] for i in hit.tolist()], pa.binary())})

    def refer(self, batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
        """mapInArrow: (row, row2, text) -> (h, row, row2, at) of every super-k-mer."""
        for batch in batches_of(batches, "text"):
            texts = [b" ".join(t.split()) for t in text_bytes(batch.column("text"))]
            for raw, text, at, _, start, end, _ in self.super_kmers(texts, ranks):
                digests = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                text = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column("row").take(text), batch.column("row2").take(text), pa.array(at.astype(np.int32))], names=["h", "row", "row2", "at"])

    def stretches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow: (row, row2, at, bits) -> (row, row2, lo, hi), the words that repeated windows cover."""
        for batch in batches:
            rows, lo, hi = [], [], []
            for i, (at, bits) in enumerate(zip(batch.column("at").to_pylist(), batch.column("bits").to_pylist(), strict=True)):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], np.frombuffer(bits, np.uint8), [0])).astype(np.int8))).tolist()
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    rows.append(i)
                    lo.append(at + a)
                    hi.append(at + b + self.window - 1)
            of = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(of), batch.column("row2").take(of), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["row", "row2", "lo", "hi"])


def row_key() -> list[Column]:
    """Two hashes, 128 bits, that name a row by its doc_id and text; rows that agree in both get the same stretches anyway."""
    return [F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("row2")]


def covered(docs: DataFrame, method: Windows = Windows()) -> DataFrame:
    """(row, row2, stretches): for each row_key() with repeated windows the array of (lo, hi) word positions they cover."""
    ranks, total = method.ranks(docs.select("text"))
    buckets = max(1, -(-3 * total // method.bucket_bytes))
    sent = docs.select("text").mapInArrow(method.send(buckets, ranks), "bucket int, packed binary")
    known = cut(sent.groupBy("bucket").applyInArrow(lambda rows: method.count(rows), "h binary, bits binary"))
    own = docs.select(*row_key(), "text").mapInArrow(lambda batches: method.refer(batches, ranks), "h binary, row long, row2 long, at int")
    found = own.join(known, "h").select("row", "row2", "at", "bits").mapInArrow(lambda batches: method.stretches(batches), "row long, row2 long, lo int, hi int")
    # equal rows bring equal stretches more than once; a set keeps one
    out = cut(found.groupBy("row", "row2").agg(F.collect_set(F.struct("lo", "hi")).alias("stretches")))
    drop(known)
    return out


def removed(docs: DataFrame, method: Windows = Windows()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document; kept is what is left, words joined by one space."""
    rows = docs.select("doc_id", "text", *row_key()).join(covered(docs, method), ["row", "row2"], "left").select("doc_id", "text", "stretches")
    kind = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, found in zip(text_bytes(batch.column("text")), batch.column("stretches"), strict=True):
                words = text.split()
                left, at = [], 0
                for x in sorted((x["lo"], x["hi"]) for x in found.as_py() or ()):
                    if x[1] > at:
                        left += words[at : max(at, x[0])]
                        at = x[1]
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, T.StructType([kind, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, i + k AS i FROM windows SEMI JOIN repeated USING (s), unnest(range(0, 35)) AS u(k)),
kept AS (SELECT r, string_agg(w[i], ' ' ORDER BY i) AS text, count(*) AS n FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) x ANTI JOIN hit USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
