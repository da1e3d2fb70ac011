"""Conversation structure repair: a min-plus matrix scan with (cost, audit) elements.

A conversation is right if its roles' initials read `(s?(ua)+)?`. That is an automaton of four states (nothing yet, after s, after u, after a).
Each turn is a 4 x 4 matrix: the cheapest way, as (cost, edits), to get from a state before the turn to one after it, by keeping it,
giving it another role or deleting it, after any insertions (the closure over them is one fixed matrix). Matrices are multiplied with
minimum for addition and addition of costs and concatenation of edits for multiplication, which is associative; of equal costs the
edits that are least in ASCII win. That is sound as over the same turns no list of edits is the beginning of another of equal cost.

Conversations of up to `long_rows` turns and `long_bytes` of text are shuffled by conversation and solved in the task that meets
them, as a balanced tree of products. Longer ones never come together in a task: their turns are sorted over the whole cluster, runs
of `segment` turns are multiplied each by itself, and the products are multiplied in groups of `fan_in`, level by level, until one is left. The root's
edits are dealt back to the turns, which are repaired where they are. (A root holds 16 lists of edits, so 16 bytes a turn.) The only thing that passes over a long
conversation in one task is its digest, which digests() streams, because a hash of the whole text can't be combined from parts.

Faults of a turn, the first that applies: blank (nothing but white space), duplicate (role and text seen earlier in the conversation; texts
are compared by SHA-256), truncated (doesn't end in . ! or ?). Deleting costs 3 and is required for blank and duplicate turns, a new role
costs 2, an insertion 2, keeping 0; truncated turns that aren't deleted cost 1 more. Edits: K, R, D, I.

Defined cases: null roles and texts are one space; turns are ordered by number, null first, and within a number by role and by the text's
SHA-256; a null conv_id is one conversation; a conversation without turns has no faults, no edits and an empty text; repeated rows are
duplicates; very long texts make a conversation a long one; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lodestone.llm.common import batches_of, cut, in_order, shuffles

#: States: nothing yet, after s, after u, after a. (from, initial) -> to.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
INSERTED = {"u": "user", "a": "assistant"}
#: The ids of at most so many long conversations are broadcast (some MB); more are joined by shuffle.
BROADCAST_LONG = 100_000
#: The six ASCII white-space characters.
WHITE = " \t\n\x0b\x0c\r"

#: Of each pair of states the least (cost, edits), or None where there is no way.
Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]


def least(ways: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(tuple(ways.get((i, j)) for j in range(4)) for i in range(4))


def times(a: Matrix, b: Matrix) -> Matrix:
    rows = []
    for own in a:
        row: list[tuple[int, str] | None] = [None] * 4
        for first, then in zip(own, b, strict=True):
            if first is None:
                continue
            cost, edits = first
            for j, second in enumerate(then):
                if second is None:
                    continue
                total, best = cost + second[0], row[j]
                if best is None or total < best[0]:
                    row[j] = (total, edits + second[1])
                elif total == best[0] and (whole := edits + second[1]) < best[1]:
                    row[j] = (total, whole)
        rows.append(tuple(row))
    return tuple(rows)


def product(matrices: list[Matrix]) -> Matrix:
    """In their order, as a balanced tree."""
    while len(matrices) > 1:
        pairs = [times(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[2 * len(pairs) :]
    return matrices[0] if matrices else UNIT


UNIT = least({(i, i): (0, "") for i in range(4)})


def closure() -> Matrix:
    """Any number of insertions: more than three can't pay, there being four states."""
    one = least({(i, j): (INSERT, "I") for (i, role), j in STEPS.items() if role in INSERTED} | {(i, i): (0, "") for i in range(4)})
    return times(times(one, one), one)


CLOSURE = closure()


@functools.cache
def turn_matrix(initial: str, deleted: bool, truncated: bool) -> Matrix:
    """Insertions, then the turn. initial: s, u, a or nothing for all others; deleted: it must be."""
    ways = {(i, i): (DELETE, "D") for i in range(4)}
    if not deleted:
        more = TRUNCATED if truncated else 0
        ways |= {(i, j): (REROLE + more, "R") for (i, role), j in STEPS.items() if role in INSERTED}
        ways |= {(i, j): (more, "K") for (i, role), j in STEPS.items() if role == initial}
    return times(CLOSURE, least(ways))


def cheapest(whole: Matrix) -> tuple[int, str]:
    row = times(whole, CLOSURE)[0]
    return min(row[j] for j in ENDS if row[j] is not None)


#: What is known of a run of turns: its matrix, and what its neighbours need to count gaps and illegal pairs.
SEGMENT = "costs array<long>, edits array<string>, rows long, first string, last string, illegal long, blank long, duplicate long, truncated long, first_turn long, last_turn long, numbers long"
LEGAL = ("su", "ua", "au")


@dataclass
class Run:
    matrix: Matrix
    rows: int
    first: str
    last: str
    illegal: int
    blank: int
    duplicate: int
    truncated: int
    first_turn: int | None
    last_turn: int | None
    numbers: int

    @classmethod
    def of(cls, initials: list[str], faults: list[str | None], turns: list[int | None]) -> Run:
        matrices = [turn_matrix(i if i in "sua" else "", f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)]
        known = [t for t in turns if t is not None]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        return cls(product(matrices), len(initials), initials[0], initials[-1], illegal, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), known[0] if known else None, known[-1] if known else None, len(set(known)))

    @classmethod
    def joined(cls, runs: list[Run]) -> Run:
        """Of runs that follow one another."""
        out = cls(product([r.matrix for r in runs]), 0, runs[0].first, runs[-1].last, 0, 0, 0, 0, None, None, 0)
        for before, r in zip([None, *runs], runs, strict=False):
            for name in ("rows", "illegal", "blank", "duplicate", "truncated", "numbers"):
                setattr(out, name, getattr(out, name) + getattr(r, name))
            out.illegal += before is not None and before.last + r.first not in LEGAL
            if r.first_turn is not None:
                out.numbers -= out.last_turn == r.first_turn
                out.first_turn = r.first_turn if out.first_turn is None else out.first_turn
                out.last_turn = r.last_turn
        return out

    def report(self) -> tuple:
        cost, audit = cheapest(self.matrix)
        gaps = self.last_turn - self.first_turn + 1 - self.numbers if self.first_turn is not None else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit

    def written(self) -> tuple:
        cells = [c for row in self.matrix for c in row]
        return ([-1 if c is None else c[0] for c in cells], ["" if c is None else c[1] for c in cells], *(getattr(self, n) for n in self.__dataclass_fields__ if n != "matrix"))

    @classmethod
    def read(cls, costs: list[int], edits: list[str], *more) -> Run:
        cells = [None if c < 0 else (c, e) for c, e in zip(costs, edits, strict=True)]
        return cls(tuple(tuple(cells[i : i + 4]) for i in range(0, 16, 4)), *more)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "turns array<struct<role string, text string>>"


def typed(key: T.StructField, *fields: str) -> T.StructType:
    """The schema of a key and further fields."""
    return T.StructType([key, *(f for own in fields for f in T.StructType.fromDDL(own))])


def applied(edits: str, before: int, role: str, text: str) -> list[dict]:
    """What a turn becomes. edits: insertions, its own letter, and insertions after it where it is the last; before: how many turns
    of u and a there are before."""
    out = []
    for letter in edits:
        if letter == "D":
            continue
        if letter == "K":
            out.append({"role": role, "text": text})
            before += not (role[:1] == "s")
            continue
        out.append({"role": "assistant" if before % 2 else "user", "text": text if letter == "R" else ""})
        before += 1
    return out


def by_turn(audit: str, rows: int) -> list[str]:
    """The audit cut after each turn's own letter; the last turn's part holds what is inserted at the end."""
    out, at = [], 0
    for i, letter in enumerate(audit):
        if letter != "I":
            out.append(audit[at : i + 1])
            at = i + 1
    if out:
        out[-1] += audit[at:]
    if len(out) != rows:
        raise ValueError(f"an audit of {len(out)} turns for {rows}")
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """op13's damage: of rows (conv_id, turn, role, text) one in twenty each, by the CRC-32 of conv_id:turn, is dropped, emptied, without its
    . ! and ?, repeated, and of role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    kept = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    k = F.col("_kind")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return kept.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


@dataclass(frozen=True)
class Repair:
    long_rows: int = 256
    long_bytes: int = 16 << 20
    segment: int = 128
    fan_in: int = 16

    def repaired(self, rows: DataFrame) -> DataFrame:
        """rows (conv_id, turn, role, text) -> (conv_id, long, part, report struct, turns array of (role, text)).

        A conversation that isn't long is one row. A long one is one row with its report and no turns, and a row without report for
        each of its turns, in the order of part, with what becomes of it (nothing, itself, insertions)."""
        own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
        text = F.rtrim("text", F.lit(WHITE))
        fault = F.when(text == "", "blank").when(~F.right(text, F.lit(1)).isin(".", "!", "?"), "truncated")
        own = own.select("*", fault.alias("fault"), F.sha2("text", 256).alias("hash"))
        sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
        long = cut(sizes.where((F.col("n") > self.long_rows) | (F.col("bytes") > self.long_bytes)).select(F.col("conv_id").alias("_long")))
        many = long.count()
        if not many:
            return self.short(own)
        long = F.broadcast(long) if many <= BROADCAST_LONG else long
        there = F.col("conv_id").eqNullSafe(F.col("_long"))
        return self.short(own.join(long, there, "left_anti")).unionByName(self.spread(own.join(long, there, "left_semi")))

    def short(self, rows: DataFrame) -> DataFrame:
        kind = typed(rows.schema["conv_id"], REPORT, TURNS)
        placed = rows.repartition(shuffles(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "hash")
        done = placed.select("conv_id", "turn", "role", "text", "fault", "hash").mapInArrow(solved, kind)
        return done.select("conv_id", F.lit(False).alias("long"), F.lit(0).cast("long").alias("part"), F.struct(*T.StructType.fromDDL(REPORT).names).alias("report"), "turns")

    def spread(self, rows: DataFrame) -> DataFrame:
        key = rows.schema["conv_id"]
        placed = in_order(rows, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")], "place")
        # a partition's places begin at a multiple of a large power of two, so no segment is in two partitions
        segment = F.expr(f"place div {self.segment}").alias("segment")
        solid = placed.where("fault is null or fault <> 'blank'").select(F.struct("conv_id", "role", "hash").alias("same"), "place")
        first = solid.groupBy("same").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
        again = solid.join(first, "same").where("place > first").select("place", F.lit("duplicate").alias("again"))
        judged = placed.select("conv_id", segment, "place", "turn", F.left("role", F.lit(1)).alias("initial"), "fault").join(again, "place", "left").withColumn("fault", F.coalesce("again", "fault")).drop("again")
        kind = typed(key, "node long", SEGMENT)
        runs = judged.groupBy("conv_id", "segment").applyInArrow(segment_run, kind)
        tree = cut(runs.withColumn("node", (F.row_number().over(W.partitionBy("conv_id").orderBy("node")) - 1).cast("long")))  # a row per segment
        nodes = tree.agg(F.max("node").alias("n")).first()["n"] + 1
        while nodes > 1:
            tree = tree.groupBy("conv_id", F.expr(f"node div {self.fan_in}").alias("parent")).applyInArrow(joined_runs(self.fan_in), kind)
            nodes = -(-nodes // self.fan_in)
        roots = cut(tree.mapInArrow(reports, typed(key, REPORT)))
        # an audit's letters go back to the turns; a conversation's segments tell their places
        sizes = placed.groupBy("conv_id", segment).agg(F.min("place").alias("start"), F.count("*").alias("n"))
        segments = sizes.groupBy(F.col("conv_id").alias("_conv")).agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("segments"))
        edits = roots.join(segments, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("audit", "segments").mapInArrow(dealt, "place long, edits string, before long")
        turns = placed.select("conv_id", "place", "role", "text").join(edits, "place").mapInArrow(turns_of, typed(key, "part long", TURNS))
        shape = lambda df, part, report, own: df.select("conv_id", F.lit(True).alias("long"), part.cast("long").alias("part"), report.alias("report"), own.alias("turns"))
        report = F.struct(*T.StructType.fromDDL(REPORT).names)
        told = shape(roots, F.lit(-1), report, F.lit(None).cast(turns.schema["turns"].dataType))
        return told.unionByName(shape(turns, F.col("part"), F.lit(None).cast(told.schema["report"].dataType), F.col("turns")))


def records(fields: list[pa.Field], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


ARROW = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


def arrow(ddl: str) -> list[pa.Field]:
    return [pa.field(name, ARROW[kind]) for name, kind in (f.strip().split(" ") for f in ddl.split(","))]


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns (conv_id, turn, role, text, fault, hash), sorted, to (conv_id, report, turns). A task holds a conversation at a time."""
    fields, ready, held = None, [], 0
    open_rows: list[tuple] = []

    def closed() -> tuple:
        seen, faults = set(), []
        for _, _, role, _, fault, digest in open_rows:
            new = (role, digest) not in seen
            seen.add((role, digest))
            faults.append(fault if fault == "blank" or new else "duplicate")
        report = Run.of([r[2][:1] for r in open_rows], faults, [r[1] for r in open_rows]).report()
        out, before = [], 0
        for row, edits in zip(open_rows, by_turn(report[-1], len(open_rows)), strict=True):
            own = applied(edits, before, row[2], row[3])
            before += counted(own, before)
            out += own
        return (open_rows[0][0], *report, out)

    for batch in batches_of(batches, "text"):
        fields = [batch.schema.field("conv_id"), *arrow(REPORT), pa.field("turns", pa.list_(TURN))]
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if open_rows and open_rows[0][0] != row[0]:
                ready.append(closed())
                held += sum(len(r[3]) for r in open_rows)
                open_rows = []
                if held > 4 << 20 or len(ready) == 4096:
                    yield records(fields, ready)
                    ready, held = [], 0
            open_rows.append(row)
    if open_rows:
        yield records(fields, [*ready, closed()])


def counted(turns: list[dict], before: int) -> int:
    """Those of u and a: all but an s at the beginning."""
    return len(turns) - (before == 0 and bool(turns) and turns[0]["role"][:1] == "s")


def segment_run(table: pa.Table) -> pa.Table:
    """applyInArrow on a segment's turns (conv_id, segment, place, turn, initial, fault)."""
    table = table.sort_by("place")
    run = Run.of(*(table.column(c).to_pylist() for c in ("initial", "fault", "turn")))
    return run_table(table, table.column("segment")[0].as_py(), run)


def joined_runs(fan_in: int) -> Callable[[pa.Table], pa.Table]:
    """applyInArrow on neighbouring nodes of a conversation: their parent."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        names = [f.name for f in arrow(SEGMENT)]
        run = Run.joined([Run.read(*row) for row in zip(*(table.column(n).to_pylist() for n in names), strict=True)])
        return run_table(table, table.column("node")[0].as_py() // fan_in, run)

    return join


def run_table(like: pa.Table, node: int, run: Run) -> pa.Table:
    fields = [like.schema.field("conv_id"), pa.field("node", pa.int64()), *arrow(SEGMENT)]
    return pa.Table.from_batches([records(fields, [(like.column("conv_id")[0].as_py(), node, *run.written())])])


def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in arrow(SEGMENT)]
    for batch in batches:
        rows = zip(batch.column("conv_id").to_pylist(), *(batch.column(n).to_pylist() for n in names), strict=True)
        yield records([batch.schema.field("conv_id"), *arrow(REPORT)], [(conv, *Run.read(*own).report()) for conv, *own in rows])


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(audit, segments (start, n)) to a row (place, edits, before) per turn."""
    fields = arrow("place long, edits string, before long")
    for batch in batches:
        for audit, segments in zip(batch.column("audit").to_pylist(), batch.column("segments").to_pylist(), strict=True):
            places = (s["start"] + i for s in segments for i in range(s["n"]))
            parts = by_turn(audit, sum(s["n"] for s in segments))
            system = (len(audit) - audit.count("D")) % 2  # those of u and a are even, so an odd one is an s
            made, rows = 0, []
            for place, edits in zip(places, parts, strict=True):
                rows.append((place, edits, max(0, made - system)))
                made += len(edits) - edits.count("D")
                if len(rows) == 65_536:
                    yield records(fields, rows)
                    rows = []
            yield records(fields, rows)


def turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, "text"):
        rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", "edits", "before")), strict=True)
        yield records([batch.schema.field("conv_id"), pa.field("part", pa.int64()), pa.field("turns", pa.list_(TURN))], [(conv, place, applied(edits, before, role, text)) for conv, place, role, text, edits, before in rows])


def digests(repaired: DataFrame, rows: DataFrame) -> DataFrame:
    """op13's rows: one for every conv_id of rows, also of those of which the damage left nothing."""
    lines = F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"]))
    at_once = repaired.where("not long").select("conv_id", "report", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    long = repaired.where("long")
    streamed = long.where("report is null").select("conv_id", "part", lines.alias("lines")).repartition(shuffles(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    hashed = streamed.mapInArrow(streamed_digest, typed(rows.schema["conv_id"], "repaired_sha256 string")).withColumnRenamed("conv_id", "_conv")
    told = long.where("report is not null").join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "report", "repaired_sha256")
    every = rows.select(F.col("conv_id").alias("_conv")).distinct()
    all_of = every.join(at_once.unionByName(told), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = lambda n: F.coalesce(F.col(f"report.{n}"), F.lit(0).cast("long")).alias(n)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return all_of.select(F.col("_conv").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("report.audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


def streamed_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts (conv_id, part, lines), sorted: the SHA-256 of each conversation's lines, joined by newlines. A task holds a batch at a time."""
    fields, conv, digest, some, done = None, None, None, False, []
    for batch in batches:
        fields = [batch.schema.field("conv_id"), pa.field("repaired_sha256", pa.string())]
        for own, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if digest is None or own != conv:
                done += [] if digest is None else [(conv, digest.hexdigest())]
                conv, digest, some = own, hashlib.sha256(), False
            for line in lines:
                digest.update((b"\n" if some else b"") + line.encode())
                some = True
    if digest is not None:
        yield records(fields, [*done, (conv, digest.hexdigest())])


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295)::BIGINT % 20 AS k
  FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE k <> 0),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM damaged),
judged AS (
  SELECT conv_id, turn, role, text, initial, pos, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair,
    CASE WHEN rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
report AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
inserted(i, j, n, lines) AS (VALUES (0, 0, 0, []::VARCHAR[]), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (3, 2, 1, ['user:']), (2, 3, 1, ['assistant:']), (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])),
steps(i, initial, j, role) AS (VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
edits AS (
  SELECT conv_id, pos, s.i, s.j, 'K' AS letter, (fault = 'truncated')::INTEGER AS cost, [t.role || ':' || t.text] AS lines FROM judged t JOIN steps s USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, pos, s.i, s.j, 'R', 2 + (fault = 'truncated')::INTEGER, [s.role || ':' || t.text] FROM judged t JOIN steps s ON s.role IS NOT NULL WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, pos, i, i, 'D', 3, [] FROM judged, range(4) r(i)),
ways AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS way FROM report
  UNION ALL
  SELECT conv_id, pos, state, min(way) FROM (
    SELECT w.conv_id, e.pos, e.j::INTEGER AS state, {'cost': (w.way.cost + 2 * c.n + e.cost)::BIGINT, 'audit': w.way.audit || repeat('I', c.n) || e.letter, 'lines': w.way.lines || c.lines || e.lines} AS way
    FROM ways w JOIN inserted c ON c.i = w.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.pos = w.pos + 1 AND e.i = c.j) GROUP BY ALL),
ends AS (
  SELECT w.conv_id, min({'cost': w.way.cost + 2 * c.n, 'audit': w.way.audit || repeat('I', c.n), 'lines': w.way.lines || c.lines}) AS way
  FROM ways w JOIN (SELECT conv_id, max(pos) AS pos FROM judged GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos JOIN inserted c ON c.i = w.state AND c.j IN (0, 3) GROUP BY w.conv_id)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) every LEFT JOIN report ON report.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM every.conv_id
"""
