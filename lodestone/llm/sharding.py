"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in the order of their keys (a distributed sort; no task holds more than its range). A keyed permutation of
0 .. n-1 turns the number into a position, whose remainder by the number of shards is the shard and whose quotient is the slot. So
the counts of any two shards differ by one at most, slots have no gaps, and both directions are computed, not stored: the shard and
slot of a row number, and the row number of a shard and slot. Equal input, seed and number of shards give equal places, however the
rows are dealt over files and tasks.

The permutation works on pairs of digits to a base whose square is the least one that isn't below n; each round adds to one digit a
keyed fifth power of the other. What falls outside 0 .. n-1 is permuted again until it doesn't (cycle walking): some 2 of sqrt(n) numbers.

Defined cases: a null text has no bytes (size 16, CRC 0); rows with a null key come first; rows of equal keys are ordered by a 128-bit hash
of the whole row, and equal rows are interchangeable; every row is placed by itself, equal texts don't stay together (the law is `rows`); an empty table gives no rows;
extra columns, whatever their names, stay inside `row`.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import numbered, packed

#: Rounds reckon modulo this prime (2^31 - 1), so that products stay within 64 bits; it also bounds the base.
PRIME = 2**31 - 1


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 .. n-1, keyed by a seed."""

    n: int
    seed: int = 42
    rounds: int = 6

    def __post_init__(self) -> None:
        if not 0 <= self.n <= PRIME * PRIME:
            raise ValueError(f"a permutation of {self.n} numbers is beyond 64-bit arithmetic")

    @property
    def base(self) -> int:
        return max(1, math.isqrt(self.n - 1) + 1) if self.n else 1

    @property
    def keys(self) -> list[int]:
        return [zlib.crc32(f"{self.seed}:{i}".encode()) % PRIME for i in range(self.rounds)]

    def mixed(self, digit: np.ndarray, key: int) -> np.ndarray:
        x = (digit + key) % PRIME
        square = x * x % PRIME
        return square * square % PRIME * x % PRIME

    def step(self, x: np.ndarray) -> np.ndarray:
        left, right = np.divmod(x, self.base)
        for key in self.keys:
            left, right = right, (left + self.mixed(right, key)) % self.base
        return left * self.base + right

    def step_back(self, x: np.ndarray) -> np.ndarray:
        left, right = np.divmod(x, self.base)
        for key in reversed(self.keys):
            left, right = (right - self.mixed(left, key)) % self.base, left
        return left * self.base + right

    def walked(self, x: np.ndarray, step) -> np.ndarray:
        """step, again and again while outside: the walk follows a cycle of the larger set and must come back to x's own."""
        x = np.asarray(x, np.int64)
        if len(x) and not (0 <= x.min() and x.max() < self.n):
            raise ValueError(f"numbers must be within 0 and {self.n - 1}")
        x = step(x)
        while len(out := np.flatnonzero(x >= self.n)):
            x[out] = step(x[out])
        return x

    def position(self, number: np.ndarray) -> np.ndarray:
        return self.walked(number, self.step)

    def number(self, position: np.ndarray) -> np.ndarray:
        return self.walked(position, self.step_back)


@dataclass(frozen=True)
class Shards:
    shards: int = 40
    seed: int = 42

    def placed(self, docs: DataFrame, by: list[str]) -> DataFrame:
        """(row struct, number, shard, slot): every row, numbered in the order of the columns `by`, and its place."""
        row = packed(docs, "row")
        fields = [F.col("row").getField(c) for c in by]
        rows = numbered(row, [*(f.asc_nulls_first() for f in fields), F.xxhash64("row"), F.xxhash64(F.lit(self.seed), "row")], "number")
        return self.located(rows, rows.count())

    def located(self, rows: DataFrame, n: int) -> DataFrame:
        """rows with a number below n -> with shard and slot."""
        permutation = Permutation(n, self.seed)

        @F.pandas_udf("long")
        def position(number: pd.Series) -> pd.Series:
            return pd.Series(permutation.position(number.to_numpy()))

        p = F.col("_position")
        return rows.withColumn("_position", position("number")).withColumns({"shard": F.pmod(p, F.lit(self.shards)).cast("int"), "slot": F.expr(f"_position div {self.shards}")}).drop("_position")

    def numbers(self, places: DataFrame, n: int) -> DataFrame:
        """places (shard, slot) of n rows -> with the number of the row that is there, null where none is."""
        permutation = Permutation(n, self.seed)

        @F.pandas_udf("long")
        def number(position: pd.Series) -> pd.Series:
            return pd.Series(permutation.number(position.to_numpy()))

        p = F.col("slot").cast("long") * self.shards + F.col("shard")
        inside = (F.col("shard") >= 0) & (F.col("shard") < self.shards) & (F.col("slot") >= 0) & (p < n)
        return places.withColumn("number", F.when(inside, number(F.when(inside, p).otherwise(0))) if n else F.lit(None).cast("long"))


def size_of(text: Column) -> Column:
    """UTF-8 bytes, none for null, and 16 for the row itself."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def sql(shards: int = 40, seed: int = 42) -> str:
    """DuckDB SQL of op12's rows. CRC32 is folded over the bytes, with a table made from its polynomial."""
    p = Permutation(1, seed)
    x = f"((r + k) % {PRIME})"
    square = f"({x} * {x} % {PRIME})"
    mixed = f"({square} * {square} % {PRIME} * {x} % {PRIME})"
    keys = ", ".join(f"({i}, {k}::BIGINT)" for i, k in enumerate(p.keys))
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc),
n AS (SELECT count(*) AS n, greatest(1, ceil(sqrt(count(*))))::BIGINT AS base FROM d),
rounds(i, k) AS (VALUES {keys}),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS number FROM d),
walk AS (
  SELECT number, 0 AS i, number // base AS l, number % base AS r FROM numbered, n
  UNION ALL
  SELECT number, CASE WHEN w.i < {p.rounds} THEN w.i + 1 ELSE 1 END, nl, nr FROM (
    SELECT w.number, w.i, r AS nl, (l + {mixed}) % base AS nr
    FROM (SELECT number, i % {p.rounds} AS j, i, l, r FROM walk, n WHERE i < {p.rounds} OR l * base + r >= n) w JOIN rounds ON rounds.i = w.j, n) w),
ends AS (SELECT number, l * base + r AS p FROM walk, n WHERE i = {p.rounds} AND l * base + r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INTEGER AS shard, p // {shards} AS slot, NULL::INTEGER AS grown_shard FROM numbered JOIN ends USING (number)
"""


SQL = sql()
