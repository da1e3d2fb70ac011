"""Mixing sources to target weights: Efraimidis-Spirakis sampling in DataFrame operations only.

Each document gets the key -ln(u) / quality, u being a number in (0, 1) that depends on its doc_id and a seed alone (on its
text, where the doc_id is null). A source's target pays for complete epochs first (every document once per epoch); the rest is
a budget for one more, partial epoch: documents in the order of their keys, prefix-summed by size, up to the document that
brings the sum nearest to the budget.

No source is ever gathered or sorted in one task. Keys fall into buckets; the buckets' sizes are summed before the
shuffle; the running sum over buckets names the one bucket of each source in which the budget ends, and only that
bucket's rows (about 1/4096 of the source) are sorted for the exact cut. The outcome is a plan with one row per source.
Rows of equal key and size are copies, counted before they are sorted. Where the cut falls among copies, they are numbered
(per partition, with the partitions' counts summed up first), and as many as the budget pays for are taken.

Defined cases: a null text has size 0; documents without words (size 0) add nothing to any target, so mixed_documents()
leaves them out, also where complete epochs take all others of their source; a null source is a source of its own, ordered last; sources without words get
target 0; documents with a null doc_id are told apart by their texts, and which of several copies are taken is any; an
empty table gives no rows. Extra columns, whatever their names, are kept by mixed_documents().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm.common import WORD, cut, packed

#: A plan of at most so many sources is broadcast (some 10 MB); a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Marks of junk that lower a document's quality weight.
JUNK = r"[#$%&*|!]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: 1 for text without junk marks, falling with the marks per word."""
    junk = F.coalesce(F.regexp_count(text, F.lit(JUNK)), F.lit(0)).cast("double")
    return F.when(size > 0, F.lit(1.0) / (F.lit(1.0) + F.lit(4.0) * junk / size)).otherwise(F.lit(1.0))


def key_of(doc_id: Column, text: Column, quality: Column, seed: str) -> Column:
    """-ln(u) / quality; u has 52 bits of the MD5 of seed and doc_id, or of seed and the text's MD5."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / quality


@dataclass(frozen=True)
class Mixer:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    max_epochs: int = 3
    seed: str = "mix"
    buckets: int = 4096

    def keyed(self, docs: DataFrame) -> DataFrame:
        """(doc_id, source, size, key), the narrow table that planning needs."""
        sized = docs.select("doc_id", "source", "text", size_of(F.col("text")).alias("size"))
        return sized.select("doc_id", "source", "size", self.key().alias("key"))

    def key(self) -> Column:
        """The key of rows (doc_id, text, size)."""
        return key_of(F.col("doc_id"), F.col("text"), quality_of(F.col("text"), F.col("size")), self.seed)

    def _bucket(self) -> Column:
        return F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * self.buckets), F.lit(self.buckets - 1)).cast("int")

    def targets(self, sources: DataFrame) -> DataFrame:
        """(source, source_size) -> with weight and target. The level at which capped shares add up is found in closed form over sources sorted by cap per weight."""
        n = len(self.weights)
        rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
        weight = F.element_at(F.array(*map(F.lit, self.weights)), (F.pmod(rank - 1, F.lit(n)) + 1).cast("int"))
        s = sources.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * self.max_epochs)
        by_fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
        rows, everything = by_fill.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        s = s.withColumn("before", F.coalesce(F.sum("cap").over(rows), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("weight").over(rows), F.lit(0.0)))
        s = s.withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / (F.sum("weight").over(everything) - F.col("w_before")))
        s = s.withColumn("level", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("before", "level"))).over(everything)["level"])
        return s.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))

    def plan(self, keyed: DataFrame) -> DataFrame:
        """One row per source: source, source_size, weight, target, epochs, and where the partial epoch ends: in bucket `edge`,
        with the rows of cut_key and cut_size, `copies` rows, of which cut_copies are taken."""
        rows = keyed.select("source", "size", "key", self._bucket().alias("bucket"))
        sums = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
        s = self.targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")))
        s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        s = cut(s.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
        upto = F.sum("size").over(W.partitionBy("source").orderBy("bucket"))
        edge = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("size")).alias("b").join(s.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        edge = edge.where("before <= budget and budget < upto").select(F.col("b.source").alias("e_source"), F.col("bucket").alias("edge"), "before", "budget")
        inside = rows.where("size > 0").join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("edge")))
        # copies are counted first, so that no number of them makes a long window
        inside = inside.groupBy("e_source", "edge", "before", "budget", "key", "size").agg(F.count("*").alias("copies"))
        done = F.col("before") + F.sum(F.col("size") * F.col("copies")).over(W.partitionBy("e_source").orderBy("key", "size")) - F.col("size") * F.col("copies")
        # copy j is taken if its middle, done + (j - 1/2) size, is within the budget
        paid = F.least(F.floor((F.col("budget") - done) / F.col("size") + 0.5), F.col("copies"))
        last = F.max(F.when(F.col("paid") > 0, F.struct("key", "size", "paid", "copies"))).alias("last")
        ends = inside.withColumn("paid", paid).groupBy("e_source", "edge").agg(last)
        ends = ends.select("e_source", "edge", F.col("last.key").alias("cut_key"), F.col("last.size").alias("cut_size"), F.col("last.paid").alias("cut_copies"), F.col("last.copies").alias("copies"))
        return cut(s.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").select("source", "source_size", "weight", "target", "epochs", "edge", "cut_key", "cut_size", "cut_copies", "copies"))

    def apply(self, rows: DataFrame, plan: DataFrame) -> DataFrame:
        """rows (row, source, size, key), row being a struct of anything -> (row, size, source_size, target, repeats, taken)."""
        whole = packed(plan, "plan")
        if plan.count() <= BROADCAST_SOURCES:
            whole = F.broadcast(whole)
        joined = rows.select("row", "source", "size", "key", self._bucket().alias("bucket")).join(whole, F.col("source").eqNullSafe(F.col("plan.source")))
        place, end = F.struct("bucket", "key", "size"), F.struct(F.col("plan.edge").alias("bucket"), F.col("plan.cut_key").alias("key"), F.col("plan.cut_size").alias("size"))
        at_cut = F.coalesce((F.col("plan.cut_copies") < F.col("plan.copies")) & (place == end), F.lit(False))
        # without a cut in it, the edge's bucket has nothing that the budget pays for
        before = (F.col("bucket") < F.col("plan.edge")) | F.coalesce(place <= end, F.lit(False))
        out = joined.where(~at_cut).withColumn("once", F.coalesce(before, F.lit(False)))
        if not plan.where("cut_copies < copies").isEmpty():
            out = out.unionByName(numbered(joined.where(at_cut)).withColumn("once", F.col("n") <= F.col("plan.cut_copies")).drop("n"))
        out = out.withColumn("repeats", F.col("plan.epochs") + F.col("once").cast("int"))
        return out.select("row", "size", F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"), "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def numbered(copies: DataFrame) -> DataFrame:
    """copies with n, which counts the rows of each plan.source from 1: within partitions, after the partitions before. Written first: places must not change."""
    rows = cut(copies.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftrightunsigned("at", 33))
    parts = rows.groupBy(F.col("plan.source").alias("p_source"), F.col("part").alias("p_part")).agg(F.count("*").alias("rows"))
    parts = parts.withColumn("earlier", F.sum("rows").over(W.partitionBy("p_source").orderBy("p_part")) - F.col("rows"))
    own = F.row_number().over(W.partitionBy("plan.source", "part").orderBy("at"))
    return rows.withColumn("own", own).join(parts, F.col("plan.source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part"))).withColumn("n", F.col("own") + F.col("earlier")).drop("at", "part", "p_source", "p_part", "rows", "earlier", "own")


def mix(docs: DataFrame, mixer: Mixer = Mixer()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    keyed = cut(mixer.keyed(docs))
    out = mixer.apply(keyed.select(F.struct("doc_id").alias("row"), "source", "size", "key"), mixer.plan(keyed))
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, mixer: Mixer = Mixer()) -> DataFrame:
    """The mixed corpus: docs' own columns, each row as often as the mix takes it; rows without words are left out."""
    plan = mixer.plan(cut(mixer.keyed(docs)))
    rows = packed(docs, "row").select("row", "row.doc_id", "row.source", "row.text", size_of(F.col("row.text")).alias("size"))
    taken = mixer.apply(rows.select("row", "source", "size", mixer.key().alias("key")), plan).where("taken > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("n")).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#$%&*|!]+'))::DOUBLE AS junk,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / (CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + 4.0::DOUBLE * junk / size) ELSE 1.0::DOUBLE END) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight, source_size * 3 AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER p, 0)::DOUBLE AS cap_before, coalesce(sum(weight) OVER p, 0)::DOUBLE AS w_before
      FROM w WINDOW p AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - cap_before) / ((SELECT sum(weight) FROM w) - w_before) AS lv FROM f),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(lv, cap_before) FROM l WHERE cap::DOUBLE / weight >= lv)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, target - epochs * e.source_size AS budget,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN budget > 0 AND size > 0 AND upto - size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""
