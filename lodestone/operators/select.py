"""Evidence selection: named targets first, then relevance, under page, paper and total limits.

A question's items are gathered once into an array by rank (a question has some dozen: the fused candidates and the evidence it
holds). The greedy choice folds over it in phases: one per target in plan order (at most two items each), then one for all. In
a phase, an item is taken if it matches, its page and its paper's share aren't used up, and the phase's limit isn't reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import target_matches

MAX_EVIDENCE, PER_TARGET, PER_PAPER, MAX_TARGETS = 8, 2, 4, 3


def select_evidence(items: DataFrame, targets: Column | None = None) -> DataFrame:
    """items (qid, chunk_id, paper, page, text, score, slot, ...) -> the selected ones, with evidence_no from 1.

    targets: column over items, array of the question's target names. With targets of which no item's text names any, nothing is
    selected. Order is score descending, then slot.
    """
    none = F.array().cast("array<string>")
    names = [c for c in items.columns if c != "qid"]
    given = items.withColumn("_targets", none if targets is None else F.coalesce(targets, none))
    named = [F.coalesce(target_matches(F.get("_targets", F.lit(t)), F.col("text")), F.lit(False)) for t in range(MAX_TARGETS)]
    any_named = F.coalesce(F.exists("_targets", lambda t: target_matches(t, F.col("text"))), F.lit(False))
    order = F.struct((-F.col("score")).alias("score"), "slot")
    place = F.concat("paper", F.lit("\0"), F.col("page").cast("string"))
    row = F.struct(order.alias("order"), place.alias("place"), "paper", *[c.alias(f"named{t}") for t, c in enumerate(named)], F.struct(*[F.col(f"`{c}`") for c in names]).alias("item"))
    questions = given.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max((F.size("_targets") == 0) | any_named).alias("open")).where("open")

    def taking(phase: int, limit: Column):
        """A step of the fold: the state is the rows taken so far (their numbers, pages and papers) and how many this phase took."""

        def step(state: Column, row: Column) -> Column:
            fits = row[f"named{phase}"] if phase < MAX_TARGETS else F.lit(True)
            free = ~F.array_contains(state["places"], row["place"]) & (F.size(F.filter(state["papers"], lambda p: p == row["paper"])) < PER_PAPER)
            more = F.struct((state["n"] + 1).alias("n"), F.concat(state["places"], F.array(row["place"])).alias("places"), F.concat(state["papers"], F.array(row["paper"])).alias("papers"), F.concat(state["items"], F.array(row["item"])).alias("items"))
            return F.when(fits & free & (state["n"] < limit), more).otherwise(state)

        return step

    item = F.struct(*[F.col(f"`{c}`") for c in names])
    state = F.struct(F.lit(0).alias("n"), none.alias("places"), none.alias("papers"), F.array().cast(f"array<{items.select(item.alias('i')).schema['i'].dataType.simpleString()}>").alias("items"))
    chosen = questions.withColumn("state", state)
    for phase in range(MAX_TARGETS + 1):
        last = phase == MAX_TARGETS
        begun = F.col("state").withField("n", F.size("state.items") if last else F.lit(0))
        chosen = chosen.withColumn("state", F.aggregate("rows", begun, taking(phase, F.lit(MAX_EVIDENCE if last else PER_TARGET))))
    return chosen.select("qid", F.posexplode("state.items").alias("i", "item")).select(*["qid" if c == "qid" else F.col(f"item.`{c}`") for c in items.columns], (F.col("i") + 1).alias("evidence_no"))
