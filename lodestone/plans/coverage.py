"""Evidence coverage: which target and facet each evidence supports, what is missing, and where to go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.objects import covered_cells, unique_keys
from lodestone.functions.text import casefold, target_matches, tokens

#: The target that stands for the whole question where none is named. Fixed value.
OPEN_TARGET = "question"


def coverage_targets(targets: Column) -> Column:
    return F.when(F.size(targets) == 0, F.array(F.lit(OPEN_TARGET))).otherwise(targets)


def matches_coverage_target(target: Column, named: Column, text: Column) -> Column:
    """The text names the target, and no longer named target (in tokens) as well; the open target is matched by any text."""
    longer = F.exists(named, lambda o: (o != target) & (F.size(tokens(o)) > F.size(tokens(target))) & target_matches(o, text))
    return (target == OPEN_TARGET) | (target_matches(target, text) & ~longer)


def canonical(names: Column, raw: Column) -> Column:
    """Of the names the last that equals raw but for case, or null."""
    return F.try_element_at(F.filter(names, lambda n: casefold(n) == casefold(raw)), F.lit(-1))


def sanitize_coverage(states: DataFrame, payload: str = "payload") -> DataFrame:
    """states (qid, targets, facets, evidence array, payload) -> cells (qid, target, facet, ids): valid evidence ids, each once.

    Unknown targets and facets, ids that are malformed or out of range, and evidence that isn't of the target are dropped. Of raw
    keys that name the same cell the last in the payload with a valid id counts.
    """
    read = states.select("qid", "targets", "facets", "evidence", covered_cells(F.col(payload)).alias("read"))
    flat = read.select("qid", "targets", "facets", "evidence", F.explode("read").alias("c")).select("qid", "targets", "facets", "evidence", "c.*")
    cells = flat.select("qid", "targets", "evidence", "place", canonical(coverage_targets(F.col("targets")), F.col("raw_target")).alias("target"), canonical(F.col("facets"), F.col("raw_facet")).alias("facet"), F.col("ids").alias("raw"))
    numbers = F.transform(F.filter("raw", lambda i: i.rlike(r"^E\d+\z")), lambda i: F.substring(i, F.lit(2), F.length(i)).try_cast("int"))
    item = lambda n: F.try_element_at("evidence", n)
    fits = lambda n: (n >= 1) & (n <= F.size("evidence")) & F.coalesce(matches_coverage_target(F.col("target"), F.col("targets"), item(n)["text"]), F.lit(False))
    ids = F.array_distinct(F.transform(F.filter(numbers, lambda n: F.coalesce(fits(n), F.lit(False))), lambda n: F.concat(F.lit("E"), n.cast("string"))))
    good = cells.where("target is not null and facet is not null").select("qid", "place", "target", "facet", ids.alias("ids")).where(F.size("ids") > 0)
    return good.groupBy("qid", "target", "facet").agg(F.max_by("ids", "place").alias("ids"))


def covers(cells: Column, target: Column, facet: Column) -> Column:
    return F.exists(cells, lambda c: (c["target"] == target) & (c["facet"] == facet))


def missing(targets: Column, facets: Column, cells: Column) -> Column:
    """'target: facet' of each required cell without evidence, in plan order."""
    return F.flatten(F.transform(coverage_targets(targets), lambda t: F.transform(F.filter(facets, lambda f: ~covers(cells, t, f)), lambda f: F.concat(t, F.lit(": "), f))))


def status(required: Column, missing_count: Column) -> Column:
    return F.when((required == 0) | (missing_count >= required), "insufficient").when(missing_count == 0, "complete").otherwise("partial")


def covered_map(targets: Column, cells: Column) -> Column:
    own = lambda t: F.map_from_entries(F.transform(F.filter(cells, lambda c: c["target"] == t), lambda c: F.struct(c["facet"], c["ids"])))
    named = coverage_targets(targets)
    return F.map_from_arrays(named, F.transform(named, own))


def verify(states: DataFrame, payload: str = "payload") -> DataFrame:
    """states with a verification struct and verify_error. states: qid, plan, evidence, payload and more."""
    states = states.withColumn("_read", unique_keys(F.col(payload)))
    p = F.try_parse_json("_read")
    flat = states.select("qid", "plan.targets", "plan.facets", "evidence", payload)
    cells = sanitize_coverage(flat, payload).groupBy("qid").agg(F.collect_list(F.struct("target", "facet", "ids")).alias("_cells"))
    rows = states.join(cells, "qid", "left").withColumn("_cells", F.coalesce("_cells", F.array().cast("array<struct<target:string,facet:string,ids:array<string>>>")))
    targets, facets = F.col("plan.targets"), F.col("plan.facets")
    gaps = missing(targets, facets, F.col("_cells"))
    query = F.try_variant_get(p, "$.corrective_query", "variant")
    text = F.when(query.isNull(), "").when(F.schema_of_variant(query) == "STRING", F.trim(F.try_variant_get(p, "$.corrective_query", "string")))
    is_object = F.coalesce(F.schema_of_variant(F.try_variant_get(p, "$.covered", "variant")).startswith("OBJECT"), F.lit(False))
    error = F.when(~is_object, "covered is no object").when(text.isNull(), "corrective_query is no string")
    verification = F.struct(
        status(F.size(coverage_targets(targets)) * F.size(facets), F.size(gaps)).alias("status"),
        covered_map(targets, F.col("_cells")).alias("covered"),
        gaps.alias("missing"),
        text.alias("corrective_query"),
    )
    return rows.withColumn("verification", verification).withColumn("verify_error", error).drop("_cells", "_read")


def route_after_research(stop_reason: Column) -> Column:
    return F.when(stop_reason.isin("no_relevant_evidence", "no_new_evidence"), "writer").otherwise("verifier")


def route_after_verification(verified: Column, corrective_query: Column, retries: Column, max_retries: int) -> Column:
    done = (verified == "complete") | (corrective_query == "") | (retries >= max_retries)
    return F.when(done, "writer").otherwise("researcher")
