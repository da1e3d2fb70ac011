"""Question plans: sanitising the planner's JSON payload with column expressions.

Payloads are parsed to VARIANT, so one entry of a wrong type is dropped alone; of a repeated key the last value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.objects import unique_keys
from lodestone.functions.text import ALNUM, casefold, target_matches, unique_strings

# Fixed values.
RETRIEVERS = ("sparse", "dense", "graph")
DEFAULT_RETRIEVERS = ("sparse", "dense")
GENERIC_SUFFIXES = ("method", "methods", "approach", "approaches", "frameworks")
ALIAS = r"\(([A-Z][A-Z0-9-]{1,9})\)"
LIMITS = {"queries": 3, "entities": 5, "targets": 3, "facets": 5}
MAX_LANGUAGE = 30


def is_list(payload: Column, field: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(payload, f"$.{field}", "variant")).startswith("ARRAY"), F.lit(False))


def string_items(values: Column) -> Column:
    """The strings of an array of variants."""
    kept = F.filter(values, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(kept, lambda v: F.variant_get(v, "$", "string"))


def strings(payload: Column, field: str) -> Column:
    """The strings of a list in the payload; an empty array if it is no list."""
    return F.when(is_list(payload, field), string_items(F.try_variant_get(payload, f"$.{field}", "array<variant>"))).otherwise(F.array().cast("array<string>"))


def sanitize_retrievers(values: Column) -> Column:
    """The known ones in canonical order; the default if none; graph alone gets dense beside it."""
    known = F.filter(F.array(*map(F.lit, RETRIEVERS)), lambda r: F.coalesce(F.array_contains(values, r), F.lit(False)))
    return F.when(F.size(known) == 0, F.array(*map(F.lit, DEFAULT_RETRIEVERS))).when(known == F.array(F.lit("graph")), F.array(F.lit("dense"), F.lit("graph"))).otherwise(known)


def explicit_targets(values: Column, question: Column) -> Column:
    """Of the first three names those the question spells out, or else their first alias in parentheses that it does."""

    def spelled(name: Column) -> Column:
        alias = F.get(F.filter(F.regexp_extract_all(name, F.lit(ALIAS), F.lit(1)), lambda a: target_matches(a, question)), F.lit(0))
        return F.when(target_matches(name, question), name).otherwise(alias)

    def specific(name: Column) -> Column:
        last = F.try_element_at(F.regexp_extract_all(casefold(name), F.lit(ALNUM), F.lit(0)), F.lit(-1))
        return name.isNotNull() & ~F.coalesce(last.isin(*GENERIC_SUFFIXES), F.lit(False))

    return F.array_distinct(F.filter(F.transform(unique_strings(values, LIMITS["targets"]), spelled), specific))


def plan_questions(questions: DataFrame, payload: str = "payload") -> DataFrame:
    """questions (qid, question, payload JSON) -> the columns given, plan (struct) and plan_error (null if the plan is good)."""
    names = questions.columns
    questions = questions.withColumn("_read", unique_keys(F.col(payload)))
    p = F.try_parse_json("_read")
    question = F.trim(F.col("question"))
    own = {k: unique_strings(strings(p, k), LIMITS[k]) for k in ("queries", "entities", "facets")}
    language = F.when(F.schema_of_variant(F.try_variant_get(p, "$.output_language", "variant")) == "STRING", F.trim(F.try_variant_get(p, "$.output_language", "string")))
    lists = {k: ~is_list(p, k) for k in LIMITS}
    error = (
        F.when(~F.coalesce(F.schema_of_variant(p).startswith("OBJECT"), F.lit(False)), "payload is no JSON object")
        .when(lists["queries"] | lists["entities"] | lists["facets"] | lists["targets"], "a list is missing")
        .when(F.size(own["queries"]) == 0, "no queries")
        .when(F.size(own["facets"]) == 0, "no facets")
        .when(~F.coalesce(F.length(language).between(1, MAX_LANGUAGE), F.lit(False)), "no valid output language")
    )
    plan = F.struct(
        own["queries"].alias("queries"),
        own["entities"].alias("entities"),
        explicit_targets(strings(p, "targets"), question).alias("targets"),
        own["facets"].alias("facets"),
        sanitize_retrievers(strings(p, "retrievers")).alias("retrievers"),
        language.alias("output_language"),
    )
    return questions.select(*names, plan.alias("plan"), error.alias("plan_error"))
