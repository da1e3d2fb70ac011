"""Answers: which evidence may be cited, checks of a draft, and its rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.citations import citation_summary, valid_evidence_ids, validate_citations, without_page_citations


def allowed_ids(covered: Column) -> Column:
    """Evidence numbers of all covered cells, ascending, each once. covered: target -> facet -> ids."""
    ids = F.flatten(F.flatten(F.transform(F.map_values(covered), lambda facets: F.map_values(facets))))
    good = F.filter(ids, lambda i: i.rlike(r"^E\d+\z"))
    return F.array_sort(F.array_distinct(F.transform(good, lambda i: F.substring(i, F.lit(2), F.length(i)).try_cast("bigint"))))


def draft_error(status: Column, used: Column, allowed: Column) -> Column:
    """What is wrong with a draft that cites the evidence `used`; null if nothing."""
    return (
        F.when((status == "insufficient") & (F.size(used) > 0), "evidence cited while abstaining")
        .when((status != "insufficient") & (F.size(used) == 0), "no valid evidence cited")
        .when((status != "insufficient") & (F.size(F.array_except(used, allowed)) > 0), "evidence cited that was not approved")
    )


def write(states: DataFrame, draft: str = "payload") -> DataFrame:
    """states with answer, write_error and summary. Page citations in the draft itself are deleted before rendering."""
    evidence = F.col("evidence")
    used = valid_evidence_ids(F.col(draft), F.size(evidence).cast("bigint"))
    rows = states.withColumn("_used", used).withColumn("_allowed", allowed_ids(F.col("verification.covered")))
    rows = rows.withColumn("write_error", draft_error(F.col("verification.status"), F.col("_used"), F.col("_allowed")))
    rows = rows.withColumn("answer", validate_citations(without_page_citations(F.col(draft)), evidence))
    return rows.withColumn("summary", citation_summary(F.col("answer"), evidence)).drop("_used", "_allowed")
