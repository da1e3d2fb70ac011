"""Citations in answers, as column expressions: evidence ids [E1, E2] and page citations [x.pdf p.3]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two citation formats.
EVIDENCE = r"\[(E\d+(?:\s*,\s*E\d+)*)\]"
PAGE = r"\[([^\[\]]+\.pdf) p\.(\d+)\]"


def replaced(text: Column, pattern: str, by) -> Column:
    """text with each match of the pattern replaced by by(match): the pieces between and the matches come in step."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = F.transform(found, by)
    pieces = F.split(text, pattern, -1)
    return F.array_join(F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(F.get(made, i), F.lit("")))), "")


def evidence_numbers(citation: Column) -> Column:
    return F.transform(F.regexp_extract_all(citation, F.lit(r"E(\d+)"), F.lit(1)), lambda n: n.try_cast("bigint"))


def page_label(paper: Column, page: Column) -> Column:
    return F.concat(F.lit("["), paper, F.lit(" p."), page.cast("string"), F.lit("]"))


def valid_evidence_ids(answer: Column, count: Column) -> Column:
    """Numbers of cited evidence within 1 and count, each once, in order of first citation."""
    cited = F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(EVIDENCE), F.lit(1)), evidence_numbers))
    return F.array_distinct(F.filter(cited, lambda n: (n >= 1) & (n <= count)))


def cited_pages(answer: Column) -> Column:
    """array of (paper, page)."""
    papers, pages = (F.regexp_extract_all(answer, F.lit(PAGE), F.lit(i)) for i in (1, 2))
    return F.transform(papers, lambda p, i: F.struct(p.alias("paper"), F.get(pages, i).try_cast("int").alias("page")))


def real_pages(evidence: Column) -> Column:
    known = F.filter(evidence, lambda e: (F.coalesce(e["paper"], F.lit("")) != "") & e["page"].isNotNull())
    return F.transform(known, lambda e: F.struct(e["paper"].alias("paper"), e["page"].cast("int").alias("page")))


def without_page_citations(text: Column) -> Column:
    return F.regexp_replace(text, PAGE, "")


def validate_citations(answer: Column, evidence: Column) -> Column:
    """Known evidence ids become page citations, unknown ones and page citations of no evidence go, spaces are tidied."""

    def render(citation: Column) -> Column:
        items = F.transform(evidence_numbers(citation), lambda n: F.when((n >= 1) & (n <= F.size(evidence)), F.try_element_at(evidence, n.cast("int"))))
        return F.array_join(F.transform(items, lambda e: F.when((F.coalesce(e["paper"], F.lit("")) != "") & e["page"].isNotNull(), page_label(e["paper"], e["page"])).otherwise(F.lit(""))), "")

    rendered = replaced(answer, EVIDENCE, render)
    pages = real_pages(evidence)
    real = replaced(rendered, PAGE, lambda c: F.when(F.arrays_overlap(cited_pages(c), pages), c).otherwise(F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(real, r"[ \t]{2,}", " "), " +([,.;:])", "$1")
    return F.regexp_replace(tidy, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def citation_summary(answer: Column, evidence: Column) -> Column:
    """struct of citations, sources and all_grounded: at least one citation, and every one of a page of the evidence."""
    pages, real = cited_pages(answer), real_pages(evidence)
    grounded = (F.size(pages) > 0) & F.forall(pages, lambda p: F.array_contains(real, p))
    return F.struct(F.size(pages).alias("citations"), F.size(F.array_distinct(F.transform(pages, lambda p: p["paper"]))).alias("sources"), grounded.alias("all_grounded"))
