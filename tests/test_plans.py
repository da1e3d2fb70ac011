import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import citations as cite
from lodestone.operators.graph import EntityGraph
from lodestone.operators.sparse import SparseIndex
from lodestone.plans import coverage, planning, workflow
from lodestone.plans.answering import allowed_ids, draft_error
from lodestone.session import Settings
from lodestone.sources.providers import ModelUnavailableError, Recorded
from lodestone.sources.store import Indexes

GOOD = {"queries": [" q1 ", "q1", 7, "q2", "q3", "q4"], "entities": ["e"], "targets": ["Self-RAG", "CRAG methods", "Corrective Thing (CRAG)"], "facets": ["aim"], "retrievers": ["graph", "sparse", "web"], "output_language": " English "}


def plan(spark, payload, question="Compare Self-RAG and CRAG methods"):
    df = spark.createDataFrame([("q", question, payload if isinstance(payload, str) else json.dumps(payload))], "qid string, question string, payload string")
    return planning.plan_questions(df).first()


def test_plan_is_bounded_and_cleaned(spark):
    r = plan(spark, GOOD)
    assert r.plan_error is None
    assert r.plan.queries == ["q1", "q2", "q3"] and r.plan.entities == ["e"] and r.plan.output_language == "English"
    assert r.plan.targets == ["Self-RAG", "CRAG"] and r.plan.retrievers == ["sparse", "graph"]


@pytest.mark.parametrize(("raw", "expected"), [(["graph"], ["dense", "graph"]), ([], ["sparse", "dense"]), ("sparse", ["sparse", "dense"]), (None, ["sparse", "dense"]), (["dense", "sparse", 3], ["sparse", "dense"]), (["dense"], ["dense"]), (["graph", "dense", "sparse"], ["sparse", "dense", "graph"])])
def test_retrievers(spark, raw, expected):
    assert plan(spark, GOOD | {"retrievers": raw}).plan.retrievers == expected


@pytest.mark.parametrize(("change", "error"), [({"queries": []}, "no queries"), ({"facets": ["", 3]}, "no facets"), ({"output_language": "x" * 31}, "no valid output language"), ({"output_language": 3}, "no valid output language"), ({"targets": None}, "a list is missing"), ({"entities": "e"}, "a list is missing")])
def test_plan_errors(spark, change, error):
    assert plan(spark, GOOD | change).plan_error == error


def test_no_json_object_is_an_error(spark):
    assert plan(spark, "[1]").plan_error == plan(spark, "nope").plan_error == "payload is no JSON object"


EVIDENCE = [("c1", "a.pdf", 1, "CRAG is graded", 1.0), ("c2", "b.pdf", 2, "Self-RAG and CRAG", 0.5), ("c3", "b.pdf", 3, "Corrective CRAG", 0.1)]
STATE = "qid string, question string, plan struct<targets:array<string>,facets:array<string>>, evidence array<struct<chunk_id:string,paper:string,page:int,text:string,score:double>>, payload string"


def verified(spark, covered, targets=("CRAG", "Self-RAG"), facets=("aim", "limits"), query=" more "):
    row = ("q", "?", (list(targets), list(facets)), EVIDENCE, json.dumps({"covered": covered, "corrective_query": query}))
    return coverage.verify(spark.createDataFrame([row], STATE)).first()


def test_coverage_is_sanitised_and_gaps_are_in_plan_order(spark):
    r = verified(spark, {"crag": {"AIM": ["E1", "E1", "E01", "E9", "x", 1, "E2"], "other": ["E1"]}, "Nobody": {"aim": ["E1"]}, "Self-RAG": {"aim": ["E1"], "limits": "E2"}})
    assert r.verification.covered == {"CRAG": {"aim": ["E1", "E2"]}, "Self-RAG": {}}
    assert r.verification.missing == ["CRAG: limits", "Self-RAG: aim", "Self-RAG: limits"]
    assert (r.verification.status, r.verification.corrective_query, r.verify_error) == ("partial", "more", None)


def test_a_longer_named_target_takes_the_evidence(spark):
    r = verified(spark, {"CRAG": {"aim": ["E1", "E3"]}}, ("CRAG", "Corrective CRAG"), ("aim",))
    assert r.verification.covered["CRAG"] == {"aim": ["E1"]}


def test_open_target_status_and_errors(spark):
    assert verified(spark, {"question": {"aim": ["E3"]}}, (), ("aim",)).verification.status == "complete"
    assert verified(spark, {}, (), ("aim",)).verification.status == "insufficient"
    assert verified(spark, [], (), ("aim",)).verify_error == "covered is no object"
    assert verified(spark, {}, (), ("aim",), 5).verify_error == "corrective_query is no string"


def test_routes(spark):
    df = spark.createDataFrame([("partial", "q", 0, "researcher"), ("insufficient", "q", 0, "researcher"), ("partial", "q", 1, "writer"), ("partial", "", 0, "writer"), ("complete", "q", 0, "writer")], "s string, c string, n int, want string")
    assert all(r.got == r.want for r in df.select("*", coverage.route_after_verification(F.col("s"), F.col("c"), F.col("n"), 1).alias("got")).collect())


def rendered(spark, draft):
    df = spark.createDataFrame([(draft, EVIDENCE)], "d string, e array<struct<chunk_id:string,paper:string,page:int,text:string,score:double>>")
    return df.select(cite.validate_citations(F.col("d"), F.col("e")).alias("a"), cite.valid_evidence_ids(F.col("d"), F.size("e").cast("bigint")).alias("ids"), cite.citation_summary(F.col("d"), F.col("e")).alias("s")).first()


def test_citations_are_rendered_and_unknown_ones_go(spark):
    r = rendered(spark, "One [E1, E2]. Two [E9] , three [a.pdf p.1] [a.pdf p.7] [E3][E1][E99999999999999999999] .")
    assert r.a == "One [a.pdf p.1][b.pdf p.2]. Two, three [a.pdf p.1] [b.pdf p.3][a.pdf p.1]."
    assert r.ids == [1, 2, 3]


def test_citation_summary(spark):
    assert tuple(rendered(spark, "x [a.pdf p.1] [b.pdf p.2] [b.pdf p.2]").s) == (3, 2, True)
    assert tuple(rendered(spark, "x [a.pdf p.5]").s) == (1, 1, False)
    assert tuple(rendered(spark, "x").s) == (0, 0, False)


def test_allowed_ids_and_draft_checks(spark):
    df = spark.createDataFrame([({"t": {"f": ["E10", "E2"], "g": ["E2", "bad"]}},)], "c map<string,map<string,array<string>>>")
    assert df.select(allowed_ids(F.col("c"))).first()[0] == [2, 10]
    rows = [("insufficient", [1], "evidence cited while abstaining"), ("insufficient", [], None), ("partial", [], "no valid evidence cited"), ("complete", [3], "evidence cited that was not approved"), ("complete", [1], None)]
    d = spark.createDataFrame(rows, "s string, u array<bigint>, want string").select("want", draft_error(F.col("s"), F.col("u"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("got"))
    assert all(r.got == r.want for r in d.collect())


# ---------------------------------------------------------------- the whole workflow, with recorded answers


def engine(spark):
    rows = [("c1", "a.pdf", 1, 0, "Self-RAG uses reflection tokens."), ("c2", "b.pdf", 1, 0, "CRAG uses an evaluator."), ("c3", "c.pdf", 1, 0, "Pasta needs salt.")]
    chunks = spark.createDataFrame(rows, "chunk_id string, paper string, page int, position int, text string")
    none = spark.createDataFrame([], "id string, embedding array<float>")
    return workflow.RetrievalEngine(chunks, Indexes(SparseIndex.build(chunks), none, EntityGraph.build(chunks)))


def words(query, text):
    return F.size(F.array_intersect(F.split(F.lower(query), r"\W+"), F.split(F.lower(text), r"\W+"))).cast("double") - 1


def ask(spark, answers, question="Which tokens does Self-RAG use?", scorer=words):
    q = spark.createDataFrame([("q", question)], "qid string, question string")
    recorded = spark.createDataFrame([("q", *a) for a in answers], "qid string, node string, round int, payload string")
    return workflow.ask(q, engine(spark), Settings(min_rerank_score=0.5), Recorded(recorded), scorer).first()


def planned(*queries, targets=()):
    return ("planner", 0, json.dumps({"queries": list(queries), "entities": [], "targets": list(targets), "facets": ["aim"], "retrievers": ["sparse"], "output_language": "English"}))


def verdict(turn, covered, query=""):
    return ("verifier", turn, json.dumps({"covered": covered, "corrective_query": query}))


def test_full_flow_in_one_round(spark):
    s = ask(spark, [planned("self-rag uses reflection tokens", targets=["Self-RAG"]), verdict(0, {"Self-RAG": {"aim": ["E1"]}}), ("writer", 0, "Tokens [E1].")])
    assert s.answer == "Tokens [a.pdf p.1]." and s.verification.status == "complete" and s.retry_count == 0
    assert [e.chunk_id for e in s.evidence] == ["c1"] or s.evidence[0].chunk_id == "c1"


def test_nothing_relevant_goes_straight_to_the_writer(spark):
    s = ask(spark, [planned("zebra"), ("writer", 0, "The corpus doesn't say.")])
    assert s.stop_reason == "no_relevant_evidence" and s.evidence == [] and s.answer == "The corpus doesn't say."


def test_retry_happens_once_and_without_news_keeps_the_old_evidence(spark):
    s = ask(spark, [planned("self-rag uses reflection tokens"), verdict(0, {}, "reflection tokens"), ("writer", 0, "It doesn't say.")])
    assert s.stop_reason == "no_new_evidence" and s.retry_count == 1 and [e.chunk_id for e in s.evidence][:1] == ["c1"]


def test_retry_with_news_is_verified_again(spark):
    s = ask(spark, [planned("reflection tokens uses"), verdict(0, {"question": {}}, "pasta needs salt"), verdict(1, {"question": {"aim": ["E1"]}}, "on and on"), ("writer", 0, "So [E1].")])
    assert s.retry_count == 1 and s.stop_reason == "" and "c3" in [e.chunk_id for e in s.evidence] and s.answer.startswith("So [")


def test_contract_breaches_raise(spark):
    with pytest.raises(workflow.PlanError, match="no queries"):
        ask(spark, [planned()])
    with pytest.raises(workflow.PlanError, match="no valid evidence"):
        ask(spark, [planned("self-rag uses reflection tokens"), verdict(0, {"question": {"aim": ["E1"]}}), ("writer", 0, "No citation.")])


def test_models_are_required(spark):
    q = spark.createDataFrame([("q", "?")], "qid string, question string")
    with pytest.raises(ValueError, match="completer"):
        workflow.ask(q, engine(spark), Settings(), None, words)
    with pytest.raises(ModelUnavailableError):
        workflow.ask(q, engine(spark), Settings(), Recorded(q), None)
    with pytest.raises(ModelUnavailableError):
        engine(spark).dense_search_many(q)


def test_initial_state_has_all_fields(spark):
    s = workflow.initial_states(spark.createDataFrame([("q", "?")], "qid string, question string")).first()
    assert s.asDict(recursive=True) == {"qid": "q", "question": "?", "plan": {"queries": [], "entities": [], "targets": [], "facets": [], "retrievers": ["sparse", "dense"], "output_language": "English"}, "evidence": [], "verification": {"status": "insufficient", "covered": {}, "missing": [], "corrective_query": ""}, "retry_count": 0, "stop_reason": "", "answer": ""}


# ---------------------------------------------------------------- objects with repeated keys


def test_of_repeated_keys_the_last_value_counts(spark):
    text = '{"queries": ["first"], "facets": ["x"], "entities": [], "targets": [], "output_language": "French", "queries": ["last"], "output_language": "English"}'
    r = plan(spark, text)
    assert r.plan_error is None and r.plan.queries == ["last"] and r.plan.output_language == "English"
    assert plan(spark, text.replace('"queries": ["last"]', '"queries": []')).plan_error == "no queries"
    assert plan(spark, text.replace('["last"]', '[NaN, "q", Infinity]')).plan.queries == ["q"]


def reference_coverage(payload, targets, facets, evidence):
    """The rule by hand, on Python's own objects: keys in their order, later cells over earlier ones."""
    out = {}
    for raw_target, raw_facets in json.loads(payload)["covered"].items():
        target = {t.casefold(): t for t in targets}.get(raw_target.casefold())
        for raw_facet, ids in raw_facets.items() if target and isinstance(raw_facets, dict) else ():
            facet = {f.casefold(): f for f in facets}.get(raw_facet.casefold())
            good = [i for i in dict.fromkeys(ids) if isinstance(i, str) and i[1:].isdigit() and 1 <= int(i[1:]) <= evidence] if facet and isinstance(ids, list) else []
            if good:
                out[target, facet] = good
    return out


def test_of_keys_equal_but_for_case_the_last_with_an_id_counts(spark):
    draw = random.Random(11)
    for _ in range(6):
        cell = lambda: json.dumps(draw.choice([["E1"], ["E2", "E1"], [], ["E9"], ["x", 3], "E1"]))
        inner = lambda: "{" + ", ".join(f'"{draw.choice(["aim", "AIM", "Aim", "limits", "other"])}": {cell()}' for _ in range(draw.randint(1, 5))) + "}"
        covered = "{" + ", ".join(f'"{draw.choice(["Straße", "STRASSE", "strasse", "ﬁt", "FIT", "none"])}": {draw.choice([inner(), inner(), inner(), "[]"])}' for _ in range(draw.randint(1, 5))) + "}"
        payload = f'{{"covered": {{}}, "corrective_query": "", "covered": {covered}}}'
        evidence = [("c1", "a.pdf", 1, "strasse fit", 1.0), ("c2", "b.pdf", 1, "strasse and fit", 1.0)]
        state = spark.createDataFrame([("q", ["Straße", "ﬁt"], ["aim", "limits"], evidence, payload)], "qid string, targets array<string>, facets array<string>, evidence array<struct<chunk_id:string,paper:string,page:int,text:string,score:double>>, payload string")
        got = {(r.target, r.facet): r.ids for r in coverage.sanitize_coverage(state).collect()}
        assert got == reference_coverage(payload, ["Straße", "ﬁt"], ["aim", "limits"], 2), payload
