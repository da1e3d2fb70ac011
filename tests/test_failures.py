"""What fails on executors: a service, models, a lost task. And what a batch does about it."""

import json
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from test_plans import engine, planned, words

from lodestone import cli
from lodestone.plans import workflow
from lodestone.session import Settings
from lodestone.sources import providers
from lodestone.sources.providers import HttpCompleter, ModelUnavailableError, ServiceError
from lodestone.sources.responses import Kept

PLAN = json.loads(planned("self-rag uses reflection tokens")[2])


class Service(BaseHTTPRequestHandler):
    """Answers by what the prompt holds; counts calls, and how many there are at a time."""

    asked: Counter = Counter()
    now = most = 0
    lock = threading.Lock()
    failures: dict = {}

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        with Service.lock:
            Service.asked[prompt] += 1
            Service.now += 1
            Service.most = max(Service.most, Service.now)
            code = next((codes.pop(0) for own, codes in Service.failures.items() if own in prompt and codes), 200)
        if "slow" in prompt:
            threading.Event().wait(0.05)
        raw = b"no json" if "garbled" in prompt else json.dumps({"choices": [{"message": {"content": self.answer(prompt)}}]}).encode()
        with Service.lock:
            Service.now -= 1
        self.send_response(code)
        self.send_header("Content-Length", str(len(raw)))
        if code == 429:
            self.send_header("Retry-After", "0")
        self.end_headers()
        self.wfile.write(raw)

    def answer(self, prompt):
        if "retrieval plan" in prompt:
            return "no plan" if "nonsense" in prompt else json.dumps(PLAN)
        if "corrective_query" in prompt:
            return json.dumps({"covered": {"question": {"aim": ["E1"]}}, "corrective_query": ""})
        return "Tokens [E1]." if "Write the answer" in prompt else f"answer to {prompt}"

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked, Service.now, Service.most, Service.failures = Counter(), 0, 0, {}
    yield f"http://127.0.0.1:{server.server_port}/chat"
    server.shutdown()


def prompts(spark, rows):
    return spark.createDataFrame([(str(i), "writer", 0, p) for i, p in enumerate(rows)], "qid string, node string, round int, prompt string")


def completer(url, tmp_path, **more):
    return HttpCompleter(url, "secret", "m", 10.0, **{"pause": 0.01, "responses": str(tmp_path / "responses")} | more)


# ---------------------------------------------------------------- calls


def test_failed_calls_are_repeated_and_errors_are_rows(spark, tmp_path, service):
    Service.failures = {"busy": [429, 503], "down": [500] * 9, "denied": [401] * 9}
    got = {r.qid: (r.payload, r.error) for r in completer(service, tmp_path).attempt(prompts(spark, ["fine", "busy", "down", "denied", "garbled"])).collect()}
    assert got["0"] == ("answer to fine", None) and got["1"] == ("answer to busy", None)
    assert [got[i][0] for i in "234"] == [None] * 3
    assert got["2"][1].startswith("HTTP 500") and got["3"][1].startswith("HTTP 401") and "another form" in got["4"][1]
    assert Service.asked == {"fine": 1, "busy": 3, "down": 3, "denied": 1, "garbled": 1}


def test_a_closed_port_is_an_error(spark, tmp_path):
    got = completer("http://127.0.0.1:9/chat", tmp_path, retries=1).attempt(prompts(spark, ["x"])).first()
    assert got.payload is None and "refused" in got.error


def test_calls_are_made_several_at_a_time_but_not_too_many(spark, tmp_path, service):
    rows = prompts(spark, [f"slow {i}" for i in range(60)]).coalesce(1)
    one = completer(service, tmp_path, concurrency=3)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert one.attempt(rows).where("error is null").count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert 1 < Service.most <= 3


def dying():
    class Dying(HttpCompleter):
        """Its worker dies once, when it comes to a prompt. (Local classes travel to the workers by value.)"""

        def tried(self, prompt, node):
            marker = os.path.join(self.responses, "died")
            if prompt == "question 17" and not os.path.exists(marker):
                with open(marker, "w"):
                    pass
                os._exit(1)
            return super().tried(prompt, node)

    return Dying


def test_a_lost_task_repeats_no_answered_call(spark, tmp_path, service):
    folder = tmp_path / "responses"
    folder.mkdir()
    rows = prompts(spark, [f"question {i}" for i in range(40)])
    own = dying()(service, "secret", "m", 10.0, concurrency=1, responses=str(folder))
    with pytest.raises(Exception, match="(?i)worker|exit|EOF"):
        own.attempt(rows).collect()
    before = Counter(Service.asked)
    assert 0 < len(before) < 40
    got = {r.qid: r.payload for r in own.attempt(rows).collect()}
    assert got == {str(i): f"answer to question {i}" for i in range(40)}
    assert set(Service.asked.values()) == {1}  # before and after


def test_answers_are_kept_by_prompt_model_step_and_question(spark, tmp_path, service):
    one = completer(service, tmp_path)
    assert one.attempt(prompts(spark, ["a", "b"])).count() == one.attempt(prompts(spark, ["a", "b"])).count() == 2
    assert Service.asked == {"a": 1, "b": 1}
    one.attempt(prompts(spark, ["b", "b"])).collect()  # question 0 asks b for the first time
    one.attempt(prompts(spark, ["a"]).withColumn("round", F.lit(1))).collect()
    completer(service, tmp_path, responses=str(tmp_path / "others")).attempt(prompts(spark, ["a"])).collect()
    assert Service.asked == {"a": 3, "b": 2}


def test_a_cut_off_line_is_asked_again(tmp_path):
    kept = Kept(f"file:{tmp_path}/r", "writer-0", 3)
    kept.keep("k", "v ü\n")
    assert kept.answers() == {"k": "v ü\n"}  # before the file is closed
    kept.stream.write(b'{"key": "half", "pay')
    kept.close()
    assert Kept(str(tmp_path / "r"), "writer-0", 3).answers() == {"k": "v ü\n"} and Kept(str(tmp_path / "r"), "writer-0", 4).answers() == {}


# ---------------------------------------------------------------- batches


def batch(spark, *questions):
    return spark.createDataFrame([(str(i), q) for i, q in enumerate(questions)], "qid string, question string")


def test_a_question_that_fails_ends_alone(spark, tmp_path, service):
    Service.failures = {"Status: complete": [], "Which of two?": [500] * 9}
    questions = batch(spark, "Which tokens?", "nonsense", "Which of two?")
    got = {r.qid: r for r in workflow.ask_each(questions, engine(spark), Settings(min_rerank_score=0.5), completer(service, tmp_path), words).collect()}
    assert len(got) == 3 and got["0"].error is None and got["0"].answer == "Tokens [a.pdf p.1]."
    assert tuple(got["1"].error) == ("planner", "contract", "payload is no JSON object") and got["1"].answer == "" and got["1"].plan is None
    assert tuple(got["2"].error)[:2] == ("planner", "service") and got["2"].error.message.startswith("HTTP 500")
    with pytest.raises((ServiceError, workflow.PlanError)):
        workflow.ask(questions, engine(spark), Settings(min_rerank_score=0.5), completer(service, tmp_path), words)


def test_later_steps_fail_alone_too(spark, tmp_path, service):
    Service.failures = {"Decide which evidence": [400], "Write the answer": [400]}
    run = lambda *q: workflow.ask_each(batch(spark, *q), engine(spark), Settings(min_rerank_score=0.5), completer(service, tmp_path), words).collect()
    got = run("One?", "Two?", "Three?")
    assert set(Service.asked.values()) == {1}
    assert sorted((r.error.step if r.error else None, r.answer) for r in got if r.error) == [("verifier", ""), ("writer", "")]
    assert [r.answer for r in got if not r.error] == ["Tokens [a.pdf p.1]."] and all(r.evidence for r in got)
    with pytest.raises(ServiceError, match="question 0, planner"):
        workflow.ask(batch(spark, "x"), engine(spark), Settings(), completer("http://127.0.0.1:9/", tmp_path, retries=0, responses=str(tmp_path / "none")), words)


# ---------------------------------------------------------------- models


@pytest.fixture
def failing():
    def load(path):
        class Model:
            def encode(self, texts):
                raise RuntimeError("no memory\nat all")

            def predict(self, pairs):
                raise RuntimeError("no memory\nat all")

        return Model()

    return load


def test_models_that_fail_raise_on_the_driver(spark, tmp_path, failing):
    encode, score = providers.local_encoder(str(tmp_path), failing), providers.local_scorer(str(tmp_path), failing)
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    assert {tuple(r) for r in encode.attempt(rows).collect()} == {(i, None, "RuntimeError: no memory at all") for i in "12"}
    with pytest.raises(ModelUnavailableError, match="no memory at all"):
        providers.encodings(encode, rows)
    assert {tuple(r.s) for r in rows.select(score.attempt(F.col("id"), F.col("text")).alias("s")).collect()} == {(None, "RuntimeError: no memory at all")}
    e = engine(spark)
    with pytest.raises(ModelUnavailableError, match="no memory at all"):
        workflow.RetrievalEngine(e.chunks, e.indexes, encode).dense_search_many(batch(spark, "q").withColumnRenamed("question", "text"))
    states = workflow.initial_states(batch(spark, "reflection tokens")).withColumn("plan", F.col("plan").withField("queries", F.array(F.lit("reflection tokens"))).withField("retrievers", F.array(F.lit("sparse"))))
    with pytest.raises(ModelUnavailableError, match="the scorer failed: RuntimeError: no memory at all"):
        workflow.research(states, e, Settings(), score)


# ---------------------------------------------------------------- the command


@pytest.fixture
def corpus(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("LODESTONE_DATA_DIR", str(tmp_path / "data"))
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    monkeypatch.delenv("DEEPSEEK_API_KEY", raising=False)
    (tmp_path / "papers").mkdir()
    for name, text in (("a", "Self-RAG uses reflection tokens."), ("b", "CRAG uses an evaluator."), ("c", "Pasta needs salt.")):
        (tmp_path / "papers" / f"{name}.pdf").write_text(text)
    kinds = {"PAGE_READER": lambda content: [content.decode()], "ENCODER": lambda rows: rows.select("id", F.array(F.lit(1.0).cast("float")).alias("embedding")), "SCORER": words}
    monkeypatch.setattr(cli, "named", lambda variable, default: next((v for k, v in kinds.items() if variable.endswith(k)), default))
    assert cli.main(["ingest", str(tmp_path / "papers")]) == cli.main(["index"]) == 0
    return kinds


def asked(monkeypatch, capsys, url):
    monkeypatch.setattr(providers, "PROVIDERS", (("OPENAI_API_KEY", url),))
    capsys.readouterr()
    code = cli.main(["ask", "Which tokens does Self-RAG use?"])
    return code, *capsys.readouterr()


def test_the_command_tells_failures_by_its_exit_code(corpus, monkeypatch, capsys, service):
    code, out, err = asked(monkeypatch, capsys, "http://127.0.0.1:9/chat")
    assert (code, out) == (1, "") and err.strip().count("\n") == 0 and "completion service unavailable" in err and "refused" in err
    Service.failures = {"retrieval plan": [500] * 3}
    code, out, err = asked(monkeypatch, capsys, service)
    assert (code, out) == (1, "") and "HTTP 500" in err and err.strip().count("\n") == 0 and "Traceback" not in err
    assert asked(monkeypatch, capsys, service)[:2] == (0, "Tokens [a.pdf p.1].\n")


def test_the_command_tells_a_failing_scorer(corpus, monkeypatch, capsys, service, tmp_path, failing):
    corpus["SCORER"] = providers.local_scorer(str(tmp_path), failing)
    code, out, err = asked(monkeypatch, capsys, service)
    assert (code, out) == (1, "") and err.strip() == "the scorer failed: RuntimeError: no memory at all"

    @F.pandas_udf("double")
    def plain(query, text):
        raise RuntimeError("no memory")

    corpus["SCORER"] = plain
    code, out, err = asked(monkeypatch, capsys, service)
    assert (code, out) == (1, "") and err.strip().splitlines()[-1] == "a model failed: RuntimeError: no memory"
