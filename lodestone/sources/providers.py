"""Models that the caller brings: encoders, scorers, completers. A missing one is an error, never a silent fallback.

Models of local folders and the completion service run on executors. What fails there comes back as a row: attempt() gives, beside
the result, an error that is null where there is none, and the driver raises what it finds. So a failure costs no task its
retries, and the caller sees ModelUnavailableError or ServiceError instead of a worker's traceback.
"""

from __future__ import annotations

import http.client
import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import cut, shared_folder, shuffles
from lodestone.sources.responses import BUCKETS, answering

#: (id, text) -> (id, embedding), unit vectors of floats.
Encoder = Callable[[DataFrame], DataFrame]
#: (query, text) -> a column of scores, an expression or a pandas UDF.
Scorer = Callable[[Column, Column], Column]


class ModelUnavailableError(RuntimeError):
    """A model is needed that is not there, or fails."""


class ServiceError(RuntimeError):
    """A completion service gave no answer."""


class Completer(Protocol):
    """prompts (qid, node, round, prompt) -> (qid, payload): a JSON object for planner and verifier, text for the writer."""

    def complete(self, prompts: DataFrame) -> DataFrame: ...


def model_path(name: str) -> str:
    """A local model folder. Nothing is downloaded: the name of a model that isn't on this machine raises."""
    if os.path.isdir(name):
        return name
    raise ModelUnavailableError(f"model {name!r} is not a local folder")


MODELS: dict[tuple[str, str, str], Any] = {}


def loaded(load: Callable[[str], Any], path: str) -> Any:
    """A model, loaded once per Python process: tasks that run in one worker share it. A loader is known by its name, as each task gets
    a copy of it."""
    key = (load.__module__, load.__qualname__, path)
    if key not in MODELS:
        MODELS[key] = load(path)
    return MODELS[key]


def sentence_transformer(path: str) -> Any:
    """An encoding model of a local folder, if the library is there."""
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as e:
        raise ModelUnavailableError("the sentence_transformers library is not installed") from e
    return SentenceTransformer(path)


def cross_encoder(path: str) -> Any:
    """A scoring model of a local folder, if the library is there."""
    try:
        from sentence_transformers import CrossEncoder
    except ImportError as e:
        raise ModelUnavailableError("the sentence_transformers library is not installed") from e
    return CrossEncoder(path)


@dataclass(frozen=True)
class LocalEncoder:
    """An Encoder of a local model, whose encode(list of texts) gives vectors; they are scaled to length 1. Runs on the executors."""

    path: str
    load: Callable[[str], Any]

    def attempt(self, rows: DataFrame) -> DataFrame:
        """(id, text) -> (id, embedding, error)"""
        path, load = self.path, self.load

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    vectors, error = attempted(lambda texts: encoded(loaded(load, path), texts), batch.column("text").to_pylist())
                    n = batch.num_rows
                    given = pa.array(list(vectors), pa.list_(pa.float32())) if error is None else pa.nulls(n, pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([batch.column("id"), given, pa.array([error] * n, pa.string())], names=["id", "embedding", "error"])

        kind = T.StructType([rows.schema["id"], T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])
        return rows.select("id", "text").mapInArrow(run, kind)

    def __call__(self, rows: DataFrame) -> DataFrame:
        return self.attempt(rows).select("id", F.when(F.col("error").isNull(), F.col("embedding")).otherwise(F.raise_error(F.col("error")).cast("array<float>")).alias("embedding"))


@dataclass(frozen=True)
class LocalScorer:
    """A Scorer of a local model, whose predict(list of pairs) gives scores, as many as pairs. Runs on the executors."""

    path: str
    load: Callable[[str], Any]

    def attempt(self, query: Column, text: Column) -> Column:
        """A struct (score, error)."""
        path, load = self.path, self.load

        @F.pandas_udf("score double, error string")
        def score(query: pd.Series, text: pd.Series) -> pd.DataFrame:
            scores, error = attempted(lambda pairs: predicted(loaded(load, path), pairs), list(zip(query, text, strict=True)))
            return pd.DataFrame({"score": scores if error is None else [None] * len(query), "error": [error] * len(query)}).astype({"score": "float64", "error": "object"})

        return score(query, text)

    def __call__(self, query: Column, text: Column) -> Column:
        both = self.attempt(query, text)
        return F.when(both["error"].isNull(), both["score"]).otherwise(F.raise_error(both["error"]).cast("double"))


def attempted(run: Callable[[list], Any], given: list) -> tuple[Any, str | None]:
    """What run gives, or the error as one line. The boundary to foreign code, which may raise anything."""
    try:
        return run(given), None
    except Exception as e:
        return None, " ".join(f"{type(e).__name__}: {e}".split())


def encoded(model: Any, texts: list[str]) -> np.ndarray:
    x = np.asarray(model.encode(texts), np.float32)
    if x.ndim != 2 or len(x) != len(texts):
        raise ModelUnavailableError(f"the encoder gave {x.shape} values for {len(texts)} texts")
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def predicted(model: Any, pairs: list[tuple[str, str]]) -> np.ndarray:
    scores = np.asarray(model.predict(pairs), np.float64)
    if scores.shape != (len(pairs),):
        raise ModelUnavailableError(f"the scorer gave {scores.shape} scores for {len(pairs)} pairs")
    return scores


def local_encoder(name: str, load: Callable[[str], Any] = sentence_transformer) -> LocalEncoder:
    return LocalEncoder(model_path(name), load)


def local_scorer(name: str, load: Callable[[str], Any] = cross_encoder) -> LocalScorer:
    return LocalScorer(model_path(name), load)


def encodings(encoder: Encoder, rows: DataFrame) -> DataFrame:
    """(id, embedding) of all rows, written once. ModelUnavailableError if any has an error."""
    attempt = getattr(encoder, "attempt", None)
    if attempt is None:
        return encoder(rows)
    done = cut(attempt(rows))
    bad = done.where("error is not null").select("error").head()
    if bad is not None:
        raise ModelUnavailableError(f"the encoder failed: {bad['error']}")
    return done.select("id", "embedding")


def missing_encoder(name: str) -> Encoder:
    def encode(rows: DataFrame) -> DataFrame:
        raise ModelUnavailableError(f"no encoder given for {name!r}")

    return encode


@dataclass(frozen=True)
class Recorded:
    """Answers recorded beforehand: (qid, node, round, payload)."""

    answers: DataFrame

    def complete(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("qid", "node", "round").join(self.answers, ["qid", "node", "round"]).select("qid", "payload")


#: (variable with the key, address), in order of precedence. Fixed values.
PROVIDERS = (("DEEPSEEK_API_KEY", "https://api.deepseek.com/chat/completions"), ("OPENAI_API_KEY", "https://api.openai.com/v1/chat/completions"))


#: Answers after which a call is made again: time-outs, conflicts, too many requests, and everything of the service itself.
AGAIN = frozenset({408, 409, 429}) | frozenset(range(500, 600))


@dataclass(frozen=True)
class HttpCompleter:
    """A chat completion service, called from the executors, temperature 0.

    A task makes `concurrency` calls at a time; a failed one is repeated up to `retries` times, after a pause that doubles each time (or the
    one that the service names) up to `longest_pause`. Answers are kept in the folder `responses` (see responses.py), by default one of this application
    in the checkpoint folder: a named folder lasts, and what it holds isn't asked again by later runs.
    """

    url: str
    key: str
    model: str
    timeout: float = 120.0
    concurrency: int = 8
    retries: int = 2
    pause: float = 0.5
    longest_pause: float = 30.0
    responses: str | None = None

    @classmethod
    def from_env(cls, model: str, env: dict[str, str] | None = None) -> HttpCompleter | None:
        """The first provider whose key is set, or None."""
        env = dict(os.environ) if env is None else env
        return next((cls(url, env[name].strip(), model) for name, url in PROVIDERS if env.get(name, "").strip()), None)

    def call(self, prompt: str, as_json: bool) -> str:
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]} | ({"response_format": {"type": "json_object"}} if as_json else {})
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            return json.load(response)["choices"][0]["message"]["content"] or ""

    def tried(self, prompt: str, node: str) -> tuple[str | None, str | None]:
        """(payload, None), or (None, error) when all tries failed."""
        for attempt in range(self.retries + 1):
            pause = min(self.longest_pause, self.pause * 2**attempt) * random.uniform(0.75, 1.25)
            try:
                return self.call(prompt, node != "writer"), None
            except urllib.error.HTTPError as e:
                error, again = f"HTTP {e.code} {e.reason}", e.code in AGAIN
                wanted = e.headers.get("Retry-After", "")
                pause = min(self.longest_pause, float(wanted)) if wanted.isdigit() else pause
            except (OSError, http.client.HTTPException) as e:  # URLError and time-outs are OSErrors
                error, again = str(getattr(e, "reason", e)) or type(e).__name__, True
            except (ValueError, LookupError, TypeError) as e:
                error, again = f"an answer of another form ({type(e).__name__})", False
            if not again:
                break
            if attempt < self.retries:
                time.sleep(pause)
        return None, error

    def attempt(self, prompts: DataFrame) -> DataFrame:
        """prompts (qid, node, round, prompt) -> (qid, payload, error), one of the two being null."""
        spark = prompts.sparkSession
        turn = F.col("round") if "round" in prompts.columns else F.lit(0)
        own = prompts.select(F.col("qid").cast("string").alias("qid"), "node", F.concat_ws("-", "node", turn).alias("step"), "prompt")
        key = F.sha2(F.to_json(F.struct(F.lit(self.url).alias("url"), F.lit(self.model).alias("model"), "qid", "step", "prompt")), 256)
        keyed = own.withColumn("key", key).withColumn("bucket", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"))
        dealt = keyed.repartition(shuffles(spark), "step", "bucket").sortWithinPartitions("step", "bucket")
        folder = self.responses or f"{shared_folder(spark)}/responses"
        return dealt.select("qid", "node", "step", "bucket", "key", "prompt").mapInArrow(answering(self.tried, folder, self.concurrency), "qid string, payload string, error string")

    def complete(self, prompts: DataFrame) -> DataFrame:
        """prompts (qid, node, round, prompt) -> (qid, payload); a prompt without an answer raises."""
        return self.attempt(prompts).select("qid", F.when(F.col("error").isNull(), F.col("payload")).otherwise(F.raise_error(F.col("error")).cast("string")).alias("payload"))
