"""Commands: ingest <directory>, index, ask <question>.

Models are those of the settings, if they are local folders, or are named by import paths module:attribute in LODESTONE_ENCODER (an
Encoder) and LODESTONE_SCORER (a Scorer), and a page reader in LODESTONE_PAGE_READER. Exit codes: 0 done, 1 a model or service failed, 2 no key for a completion service.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lodestone.plans.workflow import RetrievalEngine, ask
from lodestone.session import Settings, session
from lodestone.sources.pages import ingest, pdf_pages
from lodestone.sources.providers import HttpCompleter, ModelUnavailableError, ServiceError, local_encoder, local_scorer, missing_encoder
from lodestone.sources.store import StoreError, build_indexes, forget, load_chunks, load_indexes, save_indexes


def named(variable: str, default):
    path = os.environ.get(variable)
    if not path:
        return default
    module, _, attribute = path.partition(":")
    return getattr(importlib.import_module(module), attribute)


def local(variable: str, name: str, make, default):
    """The model that the variable names, or that of a local folder, or the default."""
    return named(variable, None) or (make(name) if os.path.isdir(name) else default)


def positioned(chunks):
    """Stored chunks with a position: their order in the store, by which ties are broken."""
    return chunks.withColumn("position", F.monotonically_increasing_id()).drop("score")


def run_ingest(args: argparse.Namespace, settings: Settings) -> int:
    chunks = ingest(session(), args.directory, settings.chunks_path, named("LODESTONE_PAGE_READER", pdf_pages))
    print(f"{chunks.count()} chunks from {args.directory}")
    return 0


def run_index(args: argparse.Namespace, settings: Settings) -> int:
    spark = session()
    chunks = positioned(load_chunks(spark, settings.chunks_path))
    indexes = build_indexes(chunks, local("LODESTONE_ENCODER", settings.embedding_model, local_encoder, missing_encoder(settings.embedding_model)))
    r = save_indexes(indexes, settings.index_dir)
    forget(settings.index_dir)
    print(f"indexed {r['chunks']} chunks, {r['entities']} entities, {r['edges']} edges, dense backend {r['backend']}")
    return 0


def run_ask(args: argparse.Namespace, settings: Settings) -> int:
    completer = HttpCompleter.from_env(settings.llm_model)
    if completer is None:
        print("no API key: set DEEPSEEK_API_KEY or OPENAI_API_KEY", file=sys.stderr)
        return 2
    spark = session()
    chunks = positioned(load_chunks(spark, settings.chunks_path))
    engine = RetrievalEngine(chunks, load_indexes(spark, settings.index_dir, chunks.count()), local("LODESTONE_ENCODER", settings.embedding_model, local_encoder, None), settings.top_k)
    questions = spark.createDataFrame([("1", args.question)], "qid string, question string")
    print(ask(questions, engine, settings, completer, local("LODESTONE_SCORER", settings.reranker_model, local_scorer, None)).first()["answer"])
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__.partition("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, argument, run in (("ingest", "directory", run_ingest), ("index", None, run_index), ("ask", "question", run_ask)):
        sub = commands.add_parser(name)
        if argument:
            sub.add_argument(argument)
        sub.set_defaults(run=run)
    args = parser.parse_args(argv)
    try:
        return args.run(args, Settings.from_env())
    except ModelUnavailableError as e:
        print(e, file=sys.stderr)
        return 1
    except StoreError as e:
        print(e, file=sys.stderr)
        return 1
    except ServiceError as e:
        print(f"completion service unavailable: {e}", file=sys.stderr)
        return 1
    except PythonException as e:  # an injected model without attempt() failed on an executor: its traceback's last line
        print(f"a model failed: {[line.strip() for line in str(e).splitlines() if line.strip()][-1]}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
