"""Answers of a completion service, kept as they arrive.

A step's prompts are dealt into BUCKETS by their key, a bucket to one task. The task reads what its bucket's folder holds of the step
before it asks for the rest, a bounded number at a time, and appends each answer to a file of its own as soon as it is there. So a
task that is lost and run again, on whatever executor, asks only what was never answered. Errors are not kept.

The folder is any address that pyarrow's file systems take and all executors share. A file is closed after FILE_ANSWERS answers,
which is when a store without appends shows it; a line that was cut off is skipped.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from itertools import groupby, islice

import pyarrow as pa
from pyarrow import fs

#: Folders per step.
BUCKETS = 256
#: Answers in one file.
FILE_ANSWERS = 256

#: (prompt, node) -> (payload, None) or (None, error).
Ask = Callable[[str, str], tuple[str | None, str | None]]


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address such as Hadoop writes it (file:/x) or a local path."""
    scheme, _, rest = folder.partition(":")
    if scheme == "file" and not rest.startswith("//"):
        folder = f"file://{rest}"
    return fs.FileSystem.from_uri(folder)


class Kept:
    """A bucket's answers: those from before, and a file for more."""

    def __init__(self, folder: str, step: str, bucket: int):
        self.files, root = opened(folder)
        self.folder = posixpath.join(root, step, f"{bucket:03d}")
        self.files.create_dir(self.folder, recursive=True)
        self.stream, self.written = None, 0

    def answers(self) -> dict[str, str]:
        out = {}
        for info in self.files.get_file_info(fs.FileSelector(self.folder)):
            with self.files.open_input_stream(info.path) as f:
                for line in f.read().split(b"\n"):
                    try:
                        row = json.loads(line)
                        out[row["key"]] = row["payload"]
                    except (ValueError, KeyError):  # the last line of a task that was lost while it wrote
                        continue
        return out

    def keep(self, key: str, payload: str) -> None:
        if self.stream is None:
            self.stream = self.files.open_output_stream(posixpath.join(self.folder, f"{uuid.uuid4().hex}.jsonl"), buffer_size=None)
        self.stream.write(json.dumps({"key": key, "payload": payload}).encode() + b"\n")
        self.stream.flush()
        self.written += 1
        if self.written % FILE_ANSWERS == 0:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def asked(rows: list[dict], ask: Ask, kept: Kept, known: dict[str, str], concurrency: int) -> Iterator[tuple[str, str | None, str | None]]:
    """(qid, payload, error) of each row. At most `concurrency` calls are under way; what arrives is kept first."""
    todo = []
    for row in rows:
        if row["key"] in known:
            yield row["qid"], known[row["key"]], None
        else:
            todo.append(row)
    rest = iter(todo)
    with ThreadPoolExecutor(concurrency) as pool:
        running: dict[Future, dict] = {}
        while True:
            for row in islice(rest, concurrency - len(running)):
                running[pool.submit(ask, row["prompt"], row["node"])] = row
            if not running:
                return
            for done in wait(running, return_when=FIRST_COMPLETED).done:
                row = running.pop(done)
                payload, error = done.result()
                if error is None:
                    kept.keep(row["key"], payload)
                yield row["qid"], payload, error


def answering(ask: Ask, folder: str, concurrency: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow's function on prompts (qid, node, step, bucket, key, prompt), all rows of a step's bucket in one task and together:
    (qid, payload, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, known = None, None, {}
        try:
            for batch in batches:
                for own, rows in groupby(batch.to_pylist(), lambda r: (r["step"], r["bucket"])):
                    if own != at:
                        if kept is not None:
                            kept.close()
                        at, kept = own, Kept(folder, *own)
                        known = kept.answers()
                    done = list(asked(list(rows), ask, kept, known, concurrency))
                    qids, payloads, errors = zip(*done, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (qids, payloads, errors)], names=["qid", "payload", "error"])
        finally:
            if kept is not None:
                kept.close()

    return run
