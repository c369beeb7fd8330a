"""Text from files: routing by format, and reading in processes that can be killed.

Input is Spark's ``binaryFile`` source or any frame (path, content). Errors are values of a column,
so that one bad file does not stop a job. Each task has a process beside it that reads its files (``office``); it has a
limit of memory, and one that is not done by the deadline, or dies, is ended whatever it does, costs one file and is replaced.
"""

from __future__ import annotations

import os
import pickle
import select
import struct
import subprocess
import sys
import time
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .office import MAX_CHARACTERS, TEXT_EXTENSIONS, ExtractionError, cut_blocks, decode_strict, docx_blocks, extract_one, pptx_text, space_camel_case, xlsx_text

__all__ = ["MAX_CHARACTERS", "TEXT_EXTENSIONS", "ExtractionError", "Reader", "cut_blocks", "decode_strict", "docx_blocks", "extract", "extract_one", "pptx_text", "routed", "space_camel_case", "xlsx_text"]

DEADLINE_SECONDS = 15
#: Files whose results a task holds at once.
FILES = 64
#: Bytes of memory that a reading process may have.
MEMORY = 2 << 30
RESULT = "path string, text string, truncated boolean, characters long, blocks array<struct<ordinal:int,text:string,label:string,heading_path:string>>, error_code string"

_CHILD = """
import pickle, resource, struct, sys
from corpusloom.sources.office import extract_one
source, sink = sys.stdin.buffer, sys.stdout.buffer
sys.stdout = sys.stderr
def take():
    head = source.read(8)
    return pickle.loads(source.read(struct.unpack("<q", head)[0])) if len(head) == 8 else None
memory, readers = take()
if memory:
    resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
if readers is not None:
    from pyspark import cloudpickle
    readers = cloudpickle.loads(readers)
while (job := take()) is not None:
    data = pickle.dumps(extract_one(*job, readers))
    sink.write(struct.pack("<q", len(data)) + data)
    sink.flush()
"""


class Reader:
    """A process that extracts files, one at a time."""

    def __init__(self, seconds: float, memory: int | None, readers: dict | None):
        self.seconds, self.memory, self.readers = seconds, memory, cloudpickle.dumps(readers) if readers else None
        self.child: subprocess.Popen | None = None

    def _start(self) -> None:
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        self.child = subprocess.Popen([sys.executable, "-c", _CHILD], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, start_new_session=True)
        for pipe in (self.child.stdin, self.child.stdout):
            os.set_blocking(pipe.fileno(), False)
        self.waiting = _frame((self.memory, self.readers))

    def extract(self, path: str | None, content: bytes | None, max_bytes: int, max_characters: int) -> dict:
        if content is not None and len(content) > max_bytes:
            content = content[: max_bytes + 1]  # only told by its length
        if self.child is None or self.child.poll() is not None:
            self._start()
        job = self.waiting + _frame((path, content, max_bytes, max_characters))
        self.waiting = b""
        answer = self._exchange(memoryview(job), time.monotonic() + self.seconds)
        if isinstance(answer, bytes):
            return pickle.loads(answer)
        self.close()
        return {"path": path, "text": None, "truncated": None, "characters": None, "blocks": None, "error_code": answer}

    def _exchange(self, job: memoryview, deadline: float) -> bytes | str:
        """The answer, or the code of an error."""
        into, out, got = self.child.stdin.fileno(), self.child.stdout.fileno(), b""
        while True:
            left = deadline - time.monotonic()
            if left <= 0:
                return "EXTRACTION_TIMEOUT"
            readable, writable, _ = select.select([out], [into] if job else [], [], left)
            try:
                if writable:
                    job = job[os.write(into, job[: 1 << 16]) :]
                if readable:
                    data = os.read(out, 1 << 20)
                    if not data:
                        return "EXTRACTION_FAILED"
                    got += data
            except BrokenPipeError:
                return "EXTRACTION_FAILED"
            if len(got) >= 8 and len(got) - 8 == struct.unpack("<q", got[:8])[0]:
                return got[8:]

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.wait()
            self.child.stdin.close()
            self.child.stdout.close()
            self.child = None


def _frame(value) -> bytes:
    data = pickle.dumps(value)
    return struct.pack("<q", len(data)) + data


def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the batches, FILES at a time: what is made of them takes many times their memory."""
    for batch in batches:
        for begin in range(0, len(batch), FILES):
            yield batch.iloc[begin : begin + FILES]


def extract(files: DataFrame, max_bytes: int = 10 * 1024 * 1024, max_characters: int = MAX_CHARACTERS, seconds: float = DEADLINE_SECONDS, readers: dict | None = None, memory: int | None = MEMORY) -> DataFrame:
    """(path, text, truncated, characters, blocks, error_code) of files (path, content): one row each, whatever is in
    them. ``readers`` maps further extensions, such as pdf, to functions of the content that give the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(seconds, memory, readers)
        try:
            for batch in parts(batches):
                rows = [reader.extract(path, None if content is None else bytes(content), max_bytes, max_characters) for path, content in zip(batch["path"], batch["content"], strict=True)]
                yield pd.DataFrame(rows, columns=["path", "text", "truncated", "characters", "blocks", "error_code"])
        finally:
            reader.close()

    return files.select("path", "content").mapInPandas(run, RESULT)


def routed(files: DataFrame, max_bytes: int) -> DataFrame:
    """(path, route): what would read each file, decided from name and length alone."""
    extension = F.lower(F.regexp_extract("path", r"\.([^.\\/]*)$", 1))
    route = F.when(F.col("length") > max_bytes, "FILE_TOO_LARGE").when(extension.isin(TEXT_EXTENSIONS), "text").when(extension.isin("docx", "xlsx", "pptx", "pdf"), extension).otherwise("UNSUPPORTED_FILE_TYPE")
    return files.select("path", route.alias("route"))
