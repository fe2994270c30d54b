"""What a Python worker holds that runs the tasks of several operators, one after another."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace as Plain

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from framelink.llm import bpe, language_id, ngram_join


class Docs:
    """In place of a table: keeps the task that mapInArrow gets."""

    columns = ["doc_id", "text"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    sparkSession = Plain(sparkContext=Plain(environment={}, broadcast=lambda x: Plain(value=x)))
    task = None

    def mapInArrow(self, task, schema):
        self.task = self.task or task
        return self

    def __getattr__(self, name):
        return lambda *a, **k: self


def memory(key: str) -> int:
    """MB now (VmRSS) or at most since peak() (VmHWM)."""
    return int(next(x.split()[1] for x in Path("/proc/self/status").read_text().splitlines() if x.startswith(key))) // 1024


def peak() -> None:
    Path("/proc/self/clear_refs").write_text("5")


def worker() -> None:
    """Prints the MB that shingling takes at most, and that stay after it, beyond those from before any task."""
    rng = np.random.default_rng(3)
    words = np.array([f"word{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 600)]) for _ in range(5000)]  # 25 MB, two batches of shingles
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    ngram_join.ranges_for, ngram_join.TaskContext = lambda docs: 256, Plain(get=lambda: Plain(partitionId=lambda: 0))
    del texts
    before, tasks = memory("VmRSS"), [Docs(), Docs(), Docs()]
    language_id.predict(tasks[0], ["aa"], np.ones((1, language_id.DIM), np.float32))
    bpe.digests(tasks[1], *bpe.public_vocab())
    ngram_join.shared_shingles(tasks[2], Docs())
    for d in tasks[:2]:
        for _ in d.task(iter([batch.slice(0, 500)])):
            pass
    peak()
    rows = sum(b.num_rows for b in tasks[2].task(iter([batch])))
    assert rows > 2
    print(memory("VmHWM") - before, memory("VmRSS") - before)


def test_worker_memory():
    """A worker of the n-gram join doesn't hold the tables of language ID and of BPE, nor its own freed arrays."""
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", "from tests.llm.test_worker_memory import worker; worker()"], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    most, stays = map(int, done.stdout.split())
    assert most < 120 and stays < 30
