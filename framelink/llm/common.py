"""Helpers shared by the operators: shared-folder tables, whitespace rules, Spark column pieces."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, and ASCII letters.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; a cluster gets it with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """What an operator builds once for all tasks of a Python worker. A worker keeps that of one operator only."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def trim() -> None:
    """Give freed memory back to the system; a worker outlives its task, and so would its unused pages."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def lean(run: Callable[[Iterator], Iterator], name: str = "") -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, without what other operators left in the worker, and leaving no more than kept(name)."""

    def task(batches):
        for other in set(_kept) - {name}:
            del _kept[other]
        trim()
        yield from run(batches)
        trim()

    return task


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Parquet tables in the shared folder that spark.checkpoint.dir names.

    A written table cuts lineage and survives lost executors. Only a local master may run without
    that setting; it then gets a temporary folder of its own.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="framelink-")
        self.spark, self.root = spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        path, fs = self._at()
        fs.deleteOnExit(path)  # what a query still reads goes with the driver

    def _at(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Let Spark delete the shuffle files of finished steps, which else stay until the driver happens to collect its garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            path, fs = self._at(name)
            fs.delete(path, True)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of non-white characters, A-Z lower-cased; null and empty texts have none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc32_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string"))
