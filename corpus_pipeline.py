"""Five stages from documents to token ids; each is written as Parquet and read again for the next.

In all stages: a row without doc_id can't be named and goes in the first stage; a null text is an
empty one and goes there too; texts of any length count whole; rows that repeat a doc_id and a text are
judged alike, and rows that share a doc_id but not the text stay or go together in the stages that
drop documents; an empty table gives an empty table; columns other than those of documents are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelink.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from framelink.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with text in a language go on; those without a letter are rejected, and all if no text has a language to learn from. Equal scores don't reject."""
    known = language_id.predict(docs.select(*COLUMNS), *language_id.trained(docs))
    return known.where((F.col("lang_pred") != language_id.UND) & F.col("doc_id").isNotNull()).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur in three documents go from all but the one of the largest doc_id; no document goes, but a text may become empty. n_chars is counted anew."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), Scratch(spark, "pipeline-lines"))
    return out.withColumn("text", F.col("__kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts the document with the least doc_id stays, with all rows of that doc_id; texts without words stay."""
    sets = ngram_join.similar_sets(docs, Scratch(spark, "pipeline-copies"))
    gone = sets.where("doc_id <> component_id").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, or an edited copy of one, go; without items none does."""
    gone = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each row; an empty text has no ids."""
    return bpe.encode(docs, *bpe.public_vocab()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_join", copies), ("decontaminate", benchmark), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
