"""Line dedup: lines that recur across documents stay only in the document with the largest id.

Hashes of the line keys are range-partitioned together with document (descending) and position, so
a key that fills a third of all rows is cut over many tasks. Each task streams its sorted rows and
takes the first document of every run; runs that cross a partition border, at most two for each
partition, are stitched from a table of borders. What comes back is a sparse bitmap of dropped
lines for each document, not text.

Defined results: a null or empty text is one empty line; a text of any length counts whole; a row
without doc_id takes no part and keeps all its lines; rows that repeat a doc_id count as one
document; a line that stands more than once in the document that keeps it stays each time; an
empty table gives an empty result; other columns pass through, but those named __n_lines, __n_dropped
or __kept are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, Scratch, let, lower_ascii, shuffle_partitions, table

MIN_POINTS = 20
MIN_DOCS = 3
WORD = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_bitmaps(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Documents that lose lines: doc_id, text_hash, n_dropped, drop_words.

    drop_words is the keep bitmap in sparse form, (word, bits) for each 64 lines of which any go;
    a set bit is a dropped line and a missing word means that all 64 stay.
    """
    spark = docs.sparkSession
    rows = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_hash"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", lower_ascii(F.btrim("line", F.lit(WHITE))).alias("key"))
        .where(F.length("key") >= min_points)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    rows = scratch.save(rows, "hashes")  # the sample for the ranges and the ranges themselves read hashes, not texts
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "h1", "h2", F.desc("doc_id"), "pos")
    dealt = scratch.save(dealt.withColumn("part", F.spark_partition_id()), "lines")
    scratch.drop("hashes")

    run = Window.partitionBy("part", "h1", "h2")
    ordered = run.orderBy(F.desc("doc_id"), "pos")
    streamed = (
        dealt.withColumn("before", F.lag("doc_id").over(ordered))
        .withColumn("first_doc", F.first("doc_id").over(ordered))
        .withColumn("n_docs", F.sum(F.when(F.col("before").isNull() | (F.col("before") != F.col("doc_id")), 1).otherwise(0)).over(run))
    )

    # Border runs: the lowest and highest key of each partition, so at most two rows a partition.
    ends = dealt.groupBy("part").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("k")).select("part", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    by_doc = dealt.join(F.broadcast(ends), ["part", "h1", "h2"]).groupBy("part", "h1", "h2", "doc_id").count()
    sides = by_doc.groupBy("part", "h1", "h2").agg(F.max("doc_id").alias("hi"), F.min("doc_id").alias("lo"), F.count("*").alias("n"))
    along = Window.partitionBy("h1", "h2").orderBy("part")
    stitched = (
        sides.withColumn("shared", F.when(F.lag("lo").over(along) == F.col("hi"), 1).otherwise(0))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("parts"), F.max("hi").alias("all_first"), (F.sum("n") - F.sum("shared")).alias("all_docs"))
        .where("parts > 1")
        .drop("parts")
    )

    gone = (
        streamed.join(F.broadcast(stitched), ["h1", "h2"], "left")
        .where((F.coalesce("all_docs", "n_docs") >= min_docs) & (F.col("doc_id") != F.coalesce("all_first", "first_doc")))
        .select("doc_id", "text_hash", F.expr(f"pos div {WORD}").cast("int").alias("word"), F.expr(f"shiftleft(1L, pos % {WORD})").alias("bit"))
    )
    packed = gone.groupBy("doc_id", "text_hash", "word").agg(F.bit_or("bit").alias("bits"))
    return packed.groupBy("doc_id", "text_hash").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drop_words"))


def kept_text(text: Column, drop_words: Column) -> Column:
    """The lines that the bitmap keeps, joined by line feeds; a null bitmap keeps all."""

    def kept(lines: Column) -> Column:
        sparse = F.map_from_entries(drop_words)
        dense = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / WORD).cast("int")), lambda w: F.coalesce(F.try_element_at(sparse, w), F.lit(0).cast("long")))
        return let(dense, lambda d: F.array_join(F.filter(lines, lambda x, i: F.getbit(F.get(d, F.floor(i / WORD).cast("int")), i % WORD) == 0), "\n"))

    return F.when(drop_words.isNull(), F.coalesce(text, F.lit(""))).otherwise(let(lines_of(text), kept))


def dedup_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __n_lines (before dropping), __n_dropped and __kept, the text of the lines that stay."""
    docs = docs.drop("__n_lines", "__n_dropped", "__kept")
    maps = line_bitmaps(docs, scratch, id_col, text_col).alias("m")
    text = F.col(f"d.{text_col}")
    out = docs.alias("d").join(maps, (F.col(f"d.{id_col}") == F.col("m.doc_id")) & (text_key(text) == F.col("m.text_hash")), "left")
    return out.select("d.*", F.size(lines_of(text)).cast("long").alias("__n_lines"), F.coalesce("m.n_dropped", F.lit(0).cast("long")).alias("__n_dropped"), kept_text(text, F.col("m.drop_words")).alias("__kept"))


def op3_line_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, Scratch(spark, "line_dedup"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("__kept"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (
  SELECT k.*, (r.key IS NOT NULL AND k.doc_id <> r.top) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
