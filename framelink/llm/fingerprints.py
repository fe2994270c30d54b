"""Document fingerprints: one-permutation MinHash with optimal densification, packed to b bits.

Every distinct five-word shingle is hashed once; the top bits of the hash deal it to one of 256
bins and each bin keeps its least hash. An empty bin probes a fixed sequence of bins of its own
until it meets a filled one, the same in all texts: some bins drawn by hashing (bin, attempt), and
then all bins in an order of its own, so it always meets one. It hashes the value found with its own
number, so that bins which copy one value are as independent as others. The low four bits of each bin
are packed, one hex digit a bin. Likeness is the share of equal digits, corrected for the 1/16 that
agree by chance, and cut to 0..1.

Defined results: a text with fewer than five words is one shingle; a text without words has the
fingerprint of all zeros, which no other text has but by a chance of 16^-256; a text of any length
counts whole; rows without doc_id have no result; rows that repeat doc_id and text give equal rows;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE, Scratch, let, shuffle_partitions, table, words

BINS = 256
DRAWN = 24  # probes by hash before the ordered ones
REST = (1 << 56) - 1  # a bin's largest hash stands for "empty"


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    def of(h: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
        return F.when(F.size(h) >= size, run).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column) -> Column:
    """256 hex digits."""
    empty = F.expr(f"transform(sequence(-{BINS // 2}, {BINS // 2 - 1}), b -> shiftleft(cast(b AS bigint), 56) + {REST}L)")
    bin_of = lambda x: F.shiftright(x, 56)

    def least(s: Column) -> Column:  # sorted, so a bin's least hash is the first of its run
        return F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))

    def packed(e: Column) -> Column:
        digit = lambda x: F.lower(F.hex(x.bitwiseAND(15)))
        drawn = lambda b: F.aggregate(F.sequence(F.lit(1), F.lit(DRAWN)), F.lit(None).cast("bigint"), lambda acc, t: F.coalesce(acc, F.get(e, F.pmod(F.xxhash64(b, t), F.lit(BINS)).cast("int"))))
        # The first filled bin in b's order of all bins is the one with the least hash of (b, bin).
        in_order = lambda b, filled: F.array_min(F.transform(filled, lambda j: F.struct(F.xxhash64(b, j, F.lit(0)), F.get(e, j).alias("x"))))["x"]

        def dense(filled: Column) -> Column:
            copied = lambda b: F.xxhash64(F.coalesce(drawn(b), in_order(b, filled)), b)
            return F.when(F.size(filled) > 0, F.array_join(F.transform(e, lambda x, b: digit(F.coalesce(x, copied(b)))), "")).otherwise(F.lit("0" * BINS))

        return let(F.filter(F.transform(e, lambda x, b: F.when(x.isNotNull(), b)), lambda b: b.isNotNull()), dense)

    mins = let(F.sort_array(F.concat(shingle_hashes(text), empty)), least)
    return let(F.transform(mins, lambda x: F.when(x.bitwiseAND(REST) != REST, x)), packed)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, v: acc + v)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same / BINS - 1 / 16) / (15 / 16)))


def next_in_order(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, n_chars with the next row's next_id, next_hash, in descending order and round the end.

    Range partitions are ordered one by one; only their first rows are put in a row on one task.
    """
    dealt = ids.repartitionByRange(shuffle_partitions(ids.sparkSession), F.desc("doc_id"), F.desc("text_hash")).withColumn("part", F.spark_partition_id())
    dealt = scratch.save(dealt, "order")
    key = F.struct("doc_id", "text_hash")
    heads = dealt.groupBy("part").agg(F.max(key).alias("head"))
    line = Window.partitionBy(F.lit(0)).orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(line), F.first("head").over(line)).alias("after"))
    within = Window.partitionBy("part").orderBy(F.desc("doc_id"), F.desc("text_hash"))
    out = dealt.withColumn("nxt", F.lead(key).over(within)).join(F.broadcast(heads), "part")
    nxt = F.coalesce("nxt", "after")
    return out.select("doc_id", "text_hash", "n_chars", nxt["doc_id"].alias("next_id"), nxt["text_hash"].alias("next_hash"))


def op4_fingerprints(spark, sf_dir) -> DataFrame:
    scratch = Scratch(spark, "fingerprints")
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    ids = docs.select("doc_id", "text_hash", F.length("text").cast("long").alias("n_chars")).dropDuplicates(["doc_id", "text_hash"])
    order = scratch.save(next_in_order(ids, scratch), "next")
    taken = order.select(F.col("next_id").alias("doc_id"), F.col("next_hash").alias("text_hash"), F.col("doc_id").alias("for_id"), F.col("text_hash").alias("for_hash"), F.expr("cast(n_chars div 3 AS int)").alias("take"))
    pieces = docs.join(taken, ["doc_id", "text_hash"]).select(F.col("for_id").alias("doc_id"), F.col("for_hash").alias("text_hash"), F.expr("left(text, take)").alias("piece")).dropDuplicates(["doc_id", "text_hash"])
    both = docs.join(order, ["doc_id", "text_hash"]).join(pieces, ["doc_id", "text_hash"])
    edited = both.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 3 AS int)), piece)"))
    made = scratch.save(
        edited.select("doc_id", "text_hash", "next_id", "next_hash", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint")), "made"
    )
    after = made.select(F.col("doc_id").alias("next_id"), F.col("text_hash").alias("next_hash"), F.col("fingerprint").alias("next_fingerprint")).dropDuplicates(["next_id", "next_hash"])
    out = made.join(after, ["next_id", "next_hash"])
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
