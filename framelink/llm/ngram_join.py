"""N-gram Jaccard join: size-aware heavy-light join over sets of five-word shingles.

1. Every text becomes its set of distinct 64-bit shingle hashes. Sets are dealt out in packed form, by
   hash range, once; each range counts in how many texts a shingle occurs (copies in one batch of
   texts count once) and answers with those that occur in two or more. A shingle that many texts of
   a batch have travels once for the batch, with their number, and those texts wait for its answer,
   so a shingle in a third of all texts is one entry for each batch. The number of ranges follows the
   bytes of text.
2. A set can only have a partner if enough of its shingles came back. Those sets are kept whole, one
   for all equal sets. They order shingles by (frequency, hash), so a pair at the threshold shares
   one shingle among the first |A| - need + 1 of each, and two among one more.
3. Light sets enumerate the two-element subsets of that longer prefix and meet on equal subsets;
   heavy sets scan the inverted lists of single shingles. The boundary between them is the size
   at which the summed costs, by size class over all sets, are least.
4. On each list the sets are first compared with the most central one only. Links found so are
   merged to components, and then only sets of different components on a list are compared, each
   against the others than the list's largest component. Links inside a component can't change it,
   so no link is lost and a group of near copies isn't expanded to its pairs. The known overlaps
   with the central set L bound those that remain: |A and B| <= min(|A and L|, |B and L|) +
   min(|A - L|, |B - L|). What remains of a long list is cut into blocks, and each pair of blocks
   is a key of its own, so no list is one task's.

similar_sets gives components; similar_pairs gives every link between different sets, and so can't
skip step 4's comparisons inside a component.

Every candidate is verified on whole sets. Defined results: null, empty and wordless texts have no
shingles and link with nothing; a text of any length is one set; a row without doc_id has no result;
repeated rows are exact copies, and rows that share a doc_id but not the text have a row each; equal
frequencies are ordered by hash; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, Scratch, lean, ship, table, trim
from .components import components
from .textnp import U, cells, chunks, distinct_shingles, pack, set_keys, unpack

PERCENT = 80


PARTS = "bucket int, uid long, texts binary, counts binary, toks binary, df binary, hot binary, hot_n binary, ids binary, sizes binary, keys binary"
NAMES = [c.split()[0] for c in PARTS.split(", ")]
BATCH = 1_500_000  # shingles that a task packs at once
CHUNK_BYTES = 1 << 20  # of text whose shingles are made at once
OFTEN = 8  # texts of a batch from which a shingle travels once for all of them
RANGE_BYTES = 16 << 20  # of text for each range, until cells of a batch and range would hold a few dozen shingles only
FEWEST, MOST = 1 << 8, 1 << 17  # ranges; 2^8 leaves 7 bytes of a hash to be sent
BLOCK = 256  # sets of a list that are compared in one task with as many others


def ranges_for(docs: DataFrame) -> int:
    """A power of two in proportion to the bytes of text. One number comes to the driver."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST, max(FEWEST, 1 << (-(-size // RANGE_BYTES) - 1).bit_length() if size else 1))


def _rows(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64()] + [pa.binary()] * 9, strict=True)]


def _seven(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _eight(parts: list[bytes], top: np.ndarray) -> np.ndarray:
    """Hashes from their lower seven bytes and each part's highest byte."""
    low = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 7)
    out = np.empty((len(low), 8), np.uint8)
    out[:, :7], out[:, 7] = low, np.repeat(np.broadcast_to(top, len(parts)), np.array([len(p) // 7 for p in parts], np.int64))
    return out.view("<u8").ravel()


def shared_shingles(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n (set size), key (16 bytes, equal for equal sets), tok, df of each row of docs (doc_id, text).

    tok, df: the shingles that other texts have too; null if they are too few for a partner, and for
    all but one of the equal sets in a batch.
    """
    bits = ranges_for(docs).bit_length() - 1
    at_of = lambda h: (h >> U(64 - bits)).astype(np.int64)

    def often(h: np.ndarray) -> np.ndarray:
        """Of the hashes of a batch, those that occur OFTEN times or more, ascending."""
        slot = (h >> U(43)).astype(np.int32)
        met = np.zeros(1 << 21, np.int32)
        for lo in range(0, len(slot), 1 << 19):
            met += np.bincount(slot[lo : lo + (1 << 19)], minlength=1 << 21)
        known, n = np.unique(h[(met >= OFTEN)[slot]], return_counts=True)
        return known[n >= OFTEN]

    def packed(uid: int, parts: list[tuple]):
        ids, n, key = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
        before = np.cumsum([0, *(len(p[0]) for p in parts)])
        text = np.concatenate([p[3] + np.uint32(b) for p, b in zip(parts, before, strict=False)])
        h = np.concatenate([p[4] for p in parts])
        parts.clear()  # each array from here on is freed once the next is made from it
        once = np.zeros(len(ids), bool)
        once[np.unique(key.view("V16").ravel(), return_index=True)[1]] = True
        if not once.all():
            h = h[once[text]]
            text = text[once[text]]
        hot = often(h)
        place = np.minimum(np.searchsorted(hot, h), max(0, len(hot) - 1)).astype(np.uint32)
        is_hot = hot[place] == h if len(hot) else np.zeros(len(h), bool)
        hot_n = np.bincount(place[is_hot], minlength=len(hot)).astype(np.uint32)
        # The texts of often-met shingles stay with the batch: (text, number of the shingle) pairs.
        out = [(-1 - ((uid >> 32) * 4099 + (uid & 0xFFFFFFFF)) % (1 << 30), uid, text[is_hot].astype(np.uint32).tobytes(), place[is_hot].tobytes(), None, None, hot.astype("<u8").tobytes(), None, ids.tobytes(), n.astype(np.int32).tobytes(), key.tobytes())]
        del place
        text = text[~is_hot]
        h = h[~is_hot]
        order = np.argsort((h >> U(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
        text = text[order]
        h = h[order]
        del order
        ends, hot_ends = (np.searchsorted(at, np.arange((1 << bits) + 1)) for at in (at_of(h), at_of(hot)))
        for k in np.flatnonzero(np.diff(ends) + np.diff(hot_ends)):
            p, q = slice(ends[k], ends[k + 1]), slice(hot_ends[k], hot_ends[k + 1])
            own = text[p]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            out.append((int(k), uid, pack(np.diff(own[first].astype(np.int64), prepend=0)), pack(np.diff(np.append(first, len(own)))), _seven(h[p]), None, _seven(hot[q]), pack(hot_n[q]), *[None] * 3))
        return pa.RecordBatch.from_arrays(_rows(out), NAMES)

    def deal(batches):
        task, k, held, parts = TaskContext.get().partitionId(), 0, 0, []
        for b in batches:
            for lo, hi in chunks(b.column(1), CHUNK_BYTES):
                text, h = distinct_shingles(b.column(1).slice(lo, hi - lo), size)
                n, key = set_keys(text, h, hi - lo)
                parts.append((b.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64), n, key, text.astype(np.uint32), h))
                held += len(h)
                if held >= BATCH:
                    yield packed(task << 32 | k, parts)
                    k, held, parts = k + 1, 0, []
                    trim()
        if parts:
            yield packed(task << 32 | k, parts)

    def count(t: pa.Table) -> pa.Table:
        """In how many texts each shingle of a range is, to each batch that sent it; shingles of one text have no answer."""
        bucket = t.column("bucket")[0].as_py()
        if bucket < 0:
            return t
        col = {c: t.column(c).to_pylist() for c in ("uid", "texts", "counts", "toks", "hot", "hot_n")}
        top = np.uint8(bucket >> (bits - 8))
        tok, hot = _eight(col["toks"], top), _eight(col["hot"], top)
        every, at = np.unique(np.concatenate([tok, hot]), return_inverse=True)
        weight = np.concatenate([np.ones(len(tok), np.int64), *map(unpack, col["hot_n"])])
        df = np.bincount(at, weight, minlength=len(every)).astype(np.uint32)[at]
        out, i, j = [], 0, len(tok)
        for uid, x, c, low, hot in zip(col["uid"], col["texts"], col["counts"], col["toks"], col["hot"], strict=True):
            x, c, low = np.cumsum(unpack(x)), unpack(c), np.frombuffer(low, np.uint8).reshape(-1, 7)
            own, more = df[i : i + len(low)], df[j : j + len(hot) // 7]
            i, j = i + len(low), j + len(hot) // 7
            many = own > 1
            if many.any() or len(hot):
                left = np.add.reduceat(many.astype(np.int64), np.cumsum(c) - c) if len(c) else c
                out.append((bucket, uid, pack(np.diff(x[left > 0], prepend=0)), pack(left[left > 0]), low[many].tobytes(), pack(own[many]), hot, pack(more), None, None, None))
        return pa.Table.from_arrays(_rows(out), NAMES) if out else t.slice(0, 0)

    def whole(t: pa.Table) -> pa.Table:
        trim()
        head, rows = None, []
        for r in t.to_pylist():
            if r["bucket"] < 0:
                head = r
            else:
                rows.append(r)
        ids, n, key = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["sizes"], np.int32), np.frombuffer(head["keys"], np.uint8).reshape(-1, 16)
        read = lambda c: np.concatenate([np.zeros(0, np.int64), *(unpack(r[c]) for r in rows)])
        top = np.array([r["bucket"] >> (bits - 8) for r in rows], np.uint8)
        text = np.repeat(np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack(r["texts"])) for r in rows)]), read("counts"))
        hot, waiting, place = np.frombuffer(head["hot"], "<u8"), np.frombuffer(head["texts"], np.uint32), np.frombuffer(head["counts"], np.uint32)
        hot_df = np.zeros(len(hot), np.uint32)
        hot_df[np.searchsorted(hot, _eight([r["hot"] for r in rows], top))] = read("hot_n")
        text = np.concatenate([text, waiting.astype(np.int64)])
        tok = np.concatenate([_eight([r["toks"] for r in rows], top), hot[place]]).view(np.int64)
        df = np.concatenate([read("df"), hot_df[place]]).astype(np.int32)
        per = np.bincount(text, minlength=len(ids))
        enough = (per * 100 >= n.astype(np.int64) * percent) & (n > 0)
        order = np.argsort(text, kind="stable")
        order = order[enough[text[order]]]
        at = pa.array(np.concatenate([[0], np.cumsum(np.where(enough, per, 0))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x[order]), mask=pa.array(~enough)) for x in (tok, df)]
        return pa.Table.from_arrays([pa.array(ids), pa.array(n), cells(key), *lists], ["doc_id", "n", "key", "tok", "df"])

    answered = scratch.save(docs.mapInArrow(lean(deal), PARTS).groupBy("bucket").applyInArrow(count, PARTS), "answers")
    scratch.free()  # the dealt shingles, the largest of all shuffles
    return answered.groupBy("uid").applyInArrow(whole, "doc_id long, n int, key binary, tok array<long>, df array<int>")


def _linked(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return shared * 100 >= percent * (a + b - shared)


def _possible(a: str, b: str, percent: int) -> Column:
    """Sizes, and shingles that came back, allow the overlap that the threshold needs."""
    na, nb, ta, tb = (F.col(f"{x}.{c}") for c in ("n", "t") for x in (a, b))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(ta, tb) * (100 + percent) >= percent * (na + nb))


def boundary(sets: DataFrame) -> int:
    """The largest size of a light set. One row for each power of two comes to the driver."""
    rows = (
        sets.groupBy(F.floor(F.log2("n")).alias("cls"))
        .agg(F.sum(F.expr("cast(p AS double) * (p + 1) / 2")).alias("enumerate"), F.sum("scan").alias("scan"))
        .orderBy("cls")
        .collect()
    )
    costs = [(sum(r["enumerate"] for r in rows[:k]) + sum(r["scan"] for r in rows[k:]), k) for k in range(len(rows) + 1)]
    k = min(costs)[1]
    return (2 << int(rows[k - 1]["cls"])) - 1 if k else 0


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, shared, nu, nv of pairs (u, v), from the whole sets."""
    a = sets.select(F.col("sid").alias("u"), F.col("n").alias("nu"), F.col("tok").alias("tu"))
    b = sets.select(F.col("sid").alias("v"), F.col("n").alias("nv"), F.col("tok").alias("tv"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", F.size(F.array_intersect("tu", "tv")).alias("shared"), "nu", "nv")


def _links(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(_linked(F.col("shared"), F.col("nu"), F.col("nv"), percent)).select("u", "v")


class Sets:
    """The sets of a table, one for equal ones, and the lists on which they meet."""

    def __init__(self, docs: DataFrame, scratch: Scratch, percent: int, size: int):
        ship(docs.sparkSession)
        texts = scratch.save(shared_shingles(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), scratch, percent, size), "texts")
        scratch.drop("answers")
        scratch.free()
        self.members = texts.select("doc_id", "n", "key")
        self.reps = self.members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("sid"))
        need = F.expr(f"cast((n * {percent}L + 99) div 100 AS int)")
        one = texts.where("tok IS NOT NULL").select("key", "n", "tok", "df").dropDuplicates(["key"]).withColumn("t", F.size("tok"))
        one = one.withColumn("p", F.col("t") - need + 1).withColumn("pre", F.slice(F.array_sort(F.arrays_zip("df", "tok")), F.lit(1), F.col("p") + 1))
        # A list costs each of its sets a row, and comparisons that the order of step 4 keeps few however long it is.
        scan = F.aggregate(F.slice("pre", F.lit(1), F.col("p")), F.lit(0.0), lambda acc, x: acc + 1 + F.least(x["df"], F.lit(16)) / 2)
        self.sets = sets = scratch.save(one.join(self.reps, "key").select("sid", "n", "t", "p", F.col("pre.tok").alias("pre"), scan.alias("scan"), "tok"), "sets")

        most, base = boundary(sets), ["sid", "n", "t"]
        subsets = F.array_distinct(F.expr("flatten(transform(pre, (x, i) -> transform(slice(pre, i + 2, size(pre)), y -> xxhash64(x, y))))"))
        light = sets.where(F.col("n") <= most).select(*base, F.lit(True).alias("light"), F.lit(0).alias("kind"), F.explode(subsets).alias("list"))
        heavy = sets.where(F.col("n") * 100 >= percent * (most + 1)).select(*base, (F.col("n") <= most).alias("light"), F.lit(1).alias("kind"), F.explode(F.slice("pre", F.lit(1), F.col("p"))).alias("list"))
        posted = scratch.save(light.unionByName(heavy), "posted")
        central = F.min(F.struct(((F.col("n") - F.col("t")) / F.col("n")).alias("alone"), "sid", "n", "t", "light"))
        leads = scratch.save(posted.groupBy(*ON).agg(F.count("*").alias("members"), central.alias("lead")).where("members > 1").drop("members"), "leads")
        self.lists = scratch.save(posted.join(leads, ON), "lists")
        scratch.drop("posted", "leads")
        scratch.free()
        every = sets.where(F.col("n") <= most).select("sid", F.lit(0).alias("kind"), subsets.alias("every"))
        self.every = every.unionByName(sets.select("sid", F.lit(1).alias("kind"), F.slice("pre", F.lit(1), F.col("p")).alias("every")))

    @staticmethod
    def meet(a: Column | str = "a", b: Column | str = "b") -> Column:
        """Two light sets meet on lists of subsets, all others on lists of single shingles."""
        return (F.col(f"{a}.kind") == 0) | ~F.col(f"{a}.light") | ~F.col(f"{b}.light")


ON = ["kind", "list"]


def _blocks(rows: DataFrame, own: str, other: str) -> DataFrame:
    """rows (with `blocks` of their list) once for each block of the other side."""
    return rows.withColumn(own, F.pmod(F.xxhash64("sid"), F.col("blocks"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")


def _on_first_list(a: str = "a", b: str = "b") -> Column:
    """Of the lists that two sets share, this is the first, so each pair is made once."""
    return F.array_min(F.array_intersect(f"{a}.every", f"{b}.every")) == F.col(f"{a}.list")


def similar_sets(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    all_ = Sets(docs, scratch, percent, size)
    members, reps, sets, lists = all_.members, all_.reps, all_.sets, all_.lists
    base = ["sid", "n", "t"]

    central = lists.where("sid <> lead.sid").select(F.struct("kind", *base, "light").alias("a"), F.col("lead").alias("b")).where(all_.meet() & _possible("a", "b", percent))
    known = scratch.save(_overlaps(central.select(F.least("a.sid", "b.sid").alias("u"), F.greatest("a.sid", "b.sid").alias("v")).distinct(), sets), "known")
    first = _links(known, percent)
    comp = scratch.save(components(first, scratch, "star"), "merged")

    # Each step over lists is joined with one row a list from a written table, so Spark can split a long list.
    rest = scratch.save(lists.select(*ON, *base, "light", F.col("lead.sid").alias("lead")).join(comp.withColumnRenamed("id", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), "placed")
    apart = rest.groupBy(*ON, "comp").agg(F.count("*").alias("count"), F.min("n").alias("least_n")).groupBy(*ON).agg(F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("comps"), F.min("least_n").alias("least_n")).where("comps > 1").select(*ON, F.col("top.comp").alias("main"), "least_n")
    enough = lambda bound, sizes: bound * (100 + percent) >= percent * sizes
    partner = lambda least: F.col("n") + F.greatest(least, F.col("n") * percent / 100)
    # Sets that no size on their list lets have a partner go first; then those that no overlap there does.
    rest = rest.join(scratch.save(apart, "apart"), ON).where(enough(F.col("t"), partner(F.col("least_n")))).withColumns({"u": F.least("sid", "lead"), "v": F.greatest("sid", "lead")})
    rest = rest.join(known.select("u", "v", "shared"), ["u", "v"], "left")
    # i: overlap with the central set, where it's known; the central set's own is all of it.
    rest = scratch.save(rest.withColumn("i", F.when(F.col("sid") == F.col("lead"), F.col("t")).otherwise(F.col("shared"))).drop("u", "v", "shared", "lead"), "rest")
    per = scratch.save(rest.groupBy(*ON).agg(F.max(F.col("t") - F.coalesce("i", F.lit(0))).alias("most_else"), F.ceil(F.count("*") / BLOCK).alias("blocks")), "per")
    scratch.drop("placed", "apart")
    scratch.free()
    reach = F.coalesce(F.col("i") + F.least(F.col("t") - F.col("i"), F.col("most_else")), F.col("t"))
    rest = scratch.save(rest.join(per, ON).join(all_.every, ["sid", "kind"]), "ready")
    a, b = _blocks(rest.where("comp <> main").where(enough(reach, partner(F.col("least_n")))), "x", "y").alias("a"), _blocks(rest, "y", "x").alias("b")
    both = F.least("a.i", "b.i") + F.least(F.col("a.t") - F.col("a.i"), F.col("b.t") - F.col("b.i"))  # null if either is unknown
    once = ((F.col("b.comp") == F.col("b.main")) | (F.col("a.sid") < F.col("b.sid"))) & _on_first_list()
    possible = all_.meet() & _possible("a", "b", percent) & F.coalesce(enough(both, F.col("a.n") + F.col("b.n")), F.lit(True))
    cell = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.list") == F.col("b.list")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    across = a.join(b, cell & (F.col("a.comp") != F.col("b.comp")) & possible & once)
    across = across.select(F.least("a.sid", "b.sid").alias("u"), F.greatest("a.sid", "b.sid").alias("v")).distinct()
    second = scratch.save(_links(_overlaps(across, sets), percent), "second")
    scratch.drop("rest", "per", "ready", "lists")
    final = components(first.unionByName(second), scratch, "all")
    scratch.drop("known", "merged", "second", "sets")
    scratch.free()

    named = reps.join(final.withColumnRenamed("id", "sid"), "sid", "left").select("key", F.coalesce("comp", "sid").alias("component"))
    out = members.join(named, "key", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_pairs(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, set_id; links: u, v, shared, nu, nv with u < v) where set_id, the least doc_id of equal sets, names a set and links are all pairs of different sets at the threshold. Texts without words are in no set."""
    all_ = Sets(docs, scratch, percent, size)
    per = scratch.save(all_.lists.groupBy(*ON).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "per")
    rows = scratch.save(all_.lists.drop("lead").join(per, ON).join(all_.every, ["sid", "kind"]), "ready")
    a, b = _blocks(rows, "x", "y").alias("a"), _blocks(rows, "y", "x").alias("b")
    cell = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.list") == F.col("b.list")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    pairs = a.join(b, cell & (F.col("a.sid") < F.col("b.sid")) & all_.meet() & _possible("a", "b", percent) & _on_first_list())
    links = _overlaps(pairs.select(F.col("a.sid").alias("u"), F.col("b.sid").alias("v")).distinct(), all_.sets)
    members = all_.members.join(all_.reps.withColumnRenamed("sid", "set_id"), "key").select("doc_id", "set_id")
    return members, links.where(_linked(F.col("shared"), F.col("nu"), F.col("nv"), percent))


def op1_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"), Scratch(spark, "ngram_join"))
