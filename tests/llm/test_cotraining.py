"""Co-training against a version that keeps every text's features in memory."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelink.llm import cotrain

from .test_ops import prose


def rows_of(rng, n):
    out = []
    for i in range(n):
        good = i % 3 > 0
        words = [("good" if good else "BAD!!") + w if rng.random() < 0.3 else w for w in prose(rng, rng.randrange(20, 60)).split()]
        out.append((i, " ".join(words), "en" if rng.random() < (0.8 if good else 0.3) else "fr", f"s{rng.randrange(3) + (0 if good else 1)}"))
    return out


def slow(rows, labels, rounds):
    """Two naive Bayes views in plain Python."""

    def grams(t):
        b = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()
        return Counter(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 52 for i in range(len(b) - 2))

    import pyarrow as pa

    meta = cotrain.metadata(pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string()))
    text = [grams(r[1]) for r in rows]
    known = [i for i, r in enumerate(rows) if r[0] in labels]
    y = [labels[rows[i][0]] for i in known]
    held, fit = [k for k in range(len(known)) if k % 4 == 3], [k for k in range(len(known)) if k % 4 != 3]

    def ratio(view, groups):
        share = []
        for c in (0, 1):
            sums, size = np.zeros(cotrain.BUCKETS if view == 0 else cotrain.META), 0.0
            for members, weight in groups[c]:
                size += weight * len(members)
                for i in members:
                    if view == 0:
                        for k, n in text[i].items():
                            sums[k] += weight * n / sum(text[i].values())
                    else:
                        sums[meta[i]] += weight
            share.append((sums + (cotrain.SMOOTH if view == 0 else 0.01) * size) / size)
        return np.log(share[1] / share[0])

    def raw(view, w, i):
        return sum(n * w[k] for k, n in text[i].items()) / max(1, sum(text[i].values())) if view == 0 else w[meta[i]].sum()

    more = {v: {0: [], 1: []} for v in (0, 1)}
    for k in range(rounds + 1):
        odds = []
        for v in (0, 1):
            base = {c: [known[j] for j in fit if y[j] == c] for c in (0, 1)}
            w = ratio(v, {c: [(base[c], 1.0), (more[v][c], min(1.0, len(base[c]) / max(1, len(more[v][c]))))] for c in (0, 1)})
            s = np.array([raw(v, w, i) for i in range(len(rows))])
            a, b = cotrain.platt(s[[known[j] for j in held]], np.array([float(y[j]) for j in held]))
            odds.append(a * s + b)
        limit = math.log(cotrain.SURE / (1 - cotrain.SURE))
        free = [i for i in range(len(rows)) if i not in known]
        more = {v: {c: [i for i in free if (1 if c else -1) * odds[1 - v][i] > limit] for c in (0, 1)} for v in (0, 1)}
    return odds, more


def test_against_slow_version(spark):
    rng = random.Random(12)
    rows = rows_of(rng, 150)
    labels = {i: int(i % 3 > 0) for i in range(0, 150, 3)} | {i: int(i % 3 > 0) for i in range(1, 60, 4)}
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).selectExpr("*", "1 AS y", "2 AS slot", "3 AS n")
    got = {r.doc_id: r for r in cotrain.score(d, cotrain.fit(d, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), rounds=2)).collect()}
    (t, m), more = slow(rows, labels, 2)
    assert sum(len(x) for v in more.values() for x in v.values()) > 20
    for i, _ in enumerate(rows):
        assert got[i].p_text == pytest.approx(1 / (1 + math.exp(-t[i])), abs=2e-3) and got[i].p_meta == pytest.approx(1 / (1 + math.exp(-m[i])), abs=2e-3)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [*rows_of(rng, 60), (7, "repeated id", "en", "s0"), (None, "no id", None, None), (None, None, None, None), (900, "", "en", "s1"), (901, "z " * 200_000, "en", "s1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(3, 1), (None, 1), (50, None)], "doc_id long, quality int")
    got = cotrain.score(d, cotrain.fit(d, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.p_quality <= 1 and r.keep == (r.p_quality >= 0.5) for r in got)
    same = cotrain.score(d, cotrain.fit(d.repartition(7), labels)).collect()
    assert sorted(map(str, got)) == sorted(map(str, same))
    one = cotrain.score(d, cotrain.fit(d, labels.where("quality = 1"))).collect()
    assert {round(r.p_quality, 2) for r in one} == {1.0}


def test_held_out_area_under_curve(spark):
    """Labels that fitting didn't see are ranked."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    got = cotrain.score(docs, cotrain.fit(docs, labels.where(seen))).join(labels.where(~seen), "doc_id").select("p_quality", "p_text", "p_meta", "quality").toPandas()
    rank = got.rank()
    n1 = int((got.quality == 1).sum())
    n0 = len(got) - n1
    auc = {c: (rank[c][got.quality == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) for c in ("p_text", "p_meta", "p_quality")}
    assert n0 > 10 and auc["p_quality"] > 0.95 and min(auc.values()) > 0.75, auc
