"""Row bootstraps, limits, inflation, matched triage, truncated SVD and identifier hits against numpy, plain Python and closed forms."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.catalog import QUERIES
from epiframe.functions import draws
from epiframe.operators import evaluation as E
from epiframe.operators import models as M
from epiframe.operators import splits as P
from epiframe.operators import text as X

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("mean", [0.0, 0.4, 1.0, 7.5, 30.0, 31.0, 900.0])
def test_poisson_draws(mean):
    keys = np.arange(400) * 7919
    got = draws.poisson(keys, np.full(400, mean), 100, 3)
    assert abs(got.mean() - mean) <= 5 * math.sqrt(max(mean, 1e-9) / got.size) + (0.02 if mean > 30 else 0) and abs(got.var() - mean) <= 0.06 * mean + 1e-9
    assert (got == np.rint(got)).all() and (got >= 0).all()
    # a key's draws do not depend on its neighbours
    assert (draws.poisson(keys[::-1], np.full(400, mean), 100, 3)[::-1] == got).all() and (mean == 0 or (draws.poisson(keys, np.full(400, mean), 100, 4) != got).any())


def scored(spark, n=600, seed=2):
    rng = random.Random(seed)
    rows = [(i, y := int(rng.random() < 0.4), round(rng.gauss(0.4 + 0.25 * y, 0.2), 2), int(rng.random() < 0.25 + 0.4 * y), "abc"[i % 3]) for i in range(n)]
    rows += [(n, None, 0.5, 1, "a"), (n + 1, 1, None, 0, "b"), (n + 2, 1, 0.5, None, "c")]
    return spark.createDataFrame(rows, "id long, y int, s double, rater int, g string").repartition(4), rows


def bounds(cells, sens, spec):
    cells = sorted(cells, reverse=True)
    p, n = sum(c[1] for c in cells), sum(c[2] for c in cells)
    tp = fp = 0
    lo, hi = [], []
    for s, a, b in cells:
        tp, fp = tp + a, fp + b
        if tp >= (sens - 1e-12) * p:
            lo.append(s)
        if n - fp >= (spec - 1e-12) * n:
            hi.append(s)
    low, high = max(lo) if lo else cells[-1][0], min(hi) if hi else cells[0][0]
    return min(low, high), max(low, high)


def test_gray_zone_limits_are_those_of_the_same_weights(spark):
    df, _ = scored(spark)
    reps = {}
    for r in E.replicate_counts(E.score_counts(df, "y", "s"), 120, 5).collect():
        reps.setdefault(r.rep, []).append((r.s, r.pos, r.neg))
    per = np.array([bounds(c, 0.9, 0.85) for c in reps.values()])
    want = np.quantile(per, [0.025, 0.975], axis=0)
    got = E.gray_zone_limits(df, "y", "s", 0.9, 0.85, 120, 5).first()
    assert got.replicates == 120 and np.allclose([got.lo_low, got.lo_high, got.hi_low, got.hi_high], [want[0, 0], want[1, 0], want[0, 1], want[1, 1]])
    point = E.gray_zone(df, "y", "s", 0.9, 0.85).first()
    assert (got.lo, got.hi) == (point.lo, point.hi) and got.lo_low <= got.lo <= got.lo_high and got.hi_low <= got.hi <= got.hi_high
    # sizes of replicates are those of a bootstrap
    sizes = [sum(a + b for _, a, b in c) for c in reps.values()]
    assert abs(np.mean(sizes) - 602) < 10 and 15 < np.std(sizes) < 35
    alone = E.gray_zone_limits(df.filter("y = 1"), "y", "s", n=20).collect()
    assert alone == []


def test_matched_triage(spark):
    df, rows = scored(spark)
    whole = [r for r in rows if None not in r]

    def brute(rows):
        negatives = sorted((r[2] for r in rows if r[1] == 0), reverse=True)
        k = sum(r[3] for r in rows if r[1] == 0)
        cut = 1.0 if not negatives else negatives[k - 1] if k else negatives[0] + 1e-9
        out = []
        for g in sorted({r[4] for r in rows if r[1] == 1}):
            own = [r for r in rows if r[1] == 1 and r[4] == g]
            out.append((g, len(own), cut, sum(1 - r[3] for r in own) / len(own), sum(r[2] < cut for r in own) / len(own)))
        return out
    for frame, told in ((df, whole), (df.withColumn("rater", F.col("y")), [(*r[:3], r[1], r[4]) for r in rows if r[1] is not None and r[2] is not None]), (df.filter("y = 1"), [r for r in whole if r[1] == 1])):
        got = sorted(tuple(r) for r in E.matched_triage(frame, "y", "s", "rater", "g").collect())
        assert len(got) == 3 and all(a[:2] == b[:2] and np.allclose(a[2:], b[2:]) for a, b in zip(got, brute(told), strict=True))
    assert E.matched_triage(df.filter("false"), "y", "s", "rater", "g").collect() == []


def test_leakage_inflation(spark):
    a, b = [0.91, 0.95, 0.9, 0.97, 0.92, 0.99, 0.93, 0.94], [0.7, 0.8, 0.75, 0.6, 0.72, 0.79]
    df = spark.createDataFrame([(i, True, v) for i, v in enumerate(a)] + [(i, False, v) for i, v in enumerate(b)] + [(9, True, None)], "fold int, leaky boolean, auc double")
    got = P.leakage_inflation(df, ["fold"], "auc", "leaky", 2000, 1).first()
    assert abs(got.absolute - (np.mean(a) - np.mean(b))) < 1e-12 and abs(got.relative - (np.mean(a) - np.mean(b)) / np.mean(b)) < 1e-12
    rng = np.random.default_rng(1)
    boots = [rng.choice(a, len(a)).mean() - rng.choice(b, len(b)).mean() for _ in range(4000)]
    assert np.allclose([got.low, got.high], np.percentile(boots, [2.5, 97.5]), atol=0.02)
    same = P.leakage_inflation(df.withColumn("auc", F.lit(0.5)), ["fold"], "auc", "leaky", 50, 1).first()
    assert abs(same.absolute) < 1e-12 and abs(same.low) < 1e-12 and abs(same.high) < 1e-12


def test_mediation_draws_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, 500).astype(float)
    m = np.round(0.8 * x + rng.normal(size=500), 1)
    y = np.round(0.5 * m + 0.3 * x + rng.normal(size=500), 1)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, m, y)], "x double, m double, y double").repartition(5)
    got = M.mediation(df, "x", "m", "y", n_boot=400, seed=2).first()
    fit = lambda t, *cols: np.linalg.lstsq(np.column_stack([np.ones(len(t)), *cols]), t, rcond=None)[0]
    effect = lambda i: fit(m[i], x[i])[1] * fit(y[i], x[i], m[i])[2]
    every = np.arange(500)
    assert abs(got.indirect - effect(every)) < 1e-9 and abs(got.direct - fit(y, x, m)[1]) < 1e-9 and abs(got.total - fit(y, x)[1]) < 1e-9
    boots = [effect(rng.integers(0, 500, 500)) for _ in range(1500)]
    assert np.allclose([got.indirect_lo, got.indirect_hi], np.percentile(boots, [2.5, 97.5]), atol=0.04)
    again = M.mediation(df.repartition(3), "x", "m", "y", n_boot=400, seed=2).first()
    assert abs(again.indirect_lo - got.indirect_lo) < 1e-9
    # a row that stands many times is drawn as many rows
    sums = M.replicate_moments(spark.createDataFrame([(1.0, 2.0)] * 300 + [(0.0, 1.0)] * 20, "a double, b double"), [F.lit(1.0), F.col("a"), F.col("b")], 200, 1).collect()
    sizes = [r.m[0] for r in sums if r.rep]
    assert len(sums) == 201 and [r.m[0] for r in sums if r.rep == 0] == [320.0] and 14 < np.std(sizes) < 22


@pytest.mark.parametrize("shape,k", [((80, 40), 5), ((30, 60), 8), ((6, 4), 10)])
def test_truncated_svd(spark, shape, k):
    rng = np.random.default_rng(shape[0])
    dense = rng.normal(size=shape) * (rng.random(shape) < 0.3) + np.outer(rng.normal(size=shape[0]), rng.normal(size=shape[1])) * (rng.random(shape) < 0.4)
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(dense)]
    df = spark.createDataFrame(rows, "id int, ix array<int>, v array<double>").repartition(4)
    scores, values, converged = M.truncated_svd(df, shape[1], k)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    k = min(k, shape[1])
    got = np.array([r.scores for r in scores.orderBy("id").collect()])
    assert converged and np.allclose(values, np.concatenate([s, np.zeros(k)])[:k], atol=1e-4 * s[0])
    assert got.shape == (shape[0], k)
    want = u[:, :k] * s[:k]
    keep = min(k, len(s))
    # the same subspace, component by component up to the sign that the largest loading fixes
    assert all(min(np.abs(got[:, j] - want[:, j]).max(), np.abs(got[:, j] + want[:, j]).max()) < 0.02 * s[0] for j in range(keep))


def test_text_components(spark):
    texts = [(1, "alpha beta beta gamma"), (2, "alpha gamma delta"), (3, "delta delta alpha"), (4, ""), (5, None), (6, "never seen words"), (7, "beta gamma gamma delta")]
    df = spark.createDataFrame(texts, "id int, t string")
    scores, values, converged = M.text_components(df, "id", "t", 2, min_df=2, n=1)
    got = {r.id: r.scores for r in scores.collect()}
    assert converged and len(got) == 7 and got[4] == got[5] == got[6] == [0.0, 0.0] and any(got[1])
    few, size = M.tfidf_rows(df, "id", "t", F.lit(True), 2, 1, 2)
    assert size == 2 and all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in few.collect())
    none, values, converged = M.text_components(df.filter("id > 3 AND id < 6"), "id", "t", 2)
    assert converged and len(values) == 0 and [r.scores for r in none.collect()] == [[], []]


def test_identifier_hits_of_patterns_that_look_behind(spark):
    got = {r.doc_id: r for r in QUERIES["txt01_document_hits_looking"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    names = [c for c in next(iter(got.values())).asDict() if c != "doc_id"]
    assert len(names) == 5 and len(rows) == len(got)
    for r in rows:
        for c in names:
            assert got[r.doc_id][c] == len(re.findall(f"(?:{X.IDENTIFIERS[c]})", r.text, re.ASCII)), (c, r.doc_id)
