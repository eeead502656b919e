"""Permutation nulls against their exact moments and against shuffles."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from epiframe.operators import evaluation, permutations, spatial, summaries


def table(spark, seed=1):
    """Two strata, a value that holds a third of all rows, continuous values, null values."""
    rng = random.Random(seed)
    rows = [(i, int(rng.random() < (0.3 if i % 3 else 0.6)), 5.0 if rng.random() < 0.33 else round(rng.gauss(3, 2), 3), "ab"[i % 2]) for i in range(240)]
    rows += [(1000 + i, i % 2, None, "a") for i in range(10)]
    return spark.createDataFrame(rows, "id long, y int, v double, g string").repartition(4), rows


@pytest.mark.parametrize("limit", [permutations.SLICE_CELLS, 15])
@pytest.mark.parametrize("strata", [[], ["g"]])
def test_null_has_the_exact_mean_and_variance(spark, limit, strata):
    df, rows = table(spark)
    got = permutations.permuted_means(df, strata, "y", "v", 3000, 4, limit).collect()
    assert len(got) == 3001
    own = next(r for r in got if r.rep == 0)
    assert abs(own["sum"] - sum(r[2] for r in rows if r[1] and r[2] is not None)) < 1e-6 and own["count"] == sum(1 for r in rows if r[1] and r[2] is not None)
    mean = var = 0.0
    for g in ("ab" if strata else ["ab"]):
        part = np.array([r[2] or 0.0 for r in rows if r[3] in g])
        n, k = len(part), sum(r[1] for r in rows if r[3] in g)
        mean += k * part.mean()
        var += k * (n - k) / (n - 1) * part.var()
    null = np.array([r["sum"] for r in got if r.rep])
    assert abs(null.mean() - mean) < 5 * math.sqrt(var / 3000) and abs(null.var() / var - 1) < 0.15
    again = permutations.permuted_means(df.repartition(7), strata, "y", "v", 20, 4, limit).collect()
    same = {r.rep: round(r["sum"], 6) for r in got if r.rep <= 20}
    assert {r.rep: round(r["sum"], 6) for r in again} == same


def test_draws_are_without_replacement():
    rng = np.random.default_rng(2)
    for counts, k in ((np.array([3, 0, 5, 1]), 4), (np.ones(10, int), 10), (np.array([0, 0]), 0), (np.array([2, 2]), 9)):
        got = [permutations.dealt(rng, counts, k) for _ in range(200)]
        assert all((x <= counts).all() and (x >= 0).all() and x.sum() == min(k, counts.sum()) for x in got)
    big = np.array([2_000_000_000, 1_000_000_000, 1])
    got = np.array([permutations.dealt(rng, big, 1_500_000_000) for _ in range(300)])
    assert (got.sum(axis=1) == 1_500_000_000).all() and abs(got[:, 0].mean() / 1e9 - 1) < 1e-5
    assert abs(got[:, 0].std() / math.sqrt(1.5e9 * (2 / 3) * (1 / 3) * 0.5) - 1) < 0.2


def test_permutation_p_of_planted_and_null(spark):
    df, rows = table(spark)
    got = evaluation.permutation_test(df, "id", "y", "v", ["g"], 499, 3).first()
    a, b = ([r[2] for r in rows if r[1] == k and r[2] is not None] for k in (1, 0))
    assert abs(got.observed - (np.mean(a) - np.mean(b))) < 1e-9 and got.n == 499
    rng = np.random.default_rng(5)
    known = [r for r in rows]
    hits = 0
    for _ in range(2000):
        s = c = 0.0
        for g in "ab":
            part = [r for r in known if r[3] == g]
            k = sum(r[1] for r in part)
            for i in rng.choice(len(part), k, replace=False):
                if part[i][2] is not None:
                    s, c = s + part[i][2], c + 1
        total, count = sum(a) + sum(b), len(a) + len(b)
        hits += abs(s / c - (total - s) / (count - c)) >= abs(got.observed) - 1e-12
    assert abs(got.p - hits / 2000) < 0.08
    planted = spark.createDataFrame([(i, int(i < 40), float(i < 40) + i % 5 / 10) for i in range(100)], "id long, y int, v double")
    assert evaluation.permutation_test(planted, "id", "y", "v", [], 199).first().p == 1 / 200


def test_matched_set_enrichment(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(i % 4, 1), i % 4, i % 4 == 3 and rng.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, score double, size int, inside boolean")
    got = spatial.matched_set_enrichment(df, "id", "score", "inside", "size", 4, 800, 2).first()
    inside, pool = [r[1] for r in rows if r[3]], [r[1] for r in rows if r[2] == 3]
    k, n = len(inside), len(pool)
    sd = math.sqrt(np.var(pool) / k * (n - k) / (n - 1))
    assert got.set_size == k and abs(got.observed - np.mean(inside)) < 1e-9 and abs(got.null_mean - np.mean(pool)) < 5 * sd / math.sqrt(800)
    assert abs(got.z - (np.mean(inside) - np.mean(pool)) / sd) < 0.15 * max(1, abs(got.z)) and 0 < got.p <= 1


def test_profile_permutation(spark):
    rng = random.Random(6)
    rows = []
    for r in range(120):
        g = "x" if r % 3 else "y"
        rows += [(r, g, rng.choice("aabc" if g == "x" else "abbcd")) for _ in range(rng.randrange(1, 4))]
    rows += [(900 + r, "z", "a") for r in range(20)]
    df = spark.createDataFrame(rows, "r long, g string, i string")
    got = summaries.profile_permutation(df, "r", "g", "x", "y", "i", 3, 300, 4).first()
    plain = summaries.profile_divergence(df, "g", "x", "y", "i", 3).first()
    assert abs(got.divergence - plain.divergence) < 1e-9
    own = [x for x in rows if x[1] in "xy"]
    top = [i for i, _ in sorted(Counter(x[2] for x in own).items(), key=lambda c: (-c[1], c[0]))[:3]]
    names = sorted({x[0] for x in own})
    na = len({x[0] for x in own if x[1] == "x"})

    def js(chosen):
        p = np.array([sum(x[0] in chosen and x[2] == i for x in own) for i in top], float)
        q = np.array([sum(x[0] not in chosen and x[2] == i for x in own) for i in top], float)
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        return 0.5 * sum(a * math.log2(a / c) for a, c in zip(p, m) if a) + 0.5 * sum(a * math.log2(a / c) for a, c in zip(q, m) if a)
    assert abs(js({x[0] for x in own if x[1] == "x"}) - got.divergence) < 1e-9
    share = np.mean([js(set(rng.sample(names, na))) >= got.divergence - 1e-12 for _ in range(1000)])
    assert abs(got.p - share) < 0.08
