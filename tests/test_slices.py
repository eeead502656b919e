"""Adjusted p values and hash ranks against brute force, with ties, null groups and many slices."""

import random

import pytest

from epiframe.operators import splits, summaries


def _adjusted(ps, method):
    n, out = len(ps), {}
    order = sorted(range(n), key=lambda i: ps[i])
    if method == "bh":
        low = 1.0
        for rank in range(n, 0, -1):
            low = min(low, ps[order[rank - 1]] * n / rank)
            out[order[rank - 1]] = low
    else:
        high = 0.0
        for rank in range(1, n + 1):
            high = max(high, ps[order[rank - 1]] * (n - rank + 1))
            out[order[rank - 1]] = min(high, 1.0)
    return [out[i] for i in range(n)]


@pytest.mark.parametrize("method", ["bh", "holm"])
def test_adjusted_p_values(spark, method):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1.0, 0.5, round(rng.random() ** 6, 5), None, 0.0])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g string, p double")
    got = {r.id: r for r in summaries.adjust_pvalues(df, "p", ["id"], ["g"], method).collect()}
    assert len(got) == 600 and all(got[i].p_adjusted is None for i, _, p in rows if p is None)
    for g in ("a", "b", None):
        own = [(i, p) for i, k, p in rows if k == g and p is not None]
        for (i, _), want in zip(own, _adjusted([p for _, p in own], method), strict=True):
            assert got[i].p_adjusted == pytest.approx(want, abs=1e-12) and got[i].g == g
    whole = {r.id: r.p_adjusted for r in summaries.adjust_pvalues(df.drop("g"), "p", ["id"], (), method).collect()}
    own = [(i, p) for i, _, p in rows if p is not None]
    assert [whole[i] for i, _ in own] == pytest.approx(_adjusted([p for _, p in own], method), abs=1e-12)
    assert summaries.adjust_pvalues(df.filter("false"), "p", ["id"], ["g"], method).collect() == []


def test_splits_do_not_depend_on_the_slices(spark, monkeypatch):
    df = spark.createDataFrame([(i % 97, i) for i in range(500)], "g int, r int")
    one = {(r.r, r.split) for r in splits.group_split(df, "g", {"train": 0.6, "val": 0.2, "test": 0.2}, 3).collect()}
    monkeypatch.setattr(splits, "SLICE_ROWS", 5)
    many = {(r.r, r.split) for r in splits.group_split(df, "g", {"train": 0.6, "val": 0.2, "test": 0.2}, 3).collect()}
    assert one == many and len({r % 97 for r, s in many if s == "train"}) == 58
    assert splits.group_split(df.filter("false"), "g", {"train": 0.5, "test": 0.5}).collect() == []
