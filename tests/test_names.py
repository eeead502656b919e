"""Name candidates and depths against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from epiframe.operators import graphs, joins


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def _score(a, b):
    if a == b:
        return 1.0
    s, t = set(a.split(" ")), set(b.split(" "))
    blend = 0.5 * (1 - _edits(a, b) / max(len(a), len(b))) + 0.5 * len(s & t) / len(s | t)
    return max(blend, 0.9 if (a.startswith(b) or b.startswith(a)) and min(len(a), len(b)) >= 5 else 0.0)


def _names(rng, n):
    """A third open with one word, many share a last word, and some differ by a letter."""
    out = set()
    while len(out) < n:
        words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.35:
            words.insert(0, "general")
        if rng.random() < 0.5:
            words.append("medical")
        name = " ".join(words)
        out.add(name)
        if rng.random() < 0.4:
            i = rng.randrange(len(name))
            out.add((name[:i] + rng.choice("abcx ") + name[i + rng.randrange(2):]).strip() or "a")
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.85, 0.92])
def test_no_pair_of_names_is_lost(spark, monkeypatch, threshold):
    monkeypatch.setattr(joins, "HOT_NAMES", 8)
    rng = random.Random(7)
    names = _names(rng, 260)
    left, right = names[::2] + names[:20], names[1::2] + names[:20]
    schema = "b string, name string"
    l = spark.createDataFrame([("x", v) for v in left] + [("y", left[0]), ("x", ""), ("x", None), (None, right[0])], schema)
    r = spark.createDataFrame([("x", v) for v in right] + [("z", left[0]), (None, right[0])], schema).withColumnRenamed("name", "other")
    got = joins.name_candidates(l, r, "b", "name", "other", threshold)
    found = {(x.b, x.l_name, x.r_name) for x in got.collect()}
    assert found >= {("x", p, q) for p in left for q in right if _score(p, q) >= threshold}
    assert {b for b, _, _ in found} == {"x"}
    scored = got.withColumn("s", joins.name_similarity(F.col("l_name"), F.col("r_name"))).collect()
    assert all(abs(x.s - _score(x.l_name, x.r_name)) < 1e-9 for x in scored)


def test_a_common_opening_is_not_all_with_all(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    hot = [f"general {word()} {word()}" for _ in range(700)]
    rest = [f"{word()} {word()}" for _ in range(1400)]
    l = spark.createDataFrame([("x", v) for v in hot + rest], "b string, name string")
    r = spark.createDataFrame([("x", v[:-1] + "?") for v in hot + rest], "b string, other string")
    found = {(x.l_name, x.r_name) for x in joins.name_candidates(l, r, "b", "name", "other", 0.7).collect()}
    assert {(v, v[:-1] + "?") for v in hot + rest} <= found
    assert len(found) < 30_000                                     # 490,000 pairs share the opening


def _depths(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
        up.setdefault(b, set())
    out = {}

    def of(x):
        if x not in out:
            out[x] = max((of(p) + 1 for p in up[x]), default=0)
        return out[x]
    return {x: of(x) for x in sorted(up)}


def test_depth_of_random_graphs(spark):
    rng = random.Random(5)
    for n, most in ((60, 1), (60, 3), (40, 6)):
        edges = [(a, rng.randrange(a)) for a in range(1, n) for _ in range(rng.randrange(most + 1))] or [(1, 0)]
        got = {r.node: r.depth for r in graphs.depth(spark.createDataFrame(edges + edges[:5], "src int, dst int")).collect()}
        assert got == _depths(edges)
    assert graphs.depth(spark.createDataFrame([], "src int, dst int")).collect() == []


def test_depth_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    longest = graphs._longest
    monkeypatch.setattr(graphs, "_longest", lambda ways: (rounds.append(1), longest(ways))[1])
    chain = [(i, i - 1) for i in range(1, 1501)] + [(1501, 1500), (1501, 3)]
    got = {r.node: r.depth for r in graphs.depth(spark.createDataFrame(chain, "src int, dst int")).collect()}
    assert got == {i: i for i in range(1502)}
    assert len(rounds) <= 13                                       # the first prepares, then twelve


@pytest.mark.parametrize("edges", [[(1, 2), (2, 1), (2, 0)], [(1, 2), (2, 3), (3, 1)], [(1, 1), (2, 0)], [(1, 2), (1, 3), (2, 1), (2, 4), (3, 4)]])
def test_a_cycle_is_an_error(spark, edges):
    with pytest.raises(ValueError):
        graphs.depth(spark.createDataFrame(edges, "src int, dst int"))
