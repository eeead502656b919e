"""Blocks against blocks: what a task holds, and results against brute force."""

import numpy as np

from epiframe.operators import evaluation, spatial
from epiframe.plans import blocks


def test_tasks_hold_few_pairs_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_ROWS", 16)
    df = spark.range(960).selectExpr("id", "CAST(id AS DOUBLE) AS x")
    from pyspark.sql import functions as F
    held, n = blocks.packed(df, 960, F.xxhash64("id"), rows=F.col("x"))
    pairs = blocks.met(held.withColumnRenamed("rows", "ra"), n, held.withColumnRenamed("rows", "rb"), n, upper=True)
    sizes = [r["n"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n * (n + 1) // 2 and max(sizes) <= 5 * blocks.PAIRS_A_TASK


def test_distance_statistics_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_ROWS", 32)
    x = np.random.RandomState(3).randn(200, 4)
    x[20:30] = x[5]                       # coincident points
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x double, y double, z double, v double")
    i, j = np.triu_indices(200, 1)
    d = np.sqrt(((x[i, :3] - x[j, :3]) ** 2).sum(1))
    g = 0.5 * (x[i, 3] - x[j, 3]) ** 2
    edge = d.max() * 0.5
    on = d < edge
    ix = np.minimum((d[on] / edge * 10).astype(int), 9)
    for r in spatial.variogram(df, "v", ["x", "y", "z"]).collect():
        assert r.n == (ix == r.bin).sum() and np.isclose(r.mean_distance, d[on][ix == r.bin].mean()) and np.isclose(r.gamma, g[on][ix == r.bin].mean())
    w = np.divide(1, d, out=np.zeros_like(d), where=d > 0)
    z = x[:, 3] - x[:, 3].mean()
    assert np.isclose(spatial.morans_i_distance(df, "v", ["x", "y", "z"]).first().moran_i, 200 / w.sum() * (w * z[i] * z[j]).sum() / (z ** 2).sum())


def test_only_the_rim_is_searched_for_the_largest_distance(spark):
    x = np.random.RandomState(5).randn(400, 2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x double, y double")
    rim = np.array([list(r) for r in spatial._rim(df, ["x", "y"], ["x", "y"]).collect()])
    widest = lambda p: np.sqrt(((p[:, None] - p) ** 2).sum(-1)).max()
    assert len(rim) < 100 and widest(rim) == widest(x)


def test_nearest_of_copies_is_the_smallest_id(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_ROWS", 32)
    x = np.random.RandomState(4).randn(150, 5).astype(np.float32)
    x[100:150] = x[0:50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    far = [(i, [float("nan")] * 5) for i in (900,)]
    train = spark.createDataFrame(list(reversed(rows)) + far, "i int, v array<float>")
    asked = spark.createDataFrame([(1000 + i, v) for i, v in rows], "i int, v array<float>")
    got = {r.i: (r.nearest, r.distance) for r in evaluation.closest_record(train, asked, "i", "v", 5).collect()}
    assert got == {1000 + i: (i if i < 100 else i - 100, 0.0) for i in range(150)}


def test_neighbours_with_copies_clusters_and_ties(spark, monkeypatch):
    rng = np.random.RandomState(6)
    x = np.vstack([rng.randn(60, 2) * 0.001, rng.randint(0, 6, (80, 2)), np.full((30, 2), 2.0), [[500.0, 500.0]]])
    df = spark.createDataFrame([(f"r{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(x)] + [("null", None, 1.0)], "i string, x double, y double")
    got = {}
    made = spatial.nearest_neighbours(df, "i", ["x", "y"], 4, 100.0)
    for r in made.collect():
        got.setdefault(r.i, []).append((r.d, r.j))
    for i in range(len(x)):
        d = np.sqrt((x[i, 0] - x[:, 0]) ** 2 + (x[i, 1] - x[:, 1]) ** 2)
        want = sorted((float(v), f"r{j:03d}") for j, v in enumerate(d) if j != i)[:4]
        assert sorted(got[f"r{i:03d}"]) == want
    assert "null" not in got


def test_no_row_pairs_are_shuffled_for_neighbours(spark, monkeypatch):
    """The width follows the data, so a cell that holds all points makes no pairs of them."""
    asked = []
    real = spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: asked.append(real(df)) or asked[-1])
    x = np.random.RandomState(8).rand(3000, 2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, x double, y double")
    assert spatial.nearest_neighbours(df, "i", ["x", "y"], 3, 50.0).count() == 9000
    assert not any({"i", "j"} <= set(d.columns) for d in asked) and max(d.count() for d in asked) == 3000
