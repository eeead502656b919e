"""k-means of sparse rows: the rounds of Spark's own from the same start, whatever the parts, and no centre as wide as the vocabulary."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.operators import kmeans as K
from epiframe.operators import models as M


def sparse(spark, n=120, width=40, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ix = sorted(rng.sample(range((i % 5) * 6, (i % 5) * 6 + 16), rng.randrange(2, 9)))
        v = np.array([rng.random() + 0.1 for _ in ix])
        rows.append((f"r{i:03}", ix, (v / np.sqrt((v * v).sum())).tolist()))
    return rows, spark.createDataFrame(rows, "id string, ix array<int>, v array<double>"), width


@pytest.mark.parametrize("parts,apart", [(1, False), (4, True)])
def test_rounds_are_those_of_mllib_from_the_same_start(spark, monkeypatch, parts, apart):
    from pyspark.mllib.clustering import KMeans, KMeansModel
    from pyspark.mllib.linalg import SparseVector
    rows, df, width = sparse(spark)
    first = np.random.default_rng(1).random((width, 4)) / 8
    if apart:
        first[:, 2] = 9.0                                      # no row is nearest to it: it stays
    monkeypatch.setattr(K, "_start", lambda *a: (np.arange(width), first))
    got = {r.id: r.cluster for r in K.sparse_kmeans(df, "id", 4, parts).collect()}
    x = [SparseVector(width, ix, v) for _, ix, v in rows]
    model = KMeans.train(spark.sparkContext.parallelize(x, 3), 4, 20, epsilon=1e-4, initialModel=KMeansModel(list(first.T)))
    assert got == {r[0]: model.predict(v) for r, v in zip(rows, x, strict=True)}
    assert len(set(got.values())) == (3 if apart else 4)


def test_start_finds_separate_groups_and_does_not_depend_on_the_parts(spark):
    df = spark.range(60).select("id", F.array(*[(F.col("id") % 3 * 10 + j).cast("int") for j in range(3)]).alias("ix"), F.array(F.lit(0.6), F.lit(0.6), F.rand(1) / 50 + 0.5).alias("v"))
    df = spark.createDataFrame(df.collect(), df.schema)
    one, more = ({r.id: r.cluster for r in K.sparse_kmeans(df.repartition(n), "id", 3, n, seed=2).collect()} for n in (1, 5))
    assert one == more and len(one) == 60 and len({(i % 3, c) for i, c in one.items()}) == 3 == len(set(one.values()))
    assert {r.cluster for r in K.sparse_kmeans(df.limit(2).select("id", "ix", F.array(F.lit(0.1), F.lit(0.1), F.lit(0.1)).alias("v")), "id", 4, 2).collect()} <= {0, 1}
    assert K.sparse_kmeans(df.filter("false"), "id", 3, 2).collect() == []


def test_text_clusters_hold_no_centre_over_the_vocabulary(spark, monkeypatch):
    """Term numbers up to 2 thousand million: a dense centre would be 16 GB."""
    texts = [(i, " ".join(random.Random(i).sample("red green blue grey".split() if i % 2 else "one two three four".split(), 3))) for i in range(40)] + [(90, None), (91, "never seen")]
    df = spark.createDataFrame(texts, "id int, t string")
    plain = {r.id: r.cluster for r in M.text_clusters(df, "id", "t", 2, 1).collect()}
    weights = M.tfidf_rows

    def wide(*a, **b):
        rows, size = weights(*a, **b)
        step = 2_000_000_000 // size
        return rows.withColumn("ix", F.transform("ix", lambda i: i * step)), step * size
    monkeypatch.setattr(M, "tfidf_rows", wide)
    assert plain.keys() == set(range(40)) and {r.id: r.cluster for r in M.text_clusters(df, "id", "t", 2, 1).collect()} == plain
