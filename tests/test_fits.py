"""Fits say whether they converged; criteria of a cohort are counted in one pass."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.operators import cohorts, evaluation, models
from epiframe.plans.fits import NotConverged


def test_a_separated_model_is_reported(spark):
    df = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, y int")
    with pytest.warns(NotConverged):
        models.glm_fit(df, F.col("y"), [F.lit(1.0), F.col("x")], steps=4)


def test_a_converged_model_is_quiet_and_right(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.4 + 0.9 * x)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, y int")
    with warnings.catch_warnings():
        warnings.simplefilter("error", NotConverged)
        beta, _, n = models.glm_fit(df, F.col("y"), [F.lit(1.0), F.col("x")])
        evaluation.calibration(df.withColumn("p", 1 / (1 + F.exp(-F.col("x")))), "y", "p").collect()
    want = np.zeros(2)
    design = np.column_stack([np.ones(300), x])
    for _ in range(30):
        mu = 1 / (1 + np.exp(-design @ want))
        want += np.linalg.solve((design * (mu * (1 - mu))[:, None]).T @ design, design.T @ (y - mu))
    assert n == 300 and np.allclose(beta, want, atol=1e-7)


def test_criteria_follow_each_other(spark):
    """The first stay is the first of those that passed before it, and each table is asked once."""
    stays = spark.createDataFrame([(1, 10, 100, 0, 50, 17, "A", None), (1, 11, 101, 60, 200, 40, "A", None), (1, 12, 102, 300, 400, 41, "A", None), (2, 13, 103, 0, 90, 50, "B", 95),
                                   (3, 14, 104, 0, 90, 60, "A", None), (4, None, 105, 0, 90, 70, "A", None)], "subject int, visit int, stay int, start int, end int, age int, unit string, death int")
    stays = stays.selectExpr("subject", "visit", "stay", "timestamp_seconds(start * 3600) start", "timestamp_seconds(end * 3600) end", "age", "unit", "timestamp_seconds(death * 3600) death")
    codes = spark.createDataFrame([(11, "I10"), (11, "I11"), (12, "I10"), (13, "I10"), (14, "C50"), (None, "I10")], "visit int, code string")
    labs = spark.createDataFrame([(101, "na", 61), (101, "na", 62), (102, "na", 301)], "stay int, item string, at int").selectExpr("stay", "item", "timestamp_seconds(at * 3600) at")
    spec = {"unit": "stay", "criteria": [{"kind": "age", "min": 18}, {"kind": "first_stay"}, {"kind": "code_out", "prefixes": ["C"]}, {"kind": "code_in", "prefixes": ["I1"]}, {"kind": "unit", "values": ["A"]},
                                         {"kind": "measured", "item": "na", "to_hours": 24}, {"kind": "survived", "hours": 24}]}
    cohort, counts = cohorts.cohort_from_spec(spec, {"stays": stays, "codes": codes, "labs": labs})
    got = cohort.collect()
    assert [(r.stay, r.outcome) for r in got] == [(101, 0)] and "_at" not in cohort.columns
    assert [(r.step, r.criterion, r.n) for r in sorted(counts.collect())] == [(0, "start", 6), (1, "age", 5), (2, "first_stay", 4), (3, "code_out", 3), (4, "code_in", 2), (5, "unit", 1), (6, "measured", 1), (7, "survived", 1)]
    none, zero = cohorts.cohort_from_spec(spec, {"stays": stays.filter("false"), "codes": codes, "labs": labs})
    assert none.collect() == [] and {r.n for r in zero.collect()} == {0}


def test_rows_of_a_cutoff_are_not_gathered(spark):
    rng = np.random.RandomState(2)
    x = rng.rand(500) * 20
    df = spark.createDataFrame([(float(a), float(3 + 0.5 * a + 2 * (a >= 10) + e)) for a, e in zip(x, rng.randn(500) * 0.1)], "x double, y double")
    d = models.local_linear_rd(df, "y", "x", [10.0, 5.0], 5.0)
    got = {r.cutoff: r.estimate for r in d.collect()}
    assert abs(got[10.0] - 2) < 0.1 and abs(got[5.0]) < 0.1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in models.local_linear_rd(df, "y", "x", [10.0, 5.0], 5.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
