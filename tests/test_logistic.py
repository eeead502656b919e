"""Logistic regressions of terms: the best coefficients, found without any of them on the driver."""

import math

import numpy as np
from pyspark.sql import functions as F

from epiframe.operators import logistic
from epiframe.operators import models as M

WORDS = ["red", "dog", "fox", "blue", "cat", "sun", "sky", "sea"]


def texts():
    rng = np.random.default_rng(3)
    out = []
    for i in range(90):
        some = rng.choice(WORDS, 5)
        lean = (some == "red").sum() + (some == "sea").sum() - 1 + rng.normal() / 2
        out.append((i, " ".join(some) if i != 7 else "?", None if i % 11 == 0 else int(lean > 0), int("dog" in some), i % 4 != 0))
    return out


def best(x, y, fit, reg):
    """Probabilities of the fit that spark.ml's objective asks for, by Newton steps on a dense matrix."""
    use = fit & ~np.isnan(y)
    n, pos = fit.sum(), y[use].sum()
    w = np.where(y[use] == 1, n / (2 * pos), n / (2 * (n - pos)))
    w /= w.sum()
    mean = w @ x[use]
    sd = np.sqrt(w @ (x[use] - mean) ** 2 / (1 - (w * w).sum()))
    z = np.column_stack([np.divide(x, sd, out=np.zeros_like(x), where=sd > 0), np.ones(len(x))])
    b, penalty = np.zeros(z.shape[1]), np.diag([reg] * x.shape[1] + [0.0])
    loss = lambda b: w @ np.logaddexp(0, np.where(y[use] == 1, -(z[use] @ b), z[use] @ b)) + b @ penalty @ b / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z[use] @ b)))
        d = np.linalg.solve((z[use].T * (w * p * (1 - p))) @ z[use] + penalty, z[use].T @ (w * (p - y[use])) + penalty @ b)
        step = next((s for s in (1, .5, .1, .01) if loss(b - s * d) < loss(b)), 0)
        b = b - step * d
    return 1 / (1 + np.exp(-(z @ b)))


def test_text_classifier_finds_the_best_fit_with_its_coefficients_dealt_out(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    def one_place(*_):
        raise AssertionError("all coefficients went to the driver")
    monkeypatch.setattr(LogisticRegression, "fit", one_place)
    monkeypatch.setattr(logistic, "PART_ENTRIES", 60)
    data = texts()
    df = spark.createDataFrame(data, "id int, t string, y int, dog int, f boolean").repartition(3).withColumn("few", F.when(F.col("id") == 1, 1).otherwise(0))
    got = {(r.id, r.label): r for r in M.text_classifier(df, "id", "t", ["y", "dog", "few"], F.col("f")).collect()}
    rows, size = M.tfidf_rows(df, "id", "t", F.col("f"))
    x = np.zeros((len(data), size))
    for r in rows.collect():
        x[r.id, r.ix] = r.v
    seen = x.any(axis=1)
    assert {i for i, _ in got} == set(np.flatnonzero(seen)) and {label for _, label in got} == {"y", "dog"}
    fit = np.array([d[4] for d in data]) & seen
    for at, label in ((2, "y"), (3, "dog")):
        p = best(x, np.array([math.nan if d[at] is None else d[at] for d in data], float), fit, 0.01)
        assert all(abs(got[i, label].probability - p[i]) < 1e-3 and got[i, label].predicted == (got[i, label].probability >= 0.5) for i in np.flatnonzero(seen))


def test_a_label_of_one_class_and_a_term_of_no_fitted_row(spark):
    rows = spark.createDataFrame([(i, [i % 3, 3], [0.6, 0.8], 1 if i < 6 else None, i < 8) for i in range(8)] + [(8, [900], [1.0], None, False)], "id int, ix array<int>, v array<double>, y int, f boolean")
    got = logistic.sparse_logistic(rows, "id", ["y"], "f", 2).collect()
    assert sorted((r.id, r.probability) for r in got) == [(i, 1.0) for i in range(9)]
    assert logistic.sparse_logistic(rows, "id", ["y"], "f", 2, min_pos=7) is None
