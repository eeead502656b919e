"""Cases that once gave wrong answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.operators import evaluation, graphs, models, splits, text, trajectories


def test_leakage_at_equal_times(spark):
    df = spark.createDataFrame([(1, 1, 100.0, "train"), (1, 2, 100.0, "test"), (2, 3, 50.0, "train"), (2, 4, 55.0, "test"), (3, 5, 0.0, "train"), (3, 6, 99.0, "test")], "s int, r int, t double, split string")
    got = splits.leakage_audit(df, "s", ["r"], "t", "split", 10.0, 50.0).first()
    assert (got.near_rows, got.test_rows) == (2, 3)


def test_negation_reaches_forty_characters(spark):
    df = spark.createDataFrame([(1, "no a b c d e f g h fever today"), (2, "no " + "x" * 45 + " fever"), (3, "no. fever"), (4, "without, (any) fever and chills at night")], "id int, t string")
    d = spark.createDataFrame([("fever", "F"), ("chills at night", "C")], "s string, term string")
    got = {(r.id, r.term): r.negated for r in text.extract_terms(df, ["id"], "t", d, "s", "term", ["no", "without"]).collect()}
    assert got == {(1, "F"): True, (2, "F"): False, (3, "F"): False, (4, "F"): True, (4, "C"): True}


def test_error_grid_at_seventy(spark):
    df = spark.createDataFrame([(70.0, 50.0), (50.0, 70.0), (70.0, 70.0), (60.0, 75.0)], "r double, e double")
    assert [r[0] for r in df.select(evaluation.clarke_zone(F.col("r"), F.col("e"))).collect()] == ["A", "A", "A", "D"]


def test_classifier_without_a_label_that_qualifies(spark):
    df = spark.createDataFrame([(i, f"word{i % 3} other word", 0) for i in range(20)], "id int, t string, y int")
    assert models.text_classifier(df, "id", "t", ["y"], F.lit(True)).collect() == []


def test_values_with_a_next_state_outside(spark):
    sa = spark.createDataFrame([(0, 0, 1.0, 0.0), (1, 0, 0.0, 0.0)], "state int, action int, reward double, terminal double")
    p = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 9, 0.5), (1, 0, 0, 1.0)], "state int, action int, next_state int, p double")
    got = {r.state: r.v for r in trajectories.policy_evaluation(sa, p, None, 0.5, 1e-9).collect()}
    want = np.linalg.solve(np.array([[1, -0.25], [-0.5, 1]]), [1.0, 0.0])
    assert np.allclose([got[0], got[1]], want)


def test_pagerank_converges(spark):
    rng = np.random.RandomState(3)
    edges = sorted({(int(a), int(b)) for a, b in rng.randint(0, 40, (90, 2)) if a != b} | {(i + 1, i) for i in range(39)})
    got = {r.n: r["rank"] for r in graphs.pagerank(spark.createDataFrame(edges, "src int, dst int")).collect()}
    m = np.zeros((40, 40))
    for s, d in edges:
        m[s, d] = 1
    out = m.sum(0)
    r = np.full(40, 1 / 40)
    for _ in range(500):
        r = 0.15 / 40 + 0.85 * (m[:, out > 0] @ (r[out > 0] / out[out > 0]) + r[out == 0].sum() / 40)
    assert np.allclose([got[i] for i in range(40)], r, atol=1e-7)


def test_depth_of_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        graphs.depth(spark.createDataFrame([(1, 2), (2, 1), (2, 0)], "src int, dst int"))


def test_evidence_is_counted_in_full(spark):
    df = spark.createDataFrame([(1, "A nodule. A nodule. A nodule. A nodule. A nodule.")], "id int, t string")
    assert text.label_text(df, ["id"], "t", {"nodule": ["nodule"]}).first().nodule_evidence == 5


def test_kernel_distance_covers_all_rows(spark):
    rng = np.random.RandomState(5)
    x = np.vstack([rng.randn(150, 3), rng.randn(170, 3) + 0.8])
    side = np.r_[np.zeros(150), np.ones(170)]
    df = spark.createDataFrame([(i, [float(v) for v in r], int(s)) for i, (r, s) in enumerate(zip(x, side))] + [(999, None, 1)], "i int, v array<double>, s int")
    k = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(k, 0)
    a, b = side == 0, side == 1
    want = k[np.ix_(a, a)].sum() / (150 * 149) + k[np.ix_(b, b)].sum() / (170 * 169) - 2 * k[np.ix_(a, b)].mean()
    got = evaluation.mmd(df, "i", "v", F.col("s"), 3, 4096, 1, 0.3, 39).first()
    assert got.n == 320 and abs(got.mmd2 - want) < 0.02 and got.p == 1 / 40
    same = evaluation.mmd(df, "i", "v", F.col("i") % 2, 3, 1024, 1, None, 39).first()
    assert abs(same.gamma - 1 / (2 * x.var(0, ddof=1).sum())) < 1e-9 and same.p > 0.05
    assert evaluation.mmd(df.filter("i = 3"), "i", "v", F.col("s"), 3, 8, n_perm=3).first().mmd2 is None


def test_synthetic_rows_told_from_real(spark):
    rng = np.random.RandomState(6)
    rows = [(i, [float(v) for v in rng.randn(3) + (i >= 400) * 1.0]) for i in range(800)]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    apart = models.propensity_mse(df.filter("i < 400"), df.filter("i >= 400"), "i", "v").first()
    alike = models.propensity_mse(df.filter("i < 200"), df.filter("i >= 200 AND i < 400"), "i", "v").first()
    assert apart.n == 800 and apart.share == 0.5 and abs(apart.null_expected - 3 * 0.125 / 800) < 1e-12
    assert apart.ratio > 20 and alike.ratio < 5


def test_closest_records_against_holdout(spark):
    rng = np.random.RandomState(7)
    x = rng.randn(90, 4) * [1, 5, 0.1, 0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    got = {r.side: (r.p5, r["median"]) for r in evaluation.closest_record_report(df.filter("i < 50"), {"s": df.filter("i >= 50 AND i < 70"), "h": df.filter("i >= 70")}, "i", "v", 4).collect()}
    sd = x[:50].std(0)
    z = (x - x[:50].mean(0)) / np.where(sd > 0, sd, 1)
    for name, rows in (("s", z[50:70]), ("h", z[70:])):
        d = np.sqrt(((rows[:, None] - z[None, :50]) ** 2).sum(-1)).min(1)
        assert np.allclose(got[name], np.percentile(d, [5, 50]))


def test_rank_correlation_of_shift_and_loss(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 2.0, 1.0), ("m", 3.0, 4.0), ("m", 4.0, 3.0), ("n", 1.0, 1.0)], "g string, a double, b double")
    got = {r.stratum: r for r in evaluation.shift_loss_correlation(df, "a", "b", "g").collect()}
    assert abs(got["m"].spearman_rho - 0.6) < 1e-12 and abs(got["m"].p - 0.4) < 1e-9 and got["n"].spearman_rho is None


def test_shapley_of_two_corrections(spark):
    df = spark.createDataFrame([(False, False, 10.0), (True, False, 6.0), (False, True, 9.0), (True, True, 1.0)], "a boolean, b boolean, v double")
    got = {r.term: r for r in evaluation.shapley_gap(df, ["a", "b"], "v").collect()}
    assert (got["a"].closed_mean, got["a"].closed_sd, got["a"].share_of_raw) == (6.0, 2.0, 0.6) and got["b"].closed_mean == 3.0


def test_scan_crosses_section_borders_and_skips_headers(spark):
    df = spark.createDataFrame([(1, "HEAD call 555-123-4567 a@b.org\nNOTE: 555-123-4567 10.0.0.1\nNOTE: on"), (2, "10.0.0.1 NOTE:"), (3, ""), (4, None)], "id int, t string")
    def got(header, category, pattern):
        d = text.pii_counts(df, ["id"], "t", header, {category: pattern})
        return sorted((r.id, r.section, r.n, r.chars) for r in d.collect())
    assert got("(NOTE):", "phone", text.IDENTIFIERS["phone"]) == [(1, "note", 1, 12), (1, "other", 1, 12)]
    assert got("(NOTE):", "over", r"0\.0\.1\s+NOTE") == [(1, "note", 1, 10), (2, "other", 1, 10)]
    assert got("(NOTE):", "head", "OTE: [5o]") == []


def test_planted_identifiers_are_counted(spark):
    df = spark.createDataFrame([(1, "One.\nTwo.\n\nThree"), (2, "a@b.org"), (3, ""), (4, None)], "id int, t string")
    out = text.plant(df, "id", "t", each=2, seed=7).cache()
    assert set(text.MADE_UP) == set(text.IDENTIFIERS)
    assert all(set(r.planted.values()) == {2} and set(r.planted) == set(text.IDENTIFIERS) for r in out.collect())
    first = out.filter("id = 1").first().t.split("\n")
    assert len(first) == 4 and [line[:len(own)] for line, own in zip(first, ["One.", "Two.", "", "Three"], strict=True)] == ["One.", "Two.", "", "Three"]
    got = {r.category: r for r in text.detector_recall(df, out, "id", "t", text.IDENTIFIERS).collect()}
    assert all(r.n_planted == 8 and r.n_found == 8 for r in got.values()) and got["email"].observed_rate == 0.25
    again = text.plant(df, "id", "t", each=2, seed=7)
    assert out.select("id", "t").exceptAll(again.select("id", "t")).count() == 0 and out.select("t").exceptAll(text.plant(df, "id", "t", each=2, seed=8).select("t")).count() == 4
