"""Small frames with answers known in closed form, by brute force or by planting."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.functions import cleaning as N
from epiframe.functions import stats
from epiframe.operators import cohorts, contingency, evaluation, graphs, joins, models, spatial, splits, summaries, survival, text, timeseries, trajectories
from epiframe.plans.ordered import ordered_pairs, quantiles, scan
from epiframe.sources import records


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scan_equals_plain_windows(spark):
    random.seed(1)
    data = [(k, random.randint(0, 40), i, random.choice([None, random.random()])) for k in "abb" for i in range(60)]
    df = spark.createDataFrame([(k, float(t), n, x) for n, (k, t, _, x) in enumerate(data)], "k string, t double, id long, x double")
    got = scan(df, ["k"], "t", {"s": ("sum", "x"), "c": ("count", "x"), "m": ("prev_max", "x"), "l": ("lag", "x"), "n": ("row_number", None), "f": ("last", "x")}, 7.0, ["id"])
    w = "OVER (PARTITION BY k ORDER BY t, id)"
    df.createOrReplaceTempView("v")
    want = spark.sql(f"SELECT k, t, id, x, sum(x) {w} s, count(x) {w} c, max(x) OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m, "
                     f"lag(x) {w} l, row_number() {w} n, last_value(x) IGNORE NULLS {w} f FROM v")
    for a, b in zip(rows(got, "id", "c", "n", "l", "m", "f", "s"), rows(want, "id", "c", "n", "l", "m", "f", "s")):
        assert a[:6] == b[:6] and (a[6] is None) == (b[6] is None) and (a[6] is None or math.isclose(a[6], b[6]))


def test_ordered_pairs_brute_force(spark):
    random.seed(2)
    pts = [(random.randint(0, 9), random.randint(0, 9), random.randint(0, 1)) for _ in range(80)]
    got = ordered_pairs(spark.createDataFrame(pts, "x int, y int, e int"), [], "x", "y", F.col("e"), F.lit(1)).first()
    pairs = [(a, b) for a, b in itertools.product(pts, pts) if a[2] and a[0] < b[0]]
    assert (got["total"], got["below"], got["equal"]) == (len(pairs), sum(a[1] < b[1] for a, b in pairs), sum(a[1] == b[1] for a, b in pairs))


def test_quantiles_match_numpy(spark):
    random.seed(3)
    x = [round(random.gauss(0, 1), 2) for _ in range(101)] + [0.5] * 60
    got = quantiles(spark.createDataFrame([(v,) for v in x], "x double"), [], "x", {"a": 0.1, "b": 0.5, "c": 0.77}).first()
    assert np.allclose([got["a"], got["b"], got["c"]], np.quantile(x, [0.1, 0.5, 0.77]))


def test_hot_group_takes_many_slices(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").cast("double").alias("t"), F.lit(1).alias("x"))
    got = scan(df, ["k"], "t", {"n": ("sum", "x")}, 100.0)
    assert got.groupBy("k").agg(F.max("n").alias("m")).orderBy("k").collect() == [(0, 3333), (1, 1667)]


def test_names(spark):
    df = spark.createDataFrame([("Heparin Sodium Injection, USP 5,000 units/mL",), ("Semaglutide (Ozempic) 0.25 mg/0.5 mL",)], "n string")
    assert [r[0] for r in df.select(N.drug_key(F.col("n"))).collect()] == ["heparin", "semaglutide"]
    firm = spark.createDataFrame([("Medtronic, Inc.",)], "n string")
    assert firm.select(N.firm_key(F.col("n"))).first()[0] == "medtronic"
    race = spark.createDataFrame([("WHITE - RUSSIAN",), ("HISPANIC/LATINO - CUBAN",), ("WHITE HISPANIC",), (None,), ("PATIENT DECLINED",)], "r string")
    assert [r[0] for r in race.select(N.collapse_race(F.col("r"))).collect()] == ["White", "Hispanic", "Hispanic", "Unknown", "Unknown"]


def test_comorbidity_override(spark):
    df = spark.createDataFrame([(1, "C78.1", 10), (1, "C18", 10), (2, "428.0", 9)], "h long, c string, v int")
    got = {r["h"]: r["charlson_index"] for r in N.code_flags(df, ["h"], "c", "v").collect()}
    assert got == {1: 6, 2: 1}


def test_jsonl_and_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n{broken\n')
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    got = records.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).cache()
    assert got.filter("_corrupt IS NULL").count() == 1 and got.filter("_corrupt IS NOT NULL").count() == 1
    records.write_jsonl(got.select("a", "b"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "t.csv").write_text("B,extra\nhello,1\n")
    assert records.read_csv_by_name(spark, str(tmp_path / "t.csv"), schema).collect() == [(None, "hello")]
    d = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    records.write_manifest(d, str(tmp_path / "m"), ["id"])
    assert rows(spark.read.parquet(str(tmp_path / "m")), "id", "split") == [(1, "train"), (2, "test")]


def test_dedupe_keeps_all_rows_of_top_version(spark):
    df = spark.createDataFrame([("a", "1", 1), ("a", "10", 2), ("a", "10", 3), ("a", "10", 3), ("b", "x", 4)], "k string, v string, n int")
    assert rows(records.dedupe_latest(df, ["k"], "v"), "k", "n") == [("a", 2), ("a", 3), ("b", 4)]


def test_paired_window(spark):
    abx = spark.createDataFrame([(1, 10.0), (1, 50.0), (2, 5.0), (3, 90.0)], "s long, a double")
    cul = spark.createDataFrame([(1, 12.0), (2, 200.0), (3, 60.0)], "s long, c double")
    got = joins.paired_window(abx, cul, ["s"], "a", "c", 72.0, 24.0, "min", 24.0)
    assert rows(got, "s", "pair_time") == [(1, 10.0), (3, 60.0)]


def test_caliper_match_is_one_to_one(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0), 0.1 + 0.8 * i / 60) for i in range(60)], "id long, t int, p double")
    got = joins.caliper_match(df, "id", "t", "p").collect()
    assert len(got) == 20 and len({r["control_id"] for r in got}) == 20


def test_merge_split_and_probability_events(spark):
    ev = spark.createDataFrame([(1, 0.0, 10.0), (1, 12.0, 20.0), (1, 40.0, 45.0)], "k long, s double, e double")
    assert rows(timeseries.merge_events(ev, ["k"], "s", "e", 5.0, 100.0), "s", "e") == [(0.0, 20.0), (40.0, 45.0)]
    pr = spark.createDataFrame([(1, i, 0.9 if 10 <= i <= 19 else 0.1) for i in range(40)], "k long, i long, p double")
    assert rows(timeseries.probability_events(pr, ["k"], "i", "p", 2.0, 4.0), "start", "end") == [(20.0, 42.0)]


def test_cusum_first_signal(spark):
    d = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([1, 1, 0, 0, 10, 10])], "k long, i long, x double")
    p = timeseries.cusum(d, ["k"], "i", "x", 2, 2.0, 5.0, width=2.0)
    assert timeseries.cusum_signal(p, ["k"], "i").first()["signal_step"] == 4


@pytest.mark.parametrize("gap", [2, 3, 7])
def test_greedy_spacing(spark, gap):
    random.seed(gap)
    at = sorted(random.sample(range(200), 90))
    want, last = [], None
    for t in at:
        if last is None or t - last >= gap:
            want.append(t)
            last = t
    got = timeseries.greedy_spacing(spark.createDataFrame([("a", t) for t in at], "k string, t long"), ["k"], "t", gap, 16)
    assert [r[1] for r in rows(got, "k", "t")] == want


def test_association_cells(spark):
    d = spark.createDataFrame([(50, 950, 100, 8900)], "a long, b long, c long, d long")
    r = contingency.disproportionality(d).first()
    assert math.isclose(r["ror"], 50 * 8900 / (950 * 100)) and math.isclose(r["prr"], 0.05 / (100 / 9000)) and r["evans"]
    g = contingency.disproportionality(d, bounds="gamma").first()
    assert g["ic025"] < r["ic"] < g["ic975"]


def test_shrinkage_pulls_small_cells(spark):
    d = spark.createDataFrame([(1, 0.05), (100, 50.0)], "a long, expected double")
    got = {r["a"]: r for r in contingency.ebgm(d).collect()}
    assert got[1]["ebgm"] < 1 / 0.05 and abs(got[100]["ebgm"] - 2) < 0.2
    assert got[1]["eb05"] < got[1]["ebgm"] < got[1]["eb95"]


def test_prior_fit_raises_likelihood(spark):
    rng = np.random.default_rng(0)
    e = rng.uniform(0.5, 20, 800)
    lam = np.where(rng.random(800) < 0.3, rng.gamma(2, 2, 800), rng.gamma(5, 0.2, 800))
    n = rng.poisson(lam * e)
    cells = spark.createDataFrame([(int(a), float(b)) for a, b in zip(n, e)], "a long, expected double")
    prior = contingency.fit_gamma_poisson_prior(cells)
    def ll(p):
        theta = np.r_[np.log(p[:4]), np.log(p[4] / (1 - p[4]))]
        return np.logaddexp(*contingency._log_parts(theta, n.astype(float), np.round(e, 9))).sum()
    assert ll(prior) > ll(contingency.PRIOR) + 5


def test_distribution_functions():
    assert math.isclose(float(stats.t_two_sided(2.0, 10)), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(float(stats.gammainc(2.5, 3.0)), 0.6937810815, rel_tol=1e-6)
    assert math.isclose(float(stats.digamma(1.0)), -0.5772156649015329, rel_tol=1e-9)


def test_logit_matches_the_saturated_table(spark):
    cells = [(1, 1, 30), (0, 1, 70), (1, 0, 20), (0, 0, 180)]
    d = spark.createDataFrame([(y, x) for y, x, n in cells for _ in range(n)], "y int, x int")
    got = {r["term"]: r for r in models.logit(d, "y", ["x"]).collect()}
    assert math.isclose(got["x"]["ratio"], 30 * 180 / (70 * 20), rel_tol=1e-6)


def test_two_stage_recovers_the_effect(spark):
    rng = np.random.default_rng(1)
    z, u = rng.normal(size=4000), rng.normal(size=4000)
    x = z + u + rng.normal(size=4000)
    y = 2 * x + 3 * u + rng.normal(size=4000)
    d = spark.createDataFrame([(float(a), float(b), float(c), float(c * c)) for a, b, c in zip(y, x, z)], "y double, x double, z double, q double")
    r = models.two_stage_ls(d, "y", "x", ["z", "q"]).first()
    assert abs(r["iv_coef"] - 2) < 0.2 and r["ols_coef"] > 2.5 and r["first_stage_f"] > 100


def test_cox_recovers_and_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    t = np.ceil(rng.exponential(np.exp(-0.7 * x)) * 10)
    c = np.ceil(rng.exponential(1.5, 400) * 10)
    time, ev = np.minimum(t, c), (t <= c).astype(int)
    d = spark.createDataFrame([(float(a), int(b), float(g), i % 40) for i, (a, b, g) in enumerate(zip(time, ev, x))], "t double, e int, x double, g long")
    r = models.cox_ph(d, "t", "e", ["x"], cluster="g").first()
    beta = 0.0
    for _ in range(30):
        grad = hess = 0.0
        for u in np.unique(time[ev == 1]):
            risk, dead = time >= u, (time == u) & (ev == 1)
            w = np.exp(beta * x)
            for j in range(dead.sum()):
                f = j / dead.sum()
                s = [(w * x ** k)[risk].sum() - f * (w * x ** k)[dead].sum() for k in range(3)]
                grad -= s[1] / s[0]
                hess += s[2] / s[0] - (s[1] / s[0]) ** 2
            grad += x[dead].sum()
        beta += grad / hess
    assert math.isclose(r["estimate"], beta, rel_tol=1e-6) and abs(beta - 0.7) < 0.2


def test_ridge_cv_predicts_out_of_fold(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    y = x @ [1, 2, 0, 0, -1] + 0.1 * rng.normal(size=300)
    d = spark.createDataFrame([([float(v) for v in a], float(b), i % 5) for i, (a, b) in enumerate(zip(x, y))], "v array<double>, y double, fold int")
    err = models.grouped_cv(d, "y", "v", "fold").select(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert err < 0.2


def test_kaplan_meier_small(spark):
    d = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (3.0, 1), (5.0, 0)], "t double, e int")
    got = survival.kaplan_meier(d, "t", "e").orderBy("time").collect()
    assert [(r["time"], r["at_risk"], r["events"]) for r in got] == [(1.0, 5, 1), (3.0, 3, 2)]
    assert math.isclose(got[1]["survival"], 0.8 / 3)


def test_calibration_of_perfect_predictions(spark):
    d = spark.createDataFrame([(int(i < n * p), p) for p, n in ((0.2, 500), (0.5, 400), (0.8, 500)) for i in range(n)], "y int, p double")
    r = evaluation.calibration(d, "y", "p").first()
    assert abs(r["intercept"]) < 1e-6 and abs(r["slope"] - 1) < 1e-6


def test_conformal_beyond_sample_is_infinite(spark):
    d = spark.createDataFrame([(float(i),) for i in range(5)], "s double")
    assert evaluation.conformal_quantile(d, "s", 0.1).first()["q"] == float("inf")
    assert evaluation.conformal_quantile(d, "s", 0.4).first()["q"] == 3.0


def test_event_scoring(spark):
    ref = spark.createDataFrame([(1, 10.0, 20.0)], "k long, s double, e double")
    hyp = spark.createDataFrame([(1, 14.0, 24.0), (1, 50.0, 60.0)], "k long, s double, e double")
    o = evaluation.event_scores(ref, hyp, ["k"], "s", "e", "overlap", 15.0).first()
    assert (o["tp"], o["fp"], o["fn"]) == (1.0, 1.0, 0.0)
    t = evaluation.event_scores(ref, hyp, ["k"], "s", "e", "time", 15.0).first()
    assert np.allclose([t["tp"], t["fp"], t["fn"]], [0.6, 1.4, 0.4])


def test_events_match_one_to_one_closest_first(spark):
    ref = spark.createDataFrame([(1, 1, 10.0), (1, 2, 14.0), (2, 3, 5.0)], "k long, id long, at double")
    hyp = spark.createDataFrame([(1, 1, 13.0), (1, 2, 100.0), (2, 3, 5.5), (2, 4, 5.2)], "k long, id long, at double")
    got = evaluation.match_events(ref, hyp, ["k"], "id", "at", 3.5)
    assert rows(got, "k", "tp", "fp", "fn") == [(1, 1, 1, 1), (2, 1, 1, 0)]


def test_permutation_null_and_planted(spark):
    d = spark.createDataFrame([(i, int(i % 2), float(i % 2) * 5 + (i * 7 % 11), (i * 7919) % 13) for i in range(200)], "id long, l int, planted double, null long")
    assert evaluation.permutation_test(d, "id", "l", "planted", [], 39).first()["p"] <= 0.05
    assert evaluation.permutation_test(d, "id", "l", "null", [], 39).first()["p"] > 0.05


def test_group_split_keeps_groups_whole(spark):
    d = spark.range(1000).select(F.col("id"), (F.col("id") % 100).alias("g"))
    s = splits.group_split(d, "g", {"train": 0.7, "test": 0.3}, 1)
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert s.filter("split = 'train'").select("g").distinct().count() == 70


def test_kdigo_and_sofa(spark):
    c = spark.createDataFrame([(1, 0.0, 1.0), (1, 40.0, 1.6), (2, 0.0, 4.2)], "s long, h double, v double")
    assert rows(cohorts.kdigo(c, ["s"], "h", "v"), "s", "h", "stage") == [(1, 0.0, 0), (1, 40.0, 1), (2, 0.0, 0)]
    assert rows(cohorts.kdigo(c, ["s"], "h", "v", strict_stage3=False), "s", "h", "stage")[2] == (2, 0.0, 3)
    g = spark.createDataFrame([(1, 1, 90.0, 100.0, 1, 90.0, 1.3, 60.0, 0.2, None, 15.0, 1.0, None)],
                              "s long, hour long, pao2 double, fio2 double, vent int, platelets double, bilirubin double, map double, norepinephrine double, epinephrine double, gcs double, creatinine double, urine double")
    r = cohorts.sofa(g, ["s"], "hour").first()
    assert (r["respiratory"], r["coagulation"], r["liver"], r["cardiovascular"], r["sofa"]) == (4, 2, 1, 4, 11)


def test_unknown_criterion_raises(spark):
    with pytest.raises(ValueError):
        cohorts.cohort_from_spec({"criteria": [{"kind": "magic"}]}, {"stays": spark.range(1)})


def test_policy_values_solve_the_bellman_equations(spark):
    t = [(k, i, (k + i) % 3, i % 2, 1.0 if i == 5 else 0.0, (k + i + 1) % 3, i == 5) for k in range(20) for i in range(6)]
    d = spark.createDataFrame(t, "key long, t long, state int, action int, reward double, next_state int, done boolean")
    sa, p = trajectories.empirical_mdp(d, 3, 2)
    pol = trajectories.behaviour_policy(d, 3, 2)
    pi = {(r.state, r.action): r.p for r in pol.collect()}
    m, b, live = np.zeros((3, 3)), np.zeros(3), {}
    for r in sa.collect():
        b[r.state] += pi[r.state, r.action] * r.reward
        live[r.state, r.action] = 1 - r.terminal
    for r in p.collect():
        m[r.state, r.next_state] += pi[r.state, r.action] * live[r.state, r.action] * r.p
    want = np.linalg.solve(np.eye(3) - 0.8 * m, b)
    got = {r.state: r.v for r in trajectories.policy_evaluation(sa, p, pol, 0.8, 1e-9).collect()}
    assert np.allclose([got[i] for i in range(3)], want, atol=1e-7)


def test_negation_and_longest_term(spark):
    df = spark.createDataFrame([(1, "No acute chest pain. Severe chest pain and pain.")], "id long, t string")
    d = spark.createDataFrame([("chest pain", "angina"), ("pain", "pain")], "s string, term string")
    got = rows(text.extract_terms(df, ["id"], "t", d, "s", "term", ["no", "without"]), "sentence", "term", "negated")
    assert got == [(0, "angina", True), (1, "angina", False), (1, "pain", False)]


def test_sections_and_planted_identifiers(spark):
    df = spark.createDataFrame([(1, "intro\nFINDINGS: ok call 555-123-4567\nIMPRESSION: none")], "id long, t string")
    s = text.split_sections(df, ["id"], "t", r"(FINDINGS|IMPRESSION):")
    assert [r["section"] for r in s.orderBy("position").collect()] == ["other", "findings", "impression"]
    assert rows(text.pii_counts(df, ["id"], "t", r"(FINDINGS|IMPRESSION):"), "section", "category", "n", "chars") == [("findings", "phone", 1, 12)]


def test_cycle_is_broken_at_the_largest_node(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "d")], "src string, dst string")
    dates = spark.createDataFrame([(x, 1) for x in "abcd"], "n string, d int")
    got = rows(graphs.clean_edges(e, dates, "n", "d"), "src", "dst")
    assert got == [("A", "B"), ("C", "A"), ("D", "A")]
    assert dict(rows(graphs.depth(graphs.clean_edges(e, dates, "n", "d")), "node", "depth")) == {"A": 1, "B": 0, "C": 2, "D": 2}


def test_components_and_sholl(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (3, 7)], "src long, dst long")
    assert dict(rows(graphs.components(e), "node", "c")) == {1: 1, 2: 1, 3: 1, 7: 1, 10: 10, 11: 10}
    t = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 2, 12.0), (1, 4, 3, 25.0)], "tree long, id long, parent long, x double")
    got = rows(graphs.sholl(t, ["tree"], "id", "parent", ["x"], F.col("parent").isNull(), 10.0), "radius", "crossings")
    assert got == [(10.0, 1), (20.0, 1)]


def test_nearest_neighbours_brute_force(spark):
    rng = np.random.default_rng(5)
    p = np.vstack([rng.normal(size=(60, 2)), [[50.0, 50.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "i long, x double, y double")
    got = {}
    for r in spatial.nearest_neighbours(df, "i", ["x", "y"], 3, 0.5).collect():
        got.setdefault(r["i"], set()).add(r["j"])
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {i: set(np.argsort(d[i])[:3]) for i in range(len(p))}


def test_pooling_and_icc(spark):
    e = spark.createDataFrame([(0.1, 0.01), (0.3, 0.02), (0.2, 0.015)], "y double, v double")
    r = summaries.pool_effects(e, "y", "v").first()
    w = np.array([100, 50, 1 / 0.015])
    assert math.isclose(r["fixed"], float((w * [0.1, 0.3, 0.2]).sum() / w.sum()), rel_tol=1e-9)
    same = spark.createDataFrame([(s, x, float(s)) for s in range(5) for x in range(3)], "s long, r long, v double")
    assert math.isclose(summaries.icc(same, "s", "v", "r").first()["icc2"], 1.0)
