"""EVL: model and detector evaluation."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..plans.ordered import axis
from .registry import query, rounded

# y: the line was returned; p: a score in (0, 1) from price and discount; g: order status of the order
SQL = """d AS (SELECT l_orderkey, l_partkey, l_suppkey, (l_returnflag = 'R')::INT AS y, round(0.05::DOUBLE + 0.9::DOUBLE * (l_quantity + 100 * l_discount) / 61, 2) AS p, round(0.05::DOUBLE + l_tax * 10, 2) AS q, l_linestatus AS g, l_extendedprice AS x FROM lineitem)"""


def scored(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("y"),
                             F.round(0.05 + 0.9 * (F.col("l_quantity") + 100 * F.col("l_discount")) / 61, 2).alias("p"),
                             F.round(0.05 + F.col("l_tax") * 10, 2).alias("q"), F.col("l_linestatus").alias("g"), F.col("l_extendedprice").alias("x"))


@query("evl01_auroc", f"""
WITH {SQL}, r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0::DOUBLE AS r FROM d)
SELECT g, count(*)::BIGINT AS n, sum(y)::BIGINT AS n_pos, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y))), 6) AS auroc FROM r GROUP BY 1""")
def auroc(t):
    return rounded(E.auroc(scored(t), "y", "p", ["g"]))


@query("evl01_weighted_auroc", f"""
WITH {SQL}, s AS (SELECT p, sum(q) FILTER (y = 1) AS a, sum(q) FILTER (y = 0) AS b FROM d GROUP BY 1), c AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM s)
SELECT round(sum(a * (lo + b / 2)) / (sum(a) * sum(b)), 6) AS auroc FROM c""")
def weighted_auroc(t):
    return rounded(E.auroc(scored(t), "y", "p", [], "q").select("auroc"))


@query("evl02_auprc", f"""
WITH {SQL}, s AS (SELECT g, p, sum(y) AS a, count(*) AS n FROM d GROUP BY 1, 2), c AS (SELECT *, sum(a) OVER w AS tp, sum(n) OVER w AS k FROM s WINDOW w AS (PARTITION BY g ORDER BY p DESC))
SELECT g, round(sum(a * tp / k::DOUBLE) / sum(a), 6) AS auprc FROM c GROUP BY 1""")
def auprc(t):
    return rounded(E.auprc(scored(t), "y", "p", ["g"]))


@query("evl02_precision_at_k", f"""
WITH {SQL}, o AS (SELECT o_orderkey, avg(p) AS p, max(y) AS y FROM d JOIN orders ON o_orderkey = l_orderkey GROUP BY 1), tp AS (SELECT * FROM o ORDER BY round(p, 6) DESC, o_orderkey LIMIT 100)
SELECT count(*)::BIGINT AS k, round(avg(y), 6) AS precision, round(sum(y) / (SELECT sum(y) FROM o)::DOUBLE, 6) AS recall FROM tp""")
def at_k(t):
    d = scored(t).groupBy("l_orderkey").agg(F.round(F.avg("p"), 6).alias("p"), F.max("y").alias("y"))
    return rounded(E.precision_at_k(d, "y", "p", 100, "l_orderkey"))


@query("evl03_brier_logloss", f"WITH {SQL} SELECT g, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM d GROUP BY 1")
def brier(t):
    return rounded(E.brier_logloss(scored(t), "y", "p", ["g"]))


@query("evl03_ece_uniform", f"""
WITH {SQL}, b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS o FROM d GROUP BY 1), t AS (SELECT sum(n) AS n, sum(n * o) / sum(n) AS base FROM b)
SELECT round(sum(b.n / t.n::DOUBLE * abs(mp - o)), 6) AS ece, round(sum(b.n / t.n::DOUBLE * pow(mp - o, 2)), 6) AS reliability, round(sum(b.n / t.n::DOUBLE * pow(o - base, 2)), 8) AS resolution, round(min(base * (1 - base)), 6) AS uncertainty FROM b, t""")
def ece(t):
    d = E.ece(E.reliability(scored(t), "y", "p", 10, "uniform"))
    return d.select(*[F.round(c, 6).alias(c) for c in ("ece", "reliability", "uncertainty")], F.round("resolution", 8).alias("resolution"))


@query("evl03_reliability_quantile", f"""
WITH {SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM d), b AS (SELECT greatest(least(len([v FOR v IN e IF v <= p]) - 1, len(e) - 2), 0) AS bin, p, y FROM d, e)
SELECT bin::INT AS bin, count(*)::BIGINT AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM b GROUP BY 1""")
def reliability(t):
    return rounded(E.reliability(scored(t), "y", "p", 5))


@query("evl04_calibration")
def calibration(t):
    return rounded(E.calibration(scored(t), "y", "p"), 5)


THR = [0.1, 0.25, 0.33, 0.5, 0.75]


@query("evl05_net_benefit", f"""
WITH {SQL}, t AS (SELECT unnest([0.1, 0.25, 0.33, 0.5, 0.75]::DOUBLE[]) AS threshold), c AS (SELECT threshold, count(*)::DOUBLE AS n, sum(y) AS pos, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp FROM d, t GROUP BY 1)
SELECT threshold, round(tp / n - fp / n * threshold / (1 - threshold), 6) + 0 AS nb_model, round(pos / n - (n - pos) / n * threshold / (1 - threshold), 6) + 0 AS nb_all, 0.0::DOUBLE AS nb_none, round((tp + fp) / n, 6) AS flagged, round(tp / pos::DOUBLE, 6) AS sensitivity, round(1 - fp / (n - pos), 6) AS specificity FROM c""")
def benefit(t):
    return rounded(E.net_benefit(scored(t), "y", "p", THR))


@query("evl06_operating_points", f"""
WITH {SQL}, s AS (SELECT p, sum(y) AS a, count(*) - sum(y) AS b FROM d GROUP BY 1), c AS (SELECT p, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS pp, sum(b) OVER () AS nn FROM s WINDOW w AS (ORDER BY p DESC)),
m AS (SELECT p AS threshold, tp / pp::DOUBLE AS sensitivity, 1 - fp / nn::DOUBLE AS specificity, tp / (tp + fp)::DOUBLE AS ppv, (tp + fp) / (pp + nn)::DOUBLE AS alert_rate FROM c),
u AS ((SELECT 'sensitivity' AS target, * FROM m WHERE sensitivity >= 0.9 ORDER BY threshold DESC LIMIT 1) UNION ALL (SELECT 'alert_rate', * FROM m WHERE alert_rate <= 0.1 ORDER BY threshold LIMIT 1) UNION ALL (SELECT 'fpr', * FROM m WHERE 1 - specificity <= 0.2 ORDER BY threshold LIMIT 1))
SELECT target, threshold, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(ppv, 6) AS ppv, round(alert_rate, 6) AS alert_rate FROM u""")
def points(t):
    return rounded(E.operating_points(scored(t), "y", "p", {"sensitivity": 0.9, "alert_rate": 0.1, "fpr": 0.2}))


@query("evl07_subgroup_gaps", f"""
WITH {SQL}, s AS (SELECT l_suppkey % 7 AS grp, avg((p >= 0.5)::INT) FILTER (y = 1) AS tpr, avg((p >= 0.5)::INT) FILTER (y = 0) AS fpr, avg(y) AS prevalence FROM d GROUP BY 1)
SELECT grp, round(prevalence, 6) AS prevalence, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(max(tpr) OVER () - min(tpr) OVER (), 6) AS tpr_gap, round(max(fpr) OVER () - min(fpr) OVER (), 6) AS fpr_gap, round(tpr - (SELECT tpr FROM s WHERE grp = 0), 6) + 0 AS tpr_vs_ref FROM s""")
def gaps(t):
    m = E.subgroup_metrics(scored(t).withColumn("grp", F.col("l_suppkey") % 7), "y", "p", "grp", 0.5)
    return rounded(E.subgroup_gaps(m, "grp", ["tpr", "fpr"], 0).select("grp", "prevalence", "tpr", "fpr", "tpr_gap", "fpr_gap", "tpr_vs_ref"))


@query("evl08_regression_metrics", """
WITH d AS (SELECT l_linestatus AS g, l_extendedprice AS y, 2000 * l_quantity AS f, l_extendedprice * 1.1::DOUBLE AS nv FROM lineitem) SELECT g, count(*)::BIGINT AS n, round(avg(abs(f - y)), 4) AS mae, round(sqrt(avg((f - y) * (f - y))), 4) AS rmse, round(avg(f - y), 4) + 0 AS bias,
 round(1 - sum((f - y) * (f - y)) / (var_pop(y) * count(*)), 6) + 0 AS r2, round(corr(y, f), 6) + 0 AS pearson, round(avg((y BETWEEN f * 0.5::DOUBLE AND f * 1.5::DOUBLE)::INT), 6) AS coverage, round(1 - sqrt(avg((f - y) * (f - y))) / sqrt(avg((nv - y) * (nv - y))), 6) + 0 AS skill FROM d GROUP BY 1""")
def regression(t):
    d = t.lineitem.select(F.col("l_linestatus").alias("g"), F.col("l_extendedprice").alias("y"), (2000 * F.col("l_quantity")).alias("f"), (F.col("l_extendedprice") * 1.1).alias("nv"))
    d = E.regression_metrics(d.withColumn("lo", F.col("f") * 0.5).withColumn("hi", F.col("f") * 1.5), "y", "f", ["g"], "lo", "hi", "nv")
    return d.select("g", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias")], *[F.round(c, 6).alias(c) for c in ("r2", "pearson", "coverage", "skill")])


@query("evl09_label_shift")
def label_shift(t):
    d = scored(t).withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    return rounded(E.label_shift_bbse(d.filter("g = 'F'"), d.filter("g = 'O'"), "y", "yhat"))


@query("evl10_gap_decomposition", f"""
WITH {SQL}, w AS (SELECT *, 0.5::DOUBLE + q AS wx, 1.5::DOUBLE - y AS wy, (p - y) * (p - y) AS e FROM d), s AS (SELECT avg(e) AS s, sum(wx * e) / sum(wx) AS x, sum(wy * e) / sum(wy) AS l, sum(wx * wy * e) / sum(wx * wy) AS xl FROM w WHERE g = 'F'), t AS (SELECT avg(e) AS t FROM w WHERE g = 'O')
SELECT round(s, 8) AS source, round(t, 8) AS target, round(t - s, 8) + 0 AS gap, round(((x - s) + (xl - l)) / 2, 8) + 0 AS covariate, round(((l - s) + (xl - x)) / 2, 8) + 0 AS label, round(t - xl, 8) + 0 AS concept FROM s, t""")
def decomposition(t):
    d = scored(t).withColumn("wx", 0.5 + F.col("q")).withColumn("wy", 1.5 - F.col("y"))
    return rounded(E.gap_decomposition(d.filter("g = 'F'"), d.filter("g = 'O'"), "y", "p", "wx", "wy"), 8)


@query("evl11_cluster_bootstrap")
def bootstrap(t):
    d = scored(t).withColumn("se", (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).withColumn("one", F.lit(1.0))
    return rounded(E.cluster_bootstrap(d, ["l_suppkey"], F.col("se") / F.col("one"), ["se", "one"], 200, 3, by=["g"]))


@query("evl12_permutation_test")
def permutation(t):
    d = t.orders.withColumn("label", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    return rounded(E.permutation_test(d, "o_orderkey", "label", "o_totalprice", ["o_orderstatus"], 19, 5), 4)


@query("evl13_delong", f"""
WITH {SQL}, o AS (SELECT l_orderkey, max(y) AS y, max(p) AS p, max(q) AS q FROM d GROUP BY 1), c AS (SELECT sum(y)::DOUBLE AS np, (count(*) - sum(y))::DOUBLE AS nn FROM o),
a AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY y ORDER BY p) + (count(*) OVER (PARTITION BY y, p) - 1) / 2.0::DOUBLE AS wa,
  rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0::DOUBLE AS rb, rank() OVER (PARTITION BY y ORDER BY q) + (count(*) OVER (PARTITION BY y, q) - 1) / 2.0::DOUBLE AS wb FROM o),
v AS (SELECT y, CASE WHEN y = 1 THEN (ra - wa) / nn ELSE 1 - (ra - wa) / np END AS va, CASE WHEN y = 1 THEN (rb - wb) / nn ELSE 1 - (rb - wb) / np END AS vb FROM a, c),
s AS (SELECT avg(va) FILTER (y = 1) AS aa, avg(vb) FILTER (y = 1) AS ab, var_samp(va - vb) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(va - vb) FILTER (y = 0) / count(*) FILTER (y = 0) AS v FROM v)
SELECT round(aa, 6) AS auroc_a, round(ab, 6) AS auroc_b, round(aa - ab, 6) + 0 AS difference, round(sqrt(v), 7) AS se FROM s""")
def delong(t):
    d = scored(t).groupBy("l_orderkey").agg(F.max("y").alias("y"), F.max("p").alias("p"), F.max("q").alias("q"))
    d = E.delong(d, "l_orderkey", "y", "p", "q")
    return d.select(*[F.round(c, 6).alias(c) for c in ("auroc_a", "auroc_b", "difference")], F.round("se", 7).alias("se"))


@query("evl14_conformal", f"""
WITH {SQL}, s AS (SELECT y, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM d WHERE g = 'F'), r AS (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY s) AS k, count(*) OVER (PARTITION BY y) AS n FROM s)
SELECT y, max(n)::BIGINT AS n_cal, round(coalesce(max(s) FILTER (k = ceil((n + 1) * 0.9::DOUBLE - 1e-9)), 'inf'::DOUBLE), 6) AS q FROM r GROUP BY 1""")
def conformal(t):
    d = scored(t).filter("g = 'F'").withColumn("s", F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p")))
    return rounded(E.conformal_quantile(d, "s", 0.1, ["y"]))


@query("evl14_weighted_conformal", f"""
WITH {SQL}, s AS (SELECT abs(p - y) AS s, sum(q) AS w FROM d GROUP BY 1), c AS (SELECT s, sum(w) OVER (ORDER BY s) AS cum, sum(w) OVER () AS t FROM s), w AS (SELECT unnest([0.0, 5.0, 100000.0]::DOUBLE[]) AS w_test)
SELECT w_test, round(coalesce(min(s) FILTER (cum / (t + w_test) >= 0.8), 'inf'::DOUBLE), 6) AS q FROM c, w GROUP BY 1""")
def weighted_conformal(t):
    d = scored(t).withColumn("s", F.abs(F.col("p") - F.col("y")))
    return rounded(E.weighted_conformal_quantile(d, "s", "q", [0.0, 5.0, 100000.0], 0.2))


@query("evl15_psi", f"""
WITH {SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM d WHERE g = 'F'), b AS (SELECT g, CASE WHEN x >= e[1] AND x <= e[-1] THEN least(len([v FOR v IN e IF v <= x]) - 1, len(e) - 2) END AS b FROM d, e),
n AS (SELECT count(*) FILTER (g = 'F')::DOUBLE AS nr, count(*) FILTER (g = 'O')::DOUBLE AS nc FROM d), c AS (SELECT b, count(*) FILTER (g = 'F') / min(nr) + 1e-6 AS r, count(*) FILTER (g = 'O') / min(nc) + 1e-6 AS c FROM b, n WHERE b IS NOT NULL GROUP BY 1)
SELECT round(sum((c - r) * ln(c / r)), 8) AS psi FROM c""")
def psi(t):
    d = scored(t)
    return rounded(E.psi(d.filter("g = 'F'"), d.filter("g = 'O'"), "x"), 8)


@query("evl15_distribution_distance", f"""
WITH {SQL}, c AS (SELECT x, count(*) FILTER (g = 'F')::DOUBLE AS r, count(*) FILTER (g = 'O')::DOUBLE AS c FROM d GROUP BY 1), f AS (SELECT x, abs(sum(r) OVER w / sum(r) OVER () - sum(c) OVER w / sum(c) OVER ()) AS gap, lead(x) OVER (ORDER BY x) AS nx FROM c WINDOW w AS (ORDER BY x))
SELECT round(max(gap), 6) AS ks, round(sum(gap * (coalesce(nx, x) - x)), 4) AS wasserstein, round(sum(2 * gap * gap * (coalesce(nx, x) - x)), 5) AS energy, 0.0::DOUBLE AS missing_diff FROM f""")
def distance(t):
    d = scored(t)
    d = E.distribution_distance(d.filter("g = 'F'"), d.filter("g = 'O'"), "x")
    return d.select(F.round("ks", 6).alias("ks"), F.round("wasserstein", 4).alias("wasserstein"), F.round("energy", 5).alias("energy"), "missing_diff")


@query("evl16_mmd")
def kernel_distance(t):
    return rounded(E.mmd(t.embeddings, "vec_id", "embedding", F.col("label") >= 5, 64, 512, 1, n_perm=99))


@query("evl16_centroid_distance", """
WITH m AS (SELECT i, avg(embedding[i]::DOUBLE) FILTER (label < 5) AS a, avg(embedding[i]::DOUBLE) FILTER (label >= 5) AS b FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1)
SELECT round(1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 5) AS cosine_distance, round(sqrt(sum((a - b) * (a - b))), 5) AS mean_shift FROM m""")
def centroids(t):
    return rounded(E.centroid_distance(t.embeddings, "embedding", (F.col("label") >= 5).cast("int"), 64), 5)


@query("evl17_closest_record", """
SELECT q.vec_id, min_by(t.vec_id, list_distance(q.embedding, t.embedding)) AS nearest, round(min(list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[])), 4) AS distance
FROM embeddings q, embeddings t WHERE q.vec_id % 2 = 1 AND t.vec_id % 2 = 0 GROUP BY 1""")
def closest(t):
    e = t.embeddings
    return rounded(E.closest_record(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "vec_id", "embedding", 64), 4)


EVENTS = """ref AS (SELECT DISTINCT user_id, epoch_us(ts) / 1e6::DOUBLE AS s, epoch_us(ts) / 1e6::DOUBLE + 7200 AS e FROM events WHERE event_type = 'error'), hyp AS (SELECT DISTINCT user_id, epoch_us(ts) / 1e6::DOUBLE - 600 AS s, epoch_us(ts) / 1e6::DOUBLE + 60 * value AS e FROM events WHERE event_type IN ('click', 'view')),
o AS (SELECT r.user_id, r.s AS rs, r.e AS re, h.s AS hs, h.e AS he, least(r.e, h.e) - greatest(r.s, h.s) AS ov FROM ref r JOIN hyp h ON h.user_id = r.user_id AND r.s < h.e AND h.s < r.e)"""


def ref_hyp(t):
    x = axis(t.events, "ts")
    ref = t.events.filter("event_type = 'error'").select("user_id", x.alias("s")).withColumn("e", F.col("s") + 7200)
    hyp = t.events.filter("event_type IN ('click', 'view')").select("user_id", (x - 600).alias("s"), (x + 60 * F.col("value")).alias("e"))
    return ref, hyp


@query("evl18_overlap_scores", f"""
WITH {EVENTS}, a AS (SELECT user_id, count(*)::DOUBLE AS n, count(*) FILTER (EXISTS (SELECT 1 FROM o WHERE o.user_id = ref.user_id AND o.rs = ref.s))::DOUBLE AS tp FROM ref GROUP BY 1), b AS (SELECT user_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = hyp.user_id AND o.hs = hyp.s AND o.he = hyp.e))::DOUBLE AS fp FROM hyp GROUP BY 1)
SELECT user_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n - tp, 0) AS fn FROM a FULL JOIN b USING (user_id)""")
def overlap(t):
    ref, hyp = ref_hyp(t)
    return E.event_scores(ref, hyp, ["user_id"], "s", "e", "overlap", 86400.0)


@query("evl18_time_scores", f"""
WITH {EVENTS}, c AS (SELECT ref.user_id, ref.s, ref.e, coalesce(sum(ov), 0) AS ins, coalesce(sum(he - hs - ov), 0) AS outs FROM ref LEFT JOIN o ON o.user_id = ref.user_id AND o.rs = ref.s GROUP BY 1, 2, 3),
a AS (SELECT user_id, sum(least(ins / (e - s), 1)) AS tp, sum(1 - least(ins / (e - s), 1)) AS fn, sum(outs / (e - s)) AS x FROM c GROUP BY 1), b AS (SELECT user_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = hyp.user_id AND o.hs = hyp.s AND o.he = hyp.e))::DOUBLE AS fp FROM hyp GROUP BY 1)
SELECT user_id, round(coalesce(tp, 0), 6) AS tp, round(coalesce(x, 0) + coalesce(fp, 0), 6) AS fp, round(coalesce(fn, 0), 6) + 0 AS fn FROM a FULL JOIN b USING (user_id)""")
def timed(t):
    ref, hyp = ref_hyp(t)
    return rounded(E.event_scores(ref, hyp, ["user_id"], "s", "e", "time", 86400.0), 6)


@query("evl18_tolerance_pooled")
def tolerance(t):
    ref, hyp = ref_hyp(t)
    d = E.event_scores(ref, hyp, ["user_id"], "s", "e", "tolerance", 86400.0, 600.0, 1200.0, 1800.0, 14400.0)
    return rounded(E.pooled_scores(d, 24.0 * 30))


@query("evl18_matched_events")
def matched(t):
    x = axis(t.events, "ts")
    ref = t.events.filter("event_type = 'error'").select("user_id", "event_id", x.alias("at"))
    hyp = t.events.filter("event_type = 'click'").select("user_id", "event_id", x.alias("at"))
    return E.match_events(ref, hyp, ["user_id"], "event_id", "at", 6 * 3600.0)


@query("evl17_propensity_mse")
def pmse(t):
    from ..operators.models import propensity_mse
    return rounded(propensity_mse(t.embeddings.filter("vec_id % 2 = 0"), t.embeddings.filter("vec_id % 2 = 1"), "vec_id", "embedding"))


@query("evl17_closest_record_report")
def closest_report(t):
    side = lambda k: t.embeddings.filter(f"vec_id % 4 = {k}")
    return rounded(E.closest_record_report(t.embeddings.filter("vec_id % 2 = 0"), {"synthetic": side(1), "holdout": side(3)}, "vec_id", "embedding", 64), 4)


@query("evl18_alarm_scores", """
WITH al AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS a FROM events WHERE event_type = 'click'), ev AS (SELECT DISTINCT user_id, epoch_us(ts) / 1e6::DOUBLE AS e FROM events WHERE event_type = 'error'), h AS (SELECT al.user_id, a, e FROM al JOIN ev ON al.user_id = ev.user_id AND e BETWEEN a + 600 AND a + 600 + 43200)
SELECT user_id, coalesce(n, 0)::BIGINT AS n_alarms, coalesce(m, 0)::BIGINT AS n_events, coalesce(g, 0)::BIGINT AS true_alarms, coalesce(c, 0)::BIGINT AS caught FROM (SELECT user_id, count(*) AS n FROM al GROUP BY 1) FULL JOIN (SELECT user_id, count(*) AS m FROM ev GROUP BY 1) USING (user_id)
LEFT JOIN (SELECT user_id, count(DISTINCT a) AS g, count(DISTINCT e) AS c FROM h GROUP BY 1) USING (user_id)""")
def alarm(t):
    x = axis(t.events, "ts")
    al = t.events.filter("event_type = 'click'").select("user_id", x.alias("a"))
    ev = t.events.filter("event_type = 'error'").select("user_id", x.alias("e"))
    return E.alarm_scores(al, ev, ["user_id"], "a", "e", 600.0, 43200.0, 86400.0)


@query("evl19_clarke_zones", """
WITH d AS (SELECT 40 + l_quantity * 6 AS r, 10 * floor(4 + l_extendedprice / 3000) AS e FROM lineitem), z AS (SELECT CASE WHEN (r <= 70 AND e <= 70) OR abs(e - r) <= 0.2::DOUBLE * r THEN 'A' WHEN (r <= 70 AND e >= 180) OR (r >= 180 AND e <= 70) THEN 'E'
 WHEN (r >= 70 AND r <= 290 AND e >= r + 110) OR (r >= 130 AND r <= 180 AND e <= 7 / 5::DOUBLE * r - 182) THEN 'C' WHEN (r >= 240 AND e >= 70 AND e <= 180) OR (r <= 175 / 3::DOUBLE AND e >= 70 AND e <= 180) OR (r >= 175 / 3::DOUBLE AND r <= 70 AND e >= 6 / 5::DOUBLE * r) THEN 'D' ELSE 'B' END AS zone FROM d)
SELECT zone, count(*)::BIGINT AS n FROM z GROUP BY 1""")
def zones(t):
    d = t.lineitem.select((40 + F.col("l_quantity") * 6).alias("r"), (10 * F.floor(4 + F.col("l_extendedprice") / 3000)).cast("double").alias("e"))
    return d.groupBy(E.clarke_zone(F.col("r"), F.col("e")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("evl19_bhs_grade", """
WITH d AS (SELECT l_linestatus AS g, 100 * l_discount + l_quantity / 5 - 10 AS e FROM lineitem), s AS (SELECT g, count(*)::BIGINT AS n, 100 * avg((abs(e) <= 5)::INT) AS a, 100 * avg((abs(e) <= 10)::INT) AS b, 100 * avg((abs(e) <= 15)::INT) AS c, avg(e) AS m, stddev_samp(e) AS sd FROM d GROUP BY 1)
SELECT g, n, round(a, 5) AS within_5, round(b, 5) AS within_10, round(c, 5) AS within_15, round(m, 6) + 0 AS mean_error, round(sd, 6) AS sd_error, CASE WHEN a >= 60 AND b >= 85 AND c >= 95 THEN 'A' WHEN a >= 50 AND b >= 75 AND c >= 90 THEN 'B' WHEN a >= 40 AND b >= 65 AND c >= 85 THEN 'C' ELSE 'D' END AS grade, abs(m) <= 5 AND sd <= 8 AS aami_pass FROM s""")
def bhs(t):
    d = t.lineitem.select(F.col("l_linestatus").alias("g"), F.lit(10.0).alias("r"), (100 * F.col("l_discount") + F.col("l_quantity") / 5).alias("e"))
    d = E.bhs_grade(d, "r", "e", ["g"])
    return d.select("g", "n", *[F.round(c, 5).alias(c) for c in ("within_5", "within_10", "within_15")], *[F.round(c, 6).alias(c) for c in ("mean_error", "sd_error")], "grade", "aami_pass")


@query("evl20_triage_curve", f"""
WITH {SQL}, o AS (SELECT l_orderkey, max(y) AS y, round(avg(p), 6) AS p FROM d GROUP BY 1), r AS (SELECT y, row_number() OVER (ORDER BY p DESC, l_orderkey) AS k, count(*) OVER () AS n FROM o), f AS (SELECT unnest([0.05, 0.1, 0.5]::DOUBLE[]) AS fraction)
SELECT fraction, max(ceil(n * fraction - 1e-9))::BIGINT AS reviewed, round(sum(y) FILTER (k <= ceil(n * fraction - 1e-9)) / sum(y)::DOUBLE, 6) AS recall FROM r, f GROUP BY 1""")
def triage(t):
    d = scored(t).groupBy("l_orderkey").agg(F.max("y").alias("y"), F.round(F.avg("p"), 6).alias("p"))
    return rounded(E.triage_curve(d, "p", "y", [0.05, 0.1, 0.5], "l_orderkey"))


@query("evl21_leaderboard", """
WITH c AS (SELECT p_brand, p_type, avg(l_discount) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), g AS (SELECT p_brand, count(*)::BIGINT AS n_cells, avg(v) AS m, min(v) AS w, max(v) - min(v) AS gap FROM c GROUP BY 1)
SELECT p_brand, n_cells, round(m, 8) AS mean, round(w, 8) AS worst, round(gap, 8) AS gap, row_number() OVER (ORDER BY m DESC, p_brand)::BIGINT AS rank FROM g""")
def board(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_type").agg(F.avg("l_discount").alias("v"))
    return rounded(E.leaderboard(d, "p_brand", "p_type", "v"), 8)


@query("evl06_screening_policies", f"""
WITH {SQL}, h AS (SELECT unnest([0.2, 0.4, 0.6]::DOUBLE[]) AS threshold), s AS (SELECT threshold, avg(y) AS c, avg((p >= threshold)::INT) AS r, avg((p >= threshold AND y = 1)::INT) AS h FROM d, h GROUP BY 1)
SELECT threshold, round(1000 * r, 5) AS referred_per_1000, round(1000 * h, 5) AS found_per_1000, round(1000 * (c - h), 5) + 0 AS missed_per_1000, round(1000 * (r * 4000 + 50 + (c - h) * 300), 4) AS cost_per_1000, CASE WHEN h > 0 THEN round((r * 4000 + 50 + (c - h) * 300) / h, 4) END AS cost_per_found FROM s""")
def policies(t):
    d = E.screening_policies(scored(t), "y", "p", [0.2, 0.4, 0.6], 4000.0, 50.0, 300.0)
    return d.select("threshold", *[F.round(c, 5).alias(c) for c in ("referred_per_1000", "found_per_1000", "missed_per_1000")], *[F.round(c, 4).alias(c) for c in ("cost_per_1000", "cost_per_found")])


@query("evl06_gray_zone", f"""
WITH {SQL}, s AS (SELECT p, sum(y) AS a, count(*) - sum(y) AS b FROM d GROUP BY 1), c AS (SELECT p, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS pp, sum(b) OVER () AS nn FROM s WINDOW w AS (ORDER BY p DESC)),
z AS (SELECT coalesce(max(p) FILTER (tp >= (0.9 - 1e-12) * pp), min(p)) AS a, coalesce(min(p) FILTER (nn - fp >= (0.9 - 1e-12) * nn), max(p)) AS b FROM c)
SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*)::BIGINT AS n, round(avg((p BETWEEN least(a, b) AND greatest(a, b))::INT), 6) AS inside FROM d, z GROUP BY 1, 2""")
def gray(t):
    return rounded(E.gray_zone(scored(t), "y", "p"))


@query("evl06_gray_zone_limits")
def gray_limits(t):
    return rounded(E.gray_zone_limits(scored(t), "y", "p", n=200, seed=3))


@query("evl06_matched_triage", f"""
WITH {SQL}, r AS (SELECT *, (x > 50000)::INT AS rater, l_suppkey % 7 AS grp FROM d), k AS (SELECT count(*) FILTER (y = 0 AND rater = 1) AS k FROM r),
n AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS i FROM r WHERE y = 0), h AS (SELECT CASE WHEN k = 0 THEN (SELECT max(p) FROM n) + 1e-9 ELSE (SELECT p FROM n WHERE i = k) END AS threshold FROM k)
SELECT grp, count(*)::BIGINT AS n_cases, threshold, round(avg(1 - rater), 6) AS rater_missed, round(avg((p < threshold)::INT), 6) AS model_missed FROM r, h WHERE y = 1 GROUP BY 1, 3""")
def triage(t):
    d = scored(t).withColumn("rater", (F.col("x") > 50000).cast("int")).withColumn("grp", F.col("l_suppkey") % 7)
    return rounded(E.matched_triage(d, "y", "p", "rater", "grp"))


TERMS = ["tax", "discount", "quantity"]


@query("evl10_shapley_gap", """
WITH r AS (SELECT p_brand AS brand, l_linestatus AS g, l_extendedprice AS x, l_tax AS t, l_discount AS d, l_quantity AS q FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT * FROM (SELECT unnest([0, 1]) AS tax), (SELECT unnest([0, 1]) AS discount), (SELECT unnest([0, 1]) AS quantity)),
v AS (SELECT brand, tax, discount, quantity, avg(y) FILTER (g = 'F') - avg(y) FILTER (g = 'O') AS v FROM (SELECT *, x / (1 + tax * t) * (1 - discount * d) / (CASE quantity WHEN 1 THEN q ELSE 1 END) AS y FROM r, s) GROUP BY 1, 2, 3, 4),
u AS (SELECT brand, unnest(['tax', 'discount', 'quantity']) AS term, tax, discount, quantity, v FROM v), f AS (SELECT *, CASE term WHEN 'tax' THEN tax WHEN 'discount' THEN discount ELSE quantity END AS own, tax + discount + quantity AS k FROM u),
j AS (SELECT a.brand, a.term, a.k, a.v - b.v AS c, CASE a.k WHEN 1 THEN 1 / 6::DOUBLE ELSE 1 / 3::DOUBLE END AS w FROM f a JOIN f b ON a.brand = b.brand AND a.term = b.term AND a.own = 0 AND b.own = 1 AND b.k = a.k + 1 AND (a.tax = b.tax OR a.term = 'tax') AND (a.discount = b.discount OR a.term = 'discount') AND (a.quantity = b.quantity OR a.term = 'quantity'))
SELECT j.brand, term, round(sum(w * c), 4) + 0 AS closed_mean, round(sqrt(greatest(sum(w * c * c) - pow(sum(w * c), 2), 0)), 2) AS closed_sd, round(sum(w * c) / any_value(v.v), 6) + 0 AS share_of_raw FROM j JOIN v ON v.brand = j.brand AND tax + discount + quantity = 0 GROUP BY 1, 2""")
def shapley(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    def price(m):
        x = F.col("l_extendedprice") / (1 + F.col("l_tax")) if m & 1 else F.col("l_extendedprice")
        x = x * (1 - F.col("l_discount")) if m & 2 else x
        return x / F.col("l_quantity") if m & 4 else x
    gap = lambda m: F.avg(F.when(F.col("l_linestatus") == "F", price(m))) - F.avg(F.when(F.col("l_linestatus") == "O", price(m)))
    g = d.groupBy(F.col("p_brand").alias("brand")).agg(*[gap(m).alias(f"v{m}") for m in range(8)])
    subsets = F.array(*[F.struct(*[F.lit(bool(m >> i & 1)).alias(c) for i, c in enumerate(TERMS)], F.col(f"v{m}").alias("v")) for m in range(8)])
    s = E.shapley_gap(g.select("brand", F.inline(subsets)), TERMS, "v", ["brand"])
    return s.select("brand", "term", (F.round("closed_mean", 4) + 0).alias("closed_mean"), F.round("closed_sd", 2).alias("closed_sd"), (F.round("share_of_raw", 6) + 0).alias("share_of_raw"))


@query("evl19_ieee_grade", """
WITH s AS (SELECT l_linestatus AS g, count(*)::BIGINT AS n, avg(abs(100 * l_discount + l_quantity / 5 - 10)) AS m FROM lineitem GROUP BY 1)
SELECT g, n, round(m, 6) AS mad, CASE WHEN m <= 5 THEN 'A' WHEN m <= 6 THEN 'B' WHEN m <= 7 THEN 'C' ELSE 'D' END AS grade FROM s""")
def ieee(t):
    d = t.lineitem.select(F.col("l_linestatus").alias("g"), F.lit(10.0).alias("r"), (100 * F.col("l_discount") + F.col("l_quantity") / 5).alias("e"))
    return rounded(E.ieee_grade(d, "r", "e", ["g"]))


@query("evl20_deferral_curve", f"""
WITH {SQL}, o AS (SELECT l_orderkey, max(y) AS y, round(avg(p), 6) AS p, round(avg(q), 6) AS u FROM d GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY u, l_orderkey) AS k, count(*) OVER () AS n FROM o), c AS (SELECT unnest([0.5, 0.8, 1.0]::DOUBLE[]) AS coverage),
r AS (SELECT coverage, y, p, u FROM k, c WHERE k <= greatest(round_even(n * coverage, 0), 1)), a AS (SELECT *, rank() OVER (PARTITION BY coverage ORDER BY p) + (count(*) OVER (PARTITION BY coverage, p) - 1) / 2.0::DOUBLE AS rk FROM r)
SELECT coverage, count(*)::BIGINT AS n_kept, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(u), 6) AS mean_uncertainty, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y))), 6) AS auroc FROM a GROUP BY 1""")
def deferral(t):
    d = scored(t).groupBy("l_orderkey").agg(F.max("y").alias("y"), F.round(F.avg("p"), 6).alias("p"), F.round(F.avg("q"), 6).alias("u"))
    return rounded(E.deferral_curve(d, "y", "p", "u", [0.5, 0.8, 1.0], "l_orderkey"))


@query("evl20_exclusion_elasticity", """
WITH s AS (SELECT l_returnflag, count(*)::BIGINT AS n, avg((l_quantity > 10)::INT) AS a, avg((l_quantity > 20)::INT) AS b, avg((l_quantity > 40)::INT) AS c FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round(a, 6) AS excluded_0, round(b, 6) AS excluded_1, round(c, 6) AS excluded_2, round((c - a) / (2 * ln(2)), 6) AS elasticity, round(greatest(a, b, c) - least(a, b, c), 6) AS range FROM s""")
def elasticity(t):
    return rounded(E.exclusion_elasticity(t.lineitem, "l_quantity", [10, 20, 40], ["l_returnflag"]))


@query("evl21_axis_summary", """
WITH c AS (SELECT p_brand, p_type, avg(l_discount) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), a AS (SELECT *, unnest(list_distinct(string_split(p_type, ' '))) AS axis FROM c), n AS (SELECT p_brand, count(*) AS n, sum(v) AS t FROM c GROUP BY 1), w AS (SELECT p_brand, axis, count(*) AS k, sum(v) AS s FROM a GROUP BY 1, 2)
SELECT p_brand, axis, k::BIGINT AS n_with, (n - k)::BIGINT AS n_without, round(s / k, 8) AS mean_with, CASE WHEN n > k THEN round((t - s) / (n - k), 8) END AS mean_without FROM w JOIN n USING (p_brand)""")
def axes(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_type").agg(F.avg("l_discount").alias("v"))
    return rounded(E.axis_summary(d.withColumn("axes", F.split("p_type", " ")), "axes", "v", ["p_brand"]), 8)


@query("evl21_shift_loss", """
WITH c AS (SELECT p_type, round(avg(l_tax), 6) AS a, round(avg(l_discount), 6) AS b FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, p_type), u AS (SELECT p_type AS stratum, a, b FROM c UNION ALL SELECT 'pooled', a, b FROM c),
r AS (SELECT stratum, rank() OVER (PARTITION BY stratum ORDER BY a) + (count(*) OVER (PARTITION BY stratum, a) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY stratum ORDER BY b) + (count(*) OVER (PARTITION BY stratum, b) - 1) / 2.0::DOUBLE AS y FROM u)
SELECT stratum, count(*)::BIGINT AS n_cells, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 5) + 0 END AS spearman_rho FROM r GROUP BY 1""")
def shift_loss(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_type").agg(F.round(F.avg("l_tax"), 6).alias("a"), F.round(F.avg("l_discount"), 6).alias("b"))
    return rounded(E.shift_loss_correlation(d, "a", "b", "p_type").drop("p"), 5)
