"""AGG10-AGG30: p values, rates, agreement, effects and composition."""

from pyspark.sql import functions as F

from ..functions.stats import two_sided_p
from ..operators import summaries as M
from ..plans.spread import spread
from .registry import query, rounded

N = lambda name="n": F.count(F.lit(1)).alias(name)

PV = """s AS (SELECT p_brand, p_type, avg(l_quantity) AS m, count(*) AS k FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
pv AS (SELECT p_brand, p_type, exp(-abs(m - 25.5) * sqrt(k) / 10) AS p FROM s)"""


def pvalues(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_type").agg(F.avg("l_quantity").alias("m"), N("k"))
    return d.select("p_brand", "p_type", F.exp(-F.abs(F.col("m") - 25.5) * F.sqrt("k") / 10).alias("p"))


@query("agg10_bh", f"""
WITH {PV}, r AS (SELECT *, p * count(*) OVER (PARTITION BY p_type) / row_number() OVER (PARTITION BY p_type ORDER BY p, p_brand) AS v, row_number() OVER (PARTITION BY p_type ORDER BY p, p_brand) AS rk FROM pv)
SELECT p_brand, p_type, round(p, 8) AS p, round(least(min(v) OVER (PARTITION BY p_type ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS p_adjusted FROM r""")
def bh(t):
    d = M.adjust_pvalues(pvalues(t), "p", ["p_brand"], ["p_type"])
    return d.select("p_brand", "p_type", F.round("p", 8).alias("p"), F.round("p_adjusted", 6).alias("p_adjusted"))


@query("agg10_holm", f"""
WITH {PV}, r AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, p_brand, p_type) + 1) AS v, row_number() OVER (ORDER BY p, p_brand, p_type) AS rk FROM pv)
SELECT p_brand, p_type, round(least(max(v) OVER (ORDER BY rk), 1), 6) AS p_adjusted, least(max(v) OVER (ORDER BY rk), 1) <= 0.05 AS significant FROM r""")
def holm(t):
    d = M.adjust_pvalues(pvalues(t), "p", ["p_brand", "p_type"], [], "holm", 0.05)
    return d.select("p_brand", "p_type", F.round("p_adjusted", 6).alias("p_adjusted"), "significant")


@query("agg10_combine")
def combined(t):
    return rounded(M.combine_pvalues(pvalues(t), "p", ["p_type"]))


@query("agg11_proportions", """
WITH g AS (SELECT o_orderpriority, count(*) FILTER (o_totalprice > 300000) AS k, count(*) AS n FROM orders GROUP BY 1), z AS (SELECT 1.959963984540054::DOUBLE AS z),
w AS (SELECT *, k / n::DOUBLE AS p, 1 + z * z / n AS dn FROM g, z), c AS (SELECT *, (p + z * z / (2 * n)) / dn AS c, z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n)) / dn AS h FROM w)
SELECT o_orderpriority, k::BIGINT AS k, n::BIGINT AS n, round(10000 * p, 5) AS rate, round(10000 * (c - h), 5) AS low, round(10000 * (c + h), 5) AS high,
 round(p / (SELECT p FROM c WHERE o_orderpriority = '5-LOW'), 6) AS risk_ratio FROM c""")
def proportions(t):
    d = M.proportion_table(t.orders, ["o_orderpriority"], F.col("o_totalprice") > 300000, {"o_orderpriority": "5-LOW"}, 10000.0)
    return d.select("o_orderpriority", "k", "n", *[F.round(c, 5).alias(c) for c in ("rate", "low", "high")], F.round("risk_ratio", 6).alias("risk_ratio"))


RATES = """rates AS (SELECT c_nationkey, c_mktsegment, count(DISTINCT o_orderkey)::BIGINT AS n, count(DISTINCT c_custkey) AS e FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)"""


def rates(t, exact=False):
    o = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    j = o.join(t.customer, "c_custkey")
    n = j.groupBy("c_nationkey", "c_mktsegment").agg(N())
    e = j.select("c_nationkey", "c_mktsegment", "c_custkey").distinct().groupBy("c_nationkey", "c_mktsegment").agg(N("e"))
    return M.exposure_rates(n, e, ["c_nationkey", "c_mktsegment"], "n", "e", 1000.0, exact)


@query("agg12_exposure_rates", f"WITH {RATES} SELECT c_nationkey, c_mktsegment, n, e::BIGINT AS e, round(1000.0::DOUBLE * n / e, 6) AS rate FROM rates")
def exposure(t):
    return rounded(rates(t))


@query("agg12_exact_limits")
def exact_limits(t):
    return rounded(rates(t, True))


@query("agg12_rate_ratio", f"""
WITH {RATES}, j AS (SELECT a.c_nationkey, a.n::DOUBLE AS na, a.e::DOUBLE AS ea, b.n::DOUBLE AS nb, b.e::DOUBLE AS eb FROM rates a JOIN rates b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'MACHINERY'),
r AS (SELECT *, (na / ea) / (nb / eb) AS r, sqrt(1 / greatest(na, 0.5) + 1 / greatest(nb, 0.5)) AS se FROM j)
SELECT c_nationkey, round(na / nb, 6) AS crude_ratio, round(ea / eb, 6) AS exposure_ratio, round(r, 6) AS rate_ratio, round(exp(ln(r) - 1.96::DOUBLE * se), 6) AS ratio_lo, round(exp(ln(r) + 1.96::DOUBLE * se), 6) AS ratio_hi FROM r""")
def ratio(t):
    return rounded(M.rate_ratio(rates(t), ["c_nationkey"], "c_mktsegment", "BUILDING", "MACHINERY", "n", "e"))


@query("agg12_standardised", f"""
WITH {RATES} SELECT c_nationkey, round(1000 * sum(n / e::DOUBLE * CASE c_mktsegment WHEN 'BUILDING' THEN 0.5::DOUBLE WHEN 'MACHINERY' THEN 0.3::DOUBLE WHEN 'FURNITURE' THEN 0.2::DOUBLE END), 5) AS standardised,
 round(1000 * sum(n) / sum(e)::DOUBLE, 5) AS crude FROM rates GROUP BY 1""")
def standardised(t):
    d = M.standardised_rate(rates(t), ["c_nationkey"], "c_mktsegment", "n", "e", {"BUILDING": 5.0, "MACHINERY": 3.0, "FURNITURE": 2.0}, 1000.0)
    return rounded(d, 5)


@query("agg13_weighted_persons", """
SELECT c_mktsegment, c_nationkey, count(*)::BIGINT AS n_persons, round(sum(c_acctbal), 2) AS weighted FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1, 2""")
def persons(t):
    ev = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rounded(M.weighted_persons(ev, t.customer, "c_custkey", "c_acctbal", ["c_mktsegment", "c_nationkey"]), 2)


@query("agg14_profile_divergence", """
WITH i AS (SELECT l_returnflag AS g, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('R', 'A')), v AS (SELECT p_name, count(*) AS n, count(*) FILTER (g = 'R') AS a, count(*) FILTER (g = 'A') AS b FROM i GROUP BY 1 ORDER BY n DESC, p_name LIMIT 30),
s AS (SELECT a / (sum(a) OVER ())::DOUBLE AS p, b / (sum(b) OVER ())::DOUBLE AS q FROM v)
SELECT count(*)::BIGINT AS n_items, round(0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 8) AS divergence FROM s""")
def divergence(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return rounded(M.profile_divergence(d, "l_returnflag", "R", "A", "p_name", 30), 8)


@query("agg14_profile_permutation")
def permuted_profile(t):
    n = t.lineitem.count()
    o = spread(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", rows=n)
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_name")
    d = spread(d, "l_orderkey", rows=n).join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return rounded(M.profile_permutation(d, "l_orderkey", "o_orderpriority", "1-URGENT", "5-LOW", "p_name", 30, 19, 1), 8)


@query("agg15_group_quantiles", """
SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, avg((value IS NULL)::INT)::DOUBLE AS missing_share, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median,
 round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY 1""")
def grouped_quantiles(t):
    return rounded(M.group_quantiles(t.events, ["event_type"], "value", 25.0))


@query("agg16_capture_recapture", """
WITH g AS (SELECT lang, count(*) FILTER (regexp_matches(text, '[0-9]')) AS x, count(*) FILTER (n_chars > 1000) AS y, count(*) FILTER (regexp_matches(text, '[0-9]') AND n_chars > 1000) AS m FROM documents GROUP BY 1)
SELECT lang, x::BIGINT AS n1, y::BIGINT AS n2, m::BIGINT AS m, round((x + 1) * (y + 1) / (m + 1)::DOUBLE - 1, 5) AS chapman, round(sqrt(greatest((x + 1)::DOUBLE * (y + 1) * (x - m) * (y - m) / ((m + 1)::DOUBLE * (m + 1) * (m + 2)), 0)), 5) AS chapman_se,
 CASE WHEN m > 0 THEN round(x * y / m::DOUBLE, 5) END AS lincoln, CASE WHEN m > 0 THEN round(sqrt(x::DOUBLE * y * (x - m) * (y - m) / (m::DOUBLE * m * m)), 5) END AS lincoln_se FROM g""")
def capture(t):
    return rounded(M.capture_recapture(t.documents, ["lang"], F.col("text").rlike("[0-9]"), F.col("n_chars") > 1000), 5)


CODED = """c AS (SELECT user_id, event_type, CASE WHEN value < 30 THEN 'view' WHEN value < 60 THEN 'click' WHEN value < 120 THEN 'purchase' ELSE 'error' END AS guess, event_id FROM events)"""


def coded(t):
    v = F.col("value")
    return t.events.withColumn("guess", F.when(v < 30, "view").when(v < 60, "click").when(v < 120, "purchase").otherwise("error"))


@query("agg17_agreement", f"""
WITH {CODED}, n AS (SELECT user_id % 5 AS stratum, event_type AS a, guess AS b, count(*) AS n FROM c GROUP BY 1, 2, 3), ma AS (SELECT stratum, a AS k, sum(n) AS na FROM n GROUP BY 1, 2), mb AS (SELECT stratum, b AS k, sum(n) AS nb FROM n GROUP BY 1, 2),
pe AS (SELECT stratum, sum(coalesce(na, 0) * coalesce(nb, 0)) AS pe, count(*) AS c FROM ma FULL JOIN mb USING (stratum, k) GROUP BY 1), g AS (SELECT stratum, sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS ok FROM n GROUP BY 1)
SELECT stratum, n::BIGINT AS n, round(ok / n::DOUBLE, 6) AS accuracy, round((ok / n::DOUBLE - pe / (n::DOUBLE * n)) / (1 - pe / (n::DOUBLE * n)), 6) AS kappa, round((c * ok / n::DOUBLE - 1) / (c - 1), 6) AS pabak FROM g JOIN pe USING (stratum)""")
def agreements(t):
    return rounded(M.agreement(coded(t).withColumn("stratum", F.col("user_id") % 5), "event_type", "guess", ["stratum"]))


@query("agg17_class_scores", f"""
WITH {CODED}, l AS (SELECT event_type AS label FROM c UNION SELECT guess FROM c), s AS (SELECT label, (SELECT count(*) FROM c WHERE event_type = label) AS s, (SELECT count(*) FROM c WHERE guess = label) AS k, (SELECT count(*) FROM c WHERE guess = label AND event_type = label) AS h FROM l)
SELECT label, s::BIGINT AS support, CASE WHEN s > 0 THEN round(h / s::DOUBLE, 6) END AS recall, CASE WHEN k > 0 THEN round(h / k::DOUBLE, 6) END AS precision, round(2 * h / (s + k)::DOUBLE, 6) AS f1, round(h / (s + k - h)::DOUBLE, 6) AS jaccard FROM s""")
def classes(t):
    return rounded(M.class_scores(coded(t), "event_type", "guess"))


@query("agg18_set_overlap", """
WITH m AS (SELECT DISTINCT p_brand, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT p_brand, count(*) AS n FROM m GROUP BY 1),
i AS (SELECT a.p_brand AS set_a, b.p_brand AS set_b, count(*) AS i FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2)
SELECT set_a, set_b, i::BIGINT AS intersection, (x.n + y.n - i)::BIGINT AS "union", round(i / (x.n + y.n - i)::DOUBLE, 6) AS jaccard FROM i JOIN n x ON x.p_brand = set_a JOIN n y ON y.p_brand = set_b""")
def overlaps(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return rounded(M.set_overlap(d, "p_brand", "l_orderkey"))


@query("agg19_eta_squared", """
WITH t AS (SELECT avg(l_extendedprice) AS mu, var_pop(l_extendedprice) * count(*) AS sst FROM lineitem),
a AS (SELECT l_returnflag, avg(l_extendedprice) AS ma, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_linestatus, avg(l_extendedprice) AS mb, count(*) AS n FROM lineitem GROUP BY 1),
ab AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT 'l_returnflag' AS term, round(sum(n * (ma - mu) * (ma - mu)) / min(sst), 8) AS eta2, count(*)::BIGINT AS n_levels FROM a, t UNION ALL
SELECT 'l_linestatus', round(sum(n * (mb - mu) * (mb - mu)) / min(sst), 8), count(*) FROM b, t UNION ALL
SELECT 'l_returnflag:l_linestatus', round(sum(ab.n * pow(m - ma - mb + mu, 2)) / min(sst), 8), count(*) FROM ab JOIN a USING (l_returnflag) JOIN b USING (l_linestatus), t""")
def eta(t):
    return rounded(M.eta_squared(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus"], True), 8)


@query("agg20_icc", """
WITH d AS (SELECT user_id AS s, event_type AS r, avg(value) AS x FROM events GROUP BY 1, 2), f AS (SELECT s FROM d GROUP BY 1 HAVING count(*) = 5), y AS (SELECT d.* FROM d JOIN f USING (s)),
m AS (SELECT count(DISTINCT s)::DOUBLE AS k, 5.0::DOUBLE AS r, avg(x) AS g, sum(x * x) AS q, count(*)::DOUBLE AS n FROM y),
b AS (SELECT sum(5 * ms * ms) AS b FROM (SELECT avg(x) AS ms FROM y GROUP BY s)), c AS (SELECT sum(k * mr * mr) AS c FROM (SELECT avg(x) AS mr, count(*) AS k FROM y GROUP BY r)),
v AS (SELECT k, r, (b - n * g * g) / (k - 1) AS msr, (q - b) / (n - k) AS msw, (c - n * g * g) / (r - 1) AS msc, (q - b - c + n * g * g) / ((k - 1) * (r - 1)) AS mse FROM m, b, c)
SELECT k::BIGINT AS n_subjects, round(greatest((msr - msw) / r, 0) / (greatest((msr - msw) / r, 0) + msw), 6) AS icc1, round((msr - mse) / (msr + (r - 1) * mse + r * (msc - mse) / k), 6) + 0 AS icc2,
 round((msr - mse) / (msr + (r - 1) * mse), 6) + 0 AS icc3, round(sqrt(msw), 6) AS within_sd, round(1.96 * sqrt(2) * sqrt(msw), 5) AS mdc95 FROM v""")
def reliability(t):
    d = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("x"))
    full = d.groupBy("user_id").agg(N("_n")).filter("_n = 5")
    out = M.icc(d.join(full, "user_id", "left_semi"), "user_id", "x", "event_type")
    return out.select("n_subjects", *[F.round(c, 6).alias(c) for c in ("icc1", "icc2", "icc3", "within_sd")], F.round("mdc95", 5).alias("mdc95"))


@query("agg20_twin_heritability", """
WITH p AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'MZ' ELSE 'DZ' END AS z, o_totalprice AS a, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
q AS (SELECT * FROM p WHERE k = 1 AND b IS NOT NULL), d AS (SELECT z, a AS x, b AS y FROM q UNION ALL SELECT z, b, a FROM q), r AS (SELECT z, corr(x, y) AS r FROM d GROUP BY 1)
SELECT round(max(r) FILTER (z = 'MZ'), 6) + 0 AS r_mz, round(max(r) FILTER (z = 'DZ'), 6) + 0 AS r_dz, round(2 * (max(r) FILTER (z = 'MZ') - max(r) FILTER (z = 'DZ')), 6) + 0 AS h2 FROM r""")
def twins(t):
    from ..operators.joins import within_group_pairs
    pr = within_group_pairs(t.orders.withColumn("m", F.struct("o_orderkey", "o_totalprice")), ["o_custkey"], "o_orderdate", "m", "first_two")
    z = F.when(F.col("o_custkey") % 2 == 0, "MZ").otherwise("DZ")
    d = pr.select(z.alias("z"), F.col("a.o_totalprice").alias("a"), F.col("b.o_totalprice").alias("b"))
    return rounded(M.twin_heritability(d, "z", "a", "b", "MZ", "DZ"))


@query("agg21_bland_altman", """
SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(x - y), 6) + 0 AS bias, round(stddev_samp(x - y), 6) AS sd, round(avg(x - y) - 1.96::DOUBLE * stddev_samp(x - y), 5) AS lower, round(avg(x - y) + 1.96::DOUBLE * stddev_samp(x - y), 5) AS upper,
 round(100 * 1.96::DOUBLE * stddev_samp(x - y) / ((avg(x) + avg(y)) / 2), 4) AS percentage_error, round(2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + pow(avg(x) - avg(y), 2)), 6) + 0 AS ccc
FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 2000 AS y FROM lineitem) GROUP BY 1""")
def bland(t):
    d = M.bland_altman(t.lineitem.withColumn("y", F.col("l_extendedprice") / 2000), "l_quantity", "y", ["l_returnflag"])
    digits = {"lower": 5, "upper": 5, "percentage_error": 4}
    return d.select("l_returnflag", "n", *[F.round(c, digits.get(c, 6)).alias(c) for c in d.columns[2:]])


@query("agg21_repeated_limits", """
WITH e AS (SELECT l_orderkey AS s, l_quantity - l_extendedprice / 2000 AS d, l_quantity AS x, l_extendedprice / 2000 AS y FROM lineitem), g AS (SELECT s, count(*)::DOUBLE AS n, sum(d) AS sd, sum(d * d) AS q FROM e GROUP BY 1),
t AS (SELECT count(*)::DOUBLE AS k, sum(n) AS nn, sum(sd) AS ss, sum(q) AS q, sum(sd * sd / n) AS b, sum(n * n) AS n2 FROM g), v AS (SELECT (b - ss * ss / nn) / (k - 1) AS msb, (q - b) / (nn - k) AS msw, (nn - n2 / nn) / (k - 1) AS n0 FROM t),
w AS (SELECT sqrt(greatest((msb - msw) / n0, 0) + msw) AS sd FROM v) SELECT (SELECT count(*) FROM e)::BIGINT AS n, round((SELECT avg(d) FROM e), 6) + 0 AS bias, round(sd, 6) AS sd FROM w""")
def repeated(t):
    d = M.bland_altman(t.lineitem.withColumn("y", F.col("l_extendedprice") / 2000), "l_quantity", "y", [], "l_orderkey")
    return rounded(d.select("n", "bias", "sd"))


@query("agg21_four_quadrant", """
WITH l AS (SELECT value - lag(value) OVER w AS a, (event_id % 97) - lag(event_id % 97) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT count(*)::BIGINT AS n, round(avg((a * b > 0)::INT), 6) AS concordance FROM l WHERE a IS NOT NULL AND (abs(a) >= 10 OR abs(b) >= 10)""")
def quadrants(t):
    d = t.events.select("user_id", "event_id", "ts", "value", (F.col("event_id") % 97).alias("b"))
    return rounded(M.four_quadrant(d, ["user_id"], "ts", "value", "b", 10.0, ["event_id"], 86400.0))


@query("agg22_effect_size", """
WITH g AS (SELECT p_brand, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS nx, count(*) FILTER (l_returnflag <> 'R')::DOUBLE AS ny, avg(l_quantity) FILTER (l_returnflag = 'R') AS mx, avg(l_quantity) FILTER (l_returnflag <> 'R') AS my,
  var_samp(l_quantity) FILTER (l_returnflag = 'R') AS vx, var_samp(l_quantity) FILTER (l_returnflag <> 'R') AS vy FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
e AS (SELECT *, (mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)) AS d FROM g), h AS (SELECT *, (1 - 3 / (4 * (nx + ny - 2) - 1)) * d AS g FROM e)
SELECT p_brand, nx::BIGINT AS nx, ny::BIGINT AS ny, round(d, 6) + 0 AS cohen_d, round(g, 6) + 0 AS hedges_g, round((nx + ny) / (nx * ny) + g * g / (2 * (nx + ny)), 8) AS var_g, round((mx - my) / sqrt(vx / nx + vy / ny), 6) + 0 AS welch_t,
 round(pow(vx / nx + vy / ny, 2) / (pow(vx / nx, 2) / (nx - 1) + pow(vy / ny, 2) / (ny - 1)), 4) AS welch_df FROM h""")
def effects(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    d = M.effect_size(d, ["p_brand"], F.col("l_returnflag") == "R", "l_quantity")
    return d.select("p_brand", "nx", "ny", *[F.round(c, 6).alias(c) for c in ("cohen_d", "hedges_g", "welch_t")], F.round("var_g", 8).alias("var_g"), F.round("welch_df", 4).alias("welch_df"))


@query("agg22_smd", """
WITH l AS (SELECT (l_returnflag = 'R')::INT AS a, l_quantity AS q, l_discount AS d, l_tax + 1 AS w FROM lineitem), u AS (SELECT a, w, 'l_quantity' AS covariate, q AS x FROM l UNION ALL SELECT a, w, 'l_discount', d FROM l),
m AS (SELECT covariate, a, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) AS v FROM u GROUP BY 1, 2)
SELECT x.covariate, round(x.m, 6) AS mean_treated, round(y.m, 6) AS mean_control, round((x.m - y.m) / sqrt((x.v + y.v) / 2), 6) + 0 AS smd FROM m x JOIN m y ON x.covariate = y.covariate AND x.a = 1 AND y.a = 0""")
def smd(t):
    d = t.lineitem.withColumn("a", (F.col("l_returnflag") == "R").cast("int")).withColumn("w", F.col("l_tax") + 1)
    return rounded(M.standardised_differences(d, "a", ["l_quantity", "l_discount"], "w"))


@query("agg22_paired_effect", """
SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(d), 7) + 0 AS mean_difference, round(avg(d) / stddev_samp(d), 7) + 0 AS dz, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) + 0 AS t FROM (SELECT l_returnflag, l_discount - l_tax AS d FROM lineitem) GROUP BY 1""")
def paired(t):
    d = M.paired_effect(t.lineitem, "l_discount", "l_tax", ["l_returnflag"])
    return d.select("l_returnflag", "n", F.round("mean_difference", 7).alias("mean_difference"), F.round("dz", 7).alias("dz"), F.round("t", 5).alias("t"))


def brand_effects(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return M.effect_size(d, ["p_brand", "p_type"], F.col("l_returnflag") == "R", "l_quantity").select("p_brand", "p_type", F.col("hedges_g").alias("y"), F.col("var_g").alias("v")).dropna()


EFF = """g AS (SELECT p_brand, p_type, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS nx, count(*) FILTER (l_returnflag <> 'R')::DOUBLE AS ny, avg(l_quantity) FILTER (l_returnflag = 'R') AS mx, avg(l_quantity) FILTER (l_returnflag <> 'R') AS my,
  var_samp(l_quantity) FILTER (l_returnflag = 'R') AS vx, var_samp(l_quantity) FILTER (l_returnflag <> 'R') AS vy FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
h AS (SELECT *, (1 - 3 / (4 * (nx + ny - 2) - 1)) * (mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)) AS y FROM g), eff AS (SELECT p_brand, p_type, y, (nx + ny) / (nx * ny) + y * y / (2 * (nx + ny)) AS v FROM h WHERE nx >= 2 AND ny >= 2)"""


@query("agg23_pool_effects", f"""
WITH {EFF}, a AS (SELECT p_type, count(*)::BIGINT AS k, sum(1 / v) AS w, sum(1 / (v * v)) AS w2, sum(y / v) AS wy, sum(y * y / v) AS wyy FROM eff GROUP BY 1),
b AS (SELECT *, greatest(wyy - wy * wy / w, 0) AS q FROM a), c AS (SELECT *, greatest((q - (k - 1)) / (w - w2 / w), 0) AS tau2, greatest(100 * (q - (k - 1)) / q, 0) AS i2 FROM b),
r AS (SELECT c.p_type, sum(1 / (v + tau2)) AS rw, sum(y / (v + tau2)) AS rwy FROM eff JOIN c USING (p_type) GROUP BY 1)
SELECT c.p_type, k, round(wy / w, 6) + 0 AS fixed, round(sqrt(1 / w), 6) AS fixed_se, round(q, 5) AS q, round(tau2, 7) AS tau2, round(i2, 4) AS i2, round(rwy / rw, 6) + 0 AS random, round(sqrt(1 / rw), 6) AS random_se,
 round(rwy / rw - 1.959963984540054::DOUBLE * sqrt(1 / rw), 6) + 0 AS low, round(rwy / rw + 1.959963984540054::DOUBLE * sqrt(1 / rw), 6) + 0 AS high FROM c JOIN r USING (p_type)""")
def pooled(t):
    d = M.pool_effects(brand_effects(t), "y", "v", ["p_type"])
    digits = {"q": 5, "tau2": 7, "i2": 4}
    return d.select("p_type", "k", *[(F.round(c, digits.get(c, 6)) + 0.0).alias(c) for c in d.columns[2:]])


@query("agg23_hartung_knapp")
def hartung(t):
    return rounded(M.pool_effects(brand_effects(t), "y", "v", ["p_type"], True).select("p_type", "k", "random", "random_se", "low", "high"))


@query("agg23_leave_one_out", f"""
WITH {EFF}, s AS (SELECT p_brand || '/' || p_type AS study, y, v FROM eff), t AS (SELECT sum(1 / v) AS w, sum(y / v) AS wy FROM s) SELECT study, round((wy - y / v) / (w - 1 / v), 8) + 0 AS fixed_without FROM s, t""")
def without(t):
    d = brand_effects(t).select(F.concat_ws("/", "p_brand", "p_type").alias("study"), "y", "v")
    return rounded(M.leave_one_out(d, "y", "v", "study"), 8)


@query("agg23_egger", f"""
WITH {EFF} SELECT p_type, count(*)::BIGINT AS k, round(regr_intercept(y / sqrt(v), 1 / sqrt(v)), 6) + 0 AS intercept FROM eff GROUP BY 1""")
def asymmetry(t):
    return rounded(M.egger(brand_effects(t), "y", "v", ["p_type"]).drop("p"))


BULK = """m AS (SELECT p_type, count(DISTINCT l_orderkey) AS members FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 50),
bulk AS (SELECT p_type, p_brand, members::BIGINT AS members, s / members AS level FROM (SELECT p_type, p_brand, sum(l_quantity) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) JOIN m USING (p_type))"""


def bulk(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return M.pseudobulk(d, "p_type", "p_brand", "l_quantity", "l_orderkey", 50)


@query("agg24_pseudobulk", f"WITH {BULK} SELECT p_type, p_brand, members, round(level, 6) AS level, round(level / sum(level) OVER (PARTITION BY p_brand), 6) AS specificity FROM bulk")
def specific(t):
    return rounded(M.specificity(bulk(t), "p_type", "p_brand", "level"))


@query("agg24_top_share", f"""
WITH {BULK}, s AS (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY level DESC) AS rk, count(*) OVER (PARTITION BY p_type) AS n FROM bulk) SELECT p_type, p_brand, round(level, 6) AS level FROM s WHERE rk <= ceil(n * 0.2)""")
def top(t):
    return rounded(M.top_share(bulk(t), ["p_type"], "level", 0.2).select("p_type", "p_brand", "level"))


@query("agg24_roll_up", f"""
WITH {BULK} SELECT CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'size' ELSE 'grade' END AS parent, p_brand, round(sum(level * members) / sum(members), 6) AS level FROM bulk GROUP BY 1, 2""")
def rolled(t):
    up = {"SMALL": "size", "MEDIUM": "size", "LARGE": "size", "STANDARD": "grade", "ECONOMY": "grade", "PROMO": "grade"}
    return rounded(M.roll_up(bulk(t), up, "p_type", "p_brand", "level", "members"))


@query("agg25_composition", """
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT p_brand, sum(n) AS t, sum(ln(1 + n)) AS l FROM c GROUP BY 1 HAVING sum(n) >= 10), k AS (SELECT count(DISTINCT p_type) AS k FROM c)
SELECT p_brand, p_type, n::BIGINT AS n, round(n / t::DOUBLE, 6) AS share, round(ln(1 + n) - l / k, 6) + 0 AS clr, round(-sum(n / t::DOUBLE * ln(n / t::DOUBLE)) OVER (PARTITION BY p_brand) / ln(k), 6) AS evenness FROM c JOIN t USING (p_brand), k""")
def mix(t):
    return rounded(M.composition(t.part, "p_brand", "p_type", 10))


SERIES = "s AS (SELECT event_type, date_trunc('day', ts) AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)"


def series(t):
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))


@query("agg26_corr_matrix", f"""
WITH {SERIES} SELECT a.event_type AS a, b.event_type AS b, count(*)::BIGINT AS n, round(corr(a.n, b.n), 6) + 0 AS r, round(atanh(corr(a.n, b.n)), 6) + 0 AS z FROM s a JOIN s b ON a.day = b.day AND a.event_type < b.event_type GROUP BY 1, 2""")
def correlations(t):
    return rounded(M.corr_matrix(series(t), "event_type", "day", "n"))


@query("agg26_spearman", f"""
WITH {SERIES}, k AS (SELECT event_type, day, rank() OVER (PARTITION BY event_type ORDER BY n) + (count(*) OVER (PARTITION BY event_type, n) - 1) / 2.0::DOUBLE AS n FROM s)
SELECT a.event_type AS a, b.event_type AS b, round(corr(a.n, b.n), 6) + 0 AS r FROM k a JOIN k b ON a.day = b.day AND a.event_type < b.event_type GROUP BY 1, 2""")
def spearman(t):
    return rounded(M.corr_matrix(series(t), "event_type", "day", "n", "spearman").select("a", "b", "r"))


@query("agg26_corr_with", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(corr(l_discount, l_extendedprice), 6) + 0 AS r FROM lineitem GROUP BY 1, 2")
def edge(t):
    return rounded(M.corr_with(t.lineitem, ["l_returnflag", "l_linestatus"], "l_discount", "l_extendedprice").drop("p"))


@query("agg27_rank_agreement", """
WITH d AS (SELECT c_custkey, round(c_acctbal / 50) AS x, sum(o_totalprice) AS s, round(sum(o_totalprice) / 100000) AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM d), p AS (SELECT sum(sign((a.x - b.x) * (a.y - b.y))) / 2 AS s FROM d a, d b),
t AS (SELECT (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*)::DOUBLE AS k FROM d GROUP BY x)) AS ta, (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*)::DOUBLE AS k FROM d GROUP BY y)) AS tb, (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 FROM d) AS t0)
SELECT (SELECT count(*) FROM d)::BIGINT AS n, round((SELECT corr(rx, ry) FROM r), 6) + 0 AS spearman, round(s / sqrt((t0 - ta) * (t0 - tb)), 6) + 0 AS kendall FROM p, t""")
def ranks(t):
    d = t.customer.join(t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s")), "c_custkey")
    d = d.select(F.round(F.col("c_acctbal") / 50).alias("x"), F.round(F.col("s") / 100000).alias("y"))
    return rounded(M.rank_agreement(d, "x", "y"))


@query("agg27_kendall_w", f"""
WITH {SERIES}, k AS (SELECT event_type, day, rank() OVER (PARTITION BY day ORDER BY n, event_type)::DOUBLE AS rk FROM s), x AS (SELECT event_type, sum(rk) AS t FROM k GROUP BY 1), m AS (SELECT count(DISTINCT day) AS m FROM k)
SELECT max(m)::BIGINT AS m, count(*)::BIGINT AS k, round(12 * var_pop(t) * count(*) / (max(m) * max(m) * (pow(count(*), 3) - count(*))), 6) AS w FROM x, m""")
def judges(t):
    from ..plans.ordered import scan
    k = scan(series(t), ["day"], "n", {"rk": ("row_number", None)}, 1000.0, ["event_type"])
    return rounded(M.kendall_w(k, "event_type", "day", "rk"))


@query("agg27_top_k_overlap", """
WITH a AS (SELECT l_suppkey, sum(l_quantity) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY s DESC, l_suppkey LIMIT 20), b AS (SELECT l_suppkey, sum(l_quantity) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 ORDER BY s DESC, l_suppkey LIMIT 20)
SELECT (count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL))::BIGINT AS common, round(count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) / count(*)::DOUBLE, 6) AS jaccard FROM a FULL JOIN b USING (l_suppkey)""")
def top_lists(t):
    s = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("s"))
    return rounded(M.top_k_overlap(s("R"), s("A"), "l_suppkey", "s", 20))


@query("agg28_mode_with_conflict", """
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority AS mode, count(*) OVER (PARTITION BY o_custkey) > 1 AS conflict FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""")
def modes(t):
    return M.mode_with_conflict(t.orders, ["o_custkey"], "o_orderpriority")


@query("agg29_quantile_strata", """
WITH r AS (SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY c_nationkey ORDER BY -(c_custkey % 101)) + (count(*) OVER (PARTITION BY c_nationkey, c_custkey % 101) - 1) / 2.0::DOUBLE AS b FROM customer)
SELECT c_custkey, c_nationkey, (ntile(3) OVER (PARTITION BY c_nationkey ORDER BY (a + b) / 2, c_custkey))::INT AS stratum FROM r""")
def strata(t):
    d = t.customer.withColumn("m", F.col("c_custkey") % 101)
    return M.quantile_strata(d, ["c_nationkey"], {"c_acctbal": True, "m": False}, 3, "c_custkey")


@query("agg30_collapse_repeats", """
SELECT user_id, round(avg(value), 6) AS value, count(value)::BIGINT AS value_n, round(stddev_samp(value) / sqrt(count(value)), 6) AS value_se, min_by(event_type, (ts, event_id)) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""")
def collapse(t):
    return rounded(M.collapse_repeats(t.events, ["user_id"], {"value": "mean", "event_type": "first", "event_id": "high"}, ["ts", "event_id"]))
