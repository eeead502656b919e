"""MOD: fits as Spark jobs."""

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators.splits import grouped_folds
from .registry import query, rounded

LINES = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, (l_returnflag = 'R')::INT AS y, (l_linestatus = 'F')::INT AS z, l_quantity AS q, l_discount * 10 AS d, l_tax * 10 AS x, l_extendedprice / 1000 AS price, o_orderpriority AS prio FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def lines(t):
    o = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("prio"), "o_custkey")
    d = t.lineitem.join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return d.select("l_orderkey", "l_partkey", "l_suppkey", "o_custkey", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_linestatus") == "F").cast("int").alias("z"),
                    F.col("l_quantity").alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("x"), (F.col("l_extendedprice") / 1000).alias("price"), "prio")


@query("mod01_its_batch")
def its(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    m = d.groupBy("p_brand", ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("month")).agg(F.count("*").alias("n"))
    return rounded(M.its_batch(m, ["p_brand"], "month", "n", F.lit(40)), 3)


def panel(t):
    """Log monthly-quarter sales of suppliers; a third are never treated, the rest start in quarter 8 or 14."""
    step = ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1)
    d = t.lineitem.groupBy("l_suppkey", step.alias("t")).agg(F.sum("l_quantity").alias("n"))
    return d.select("l_suppkey", "t", F.log1p("n").alias("y"), "n", F.when(F.col("l_suppkey") % 3 == 1, 8).when(F.col("l_suppkey") % 3 == 2, 14).alias("cohort"))


PANEL = """p AS (SELECT l_suppkey, (extract(year FROM l_shipdate) - 1995) * 4 + extract(quarter FROM l_shipdate) - 1 AS t, ln(1 + sum(l_quantity)) AS y, CASE l_suppkey % 3 WHEN 1 THEN 8 WHEN 2 THEN 14 END AS c FROM lineitem GROUP BY 1, 2, 4),
gh AS (SELECT g, h FROM (SELECT unnest([8, 14]) AS g), (SELECT unnest([0, 1, 2, 3]) AS h)), dd AS (SELECT gh.g, gh.h, a.c, a.y - b.y AS dy, a.t FROM gh JOIN p a ON a.t = g + h JOIN p b ON b.l_suppkey = a.l_suppkey AND b.t = g - 1),
att AS (SELECT g, h, avg(dy) FILTER (c = g) - avg(dy) FILTER (c IS NULL OR c > t) AS att, count(*) FILTER (c = g) AS n FROM dd GROUP BY 1, 2)"""


@query("mod02_att_group_time", f"WITH {PANEL} SELECT g, h::BIGINT AS h, round(att, 6) AS att, n::BIGINT AS n_treated FROM att")
def att(t):
    d = M.att_group_time(panel(t), "l_suppkey", "t", "y", "cohort", [0, 1, 2, 3])
    return rounded(d.withColumn("h", F.col("h").cast("bigint")))


@query("mod02_dynamic_att", f"WITH {PANEL} SELECT h::BIGINT AS h, round(sum(att * n) / sum(n), 6) AS att, count(*)::BIGINT AS n_cohorts, sum(n)::BIGINT AS n_treated FROM att GROUP BY 1")
def dynamic(t):
    d = M.dynamic_att(M.att_group_time(panel(t), "l_suppkey", "t", "y", "cohort", [0, 1, 2, 3]))
    return rounded(d.withColumn("h", F.col("h").cast("bigint")))


@query("mod03_event_study")
def study(t):
    d = panel(t).withColumn("rel", F.col("t") - F.col("cohort"))
    return rounded(M.event_study(d, "l_suppkey", "t", "n", "rel", -4, 4), 4)


@query("mod04_logit")
def logistic(t):
    return rounded(M.logit(lines(t), "y", ["d", "z", "d:z", "prio"], cluster="l_suppkey", categories={"prio": ["5-LOW", "1-URGENT", "2-HIGH"]}), 4)


@query("mod04_logit_saturated", f"""
WITH {LINES}, c AS (SELECT sum(y * z)::DOUBLE AS a, sum((1 - y) * z)::DOUBLE AS b, sum(y * (1 - z))::DOUBLE AS c, sum((1 - y) * (1 - z))::DOUBLE AS d, count(*) AS n FROM li)
SELECT 'z' AS term, round(ln(a * d / (b * c)), 5) + 0 AS estimate, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 5) AS se, round(a * d / (b * c), 5) AS ratio, n::BIGINT AS n FROM c UNION ALL SELECT 'intercept', round(ln(c / d), 5), round(sqrt(1 / c + 1 / d), 5), round(c / d, 5), n FROM c""")
def saturated(t):
    return rounded(M.logit(lines(t), "y", ["z"]).select("term", "estimate", "se", "ratio", "n"), 5)


@query("mod05_iptw_balance")
def balance(t):
    from ..operators.summaries import standardised_differences
    d = M.iptw(M.propensity(lines(t), "z", ["q", "d", "x"]), "z", "ATE")
    return rounded(standardised_differences(d, "z", ["q", "d", "x"], "weight"), 4)


@query("mod05_domain_weights")
def weights(t):
    d = lines(t)
    w = M.domain_weights(d.filter("z = 0").select("l_suppkey", "q", "d"), d.filter("z = 1").select("q", "d"), ["q", "d"])
    return rounded(M.effective_size(w, "weight", ["l_suppkey"]), 3)


@query("mod06_risk_ratio", f"""
WITH {LINES}, g AS (SELECT prio, sum(y * z * (1 + x)) AS a, sum(y * (1 - z) * (1 + x)) AS c, sum(z * (1 + x)) AS n1, sum((1 - z) * (1 + x)) AS n0 FROM li GROUP BY 1)
SELECT prio, round(a / n1, 6) AS risk_treated, round(c / n0, 6) AS risk_control, round((a / n1) / (c / n0), 6) AS rr, round(sqrt(1 / a - 1 / n1 + 1 / c - 1 / n0), 6) AS se_log_rr,
 round((a / n1) / (c / n0) * exp(-1.96::DOUBLE * sqrt(1 / a - 1 / n1 + 1 / c - 1 / n0)), 6) AS rr_lo, round((a / n1) / (c / n0) * exp(1.96::DOUBLE * sqrt(1 / a - 1 / n1 + 1 / c - 1 / n0)), 6) AS rr_hi, round(a / n1 - c / n0, 6) + 0 AS rd FROM g""")
def risks(t):
    return rounded(M.risk_ratio(lines(t).withColumn("w", 1 + F.col("x")), "y", "z", "w", ["prio"]))


@query("mod06_wald_cace", f"""
WITH {LINES}, c AS (SELECT avg(price) FILTER (z = 1) - avg(price) FILTER (z = 0) AS itt, avg(y) FILTER (z = 1) - avg(y) FILTER (z = 0) AS u FROM li) SELECT round(itt, 6) + 0 AS itt, round(u, 6) + 0 AS uptake, round(itt / u, 4) AS cace FROM c""")
def cace(t):
    d = M.wald_cace(lines(t), "price", "z", "y")
    return d.select(F.round("itt", 6).alias("itt"), F.round("uptake", 6).alias("uptake"), F.round("cace", 4).alias("cace"))


@query("mod07_new_user_cohort", """
WITH e AS (SELECT o_custkey, o_orderkey, o_orderpriority AS drug, o_orderdate AS at_, lag(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS prev FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
k AS (SELECT * FROM e WHERE prev IS NULL OR date_diff('day', prev, at_) > 180), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY at_, o_orderkey, drug) = 1)
SELECT o_custkey, o_orderkey, drug, at_ AS at, (drug = '1-URGENT')::INT AS treated, false AS both_drugs FROM f""")
def new_users(t):
    from ..plans.ordered import scan
    e = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("drug"), F.col("o_orderdate").alias("at"))
    e = scan(e, ["o_custkey", "drug"], "at", {"prev": ("lag", "at")}, 400 * 86400.0, ["o_orderkey"])
    return M.new_user_cohort(e, "o_custkey", "o_orderkey", "drug", "at", "prev", "1-URGENT", "2-HIGH", 180).drop("prev")


@query("mod08_ols", f"""
WITH {LINES}, f AS (SELECT prio, regr_slope(price, q) AS b, regr_intercept(price, q) AS a, avg(q) AS mq, regr_sxx(price, q) AS sxx, count(*)::DOUBLE AS n, regr_r2(price, q) AS r2 FROM li GROUP BY 1),
s AS (SELECT prio, b, a, n, r2, sqrt(sum(pow(price - a - b * q, 2) * pow(q - mq, 2)) / (sxx * sxx) * n / (n - 2)) AS se FROM li JOIN f USING (prio) GROUP BY prio, b, a, n, r2, sxx)
SELECT prio, 'q' AS term, round(b, 5) AS estimate, round(se, 5) AS se, n::BIGINT AS n, round(r2, 6) AS r2 FROM s""")
def least_squares(t):
    d = M.ols(lines(t), "price", ["q"], ["prio"]).filter("term = 'q'").drop("p")
    return d.select("prio", "term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"), "n", F.round("r2", 6).alias("r2"))


@query("mod08_two_stage_ls")
def iv(t):
    return rounded(M.two_stage_ls(lines(t), "price", "q", ["d", "z"], ["x"]), 3)


@query("mod08_local_linear_rd")
def rd(t):
    return rounded(M.local_linear_rd(lines(t), "price", "q", [25.0, 15.0, 35.0], 10.0), 4)


@query("mod09_residualize", f"""
WITH {LINES}, f AS (SELECT regr_slope(price, q) AS b, regr_intercept(price, q) AS a, avg(price) AS m FROM li WHERE z = 0) SELECT prio, round(avg(price - a - b * q + m), 5) AS price_res, round(stddev_samp(price - a - b * q), 5) AS spread FROM li, f GROUP BY 1""")
def residuals(t):
    d = M.residualize(lines(t), ["price"], ["q"], F.col("z") == 0, True)
    return rounded(d.groupBy("prio").agg(F.avg("price_res").alias("price_res"), F.stddev_samp("price_res").alias("spread")), 5)


def vectors(t, n=64):
    return t.embeddings.select("vec_id", "label", (F.col("vec_id") % 3).alias("batch"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


DIMENSIONS = [f"e{i}" for i in range(64)]


def adjusted(d):
    """One row per vector and dimension."""
    values = F.posexplode(F.array(*[F.round(F.col(f"{c}_adj"), 5) + F.lit(0.0) for c in DIMENSIONS])).alias("feature", "adjusted")
    return d.select("vec_id", values)


@query("mod10_combat_plain", """
WITH v AS (SELECT vec_id, vec_id % 3 AS b, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), m AS (SELECT b, i, avg(x) AS mb, count(*)::DOUBLE AS n, var_pop(x) * count(*) AS ss FROM v GROUP BY 1, 2), g AS (SELECT i, sum(n * mb) / sum(n) AS mu, sum(ss) / sum(n) AS vp FROM m GROUP BY 1)
SELECT vec_id, (i - 1)::INT AS feature, round((x - mb) / sqrt(ss / (n - 1)) * sqrt(vp) + mu, 5) + 0 AS adjusted FROM v JOIN m USING (b, i) JOIN g USING (i)""")
def combat_plain(t):
    return adjusted(M.combat(vectors(t), "batch", DIMENSIONS, eb=False))


@query("mod10_combat_eb")
def combat(t):
    return adjusted(M.combat(vectors(t), "batch", DIMENSIONS, ["label"]))


@query("mod11_normative")
def norms(t):
    d = lines(t)
    x = [(F.col("q") - 25) / 25, (F.col("q") - 25) * (F.col("q") - 25) / 625, F.col("z").cast("double")]
    d = M.normative(d.withColumn("site", F.col("l_suppkey") % 5), "price", x, F.col("y") == 0, "site", F.col("y") == 0)
    return rounded(M.extreme_counts(d, ["site"], "z"), 4)


@query("mod11_band_norms", f"""
WITH {LINES}, b AS (SELECT *, CASE WHEN q < 10 THEN 'low' WHEN q < 30 THEN 'mid' ELSE 'high' END AS band FROM li), r AS (SELECT band, avg(price) AS m, sqrt(var_pop(price) * count(*) / (count(*) - 2)) AS sd FROM b WHERE y = 0 GROUP BY 1)
SELECT prio, count(*)::BIGINT AS n, (count(*) FILTER (-(price - m) / sd > 1.5))::BIGINT AS n_high, (count(*) FILTER (-(price - m) / sd < -1.5))::BIGINT AS n_low, round(avg((abs((price - m) / sd) <= 1.5)::INT), 6) AS inside FROM b JOIN r USING (band) GROUP BY 1""")
def bands(t):
    band = F.when(F.col("q") < 10, "low").when(F.col("q") < 30, "mid").otherwise("high")
    return rounded(M.extreme_counts(M.band_norms(lines(t), "price", band, F.col("y") == 0, 2, -1.0), ["prio"], "z", 1.5))


@query("mod12_text_classifier")
def classifier(t):
    d = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left").select("doc_id", "text", "quality", "toxic")
    return rounded(M.text_classifier(d, "doc_id", "text", ["quality", "toxic"], F.col("quality").isNotNull() & (F.col("doc_id") % 4 != 0)), 3)


@query("mod12_svd_classifier")
def svd_classifier(t):
    d = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left").select("doc_id", "text", "quality", "toxic")
    return rounded(M.text_classifier(d, "doc_id", "text", ["quality", "toxic"], F.col("quality").isNotNull() & (F.col("doc_id") % 4 != 0), components=20), 3)


@query("mod12_text_components")
def components(t):
    d, values, converged = M.text_components(t.benchmark, "item_id", "text", 5, n=1)
    shares = F.array(*[F.lit(float(v)) for v in values])
    return rounded(d.select("item_id", F.posexplode("scores").alias("component", "score"), shares.alias("_v"), F.lit(converged).alias("converged")).select("item_id", "component", "score", F.get("_v", F.col("component")).alias("value"), "converged"), 4)


@query("mod12_text_clusters")
def clusters(t):
    d = M.text_clusters(t.conversations.withColumn("row_id", F.concat_ws("-", "conv_id", "turn")), "row_id", "text", 4, 1)
    return d.groupBy("cluster").agg(F.count("*").alias("n"))


@query("mod13_kmeans_states")
def state_ids(t):
    d = vectors(t)
    return M.kmeans_states(d.filter("vec_id % 2 = 0"), d, DIMENSIONS, 6, 1).groupBy("state").agg(F.count("*").alias("n"))


@query("mod14_grouped_cv")
def cv(t):
    d = t.embeddings.withColumn("group", F.col("vec_id") % 50).withColumn("y", F.col("embedding")[0] * 3 + F.col("label") / 10)
    d = M.grouped_cv(grouped_folds(d, "group", 5), "y", "embedding", "fold")
    return rounded(d.groupBy("fold").agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("y") - F.col("prediction")) * (F.col("y") - F.col("prediction")))).alias("rmse")), 4)


@query("mod15_transfer_matrix")
def transfer(t):
    d = t.embeddings.select("embedding", (F.col("vec_id") % 3).alias("domain"), F.pmod(F.xxhash64("vec_id"), F.lit(4)).alias("fold"), (F.col("embedding")[0] * 3 + F.col("label") / 10).alias("y"))
    return rounded(M.transfer_matrix(d, "domain", "fold", "y", "embedding"), 4)


@query("mod16_mediation")
def mediate(t):
    return rounded(M.mediation(lines(t), "z", "q", "price", ["d"], "l_suppkey", 100, 3), 4)


@query("mod16_mediation_rows")
def mediate_rows(t):
    return rounded(M.mediation(lines(t), "z", "q", "price", ["d"], None, 100, 3), 4)


@query("mod17_calibration")
def negative_controls(t):
    from .summaries import brand_effects
    d = brand_effects(t).withColumn("se", F.sqrt("v"))
    return rounded(M.negative_control_calibration(d.filter("p_type <> 'PROMO'"), d.filter("p_type = 'PROMO'"), "y", "se").drop("v"), 3)


@query("mod18_cox_ph")
def cox(t):
    from .survival import tte
    d = tte(t).withColumn("bal", F.col("balance") / 10000).withColumn("built", (F.col("segment") == "BUILDING").cast("int")).withColumn("nation", F.col("key") % 25)
    return rounded(M.cox_ph(d, "duration", "event", ["bal", "built"], cluster="nation"), 4)


@query("mod19_impute_pool")
def impute(t):
    d = lines(t).withColumn("row", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "q", "price"))
    d = d.withColumn("obs", F.when(F.col("l_partkey") % 5 != 0, F.col("price")))
    return rounded(M.impute_pool(d, "row", "obs", "z", ["q"], "delta", [0.0, 0.1, 0.3], 10, 3), 3)
