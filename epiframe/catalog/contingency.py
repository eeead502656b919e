"""AGG01-AGG09: contingency tables and reporting associations."""

from pyspark.sql import functions as F

from ..operators import contingency as C
from ..plans.spread import spread
from .registry import query, rounded


def brands(t):
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", F.col("p_brand").alias("brand"))


def returns(t):
    return t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("flag"))


PAIRS = """L AS (SELECT DISTINCT l_orderkey, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey), R AS (SELECT DISTINCT l_orderkey, l_returnflag AS flag FROM lineitem)"""
CELLS = f"""{PAIRS}, nn AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem), ml AS (SELECT brand, count(*) AS l FROM L GROUP BY 1), mr AS (SELECT flag, count(*) AS r FROM R GROUP BY 1),
ab AS (SELECT brand, flag, count(*) AS a FROM L JOIN R USING (l_orderkey) GROUP BY 1, 2),
cells AS (SELECT brand, flag, a::BIGINT AS a, (l - a)::BIGINT AS b, (r - a)::BIGINT AS c, (n - l - r + a)::BIGINT AS d FROM ab JOIN ml USING (brand) JOIN mr USING (flag), nn)"""


def cells(t, min_a=1):
    return C.two_by_two(brands(t), returns(t), "l_orderkey", "brand", "flag", min_a)


@query("agg01_two_by_two", f"WITH {CELLS} SELECT * FROM cells")
def table(t):
    return cells(t)


MEASURES = """x AS (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5::DOUBLE ELSE 0 END AS k FROM cells), y AS (SELECT brand, flag, a AS a0, b AS b0, c AS c0, d AS d0, a + k AS a, b + k AS b, c + k AS c, d + k AS d FROM x),
z AS (SELECT *, a + b + c + d AS n, ln(a * d / (b * c)) AS lr, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se, (a / (a + b)) / (c / (c + d)) AS prr, sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) AS sp,
   (a + b) * (a + c) / (a + b + c + d) AS ea, (a0 + b0)::DOUBLE * (a0 + c0) / (a0 + b0 + c0 + d0) AS e FROM y),
m AS (SELECT *, pow(greatest(abs(a - ea) - least(0.5, abs(a - ea)), 0), 2) * (1 / ea + 1 / (a + b - ea) + 1 / (a + c - ea) + 1 / (n - a - b - c + ea)) AS chi2, log2((a0 + 0.5::DOUBLE) / (e + 0.5::DOUBLE)) AS ic FROM z)"""


@query("agg02_disproportionality", f"""
WITH {CELLS}, {MEASURES} SELECT brand, flag, a0 AS a, b0 AS b, c0 AS c, d0 AS d, round(exp(lr), 6) AS ror, round(exp(lr - 1.96::DOUBLE * se), 6) AS ror025, round(exp(lr + 1.96::DOUBLE * se), 6) AS ror975,
 round(prr, 6) AS prr, round(exp(ln(prr) - 1.96::DOUBLE * sp), 6) AS prr025, round(exp(ln(prr) + 1.96::DOUBLE * sp), 6) AS prr975, round(chi2, 5) AS chi2, round(e, 6) AS expected, round(ic, 6) + 0 AS ic,
 round(ic - 1.96::DOUBLE / sqrt(a0 + 0.5::DOUBLE), 6) + 0 AS ic025, round(ic + 1.96::DOUBLE / sqrt(a0 + 0.5::DOUBLE), 6) + 0 AS ic975, prr >= 2 AND chi2 >= 4 AND a0 >= 3 AS evans FROM m""")
def measures(t):
    d = C.disproportionality(cells(t)).drop("p", "log_ror", "se")
    return rounded(d.withColumn("chi2", F.round("chi2", 5)))


@query("agg02_variants", f"""
WITH {CELLS} SELECT brand, flag, round((a + 0.5::DOUBLE) * (d + 0.5::DOUBLE) / ((b + 0.5::DOUBLE) * (c + 0.5::DOUBLE)), 6) AS ror,
 round(ic - 3.3::DOUBLE / sqrt(a + 0.5::DOUBLE) - 2 / pow(a + 0.5::DOUBLE, 1.5), 6) + 0 AS ic025, round(ic + 2.4::DOUBLE / sqrt(a + 0.5::DOUBLE) - 0.5::DOUBLE / pow(a + 0.5::DOUBLE, 1.5), 6) + 0 AS ic975
FROM (SELECT *, log2((a + 0.5::DOUBLE) / ((a + b)::DOUBLE * (a + c) / (a + b + c + d) + 0.5::DOUBLE)) AS ic FROM cells)""")
def variants(t):
    return rounded(C.disproportionality(cells(t), "always", "powers").select("brand", "flag", "ror", "ic025", "ic975"))


@query("agg02_gamma_bounds")
def gamma_bounds(t):
    return rounded(C.disproportionality(cells(t), "zero_cell", "gamma").select("brand", "flag", "ic", "ic025", "ic975", "p"))


STRATA = """k AS (SELECT p_brand AS brand, l_returnflag AS flag, o_orderpriority AS stratum, count(*)::BIGINT AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)"""


@query("agg03_stratified_expected", f"""
WITH {STRATA}, l AS (SELECT stratum, brand, sum(n) AS l FROM k GROUP BY 1, 2), r AS (SELECT stratum, flag, sum(n) AS r FROM k GROUP BY 1, 2), s AS (SELECT stratum, sum(n) AS s FROM k GROUP BY 1),
e AS (SELECT brand, flag, sum(l.l * r.r / s.s::DOUBLE) AS e FROM l JOIN r USING (stratum) JOIN s USING (stratum) GROUP BY 1, 2), o AS (SELECT brand, flag, sum(n)::BIGINT AS o FROM k GROUP BY 1, 2)
SELECT brand, flag, o AS observed, round(e, 6) AS expected, round(o / e, 6) AS ratio FROM o JOIN e USING (brand, flag)""")
def expected(t):
    d = (t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
         .groupBy(F.col("p_brand").alias("brand"), F.col("l_returnflag").alias("flag"), F.col("o_orderpriority").alias("stratum")).agg(F.count(F.lit(1)).alias("n")))
    return rounded(C.stratified_expected(d, "brand", "flag", "stratum"))


BY_LEVEL = """L AS (SELECT DISTINCT l_orderkey, o_orderpriority AS level, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
R AS (SELECT DISTINCT l_orderkey, o_orderpriority AS level, l_returnflag AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey), nn AS (SELECT level, count(DISTINCT l_orderkey) AS n FROM R GROUP BY 1),
ml AS (SELECT level, brand, count(*) AS l FROM L GROUP BY 1, 2), mr AS (SELECT level, flag, count(*) AS r FROM R GROUP BY 1, 2), ab AS (SELECT level, brand, flag, count(*) AS a FROM L JOIN R USING (l_orderkey, level) GROUP BY 1, 2, 3),
cells AS (SELECT level, brand, flag, a, l - a AS b, r - a AS c, n - l - r + a AS d FROM ab JOIN ml USING (level, brand) JOIN mr USING (level, flag) JOIN nn USING (level))"""


def level_cells(t):
    n = t.lineitem.count()
    o = spread(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("level")), "o_orderkey", rows=n)
    put = lambda d: spread(d, "l_orderkey", rows=n).join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return C.two_by_two(put(brands(t)), put(returns(t)), "l_orderkey", "brand", "flag", 1, ["level"])


@query("agg04_mantel_haenszel", f"""
WITH {BY_LEVEL} SELECT brand, flag, count(*)::BIGINT AS n_strata, sum(a)::BIGINT AS a, round(sum(a * d / (a + b + c + d)::DOUBLE) / sum(b * c / (a + b + c + d)::DOUBLE), 6) AS mh_ror FROM cells GROUP BY 1, 2""")
def pooled(t):
    return rounded(C.mantel_haenszel(level_cells(t), ["brand", "flag"]))


ROR = "ln((a + z) * (d + z) / ((b + z) * (c + z))) AS lr, sqrt(1 / (a + z) + 1 / (b + z) + 1 / (c + z) + 1 / (d + z)) AS se FROM (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS z FROM cells)"


@query("agg05_ratio_of_ratios", f"""
WITH {BY_LEVEL}, m AS (SELECT level, brand, flag, {ROR}), j AS (SELECT x.brand, x.flag, x.lr AS la, y.lr AS lb, x.lr - y.lr AS dl, sqrt(x.se * x.se + y.se * y.se) AS s FROM m x JOIN m y ON x.brand = y.brand AND x.flag = y.flag AND x.level = '1-URGENT' AND y.level = '5-LOW')
SELECT brand, flag, round(exp(la), 6) AS ror_a, round(exp(lb), 6) AS ror_b, round(exp(dl), 6) AS ratio, round(exp(dl - 1.96::DOUBLE * s), 6) AS ratio025, round(exp(dl + 1.96::DOUBLE * s), 6) AS ratio975, sign(la) * sign(lb) < 0 AS discordant FROM j""")
def ratios(t):
    return rounded(C.ratio_of_ratios(level_cells(t), ["brand", "flag"], "level", "1-URGENT", "5-LOW").drop("p"))


@query("agg05_discordance", f"""
WITH {BY_LEVEL}, m AS (SELECT level, brand, flag, {ROR}), s AS (SELECT brand, flag, count(*)::BIGINT AS n_levels, (count(*) FILTER (exp(lr - 1.96::DOUBLE * se) > 1))::BIGINT AS n_signal FROM m GROUP BY 1, 2)
SELECT *, n_signal > 0 AND n_signal < n_levels AS discordant FROM s""")
def discordant(t):
    return C.discordance(level_cells(t), ["brand", "flag"], "level")


TRI = f"""{PAIRS}, ni AS (SELECT brand, count(*) AS k FROM L GROUP BY 1), ne AS (SELECT flag, count(*) AS ne FROM R GROUP BY 1), ab AS (SELECT x.brand AS item_a, y.brand AS item_b, count(*) AS nab FROM L x JOIN L y ON x.l_orderkey = y.l_orderkey AND x.brand < y.brand GROUP BY 1, 2 HAVING count(*) >= 40),
abe AS (SELECT x.brand AS item_a, y.brand AS item_b, flag, count(*) AS nabe FROM L x JOIN L y ON x.l_orderkey = y.l_orderkey AND x.brand < y.brand JOIN R ON R.l_orderkey = x.l_orderkey GROUP BY 1, 2, 3 HAVING count(*) >= 3),
ie AS (SELECT brand, flag, count(*) AS k FROM L JOIN R USING (l_orderkey) GROUP BY 1, 2), nn AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem),
j AS (SELECT abe.item_a, abe.item_b, abe.flag, nabe, nab, ne, ia.k AS na, ib.k AS nb, ea.k AS nae, eb.k AS nbe, n FROM abe JOIN ab USING (item_a, item_b) JOIN ne USING (flag) JOIN ni ia ON ia.brand = item_a JOIN ni ib ON ib.brand = item_b
  JOIN ie ea ON ea.brand = item_a AND ea.flag = abe.flag JOIN ie eb ON eb.brand = item_b AND eb.flag = abe.flag, nn),
tri AS (SELECT item_a, item_b, flag, nabe AS n111, nab - nabe AS n110, nae - nabe AS n101, na - nab - nae + nabe AS n100, nbe - nabe AS n011, nb - nab - nbe + nabe AS n010, ne - nae - nbe + nabe AS n001, n - na - nb - ne + nab + nae + nbe - nabe AS n000 FROM j)"""


def triples(t):
    return C.three_way(brands(t), returns(t), "l_orderkey", "brand", "flag", 40, 3)


@query("agg06_three_way", f"WITH {TRI} SELECT * FROM tri")
def three(t):
    return triples(t)


@query("agg07_interaction_scores", f"""
WITH {TRI}, f AS (SELECT *, n101 / (n101 + n100)::DOUBLE AS f10, n011 / (n011 + n010)::DOUBLE AS f01, n001 / (n001 + n000)::DOUBLE AS f00, CASE WHEN least(n111, n110, n101, n100, n011, n010, n001, n000) = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS z FROM tri),
g AS (SELECT *, (n111 + n110) * least(greatest(1 - (1 - f10) * (1 - f01) / greatest(1 - f00, 1e-12), 0), 1) AS e,
 ln((n111 + z) * (n000 + z) / ((n110 + z) * (n001 + z))) AS l11, ln((n101 + z) * (n000 + z) / ((n100 + z) * (n001 + z))) AS l10, ln((n011 + z) * (n000 + z) / ((n010 + z) * (n001 + z))) AS l01 FROM f)
SELECT item_a, item_b, flag, round(e, 5) AS expected, round(log2((n111 + 0.5::DOUBLE) / (e + 0.5::DOUBLE)), 6) + 0 AS omega,
 round(log2((n111 + 0.5::DOUBLE) / (e + 0.5::DOUBLE)) - 3.3::DOUBLE / sqrt(n111 + 0.5::DOUBLE) - 2 / pow(n111 + 0.5::DOUBLE, 1.5), 6) + 0 AS omega025, round(exp(l11 - l10 - l01), 6) AS ior, round(exp(l11) - exp(l10) - exp(l01) + 1, 5) + 0 AS reri FROM g""")
def interactions(t):
    d = C.interaction_scores(triples(t)).select("item_a", "item_b", "flag", F.round("expected", 5).alias("expected"), "omega", "omega025", "ior", F.round("reri", 5).alias("reri"))
    return rounded(d)


def quarter():
    return (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("bigint").alias("q")


@query("agg08_cumulative_tables", """
WITH o AS (SELECT o_orderkey, (extract(year FROM o_orderdate) * 4 + extract(quarter FROM o_orderdate) - 1)::BIGINT AS q FROM orders), li AS (SELECT * FROM lineitem JOIN o ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
L AS (SELECT DISTINCT l_orderkey, q, p_type AS kind FROM li), R AS (SELECT DISTINCT l_orderkey, q, l_returnflag AS flag FROM li), qs AS (SELECT unnest(range((SELECT min(q) FROM L), (SELECT max(q) + 1 FROM L))) AS q),
a AS (SELECT kind, flag, q, count(*) AS k FROM L JOIN R USING (l_orderkey, q) GROUP BY 1, 2, 3), p AS (SELECT DISTINCT kind, flag FROM a),
f AS (SELECT kind, flag, qs.q, (SELECT coalesce(sum(k), 0) FROM a WHERE a.kind = p.kind AND a.flag = p.flag AND a.q <= qs.q) AS a, (SELECT count(*) FROM L WHERE L.kind = p.kind AND L.q <= qs.q) AS l,
   (SELECT count(*) FROM R WHERE R.flag = p.flag AND R.q <= qs.q) AS r, (SELECT count(DISTINCT l_orderkey) FROM L WHERE L.q <= qs.q) AS n FROM p CROSS JOIN qs)
SELECT kind, flag, q, a::BIGINT AS a, (l - a)::BIGINT AS b, (r - a)::BIGINT AS c, (n - l - r + a)::BIGINT AS d FROM f""")
def cumulative(t):
    o = t.orders.select("o_orderkey", quarter())
    li = t.lineitem.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return C.cumulative_tables(li.withColumnRenamed("p_type", "kind"), li.withColumnRenamed("l_returnflag", "flag"), "l_orderkey", "kind", "flag", "q", 3)


@query("agg09_ebgm")
def shrunk(t):
    d = C.disproportionality(C.two_by_two(t.lineitem.select("l_orderkey", "l_suppkey"), returns(t), "l_orderkey", "l_suppkey", "flag"))
    return rounded(C.ebgm(d.select("l_suppkey", "flag", "a", "expected")), 4)


@query("agg09_fitted_prior")
def fitted(t):
    d = C.disproportionality(C.two_by_two(t.lineitem.select("l_orderkey", "l_suppkey"), returns(t), "l_orderkey", "l_suppkey", "flag"))
    d = d.select("l_suppkey", "flag", "a", "expected")
    return rounded(C.ebgm(d, C.fit_gamma_poisson_prior(d)), 3)
