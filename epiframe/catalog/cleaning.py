"""NRM: projections, filters and scalar cleaning."""

from pyspark.sql import functions as F

from ..functions import cleaning as N
from .registry import query, rounded


@query("nrm01_normalize_name", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS drug, regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') AS device,
       lower(split_part(p_name, ' ', 2)) AS firm FROM part""")
def names(t):
    label = F.concat(F.col("p_name"), F.lit(" Hydrochloride (USP) 5.5 mg/mL, tablets"))
    first = F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(" sodium and "), F.element_at(F.split("p_name", " "), 2), F.lit(" 10 mg vial"))
    firm = F.concat(F.upper(F.element_at(F.split("p_name", " "), 2)), F.lit(", Inc. & Co.™ L.L.C."))
    return t.part.withColumn("_l", label).select("p_partkey", N.drug_key(first).alias("drug"), N.device_name_key(F.col("p_brand")).alias("device"),
                                                 N.firm_key(firm).alias("firm"))


@query("nrm02_classify_text", """
SELECT page_id, CASE WHEN regexp_matches(url, '/fr/') THEN 'french' WHEN regexp_matches(url, '/en/') THEN 'english' ELSE 'other' END AS first_match,
  CASE WHEN regexp_matches(url, '^https') THEN 'secure' WHEN regexp_matches(url, '[?]') THEN 'query' ELSE 'plain' END AS last_match FROM pages""")
def classify(t):
    u = F.col("url")
    return t.pages.select("page_id", N.classify_text(u, [("/fr/", "french"), ("/en/", "english")], "other").alias("first_match"),
                          N.classify_text(u, [("[?]", "query"), ("^https", "secure")], "plain", last_wins=True).alias("last_match"))


@query("nrm03_common_unit", """
SELECT p_partkey, CASE WHEN f * p_size BETWEEN 0 AND 40 THEN round(f * p_size, 6) END AS years FROM (
 SELECT *, CASE p_type WHEN 'SMALL' THEN 1/12::DOUBLE WHEN 'LARGE' THEN 1::DOUBLE WHEN 'PROMO' THEN 10::DOUBLE END AS f FROM part)""")
def units(t):
    y = N.to_common_unit(F.col("p_size"), F.col("p_type"), {"SMALL": 1 / 12, "LARGE": 1.0, "PROMO": 10.0}, 0, 40)
    return rounded(t.part.select("p_partkey", y.alias("years")))


@query("nrm03_guessed_unit", """
SELECT l_returnflag, round(sum(CASE WHEN m > 20 THEN l_quantity / 60 ELSE l_quantity END), 4) AS flow,
       round(sum(CASE WHEN d < 1 THEN l_discount * 1000 ELSE l_discount END), 4) AS volume
FROM lineitem, (SELECT quantile_cont(l_quantity, 0.5) AS m, quantile_cont(l_discount, 0.5) AS d FROM lineitem) GROUP BY 1""")
def guessed(t):
    d = N.guess_unit(t.lineitem.select("l_returnflag", "l_quantity", "l_discount"), {"l_quantity": (">", 20.0, 1 / 60), "l_discount": ("<", 1.0, 1000.0)})
    return rounded(d.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("flow"), F.sum("l_discount").alias("volume")), 4)


@query("nrm04_parse_tokens", """
SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1), '') AS lang,
       TRY_CAST(nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS BIGINT) AS number FROM pages""")
def tokens(t):
    got = N.parse_tokens(F.col("url"), "/([a-z]{2})/([0-9]+)", {"lang": (1, "string"), "number": (2, "bigint")})
    return t.pages.select("page_id", got.alias("g")).select("page_id", "g.*")


@query("nrm05_band", """
SELECT CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 'low' WHEN l_quantity >= 10 AND l_quantity < 30 THEN 'mid' WHEN l_quantity >= 45 THEN NULL
  WHEN l_quantity >= 30 THEN 'high' END AS quantity_band, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def bands(t):
    b = N.band(F.col("l_quantity"), [0, 10, 30, 45], ["low", "mid", "high"])
    return t.lineitem.groupBy(b.alias("quantity_band")).agg(F.count(F.lit(1)).alias("n"))


@query("nrm06_code_flags", """
WITH c AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 9 ELSE 10 END AS v,
   CASE WHEN l_linenumber % 2 = 0 THEN (140 + l_partkey % 500)::VARCHAR ELSE chr((65 + l_suppkey % 20)::INT) || lpad((l_partkey % 100)::VARCHAR, 2, '0') END AS code FROM lineitem),
f AS (SELECT l_orderkey, bool_or(CASE WHEN v = 9 THEN code IN ('196','197','198','199') ELSE code IN ('C77','C78','C79','C80') END) AS metastatic,
   bool_or(CASE WHEN v = 9 THEN starts_with(code, '428') ELSE code = 'I50' END) AS chf,
   bool_or(CASE WHEN v = 9 THEN TRY_CAST(code AS INT) BETWEEN 140 AND 172 OR TRY_CAST(code AS INT) BETWEEN 174 AND 195 OR TRY_CAST(code AS INT) BETWEEN 200 AND 208
     ELSE regexp_matches(code, '^C(0[0-9]|1[0-9]|2[0-6]|3[0-4]|3[7-9]|4[01]|43|4[5-9]|5[0-8]|6[0-9]|7[0-6]|8[1-5]|88|9[0-7])') END) AS cancer FROM c GROUP BY 1)
SELECT l_orderkey, metastatic, chf, cancer, ((CASE WHEN metastatic THEN 6 ELSE 0 END) + (CASE WHEN chf THEN 1 ELSE 0 END) + (CASE WHEN cancer AND NOT metastatic THEN 2 ELSE 0 END))::INT AS charlson_index
FROM f""")
def flags(t):
    nine = F.col("l_linenumber") % 2 == 0
    old = (140 + F.col("l_partkey") % 500).cast("string")
    new = F.concat(F.char(65 + F.col("l_suppkey") % 20), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"))
    d = t.lineitem.select("l_orderkey", F.when(nine, 9).otherwise(10).alias("v"), F.when(nine, old).otherwise(new).alias("code"))
    groups = {k: N.CHARLSON[k] for k in ("metastatic", "chf", "cancer")}
    return N.code_flags(d, ["l_orderkey"], "code", "v", groups, {"cancer": "metastatic"})


@query("nrm07_plausible", """
SELECT event_type, count(*)::BIGINT AS n FROM events WHERE (event_type = 'view' AND value BETWEEN 5 AND 100)
 OR (event_type = 'click' AND value BETWEEN 0 AND 50) OR (event_type = 'error' AND value BETWEEN 20 AND 500) GROUP BY 1""")
def plausible_rows(t):
    d = N.plausible(t.events, "event_type", "value", {"view": (5, 100), "click": (0, 50), "error": (20, 500)})
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("nrm08_resolve_items", """
SELECT 'ring' AS concept, p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RING') UNION ALL
SELECT 'blue', p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^blue')""")
def resolve(t):
    return N.resolve_items(t.part, "p_partkey", "p_name", {"ring": "RING", "blue": "^blue"})


@query("nrm08_verify_items", """
SELECT concept, m.p_partkey, p_name, CASE WHEN concept = 'none' THEN 'no_dictionary' WHEN p_name IS NULL THEN 'missing_id'
  WHEN (concept = 'ring' AND regexp_matches(p_name, '(?i)ring')) OR (concept = 'blue' AND regexp_matches(p_name, '(?i)^blue')) THEN 'ok' ELSE 'label_mismatch' END AS status
FROM (SELECT DISTINCT CASE l_suppkey % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'blue' ELSE 'none' END AS concept,
      CASE WHEN l_linenumber = 7 THEN -l_partkey - 1 ELSE l_partkey END AS p_partkey FROM lineitem) m LEFT JOIN part p ON p.p_partkey = m.p_partkey""")
def verify(t):
    c = F.when(F.col("l_suppkey") % 3 == 0, "ring").when(F.col("l_suppkey") % 3 == 1, "blue").otherwise("none")
    key = F.when(F.col("l_linenumber") == 7, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey"))
    m = t.lineitem.select(c.alias("concept"), key.alias("p_partkey")).distinct()
    return N.verify_items(m, t.part, "p_partkey", "p_name", {"ring": "ring", "blue": "^blue"})


@query("nrm09_cyclic_features", """
WITH h AS (SELECT event_id, ts, hour(ts) + minute(ts) / 60.0::DOUBLE AS h FROM events)
SELECT event_id, round(sin(2 * pi() * h / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * h / 24), 6) + 0 AS hour_cos,
 CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend, CASE WHEN h >= 19 OR h < 7 THEN 1 ELSE 0 END AS is_night,
 (hour(ts) // 4)::INT AS hour_block, round(CASE WHEN h < 19 THEN h - 7 ELSE h - 31 END, 6) AS hours_from_shift FROM h""")
def clock(t):
    return rounded(t.events.select("event_id", *[c.alias(n) for n, c in N.clock_features(F.col("ts")).items()]))


@query("nrm10_small_cells", """
SELECT p_brand, p_type, CASE WHEN n = 0 OR n >= 10 THEN n END AS n FROM (SELECT p_brand, p_type, count(*)::BIGINT AS n FROM part GROUP BY 1, 2)""")
def small_cells(t):
    return N.suppress_small_cells(t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")), ["n"])


POLICY = {"1-URGENT": ["acute", "flagged"], "2-HIGH": ["flagged"], "5-LOW": ["routine"]}


@query("nrm11_vocabulary", """
SELECT o_custkey, max((o_orderpriority = '1-URGENT')::INT) AS acute, max((o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT) AS flagged,
 max((o_orderpriority = '5-LOW')::INT) AS routine FROM orders GROUP BY 1""")
def vocabulary(t):
    return N.map_vocabulary(t.orders, ["o_custkey"], "o_orderpriority", POLICY)


@query("nrm11_coverage", """
SELECT o_orderpriority, count(*)::BIGINT AS n, o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AS mapped,
 round((SELECT avg((o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'))::INT) FROM orders), 6) AS coverage FROM orders GROUP BY 1""")
def coverage(t):
    return rounded(N.mapping_coverage(t.orders, "o_orderpriority", POLICY))


@query("nrm12_ratio_features", """
SELECT vec_id, round((embedding[1] + embedding[2])::DOUBLE / 2, 5) AS mean,
  round(ln(1 + abs(embedding[3]::DOUBLE)), 6) AS log_third FROM embeddings""")
def ratios(t):
    e = lambda i: F.col("embedding")[i].cast("double")
    a = N.asymmetry(e(0), e(1))
    return t.embeddings.select("vec_id", F.round(a["mean"], 5).alias("mean"), F.round(F.log1p(F.abs(e(2))), 6).alias("log_third"))


@query("nrm12_asymmetry", """
WITH v AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS l, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey, (l + r) / 2 AS mean, round((l - r) / ((l + r) / 2), 6) + 0 AS asymmetry FROM v""")
def asymmetry(t):
    even = F.col("l_linenumber") % 2 == 0
    d = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.when(even, F.col("l_quantity")).otherwise(0)).alias("l"), F.sum(F.when(~even, F.col("l_quantity")).otherwise(0)).alias("r"))
    return rounded(d.select("l_orderkey", *[c.alias(n) for n, c in N.asymmetry(F.col("l"), F.col("r")).items()]))


@query("nrm13_rate_corrections", """
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.3 + l_quantity / 500 AS qt, 0.5 + l_tax * 10 AS rr FROM lineitem),
a AS (SELECT regr_slope(ln(qt), ln(rr)) AS a FROM q)
SELECT count(*)::BIGINT AS n, round(avg(1000 * qt / sqrt(rr)), 5) AS bazett, round(avg(1000 * qt / cbrt(rr)), 5) AS fridericia,
 round(avg(1000 * (qt + 0.154 * (1 - rr))), 5) AS framingham, round(avg(1000 * qt + 1.75 * (60 / rr - 60)), 5) AS hodges,
 round(avg(1000 * qt / pow(rr, a)), 5) AS power FROM q, a""")
def corrections(t):
    d = t.lineitem.select((0.3 + F.col("l_quantity") / 500).alias("qt"), (0.5 + F.col("l_tax") * 10).alias("rr"))
    d = N.rate_corrections(d, "qt", "rr", [*N.RATE_FORMULAS, "power"])
    return rounded(d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in (*N.RATE_FORMULAS, "power")]), 5)
