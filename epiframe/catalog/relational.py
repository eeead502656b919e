"""REL: the relational base."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.joins import asof_join, hash_order
from ..operators.timeseries import ffill_limit, skeleton
from ..plans.ordered import near, quantiles, scan, value_ranks
from .registry import query, rounded


@query("rel01_join_kinds", """
SELECT c.c_mktsegment AS segment, count(*)::BIGINT AS n_rows, count(o.o_orderkey)::BIGINT AS n_orders,
       count(n.n_name)::BIGINT AS n_nations
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'
JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1""")
def join_kinds(t):
    filed = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    d = (t.customer.join(filed, F.col("o_custkey") == F.col("c_custkey"), "left")
         .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")))
    return d.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("o_orderkey").alias("n_orders"), F.count("n_name").alias("n_nations"))


@query("rel02_asof_merge", """
SELECT l.event_id, r.ts AS seen_at, r.value AS seen_value, r.ts IS NULL AS missing
FROM (SELECT * FROM events WHERE event_type = 'purchase') l
LEFT JOIN LATERAL (SELECT ts, value FROM events e WHERE e.event_type = 'view' AND e.user_id = l.user_id AND e.ts <= l.ts
                   ORDER BY ts DESC, event_id LIMIT 1) r ON true""")
def asof_merge(t):
    left = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'view'").select(
        "user_id", F.col("ts").alias("seen_at"), F.col("value").alias("seen_value"), F.col("event_id").alias("seen_id"))
    out = asof_join(left, right, ["user_id"], "ts", "seen_at", width=86400.0, tie=["seen_id"])
    return out.select("event_id", "seen_at", "seen_value", "missing")


@query("rel03_search_join", """
SELECT e.event_id, (SELECT count(*) FROM events b WHERE b.event_type = 'error' AND b.user_id = e.user_id AND b.ts <= e.ts)::BIGINT AS position
FROM events e WHERE e.event_type = 'view'""")
def search_join(t):
    line = t.events.filter("event_type IN ('view', 'error')").select("event_id", "user_id", "ts", "event_type")
    line = line.withColumn("_first", F.when(F.col("event_type") == "error", 0).otherwise(1))
    d = scan(line, ["user_id"], "ts", {"position": ("count", F.when(F.col("event_type") == "error", 1))},
             width=86400.0, tie=["_first", "event_id"])
    return d.filter("event_type = 'view'").select("event_id", "position")


@query("rel04_union", """
SELECT side, nation, count(*)::BIGINT AS n, round(sum(balance), 2) AS balance FROM (
  SELECT 'customer' AS side, c_nationkey AS nation, c_acctbal AS balance FROM customer
  UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier) GROUP BY 1, 2""")
def union(t):
    c = t.customer.select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = t.supplier.select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    d = c.unionByName(s, allowMissingColumns=True).groupBy("side", "nation")
    return rounded(d.agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("balance")), 2)


@query("rel05_membership", """
SELECT c_nationkey AS nation, count(*)::BIGINT AS n FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000) GROUP BY 1""")
def membership(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    large = t.orders.filter("o_orderstatus = 'P' AND o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    d = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(urgent, "c_custkey", "left_semi")
    return d.join(large, "c_custkey", "left_anti").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("rel06_group_aggregate", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty,
  round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2""")
def group_aggregate(t):
    d = t.lineitem.filter(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("count_order"))


@query("rel07_distinct", """
SELECT p_brand, count(DISTINCT p_type)::BIGINT AS n_types, count(DISTINCT l_suppkey)::BIGINT AS n_suppliers,
       count(DISTINCT l_orderkey)::BIGINT AS n_orders
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def distinct(t):
    # one pass per counted column, each pre-aggregated to distinct pairs, instead of one expanded pass
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    parts = [d.select("p_brand", c).distinct().groupBy("p_brand").agg(F.count(c).alias(n))
             for c, n in (("p_type", "n_types"), ("l_suppkey", "n_suppliers"), ("l_orderkey", "n_orders"))]
    return parts[0].join(parts[1], "p_brand").join(parts[2], "p_brand")


@query("rel08_pivot", """
SELECT o_orderpriority, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS f, (count(*) FILTER (o_orderstatus = 'O'))::BIGINT AS o,
       (count(*) FILTER (o_orderstatus = 'P'))::BIGINT AS p FROM orders GROUP BY 1""")
def pivot(t):
    d = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return d.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("rel09_unpivot", """
SELECT measure, l_returnflag, round(avg(x), 6) AS mean FROM (
  SELECT l_returnflag, 'discount' AS measure, l_discount AS x FROM lineitem UNION ALL
  SELECT l_returnflag, 'tax', l_tax FROM lineitem UNION ALL SELECT l_returnflag, 'quantity', l_quantity FROM lineitem) GROUP BY 1, 2""")
def unpivot(t):
    d = t.lineitem.select("l_returnflag", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("quantity"))
    long = d.unpivot("l_returnflag", ["discount", "tax", "quantity"], "measure", "x")
    return rounded(long.groupBy("measure", "l_returnflag").agg(F.avg("x").alias("mean")))


@query("rel10_explode", """
SELECT lang, word, count(*)::BIGINT AS n FROM (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY 1, 2""")
def explode(t):
    d = t.documents.select("lang", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return d.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query("rel11_top_per_group", """
SELECT c_nationkey, c_custkey, c_acctbal FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3""")
def top_per_group(t):
    # the bounded collection keeps three rows per group and task, so no group is sorted whole
    spot = F.struct((-F.col("c_acctbal")).alias("o"), "c_custkey", "c_acctbal")
    part = t.customer.withColumn("_p", F.pmod(F.xxhash64("c_custkey"), F.lit(64))).select("c_nationkey", "_p", spot.alias("s"))
    local = part.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey", "_p").orderBy("s"))).filter("r <= 3")
    best = local.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("s"))).filter("r <= 3")
    return best.select("c_nationkey", "s.c_custkey", "s.c_acctbal")


@query("rel12_row_number", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS visit_no FROM orders""")
def row_number(t):
    d = scan(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate",
             {"visit_no": ("row_number", None)}, width=180 * 86400.0, tie=["o_orderkey"])
    return d.drop("o_orderdate")


@query("rel13_rank_average", """
SELECT p_partkey, round(rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0, 1)::DOUBLE AS size_rank
FROM part""")
def rank_average(t):
    ranks = value_ranks(t.part, ["p_type"], "p_size", width=10.0).select("p_type", "p_size", "rank")
    return t.part.join(ranks, ["p_type", "p_size"]).select("p_partkey", F.col("rank").alias("size_rank"))


@query("rel14_lag_lead", """
SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, round(value - lag(value) OVER w, 6) AS change
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_lead(t):
    d = scan(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts",
             {"before": ("lag", "value"), "after": ("lead", "value")}, width=86400.0, tie=["event_id"])
    return d.select("event_id", "before", "after", F.round(F.col("value") - F.col("before"), 6).alias("change"))


@query("rel15_running", """
SELECT event_id, round(sum(value) OVER w, 4) AS running_sum, max(value) OVER w AS running_max,
       round(exp(sum(ln(1 + value / 1000)) OVER w), 6) AS running_product
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running(t):
    d = scan(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts",
             {"running_sum": ("sum", "value"), "running_max": ("max", "value"), "_log": ("sum", F.log1p(F.col("value") / 1000))},
             width=86400.0, tie=["event_id"])
    return d.select("event_id", F.round("running_sum", 4).alias("running_sum"), "running_max",
                    F.round(F.exp("_log"), 6).alias("running_product"))


@query("rel16_rolling", """
WITH d AS (SELECT event_type, (date_diff('day', TIMESTAMP '2024-01-01', ts))::BIGINT AS day, count(*)::BIGINT AS n FROM events GROUP BY 1, 2),
g AS (SELECT t.event_type, k.day, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT event_type FROM d) t CROSS JOIN (SELECT unnest(range(31)) AS day) k
      LEFT JOIN d ON d.event_type = t.event_type AND d.day = k.day)
SELECT event_type, day, CASE WHEN count(*) OVER w >= 7 THEN round(avg(n) OVER w, 6) END AS week_mean FROM g
WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling(t):
    day = F.datediff("ts", F.lit("2024-01-01")).cast("bigint").alias("day")
    n = t.events.groupBy("event_type", day).agg(F.count(F.lit(1)).alias("n"))
    grid = skeleton(n.select("event_type").distinct(), ["event_type"], "day", 0, 30).join(n, ["event_type", "day"], "left").fillna(0, ["n"])
    d = near(grid, ["event_type"], "day", 6, 0, 4096, {"_m": F.avg("n"), "_c": F.count("n")})
    return d.select("event_type", "day", F.when(F.col("_c") >= 7, F.round("_m", 6)).alias("week_mean"))


@query("rel17_fill_reindex", """
WITH d AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts)::BIGINT AS day, max(value) AS v FROM events GROUP BY 1, 2),
g AS (SELECT u.user_id, k.day, d.v FROM (SELECT DISTINCT user_id FROM d) u CROSS JOIN (SELECT unnest(range(31)) AS day) k
      LEFT JOIN d ON d.user_id = u.user_id AND d.day = k.day)
SELECT user_id, day, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v FROM g""")
def fill_reindex(t):
    day = F.datediff("ts", F.lit("2024-01-01")).cast("bigint").alias("day")
    d = t.events.groupBy("user_id", day).agg(F.max("value").alias("v"))
    grid = skeleton(d.select("user_id").distinct(), ["user_id"], "day", 0, 30).join(d, ["user_id", "day"], "left")
    return ffill_limit(grid, ["user_id"], "day", ["v"], 3)


@query("rel18_cut_quantile", """
WITH b AS (SELECT CASE WHEN l_quantity < 10 THEN '0-10' WHEN l_quantity < 25 THEN '10-25' ELSE '25+' END AS band, l_extendedprice AS x FROM lineitem)
SELECT band, count(*)::BIGINT AS n, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.9), 4) AS p90 FROM b GROUP BY 1""")
def cut_quantile(t):
    q = F.col("l_quantity")
    d = t.lineitem.select(F.when(q < 10, "0-10").when(q < 25, "10-25").otherwise("25+").alias("band"), F.col("l_extendedprice").alias("x"))
    n = d.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.join(quantiles(d, ["band"], "x", {"median": 0.5, "p90": 0.9}, width=2000.0), "band"), 4)


@query("rel19_case_map", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'mid' ELSE 'low' END AS grade,
       sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END)::BIGINT AS n_large, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def case_map(t):
    grades = F.create_map(*[F.lit(x) for x in ("1-URGENT", "high", "2-HIGH", "high", "3-MEDIUM", "mid")])
    d = t.orders.groupBy(F.coalesce(grades[F.col("o_orderpriority")], F.lit("low")).alias("grade"))
    return d.agg(F.sum(F.when(F.col("o_totalprice") > 250000, 1).otherwise(0)).alias("n_large"), F.count(F.lit(1)).alias("n"))


@query("rel20_regex", """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS page, regexp_matches(url, '[?&]page=') AS paged
FROM pages WHERE regexp_matches(url, 'example\\.(com|org)')""".replace("\\\\", "\\"))
def regex(t):
    u = F.col("url")
    return t.pages.filter(u.rlike(r"example\.(com|org)")).select(
        F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"), F.regexp_replace(u, "[?#].*$", "").alias("page"),
        u.rlike("[?&]page=").alias("paged"))


@query("rel21_periods", """
SELECT (extract(year FROM o_orderdate) * 4 + extract(quarter FROM o_orderdate) - 1 - 2004 * 4)::BIGINT AS quarter_index,
       strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*)::BIGINT AS n,
       max(date_diff('day', o_orderdate, TIMESTAMP '2001-12-31'))::BIGINT AS max_age_days FROM orders GROUP BY 1, 2""")
def periods(t):
    o = F.col("o_orderdate")
    q = (F.year(o) * 4 + F.quarter(o) - 1 - 2004 * 4).cast("bigint").alias("quarter_index")
    return t.orders.groupBy(q, F.date_format(F.trunc(o, "month"), "yyyy-MM-dd").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.datediff(F.lit("2001-12-31"), o)).cast("bigint").alias("max_age_days"))


@query("rel22_json", """
SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def json_field(t):
    d = t.events.select("event_type", F.from_json("props", "k BIGINT")["k"].alias("k"))
    return d.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("rel23_correlation", """
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1""")
def correlation(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@query("rel24_seeded_sample")
def seeded_sample(t):
    d = t.orders.withColumn("_h", hash_order("o_orderkey", seed=7))
    return d.filter(F.pmod("_h", F.lit(100)) < 10).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("rel25_named_steps", """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1),
seg AS (SELECT c_mktsegment, avg(s) AS m FROM spend JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c.c_mktsegment, count(*)::BIGINT AS n_above FROM spend JOIN customer c ON o_custkey = c.c_custkey
JOIN seg ON seg.c_mktsegment = c.c_mktsegment WHERE s > m GROUP BY 1""")
def named_steps(t):
    spend = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s")).join(
        t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    mean = spend.groupBy("c_mktsegment").agg(F.avg("s").alias("m"))
    return spend.join(mean, "c_mktsegment").filter("s > m").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_above"))
