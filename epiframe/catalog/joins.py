"""JON: interval, nearest, as-of, window and fuzzy joins."""

from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import query, rounded

DAY = 86400.0


def visits(t):
    return t.orders.select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_orderdate").alias("start"),
                           (F.col("o_orderdate") + F.expr("interval 90 days")).alias("end"))


def shipments(t):
    """Ship dates of a customer's lines: (key, ship, n, quantity)."""
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"))
    d = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return d.groupBy("key", F.col("l_shipdate").alias("ship")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


SHIP = """ship AS (SELECT o_custkey AS key, l_shipdate AS ship, count(*)::BIGINT AS n, sum(l_quantity) AS quantity
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)"""


@query("jon01_interval_join", f"""
WITH {SHIP} SELECT s.key, ship, n, quantity, o_orderkey, o_orderdate AS start, o_orderdate + INTERVAL 90 DAY AS "end"
FROM ship s JOIN orders o ON o_custkey = s.key AND ship BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAY
QUALIFY row_number() OVER (PARTITION BY s.key, ship ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def interval(t):
    return J.interval_join(shipments(t), visits(t), ["key"], "ship", "start", "end", 90 * DAY, tie=["o_orderkey"])


@query("jon02_nearest_join", f"""
WITH {SHIP} SELECT o_orderkey, ship, n, (abs(epoch(o_orderdate) - epoch(ship)))::DOUBLE AS gap FROM orders LEFT JOIN ship
ON key = o_custkey AND abs(epoch(o_orderdate) - epoch(ship)) <= 86400 * 30
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(epoch(o_orderdate) - epoch(ship)), ship) = 1""")
def nearest(t):
    left = visits(t).select("key", "o_orderkey", "start")
    d = J.nearest_join(left, shipments(t).drop("quantity"), ["key"], "start", "ship", 30 * DAY, 180 * DAY)
    return d.select("o_orderkey", "ship", "n", "gap")


@query("jon03_asof_join", f"""
WITH {SHIP} SELECT o_orderkey, ship, n, ship IS NULL AS missing FROM orders LEFT JOIN ship
ON key = o_custkey AND ship <= o_orderdate AND epoch(o_orderdate) - epoch(ship) <= 86400 * 60
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY ship DESC NULLS LAST) = 1""")
def asof(t):
    left = visits(t).select("key", "o_orderkey", "start")
    d = J.asof_join(left, shipments(t).drop("quantity"), ["key"], "start", "ship", 60 * DAY, 180 * DAY)
    return d.select("o_orderkey", "ship", "n", "missing")


@query("jon04_pre_post_windows", f"""
WITH {SHIP}, w AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 10 DAY AS b, ship, quantity AS q FROM orders LEFT JOIN ship ON key = o_custkey
  AND ship >= o_orderdate - INTERVAL 120 DAY AND ship < o_orderdate + INTERVAL 130 DAY)
SELECT o_orderkey, (count(q) FILTER (ship < a))::BIGINT AS pre_n, round(avg(q) FILTER (ship < a), 6) AS pre_mean, max(q) FILTER (ship < a) AS pre_max,
 max_by(q, ship) FILTER (ship < a) AS baseline, (count(q) FILTER (ship >= b))::BIGINT AS post_n, round(avg(q) FILTER (ship >= b), 6) AS post_mean,
 max(q) FILTER (ship >= b) AS post_max, count(q) FILTER (ship < a) >= 2 AND count(q) FILTER (ship >= b) >= 2 AS valid FROM w GROUP BY 1""")
def pre_post(t):
    index = visits(t).select("key", "o_orderkey", "start", (F.col("start") + F.expr("interval 10 days")).alias("stop"))
    d = J.pre_post_windows(index, shipments(t), ["key"], "o_orderkey", "start", "stop", "ship", "quantity", 120 * DAY, 120 * DAY, 2, 360 * DAY)
    return rounded(d.drop("key"))


@query("jon05_paired_window", """
WITH p AS (SELECT a.user_id, a.ts AS f, b.ts AS s FROM events a JOIN events b ON b.user_id = a.user_id AND a.event_type = 'view' AND b.event_type = 'error'
   AND b.ts >= a.ts - INTERVAL 6 HOUR AND b.ts <= a.ts + INTERVAL 12 HOUR)
SELECT user_id, least(f, s) AS pair_time FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY f, s) = 1""")
def paired(t):
    a = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("f"))
    b = t.events.filter("event_type = 'error'").select("user_id", F.col("ts").alias("s"))
    return J.paired_window(a, b, ["user_id"], "f", "s", 6 * 3600.0, 12 * 3600.0, "min", DAY)


@query("jon05_repeat_within", """
WITH n AS (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS nx FROM events)
SELECT user_id, min(ts) AS repeat_time FROM n WHERE nx - ts <= INTERVAL 24 HOUR GROUP BY 1""")
def repeats(t):
    return J.repeat_within(t.events, ["user_id"], "event_type", "ts", 24.0, DAY)


@query("jon06_next_within", """
WITH n AS (SELECT o_orderkey, o_orderdate + INTERVAL 2 DAY AS e, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders)
SELECT o_orderkey, coalesce((epoch(nx) - epoch(e)) / 3600 BETWEEN 0 AND 720, false)::INT AS returned FROM n""")
def revisit(t):
    d = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.expr("interval 2 days")).alias("stop"))
    return J.next_within(d, ["o_custkey"], "o_orderdate", "stop", 720.0, 360 * DAY, ["o_orderkey"]).select("o_orderkey", "returned")


@query("jon06_entry_after", """
WITH s AS (SELECT o_custkey AS k, o_orderdate AS a, o_orderdate + INTERVAL 20 DAY AS b FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey, (EXISTS (SELECT 1 FROM s WHERE k = o_custkey AND a >= o_orderdate + INTERVAL 1 DAY AND a <= o_orderdate + INTERVAL 31 DAY)
  AND NOT EXISTS (SELECT 1 FROM s WHERE k = o_custkey AND a <= o_orderdate AND b > o_orderdate) AND o_orderstatus <> 'P')::INT AS unplanned
FROM orders WHERE o_orderpriority <> '1-URGENT'""")
def unplanned(t):
    o = t.orders.withColumnRenamed("o_custkey", "key")
    base = o.filter("o_orderpriority <> '1-URGENT'").select("key", "o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("start"),
                                                             (F.col("o_orderdate") + F.expr("interval 1 day")).alias("stop"))
    stays = o.filter("o_orderpriority = '1-URGENT'").select("key", F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("interval 20 days")).alias("b"))
    d = J.entry_after(base, stays, ["key"], "o_orderkey", "start", "stop", "a", "b", 720.0, F.col("o_orderstatus") == "P", 60 * DAY)
    return d.select("o_orderkey", "unplanned")


@query("jon07_semi_anti", """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
AND EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
def semi_anti(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    returned = o.join(t.lineitem.filter("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    d = J.semi_anti_filter(t.customer, [(o.filter("o_orderpriority = '1-URGENT'"), ["c_custkey"]), (returned, ["c_custkey"])],
                           [(o.filter("o_totalprice > 450000"), ["c_custkey"])])
    return d.select("c_custkey")


FUZZY = """names AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT p_brand, p_name AS r_name, min(p_partkey) AS r_id FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2),
p AS (SELECT a.p_brand, a.p_name, r_id, CASE WHEN a.p_name = r_name THEN 1.0::DOUBLE ELSE greatest(
   0.5 * (1 - levenshtein(a.p_name, r_name) / greatest(length(a.p_name), length(r_name))::DOUBLE)
   + 0.5 * len(list_intersect(string_split(a.p_name, ' '), string_split(r_name, ' ')))::DOUBLE
        / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(r_name, ' ')))),
   CASE WHEN (starts_with(a.p_name, r_name) OR starts_with(r_name, a.p_name)) AND least(length(a.p_name), length(r_name)) >= 5 THEN 0.9::DOUBLE ELSE 0 END) END AS score
  FROM names a JOIN r USING (p_brand)),
best AS (SELECT * FROM p WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY score DESC, r_id) = 1)"""


@query("jon08_fuzzy_block", f"""
WITH {FUZZY} SELECT p.p_partkey AS l_id, best.r_id, round(best.score, 6) AS score FROM part p LEFT JOIN best ON best.p_brand = p.p_brand AND best.p_name = p.p_name
WHERE p.p_partkey % 2 = 0""")
def fuzzy(t):
    p = t.part.select("p_brand", "p_name", "p_partkey")
    left = p.filter("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "l_id")
    right = p.filter("p_partkey % 2 = 1").select("p_brand", F.col("p_name").alias("r_name"), F.col("p_partkey").alias("r_id"))
    return rounded(J.fuzzy_block_join(left, right, "p_brand", "l_id", "r_id", "p_name", "r_name", 0.6))


@query("jon08_tiered_match")
def tiered(t):
    p = t.part.select("p_brand", "p_name", "p_type", "p_partkey")
    left = p.filter("p_partkey % 2 = 0").select("p_brand", F.col("p_partkey").alias("l_id"), "p_name", F.concat_ws(" ", "p_type", "p_name").alias("firm"))
    right = p.filter("p_partkey % 2 = 1").select("p_brand", F.col("p_partkey").alias("r_id"), F.col("p_name").alias("r_name"),
                                                  F.concat_ws(" ", "p_type", "p_name").alias("r_firm"))
    return rounded(J.tiered_match(left, right, "p_brand", "l_id", "r_id", ("p_name", "r_name"), ("firm", "r_firm")))


@query("jon09_consecutive_pairs", """
SELECT o_custkey, o_orderkey AS a, b, o_orderdate AS order_a, order_b FROM (SELECT *, lead(o_orderkey) OVER w AS b, lead(o_orderdate) OVER w AS order_b
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE b IS NOT NULL""")
def consecutive(t):
    return J.within_group_pairs(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey", width=360 * DAY)


@query("jon09_first_two", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, a.o_orderdate AS order_a, b.o_orderdate AS order_b FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.k = 1 AND b.k = 2""")
def first_two(t):
    return J.within_group_pairs(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey", "first_two")


@query("jon09_pairs_within", """
SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, a.o_orderdate AS order_a, b.o_orderdate AS order_b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
AND b.o_orderdate BETWEEN a.o_orderdate AND a.o_orderdate + INTERVAL 14 DAY AND (b.o_orderdate, b.o_orderkey) > (a.o_orderdate, a.o_orderkey)""")
def pairs_within(t):
    return J.within_group_pairs(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey", "within", 14 * DAY, 60 * DAY)


@query("jon09_coreported", """
WITH d AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT a.p_brand AS item_a, b.p_brand AS item_b, count(*)::BIGINT AS n FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2 HAVING count(*) >= 20""")
def coreported(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_brand")
    return J.coreported_pairs(d, "l_orderkey", "p_brand", 20)


@query("jon10_exact_match")
def exact(t):
    d = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") < 2000).cast("int").alias("treated"))
    return J.exact_match(d, "treated", ["c_nationkey", "c_mktsegment"], "c_custkey", 2, 5)


@query("jon11_caliper_match")
def caliper(t):
    d = t.customer.select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 4 == 0).cast("int").alias("treated"),
                          (0.02 + (F.col("c_acctbal") + 1000) / 11500).alias("score")).filter("score > 0 AND score < 1")
    return rounded(J.caliper_match(d, "c_custkey", "treated", "score", ["c_mktsegment"]))


@query("jon12_align_tables", """
WITH a AS (SELECT l_partkey, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT l_partkey, coalesce(a.n, 0)::BIGINT AS n_a, coalesce(b.n, 0)::BIGINT AS n_b FROM a FULL JOIN b USING (l_partkey)""")
def align(t):
    n = lambda flag: t.lineitem.filter(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return J.align_tables(n("R"), n("N"), ["l_partkey"], ["n"])


@query("jon13_with_grid", """
SELECT threshold, l_returnflag, (count(*) FILTER (l_quantity > threshold))::BIGINT AS n FROM lineitem, (SELECT unnest([10, 20, 30, 40]) AS threshold) GROUP BY 1, 2""")
def grid(t):
    cells = t.lineitem.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("_n"))
    d = J.with_grid(cells, [10, 20, 30, 40], "threshold")
    return d.groupBy("threshold", "l_returnflag").agg(F.sum(F.when(F.col("l_quantity") > F.col("threshold"), F.col("_n")).otherwise(0)).alias("n"))
