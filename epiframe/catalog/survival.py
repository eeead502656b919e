"""SRV: time to event."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import survival as V
from ..operators.models import logit
from ..plans.spread import spread
from .registry import query, rounded

SPAN = 300.0     # days per slice of the time axis
ENT = """ent AS (SELECT o_custkey AS key, min(o_orderdate) AS origin, max(o_orderdate) AS last, min(c_mktsegment) AS segment, min(c_acctbal) AS balance FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
ev AS (SELECT o_custkey AS key, CASE l_returnflag WHEN 'R' THEN 'progression' WHEN 'A' THEN 'replacement' ELSE 'death' END AS kind, l_shipdate AS at_ FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount >= 0.1 AND l_tax >= 0.07),
fe AS (SELECT ev.* FROM ev JOIN ent USING (key) WHERE at_ > origin), f1 AS (SELECT key, kind, at_, row_number() OVER (PARTITION BY key ORDER BY at_, CASE kind WHEN 'replacement' THEN 1 WHEN 'progression' THEN 2 ELSE 3 END) AS k FROM fe),
tte AS (SELECT ent.*, CASE WHEN at_ <= TIMESTAMP '2000-12-31' THEN 1 ELSE 0 END AS event, CASE WHEN at_ <= TIMESTAMP '2000-12-31' THEN kind ELSE 'censored' END AS event_kind,
  greatest((epoch(CASE WHEN at_ <= TIMESTAMP '2000-12-31' THEN at_ ELSE TIMESTAMP '2000-12-31' END) - epoch(origin + INTERVAL 30 DAY)) / 86400, 0.001)::DOUBLE AS duration
  FROM ent LEFT JOIN (SELECT * FROM f1 WHERE k = 1) f USING (key) WHERE origin + INTERVAL 30 DAY < TIMESTAMP '2000-12-31' AND (at_ IS NULL OR at_ > origin + INTERVAL 30 DAY))"""


def entities(t):
    n = t.orders.count()
    o = spread(t.orders.select("o_custkey", "o_orderdate"), "o_custkey", rows=n)
    o = o.join(spread(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey", rows=n), F.col("c_custkey") == F.col("o_custkey"))
    return o.groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderdate").alias("origin"), F.max("o_orderdate").alias("last"),
                                                          F.min("c_mktsegment").alias("segment"), F.min("c_acctbal").alias("balance"))


def events(t):
    n = t.orders.count()
    o = spread(t.orders.select("o_orderkey", F.col("o_custkey").alias("key")), "o_orderkey", rows=n)
    d = spread(t.lineitem.filter("l_discount >= 0.1 AND l_tax >= 0.07").select("l_orderkey", "l_returnflag", "l_shipdate"), "l_orderkey", rows=n).join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "progression").when(F.col("l_returnflag") == "A", "replacement").otherwise("death")
    first = spread(t.orders.select("o_custkey", "o_orderdate"), "o_custkey", rows=n).groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderdate").alias("o"))
    return d.select("key", kind.alias("kind"), F.col("l_shipdate").alias("at")).join(first, "key").filter("at > o").drop("o")


def tte(t):
    return V.time_to_event(entities(t), events(t), "key", "origin", "kind", "at", ["replacement", "progression", "death"], F.lit("2000-12-31"), landmark_days=30.0)


@query("srv01_time_to_event", f"WITH {ENT} SELECT key, segment, balance, event, event_kind, round(duration, 6) AS duration FROM tte")
def survival_table(t):
    return rounded(tte(t).drop("origin", "last"))


KM = """st AS (SELECT DISTINCT segment, duration AS time FROM tte WHERE event = 1), rk AS (SELECT segment, time, (SELECT count(*) FROM tte x WHERE x.segment = st.segment AND x.duration >= time) AS n,
  (SELECT count(*) FROM tte x WHERE x.segment = st.segment AND x.duration = time AND x.event = 1) AS d FROM st),
km AS (SELECT *, exp(sum(ln(1 - d / n::DOUBLE)) OVER w) AS s, sum(d / (n::DOUBLE * (n - d))) OVER w AS v FROM rk WHERE n > d WINDOW w AS (PARTITION BY segment ORDER BY time))"""


@query("srv02_kaplan_meier", f"""
WITH {ENT}, {KM} SELECT segment, time, n::BIGINT AS at_risk, d::BIGINT AS events, round(s, 6) AS survival, round(s * sqrt(v), 6) AS se, round(exp(-exp(ln(-ln(s)) + 1.959963984540054::DOUBLE * sqrt(v) / abs(ln(s)))), 6) AS ci_lo,
 round(exp(-exp(ln(-ln(s)) - 1.959963984540054::DOUBLE * sqrt(v) / abs(ln(s)))), 6) AS ci_hi FROM km""")
def curve(t):
    return rounded(V.kaplan_meier(tte(t), "duration", "event", ["segment"], width=SPAN))


@query("srv02_median_rmst", f"""
WITH {ENT}, {KM}, l AS (SELECT *, lead(time) OVER (PARTITION BY segment ORDER BY time) AS nx FROM km)
SELECT segment, min(time) FILTER (s <= 0.5) AS median, round(least(min(time), 1500) + sum(s * (least(coalesce(nx, 1500), 1500) - least(time, 1500))), 5) AS rmst FROM l GROUP BY 1""")
def median_rmst(t):
    d = V.median_and_mean(V.kaplan_meier(tte(t), "duration", "event", ["segment"], width=SPAN), ["segment"], 1500.0, SPAN)
    return rounded(d, 5)


@query("srv03_logrank", f"""
WITH {ENT}, g AS (SELECT duration AS t, event, (balance > 5000)::INT AS grp FROM tte), u AS (SELECT DISTINCT t FROM g WHERE event = 1),
r AS (SELECT u.t, count(*) FILTER (g.t >= u.t)::DOUBLE AS n, count(*) FILTER (g.t >= u.t AND grp = 1)::DOUBLE AS n1, count(*) FILTER (g.t = u.t AND event = 1)::DOUBLE AS d, count(*) FILTER (g.t = u.t AND event = 1 AND grp = 1)::DOUBLE AS d1 FROM u, g GROUP BY 1),
s AS (SELECT sum(d1) AS o1, sum(d * n1 / n) AS e1, sum(d) AS o, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r)
SELECT '1' AS "group", round(o1, 5) AS observed, round(e1, 5) AS expected, round(pow(o1 - e1, 2) / v, 5) AS chi2, 1 AS df FROM s UNION ALL SELECT '0', round(o - o1, 5), round(o - e1, 5), round(pow(o1 - e1, 2) / v, 5), 1 FROM s""")
def test(t):
    d = tte(t).withColumn("grp", (F.col("balance") > 5000).cast("int"))
    return rounded(V.logrank(d, "duration", "event", "grp", [0, 1], width=SPAN).drop("p"), 5)


@query("srv03_logrank_segments")
def test_many(t):
    return rounded(V.logrank(tte(t), "duration", "event", "segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], width=SPAN))


@query("srv04_aalen_johansen", f"""
WITH {ENT}, st AS (SELECT DISTINCT duration AS time FROM tte WHERE event = 1), rk AS (SELECT time, (SELECT count(*) FROM tte WHERE duration >= time) AS n, (SELECT count(*) FROM tte WHERE duration = time AND event = 1) AS d,
 (SELECT count(*) FROM tte WHERE duration = time AND event_kind = 'progression') AS m FROM st), s AS (SELECT *, coalesce(exp(sum(ln(1 - d / n::DOUBLE)) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS sp FROM rk)
SELECT time, n::BIGINT AS at_risk, m::BIGINT AS mine, round(sum(sp * m / n) OVER (ORDER BY time), 6) AS incidence FROM s""")
def incidence(t):
    return rounded(V.aalen_johansen(tte(t), "duration", "event_kind", "progression", "censored", width=SPAN))


@query("srv05_concordance", f"""
WITH {ENT}, p AS (SELECT a.segment, count(*)::BIGINT AS n, sum(CASE WHEN a.balance > b.balance THEN 1.0::DOUBLE WHEN a.balance = b.balance THEN 0.5::DOUBLE ELSE 0 END) AS c FROM tte a JOIN tte b ON a.segment = b.segment AND a.event_kind = 'progression' AND b.duration > a.duration GROUP BY 1)
SELECT segment, n AS comparable, round(c / n, 6) AS c_index FROM p""")
def c_index(t):
    return rounded(V.concordance(tte(t), "duration", F.col("event_kind") == "progression", "balance", ["segment"]))


def observations(t):
    o = t.orders.join(t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("origin")), F.col("o_custkey") == F.col("k"))
    return o.groupBy(F.col("k").alias("key"), (F.datediff("o_orderdate", "origin") - 30.0).alias("t")).agg(F.max("o_totalprice").alias("price"))


OBS = "obs AS (SELECT o_custkey AS key, date_diff('day', origin, o_orderdate) - 30.0::DOUBLE AS t, max(o_totalprice) AS price FROM orders JOIN ent ON ent.key = o_custkey GROUP BY 1, 2)"


@query("srv06_person_period", f"""
WITH {ENT}, {OBS}, p AS (SELECT key, event, duration, unnest(range(greatest(ceil(greatest(duration, 1e-9) / 180), 1)::BIGINT)) AS period FROM tte)
SELECT p.key, period, least(period, 8) AS period_cat, (event = 1 AND period = greatest(ceil(greatest(duration, 1e-9) / 180), 1) - 1)::INT AS y,
 coalesce((SELECT max_by(price, t) FROM obs WHERE obs.key = p.key AND t <= period * 180 + 1e-9), (SELECT min_by(price, t) FROM obs WHERE obs.key = p.key)) AS price FROM p""")
def periods(t):
    return _periods(t).select("key", "period", "period_cat", "y", "price")


def _periods(t):
    subjects = tte(t).select("key", "duration", "event", "segment")
    return V.person_period(subjects, observations(t), "key", "t", "duration", "event", 180.0, 8)


@query("srv07_landmark_dataset", f"""
WITH {ENT}, {OBS}, l AS (SELECT key, duration AS out_, CASE WHEN event = 1 THEN duration END AS ev, unnest(range(0, greatest(ceil(duration / 180)::BIGINT - 1, 0) + 1)) * 180.0::DOUBLE AS landmark FROM tte),
m AS (SELECT * FROM l WHERE landmark < out_ AND (ev IS NULL OR ev > landmark))
SELECT m.key, m.landmark, round(max_by(price, t), 4) AS last, round(min(price), 4) AS min, count(price)::BIGINT AS count, round(avg(price) FILTER (t >= landmark - 365), 4) AS recent_mean,
 CASE WHEN count(price) >= 2 THEN round(regr_slope(price, t) * 29.530588::DOUBLE, 4) + 0 END AS monthly_slope, landmark - max(t) AS since_last, min(coalesce(ev > landmark AND ev <= landmark + 360, false)::INT) AS y,
 bool_or(NOT coalesce(ev > landmark AND ev <= landmark + 360, false) AND out_ < landmark + 360) AS censored FROM m LEFT JOIN obs ON obs.key = m.key AND t < landmark GROUP BY 1, 2""")
def landmarks(t):
    d = tte(t).select("key", F.col("duration").alias("out"), F.when(F.col("event") == 1, F.col("duration")).alias("ev"))
    d = V.landmark_dataset(d, observations(t), "key", "out", "ev", "t", "price", 180.0, 360.0, 365.0, 1500.0)
    return d.select("key", "landmark", *[F.round(c, 4).alias(c) for c in ("last", "min", "recent_mean")], "count", F.round(F.col("slope") * 29.530588, 4).alias("monthly_slope"), "since_last", "y", "censored")


@query("srv07_landmark_states", """
WITH d AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts)::BIGINT AS step, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY 1, 2)
SELECT d.user_id, d.step, d.state, (SELECT max_by(state, step) FROM d f WHERE f.user_id = d.user_id AND f.step > d.step AND f.step <= d.step + 3) AS future_state FROM d
WHERE d.step >= 2 AND d.state <> 'error' AND EXISTS (SELECT 1 FROM d f WHERE f.user_id = d.user_id AND f.step > d.step AND f.step <= d.step + 3)""")
def states(t):
    d = t.events.groupBy("user_id", F.datediff("ts", F.lit("2024-01-01")).cast("bigint").alias("step")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return V.landmark_states(d, ["user_id"], "step", "state", 3, 2, ["error"])


@query("srv08_discrete_hazard")
def hazard(t):
    d = _periods(t).withColumn("z", (F.col("price") - 250000) / 100000).withColumn("late", F.col("period_cat") / 8.0)
    return rounded(logit(d, "y", ["z", "late"], cluster="key"), 4)


@query("srv09_ipcw_brier", f"""
WITH {ENT}, ct AS (SELECT DISTINCT duration AS t FROM tte), rk AS (SELECT t, (SELECT count(*) FROM tte WHERE duration >= t)::DOUBLE AS n, (SELECT count(*) FROM tte WHERE duration = t AND event = 0)::DOUBLE AS c FROM ct),
g AS (SELECT t, CASE WHEN min(n - c) OVER (ORDER BY t) <= 0 THEN 0 ELSE exp(sum(CASE WHEN n > c THEN ln(1 - c / n) ELSE 0 END) OVER (ORDER BY t)) END AS g FROM rk), h AS (SELECT max_by(g, t) AS gh FROM g WHERE t <= 1000),
x AS (SELECT *, 0.1::DOUBLE + 0.5::DOUBLE * (balance + 1000) / 11500 AS p FROM tte JOIN g ON t = duration, h)
SELECT count(*)::BIGINT AS n, round(sum(CASE WHEN duration <= 1000 AND event_kind = 'progression' THEN (1 - p) * (1 - p) / greatest(g, 1e-8) WHEN duration <= 1000 AND event = 1 THEN p * p / greatest(g, 1e-8) WHEN duration > 1000 THEN p * p / greatest(gh, 1e-8) ELSE 0 END) / count(*), 6) AS brier FROM x""")
def brier(t):
    d = tte(t).withColumn("p", 0.1 + 0.5 * (F.col("balance") + 1000) / 11500)
    return rounded(V.ipcw_brier(d, "p", "duration", "event_kind", "progression", "censored", 1000.0, SPAN))


@query("srv10_metrics_by_landmark", f"""
WITH {ENT}, l AS (SELECT balance, event, duration, unnest([0, 360, 720]) AS landmark FROM tte), y AS (SELECT landmark, balance, (event = 1 AND duration <= landmark + 360)::INT AS y FROM l WHERE duration > landmark AND (event = 1 OR duration >= landmark + 360)),
r AS (SELECT *, rank() OVER (PARTITION BY landmark ORDER BY balance) + (count(*) OVER (PARTITION BY landmark, balance) - 1) / 2.0::DOUBLE AS r FROM y)
SELECT landmark, count(*)::BIGINT AS n, sum(y)::BIGINT AS n_pos, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y))), 6) AS auroc FROM r GROUP BY 1""")
def by_landmark(t):
    d = tte(t).withColumn("landmark", F.explode(F.array(F.lit(0), F.lit(360), F.lit(720))))
    d = d.filter("duration > landmark AND (event = 1 OR duration >= landmark + 360)").withColumn("y", F.expr("CAST(event = 1 AND duration <= landmark + 360 AS INT)"))
    return rounded(E.auroc(d, "y", "balance", ["landmark"]))
