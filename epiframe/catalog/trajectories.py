"""RLT: logged trajectories of users: state = value quartile band, action = event type, a rare large value = bad outcome."""

from pyspark.sql import functions as F

from ..operators import trajectories as R
from .registry import query, rounded

ACTIONS = ["click", "error", "purchase", "signup", "view"]
TRAJ = """g AS (SELECT user_id, ts, event_id, (CASE WHEN value < 15 THEN 0 WHEN value < 35 THEN 1 WHEN value < 70 THEN 2 ELSE 3 END)::INT AS s, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::INT AS a, value FROM events),
o AS (SELECT user_id, (max(value) > 250)::INT AS died, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 6),
tr AS (SELECT user_id, row_number() OVER w - 1 AS t, s, a, (CASE WHEN row_number() OVER w = n THEN CASE WHEN died = 1 THEN -1 ELSE 1 END ELSE 0 END - CASE WHEN value > 200 THEN 0.1::DOUBLE ELSE 0 END)::DOUBLE AS r, coalesce(lead(s) OVER w, s) AS s2, row_number() OVER w = n AS done FROM g JOIN o USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def log(t):
    v = F.col("value")
    d = t.events.select("user_id", "ts", "event_id", "value", F.when(v < 15, 0).when(v < 35, 1).when(v < 70, 2).otherwise(3).alias("s"),
                        (F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("event_type")) - 1).cast("int").alias("a"))
    out = t.events.groupBy("user_id").agg((F.max("value") > 250).cast("int").alias("died"))
    return R.trajectories(d, out, "user_id", "ts", "s", "a", "died", 6, 1.0, {"value": (0.0, 200.0, 0.1)}, ["event_id"], 86400.0)


@query("rlt01_trajectories", f"WITH {TRAJ} SELECT user_id, t::BIGINT AS t, s AS state, a AS action, round(r, 6) + 0 AS reward, s2 AS next_state, done FROM tr")
def transitions(t):
    return rounded(log(t))


@query("rlt02_empirical_mdp", f"""
WITH {TRAJ}, f AS (SELECT s::INT AS s, a::INT AS a FROM (SELECT unnest(range(4)) AS s), (SELECT unnest(range(5)) AS a)) SELECT f.s AS state, f.a AS action, count(tr.t)::BIGINT AS n, round(coalesce(avg(r), 0), 6) + 0 AS reward, round(coalesce(avg(done::INT), 1), 6) AS terminal FROM f LEFT JOIN tr ON tr.s = f.s AND tr.a = f.a GROUP BY 1, 2""")
def mdp(t):
    return rounded(R.empirical_mdp(log(t), 4, 5)[0])


@query("rlt02_transition_shares", f"""
WITH {TRAJ} SELECT s AS state, a AS action, s2 AS next_state, round(count(*) / (sum(count(*)) OVER (PARTITION BY s, a))::DOUBLE, 6) AS p FROM tr WHERE NOT done GROUP BY 1, 2, 3""")
def shares(t):
    return rounded(R.empirical_mdp(log(t), 4, 5)[1])


@query("rlt02_behaviour_policy", f"""
WITH {TRAJ}, f AS (SELECT s::INT AS s, a::INT AS a FROM (SELECT unnest(range(4)) AS s), (SELECT unnest(range(5)) AS a)), c AS (SELECT f.s, f.a, count(tr.t) AS k FROM f LEFT JOIN tr ON tr.s = f.s AND tr.a = f.a GROUP BY 1, 2)
SELECT s AS state, a AS action, round((k + 0.5::DOUBLE) / (sum(k) OVER (PARTITION BY s) + 2.5::DOUBLE), 6) AS p FROM c""")
def behaviour(t):
    return rounded(R.behaviour_policy(log(t), 4, 5))


def target(t):
    s, a = F.col("state"), F.col("action")
    return t.spark.range(20).select((F.col("id") / 5).cast("int").alias("state"), (F.col("id") % 5).cast("int").alias("action")).withColumn("p", F.when(a == s, 0.28).otherwise(0.18))


IS = """b AS (SELECT s, a, (count(*) + 0.5::DOUBLE) / (sum(count(*)) OVER (PARTITION BY s) + 2.5::DOUBLE) AS p FROM tr GROUP BY 1, 2), x AS (SELECT tr.*, CASE WHEN tr.a = tr.s THEN 0.28::DOUBLE ELSE 0.18::DOUBLE END / b.p AS rho FROM tr JOIN b ON b.s = tr.s AND b.a = tr.a)"""


@query("rlt03_wis", f"""
WITH {TRAJ}, {IS}, w AS (SELECT user_id, exp(sum(ln(rho))) AS w, sum(pow(0.99::DOUBLE, t) * r) AS g FROM x GROUP BY 1) SELECT round(sum(w * g) / sum(w), 5) + 0 AS value, round(sum(w) * sum(w) / sum(w * w), 4) AS ess, count(*)::BIGINT AS n_traj FROM w""")
def wis(t):
    d = log(t)
    d = R.importance_sampling(d, "user_id", target(t), R.behaviour_policy(d, 4, 5), 0.99)
    return d.select(F.round("value", 5).alias("value"), F.round("ess", 4).alias("ess"), "n_traj")


@query("rlt03_pdis", f"""
WITH {TRAJ}, {IS}, c AS (SELECT user_id, t, r, exp(sum(ln(rho)) OVER (PARTITION BY user_id ORDER BY t)) AS w FROM x), h AS (SELECT unnest(range((SELECT max(t) + 1 FROM c))) AS t), lastw AS (SELECT user_id, max(t) AS tl, max_by(w, t) AS wl FROM c GROUP BY 1),
n AS (SELECT h.t, (SELECT sum(w) FROM c WHERE c.t = h.t) + coalesce((SELECT sum(wl) FROM lastw WHERE tl < h.t), 0) AS norm, (SELECT sum(w * r) FROM c WHERE c.t = h.t) AS wr FROM h)
SELECT round(sum(pow(0.99::DOUBLE, n.t) * wr / norm), 5) + 0 AS value, round((SELECT sum(w) * sum(w) / sum(w * w) FROM c WHERE t = 0), 4) AS ess, (SELECT count(*) FROM lastw)::BIGINT AS n_traj FROM n""")
def pdis(t):
    d = log(t)
    d = R.importance_sampling(d, "user_id", target(t), R.behaviour_policy(d, 4, 5), 0.99, "pdis")
    return d.select(F.round("value", 5).alias("value"), F.round("ess", 4).alias("ess"), "n_traj")


@query("rlt03_doubly_robust")
def robust(t):
    d = log(t)
    sa, _ = R.empirical_mdp(d, 4, 5)
    return rounded(R.doubly_robust(d, "user_id", target(t), R.behaviour_policy(d, 4, 5), sa.select("state", "action", F.col("reward").alias("q")), 0.95), 5)


@query("rlt04_policy_evaluation", f"""
WITH RECURSIVE {TRAJ}, sa AS (SELECT s, a, avg(r) AS r, avg(done::INT) AS dn FROM tr GROUP BY 1, 2), p AS (SELECT s, a, s2, count(*) / (sum(count(*)) OVER (PARTITION BY s, a))::DOUBLE AS p FROM tr WHERE NOT done GROUP BY 1, 2, 3),
m AS (SELECT sa.s, p.s2, sum(pi * (1 - dn) * p) AS m FROM (SELECT *, CASE WHEN a = s THEN 0.28::DOUBLE ELSE 0.18::DOUBLE END AS pi FROM sa) sa JOIN p ON p.s = sa.s AND p.a = sa.a GROUP BY 1, 2), b AS (SELECT s, sum(CASE WHEN a = s THEN 0.28::DOUBLE ELSE 0.18::DOUBLE END * r) AS r FROM sa GROUP BY 1),
v AS (SELECT 0 AS i, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS v3 UNION ALL SELECT i + 1, (SELECT r FROM b WHERE s = 0) + 0.9 * (SELECT sum(m * CASE s2 WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END) FROM m WHERE s = 0),
 (SELECT r FROM b WHERE s = 1) + 0.9 * (SELECT sum(m * CASE s2 WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END) FROM m WHERE s = 1), (SELECT r FROM b WHERE s = 2) + 0.9 * (SELECT sum(m * CASE s2 WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END) FROM m WHERE s = 2),
 (SELECT r FROM b WHERE s = 3) + 0.9 * (SELECT sum(m * CASE s2 WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END) FROM m WHERE s = 3) FROM v WHERE i < 300)
SELECT s AS state, round(CASE s WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END, 4) + 0 AS v FROM v, (SELECT unnest([0, 1, 2, 3]) AS s) WHERE i = 300""".replace("WITH RECURSIVE {TRAJ}", "WITH RECURSIVE " + TRAJ))
def evaluation(t):
    sa, p = R.empirical_mdp(log(t), 4, 5)
    return rounded(R.policy_evaluation(sa, p, target(t), 0.9, 1e-7), 4)


@query("rlt04_value_iteration")
def best(t):
    d = log(t)
    sa, p = R.empirical_mdp(d, 4, 5)
    return rounded(R.initial_value(d, R.policy_evaluation(sa, p, None, 0.9, 1e-7)), 4)


@query("rlt05_rule_rates", """
WITH v AS (SELECT unnest(list_filter([CASE WHEN l_quantity > 45 THEN 'l_quantity high' END, CASE WHEN l_quantity < 3 THEN 'l_quantity low' END, CASE WHEN l_discount > 0.08 THEN 'l_discount high' END, CASE WHEN l_tax < 0.01 THEN 'l_tax low' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem)
SELECT rule, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS share FROM v GROUP BY 1""")
def rules(t):
    d = R.action_rules(t.lineitem, {"l_quantity": (3, 45), "l_discount": (None, 0.08), "l_tax": (0.01, None)})
    return rounded(R.rule_rates(d))


@query("rlt05_allowed_actions", f"""
WITH {TRAJ}, b AS (SELECT a, count(*) AS n, avg(r) AS r FROM tr GROUP BY 1) SELECT a AS action, n::BIGINT AS n, n > (SELECT avg(n) FROM b) AS allowed FROM b""")
def allowed(t):
    d = log(t).groupBy("action").agg(F.count("*").alias("n"))
    m = d.agg(F.avg("n").alias("m"))
    return R.allowed_actions(d.join(F.broadcast(m)), F.col("n") > F.col("m")).select("action", "n", "allowed")


@query("rlt05_policy_divergence", f"""
WITH {TRAJ}, f AS (SELECT s::INT AS s, a::INT AS a FROM (SELECT unnest(range(4)) AS s), (SELECT unnest(range(5)) AS a)), c AS (SELECT f.s, f.a, count(tr.t) AS k FROM f LEFT JOIN tr ON tr.s = f.s AND tr.a = f.a GROUP BY 1, 2),
p AS (SELECT s, a, (k + 0.5::DOUBLE) / (sum(k) OVER (PARTITION BY s) + 2.5::DOUBLE) AS p FROM c) SELECT s AS state, round(sum(abs(p - CASE WHEN a = s THEN 0.28::DOUBLE ELSE 0.18::DOUBLE END)) / 2, 6) AS distance FROM p GROUP BY 1""")
def divergence(t):
    return rounded(R.policy_divergence(R.behaviour_policy(log(t), 4, 5), target(t)))
