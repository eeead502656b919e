"""CLN: cohorts and derived labels; orders stand in for stays, lines and events for charted values."""

from pyspark.sql import functions as F

from ..operators import cohorts as C
from .registry import query, rounded
from .timeseries import D, H, day, hours

DAY = 86400.0


@query("cln01_visit_cohort", """
WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 1 DAY AS b, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders JOIN customer ON c_custkey = o_custkey WHERE floor(c_acctbal / 100)::BIGINT >= 18),
adm AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_totalprice > 200000 THEN o_orderpriority END AS lang FROM orders WHERE o_orderstatus = 'F'), lat AS (SELECT o_custkey, max_by(lang, (o_orderdate, o_orderkey)) AS lang FROM adm WHERE lang IS NOT NULL GROUP BY 1),
n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), cr AS (SELECT o_custkey, o_orderdate AS at_ FROM orders WHERE o_totalprice > 400000)
SELECT v.o_orderkey, floor(c_acctbal / 100)::BIGINT AS age, coalesce(n, 0)::BIGINT AS n_children, (adm.o_orderkey IS NOT NULL)::INT AS admitted, (EXISTS (SELECT 1 FROM cr WHERE cr.o_custkey = v.o_custkey AND at_ >= v.a AND at_ <= v.b + INTERVAL 240 HOUR))::INT AS critical,
 coalesce(nx >= b AND nx <= b + INTERVAL 480 HOUR, false)::INT AS revisit, coalesce(adm.lang, lat.lang, 'unknown') AS language FROM v JOIN customer ON c_custkey = v.o_custkey LEFT JOIN n ON l_orderkey = v.o_orderkey LEFT JOIN adm ON adm.o_orderkey = v.o_orderkey LEFT JOIN lat ON lat.o_custkey = v.o_custkey""")
def visits(t):
    v = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("b"))
    persons = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.floor(F.col("c_acctbal") / 100).alias("age"))
    kids = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    adm = t.orders.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("admit_at"), F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")).alias("language"))
    crit = t.orders.filter("o_totalprice > 400000").select("o_custkey", F.col("o_orderdate").alias("at"))
    d = C.visit_cohort(v, persons, kids, adm, crit, "o_custkey", "o_orderkey", "a", "b", 18, 240.0, 480.0, 60 * DAY)
    return d.drop("o_custkey", "a", "b")


SPEC = {"unit": "subject", "criteria": [{"kind": "age", "min": 18, "max": 90}, {"kind": "length", "min_hours": 48}, {"kind": "unit", "values": ["F", "O"]}, {"kind": "code_in", "prefixes": ["Brand#1", "Brand#2"]},
        {"kind": "code_out", "prefixes": ["Brand#25"]}, {"kind": "survived", "hours": 240}], "outcome": {"kind": "long_stay", "hours": 480}}


def spec_tables(t):
    age = t.customer.select("c_custkey", F.floor(F.col("c_acctbal") / 100).alias("age"))
    span = F.expr("make_interval(0, 0, 0, 1 + CAST(o_orderkey % 30 AS INT))")
    s = t.orders.join(age, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("visit"), F.col("o_orderkey").alias("stay"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + span).alias("end"), "age",
        F.col("o_orderstatus").alias("unit"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, CAST(o_orderkey % 20 AS INT))")).alias("death"))
    codes = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("visit"), F.col("p_brand").alias("code"))
    return {"stays": s, "codes": codes}


SPEC_SQL = """s AS (SELECT o_custkey AS subject, o_orderkey AS stay, o_orderdate AS a, 24 * (1 + o_orderkey % 30) AS len, floor(c_acctbal / 100) AS age, o_orderstatus AS unit, CASE WHEN o_orderpriority = '1-URGENT' THEN 24 * (o_orderkey % 20) END AS dh FROM orders JOIN customer ON c_custkey = o_custkey),
code AS (SELECT DISTINCT l_orderkey AS stay, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey), c1 AS (SELECT * FROM s WHERE age BETWEEN 18 AND 90), c2 AS (SELECT * FROM c1 WHERE len >= 48), c3 AS (SELECT * FROM c2 WHERE unit IN ('F', 'O')),
c4 AS (SELECT * FROM c3 WHERE stay IN (SELECT stay FROM code WHERE regexp_matches(p_brand, '^(?:Brand#1|Brand#2)'))), c5 AS (SELECT * FROM c4 WHERE stay NOT IN (SELECT stay FROM code WHERE starts_with(p_brand, 'Brand#25'))), c6 AS (SELECT * FROM c5 WHERE dh IS NULL OR dh > 240),
c7 AS (SELECT * FROM c6 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY a, stay) = 1)"""


@query("cln02_cohort_from_spec", f"WITH {SPEC_SQL} SELECT stay, subject, (len >= 480)::INT AS outcome FROM c7")
def from_spec(t):
    return C.cohort_from_spec(SPEC, spec_tables(t))[0].select("stay", "subject", "outcome")


@query("cln02_attrition", f"""
WITH {SPEC_SQL} SELECT * FROM (SELECT 0 AS step, 'start' AS criterion, count(*)::BIGINT AS n FROM s UNION ALL SELECT 1, 'age', count(*) FROM c1 UNION ALL SELECT 2, 'length', count(*) FROM c2 UNION ALL SELECT 3, 'unit', count(*) FROM c3 UNION ALL SELECT 4, 'code_in', count(*) FROM c4
 UNION ALL SELECT 5, 'code_out', count(*) FROM c5 UNION ALL SELECT 6, 'survived', count(*) FROM c6 UNION ALL SELECT 7, 'first per subject', count(*) FROM c7)""")
def attrition(t):
    return C.cohort_from_spec(SPEC, spec_tables(t))[1]


CHART = f"""u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT user_id, {D} AS hour, event_type, value FROM events), g AS (SELECT u.user_id, k.hour::BIGINT AS hour, max(value) FILTER (event_type = 'view') AS pa, max(value) FILTER (event_type = 'click') AS pl,
 max(value) FILTER (event_type = 'purchase') / 20 AS bi, max(value) FILTER (event_type = 'error') AS mp, max(value) FILTER (event_type = 'signup') / 50 AS cr, count(e.value) AS n, sum(value) AS uo FROM u CROSS JOIN (SELECT unnest(range(31)) AS hour) k LEFT JOIN e ON e.user_id = u.user_id AND e.hour = k.hour GROUP BY 1, 2),
w AS (SELECT *, sum(uo) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS u24 FROM g),
sofa AS (SELECT user_id, hour, CASE WHEN pa / 0.5 < 100 AND n > 3 THEN 4 WHEN pa / 0.5 < 200 AND n > 3 THEN 3 WHEN pa / 0.5 < 300 THEN 2 WHEN pa / 0.5 < 400 THEN 1 ELSE 0 END AS respiratory,
 CASE WHEN pl < 20 THEN 4 WHEN pl < 50 THEN 3 WHEN pl < 100 THEN 2 WHEN pl < 150 THEN 1 ELSE 0 END AS coagulation, CASE WHEN bi >= 12 THEN 4 WHEN bi >= 6 THEN 3 WHEN bi >= 2 THEN 2 WHEN bi >= 1.2 THEN 1 ELSE 0 END AS liver,
 CASE WHEN n > 6 THEN 3 WHEN mp < 70 THEN 1 ELSE 0 END AS cardiovascular, 0 AS nervous, greatest(CASE WHEN cr >= 5 THEN 4 WHEN cr >= 3.5 THEN 3 WHEN cr >= 2 THEN 2 WHEN cr >= 1.2 THEN 1 ELSE 0 END, CASE WHEN u24 < 200 THEN 4 WHEN u24 < 500 THEN 3 ELSE 0 END) AS renal FROM w),
tot AS (SELECT *, respiratory + coagulation + liver + cardiovascular + nervous + renal AS sofa FROM sofa)"""


def chart(t):
    from ..operators.timeseries import skeleton
    pick = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    g = t.events.groupBy("user_id", day().alias("hour")).agg(pick("view").alias("pao2"), pick("click").alias("platelets"), (pick("purchase") / 20).alias("bilirubin"), pick("error").alias("map"), (pick("signup") / 50).alias("creatinine"),
                                                            F.count("*").alias("n"), F.sum("value").alias("urine"))
    g = skeleton(g.select("user_id").distinct(), ["user_id"], "hour", 0, 30).join(g, ["user_id", "hour"], "left")
    n = F.coalesce("n", F.lit(0))
    return g.withColumn("fio2", F.lit(50.0)).withColumn("vent", (n > 3).cast("int")).withColumn("norepinephrine", F.when(n > 6, 0.05)).withColumn("epinephrine", F.lit(None).cast("double")).withColumn("gcs", F.lit(None).cast("double"))


@query("cln03_sofa", f"WITH {CHART} SELECT * FROM tot")
def organ_scores(t):
    return C.sofa(chart(t), ["user_id"], "hour")


@query("cln04_sepsis_onset", f"""
WITH {CHART}, sus AS (SELECT user_id, min(hour) AS t0 FROM e WHERE value > 100 GROUP BY 1), b AS (SELECT tot.user_id, t0, coalesce(min(sofa) FILTER (hour < t0 - 4), 0) AS base FROM tot JOIN sus USING (user_id) GROUP BY 1, 2)
SELECT user_id, min(hour) FILTER (hour >= t0 - 4 AND hour <= t0 + 6 AND sofa - base >= 2) AS onset, min(base) AS baseline FROM tot JOIN b USING (user_id) GROUP BY 1""")
def onset(t):
    sus = t.events.filter("value > 100").select("user_id", day().alias("t0"))
    return C.sepsis_onset(C.sofa(chart(t), ["user_id"], "hour"), sus, "user_id", "hour", "sofa", "t0", 4, 6)


@query("cln05_kdigo", f"""
WITH c AS (SELECT event_id, user_id, {H} AS h, value / 50 AS v FROM events), w AS (SELECT *, min(v) OVER (PARTITION BY user_id ORDER BY h RANGE BETWEEN 168 PRECEDING AND 0.0000001 PRECEDING) AS lo, min(v) OVER (PARTITION BY user_id ORDER BY h RANGE BETWEEN 48 PRECEDING AND 0.0000001 PRECEDING) AS lo48,
 first_value(v) OVER (PARTITION BY user_id ORDER BY h, v) AS fv FROM c), s AS (SELECT event_id, v, coalesce(lo, fv) AS base, v - coalesce(lo48, v) AS rise, v / coalesce(lo, fv) AS r FROM w)
SELECT event_id, round(base, 6) AS baseline, (CASE WHEN r >= 3 OR (v >= 4 AND (rise >= 0.3 OR r >= 1.5)) THEN 3 WHEN r >= 2 THEN 2 WHEN rise >= 0.3 OR r >= 1.5 THEN 1 ELSE 0 END)::INT AS stage FROM s""")
def kidney(t):
    c = t.events.select("event_id", "user_id", hours(), (F.col("value") / 50).alias("v"))
    return rounded(C.kdigo(c, ["user_id"], "hours", "v").select("event_id", "baseline", "stage"))


@query("cln05_oliguria", f"""
WITH {CHART} SELECT user_id, hour, coalesce(count(uo) OVER w >= 3 AND sum(uo) OVER w / (3 * 70.0::DOUBLE) < 0.5, false) AS oliguria FROM g WINDOW w AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def low_urine(t):
    return C.oliguria(chart(t).withColumn("w", F.lit(70.0)), ["user_id"], "hour", "urine", "w", 3).select("user_id", "hour", "oliguria")


@query("cln06_horizon_label", f"""
WITH f AS (SELECT user_id, min({H}) FILTER (value > 150) AS ev FROM events GROUP BY 1) SELECT user_id, CASE WHEN ev <= 48 THEN NULL WHEN ev <= 240 THEN 1 ELSE 0 END::INT AS incident, (CASE WHEN ev > 48 AND ev <= 240 THEN 1 ELSE 0 END)::INT AS label FROM f""")
def horizon(t):
    d = t.events.groupBy("user_id").agg(F.min(F.when(F.col("value") > 150, hours())).alias("ev"))
    return d.select("user_id", C.horizon_label(F.col("ev"), 48, 192, True).alias("incident"), C.horizon_label(F.col("ev"), 48, 192).alias("label"))


@query("cln07_incident_outcome", """
WITH i AS (SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS t FROM events WHERE event_type = 'purchase'), l AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS t, value AS v FROM events WHERE event_type = 'view'),
b AS (SELECT i.event_id, i.user_id, i.t, max_by(v, (l.t, v)) AS base FROM i LEFT JOIN l ON l.user_id = i.user_id AND l.t <= i.t AND l.t > i.t - 604800 GROUP BY 1, 2, 3),
f AS (SELECT b.event_id, base, count(l.t) AS n, min(l.t) FILTER (v > 150 OR v >= 3 * base) AS ev FROM b LEFT JOIN l ON l.user_id = b.user_id AND l.t > b.t AND l.t <= b.t + 432000 GROUP BY 1, 2)
SELECT event_id, base AS baseline, n::BIGINT AS n_follow, (ev IS NOT NULL)::INT AS outcome, coalesce(base BETWEEN 10 AND 120, false) AND n > 0 AS eligible FROM f""")
def incident(t):
    index = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    labs = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("at"), "value")
    d = C.incident_outcome(index, labs, ["user_id"], "event_id", "ts", "at", "value", 7 * DAY, 5 * DAY, (10, 120), above=150.0, multiple=3.0, width=10 * DAY)
    return d.select("event_id", "baseline", "n_follow", "outcome", "eligible")


BOLUS = """i AS (SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS a, epoch_us(ts) / 1e6::DOUBLE + 60 * (event_id % 45) AS b, value * 10 AS ml FROM events), q AS (SELECT * FROM i WHERE ml >= 250 AND (b - a) / 60 <= 30)"""


def infusions(t):
    from ..plans.ordered import axis
    d = t.events.select("event_id", "user_id", "value", axis(t.events, "ts").alias("a"))
    return d.withColumn("b", F.col("a") + 60 * (F.col("event_id") % 45))


@query("cln08_boluses", f"""
WITH {BOLUS} SELECT event_id, NOT EXISTS (SELECT 1 FROM q o WHERE o.user_id = q.user_id AND o.event_id <> q.event_id AND o.a >= q.a - 36000 AND o.a <= q.b + 18000) AS isolated FROM q""")
def bolus(t):
    return C.boluses(infusions(t), ["user_id"], "event_id", "a", "b", F.col("value") * 10, 250.0, 30.0, 600.0, 300.0).select("event_id", "isolated")


@query("cln08_sham_windows")
def sham(t):
    from ..plans.ordered import axis
    b = C.boluses(infusions(t), ["user_id"], "event_id", "a", "b", F.col("value") * 10).filter("value > 100").select("user_id", "event_id", "a", F.col("value").alias("level"))
    c = t.events.select("user_id", axis(t.events, "ts").alias("at"), F.col("value").alias("level"))
    return C.sham_windows(b, c, ["user_id"], "event_id", "a", "at", "level", 5.0, 7200.0)


@query("cln09_doses", """
SELECT source, drug, count(*)::BIGINT AS n, round(sum(mg), 3) AS mg, round(sum(minutes), 3) AS minutes, count(*) FILTER (imputed)::BIGINT AS n_imputed FROM (
 SELECT 'infusion' AS source, p_brand AS drug, l_quantity * 1000 AS mg, 1440.0::DOUBLE * (l_linenumber + 1) AS minutes, false AS imputed FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' UNION ALL
 SELECT 'given', p_brand, l_quantity * CASE l_linestatus WHEN 'F' THEN 1.0::DOUBLE ELSE 0.001::DOUBLE END, CASE WHEN l_discount > 0 THEN 60 * l_quantity / (l_discount * 100) ELSE 30.0::DOUBLE END, l_discount <= 0 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A') GROUP BY 1, 2""")
def dose_rows(t):
    li = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    stop = F.col("l_shipdate") + F.expr("make_interval(0, 0, 0, l_linenumber + 1)")
    a = li.filter("l_returnflag = 'R'").select("l_orderkey", "p_brand", F.col("l_shipdate").alias("start"), stop.alias("end"), F.col("l_quantity").alias("amount"), F.lit("G").alias("unit"))
    b = li.filter("l_returnflag IN ('A', 'N')").select("l_orderkey", "p_brand", F.col("l_shipdate").alias("start"), F.col("l_quantity").alias("amount"), F.when(F.col("l_linestatus") == "F", "mg").otherwise("mcg").alias("unit"),
                                                       (F.col("l_discount") * 100).alias("rate"), F.col("l_returnflag").alias("event"))
    names = {"subject": "l_orderkey", "drug": "p_brand", "start": "start", "end": "end", "amount": "amount", "unit": "unit", "rate": "rate", "event": "event"}
    d = C.doses(a, b, names, 30.0, ["A"], {"mg": 1.0, "g": 1000.0, "mcg": 0.001})
    return rounded(d.groupBy("source", "drug").agg(F.count("*").alias("n"), F.sum("mg").alias("mg"), F.sum("minutes").alias("minutes"), F.sum(F.col("imputed").cast("int")).alias("n_imputed")), 3)


STATES = """st AS (SELECT user_id, TIMESTAMP '2024-01-01' AS a, TIMESTAMP '2024-01-01' + to_days((10 + user_id % 20)::INT) AS b FROM (SELECT DISTINCT user_id FROM events)), w AS (SELECT *, unnest(range(0, (10 + user_id % 20) * 2 + 1)) AS win, (10 + user_id % 20) * 2 AS n FROM st),
c AS (SELECT user_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 4.32e10)::BIGINT AS win, event_type, value FROM events), f AS (SELECT w.user_id, w.win, w.n, count(*) FILTER (event_type = 'error') AS pos, count(*) FILTER (event_type = 'view') AS neg, count(*) FILTER (event_type = 'click') AS uta,
  max(1 - floor(value / 20)) FILTER (event_type IN ('purchase', 'signup')) AS deep, count(*) FILTER (event_type IN ('purchase', 'signup')) AS ns FROM w LEFT JOIN c ON c.user_id = w.user_id AND c.win = w.win AND w.win < w.n GROUP BY 1, 2, 3),
ws AS (SELECT user_id, win AS "window", CASE WHEN win = n THEN CASE WHEN user_id % 7 = 0 THEN 'dead' ELSE 'discharged' END WHEN pos > 0 THEN 'delirium' WHEN neg > 0 THEN 'normal' WHEN uta > 0 OR deep <= -4 THEN 'coma' ELSE 'unscreened' END AS state, (pos + neg + uta)::BIGINT AS n_screen, ns::BIGINT AS n_sedation FROM f)"""


def states(t):
    st = t.events.select("user_id").distinct().withColumn("a", F.lit("2024-01-01").cast("timestamp"))
    st = st.withColumn("b", F.col("a") + F.expr("make_interval(0, 0, 0, 10 + CAST(user_id % 20 AS INT))")).withColumn("d", F.when(F.col("user_id") % 7 == 0, F.col("b")))
    e = F.col("event_type")
    kind = F.when(e.isin("error", "view", "click"), "screen").otherwise("sedation")
    value = F.when(e == "error", "positive").when(e == "view", "negative").when(e == "click", "unable").otherwise((1 - F.floor(F.col("value") / 20)).cast("string"))
    tl = t.events.select("user_id", "ts", kind.alias("kind"), value.alias("val"))
    return C.window_states(tl, st, "user_id", "ts", "kind", "val", "a", "b", 12.0, "d")


@query("cln10_window_states", f"WITH {STATES} SELECT * FROM ws")
def window_rows(t):
    return states(t)


@query("cln10_free_days", f"""
WITH {STATES}, k AS (SELECT * FROM ws WHERE "window" < 28) SELECT user_id, CASE WHEN bool_or(state = 'dead') THEN 0 ELSE (count(*) FILTER (state IN ('normal', 'unscreened')) + greatest(28 - count(*) FILTER (state NOT IN ('dead', 'discharged')), 0)) / 2.0::DOUBLE END::DOUBLE AS free_days, bool_or(state = 'dead') AS died FROM k GROUP BY 1""")
def free(t):
    return C.free_days(states(t), "user_id", 12.0, 14)


@query("cln11_order_features", f"""
WITH e AS (SELECT user_id, event_type, value, {H} AS h, hour(ts) AS hod, event_id % 5 = 0 AS stat, event_id % 40 AS delay FROM events), w AS (SELECT *, h + delay > 360 AS late, NOT (hod >= 4 AND hod < 8 AND NOT stat) AS off FROM e WHERE h BETWEEN 0 AND 360)
SELECT u.user_id, max_by(value, (h, value)) FILTER (event_type = 'view' AND NOT late) AS view_last, round(avg(value) FILTER (event_type = 'view' AND NOT late), 6) AS view_mean, min(value) FILTER (event_type = 'view' AND NOT late) AS view_min, max(value) FILTER (event_type = 'view' AND NOT late) AS view_max,
 count(*) FILTER (event_type = 'view' AND NOT late)::BIGINT AS view_n, round(coalesce(360 - max(h) FILTER (event_type = 'view' AND NOT late), 360), 5) AS view_hrs_since, count(*) FILTER (event_type = 'view' AND NOT late AND stat)::BIGINT AS view_n_stat, count(*) FILTER (event_type = 'view' AND NOT late AND off)::BIGINT AS view_n_off,
 count(*) FILTER (event_type = 'view' AND late)::BIGINT AS view_pending FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN w USING (user_id) GROUP BY 1""")
def orders_features(t):
    d = t.events.select("user_id", "event_type", "value", hours(), F.hour("ts").alias("hod"), "event_id")
    d = C.order_features(d, t.events.select("user_id").distinct(), "user_id", "hours", "event_type", "value", ["view"], 360.0, F.col("hod"), F.col("event_id") % 5 == 0, (F.col("event_id") % 40).cast("double"))
    return rounded(d.withColumn("view_hrs_since", F.round("view_hrs_since", 5)))


@query("cln12_mistriage", """
WITH v AS (SELECT substr(o_orderpriority, 1, 1)::INT AS a, o_totalprice > 400000 AS c, o_orderstatus = 'F' AS h FROM orders) SELECT a AS acuity, sum(((a >= 3 AND c) OR (a >= 4 AND h))::INT)::BIGINT AS under_triage, sum((a <= 2 AND NOT c AND NOT h)::INT)::BIGINT AS over_triage, sum(c::INT)::BIGINT AS eligible_under, sum((NOT c AND NOT h)::INT)::BIGINT AS eligible_over FROM v GROUP BY 1""")
def triage(t):
    d = t.orders.withColumn("acuity", F.substring("o_orderpriority", 1, 1).cast("int"))
    d = C.mistriage(d, "acuity", F.col("o_totalprice") > 400000, F.col("o_orderstatus") == "F", True)
    return d.groupBy("acuity").agg(*[F.sum(c).alias(c) for c in ("under_triage", "over_triage", "eligible_under", "eligible_over")])


LAST = "lastship AS (SELECT l_orderkey, max(l_shipdate) AS stored FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"


def exams(t):
    last = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("stored"))
    r = t.orders.join(last, "o_orderkey", "left").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").alias("ordered"), "stored")
    li = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("field"), F.col("l_returnflag").alias("val"))
    return C.exam_table(r, li, "o_orderkey", "ordered", "stored", "field", "val", ["F", "O"], 200.0)


@query("cln13_exam_table", f"""
WITH {LAST}, d AS (SELECT l_orderkey, max(l_returnflag) FILTER (l_linestatus = 'F') AS f, max(l_returnflag) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1)
SELECT o_orderkey, f AS "F", o AS "O", (epoch(stored) - epoch(o_orderdate)) / 3600 AS tat_h, coalesce(stored = o_orderdate, false) AS auto_stored, stored IS NULL OR stored < o_orderdate OR epoch(stored) - epoch(o_orderdate) > 86400 * 200 AS quarantine FROM orders LEFT JOIN lastship ON lastship.l_orderkey = o_orderkey LEFT JOIN d ON d.l_orderkey = o_orderkey""")
def exam_rows(t):
    return exams(t).select("o_orderkey", "F", "O", "tat_h", "auto_stored", "quarantine")


@query("cln13_index_exam", """
SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderdate, o_orderkey) = 1""")
def first_exam(t):
    return C.index_exam(exams(t), "o_custkey", "o_orderpriority", "ordered", "o_orderkey", ["2-HIGH", "1-URGENT"]).select("o_custkey", "o_orderkey", "o_orderpriority")
