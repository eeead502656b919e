"""TIM: time grids, runs, windows and sequences."""

from pyspark.sql import functions as F

from ..operators import timeseries as S
from ..plans.ordered import scan
from .registry import query, rounded

DAY = 86400.0
HOUR0 = "2024-01-01"


def hours(c="ts"):
    return ((F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.lit(HOUR0).cast("timestamp"))) / F.lit(3.6e9)).alias("hours")


def step_h(c="ts"):
    return F.floor((F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.lit(HOUR0).cast("timestamp"))) / F.lit(3.6e9)).cast("bigint")


def day(c="ts"):
    return F.datediff(c, F.lit(HOUR0)).cast("bigint")


H = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE"
D = "date_diff('day', TIMESTAMP '2024-01-01', ts)::BIGINT"
# complete (user, day) grid with the day's event count and mean value
GRID = f"""d AS (SELECT user_id, {D} AS step, count(*)::BIGINT AS n, avg(value) AS v, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1, 2),
grid AS (SELECT u.user_id, k.step::BIGINT AS step, coalesce(n, 0)::BIGINT AS n, v, coalesce(e, 0) > 0 AS err FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (SELECT unnest(range(31)) AS step) k LEFT JOIN d ON d.user_id = u.user_id AND d.step = k.step)"""


def day_grid(t):
    d = t.events.groupBy("user_id", day().alias("step")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"),
                                                            F.max((F.col("event_type") == "error").cast("int")).alias("e"))
    g = S.skeleton(d.select("user_id").distinct(), ["user_id"], "step", 0, 30).join(d, ["user_id", "step"], "left")
    return g.select("user_id", "step", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "v", (F.coalesce("e", F.lit(0)) > 0).alias("err"))


@query("tim01_to_grid", f"""
WITH e AS (SELECT user_id, {H} AS h, event_type, value FROM events), p AS (SELECT user_id, floor(h / 24)::BIGINT AS step, * FROM e WHERE h < 720),
i AS (SELECT user_id, unnest(range(greatest(floor(h / 24)::BIGINT, 0), least(ceil((h + 36) / 24)::BIGINT, 30))) AS step, value FROM e WHERE event_type = 'signup'),
a AS (SELECT user_id, step, max_by(value, (h, value)) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'view') AS c,
        sum(value) FILTER (event_type = 'purchase') AS purchase FROM p GROUP BY 1, 2), b AS (SELECT user_id, step, max(value) AS signup FROM i GROUP BY 1, 2)
SELECT u.user_id, k.step::BIGINT AS step, "view", coalesce(c, 0)::BIGINT AS view__n, round(purchase, 4) AS purchase, coalesce(signup, 0) AS signup
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(30)) AS step) k LEFT JOIN a USING (user_id, step) LEFT JOIN b USING (user_id, step)""")
def to_grid(t):
    long = t.events.select("user_id", hours(), F.col("event_type").alias("variable"), "value").withColumn("stop", F.col("hours") + 36)
    d = S.to_grid(long, long, ["user_id"], "hours", 30, {"view": "numeric", "purchase": "event", "signup": "interval"}, 24.0, end="stop")
    return rounded(d, 4)


@query("tim02_calendar_counts", """
WITH c AS (SELECT p_brand, date_trunc('month', l_shipdate)::DATE AS period, count(*)::BIGINT AS n, count(*) FILTER (l_returnflag = 'R') AS f
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), s AS (SELECT p_brand, min(period) AS a, (SELECT max(period) FROM c) AS b FROM c GROUP BY 1),
g AS (SELECT p_brand, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS period FROM s)
SELECT p_brand, period, coalesce(n, 0)::BIGINT AS n_all, coalesce(f, 0)::BIGINT AS n_flagged FROM g LEFT JOIN c USING (p_brand, period)""")
def calendar(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("p_brand", "l_shipdate", "l_returnflag")
    return S.calendar_counts(d, ["p_brand"], "l_shipdate", "month", flag=F.col("l_returnflag") == "R")


@query("tim03_ffill_limit", f"""
WITH {GRID} SELECT user_id, step, n, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS v, err FROM grid""")
def ffill(t):
    return rounded(S.ffill_limit(day_grid(t), ["user_id"], "step", ["v"], 2))


@query("tim04_resample_interp", f"""
WITH b AS (SELECT user_id, floor(epoch_us(ts) / 4.32e10)::BIGINT AS bin, avg(value) AS v, count(*)::BIGINT AS one FROM events GROUP BY 1, 2),
s AS (SELECT user_id, min(bin) AS a, max(bin) AS z FROM b GROUP BY 1), g AS (SELECT user_id, unnest(range(a, z + 1)) AS bin FROM s),
f AS (SELECT g.user_id, g.bin, v, one, last_value(CASE WHEN v IS NOT NULL THEN g.bin END IGNORE NULLS) OVER p AS pb, last_value(v IGNORE NULLS) OVER p AS pv,
   first_value(CASE WHEN v IS NOT NULL THEN g.bin END IGNORE NULLS) OVER q AS nb, first_value(v IGNORE NULLS) OVER q AS nv FROM g LEFT JOIN b USING (user_id, bin)
   WINDOW p AS (PARTITION BY g.user_id ORDER BY g.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY g.user_id ORDER BY g.bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, bin, round(CASE WHEN v IS NOT NULL THEN v WHEN bin - pb <= 6 THEN pv + (nv - pv) * (bin - pb) / (nb - pb) END, 6) AS value, v IS NULL AS imputed, coalesce(one, 0)::BIGINT AS one FROM f""")
def resample(t):
    d = t.events.select("user_id", "ts", "value", F.lit(1).cast("bigint").alias("one"))
    return rounded(S.resample_interp(d, ["user_id"], "ts", "value", DAY / 2, 6, ["one"], width=20.0))


@query("tim05_expand_intervals", f"""
WITH e AS (SELECT user_id, {H} AS a, CASE WHEN event_type = 'error' THEN NULL ELSE {H} + value / 10 END AS b FROM events)
SELECT user_id, bin, count(*)::BIGINT AS n FROM (SELECT user_id, unnest(range(floor(a)::BIGINT, ceil(coalesce(b, a + 1))::BIGINT)) AS bin FROM e) GROUP BY 1, 2""")
def expand(t):
    d = t.events.select("user_id", hours(), F.when(F.col("event_type") != "error", F.lit(0) + F.col("value") / 10).alias("len"))
    d = d.withColumn("stop", F.col("hours") + F.col("len"))
    return S.expand_intervals(d, "hours", "stop").groupBy("user_id", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("tim06_trailing_features", f"""
WITH {GRID} SELECT user_id, step, n, v, err, last_value(v IGNORE NULLS) OVER w AS v__last, min(v) OVER w AS v__min, max(v) OVER w AS v__max, round(avg(v) OVER w, 6) AS v__mean,
 round(sum(v) OVER w, 6) AS v__sum, (count(v) OVER w)::BIGINT AS v__count, round(1 - count(v) OVER w / (count(*) OVER w)::DOUBLE, 6) AS v__missing
FROM (SELECT user_id, step, n, err, round(v, 4) AS v FROM grid) WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def trailing(t):
    g = day_grid(t).withColumn("v", F.round("v", 4))
    return rounded(S.trailing_features(g, ["user_id"], "step", ["v"], 7))


@query("tim06_window_features", f"""
WITH {GRID} SELECT user_id, round(avg(v), 9) AS v__mean, round(min(v), 9) AS v__min, round(max(v), 9) AS v__max, round(max_by(v, step) FILTER (v IS NOT NULL), 9) AS v__last,
 count(v)::BIGINT AS v__count, round(1 - count(v) / count(*)::DOUBLE, 9) AS v__missing FROM grid WHERE step BETWEEN 5 AND 14 GROUP BY 1""")
def fixed_window(t):
    return rounded(S.window_features(day_grid(t), ["user_id"], "step", ["v"], 5, 15), 9)


@query("tim07_supervised_windows", f"""
WITH {GRID}, h AS (SELECT user_id, step, v, list(round(v, 4)) FILTER (v IS NOT NULL) OVER w AS hist, count(v) OVER w AS c, avg((n = 1)::INT) OVER w AS share,
  lead(v, 2) OVER o AS target, lead(n, 2) OVER o AS tn FROM grid WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY user_id ORDER BY step))
SELECT user_id, step, array_to_string([CAST(x AS VARCHAR) FOR x IN hist], '|') AS history, round(target, 4) AS target, tn <> 1 AS valid FROM h WHERE c = 4 AND target IS NOT NULL AND share <= 0.5""")
def supervised(t):
    g = day_grid(t).withColumn("imputed", F.col("n") == 1)
    d = S.supervised_windows(g, ["user_id"], "step", "v", "imputed", 4, 2)
    text = F.array_join(F.transform("history", lambda x: F.round(x, 4).cast("string")), "|")
    return d.select("user_id", "step", text.alias("history"), F.round("target", 4).alias("target"), "valid")


@query("tim08_decay_accumulate", f"""
WITH RECURSIVE {GRID}, r AS (SELECT user_id, step, n::DOUBLE AS level FROM grid WHERE step = 0 UNION ALL
 SELECT g.user_id, g.step, r.level * exp(-1 / 3.0::DOUBLE) + g.n FROM r JOIN grid g ON g.user_id = r.user_id AND g.step = r.step + 1)
SELECT user_id, step, round(level, 6) AS level FROM r""")
def decay(t):
    return rounded(S.decay_accumulate(day_grid(t), ["user_id"], "step", "n", 3.0).select("user_id", "step", "level"))


SESSION = f"""f AS (SELECT *, {H} AS h, max(ts + to_microseconds(CAST(value * 3.6e7 AS BIGINT))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM events)"""


@query("tim09_sessionize", f"""
WITH {SESSION}, s AS (SELECT event_id, user_id, ts, (sum(CASE WHEN pe IS NULL OR ts - pe > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM f)
SELECT event_id, session, min(ts) OVER (PARTITION BY user_id, session) AS session_start FROM s""")
def sessions(t):
    stop = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("value") * 3.6e7).cast("bigint"))
    d = S.sessionize(t.events.select("event_id", "user_id", "ts", stop.alias("stop")), ["user_id"], "ts", "stop", 6 * 3600.0, DAY, ["event_id"])
    return d.select("event_id", "session", "session_start")


@query("tim10_islands", f"""
WITH {GRID}, o AS (SELECT *, sum((NOT (n > 2))::INT) OVER (PARTITION BY user_id ORDER BY step) AS k FROM grid)
SELECT user_id, min(step) AS run_start, max(step) AS run_end, count(*)::BIGINT AS length FROM o WHERE n > 2 GROUP BY user_id, k HAVING count(*) >= 2""")
def runs(t):
    return S.islands(day_grid(t), ["user_id"], "step", F.col("n") > 2, 2, width=16.0)


@query("tim11_merge_split", f"""
WITH e AS (SELECT user_id, {H} AS a, {H} + value / 20 AS b FROM events), f AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM e),
s AS (SELECT *, sum(CASE WHEN pe IS NULL OR a - pe >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b) AS k FROM f), m AS (SELECT user_id, min(a) AS a, max(b) AS b FROM s GROUP BY user_id, k)
SELECT user_id, round(a + i * 8.0::DOUBLE, 5) AS "start", round(least(a + (i + 1) * 8.0::DOUBLE, b), 5) AS stop FROM (SELECT *, unnest(range(greatest(ceil((b - a) / 8), 1)::BIGINT)) AS i FROM m)""")
def merge_split(t):
    d = t.events.select("user_id", hours().alias("start"), "value").withColumn("stop", F.col("start") + F.col("value") / 20)
    return rounded(S.split_events(S.merge_events(d, ["user_id"], "start", "stop", 1.0, width=24.0), "start", "stop", 8.0), 5)


@query("tim12_stream_audit", """
WITH d AS (SELECT *, abs(value - lag(value) OVER w) AS dv, epoch_us(ts) / 1e6::DOUBLE - epoch_us(lag(ts) OVER w) / 1e6::DOUBLE AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum((NOT coalesce(dv < 20, false))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM d),
r AS (SELECT user_id, max(c) + 1 AS m FROM (SELECT user_id, g, count(*) AS c FROM k WHERE dv < 20 GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, count(*)::BIGINT AS n, (count(*) FILTER (dt > 0 AND dv / dt > 0.01))::BIGINT AS n_jumps, (count(*) FILTER (dt = 0))::BIGINT AS n_duplicate_times,
 avg((value IS NULL)::INT)::DOUBLE AS missing_share, coalesce(max(m), 0)::BIGINT AS longest_flat FROM k LEFT JOIN r USING (user_id) GROUP BY 1""")
def audit(t):
    d = S.stream_audit(t.events, ["user_id"], "ts", "value", 0.01, ["event_id"], 20.0, DAY)
    return d.withColumn("n_duplicate_times", F.col("n_duplicate_times").cast("bigint"))


@query("tim13_local_peaks", f"""
WITH {GRID}, l AS (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS b FROM grid WINDOW w AS (PARTITION BY user_id ORDER BY step)),
m AS (SELECT user_id, avg(n) AS mu, stddev_pop(n) AS sd FROM grid GROUP BY 1)
SELECT user_id, step, n FROM l JOIN m USING (user_id) WHERE n > a AND n >= b AND (n - mu) / (sd + 1e-12) > 1.0""")
def peaks(t):
    return S.local_peaks(day_grid(t), ["user_id"], "step", "n", 1.0, width=16.0)


@query("tim13_spaced_peaks")
def spaced_peaks(t):
    g = day_grid(t)
    by_time = S.local_peaks(g, ["user_id"], "step", "n", None, 4, "right_strict", "time", 16.0).withColumn("priority", F.lit("time"))
    by_height = S.local_peaks(g, ["user_id"], "step", "n", None, 4, "right_strict", "height", 16.0).withColumn("priority", F.lit("height"))
    return by_time.unionByName(by_height)


@query("tim14_bin_around", """
WITH i AS (SELECT event_id AS idx, user_id, ts AS t0 FROM events WHERE event_type = 'error'), k AS (SELECT *, unnest(range(12)) AS bin FROM i),
h AS (SELECT idx, floor((epoch_us(e.ts) / 1e6::DOUBLE - (epoch_us(t0) / 1e6::DOUBLE - 86400)) / 14400)::BIGINT AS bin, count(*) AS n FROM i JOIN events e ON e.user_id = i.user_id AND e.event_type = 'click'
   AND e.ts >= t0 - INTERVAL 1 DAY AND e.ts < t0 + INTERVAL 1 DAY GROUP BY 1, 2)
SELECT k.idx, k.bin::BIGINT AS bin, coalesce(n, 0)::BIGINT AS n FROM k LEFT JOIN h ON h.idx = k.idx AND h.bin = k.bin""")
def around(t):
    index = t.events.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("idx"), F.col("ts").alias("at"))
    d = S.bin_events_around(t.events.filter("event_type = 'click'"), index, ["user_id"], "ts", "idx", "at", DAY, DAY, DAY / 6, 2 * DAY)
    return d.select("idx", "bin", "n")


@query("tim15_window_aggregate", """
WITH b AS (SELECT user_id, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1), w AS (SELECT user_id, a, z, unnest(range(0, 40)) AS i FROM b),
k AS (SELECT * FROM w WHERE i * 86400 + 172800 <= epoch_us(z) / 1e6::DOUBLE - epoch_us(a) / 1e6::DOUBLE + 1e-9),
g AS (SELECT k.user_id, k.i, count(value) AS n, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM k LEFT JOIN events e ON e.user_id = k.user_id
  AND e.ts >= a + to_days(i::INT) AND e.ts < a + to_days(i::INT + 2) GROUP BY 1, 2)
SELECT user_id, i::BIGINT AS window_no, n::BIGINT AS n, CASE WHEN n >= 3 THEN round(m, 6) END AS mean, CASE WHEN n >= 3 THEN lo END AS min, CASE WHEN n >= 3 THEN hi END AS max,
 CASE WHEN n >= 3 THEN round(100 * (hi - lo) / ((hi + lo) / 2), 5) END AS variation FROM g""")
def windows(t):
    d = S.window_aggregate(t.events, ["user_id"], "ts", "value", 2 * DAY, DAY, 3)
    return d.select("user_id", "window_no", "n", F.round("mean", 6).alias("mean"), "min", "max", F.round("variation", 5).alias("variation"))


@query("tim16_first_sustained", f"""
WITH {GRID}, s AS (SELECT *, sum((n >= 2)::INT) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c FROM grid)
SELECT user_id, min(step) FILTER (c = 3) AS first_step FROM s GROUP BY 1""")
def sustained(t):
    return S.first_sustained(day_grid(t), ["user_id"], "step", F.col("n") >= 2, 3)


CUSUM = f"""{GRID}, base AS (SELECT user_id, greatest(avg(n), 0.1) / ln(2.0::DOUBLE) AS k FROM grid WHERE step < 10 GROUP BY 1),
r AS (SELECT user_id, 9 AS step, 0.0::DOUBLE AS s FROM base UNION ALL SELECT g.user_id, g.step, greatest(0, r.s + g.n - k) FROM r JOIN grid g ON g.user_id = r.user_id AND g.step = r.step + 1 JOIN base b ON b.user_id = g.user_id)"""


@query("tim17_cusum", f"""
WITH RECURSIVE {CUSUM} SELECT user_id, step::BIGINT AS step, round(s, 6) + 0 AS statistic, round(s, 6) >= 4 AS above FROM r WHERE step >= 10""")
def cusum(t):
    d = S.cusum(day_grid(t), ["user_id"], "step", "n", 10, width=16.0)
    return d.select("user_id", "step", F.round("statistic", 6).alias("statistic"), (F.round("statistic", 6) >= 4).alias("above"))


@query("tim17_cusum_signal", f"""
WITH RECURSIVE {CUSUM} SELECT user_id, min(step) FILTER (s >= 4)::BIGINT AS signal_step, count(*)::BIGINT AS n_steps FROM r WHERE step >= 10 GROUP BY 1""")
def cusum_first(t):
    return S.cusum_signal(S.cusum(day_grid(t), ["user_id"], "step", "n", 10, width=16.0), ["user_id"], "step")


@query("tim17_cusum_resets", f"""
WITH RECURSIVE {GRID}, r AS (SELECT user_id, -1 AS step, 0.0::DOUBLE AS s, 0 AS hit FROM (SELECT DISTINCT user_id FROM events) UNION ALL
 SELECT g.user_id, g.step, CASE WHEN greatest(0, r.s + g.n - 2.0::DOUBLE / ln(2.0::DOUBLE)) > 5 THEN 0 ELSE greatest(0, r.s + g.n - 2.0::DOUBLE / ln(2.0::DOUBLE)) END,
  (greatest(0, r.s + g.n - 2.0::DOUBLE / ln(2.0::DOUBLE)) > 5)::INT FROM r JOIN grid g ON g.user_id = r.user_id AND g.step = r.step + 1)
SELECT user_id, min(step) FILTER (hit = 1)::BIGINT AS first_alarm, sum(hit)::BIGINT AS n_alarms FROM r GROUP BY 1""")
def cusum_reset(t):
    return S.cusum_resets(day_grid(t), ["user_id"], "step", "n", F.lit(2.0))


@query("tim18_lead_times", f"""
WITH a AS (SELECT user_id, min({D}) FILTER (value > 100) AS s, min({D}) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)
SELECT user_id, e AS event_step, s AS signal_step, e - s AS lead, s IS NOT NULL AS flagged FROM a WHERE e IS NOT NULL""")
def leads(t):
    sig = t.events.filter("value > 100").groupBy("user_id").agg(F.min(day()).alias("signal_step"))
    ev = t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.min(day()).alias("event_step"))
    return S.lead_times(sig, ev, ["user_id"], "signal_step", "event_step")


LAGS = f"""g AS (SELECT event_type, {D} AS step, count(*)::DOUBLE AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
v AS (SELECT {D} AS step, count(*)::DOUBLE AS n FROM events WHERE event_type = 'view' GROUP BY 1),
a AS (SELECT event_type, step, n - avg(n) OVER (PARTITION BY event_type) AS x FROM g), b AS (SELECT event_type, step, n - avg(n) OVER (PARTITION BY event_type) AS y FROM v, (SELECT DISTINCT event_type FROM g)),
l AS (SELECT a.event_type, b.step - a.step AS lag, count(*)::BIGINT AS n, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)) + 1e-12) AS r FROM a JOIN b ON a.event_type = b.event_type AND b.step - a.step BETWEEN -5 AND 5 GROUP BY 1, 2 HAVING count(*) >= 10)"""


@query("tim19_lagged_corr", f"WITH {LAGS} SELECT event_type, lag::BIGINT AS lag, n, round(r, 6) + 0 AS r FROM l")
def lags(t):
    return rounded(_lags(t))


def _lags(t):
    n = t.events.groupBy("event_type", day().alias("step")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    a = n.filter("event_type <> 'view'")
    kinds = a.select("event_type").distinct().withColumn("_v", F.lit("view"))
    b = n.filter("event_type = 'view'").select(F.col("event_type").alias("_v"), "step", F.col("n").alias("m")).join(F.broadcast(kinds), "_v").drop("_v")
    return S.lagged_corr(a, b, ["event_type"], "step", "n", "m", 5).withColumn("lag", F.col("lag").cast("bigint"))


@query("tim19_best_lag", f"WITH {LAGS} SELECT event_type, lag::BIGINT AS lag, round(r, 6) AS r FROM l QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY r DESC, lag) = 1")
def best(t):
    return rounded(S.best_lag(_lags(t), ["event_type"]))


@query("tim20_alarms")
def alarm_steps(t):
    return S.alarms(day_grid(t).withColumn("p", F.col("n") / 6), ["user_id"], "step", "p", 4, 0.3, 0.5, 5)


@query("tim21_label_windows", f"""
WITH w AS (SELECT user_id, step, 24.0::DOUBLE * step AS ws, 24.0::DOUBLE * step + 24 AS we FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(31)) AS step)),
e AS (SELECT user_id, {H} AS a, {H} + 2 AS b FROM events WHERE event_type = 'error'),
h AS (SELECT w.user_id, w.step, max(CASE WHEN ws >= a - 1 - 60 AND we <= a - 1 THEN 2 WHEN (we > a - 1 AND ws < b + 12) OR (we > a - 6 AND ws < b + 6) THEN 1 ELSE 0 END) AS p FROM w LEFT JOIN e ON e.user_id = w.user_id GROUP BY 1, 2)
SELECT user_id, step::BIGINT AS step, CASE p WHEN 2 THEN 1 WHEN 1 THEN -1 ELSE 0 END::INT AS label FROM h""")
def window_labels(t):
    users = t.events.select("user_id").distinct()
    w = S.skeleton(users, ["user_id"], "step", 0, 30).withColumn("ws", F.col("step") * F.lit(24.0))
    e = t.events.filter("event_type = 'error'").select("user_id", hours().alias("a")).withColumn("b", F.col("a") + 2)
    return S.label_windows(w, e, ["user_id"], "ws", 24.0, "a", "b", 1.0, 60.0, 12.0, 6.0, 240.0).select("user_id", "step", "label")


@query("tim22_moving_average", f"""
WITH {GRID} SELECT user_id, step, round(avg(v) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS centred,
 round(avg(v) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS trailing FROM grid""")
def averages(t):
    d = S.moving_average(day_grid(t), ["user_id"], "step", "v", 5).withColumnRenamed("average", "centred")
    d = S.moving_average(d, ["user_id"], "step", "v", 5, "trailing").withColumnRenamed("average", "trailing")
    return rounded(d.select("user_id", "step", "centred", "trailing"))


@query("tim23_time_in_band", """
WITH f AS (SELECT event_type, count(*) AS n, count(*) FILTER (value < 10) AS low, count(*) FILTER (value < 50) AS mid FROM events GROUP BY 1),
l AS (SELECT event_type, n, 'value' AS variable, 10.0::DOUBLE AS threshold, low AS k FROM f)
SELECT event_type, variable, threshold, k::BIGINT AS n_flagged, round(k / sum(k) OVER ()::DOUBLE, 6) AS flag_share, round(n / sum(n) OVER ()::DOUBLE, 6) AS exposure_share,
 round(k / sum(k) OVER ()::DOUBLE / (n / sum(n) OVER ()::DOUBLE), 6) AS enrichment FROM l""")
def in_band(t):
    return rounded(S.time_in_band(t.events, "event_type", {"value": 10.0}))


@query("tim23_stage_shares", """
SELECT user_id, round(count(*) FILTER (event_type = 'view') / nullif(count(*) FILTER (event_type NOT IN ('error', 'signup')), 0)::DOUBLE, 6) AS share_view,
 round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type NOT IN ('error', 'signup')), 0)::DOUBLE, 6) AS share_click,
 (count(*) FILTER (event_type NOT IN ('error', 'signup')))::BIGINT AS sleep_rows,
 round(count(*) FILTER (event_type NOT IN ('error', 'signup')) / nullif(count(*) FILTER (event_type <> 'error'), 0)::DOUBLE, 6) AS efficiency FROM events GROUP BY 1""")
def stages(t):
    return rounded(S.stage_shares(t.events, ["user_id"], "event_type", ["view", "click"], "signup", "error"))


@query("tim24_transitions", """
WITH l AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), n AS (SELECT a, b, count(*)::BIGINT AS n FROM l WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT a AS from_state, b AS to_state, n, round(n / (sum(n) OVER (PARTITION BY a))::DOUBLE, 6) AS probability FROM n""")
def transitions(t):
    return rounded(S.transitions(t.events, ["user_id"], "ts", "event_type", DAY, ["event_id"]))


@query("tim24_dwell", """
WITH l AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
g AS (SELECT event_type, count(*)::BIGINT AS n, (count(*) FILTER (p IS NULL OR p <> event_type))::BIGINT AS r FROM l GROUP BY 1)
SELECT event_type, n AS rows, r AS runs, round(n / (sum(n) OVER ())::DOUBLE, 6) AS occupancy, round(n / r::DOUBLE, 6) AS mean_dwell FROM g""")
def dwell(t):
    return rounded(S.dwell(t.events, ["user_id"], "ts", "event_type", DAY, ["event_id"]))


@query("tim25_step_change", """
SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS max_so_far, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change,
 max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 0 AS ever_positive FROM events""")
def changes(t):
    d = S.step_change(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "value", DAY, ["event_id"])
    return d.select("event_id", "max_so_far", F.round("change", 6).alias("change"), "ever_positive")


@query("tim25_monotonicity", """
WITH c AS (SELECT value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT count(*)::BIGINT AS n_pairs, round(avg((d >= 0)::INT), 6) AS frac_nondecreasing, round(avg((d > 0)::INT), 6) AS frac_increasing FROM c WHERE d IS NOT NULL""")
def monotone(t):
    return rounded(S.monotonicity(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "value", DAY, ["event_id"]))


@query("tim25_first_last", """
SELECT user_id, min_by(value, (ts, event_id)) AS first, max_by(value, (ts, event_id)) AS last, count(*)::BIGINT AS n, round(max_by(value, (ts, event_id)) - min_by(value, (ts, event_id)), 6) + 0 AS delta FROM events GROUP BY 1""")
def ends(t):
    return rounded(S.first_last(t.events, ["user_id"], "ts", "value", ["event_id"]))


@query("tim25_label_stability", """
WITH l AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), p AS (SELECT * FROM l WHERE b IS NOT NULL),
s AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS pe FROM (SELECT a, count(*)::DOUBLE AS c FROM p GROUP BY 1)), o AS (SELECT count(*)::BIGINT AS n_pairs, avg((a = b)::INT) AS po FROM p)
SELECT n_pairs, round(po, 6) AS agreement, round(pe, 6) AS expected_agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM o, s""")
def stability(t):
    return rounded(S.label_stability(t.events, ["user_id"], "ts", "event_type", DAY, ["event_id"]))


@query("tim26_circular_summary", """
WITH h AS (SELECT event_type, hour(ts) + minute(ts) / 60.0::DOUBLE AS h FROM events), b AS (SELECT event_type, floor(h) AS k, count(*) AS c FROM h GROUP BY 1, 2),
pk AS (SELECT event_type, max(c)::BIGINT AS peak, (CASE WHEN count(*) < 24 THEN 0 ELSE min(c) END)::BIGINT AS trough FROM b GROUP BY 1),
g AS (SELECT event_type, count(*) AS n, avg(cos(h * pi() / 12)) AS c, avg(sin(h * pi() / 12)) AS s,
  avg((least(abs(h - 7), 24 - abs(h - 7), abs(h - 19), 24 - abs(h - 19)) <= 0.5)::INT) AS sh FROM h GROUP BY 1), r AS (SELECT *, sqrt(c * c + s * s) AS r FROM g)
SELECT event_type, n::BIGINT AS n, round(r, 6) AS resultant, round((atan2(s, c) * 12 / pi() + 24) % 24, 5) AS mean_hour, round(n * r * r, 6) AS z,
 round(least(greatest(exp(sqrt(1 + 4 * n + 4 * (n * n - (n * r) * (n * r))) - (1 + 2 * n)), 0), 1), 6) AS p, peak, trough, round(sh, 6) AS shift_share FROM r JOIN pk USING (event_type)""")
def circular(t):
    d = t.events.select("event_type", (F.hour("ts") + F.minute("ts") / 60.0).alias("h"))
    d = S.circular_summary(d, ["event_type"], "h")
    return rounded(d.withColumn("mean_hour", F.round("mean_hour", 5)))
