"""STR: streaming twins."""

from pyspark.sql import functions as F

from ..streaming.online import arrivals, run_arrivals, stream_counts, stream_cusum, stream_dedupe, stream_sessions
from .registry import query, rounded

#: The events arrive in this many batches, each row up to 18 hours late; watermarks of a day let all of them in.
BATCHES, DISORDER = 5, 18 * 3600


def batches(t, *columns):
    d = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), *columns)
    return arrivals(d, "ts", BATCHES, DISORDER, "event_id")


def naive(d):
    """Times back to the zone-less type of the tables."""
    return d.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in d.dtypes])


@query("str01_stream_counts", """
SELECT event_type, date_trunc('day', ts) AS window_start, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def counts(t):
    return naive(run_arrivals(batches(t, "event_type"), lambda d: stream_counts(d, ["event_type"], "ts", "1 day", "1 day"), "update", ["event_type", "window_start"]))


@query("str02_stream_sessions", """
WITH f AS (SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= 21600, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM f)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_seen, count(*)::BIGINT AS n FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)""")
def sessions(t):
    """Sessions that the watermark has closed; the others are still open when the events end."""
    return naive(run_arrivals(batches(t, "user_id"), lambda d: stream_sessions(d, ["user_id"], "ts", "1 day", "6 hours"), "append"))


@query("str03_stream_dedupe", """
SELECT user_id, event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2""")
def dedupe(t):
    d = run_arrivals(batches(t, "user_id", "event_type"), lambda d: stream_dedupe(d.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "31 days"), "append")
    return d.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


# S after a day with rows is P - min(P, least of all P before it), P the running sum of n - k per day; between days with rows P only falls
@query("str04_stream_cusum", """
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)),
p AS (SELECT *, date_diff('day', first_value(day) OVER w, day) AS i, sum(n) OVER w AS upto, 2.0::DOUBLE / ln(2.0::DOUBLE) AS k FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
s AS (SELECT user_id, day, upto - k * (i + 1) AS after, upto - n - k * i AS before FROM p), c AS (SELECT user_id, day, after - least(after, min(before) OVER (PARTITION BY user_id ORDER BY day)) AS s FROM s)
SELECT user_id, min(day)::TIMESTAMP AS signal_step, round(arg_min(s, day), 6) AS statistic FROM c WHERE s >= 4 - 1e-9 GROUP BY 1""")
def online_cusum(t):
    return rounded(naive(run_arrivals(batches(t, "user_id"), lambda d: stream_cusum(d, "user_id", "ts", "1 day", 86400, 2.0, 2.0, 4.0), "append")))
