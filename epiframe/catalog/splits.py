"""SPL and MUL: splits, leakage checks and specification grids."""

from pyspark.sql import functions as F

from ..operators import splits as P
from .registry import query, rounded

DAY = 86400.0


@query("spl01_group_split")
def group_split(t):
    d = P.group_split(t.events.select("event_id", "user_id"), "user_id", {"train": 0.6, "val": 0.2, "test": 0.2}, 11)
    return d.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_groups"))


@query("spl02_grouped_folds", """
WITH w AS (SELECT user_id, count(*) AS w FROM events GROUP BY 1), r AS (SELECT user_id, w, row_number() OVER (ORDER BY w DESC, user_id) - 1 AS k FROM w),
f AS (SELECT w, CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS fold FROM r) SELECT fold::INT AS fold, sum(w)::BIGINT AS n_rows, count(*)::BIGINT AS n_groups FROM f GROUP BY 1""")
def folds(t):
    d = P.grouped_folds(t.events.select("event_id", "user_id"), "user_id", 5)
    per = d.groupBy("fold", "user_id").agg(F.count("*").alias("n"))
    return per.groupBy("fold").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"))


@query("spl03_temporal_split", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""")
def temporal(t):
    d = P.temporal_split(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", 0.7, ["event_id"], DAY)
    return d.select("event_id", "split")


@query("spl03_rolling_origin", """
WITH e AS (SELECT DISTINCT extract(year FROM o_orderdate)::INT AS y FROM orders) SELECT a.y AS test_era, b.y AS train_era FROM e a JOIN e b ON b.y < a.y""")
def rolling(t):
    return P.rolling_origin(t.orders.select(F.year("o_orderdate").alias("y")), "y")


@query("spl04_leakage_audit", """
WITH s AS (SELECT user_id, event_id % 1000 AS rec, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM events),
a AS (SELECT user_id, max((split = 'train')::INT) AS x, max((split <> 'train')::INT) AS y FROM s GROUP BY 1), b AS (SELECT rec, max((split = 'train')::INT) AS x, max((split <> 'train')::INT) AS y FROM s GROUP BY 1),
n AS (SELECT count(*) FILTER (EXISTS (SELECT 1 FROM s q WHERE q.user_id = s.user_id AND q.split = 'train' AND abs(epoch_us(q.ts) - epoch_us(s.ts)) <= 1800000000)) AS near_rows, count(*) AS test_rows FROM s WHERE split = 'test')
SELECT (SELECT sum(x * y) FROM a)::BIGINT AS shared_subjects, round((SELECT sum(x * y) / sum(y)::DOUBLE FROM a), 6) AS subject_overlap, (SELECT sum(x * y) FROM b)::BIGINT AS shared_records, near_rows::BIGINT AS near_rows, test_rows::BIGINT AS test_rows, false AS clean FROM n""")
def leakage(t):
    d = t.events.select("user_id", (F.col("event_id") % 1000).alias("rec"), F.date_trunc("hour", "ts").alias("ts"), F.when(F.col("event_id") % 4 == 0, "test").otherwise("train").alias("split"))
    return rounded(P.leakage_audit(d, "user_id", ["rec"], "ts", "split", 1800.0, DAY))


# an order's price from its customer's other orders: random folds know the customer, customer folds do not
@query("spl04_leakage_inflation", """
WITH f AS (SELECT o_custkey AS c, o_totalprice AS y, true AS leaky, o_orderkey % 5 AS fold FROM orders UNION ALL SELECT o_custkey, o_totalprice, false, o_custkey % 5 FROM orders),
p AS (SELECT *, (sum(y) OVER a - sum(y) OVER b) / nullif(count(*) OVER a - count(*) OVER b, 0) AS own, (sum(y) OVER u - sum(y) OVER v) / (count(*) OVER u - count(*) OVER v) AS rest
  FROM f WINDOW a AS (PARTITION BY leaky, c), b AS (PARTITION BY leaky, c, fold), u AS (PARTITION BY leaky), v AS (PARTITION BY leaky, fold)),
m AS (SELECT leaky, fold, avg(abs(y - coalesce(own, rest))) / 1000 AS metric FROM p GROUP BY 1, 2), g AS (SELECT avg(metric) FILTER (leaky) AS a, avg(metric) FILTER (NOT leaky) AS b FROM m)
SELECT round(a - b, 4) AS absolute, round((a - b) / b, 6) AS relative, true AS covered FROM g""")
def inflation(t):
    o = t.orders.select(F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("y"), F.inline(F.array(F.struct(F.lit(True).alias("leaky"), (F.col("o_orderkey") % 5).alias("fold")), F.struct(F.lit(False).alias("leaky"), (F.col("o_custkey") % 5).alias("fold")))))
    sums = lambda name, *by: o.groupBy(*by).agg(F.sum("y").alias(f"s_{name}"), F.count("*").alias(f"n_{name}"))
    d = o.join(sums("a", "leaky", "c"), ["leaky", "c"]).join(sums("b", "leaky", "c", "fold"), ["leaky", "c", "fold"]).join(F.broadcast(sums("u", "leaky")), ["leaky"]).join(F.broadcast(sums("v", "leaky", "fold")), ["leaky", "fold"])
    mean = lambda all_, out: (F.col(f"s_{all_}") - F.col(f"s_{out}")) / F.nullif(F.col(f"n_{all_}") - F.col(f"n_{out}"), F.lit(0))
    folds = d.groupBy("leaky", "fold").agg((F.avg(F.abs(F.col("y") - F.coalesce(mean("a", "b"), mean("u", "v")))) / 1000).alias("metric"))
    g = P.leakage_inflation(folds, ["fold"], "metric", "leaky", 300, 5)
    return g.select(F.round("absolute", 4).alias("absolute"), F.round("relative", 6).alias("relative"), F.col("absolute").between(F.col("low"), F.col("high")).alias("covered"))


@query("spl05_stratified_sample")
def sample(t):
    d = P.stratified_sample(t.part.select("p_partkey", "p_type"), "p_type", "p_partkey", None, 3)
    return d.groupBy("p_type").agg(F.count("*").alias("n"))


@query("mul01_spec_grid", """
WITH g AS (SELECT DISTINCT base, CASE WHEN base = 'min' THEN look ELSE 24 END AS look, delta FROM (SELECT unnest(['zero', 'min', 'first']) AS base), (SELECT unnest([24, 48]) AS look), (SELECT unnest([2, 3]) AS delta))
SELECT base, look, delta, 'base=' || base || '|look=' || look || '|delta=' || delta AS spec, (SELECT count(*) FROM orders WHERE o_totalprice > 100000 * delta)::BIGINT AS n FROM g""")
def grid(t):
    g = P.spec_grid(t.spark, {"base": ["zero", "min", "first"], "look": [24, 48], "delta": [2, 3]}, {"look": ("base", "min")})
    n = t.orders.agg(*[F.sum((F.col("o_totalprice") > 100000 * k).cast("int")).alias(f"n{k}") for k in (2, 3)])
    return g.join(F.broadcast(n)).select("base", "look", "delta", "spec", F.when(F.col("delta") == 2, F.col("n2")).otherwise(F.col("n3")).alias("n"))


SPECS = {"min_quantity": [10, 20, 30], "max_discount": [0.03, 0.07, 0.1], "flag": ["R", "A"]}


def _specs(t):
    keep = {"min_quantity": lambda v: F.col("l_quantity") >= v, "max_discount": lambda v: F.col("l_discount") <= v, "flag": lambda v: F.col("l_returnflag") == v}
    return P.run_specs(t.lineitem, SPECS, keep, {"n": F.count("*"), "n_late": F.sum((F.col("l_linestatus") == "F").cast("int")), "revenue": F.sum("l_extendedprice")})


@query("mul02_run_specs", """
WITH s AS (SELECT * FROM (SELECT unnest([10, 20, 30]) AS min_quantity), (SELECT unnest([0.03, 0.07, 0.1]::DOUBLE[]) AS max_discount), (SELECT unnest(['R', 'A']) AS flag))
SELECT min_quantity, max_discount, flag, count(*)::BIGINT AS n, count(*) FILTER (l_linestatus = 'F')::BIGINT AS n_late, round(sum(l_extendedprice), 2) AS revenue FROM s JOIN lineitem ON l_quantity >= min_quantity AND l_discount <= max_discount AND l_returnflag = flag GROUP BY 1, 2, 3""")
def specs(t):
    return rounded(_specs(t), 2)


@query("mul03_spec_curve", """
WITH s AS (SELECT * FROM (SELECT unnest([10, 20, 30]) AS min_quantity), (SELECT unnest([0.03, 0.07, 0.1]::DOUBLE[]) AS max_discount), (SELECT unnest(['R', 'A']) AS flag)),
r AS (SELECT min_quantity, max_discount, flag, count(*) FILTER (l_linestatus = 'F') / count(*)::DOUBLE - 0.5 AS effect, exp(-abs(count(*) FILTER (l_linestatus = 'F') / count(*)::DOUBLE - 0.5) * sqrt(count(*)) * 3) AS p FROM s JOIN lineitem ON l_quantity >= min_quantity AND l_discount <= max_discount AND l_returnflag = flag GROUP BY 1, 2, 3)
SELECT min_quantity, max_discount, flag, round(effect, 8) + 0 AS effect, row_number() OVER (ORDER BY effect, min_quantity, max_discount, flag)::BIGINT AS rank, round((SELECT avg((p < 0.05)::INT) FROM r), 6) AS share_significant,
 round((SELECT greatest(avg((effect > 0)::INT), 1 - avg((effect > 0)::INT)) FROM r), 6) AS share_same_sign, round((SELECT quantile_cont(effect, 0.5) FROM r), 8) + 0 AS median_effect FROM r""")
def curve(t):
    r = _specs(t).withColumn("effect", F.col("n_late") / F.col("n") - 0.5).withColumn("p", F.exp(-F.abs("effect") * F.sqrt("n") * 3))
    r = r.select("min_quantity", "max_discount", "flag", "effect", "p")
    return rounded(P.spec_curve(r, ["min_quantity", "max_discount", "flag"], "effect", "p").drop("p"), 8).withColumn(
        "share_significant", F.round("share_significant", 6)).withColumn("share_same_sign", F.round("share_same_sign", 6))


@query("mul04_label_shift", """
WITH h AS (SELECT user_id, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE AS h FROM events), a AS (SELECT user_id, min(h) AS x FROM h WHERE value > 150 GROUP BY 1), b AS (SELECT user_id, min(h) AS y FROM h WHERE value > 120 AND h > 24 GROUP BY 1),
j AS (SELECT x, y, y - x AS s FROM a FULL JOIN b USING (user_id))
SELECT count(s)::BIGINT AS n_both, round(avg((abs(s) > 6)::INT), 6) AS share_moved, round(avg(((x IS NULL) <> (y IS NULL))::INT), 6) AS flip_rate, round(quantile_cont(s, 0.25), 5) + 0 AS shift_q25, round(quantile_cont(s, 0.5), 5) + 0 AS shift_median, round(quantile_cont(s, 0.75), 5) + 0 AS shift_q75 FROM j""")
def label_shift(t):
    from .timeseries import hours
    h = t.events.select("user_id", "value", hours())
    a = h.filter("value > 150").groupBy("user_id").agg(F.min("hours").alias("onset"))
    b = h.filter("value > 120 AND hours > 24").groupBy("user_id").agg(F.min("hours").alias("onset"))
    d = P.label_shift_between(a, b, "user_id", "onset")
    return d.select("n_both", F.round("share_moved", 6).alias("share_moved"), F.round("flip_rate", 6).alias("flip_rate"), *[F.round(c, 5).alias(c) for c in ("shift_q25", "shift_median", "shift_q75")])
