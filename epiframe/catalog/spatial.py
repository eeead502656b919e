"""SPT: the first embedding dimensions as coordinates, the label as region."""

from pyspark.sql import functions as F

from ..operators import spatial as P
from .registry import query, rounded


def points(t):
    e = lambda i: F.round(F.col("embedding")[i].cast("double"), 6)
    return t.embeddings.select("vec_id", "label", e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), e(3).alias("v"))


PTS = "p AS (SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS z, round(embedding[4]::DOUBLE, 6) AS v FROM embeddings)"


@query("spt01_region_stats", f"""
WITH {PTS}, g AS (SELECT label, count(v)::BIGINT AS n, avg(v) AS m, max(v) AS peak, avg(x) AS cx, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM p WHERE label <> 0 GROUP BY 1 HAVING count(v) >= 5)
SELECT label, n, round(m, 8) + 0 AS mean, round(peak, 8) AS peak, round(cx, 8) + 0 AS centre_x, round(med, 8) + 0 AS median, round(a, 8) + 0 AS p05, round(b, 8) + 0 AS p95, round((SELECT avg((v >= 0.5 * peak)::INT) FROM p WHERE p.label = g.label), 8) AS share_above FROM g""")
def regions(t):
    return rounded(P.region_stats(points(t), "label", "v", 5, 0, 0.5, ["x"]), 8)


@query("spt01_weighted_percentile", f"""
WITH {PTS}, c AS (SELECT label, v, sum(1 + abs(x)) OVER (PARTITION BY label ORDER BY v) AS cum, sum(1 + abs(x)) OVER (PARTITION BY label) AS t FROM p) SELECT label, min(v) FILTER (cum >= 0.9 * t - 1e-12) AS percentile FROM c GROUP BY 1""")
def weighted(t):
    return P.weighted_percentile(points(t).withColumn("w", 1 + F.abs("x")), "label", "v", "w", 0.9)


def lookup(t):
    d = points(t).select(*[F.floor(F.col(c) / 0.1).cast("bigint").alias(f"v{i}") for i, c in enumerate("xyz")], "label")
    return d.groupBy("v0", "v1", "v2").agg(F.max("label").alias("region")).filter("region > 0")


LOOK = f"""{PTS}, q AS (SELECT *, floor(x / 0.1::DOUBLE)::BIGINT AS v0, floor(y / 0.1::DOUBLE)::BIGINT AS v1, floor(z / 0.1::DOUBLE)::BIGINT AS v2 FROM p), lk AS (SELECT v0, v1, v2, max(label) AS region FROM q GROUP BY 1, 2, 3 HAVING max(label) > 0),
asg AS (SELECT q.*, coalesce(region, 0)::INT AS region, CASE WHEN x < 0 THEN 'left' ELSE 'right' END AS side FROM q LEFT JOIN lk USING (v0, v1, v2))"""


@query("spt02_assign_voxels", f"WITH {LOOK} SELECT vec_id, v0, v1, v2, region, side FROM asg")
def voxels(t):
    return P.assign_voxels(points(t), ["x", "y", "z"], 0.1, lookup(t), "region", 0.0).select("vec_id", "v0", "v1", "v2", "region", "side")


@query("spt02_region_counts", f"""
WITH {LOOK}, vol AS (SELECT region, count(*) * 0.001::DOUBLE AS vol FROM lk GROUP BY 1), c AS (SELECT side, region, count(*)::BIGINT AS n FROM asg GROUP BY 1, 2) SELECT side, region, n, round(n / (sum(n) OVER (PARTITION BY side))::DOUBLE, 6) AS share, round(n / vol, 3) AS density FROM c LEFT JOIN vol USING (region)""")
def counts(t):
    a = P.assign_voxels(points(t), ["x", "y", "z"], 0.1, lookup(t), "region", 0.0)
    d = P.region_counts(a, ["side"], "region", lookup(t), 0.1)
    return d.select("side", "region", "n", F.round("share", 6).alias("share"), F.round("density", 3).alias("density"))


@query("spt03_morans_i", f"""
WITH {PTS}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), b.vec_id) AS r FROM p a JOIN p b ON a.vec_id <> b.vec_id),
s AS (SELECT i, j FROM d WHERE r <= 8 UNION SELECT j, i FROM d WHERE r <= 8), m AS (SELECT avg(v) AS m, count(*) AS n, var_pop(v) * count(*) AS ss FROM p)
SELECT min(n)::BIGINT AS n, count(*)::BIGINT AS w, round(min(n) / count(*)::DOUBLE * sum((a.v - m) * (b.v - m)) / min(ss), 6) + 0 AS moran_i FROM s JOIN p a ON a.vec_id = i JOIN p b ON b.vec_id = j, m""")
def moran(t):
    return rounded(P.morans_i(points(t), "vec_id", "v", ["x", "y", "z"], 8, 0.08))


@query("spt03_morans_i_distance", f"""
WITH {PTS}, m AS (SELECT avg(v) AS m, count(*) AS n, var_pop(v) * count(*) AS ss FROM p), d AS (SELECT 1 / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS w, (a.v - m) * (b.v - m) AS zz FROM p a JOIN p b ON a.vec_id <> b.vec_id, m)
SELECT (SELECT n FROM m)::BIGINT AS n, round((SELECT n FROM m) / sum(w) * sum(w * zz) / (SELECT ss FROM m), 6) + 0 AS moran_i FROM d""")
def moran_distance(t):
    return rounded(P.morans_i_distance(points(t), "v", ["x", "y", "z"]))


@query("spt04_variogram", f"""
WITH {PTS}, d AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d, 0.5 * pow(a.v - b.v, 2) AS g FROM p a JOIN p b ON a.vec_id < b.vec_id), e AS (SELECT max(d) * 0.5 AS e FROM d)
SELECT least(floor(d / e * 10), 9)::INT AS bin, count(*)::BIGINT AS n, round(avg(d), 6) AS mean_distance, round(avg(g), 6) AS gamma FROM d, e WHERE d < e GROUP BY 1""")
def gamma(t):
    return rounded(P.variogram(points(t), "v", ["x", "y", "z"]))


@query("spt05_matched_enrichment")
def enrichment(t):
    d = t.part.join(t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("score"), F.count("*").alias("size")), "p_partkey")
    return rounded(P.matched_set_enrichment(d.withColumn("in_set", F.col("p_brand") == "Brand#7"), "p_partkey", "score", "in_set", "size", 5, 50, 3))
