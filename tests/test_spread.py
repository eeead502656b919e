"""Rows dealt out by their number, and queries that do so before rows of a report are joined."""

from pyspark.sql import functions as F

from epiframe.catalog import QUERIES
from epiframe.catalog import contingency
from epiframe.catalog.registry import Tables
from epiframe.plans import spread as plans

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(plans, "ROWS", 100)
    df = spark.range(2000).select(F.col("id").alias("k"))
    for rows, want in ((2000, 20), (0, 4), (401, 5)):
        d = plans.spread(df, "k", rows=rows)
        assert d.rdd.getNumPartitions() == want and d.agg(F.sum("k")).first()[0] == 1999000


def test_reports_are_dealt_out_before_the_joins(spark, monkeypatch):
    monkeypatch.setattr(plans, "ROWS", 500)
    n = -(-spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 500)
    found = plan(contingency.level_cells(Tables(spark, FOLDER)))
    assert n > 4 and "RepartitionByExpression [l_orderkey" in found and f", {n}" in found[found.index("RepartitionByExpression [o_orderkey"):]
    few = {tuple(r) for r in QUERIES["agg04_mantel_haenszel"](spark, FOLDER).collect()}
    monkeypatch.setattr(plans, "ROWS", 500_000)
    assert few == {tuple(r) for r in QUERIES["agg04_mantel_haenszel"](spark, FOLDER).collect()}


def test_reports_of_a_permutation_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(plans, "ROWS", 500)
    found = QUERIES["agg14_profile_permutation"](spark, FOLDER)
    assert "RepartitionByExpression [l_orderkey" in plan(found) and "RepartitionByExpression [o_orderkey" in plan(found)
    few = found.collect()
    monkeypatch.setattr(plans, "ROWS", 500_000)
    assert few == QUERIES["agg14_profile_permutation"](spark, FOLDER).collect()


def test_levels_of_pairs_are_dealt_out_once(spark, monkeypatch):
    from epiframe.plans.ordered import ordered_pairs
    rows = [(g, (i * 37 + g) % 41, (i * i + 3 * g) % 29, float(i % 3 == 0)) for g in range(2) for i in range(120)] + [(2, None, 1, 1.0), (3, 5, 5, 1.0)]
    df = spark.createDataFrame(rows, "g int, x int, y int, f double")
    monkeypatch.setattr(plans, "ROWS", 50)
    d = ordered_pairs(df, ["g"], "x", "y", F.col("f"), F.lit(1.0))
    for r in d.collect():
        own = [x for x in rows if x[0] == r.g and x[1] is not None]
        pairs = [(a[2], b[2]) for a in own for b in own if a[3] and a[1] < b[1]]
        assert (r.below, r.equal, r.total) == (sum(a < b for a, b in pairs), sum(a == b for a, b in pairs), len(pairs))
    assert "RepartitionByExpression [g" in plan(d)
