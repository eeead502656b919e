"""SRC: scans, records, versions and unions."""

import uuid

from pyspark.sql import functions as F

from ..operators.splits import group_split
from ..plans.lineage import checkpoint_dir
from ..sources.records import (concat_harmonized, dedupe_latest, explode_pairs, flatten_devices, flatten_reports, latest_row,
                               parse_jsonl, read_corpus, read_manifest, read_table, write_manifest, write_table)
from .registry import query, rounded


@query("src01_read_table", """
SELECT o_orderpriority, count(*)::BIGINT AS n, 0::BIGINT AS n_channel, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1""")
def scan_declared(t):
    d = read_table(t.spark, f"{t.folder}/orders.parquet",
                   "o_orderkey BIGINT, o_orderdate TIMESTAMP, o_orderpriority STRING, o_totalprice DOUBLE, channel STRING",
                   columns=["o_orderpriority", "o_totalprice", "channel"], where=F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    return rounded(d.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count("channel").alias("n_channel"),
                                                    F.sum("o_totalprice").alias("total")), 2)


@query("src02_json_lines", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 10 = 0 AS broken FROM events""")
def json_lines(t):
    line = F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    d = parse_jsonl(t.events.select("event_id", line.alias("line")), "line", "k BIGINT")
    broken = F.col("_corrupt").isNotNull()
    return d.select("event_id", F.when(~broken, F.col("k")).alias("k"), broken.alias("broken"))


def part_reports(t):
    """A nested report per part: words of the name as drugs, type and brand as reactions."""
    drugs = F.transform(F.split("p_name", " "), lambda w, i: F.struct(
        F.when(i == 0, F.array(w)).alias("generic_name"), F.concat(F.lit(" "), w).alias("product"),
        (F.col("p_size") % 4 + i).cast("string").alias("role")))
    reactions = F.array(F.struct(F.col("p_type").alias("term")), F.struct(F.col("p_brand").alias("term")),
                        F.struct(F.col("p_type").alias("term")))
    return t.part.select("p_partkey", F.struct((F.col("p_size") % 3).alias("sex"), drugs.alias("drug"), reactions.alias("reaction")).alias("patient"))


@query("src03_flatten_reports", """
WITH p AS (SELECT *, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unknown' END AS sex,
  array_to_string(list_sort(list_distinct([upper(x) FOR x IN w])), '|') AS drugs,
  array_to_string(list_sort(list_distinct([upper(x) FOR x, i IN w IF p_size % 4 + i - 1 = 1])), '|') AS suspect,
  array_to_string(list_sort(list_distinct([p_type, p_brand])), '|') AS reactions FROM p""")
def flatten(t):
    d = flatten_reports(part_reports(t), ["p_partkey"])
    return d.select("p_partkey", "sex", *[F.array_join(c, "|").alias(c) for c in ("drugs", "suspect", "reactions")])


@query("src03_flatten_devices", """
SELECT page_id, CASE WHEN regexp_matches(url, '[?#]') THEN regexp_extract(url, '^https?://([^/]+)', 1) END AS brand,
  CASE WHEN regexp_matches(url, '[?#]') THEN 1 ELSE 0 END::INT AS n_devices, url || ' ' || url AS narrative, length(html)::VARCHAR AS manufacturer_narrative FROM pages""")
def flatten_device_rows(t):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    device = F.when(F.col("url").rlike("[?#]"), F.array(F.struct(host.alias("brand"), F.lit("X").alias("code"))))
    say = lambda k, x: F.struct(F.lit(k).alias("kind"), x.alias("text"))
    texts = F.array(say("Description of Event", F.col("url")), say("Additional Manufacturer Narrative", F.length("html").cast("string")),
                    say("description 2", F.col("url")))
    d = t.pages.select("page_id", device.alias("device"), texts.alias("texts"))
    return flatten_devices(d, ["page_id"]).drop("code")


@query("src04_explode_pairs", """
WITH p AS (SELECT p_partkey, unnest(list_distinct([upper(x) FOR x IN string_split(p_name, ' ')])) AS drug, p_type, p_brand FROM part)
SELECT drug, reaction, count(*)::BIGINT AS n FROM (SELECT drug, p_type AS reaction FROM p UNION ALL SELECT drug, p_brand FROM p) GROUP BY 1, 2""")
def pairs(t):
    d = explode_pairs(flatten_reports(part_reports(t), ["p_partkey"]), ["p_partkey"], "drugs", "reactions")
    return d.groupBy(F.col("drugs").alias("drug"), F.col("reactions").alias("reaction")).agg(F.count(F.lit(1)).alias("n"))


@query("src05_dedupe_latest", """
WITH v AS (SELECT user_id, event_type, coalesce(TRY_CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS BIGINT), 0) AS version, value FROM events)
SELECT DISTINCT user_id, event_type, version::VARCHAR AS version, value FROM v
QUALIFY rank() OVER (PARTITION BY user_id, event_type ORDER BY version DESC) = 1""")
def newest_versions(t):
    k = F.from_json("props", "k BIGINT")["k"]
    d = t.events.select("user_id", "event_type", (k % 7).cast("string").alias("version"), "value")
    return dedupe_latest(d, ["user_id", "event_type"], "version")


@query("src05_latest_image", """
SELECT c_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey
QUALIFY row_number() OVER (PARTITION BY c_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_image(t):
    d = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderkey", "o_totalprice", "o_orderdate")
    d = d.join(t.customer.select("c_custkey"), "c_custkey", "left_semi")
    return latest_row(d, ["c_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("src06_read_corpus", """
SELECT 'customer' AS dataset, count(*)::BIGINT AS n, count(c_nationkey)::BIGINT AS n_nation FROM customer
UNION ALL SELECT 'supplier', count(*), 0 FROM supplier UNION ALL SELECT 'nation', count(*), 0 FROM nation""")
def corpus(t):
    paths = [f"{t.folder}/{n}.parquet" for n in ("customer", "supplier", "nation")]
    d = read_corpus(t.spark, paths, "c_custkey BIGINT, c_nationkey INT", r"([^/]+)\.parquet")
    return d.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("c_nationkey").alias("n_nation"))


@query("src07_manifest_rows")
def manifest_rows(t):
    d = group_split(t.events.select("event_id", "user_id"), "user_id", {"train": 0.7, "val": 0.1, "test": 0.2}, seed=3)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("user_id").alias("first_user"))


@query("src07_manifest_read_back", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM orders)
SELECT split, count(DISTINCT o_orderkey)::BIGINT AS n_orders, count(l_orderkey)::BIGINT AS n_lines, round(sum(l_quantity), 2) AS quantity
FROM s LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def manifest_read_back(t):
    at = F.col("o_custkey") % 10
    split = F.when(at < 7, "train").when(at < 8, "val").otherwise("test")
    path = f"{checkpoint_dir(t.spark)}/manifest-{uuid.uuid4().hex}"
    write_manifest(t.orders.select("o_orderkey", split.alias("split")), path, ["o_orderkey"])
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    d = read_manifest(t.spark, path, "o_orderkey BIGINT").join(lines, "o_orderkey", "left")
    return rounded(d.groupBy("split").agg(F.count(F.lit(1)).alias("n_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), F.sum("q").alias("quantity")), 2)


@query("rel26_write_read", """
SELECT form, o_orderpriority, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_date
FROM orders, (VALUES ('parquet'), ('csv'), ('tsv')) f(form) WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2""")
def write_read(t):
    folder = f"{checkpoint_dir(t.spark)}/rel26-{uuid.uuid4().hex}"
    schema = "o_orderkey BIGINT, o_orderdate TIMESTAMP, o_orderpriority STRING, o_totalprice DOUBLE"
    back = []
    for form in ("parquet", "csv", "tsv"):
        write_table(t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice"), f"{folder}/orders.{form}", form)
        back.append(read_table(t.spark, f"{folder}/orders.{form}", schema, where=F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")).withColumn("form", F.lit(form)))
    d = back[0].unionByName(back[1]).unionByName(back[2])
    return rounded(d.groupBy("form", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderdate").alias("first_date")), 2)


@query("src08_concat_harmonized", """
SELECT source, count(*)::BIGINT AS n, round(sum(age), 2) AS age FROM (
 SELECT 'customer' AS source, c_acctbal AS age FROM customer WHERE c_acctbal >= 0 UNION ALL
 SELECT 'supplier', s_acctbal FROM supplier WHERE s_acctbal >= 0) GROUP BY 1""")
def harmonized(t):
    pos = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias("age")
    a = t.customer.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("subject"), pos("c_acctbal"), F.lit("M").alias("sex"))
    b = t.supplier.select(F.lit("supplier").alias("source"), pos("s_acctbal"), F.lit("F").alias("sex"), F.col("s_suppkey").alias("subject"),
                          F.col("s_nationkey").alias("site"))
    d = concat_harmonized([a, b], {"source": "string", "subject": "bigint", "age": "double", "sex": "string", "site": "int"}, ["subject", "age", "sex"])
    return rounded(d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("age").alias("age")), 2)
