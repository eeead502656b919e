"""Packing by optimal length buckets: dynamic programming over the global length histogram, then batches of a token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, BUDGET = 16, 65_536
#: Rows of a slice in which positions are counted.
SLICE = 20_000


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding sum(count * (bound - length)).

    The cost of a bucket meets the quadrangle inequality, so the best cut of a layer moves one way and each layer is solved by
    divide and conquer, all midpoints of a level together.
    """
    n = len(lengths)
    if not n:
        return []
    length = lengths.astype(np.float64)
    before = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])       # rows below each length
    best = length * before[1:]
    cuts = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        # best[j]: padded tokens of lengths 0..j; a last bucket i..j costs length[j] * (before[j + 1] - before[i])
        new, cut = np.full(n, np.inf), np.zeros(n, np.int64)
        level = [(0, n - 1, 0, n - 1)]
        while level:
            after = []
            for low, high, first, last in level:
                j = (low + high) // 2
                i = np.arange(first, min(last, j) + 1)
                prior = np.where(i > 0, best[np.maximum(i - 1, 0)], 0.0)
                cost = prior + length[j] * (before[j + 1] - before[i])
                k = int(cost.argmin())
                new[j], cut[j] = cost[k], i[k]
                if low < j:
                    after.append((low, j - 1, first, int(i[k])))
                if j < high:
                    after.append((j + 1, high, int(i[k]), last))
            level = after
        if new[-1] >= best[-1]:
            break
        best = new
        cuts.append(cut)
    out, j = [], n - 1
    for cut in reversed(cuts):
        out.append(int(lengths[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    return sorted(out)


def length_histogram(rows: DataFrame, length: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lengths and their rows.  Their sum is at most that of all lengths, so n tokens have at most sqrt(2 n) + 1 of them."""
    got = rows.groupBy(F.col(length).alias("v")).count().orderBy("v").collect()
    return np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.int64)


def pack(docs: DataFrame, length: Column, buckets: int = BUCKETS, budget: int = BUDGET, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, bucket_length, batch, position, padding.

    Documents of a bucket are padded to its length; floor(budget / length) of them, one at least, make a batch, so a document over
    the budget is a batch by itself.  Inside a bucket documents follow the hash of their identifier, then the identifier and
    length; repeated rows get places of their own in any order.  A null length counts as 0 and a null identifier is a value.
    Places are counted in hash slices of bounded size plus the sum of the slices before, so a bucket with most rows is never in
    one task.  An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"))
    from .common import cut
    rows = cut(rows)
    values, counts = length_histogram(rows, "n_tokens")
    bounds = optimal_bounds(values, counts, buckets)
    if not bounds:
        return spark.createDataFrame([], f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, bucket int, bucket_length long, batch long, position int, padding long")
    slices = max(1, -(-int(counts.sum()) // SLICE))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("n_tokens")))).withColumn("h", F.xxhash64("doc_id", "n_tokens"))
    width = (1 << 64) // slices
    rows = rows.withColumn("slice", F.least(F.floor((F.col("h").cast("double") + float(1 << 63)) / float(width)), F.lit(slices - 1)).cast("long"))
    ahead = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("bucket", "slice").agg(F.count("*").alias("c")).select("bucket", "slice", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket", "slice").orderBy("h", "doc_id", "n_tokens")
    placed = rows.withColumn("r", F.row_number().over(inside)).join(starts, ["bucket", "slice"]).withColumn("r", F.col("start") + F.col("r") - 1)
    placed = placed.withColumn("bucket_length", F.element_at(edges, F.col("bucket") + 1)).withColumn("each", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))))
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_length", F.floor(F.col("r") / F.col("each")).alias("batch"), (F.col("r") % F.col("each")).cast("int").alias("position"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"))
