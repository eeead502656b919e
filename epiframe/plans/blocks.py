"""Every block of one table against blocks of another, a few pairs to a task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of the largest block and pairs of blocks in a task: what a task holds does not depend on the size of the tables.
MOST_ROWS, PAIRS_A_TASK = 8192, 4


def block_rows(n: int) -> int:
    """Rows of a block: small tables still make enough pairs for all cores."""
    return min(MOST_ROWS, max(512, n // 48))


def packed(df: DataFrame, n: int, part: Column, **lists: Column) -> tuple[DataFrame, int]:
    """One row per block: number ``_b`` and a list of every named column; and how many blocks there are for ``n`` rows."""
    count = max(1, math.ceil(n / block_rows(n)))
    d = df.select(F.pmod(part, F.lit(count)).cast("int").alias("_b"), *[c.alias(k) for k, c in lists.items()])
    return cut(d.groupBy("_b").agg(*[F.collect_list(k).alias(k) for k in lists])), count


def met(left: DataFrame, nl: int, right: DataFrame, nr: int, upper: bool = False) -> DataFrame:
    """All pairs (a, b) of blocks of both tables, with ``upper`` only those with a <= b.

    Both sides are dealt out by pair, so a task reads `PAIRS_A_TASK` pairs on the average, however many there are.
    """
    tasks = max(1, math.ceil(nl * nr / (2 if upper else 1) / PAIRS_A_TASK))
    lo = F.col("a") if upper else F.lit(0)
    hi = F.col("b") if upper else F.lit(nl - 1)
    a = left.withColumnRenamed("_b", "a").withColumn("b", F.explode(F.sequence(lo, F.lit(nr - 1)))).repartition(tasks, "a", "b")
    b = right.withColumnRenamed("_b", "b").withColumn("a", F.explode(F.sequence(F.lit(0), hi))).repartition(tasks, "a", "b")
    return a.hint("shuffle_hash").join(b, ["a", "b"])
