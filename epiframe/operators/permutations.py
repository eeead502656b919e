"""Sums over rows whose labels are dealt anew inside strata, by hypergeometric draws over counts: no row is copied per replicate.

Rows that are alike form a cell with a count.  A shuffle of a stratum gives label 1 to as many rows as had it, so how many fall on each slice of its
cells is a multivariate hypergeometric draw over the slices' sizes, and how many of those fall on each cell the same over the
cells' counts.  The first draw needs one number per slice, the second runs where the slice lies; what leaves a slice is its sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a slice, about.
SLICE_CELLS = 200_000
_MOST = 900_000_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric draw; counts beyond the generator's range by the normal with the same mean and variance, which there differs by less than its rounding."""
    total = good + bad
    if total < _MOST:
        return int(rng.hypergeometric(good, bad, sample)) if sample else 0
    mean = sample * (good / total)
    spread = np.sqrt(mean * (bad / total) * ((total - sample) / (total - 1)))
    return int(min(max(np.rint(mean + spread * rng.standard_normal()), max(0, sample - bad)), min(good, sample)))


def dealt(rng: np.random.Generator, counts: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` rows, drawn without replacement, fall on each cell of ``counts`` rows."""
    out = np.zeros(len(counts), np.int64)
    total = int(counts.sum())
    if sample >= total:
        return counts.astype(np.int64)
    if counts.max(initial=0) <= 1:
        where = np.flatnonzero(counts)
        out[where[rng.choice(len(where), sample, replace=False, shuffle=False)]] = 1
        return out
    if total < _MOST:
        return rng.multivariate_hypergeometric(counts.astype(np.int64), sample, method="marginals").astype(np.int64)
    for i, n in enumerate(counts.tolist()):
        out[i] = _hypergeometric(rng, int(n), total - int(n), sample)
        total, sample = total - int(n), sample - int(out[i])
    return out


def permuted_sums(cells: DataFrame, strata: Sequence[str], prepare: Callable[[pd.DataFrame], Callable[[np.ndarray], np.ndarray]], n: int, seed: int = 0, limit: int = SLICE_CELLS) -> DataFrame:
    """rep, place and v: sums over cells for the labels as they are (rep 0) and for ``n`` shuffles of them inside ``strata``.

    ``cells`` has a count ``n`` of rows, of which ``k`` have label 1, a number ``key`` that orders them, and what else ``prepare`` needs: it
    gets the cells of a slice and returns a function from the number of labelled rows per cell to a few sums.
    """
    d = cells.withColumn("stratum", F.to_json(F.struct(*[F.col(s).cast("string").alias(f"s{i}") for i, s in enumerate(strata)])) if strata else F.lit(""))
    parts = d.groupBy("stratum").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts"))
    d = d.join(parts, "stratum").withColumn("slice", F.pmod(F.xxhash64("key"), F.col("parts"))).drop("parts")
    sizes = d.groupBy("stratum", "slice").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # one entry per slice of a stratum, that is per SLICE_CELLS cells
    whole = sizes.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("slice", "n"))).alias("sizes"), F.sum("k").alias("k"))
    asked = whole.select(F.xxhash64("stratum").alias("hash"), "*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rep"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for hash_, stratum, sizes, k, rep in zip(b["hash"], b["stratum"], b["sizes"], b["k"], b["rep"], strict=True):
                rng = np.random.default_rng([seed, int(hash_) & 0xFFFFFFFFFFFFFFFF, int(rep)])
                counts = np.array([x["n"] for x in sizes], np.int64)
                yield pd.DataFrame({"stratum": stratum, "slice": [x["slice"] for x in sizes], "rep": rep, "k": dealt(rng, counts, int(k))})
    shares = asked.mapInPandas(split, "stratum STRING, slice LONG, rep INT, k LONG")

    def summed(rows: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable").reset_index(drop=True)
        counts, project = rows["n"].to_numpy(np.int64), prepare(rows)
        own = [int(rows["slice"].iloc[0]), *np.frombuffer(rows["stratum"].iloc[0].encode(), np.uint8).tolist()]
        sums = [project(rows["k"].to_numpy(np.int64))]
        share = share.sort_values("rep")
        for rep, k in zip(share["rep"].tolist(), share["k"].tolist(), strict=True):
            sums.append(project(dealt(np.random.default_rng([seed + 1, rep, *own]), counts, int(k))))
        table = np.array(sums, float)
        rep, place = np.indices(table.shape)
        out = pd.DataFrame({"rep": rep.ravel(), "place": place.ravel(), "v": table.ravel()})
        return out[(out["v"] != 0) | (out["place"] == 0)]
    done = d.groupBy("stratum", "slice").cogroup(shares.groupBy("stratum", "slice")).applyInPandas(summed, "rep INT, place INT, v DOUBLE")
    return done.groupBy("rep", "place").agg(F.sum("v").alias("v"))


def permuted_means(df: DataFrame, strata: Sequence[str], label: str, value: str, n: int, seed: int = 0, limit: int = SLICE_CELLS) -> DataFrame:
    """rep, sum and count of the non-null values of rows with label 1, for the labels as they are (rep 0) and ``n`` shuffles inside ``strata``."""
    cells = df.groupBy(*strata, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("k"))
    cells = cells.withColumn("key", F.xxhash64("value"))

    def prepare(rows: pd.DataFrame):
        v = rows["value"].to_numpy(float)
        known = ~np.isnan(v)
        table = np.column_stack([np.where(known, v, 0.0), known])
        return lambda x: x @ table
    sums = permuted_sums(cells, strata, prepare, n, seed, limit)
    pick = lambda i: F.sum(F.when(F.col("place") == i, F.col("v")).otherwise(0.0))
    return sums.groupBy("rep").agg(pick(0).alias("sum"), pick(1).alias("count"))
