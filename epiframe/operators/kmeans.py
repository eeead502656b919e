"""k-means of sparse rows whose centres never are in one place.

The centres of texts have as many entries as the vocabulary.  Rows are dealt out once into parts; a part sees the entries of the centres for its own
terms only, and tells the sums of these terms.  Sums of a term meet in a shuffle and go back to the parts that have the term, so what a round moves is
the distinct terms of every part, and what reaches the driver are a few numbers a centre.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniforms
from ..plans.fits import stopped
from ..plans.lineage import cut

#: Numbers of the rows that hold counts of members, and sums of their products with the last centre, in a table of sums.
COUNTS, PRODUCTS = -1, -2


def _flat(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, ix, v) of all entries."""
    ix, v = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows.column("ix"), rows.column("v")))
    return np.repeat(np.arange(len(ix)), ix.value_lengths().to_numpy(zero_copy_only=False)), ix.flatten().to_numpy(), v.flatten().to_numpy()


def _products(row: np.ndarray, at: np.ndarray, v: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
    return np.column_stack([np.bincount(row, v * dense[at, j], n) for j in range(dense.shape[1])])


def _nearest(placed: DataFrame, points: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``placed`` with ``near`` (the nearest of a few sparse points) and ``cost`` (its squared distance)."""
    terms, dense = _dense(points)
    square = (dense * dense).sum(axis=0)
    padded = np.vstack([dense, np.zeros((1, len(points)))])

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                row, ix, v = _flat(part)
                at = np.minimum(np.searchsorted(terms, ix), len(terms) - 1)
                at = np.where(terms[at] == ix, at, len(terms))
                far = square - 2 * _products(row, at, v, part.num_rows, padded)
                near = far.argmin(axis=1)
                cost = np.maximum(far[np.arange(len(near)), near] + np.bincount(row, v * v, part.num_rows), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near, pa.int32()), pa.array(cost)], names=[*part.schema.names, "near", "cost"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    return placed.mapInArrow(run, f"{kinds}, near INT, cost DOUBLE")


def _dense(points: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a few sparse points, and their entries there: one column a point."""
    terms = np.unique(np.concatenate([ix for ix, _ in points]))
    dense = np.zeros((len(terms), len(points)))
    for j, (ix, v) in enumerate(points):
        dense[np.searchsorted(terms, ix), j] = v
    return terms, dense


def _start(placed: DataFrame, row_id: str, k: int, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, first centres) by k-means||: some 2k rows a step drawn by their cost, weighted by the rows nearest to them, clustered on the driver."""
    def drawn(d):
        return [(np.asarray(r.ix), np.asarray(r.v)) for r in d.select(row_id, "ix", "v").orderBy(row_id).collect()]
    points = drawn(placed.orderBy(F.xxhash64(F.lit(seed), row_id), row_id).limit(1))
    for step in range(steps if points else 0):
        costs = _nearest(placed, points)
        total = costs.agg(F.sum("cost")).first()[0]
        if not total > 0:
            break
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(step), row_id), 11) / float(1 << 53)
        points += drawn(costs.filter(draw < F.col("cost") * (2.0 * k / total)))
    if not points:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    terms, dense = _dense(points)
    weight = np.zeros(len(points))
    for r in _nearest(placed, points).groupBy("near").count().collect():
        weight[r.near] = r["count"]
    x, same = np.unique(dense.T, axis=0, return_inverse=True)
    weight = np.bincount(same.ravel(), weight, len(x))
    return terms, (x if len(x) <= k else _few(x, weight, k, seed)).T


def _few(x: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 30) -> np.ndarray:
    """Weighted k-means++ of a few points."""
    draws = uniforms(np.arange(k), 1, seed)[:, 0]

    def pick(p, u):
        total = np.cumsum(p)
        return min(int(np.searchsorted(total, u * total[-1], side="right")), len(x) - 1)
    centres = [x[pick(weight, draws[0])]]
    for u in draws[1:]:
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[pick(weight * far if (weight * far).any() else far, u)])
    centres, last = np.array(centres), None
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if last is not None and (near == last).all():
            break
        last = near
        for j in range(k):
            if weight[near == j].sum() > 0:
                centres[j] = np.average(x[near == j], axis=0, weights=weight[near == j])
    return centres


def sparse_kmeans(rows: DataFrame, row_id: str, k: int, parts: int, rounds: int = 20, tol: float = 1e-4, steps: int = 2, seed: int = 0) -> DataFrame:
    """row_id and cluster (0 to k - 1) of sparse rows with arrays ``ix`` (from 0, without repeats) and ``v``: Lloyd's rounds from k-means|| until no centre moves by more than ``tol``.

    ``row_id`` is unique and no row is empty.  A part's rows are in one task; a centre without rows stays where it was; fewer than ``k`` distinct rows make fewer clusters.
    """
    # both sides of a round lie by part, so that the rows are dealt out once
    def dealt(d, by):
        return d.repartition(parts, by).sortWithinPartitions(by)
    placed = dealt(rows.select(F.pmod(F.xxhash64(row_id), F.lit(parts)).cast("int").alias("part"), row_id, "ix", "v"), "part").persist()
    placed.count()
    terms, first = _start(placed, row_id, k, steps, seed)
    k = first.shape[1]
    kind = placed.schema[row_id].dataType.simpleString()
    if not k:
        return placed.select(row_id, F.lit(0).alias("cluster"))
    names = [f"s{j}" for j in range(k)]
    table = placed.sparkSession.createDataFrame(pa.table([pa.array(terms, pa.int32()), *[pa.array(first[:, j]) for j in range(k)]], names=["ix", *names]))
    centres = cut(dealt(placed.select(F.col("part").alias("at")).distinct().crossJoin(table).select("at", "ix", *names), "at"))
    counts, squares = np.ones(k), (first * first).sum(axis=0)

    def near(left, right, counts, squares):
        """Entries, terms and nearest centres of a part's rows, and all products."""
        row, ix, v = _flat(left)
        own, at = np.unique(ix, return_inverse=True)
        told = right.column("ix").to_numpy()
        place = np.minimum(np.searchsorted(own, told), len(own) - 1)
        known = own[place] == told
        dense = np.zeros((len(own), k))
        dense[place[known]] = np.column_stack([right.column(c).to_numpy() for c in names])[known] / counts
        products = _products(row, at, v, left.num_rows, dense)
        return row, own, at, v, (squares / 2 - products).argmin(axis=1), products

    def summed(counts, squares):
        def run(left, right):
            row, own, at, v, cluster, products = near(left, right, counts, squares)
            sums = np.bincount(at * k + cluster[row], v, len(own) * k).reshape(-1, k)
            members = np.bincount(cluster, minlength=k).astype(float)
            inner = np.bincount(cluster, products[np.arange(len(cluster)), cluster], k)
            ix = np.concatenate([[COUNTS, PRODUCTS], own])
            out = np.vstack([members, inner, sums])
            part = np.full(len(ix), left.column("part")[0].as_py())
            return pa.table([pa.array(part, pa.int32()), pa.array(ix, pa.int32()), *[pa.array(out[:, j]) for j in range(k)]], names=["at", "ix", *names])
        return run

    def told(counts, squares):
        def run(left, right):
            return pa.table([left.column(row_id), pa.array(near(left, right, counts, squares)[4], pa.int32())], names=[row_id, "cluster"])
        return run

    def met(run, schema):
        return placed.groupBy("part").cogroup(centres.groupBy("at")).applyInArrow(run, schema)

    for _ in range(rounds):
        sums = met(summed(counts, squares), f"at INT, ix INT, {', '.join(f'{c} DOUBLE' for c in names)}")
        w = Window.partitionBy("ix")
        now = cut(dealt(sums.select("at", "ix", *[F.sum(c).over(w).alias(c) for c in names], (F.col("at") == F.min("at").over(w)).alias("one")), "at"))
        got = now.filter("one").agg(*[F.sum(F.when(F.col("ix") >= 0, F.col(c) * F.col(c))) for c in names],
                                    *[F.max(F.when(F.col("ix") == n, F.col(c))) for n in (COUNTS, PRODUCTS) for c in names]).first()
        square, members, inner = np.array(got, float).reshape(3, k)
        gone = members == 0
        members, inner = np.where(gone, counts, members), np.where(gone, counts * squares, inner)
        square = np.where(gone, squares, square / members ** 2)
        if gone.any():
            kept = [c for c, g in zip(names, gone, strict=True) if g]
            now = cut(dealt(now.drop(*kept).join(centres.select("at", "ix", *kept), ["at", "ix"], "left").na.fill(0.0, kept), "at"))
        moved = square + squares - 2 * inner / members
        centres, counts, squares = now, members, square
        if (moved <= tol * tol).all():
            break
    else:
        stopped("sparse_kmeans", rounds)
    out = cut(met(told(counts, squares), f"`{row_id}` {kind}, cluster INT"))
    placed.unpersist()
    return out
