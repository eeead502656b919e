"""Logistic regressions of sparse rows whose coefficients never are in one place.

The coefficients of texts are as many as the vocabulary.  Scaled, the best ones are a weighted sum of the rows that were fitted (nothing else lowers the
penalty), so the fit looks for one weight a fitted row.  Rows are packed into parts and their terms dealt out once into blocks; a block's task
multiplies all weights by its own terms and back, and what it tells is one number a fitted row.  L-BFGS needs no more than products of such vectors; the
vectors stay with their parts, their products and the intercepts reach the driver, and a search along a line reads no term at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fits import stopped
from ..plans.lineage import cut, forget, written

#: Entries and labels of the rows of one part, at most about; remembered steps.
PART_ENTRIES, PART_LABELS, STEPS = 2_000_000, 100_000, 10
#: Places of a part's vectors: label, weight, weights of the rows, their products with all rows, gradient, its products; then the remembered steps, twice each.
Y, W, A, KA, G, KG, FIRST = range(7)


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, float).tobytes()


def _array(scalar: pa.Scalar, kind=float) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), kind)


def _packed(rows: DataFrame, row_id: str, labels: Sequence[str], fit: str, blocks: int) -> DataFrame:
    """The entries of each part of the rows by block of terms, and for block -1 its identifiers and labels; fitted rows are in parts of their own."""
    names, k = [row_id, *labels, fit, "ix", "v"], len(labels)

    def flushed(part: int, fitted: bool, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        lists, v = t.column("ix").combine_chunks(), t.column("v").combine_chunks()
        place = np.repeat(np.arange(t.num_rows, dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
        ix, v = lists.flatten().to_numpy(), v.flatten().to_numpy()
        block = ix % blocks
        order = np.argsort(block, kind="stable")
        some, first = np.unique(block[order], return_index=True)
        y = np.column_stack([t.column(c).cast(pa.float64()).to_numpy() for c in labels])
        kind = t.schema.field(row_id).type
        ids = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(row_id).combine_chunks())

        def row(block, place, ix, v, ids, y):
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block], pa.int32()), pa.array([fitted]), pa.array([place], pa.binary()), pa.array([ix], pa.binary()), pa.array([v], pa.binary()), ids, pa.array([y], pa.binary())],
                                              names=["part", "block", "fit", "place", "ix", "v", "ids", "y"])
        yield row(-1, None, None, None, ids, _bytes(y))
        none = pa.array([None], pa.list_(kind))
        for b, own in zip(some.tolist(), np.split(order, first[1:]), strict=True):
            yield row(b, place[own].tobytes(), (ix[own] // blocks).astype(np.int32).tobytes(), _bytes(v[own]), none, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = TaskContext.get().partitionId() << 32, {True: [], False: []}, {True: [0, 0], False: [0, 0]}
        for b in batches:
            for some in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                fitted = some.column(k + 1).fill_null(False)
                for kind, mask in ((True, fitted), (False, pc.invert(fitted))):
                    part = some.filter(mask)
                    if part.num_rows:
                        held[kind].append(part)
                        size[kind] = [size[kind][0] + len(part.column(k + 2).flatten()), size[kind][1] + part.num_rows * k]
                        if size[kind][0] >= PART_ENTRIES or size[kind][1] >= PART_LABELS:
                            yield from flushed(at, kind, held[kind])
                            at, held[kind], size[kind] = at + 1, [], [0, 0]
        for kind in (True, False):
            if held[kind]:
                yield from flushed(at, kind, held[kind])
                at += 1
    kind = rows.schema[row_id].dataType.simpleString()
    # written once: which rows share a part depends on the order in which tasks meet them
    return written(rows.select(*names).mapInArrow(run, f"part LONG, block INT, fit BOOLEAN, place BINARY, ix BINARY, v BINARY, ids ARRAY<{kind}>, y BINARY"))


class _Block:
    """The fitted rows' entries of a block, their vectors, and the products between them; k columns, one a label."""

    def __init__(self, cells: pa.Table, vectors: pa.Table, k: int):
        self.k, self.vectors = k, {p: _array(x).reshape(-1, k) for p, x in zip(vectors.column("of").to_pylist(), vectors.column("x"), strict=True)}
        self.cells, self.mean, self.scale = [], None, None
        for part, place, ix, v in zip(cells.column("part").to_pylist(), cells.column("place"), cells.column("ix"), cells.column("v"), strict=True):
            if part < 0:
                self.mean, self.scale = _array(place).reshape(-1, k), _array(v).reshape(-1, k)
            else:
                self.cells.append((part, _array(place, np.int32), _array(ix, np.int32), _array(v)))
        self.terms = max((int(ix.max()) + 1 for _, _, ix, _ in self.cells), default=0)

    def summed(self, f=lambda v: v) -> np.ndarray:
        out = np.zeros((self.terms, self.k))
        for part, place, ix, v in self.cells:
            x = self.vectors[part]
            for j in range(self.k):
                out[:, j] += np.bincount(ix, f(v) * x[place, j], self.terms)
        return out

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Weighted means, and one over the variances (none for a term that does not vary), of each term; the vectors are weights that sum to one."""
        mean, weight = self.summed(), self.summed(np.ones_like)
        square = np.zeros_like(mean)
        for part, place, ix, v in self.cells:
            x = self.vectors[part]
            for j in range(self.k):
                far = v - mean[ix, j]
                square[:, j] += np.bincount(ix, x[place, j] * far * far, self.terms)
        square += np.maximum(1 - weight, 0) * mean * mean
        rest = 1 - sum((x * x).sum(axis=0) for x in self.vectors.values())
        variance = square / np.where(rest > 0, rest, np.inf)
        return mean, np.where(variance > 1e-300, 1 / np.where(variance > 1e-300, variance, 1), 0.0)

    def coefficients(self) -> np.ndarray:
        return (self.summed() - self.mean * sum(x.sum(axis=0) for x in self.vectors.values())) * self.scale


def _products(place: np.ndarray, ix: np.ndarray, v: np.ndarray, n: int, terms: np.ndarray) -> np.ndarray:
    return np.column_stack([np.bincount(place, v * terms[ix, j], n) for j in range(terms.shape[1])])


def _dealt(d: DataFrame, blocks: int) -> DataFrame:
    return d.repartition(blocks, "block").sortWithinPartitions("block")


def _loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, np.where(y == 1, -z, z))


def _chance(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _direction(gram: np.ndarray, shift: np.ndarray, steps: int) -> np.ndarray:
    """Shares of the remembered steps, their changes of the gradient and the gradient in the next direction, from their products alone."""
    dot = gram + np.outer(shift, shift)
    share, last = np.zeros(2 * STEPS + 1), []
    share[-1] = -1.0
    for i in range(steps):
        j = STEPS + i
        a = dot[i] @ share / dot[i, j]
        share[j] -= a
        last.append(a)
    if steps:
        share *= dot[0, STEPS] / dot[STEPS, STEPS]
    for i in reversed(range(steps)):
        share[i] += last[i] - dot[STEPS + i] @ share / dot[i, STEPS + i]
    return share


def sparse_logistic(rows: DataFrame, row_id: str, labels: Sequence[str], fit: str, blocks: int, min_pos: int = 5, reg: float = 0.01, most: int = 150, tol: float = 1e-9) -> DataFrame | None:
    """row_id, label and probability of every row for each 0/1 column of ``labels`` with ``min_pos`` positives among the rows of ``fit`` and not only these; None without such a label.

    Rows are sparse: arrays ``ix`` (from 0, without repeats) and ``v``; a task holds the fitted rows' entries of one of the ``blocks``.  Both classes weigh the same; ``reg`` / 2 times the squares of the coefficients, each times its
    term's standard deviation, is added to the mean loss; intercepts are free.  Ends when a round lowers no loss by more than ``tol``, or after ``most`` rounds.
    """
    cells, wide = _packed(rows, row_id, labels, fit, blocks), len(labels)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y in b.column(0):
                y = _array(y).reshape(-1, wide)
                yield pa.RecordBatch.from_arrays([pa.array([_bytes(np.array([np.full(wide, len(y)), np.nansum(y, axis=0), (~np.isnan(y)).sum(axis=0)]))])], names=["x"])
    counts = sum((np.frombuffer(r.x) for r in cells.filter("fit AND block = -1").select("y").mapInArrow(counted, "x BINARY").collect()), np.zeros(3 * wide)).reshape(3, wide)
    kept = [j for j in range(wide) if min_pos <= counts[1, j] != counts[0, j]]
    if not kept:
        return None
    labels, k, (n, pos, all_) = [labels[j] for j in kept], len(kept), counts[:, kept]
    weights = np.array([n / (2 * pos), n / (2 * (n - pos))])
    whole = pos * weights[0] + (all_ - pos) * weights[1]
    size = FIRST + 4 * STEPS

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, y in zip(b.column(0), b.column(1), strict=True):
                y = _array(y).reshape(-1, wide)[:, kept]
                x = np.zeros((size, *y.shape))
                x[Y], x[W] = np.nan_to_num(y), np.where(np.isnan(y), 0.0, np.where(y == 1, *weights)) / whole
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()]), pa.array([_bytes(x)])], names=["part", "x"])
    state = cut(cells.filter("fit AND block = -1").select("part", "y").mapInArrow(begun, "part LONG, x BINARY"))

    def vectors(state: DataFrame, i: int) -> DataFrame:
        def run(batches):
            for b in batches:
                x = [_bytes(_array(x).reshape(size, -1)[i]) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["of", "x"])
        # one copy for each block, of one number a row and label
        return _dealt(state.mapInArrow(run, "of LONG, x BINARY").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), blocks)

    entries = cells.filter("fit AND block >= 0").select("part", "block", "place", "ix", "v")

    def moments(left, right):
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("part", "block", "place", "ix", "v"), (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)})
        mean, scale = _Block(left, right, k).moments()
        return pa.table([pa.array([-1]), pa.array([left.column("block")[0].as_py()], pa.int32()), pa.array([_bytes(mean)]), pa.array([None], pa.binary()), pa.array([_bytes(scale)])], names=["part", "block", "place", "ix", "v"])
    told = cut(_dealt(entries, blocks).groupBy("block").cogroup(vectors(state, W).groupBy("block")).applyInArrow(moments, "part LONG, block INT, place BINARY, ix BINARY, v BINARY"))
    placed = _dealt(entries.unionByName(told), blocks).persist()

    def multiplied(left, right):
        if not left.num_rows:
            return pa.table({"part": pa.array([], pa.int64()), "x": pa.array([], pa.binary())})
        block = _Block(left, right, k)
        terms = block.coefficients()
        out = {p: np.tile(-(block.mean * terms).sum(axis=0), (len(x), 1)) for p, x in block.vectors.items()}
        for part, place, ix, v in block.cells:
            out[part] += _products(place, ix, v, len(out[part]), terms)
        return pa.table([pa.array(list(out), pa.int64()), pa.array([_bytes(x) for x in out.values()], pa.binary())], names=["part", "x"])

    def meet(moved: DataFrame) -> DataFrame:
        """The products of the gradient with all rows are put into the vectors."""
        def put(left, right):
            x = _array(left.column("x")[0]).reshape(size, -1, k).copy()
            x[KG] = sum((_array(r) for r in right.column("x")), np.zeros(x[KG].size)).reshape(-1, k)
            if changed:
                x[FIRST + 3] = x[KG] - x[FIRST + 3]
            basis = np.concatenate([x[FIRST + 0::4], x[FIRST + 2::4], x[G:G + 1]]), np.concatenate([x[FIRST + 1::4], x[FIRST + 3::4], x[KG:KG + 1]])
            gram = np.einsum("ank,bnk->kab", *basis)
            return pa.table([left.column("part"), pa.array([_bytes(x)]), pa.array([_bytes(gram)]), pa.array([_bytes((x[W] * (_chance(x[KA] + b) - x[Y])).sum(axis=0))])], names=["part", "x", "gram", "slope"])
        changed, b = rounds > 0, free
        products = placed.groupBy("block").cogroup(vectors(moved, G).groupBy("block")).applyInArrow(multiplied, "part LONG, x BINARY")
        return moved.groupBy("part").cogroup(products.groupBy("part")).applyInArrow(put, "part LONG, x BINARY, gram BINARY, slope BINARY")

    def line(share: np.ndarray, shift: np.ndarray, trials: np.ndarray) -> np.ndarray:
        """Loss at each trial along the direction of each label; of both labels in one pass."""
        b = free

        def run(batches):
            for batch in batches:
                for x in batch.column(0):
                    x = _array(x).reshape(size, -1, k)
                    a, ka = directed(x, share)
                    loss = [(x[W] * _loss(x[KA] + b + s * (ka + shift), x[Y])).sum(axis=0) for s in trials]
                    yield pa.RecordBatch.from_arrays([pa.array([_bytes(np.array([*loss, *[(p * q).sum(axis=0) for p, q in ((x[A], x[KA]), (x[A], ka), (a, ka))]]))])], names=["x"])
        got = sum(np.frombuffer(r.x) for r in state.select("x").mapInArrow(run, "x BINARY").collect()).reshape(-1, k)
        s = trials[:, None]
        return got[:-3] + reg / 2 * (got[-3] + 2 * s * got[-2] + s * s * got[-1])

    def directed(x: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direction of the rows' weights, and its products with all rows."""
        return tuple(np.einsum("bk,bnk->nk", share, np.concatenate([x[FIRST + i::4], x[FIRST + 2 + i::4], x[G + i:G + i + 1]])) for i in (0, 1))

    def moved(share: np.ndarray | None, step: np.ndarray) -> DataFrame:
        """The vectors after the step; the products of the new gradient are missing."""
        b = free

        def run(batches):
            for batch in batches:
                for part, x in zip(batch.column(0), batch.column(1), strict=True):
                    x = _array(x).reshape(size, -1, k).copy()
                    if share is not None:
                        a, ka = directed(x, share)
                        x[FIRST + 4:] = x[FIRST:-4].copy()
                        x[FIRST], x[FIRST + 1], x[FIRST + 3] = step * a, step * ka, x[KG]
                        x[A], x[KA] = x[A] + step * a, x[KA] + step * ka
                    g = x[W] * (_chance(x[KA] + b) - x[Y]) + reg * x[A]
                    x[FIRST + 2], x[G] = (g - x[G], g) if share is not None else (0.0, g)
                    yield pa.RecordBatch.from_arrays([pa.array([part.as_py()]), pa.array([_bytes(x)])], names=["part", "x"])
        return state.select("part", "x").mapInArrow(run, "part LONG, x BINARY")

    # the best intercepts without any term; one class alone is told with certainty
    with np.errstate(divide="ignore"):
        free = np.log(pos * weights[0]) - np.log((all_ - pos) * weights[1])
    certain = ~np.isfinite(free)
    free = np.where(certain, 0.0, free)
    rounds, still = 0, certain.copy()
    shifts = np.zeros((2 * STEPS + 1, k))
    # a table, whose size is known: the estimate of a loop of cuts is a product that doubles its digits each round
    state = written(meet(moved(None, np.zeros(k))))
    while True:
        got = state.select("gram", "slope").collect()
        gram = sum(np.frombuffer(r.gram) for r in got).reshape(k, 2 * STEPS + 1, -1)
        slope = sum(np.frombuffer(r.slope) for r in got)
        if rounds:
            shifts[STEPS] = slope - shifts[-1]
        shifts[-1] = slope
        if still.all() or rounds == most:
            break
        share = np.column_stack([_direction(gram[j], shifts[:, j], min(rounds, STEPS)) if not still[j] else np.zeros(2 * STEPS + 1) for j in range(k)])
        shift = (share * shifts).sum(axis=0)
        # nothing along the line reads a term: one pass over a grid, one around the best of it
        trials = np.concatenate([[0.0], 2.0 ** (np.arange(-8, 5) if rounds else np.arange(-48, 17))])
        value = line(share, shift, trials)
        best = value.argmin(axis=0)
        now, step = value.min(axis=0), trials[best]
        near = trials[np.maximum(best, 1)][:, None] * 2.0 ** np.linspace(-0.75, 0.75, 7)
        fine = line(share, shift, np.unique(near))
        at = fine.argmin(axis=0)
        better = fine.min(axis=0) < now
        now, step = np.where(better, fine.min(axis=0), now), np.where(better, np.unique(near)[at], step)
        loss = value[0]
        still = certain | (loss - now <= tol)
        step = np.where(still & (now >= loss), 0.0, step)
        free = free + step * shift
        shifts = np.vstack([step * shift, shifts[:STEPS - 1], np.zeros((1, k)), shifts[STEPS:-2], shifts[-1:]])
        rounds += 1
        old, state = state, written(meet(moved(share, step)))
        forget(old)
    if not still.all():
        stopped("sparse_logistic", most)
    final = state.select("part", "x")

    def coefficients(left, right):
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "terms": pa.array([], pa.binary()), "mean": pa.array([], pa.binary())})
        block = _Block(left, right, k)
        terms = block.coefficients()
        return pa.table([pa.array([left.column("block")[0].as_py()], pa.int32()), pa.array([_bytes(terms)]), pa.array([_bytes((block.mean * terms).sum(axis=0))])], names=["block", "terms", "mean"])
    terms = cut(placed.groupBy("block").cogroup(vectors(final, A).groupBy("block")).applyInArrow(coefficients, "block INT, terms BINARY, mean BINARY"))
    placed.unpersist()
    fixed = free - sum((np.frombuffer(r["mean"]) for r in terms.select("mean").collect()), np.zeros(k))

    def margins(left, right):
        known = _array(right.column("terms")[0]).reshape(-1, k) if right.num_rows else np.zeros((0, k))
        parts, out = [], []
        # a term that no fitted row has says nothing
        most = max((int(_array(ix, np.int32).max()) for ix in left.column("ix")), default=-1)
        known = np.vstack([known, np.zeros((max(0, most + 1 - len(known)), k))])
        for part, place, ix, v in zip(left.column("part").to_pylist(), left.column("place"), left.column("ix"), left.column("v"), strict=True):
            place = _array(place, np.int32)
            parts.append(part)
            out.append(_bytes(_products(place, _array(ix, np.int32), _array(v), int(place.max()) + 1, known)))
        return pa.table([pa.array(parts, pa.int64()), pa.array(out, pa.binary())], names=["of", "x"])

    kind = T.StructType([T.StructField(row_id, rows.schema[row_id].dataType), T.StructField("label", T.StringType()), T.StructField("probability", T.DoubleType())])

    def told_of(ids: pa.Scalar, z: np.ndarray) -> pa.Table:
        p = np.where(certain, (pos > 0).astype(float), _chance(z))
        ids = ids.values
        return pa.concat_tables([pa.table([ids, pa.array([c] * len(ids)), pa.array(np.ascontiguousarray(p[:, j]))], names=[row_id, "label", "probability"]) for j, c in enumerate(labels)])

    def fitted(left, right):
        return told_of(left.column("ids")[0], _array(right.column("x")[0]).reshape(size, -1, k)[KA] + free)

    def others(left, right):
        z = np.tile(fixed, (len(left.column("ids")[0].values), 1))
        for x in right.column("x"):
            x = _array(x).reshape(-1, k)
            z[:len(x)] += x
        return told_of(left.column("ids")[0], z)
    ids = cells.filter("block = -1").select("part", "ids", "fit")
    rest = _dealt(cells.filter("NOT fit AND block >= 0").select("part", "block", "place", "ix", "v"), blocks).groupBy("block").cogroup(_dealt(terms, blocks).groupBy("block")).applyInArrow(margins, "of LONG, x BINARY")
    own = ids.filter("fit").groupBy("part").cogroup(final.groupBy("part")).applyInArrow(fitted, kind)
    return own.unionByName(ids.filter("NOT fit").groupBy("part").cogroup(rest.groupBy("of")).applyInArrow(others, kind))
