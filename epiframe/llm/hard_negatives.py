"""Hard negatives by exact integer products, several candidates packed into one number.

Components of candidates, biased to be non-negative, lie side by side in fields of one wide integer, wide enough that a sum of products
cannot reach the next field.  Multiplying it by an anchor's biased component multiplies all fields at once; the sum over
components then holds the scores of all packed candidates, which are cut out and freed of the bias.  As long as two fields fit, the wide integers
are the 53 bits that a double keeps exactly, and a matrix product does multiplication and sum; beyond that Python's integers hold all candidates
of a block.  Anchors meet all rows cell by cell: rows are dealt into slices, anchors into slices, and a task has one slice of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows and anchors in a cell: as many cells as ``SPREAD`` asks for, but neither small nor more than a task should hold.
SLICE_ROWS, SLICE_ANCHORS, SPREAD = (4096, 131_072), (1024, 32_768), 64
#: Scores that a task holds at once.
SCORES = 1 << 21
_EXACT = 53
_NO = np.iinfo(np.int64).min
_ENDS = (-(1 << 63) + 1, (1 << 63) - 1)


def participants(vectors: DataFrame, vec_id: str, label: Column, embedding: str, scale: float) -> DataFrame:
    """vec_id, label, parts (floor of ``scale`` times each component, as doubles) of the rows that take part, each with a number uid."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda v: v * F.lit(float(scale))).alias("parts"))
    whole = F.forall("parts", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # rint of a value lowered to its floor: stays a double, so no component overflows
    rows = rows.filter(F.col("label").isNotNull() & F.col("parts").isNotNull() & whole)
    return cut(rows.withColumn("parts", F.transform("parts", lambda v: F.rint(v) - (F.rint(v) > v).cast("double"))).withColumn("uid", F.monotonically_increasing_id()))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Packed:
    """Candidates (rows of integers held as doubles) in fields of wide integers, ready for anchors."""

    def __init__(self, rows: np.ndarray, top: int, low: int):
        """``top`` and ``low``: largest and smallest component of any anchor to come."""
        self.rows, self.low = rows, low
        self.bias = int(rows.min(initial=0))
        reach = max(1, rows.shape[1]) * (int(rows.max(initial=0)) - self.bias) * (top - low)
        self.bits = max(1, reach.bit_length())
        self.fields = _EXACT // self.bits
        self.sums = [int(s) for s in (rows - self.bias).sum(axis=1)] if self.fields < 1 else (rows - self.bias).sum(axis=1).astype(np.int64)
        if self.fields:
            n, d = rows.shape
            size = -(-n // self.fields)
            self.words = np.zeros((size, d))
            for f in range(self.fields):
                part = rows[f * size:(f + 1) * size]
                self.words[:len(part)] += (part - self.bias) * 2.0 ** (self.bits * f)
            self.size = size
        else:
            self.bytes = -(-self.bits // 8)
            self.wide = [int.from_bytes(b"".join((int(v) - self.bias).to_bytes(self.bytes, "little") for v in column), "little") for column in rows.T]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of anchors (rows) with all candidates, as 64-bit integers; beyond those, their ends."""
        n, d = self.rows.shape
        if self.fields:
            raised = anchors - self.low
            product = (raised @ self.words.T).astype(np.int64)
            mask = (1 << self.bits) - 1
            parts = [(product >> (self.bits * f)) & mask for f in range(self.fields)]
            out = np.concatenate(parts, axis=1)[:, :n]
            own = raised.sum(axis=1).astype(np.int64)
            out += (self.bias * own + d * self.bias * self.low)[:, None]
            out += (self.low * self.sums)[None, :]
            return out
        out = np.empty((len(anchors), n), np.int64)
        for i, anchor in enumerate(anchors):
            raised = [int(v) - self.low for v in anchor]
            total = sum(w * v for w, v in zip(self.wide, raised, strict=True))
            body = total.to_bytes(self.bytes * n + 1, "little")
            add = self.bias * sum(raised) + d * self.bias * self.low
            for j in range(n):
                score = int.from_bytes(body[j * self.bytes:(j + 1) * self.bytes], "little") + add + self.low * self.sums[j]
                out[i, j] = min(max(score, _ENDS[0]), _ENDS[1])
        return out


def _best(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``count`` highest of each row, of equal ones the first; overwrites ``scores``, _NO marks what is out."""
    rows, columns, values = [], [], []
    line = np.arange(len(scores))
    for _ in range(min(count, scores.shape[1])):
        at = scores.argmax(axis=1)
        value = scores[line, at]
        real = value != _NO
        if not real.any():
            break
        rows.append(line[real])
        columns.append(at[real])
        values.append(value[real])
        scores[line, at] = _NO
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, columns, values))


class _Cell:
    """One slice of anchors and one of rows, rows by rising vec_id (null last) and uid."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        self.anchors = anchors
        self.rows = rows.take(pc.sort_indices(rows, sort_keys=[("vec_id", "ascending"), ("uid", "ascending")], null_placement="at_end"))
        self.a, self.c = _matrix(anchors.column("parts")), _matrix(self.rows.column("parts"))
        width = max(self.a.shape[1], self.c.shape[1])
        self.a, self.c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (self.a, self.c))
        self.low, self.top = int(self.a.min(initial=0)), int(self.a.max(initial=0))
        self.a_label, self.c_label = (t.column("label").to_numpy() for t in (anchors, self.rows))
        self.a_uid, self.c_uid = (t.column("uid").to_numpy() for t in (anchors, self.rows))

    def blocks(self, index: np.ndarray, width: int):
        step = max(1, SCORES // max(1, width))
        return (index[i:i + step] for i in range(0, len(index), step))

    def pick(self, columns: np.ndarray) -> list:
        return [self.rows.column("vec_id").combine_chunks().take(pa.array(columns)), pa.array(self.c_uid[columns])]


def _nearest(count: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = [[], [], []]
        cell = None
        if anchors.num_rows and rows.num_rows:
            cell = _Cell(anchors, rows)
            for label in np.unique(cell.a_label):
                mine, theirs = np.flatnonzero(cell.a_label == label), np.flatnonzero(cell.c_label == label)
                if not len(theirs):
                    continue
                packed = Packed(cell.c[theirs], cell.top, cell.low)
                for block in cell.blocks(mine, len(theirs)):
                    scores = packed.scores(cell.a[block])
                    scores[cell.a_uid[block][:, None] == cell.c_uid[theirs][None, :]] = _NO
                    i, j, value = _best(scores, count)
                    for part, x in zip(found, (block[i], theirs[j], value), strict=True):
                        part.append(x)
        i, j, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        ids = cell.pick(j) if cell else [pa.array([], pa.int64())] * 2
        return pa.table([pa.array(cell.a_uid[i] if cell else i, pa.int64()), *ids, pa.array(value, pa.int64())], names=["anchor", "vec_id", "uid", "score"])
    return run


def _within(count: int, least: int, most: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        cell = None
        if anchors.num_rows and rows.num_rows:
            cell = _Cell(anchors, rows)
            packed = Packed(cell.c, cell.top, cell.low)
            told = [[p["score"] for p in x] for x in anchors.column("positives").to_pylist()]
            size = max(len(x) for x in told)
            # bounds of the negatives' scores, in whole numbers
            low = np.array([[-((-least * s) // 100) for s in x] + [_ENDS[1]] * (size - len(x)) for x in told], np.int64).reshape(len(told), size)
            high = np.array([[(most * s) // 100 for s in x] + [_NO + 1] * (size - len(x)) for x in told], np.int64).reshape(len(told), size)
            for block in cell.blocks(np.arange(len(told)), len(cell.c)):
                scores = packed.scores(cell.a[block])
                scores[cell.a_label[block][:, None] == cell.c_label[None, :]] = _NO
                for k in range(size):
                    inside = np.where((scores >= low[block, k][:, None]) & (scores <= high[block, k][:, None]), scores, _NO)
                    i, j, value = _best(inside, count)
                    for part, x in zip(found, (block[i], j, value, np.full(len(i), k)), strict=True):
                        part.append(x)
        i, j, value, k = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        ids = cell.pick(j) if cell else [pa.array([], pa.int64())] * 2
        return pa.table([pa.array(cell.a_uid[i] if cell else i, pa.int64()), *ids, pa.array(value, pa.int64()), pa.array(k, pa.int32())], names=["anchor", "vec_id", "uid", "score", "place"])
    return run


def _slices(n: int, limits: tuple[int, int], spread: int) -> int:
    return max(1, -(-n // min(max(n // spread, limits[0]), limits[1])))


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", label: str | Column = "label", embedding: str = "embedding", every: int = 50, scale: float = 256.0, positives: int = 5, negatives: int = 3,
                   least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by ``every``) and each of its
    best ``positives`` other rows of the same label, the best ``negatives`` rows of another label whose score lies within ``least`` to ``most`` percent of the positive's.

    Scores are inner products of floor(scale * component), exact; higher ones come first, ties by smaller vec_id (null last).  Rows with a null
    label, a null vector or a component that is null or not finite (also after scaling) take no part; null vec_ids are no anchors; a shorter vector counts as
    ending in zeros; scores beyond 64 bits stay at their ends.  Repeated rows are rows of their own (a copy of the anchor can be its
    positive), an empty table gives an empty result, other columns are not looked at.
    """
    name = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = participants(vectors, vec_id, name, embedding, scale)
    anchor_rows = rows.filter(F.col("vec_id") % every == 0)
    n, m = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    across, down = _slices(n, SLICE_ROWS, SPREAD), _slices(m, SLICE_ANCHORS, 8)

    def dealt(df: DataFrame, own: str, other: str, own_slices: int, other_slices: int) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(other_slices - 1)))
        return df.withColumn(own, F.pmod(F.xxhash64("uid"), F.lit(own_slices)).cast("int")).withColumn(other, copies)

    def met(anchors: DataFrame, run, schema: str) -> DataFrame:
        left = dealt(anchors, "down", "across", down, across).groupBy("down", "across")
        right = dealt(rows, "across", "down", across, down).groupBy("down", "across")
        return left.cogroup(right).applyInArrow(run, schema)

    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("uid")]
    near = met(anchor_rows, _nearest(positives), "anchor long, vec_id long, uid long, score long")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).filter(F.col("place") <= positives)
    # the bounded list of an anchor's positives, in order
    held = cut(near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives")))
    asked = cut(anchor_rows.join(held, F.col("uid") == F.col("anchor")).drop("anchor"))
    far = met(asked, _within(negatives, least, most), "anchor long, vec_id long, uid long, score long, place int")
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).filter(F.col("rank") <= negatives)
    told = asked.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("place", "positive"))
    return far.join(told, ["anchor", "place"]).select("anchor_id", F.col("positive.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                                                      F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
