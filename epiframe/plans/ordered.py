"""Ordered computation inside a key without putting the whole key into one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one
task, which fails when one key holds a third of the table.  The two plans here
cut the order axis into slices, so a task sees one (key, slice):

* ``scan`` computes unbounded running values.  Each slice is scanned locally; the
  slice totals (one row per key and slice) are scanned once more and joined back.
* ``halo`` serves frames of bounded reach.  Rows near a slice border are copied
  into the neighbouring slice, so a frame never has to leave its slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import written
from .spread import spread

SLICE = "_slice"
DAY = 86_400.0


def axis(df: DataFrame, order: str) -> Column:
    """The order column as a double: seconds for times, days for dates, itself for numbers."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(order).cast("timestamp").cast("double")
    if isinstance(kind, T.DateType):
        return F.datediff(F.col(order), F.lit("1970-01-01").cast("date")).cast("double")
    return F.col(order).cast("double")


def ticks(df: DataFrame, order: str) -> Column:
    """The order column as a BIGINT of micro-units, for exact RANGE frames."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(order))
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.round(axis(df, order) * 1e6).cast("bigint")


def add_slices(df: DataFrame, order: str, width: float | None = None, n: int | None = None) -> DataFrame:
    """Add the slice number of every row.

    With ``width`` (axis units) the slice is ``floor(t / width)`` and nothing is
    read.  Without it the borders are approximate quantiles of the order column,
    so slices hold about equal row counts; this reads that one column.
    """
    t = axis(df, order)
    if width is not None:
        return df.withColumn(SLICE, F.floor(t / F.lit(float(width))).cast("bigint"))
    spark = df.sparkSession
    n = n or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = [1 << i for i in range((n - 1).bit_length() - 1, -1, -1)] or [1]
    # one sketch of the column, a scalar subquery of the same plan: nothing runs before the action, and equal subqueries run once
    borders = df.select(F.percentile_approx(t, [i / n for i in range(1, n)], 20 * n)).scalar()
    # a missing border compares as NULL, so the search stays left of it; so does a NULL order value, in the first slice
    place = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: at + F.when(F.get(F.col("_borders"), at + s - 1) <= F.col("_axis"), s).otherwise(0))
    return df.withColumn("_borders", borders).withColumn("_axis", t).withColumn(SLICE, place.cast("bigint")).drop("_borders", "_axis")


def scan(df: DataFrame, key: Sequence[str], order: str, running: Mapping[str, tuple], width: float | None = None,
         tie: Sequence[str] = (), keep_slice: bool = False) -> DataFrame:
    """Add running values per ``key`` along ``order`` (then ``tie``, which must make the order total).

    ``running`` maps an output name to ``(kind, column)``.  Kinds, all over the rows
    of the key: ``sum``, ``count`` (non-NULL), ``max``, ``min``, ``last`` (non-NULL) up to
    and including the row; ``prev_sum``, ``prev_count``, ``prev_max``, ``prev_min``,
    ``prev_last`` strictly before it; ``next`` (non-NULL) from the row on, ``after_next``
    strictly after it; ``lag`` and ``lead`` the neighbouring row's value; ``row_number``.
    """
    key = list(key)
    d = df if SLICE in df.columns else add_slices(df, order, width)
    values = {out: (F.lit(1) if col is None else (F.col(col) if isinstance(col, str) else col))
              for out, (_, col) in running.items()}
    d = d.select("*", *[v.alias(f"_v_{out}") for out, v in values.items()])
    place = [F.col(order), *[F.col(c) for c in tie]]
    at = F.struct(*place)
    local = Window.partitionBy(*key, SLICE).orderBy(*place)
    here = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    onward = local.rowsBetween(0, Window.unboundedFollowing)
    later = local.rowsBetween(1, Window.unboundedFollowing)
    over = Window.partitionBy(*key).orderBy(SLICE) if key else Window.orderBy(SLICE)
    slices_before = over.rowsBetween(Window.unboundedPreceding, -1)
    slices_after = over.rowsBetween(1, Window.unboundedFollowing)

    plain = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    totals, carries, locals_, finals = [], [], [], {}
    for out, (kind, _) in running.items():
        v, t, c, l = F.col(f"_v_{out}"), f"_t_{out}", f"_c_{out}", f"_l_{out}"
        base = kind.removeprefix("prev_")
        frame = before if kind.startswith("prev_") else here
        if base in plain:
            fn = plain[base]
            totals.append(fn(v).alias(t))
            fold = F.sum if base == "count" else fn
            carries.append(fold(t).over(slices_before).alias(c))
            locals_.append(fn(v).over(frame).alias(l))
            if base in ("sum", "count"):
                both = F.coalesce(F.col(l), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))
                finals[out] = F.when(F.col(l).isNotNull() | F.col(c).isNotNull(), both)
                if base == "count":
                    finals[out] = both
            else:
                pick = F.greatest if base == "max" else F.least
                finals[out] = pick(F.col(l), F.col(c))
        elif kind == "row_number":
            totals.append(F.count(F.lit(1)).alias(t))
            carries.append(F.sum(t).over(slices_before).alias(c))
            locals_.append(F.row_number().over(local).alias(l))
            finals[out] = F.col(l) + F.coalesce(F.col(c), F.lit(0))
        elif base == "last":
            boxed = F.when(v.isNotNull(), F.struct(v.alias("v")))
            totals.append(F.max_by(boxed, F.when(v.isNotNull(), at)).alias(t))
            carries.append(F.last(t, ignorenulls=True).over(slices_before).alias(c))
            locals_.append(F.last(boxed, ignorenulls=True).over(frame).alias(l))
            finals[out] = F.coalesce(F.col(l), F.col(c))["v"]
        elif kind in ("next", "after_next"):
            boxed = F.when(v.isNotNull(), F.struct(v.alias("v")))
            totals.append(F.min_by(boxed, F.when(v.isNotNull(), at)).alias(t))
            carries.append(F.first(t, ignorenulls=True).over(slices_after).alias(c))
            locals_.append(F.first(boxed, ignorenulls=True).over(onward if kind == "next" else later).alias(l))
            finals[out] = F.coalesce(F.col(l), F.col(c))["v"]
        elif kind in ("lag", "lead"):
            boxed = F.struct(v.alias("v"))
            edge, shift = (F.max_by, F.lag) if kind == "lag" else (F.min_by, F.lead)
            totals.append(edge(boxed, at).alias(t))
            carries.append(shift(t).over(over).alias(c))
            locals_.append(shift(boxed).over(local).alias(l))
            finals[out] = F.coalesce(F.col(l), F.col(c))["v"]
        else:
            raise ValueError(f"unknown running kind {kind!r}")

    group = [*key, SLICE]
    carry = d.groupBy(*group).agg(*totals).select(*[F.col(g).alias(f"_k_{g}") for g in group], *carries)
    joined = d.select("*", *locals_).join(
        carry, [F.col(g).eqNullSafe(F.col(f"_k_{g}")) for g in group], "left")
    keep = [c for c in df.columns if c != SLICE or keep_slice] + ([SLICE] if keep_slice and SLICE not in df.columns else [])
    return joined.select(*[F.col(c) for c in keep if c not in finals], *[e.alias(o) for o, e in finals.items()])


def halo(df: DataFrame, at: Column, back: float, ahead: float, width: float) -> DataFrame:
    """Copy rows into every slice whose frames may reach them; ``_own`` marks the home slice.

    ``at`` is numeric; a frame of row x spans ``[x - back, x + ahead]``.  Window on
    (key, ``_slice``) with a RANGE frame, then keep ``_own`` rows.
    """
    width = float(max(width, back + ahead, 1e-9))
    first = F.floor((at - F.lit(float(ahead))) / width)
    last = F.floor((at + F.lit(float(back))) / width)
    return (df.withColumn("_home", F.floor(at / width))
            .withColumn(SLICE, F.explode(F.sequence(first, last)))
            .withColumn("_own", F.col("_home") == F.col(SLICE)).drop("_home"))


def near(df: DataFrame, key: Sequence[str], order: str, back: float, ahead: float, width: float,
         cols: Mapping[str, Column], include_edges: tuple = (True, True)) -> DataFrame:
    """Add aggregates over the rows of the key within ``[t - back, t + ahead]`` (axis units).

    ``cols`` maps an output name to an aggregate Column.  ``include_edges`` opens the
    respective end; times are compared as whole micro-units.
    """
    lo = -int(round(back * 1e6)) + (0 if include_edges[0] else 1)
    hi = int(round(ahead * 1e6)) - (0 if include_edges[1] else 1)
    d = df.withColumn("_tick", ticks(df, order))
    d = halo(d, F.col("_tick"), max(-lo, 0), max(hi, 0), width * 1e6)
    w = Window.partitionBy(*key, SLICE).orderBy("_tick").rangeBetween(lo, hi)
    d = d.select("*", *[agg.over(w).alias(out) for out, agg in cols.items()])
    return d.filter("_own").drop("_own", "_tick", SLICE)


def value_ranks(df: DataFrame, by: Sequence[str], value: str, width: float | None = None) -> DataFrame:
    """One row per (by, value): ``n`` tied rows, ``below`` rows under it and the average ``rank``.

    Ties are pre-aggregated first, so even a value held by most rows costs one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    out = scan(counts, by, value, {"below": ("prev_sum", "n")}, width)
    out = out.withColumn("below", F.coalesce("below", F.lit(0)))
    return out.withColumn("rank", F.col("below") + (F.col("n") + 1) / 2.0)


def range_pairs(left: DataFrame, right: DataFrame, key: Sequence[str], lo: str, hi: str, rt: str,
                width: float, how: str = "inner") -> DataFrame:
    """Join left rows to right rows of the key with ``lo <= rt <= hi`` through time slices.

    ``lo``/``hi`` are left columns, ``rt`` a right column; all three share one axis.
    Each left row is copied to the slices its range covers, so the equi key is
    (key, slice) and a hot key is spread over the slices.
    """
    left_cols = left.columns
    l = left.withColumn("_lo", axis(left, lo)).withColumn("_hi", axis(left, hi))
    l = l.withColumn(SLICE, F.explode_outer(F.when(F.col("_lo") <= F.col("_hi"), F.sequence(
        F.floor(F.col("_lo") / width).cast("bigint"), F.floor(F.col("_hi") / width).cast("bigint")))))
    r = right.withColumn("_rt", axis(right, rt))
    r = r.withColumn("_rs", F.floor(F.col("_rt") / width).cast("bigint"))
    for k in key:
        r = r.withColumnRenamed(k, f"_rk_{k}")
    cond = (F.col(SLICE) == F.col("_rs")) & F.col("_rt").between(F.col("_lo"), F.col("_hi"))
    for k in key:
        cond = cond & (F.col(k) == F.col(f"_rk_{k}"))
    keep = [c for c in right.columns if c not in key]
    return l.join(r, cond, how).select(*left_cols, *keep)


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], width: float | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group without gathering a group's values.

    Values are counted first, ranked through sliced scans, and each quantile picks its two
    neighbouring order statistics.
    """
    ranks = value_ranks(df, by, value, width)
    total = ranks.groupBy(*by).agg(F.sum("n").alias("_n"))
    d = ranks.join(total, list(by)) if by else ranks.join(F.broadcast(total))
    picks, outs = [], []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        for side, spot in (("lo", F.floor(at + 1e-9)), ("hi", F.ceil(at - 1e-9))):
            hit = (F.col("below") <= spot) & (spot < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        place = (F.col("_n") - 1) * F.lit(float(p))
        outs.append((lo + (hi - lo) * (place - F.floor(place + 1e-9))).alias(name))
    return d.groupBy(*by).agg(F.max("_n").alias("_n"), *picks).select(*by, *outs)


def dense_rank(df: DataFrame, by: Sequence[str], x: str, out: str, width: float | None = None) -> DataFrame:
    """One row per distinct (by, x) with its position from 0."""
    d = df.select(*by, x).distinct()
    return scan(d, by, x, {out: ("row_number", None)}, width).withColumn(out, F.col(out) - 1)


def ordered_pairs(df: DataFrame, by: Sequence[str], x: str, y: str, first: Column, second: Column) -> DataFrame:
    """Count row pairs with x_i < x_j by how y_i compares with y_j, without forming pairs.

    Row i weighs ``first``, row j ``second``.  Gives per group ``below`` (y_i < y_j), ``equal``
    and ``total``.  Two different x ranks first differ in exactly one bit, so every pair is
    counted at one bit level: rows are grouped by their higher bits, and along y a running
    sum of the rows with a 0 in that bit meets the rows with a 1.  Rows times log(n).
    """
    by = list(by)
    cells = df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), first.cast("double").alias("_f"), second.cast("double").alias("_s"))
    cells = cells.dropna(subset=["_x", "_y"]).groupBy(*by, "_x", "_y").agg(F.sum("_f").alias("_f"), F.sum("_s").alias("_s"))
    cells = written(cells)         # ranks, levels and sums all read them: the input is read once
    n = cells.count()
    xs = spread(add_slices(cells.select(*by, "_x"), "_x"), *by, SLICE, rows=n).distinct()
    ranks = scan(xs, by, "_x", {"_rank": ("row_number", None)}).withColumn("_rank", F.col("_rank") - 1)
    bits = ranks.select(F.length(F.bin(F.coalesce(F.max("_rank"), F.lit(0)))).alias("_bits")).scalar()
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in by] + [F.col("_x") == F.col("_bx")]
    d = add_slices(cells, "_y").join(ranks.select(*[F.col(k).alias(f"_b_{k}") for k in by], F.col("_x").alias("_bx"), "_rank"), on)
    d = d.withColumn("_bits", bits).select(*by, "_y", "_f", "_s", "_rank", SLICE, F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)).alias("_level"))
    one = F.expr("(shiftright(_rank, _level) & 1) = 1")
    keys = [*by, "_level", "_head"]
    # dealt out once by what sums, running sums and slice totals all ask for, into as many parts as there are rows for: a row for each cell and level
    d = spread(d.withColumn("_head", F.expr("shiftright(_rank, _level + 1)")), *keys, SLICE, rows=n * max(n.bit_length(), 1))
    g = d.groupBy(*keys, SLICE, "_y").agg(
        F.sum(F.when(~one, F.col("_f")).otherwise(0.0)).alias("_n0"), F.sum(F.when(one, F.col("_s")).otherwise(0.0)).alias("_n1"))
    run = scan(g, keys, "_y", {"_prev": ("prev_sum", "_n0")})
    low = run.groupBy(*by).agg(F.sum(F.col("_n1") * F.coalesce("_prev", F.lit(0.0))).alias("below"), F.sum(F.col("_n1") * F.col("_n0")).alias("equal"))
    whole = g.groupBy(*keys).agg(F.sum("_n0").alias("_a"), F.sum("_n1").alias("_b")).groupBy(*by).agg(F.sum(F.col("_a") * F.col("_b")).alias("total"))
    return low.join(whole, by) if by else low.join(F.broadcast(whole))
