"""Grids, fills, runs, sessions, alarms and clocks over event tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from ..plans.ordered import SLICE, axis, halo, near, range_pairs, scan, ticks


def step_of(ts: Column, origin: Column, seconds: float) -> Column:
    """Whole steps of ``seconds`` since ``origin``."""
    return F.floor((ts.cast("timestamp").cast("double") - origin.cast("timestamp").cast("double")) / seconds).cast("bigint")


def skeleton(keys: DataFrame, key: Sequence[str], step: str, first, last) -> DataFrame:
    """Every step from ``first`` to ``last`` (columns or literals) for every key row."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return keys.select(*key, F.explode(F.sequence(lit(first).cast("bigint"), lit(last).cast("bigint"))).alias(step))


def to_grid(long: DataFrame, keys: DataFrame, key: Sequence[str], t: str, n: int, kinds: Mapping[str, str],
            size: float = 1.0, step: str = "step", end: str | None = None) -> DataFrame:
    """Long events to the complete (key, step) grid, one column per variable.

    ``kinds`` maps a variable to ``numeric`` (last value in the bin, plus a
    ``<variable>__n`` count), ``event`` (sum) or ``interval`` (maximum over every bin
    from floor(t) to ceil(end), an open end lasting one bin; 0 where none).
    """
    var, val = F.col("variable"), F.col("value")
    spans = [v for v, k in kinds.items() if k == "interval"]
    first = F.floor(F.col(t) / size).cast("bigint")
    points = (long.filter(~var.isin(spans)) if spans else long)
    points = points.withColumn(step, first).filter((F.col(t) >= 0) & (F.col(t) < n * size))
    if spans:
        stop = F.coalesce(F.col(end), F.col(t) + size) / size
        lo, hi = F.greatest(first, F.lit(0)), F.least(F.ceil(stop).cast("bigint"), F.lit(n)) - 1
        bins = F.when(lo <= hi, F.sequence(lo, hi))
        points = points.unionByName(long.filter(var.isin(spans)).withColumn(step, F.explode(bins)))
    aggs = []
    for v, kind in kinds.items():
        mine = F.when(var == v, val)
        if kind == "numeric":
            aggs += [F.max_by(mine, F.when(mine.isNotNull(), F.struct(F.col(t), val))).alias(v), F.count(mine).alias(f"{v}__n")]
        else:
            aggs.append((F.sum if kind == "event" else F.max)(mine).alias(v))
    wide = points.groupBy(*key, step).agg(*aggs)
    grid = skeleton(keys.select(*key).distinct(), key, step, 0, n - 1).join(wide, [*key, step], "left")
    zeros = [v for v in spans] + [f"{v}__n" for v, k in kinds.items() if k == "numeric"]
    return grid.fillna(0, subset=zeros)


def calendar_counts(df: DataFrame, key: Sequence[str], date: str, unit: str = "month", end=None,
                    flag: Column | None = None) -> DataFrame:
    """Counts per calendar ``unit`` and key from the key's first event to the table's last, zeros filled."""
    period = F.trunc(F.to_date(date), unit) if unit in ("month", "quarter", "year", "week") else F.to_date(date)
    aggs = [F.count(F.lit(1)).alias("n_all")]
    if flag is not None:
        aggs.append(F.sum(F.when(flag, 1).otherwise(0)).alias("n_flagged"))
    counts = df.filter(F.col(date).isNotNull()).groupBy(*key, period.alias("period")).agg(*aggs)
    last = F.lit(end).cast("date") if end is not None else None
    spans = counts.groupBy(*key).agg(F.min("period").alias("_first"))
    if last is None:
        spans = spans.join(F.broadcast(counts.agg(F.max("period").alias("_last"))))
    else:
        spans = spans.withColumn("_last", F.trunc(last, unit))
    stride = {"month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year",
              "week": "interval 7 days", "day": "interval 1 day"}[unit]
    frame = spans.select(*key, F.explode(F.sequence("_first", "_last", F.expr(stride))).alias("period"))
    return frame.join(counts, [*key, "period"], "left").fillna(0, subset=["n_all"] + (["n_flagged"] if flag is not None else []))


def months_since(date: Column, launch: Column) -> Column:
    """Calendar months from ``launch`` to ``date``."""
    return (F.year(date) * 12 + F.month(date)) - (F.year(launch) * 12 + F.month(launch))


def ffill_limit(grid: DataFrame, key: Sequence[str], step: str, cols: Sequence[str], limit: int, block: int = 4096) -> DataFrame:
    """Carry the last value forward over at most ``limit`` rows of a complete grid."""
    filled = {f"_f_{c}": F.last(c, ignorenulls=True) for c in cols}
    d = near(grid, key, step, limit, 0, block, filled)
    return d.select(*[F.col(f"_f_{c}").alias(c) if c in cols else F.col(c) for c in grid.columns])


def resample_interp(df: DataFrame, key: Sequence[str], ts: str, value: str, seconds: float, limit: int = 6,
                    sums: Sequence[str] = (), carry: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """Regular grid per key from its first to its last bin: mean value, linear filling of the first ``limit``
    missing bins of a gap, an ``imputed`` flag; ``sums`` are added up per bin, ``carry`` columns are carried forward."""
    b = F.floor(axis(df, ts) / seconds).cast("bigint")
    binned = df.groupBy(*key, b.alias("bin")).agg(
        F.avg(value).alias("_v"), *[F.sum(c).alias(c) for c in sums], *[F.max_by(c, ts).alias(c) for c in carry])
    spans = binned.groupBy(*key).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    grid = skeleton(spans, key, "bin", F.col("_a"), F.col("_b")).join(binned, [*key, "bin"], "left")
    spot = F.when(F.col("_v").isNotNull(), F.struct(F.col("bin").alias("b"), F.col("_v").alias("v")))
    grid = scan(grid, key, "bin", {"_p": ("last", spot), "_n": ("next", spot), **{f"_c_{c}": ("last", c) for c in carry}}, width)
    since = F.col("bin") - F.col("_p.b")
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * since / (F.col("_n.b") - F.col("_p.b"))
    out = F.coalesce(F.col("_v"), F.when(since <= limit, F.coalesce(line, F.col("_p.v"))))
    return grid.select(*key, "bin", out.alias(value), F.col("_v").isNull().alias("imputed"),
                       *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums], *[F.col(f"_c_{c}").alias(c) for c in carry])


def expand_intervals(df: DataFrame, start: str, end: str, unit: float = 1.0, out: str = "bin") -> DataFrame:
    """One row per bin of ``unit`` from floor(start) up to ceil(end); an open end lasts one bin."""
    lo = F.floor(F.col(start) / unit).cast("bigint")
    hi = F.ceil(F.coalesce(F.col(end) / unit, F.col(start) / unit + 1)).cast("bigint") - 1
    return df.withColumn(out, F.explode(F.when(lo <= hi, F.sequence(lo, hi))))


def trailing_features(grid: DataFrame, key: Sequence[str], step: str, cols: Sequence[str], k: int,
                      strict: bool = False, block: int = 4096) -> DataFrame:
    """last/min/max/mean/sum/count and missing share of the trailing ``k`` grid rows, the current one included unless ``strict``."""
    back, ahead = (k, -1) if strict else (k - 1, 0)
    aggs = {}
    for c in cols:
        aggs |= {f"{c}__last": F.last(c, ignorenulls=True), f"{c}__min": F.min(c), f"{c}__max": F.max(c),
                 f"{c}__mean": F.avg(c), f"{c}__sum": F.sum(c), f"{c}__count": F.count(c)}
    aggs["_rows"] = F.count(F.lit(1))
    d = near(grid, key, step, back, ahead, block, aggs)
    for c in cols:
        d = d.withColumn(f"{c}__missing", F.when(F.col("_rows") > 0, 1 - F.col(f"{c}__count") / F.col("_rows")))
    return d.drop("_rows")


def window_features(grid: DataFrame, key: Sequence[str], step: str, cols: Sequence[str], start: int, end: int) -> DataFrame:
    """One row per key over steps [start, end): mean, min, max, last, count and missing share of each column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
                 F.max_by(c, F.when(F.col(c).isNotNull(), F.col(step))).alias(f"{c}__last"),
                 F.count(c).alias(f"{c}__count"), (1 - F.count(c) / F.count(F.lit(1))).alias(f"{c}__missing")]
    return grid.filter(F.col(step).between(start, end - 1)).groupBy(*key).agg(*aggs)


def supervised_windows(grid: DataFrame, key: Sequence[str], step: str, value: str, imputed: str, history: int,
                       horizon: int, max_imputed: float = 0.5, block: int = 4096) -> DataFrame:
    """Row t: the ``history`` values before it and the target ``horizon`` steps on.

    Rows with a NULL in the history or target, an incomplete history, or more than
    ``max_imputed`` of it imputed are left out; ``valid`` says the target was measured.
    """
    from pyspark.sql import Window
    d = grid.withColumn("_tick", ticks(grid, step))
    d = halo(d, F.col("_tick"), history * 1e6, horizon * 1e6, block * 1e6)
    w = Window.partitionBy(*key, SLICE).orderBy("_tick")
    past = w.rangeBetween(-history * 1_000_000, -1_000_000)
    then = w.rangeBetween(horizon * 1_000_000, horizon * 1_000_000)
    d = d.select(*key, step, "_own", F.collect_list(value).over(past).alias("history"),
                 F.avg(F.col(imputed).cast("double")).over(past).alias("_share"),
                 F.first(value).over(then).alias("target"), F.first(imputed).over(then).alias("_ti"))
    d = d.filter(F.col("_own") & (F.size("history") == history) & F.col("target").isNotNull() & (F.col("_share") <= max_imputed))
    return d.select(*key, step, "history", "target", (~F.col("_ti")).alias("valid"))


def decay_accumulate(grid: DataFrame, key: Sequence[str], step: str, x: str, tau: float, out: str = "level") -> DataFrame:
    """a_t = a_{t-1} * exp(-1/tau) + x_t over a complete grid (``tau`` in steps).

    Terms older than 40 tau are below double precision, so each slice of that length
    only needs the slice before it.
    """
    from pyspark.sql import Window
    reach = math.ceil(40 * tau)
    d = halo(grid, F.col(step), reach, 0, reach)
    rel = (F.col(step) - (F.col(SLICE) - 1) * F.lit(float(reach))) / tau
    w = Window.partitionBy(*key, SLICE).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    level = F.sum(F.coalesce(F.col(x), F.lit(0.0)) * F.exp(rel)).over(w) * F.exp(-rel)
    return d.withColumn(out, level).filter("_own").drop("_own", SLICE)


def sessionize(df: DataFrame, key: Sequence[str], start: str, end: str, gap: float, width: float | None = None,
               tie: Sequence[str] = ()) -> DataFrame:
    """Number sessions per key: a new one starts when ``start`` is more than ``gap`` after every earlier end.

    Adds ``session``, ``session_start`` and the offsets ``start_h``/``end_h`` (axis units).
    """
    d = df.withColumn("_s", axis(df, start)).withColumn("_e", axis(df, end))
    d = scan(d, key, "_s", {"_pe": ("prev_max", "_e")}, width, tie)
    new = F.col("_pe").isNull() | (F.col("_s") - F.col("_pe") > gap)
    d = scan(d, key, "_s", {"session": ("sum", new.cast("bigint")),
                            "_first": ("last", F.when(new, F.struct(F.col(start).alias("at"), F.col("_s").alias("x"))))}, width, tie)
    return d.select(*df.columns, "session", F.col("_first.at").alias("session_start"),
                    (F.col("_s") - F.col("_first.x")).alias("start_off"), (F.col("_e") - F.col("_first.x")).alias("end_off"))


def islands(df: DataFrame, key: Sequence[str], order: str, cond: Column, min_len: int = 1, max_len: int | None = None,
            width: float | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of rows where ``cond`` holds: first and last order value and length."""
    d = df.withColumn("_on", F.coalesce(cond, F.lit(False)))
    d = scan(d, key, order, {"_off": ("sum", (~F.col("_on")).cast("bigint"))}, width, tie)
    runs = d.filter("_on").groupBy(*key, "_off").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"),
                                                   F.count(F.lit(1)).alias("length"))
    keep = F.col("length") >= min_len
    if max_len is not None:
        keep = keep & (F.col("length") <= max_len)
    return runs.filter(keep).drop("_off")


def merge_events(df: DataFrame, key: Sequence[str], start: str, end: str, gap: float = 0.0, width: float | None = None) -> DataFrame:
    """Merge events that overlap or are less than ``gap`` apart; events without length are dropped."""
    d = df.select(*key, start, end).withColumn("_s", axis(df, start)).withColumn("_e", axis(df, end))
    d = d.filter(F.col("_e") > F.col("_s")).groupBy(*key, start, "_s").agg(F.max(end).alias(end), F.max("_e").alias("_e"))
    d = scan(d, key, "_s", {"_pe": ("prev_max", "_e")}, width)
    new = F.col("_pe").isNull() | (F.col("_s") - F.col("_pe") >= gap)
    d = scan(d, key, "_s", {"_run": ("sum", new.cast("bigint"))}, width)
    return d.groupBy(*key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def split_events(df: DataFrame, start: str, end: str, max_len: float) -> DataFrame:
    """Cut events longer than ``max_len`` (numeric axis) into consecutive pieces."""
    n = F.greatest(F.ceil((F.col(end) - F.col(start)) / max_len), F.lit(1))
    d = df.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)))
    piece = F.col(start) + F.col("_i") * max_len
    return d.withColumn("_p", piece).withColumn(end, F.least(F.col("_p") + max_len, F.col(end))).withColumn(start, F.col("_p")).drop("_p", "_i")


def probability_events(df: DataFrame, key: Sequence[str], step: str, prob: str, step_s: float, window_s: float,
                       threshold: float = 0.5, min_duration: float = 5.0, merge_gap: float = 10.0) -> DataFrame:
    """Thresholded window probabilities to events in seconds, merged and with short ones removed."""
    runs = islands(df, key, step, F.col(prob) >= threshold)
    ev = runs.select(*key, (F.col("run_start") * step_s).alias("start"), (F.col("run_end") * step_s + window_s).alias("end"))
    return merge_events(ev, key, "start", "end", merge_gap).filter(F.col("end") - F.col("start") >= min_duration)


def stream_audit(df: DataFrame, key: Sequence[str], ts: str, value: str, rate_limit: float, tie: Sequence[str] = (),
                 flat_tol: float = 0.5, width: float | None = None) -> DataFrame:
    """Per key: steps whose change per time unit exceeds ``rate_limit``, repeated times, missing share, longest flat run."""
    d = scan(df, key, ts, {"_pv": ("lag", value), "_pt": ("lag", ts)}, width, tie)
    dt = axis(d, ts) - axis(d, "_pt")
    d = d.withColumn("_rate", F.when(dt > 0, F.abs(F.col(value) - F.col("_pv")) / dt))
    d = d.withColumn("_dup", (dt == 0).cast("int")).withColumn("_flat", F.abs(F.col(value) - F.col("_pv")) < flat_tol)
    base = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_rate") > rate_limit, 1).otherwise(0)).alias("n_jumps"),
        F.sum(F.coalesce("_dup", F.lit(0))).alias("n_duplicate_times"),
        F.avg(F.col(value).isNull().cast("double")).alias("missing_share"))
    runs = islands(d, key, ts, F.col("_flat"), width=width, tie=tie).groupBy(*key).agg((F.max("length") + 1).alias("_l"))
    return base.join(runs, list(key), "left").withColumn("longest_flat", F.coalesce("_l", F.lit(0))).drop("_l")


def _spacing_exit(gap: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["_at"].to_numpy())
        origin = int(pdf[SLICE].iloc[0]) * width
        follow = np.searchsorted(at, at + gap, side="left")
        last = np.empty(len(at), dtype=np.int64)
        for i in range(len(at) - 1, -1, -1):
            last[i] = at[i] if follow[i] == len(at) else last[follow[i]]
        entry = origin - np.arange(1, gap + 1)          # time of the last accepted row, d steps before the slice
        entry[-1] = origin - gap                        # the last state stands for "gap or more"
        first = np.searchsorted(at, entry + gap, side="left")
        leave = np.where(first < len(at), last[np.minimum(first, len(at) - 1)], entry)
        head = pdf.iloc[[0]].drop(columns="_at").reset_index(drop=True)
        head["leave"] = [(origin + width - leave).clip(1, gap).astype("int64").tolist()]
        return head
    return run


def _spacing_mark(gap: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        last = int(pdf[SLICE].iloc[0]) * width - int(pdf["_enter"].iloc[0])
        keep = np.zeros(len(pdf), dtype=bool)
        for i, t in enumerate(pdf["_at"].to_numpy()):
            if t - last >= gap:
                keep[i], last = True, t
        return pdf[keep].drop(columns="_enter")
    return run


def greedy_spacing(df: DataFrame, key: Sequence[str], step: str, gap: int, width: int = 4096) -> DataFrame:
    """Keep candidate rows in step order, each at least ``gap`` steps after the last kept one.

    The rule is sequential, but all it remembers is how many steps ago it last kept a
    row, 1 to ``gap``.  Every (key, slice) is therefore reduced to a table from the
    state on entry to the state on exit; chaining these short tables gives each slice
    its entry state, and a second pass marks the rows.
    """
    if gap <= 1:
        return df.select(*key, F.col(step))
    width = max(width, gap)
    cand = df.select(*key, F.col(step).cast("bigint").alias("_at")).distinct().withColumn(SLICE, F.floor(F.col("_at") / width).cast("bigint"))
    fields = [f for f in cand.schema.fields if f.name != "_at"]
    exits = cand.groupBy(*key, SLICE).applyInPandas(
        _spacing_exit(gap, width), T.StructType([*fields, T.StructField("leave", T.ArrayType(T.LongType()))]))
    chain = exits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(SLICE, "leave"))).alias("_s"))
    zero = F.struct(F.lit(None).cast("bigint").alias("slice"), F.lit(gap).cast("bigint").alias("state"),
                    F.array().cast(f"array<struct<{SLICE}:bigint,_enter:bigint>>").alias("seen"))

    def follow(acc, s):
        skipped = F.coalesce((s[SLICE] - acc["slice"] - 1) * width, F.lit(0))
        enter = F.least(acc["state"] + skipped, F.lit(gap).cast("bigint"))
        return F.struct(s[SLICE].alias("slice"), F.element_at(s["leave"], enter.cast("int")).alias("state"),
                        F.concat(acc["seen"], F.array(F.struct(s[SLICE].alias(SLICE), enter.alias("_enter")))).alias("seen"))

    enters = chain.select(*key, F.inline(F.aggregate("_s", zero, follow, lambda a: a["seen"])))
    marked = cand.join(enters, [*key, SLICE]).groupBy(*key, SLICE).applyInPandas(_spacing_mark(gap, width), cand.schema)
    return marked.select(*key, F.col("_at").alias(step))


def local_peaks(df: DataFrame, key: Sequence[str], step: str, x: str, threshold: float | None = None,
                separation: int = 1, tie: str = "left_strict", priority: str = "time", width: float | None = None) -> DataFrame:
    """Local maxima per key; ends of the series are never peaks.

    ``tie='left_strict'`` asks for > on the left and >= on the right,
    ``'right_strict'`` the reverse.  ``threshold`` applies to z scores (population SD).  Peaks closer
    than ``separation`` are thinned in time order, or highest first (``priority='height'``).
    """
    d = scan(df.select(*key, step, x), key, step, {"_l": ("lag", x), "_r": ("lead", x)}, width)
    v = F.col(x)
    sides = ((v > F.col("_l")) & (v >= F.col("_r"))) if tie == "left_strict" else ((v >= F.col("_l")) & (v > F.col("_r")))
    cand = d.filter(sides)
    if threshold is not None:
        moments = df.groupBy(*key).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_sd"))
        cand = cand.join(moments, list(key)).filter((v - F.col("_m")) / (F.col("_sd") + 1e-12) > threshold)
    cand = cand.select(*key, step, x)
    if separation <= 1:
        return cand
    if priority == "time":
        return cand.join(greedy_spacing(cand, key, step, separation), [*key, step])
    kept, left = None, cut(cand)
    while not left.isEmpty():
        rank = F.struct(v, -F.col(step))
        d = near(left, key, step, separation - 1, separation - 1, 4096, {"_top": F.max(rank)})
        top = cut(d.filter(rank == F.col("_top")).drop("_top"))
        kept = top if kept is None else kept.unionByName(top)
        block = top.withColumn(step, F.explode(F.sequence(F.col(step) - (separation - 1), F.col(step) + (separation - 1)))).select(*key, step).distinct()
        left = cut(left.join(block, [*key, step], "left_anti"))
    return kept if kept is not None else cand


def bin_events_around(events: DataFrame, index: DataFrame, key: Sequence[str], ts: str, index_id: str, at: str,
                      pre: float, post: float, size: float, width: float) -> DataFrame:
    """Counts of events per bin of ``size`` from ``pre`` before to ``post`` after each index event, zeros filled."""
    n = math.ceil((pre + post) / size)
    probe = index.select(*key, index_id, axis(index, at).alias("_at"))
    probe = probe.withColumn("_a", F.col("_at") - pre).withColumn("_b", F.col("_at") + post)
    hits = range_pairs(probe, events.select(*key, F.col(ts).alias("_ts")), key, "_a", "_b", "_ts", width)
    hits = hits.withColumn("bin", F.floor((axis(hits, "_ts") - F.col("_a")) / size).cast("bigint")).filter(F.col("bin") < n)
    counts = hits.groupBy(*key, index_id, "bin").agg(F.count(F.lit(1)).alias("n"))
    return skeleton(index, [*key, index_id], "bin", 0, n - 1).join(counts, [*key, index_id, "bin"], "left").fillna(0, subset=["n"])


def window_aggregate(df: DataFrame, key: Sequence[str], ts: str, value: str, size: float, step: float, min_n: int) -> DataFrame:
    """Mean, min, max, count and variation index per window of ``size`` every ``step``, counted from the key's first time.

    A window that would run past the key's last time is dropped; below ``min_n``
    values the statistics are NULL.
    """
    d = df.select(*key, axis(df, ts).alias("_t"), F.col(value).alias("_v"))
    ends = d.groupBy(*key).agg(F.min("_t").alias("_a"), F.max("_t").alias("_z"))
    d = d.join(ends, list(key)).withColumn("_r", F.col("_t") - F.col("_a"))
    lo = F.greatest(F.floor((F.col("_r") - size) / step).cast("bigint") + 1, F.lit(0))
    hi = F.floor(F.col("_r") / step).cast("bigint")
    d = d.withColumn("window_no", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    d = d.filter(F.col("window_no") * step + size <= F.col("_z") - F.col("_a") + 1e-9)
    g = d.groupBy(*key, "window_no").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"),
                                         F.min("_v").alias("min"), F.max("_v").alias("max"))
    last = F.floor((F.col("_z") - F.col("_a") - size + 1e-9) / step)
    frame = skeleton(ends.filter(last >= 0), key, "window_no", F.lit(0), last)
    g = frame.join(g, [*key, "window_no"], "left").fillna(0, subset=["n"])
    enough = F.col("n") >= min_n
    mid = (F.col("max") + F.col("min")) / 2
    return g.select(*key, "window_no", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("mean", "min", "max")],
                    F.when(enough & (mid != 0), 100 * (F.col("max") - F.col("min")) / mid).alias("variation"))


def first_sustained(df: DataFrame, key: Sequence[str], step: str, flag: Column, k: int, block: int = 4096) -> DataFrame:
    """First step of each key that opens ``k`` true steps in a row; NULL if none."""
    d = df.withColumn("_f", F.coalesce(flag, F.lit(False)).cast("int"))
    d = near(d, key, step, 0, k - 1, block, {"_n": F.sum("_f")})
    return d.groupBy(*key).agg(F.min(F.when(F.col("_n") == k, F.col(step))).alias("first_step"))


def cusum(counts: DataFrame, key: Sequence[str], step: str, x: str, baseline_n: int, multiplier: float = 2.0,
          h: float = 4.0, min_rate: float = 0.1, width: float | None = None) -> DataFrame:
    """Upper Poisson CUSUM without reset: path after the baseline steps and whether it is at or above ``h``.

    ``step`` counts 0, 1, ... per key.  The baseline is the mean of the first
    ``baseline_n`` steps, at least ``min_rate``; those steps cannot signal.  The
    recursion max(0, S + x - k) equals the running sum minus its running minimum.
    """
    base = counts.filter(F.col(step) < baseline_n).groupBy(*key).agg(F.greatest(F.avg(x), F.lit(min_rate)).alias("rate"))
    k = F.col("rate") * (multiplier - 1) / math.log(multiplier)
    d = counts.filter(F.col(step) >= baseline_n).join(base, list(key)).withColumn("_d", F.col(x) - k)
    d = scan(d, key, step, {"_cum": ("sum", "_d")}, width)
    d = scan(d, key, step, {"_low": ("min", "_cum")}, width)
    s = F.col("_cum") - F.least(F.col("_low"), F.lit(0.0))
    return d.withColumn("statistic", s).withColumn("above", s >= h).drop("_cum", "_low", "_d")


def cusum_signal(path: DataFrame, key: Sequence[str], step: str) -> DataFrame:
    """First step at which the path is above its limit, NULL if never."""
    return path.groupBy(*key).agg(F.min(F.when(F.col("above"), F.col(step))).alias("signal_step"), F.count(F.lit(1)).alias("n_steps"))


def false_alarm_rate(signals: DataFrame, steps_per_year: float = 12.0) -> DataFrame:
    """Signals per 100 key-years over never-affected series."""
    years = F.sum("n_steps") / steps_per_year
    return signals.agg(F.count("signal_step").alias("signals"), years.alias("key_years"),
                       (100 * F.count("signal_step") / years).alias("per_100_key_years"))


def cusum_resets(counts: DataFrame, key: Sequence[str], step: str, x: str, expected: Column, h: float = 5.0) -> DataFrame:
    """CUSUM that restarts from zero after each alarm (S > h): first alarm step and number of alarms.

    ``counts`` is a calendar series, so a key holds as many rows as there are calendar
    steps, however many events it had; the recursion runs over that array.
    """
    k = expected / math.log(2.0)
    series = counts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), (F.col(x) - k).alias("d")))).alias("_a"))
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(None).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("n"))

    def follow(a, r):
        v = F.greatest(F.lit(0.0), a["v"] + r["d"])
        hit = v > h
        return F.struct(F.when(hit, 0.0).otherwise(v).alias("v"),
                        F.coalesce(a["first"], F.when(hit, r["s"].cast("bigint"))).alias("first"),
                        (a["n"] + hit.cast("bigint")).alias("n"))

    out = series.select(*key, F.aggregate("_a", zero, follow).alias("_z"))
    return out.select(*key, F.col("_z.first").alias("first_alarm"), F.col("_z.n").alias("n_alarms"))


def lead_times(signals: DataFrame, events: DataFrame, key: Sequence[str], signal: str, event: str) -> DataFrame:
    """Steps from the signal to the event (positive: signal first) for keys that have an event."""
    d = events.join(signals, list(key), "left")
    return d.withColumn("lead", F.col(event) - F.col(signal)).withColumn("flagged", F.col(signal).isNotNull())


def lagged_corr(a: DataFrame, b: DataFrame, key: Sequence[str], step: str, x: str, y: str, max_lag: int, min_n: int = 10) -> DataFrame:
    """Correlation of a[t] with b[t + lag] for every lag, both series mean-centred once per key.

    Overlaps shorter than ``min_n`` steps are left out.
    """
    ma, mb = a.groupBy(*key).agg(F.avg(x).alias("_ma")), b.groupBy(*key).agg(F.avg(y).alias("_mb"))
    ca = a.join(ma, list(key)).select(*key, F.col(step), (F.col(x) - F.col("_ma")).alias("_x"))
    cb = b.join(mb, list(key)).select(*key, F.col(step), (F.col(y) - F.col("_mb")).alias("_y"))
    ca = ca.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn(step, F.col(step) + F.col("lag"))
    d = ca.join(cb, [*key, step])
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x"))) * F.sqrt(F.sum(F.col("_y") * F.col("_y"))) + 1e-12
    return (d.groupBy(*key, "lag").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("_x") * F.col("_y")) / norm).alias("r"))
            .filter(F.col("n") >= min_n))


def best_lag(lags: DataFrame, key: Sequence[str], refine: bool = False) -> DataFrame:
    """Lag with the highest correlation (the smallest such lag), optionally refined by a parabola through its neighbours."""
    best = lags.groupBy(*key).agg(F.max(F.struct("r", (-F.col("lag")).alias("neg"))).alias("_b"))
    out = best.select(*key, (-F.col("_b.neg")).alias("lag"), F.col("_b.r").alias("r"))
    if not refine:
        return out
    left = lags.select(*key, (F.col("lag") + 1).alias("lag"), F.col("r").alias("_y0"))
    right = lags.select(*key, (F.col("lag") - 1).alias("lag"), F.col("r").alias("_y2"))
    d = out.join(left, [*key, "lag"], "left").join(right, [*key, "lag"], "left")
    den = F.col("_y0") - 2 * F.col("r") + F.col("_y2")
    shift = F.when(den != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (F.col("_y0") - F.col("_y2")) / den))).otherwise(0.0)
    shift = F.when(F.col("_y0").isNotNull() & F.col("_y2").isNotNull(), shift).otherwise(0.0)
    peak = F.col("r") - F.coalesce(0.25 * (F.col("_y0") - F.col("_y2")) * shift, F.lit(0.0))
    return d.select(*key, (F.col("lag") + shift).alias("lag"), peak.alias("r"))


def alarms(prob: DataFrame, key: Sequence[str], step: str, p: str, k: int, p_thr: float = 0.5, a_thr: float = 0.5,
           refractory: int = 0) -> DataFrame:
    """Alarm steps: at least ``a_thr`` of the last ``k`` windows above ``p_thr``, more than ``refractory`` steps after the last alarm.

    The start of a series counts missing windows as below the threshold.
    """
    d = near(prob, key, step, k - 1, 0, 4096, {"_hits": F.sum((F.col(p) > p_thr).cast("int"))})
    cand = d.filter(F.col("_hits") / k >= a_thr)
    return greedy_spacing(cand, key, step, refractory + 1)


def label_windows(windows: DataFrame, events: DataFrame, key: Sequence[str], start: str, length: float, on: str, off: str,
                  horizon_gap: float, occurrence: float, post: float, buffer: float, width: float) -> DataFrame:
    """Label windows 1 (before an event), -1 (excluded) or 0 (neutral) by their position to the key's events.

    Pre-event: inside [on - gap - occurrence, on - gap].  Excluded: overlapping
    [on - gap, off + post] or within ``buffer`` of the event.  A pre-event label wins.
    """
    w = windows.withColumn("_ws", axis(windows, start)).withColumn("_we", axis(windows, start) + float(length))
    e = events.select(*key, axis(events, on).alias("_on"), axis(events, off).alias("_off"))
    reach = max(buffer, horizon_gap + occurrence)
    e = e.withColumn("_a", F.col("_on") - reach - length).withColumn("_b", F.col("_off") + max(buffer, post))
    spots = w.select(*key, start, "_ws", "_we").distinct()
    hit = range_pairs(e, spots, key, "_a", "_b", "_ws", width)
    on_, off_, ws, we = F.col("_on"), F.col("_off"), F.col("_ws"), F.col("_we")
    pre = (ws >= on_ - horizon_gap - occurrence) & (we <= on_ - horizon_gap)
    out = ((we > on_ - horizon_gap) & (ws < off_ + post)) | ((we > on_ - buffer) & (ws < off_ + buffer))
    best = hit.groupBy(*key, "_ws").agg(F.max(F.when(pre, 2).when(out, 1).otherwise(0)).alias("_p"))
    label = F.when(F.col("_p") == 2, 1).when(F.col("_p") == 1, -1).otherwise(0)
    return w.join(best, [*key, "_ws"], "left").withColumn("label", label).drop("_ws", "_we", "_p")


def moving_average(df: DataFrame, key: Sequence[str], step: str, x: str, k: int, mode: str = "centred", block: int = 4096) -> DataFrame:
    """NULL-aware mean of ``k`` grid rows, centred (extra row before for even ``k``) or trailing."""
    back, ahead = (k // 2, (k - 1) // 2) if mode == "centred" else (k - 1, 0)
    return near(df, key, step, back, ahead, block, {"average": F.avg(x)})


def time_in_band(df: DataFrame, by: str, thresholds: Mapping[str, float]) -> DataFrame:
    """Share of sub-threshold rows falling in each class against the class's share of all rows."""
    flags = [F.sum(F.when(F.col(c) < t, 1).otherwise(0)).alias(f"f_{c}") for c, t in thresholds.items()]
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *flags)
    tot = g.agg(F.sum("_n").alias("_tn"), *[F.sum(f"f_{c}").alias(f"t_{c}") for c in thresholds])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(float(t)).alias("threshold"), F.col(f"f_{c}").alias("n_flagged"),
                              F.col(f"t_{c}").alias("_tf")) for c, t in thresholds.items()])
    d = g.join(F.broadcast(tot)).select(by, "_n", "_tn", F.inline(rows))
    share = F.when(F.col("_tf") > 0, F.col("n_flagged") / F.col("_tf")).otherwise(0.0)
    exposure = F.col("_n") / F.col("_tn")
    return d.select(by, "variable", "threshold", "n_flagged", share.alias("flag_share"), exposure.alias("exposure_share"),
                    (share / exposure).alias("enrichment"))


def stage_shares(df: DataFrame, key: Sequence[str], state: str, states: Sequence[str], wake: str, unscored: str) -> DataFrame:
    """Share of each sleep state over total sleep, sleep rows and efficiency; unscored rows are excluded."""
    s = F.col(state)
    scored = F.sum(F.when(s != unscored, 1).otherwise(0))
    asleep = F.sum(F.when((s != unscored) & (s != wake), 1).otherwise(0))
    return df.groupBy(*key).agg(
        *[F.when(asleep > 0, F.sum(F.when(s == v, 1).otherwise(0)) / asleep).alias(f"share_{v}") for v in states],
        asleep.alias("sleep_rows"), F.when(scored > 0, asleep / scored).alias("efficiency"))


def transitions(df: DataFrame, key: Sequence[str], order: str, state: str, width: float | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """From-to counts of consecutive states inside a key, with the probability given the from-state."""
    d = scan(df.select(*key, order, *[c for c in tie if c not in (order, state)], state), key, order, {"_to": ("lead", state)}, width, tie)
    n = d.filter(F.col("_to").isNotNull()).groupBy(F.col(state).alias("from_state"), F.col("_to").alias("to_state")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("from_state").agg(F.sum("n").alias("_t"))
    return n.join(total, "from_state").withColumn("probability", F.col("n") / F.col("_t")).drop("_t")


def dwell(df: DataFrame, key: Sequence[str], order: str, state: str, width: float | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Occupancy, number of runs and mean run length (rows) of each state."""
    d = scan(df.select(*key, order, *[c for c in tie if c not in (order, state)], state), key, order, {"_was": ("lag", state)}, width, tie)
    g = d.groupBy(state).agg(F.count(F.lit(1)).alias("rows"),
                             F.sum(F.when(F.col("_was").isNull() | (F.col("_was") != F.col(state)), 1).otherwise(0)).alias("runs"))
    total = g.agg(F.sum("rows").alias("_t"))
    return g.join(F.broadcast(total)).select(state, "rows", "runs", (F.col("rows") / F.col("_t")).alias("occupancy"),
                                             (F.col("rows") / F.col("runs")).alias("mean_dwell"))


def step_change(df: DataFrame, key: Sequence[str], time: str, value: str, width: float | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Add the change from the key's previous row, the highest value so far and whether a positive value has occurred."""
    d = scan(df, key, time, {"_pv": ("lag", value), "max_so_far": ("max", value)}, width, tie)
    return d.withColumn("change", F.col(value) - F.col("_pv")).withColumn("ever_positive", F.col("max_so_far") > 0).drop("_pv")


def monotonicity(df: DataFrame, key: Sequence[str], time: str, value: str, width: float | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Share of consecutive pairs that do not fall, that rise, and their number."""
    d = step_change(df, key, time, value, width, tie).filter(F.col("change").isNotNull())
    return d.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg((F.col("change") >= 0).cast("double")).alias("frac_nondecreasing"),
                 F.avg((F.col("change") > 0).cast("double")).alias("frac_increasing"))


def first_last(df: DataFrame, key: Sequence[str], time: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """First and last value of each key and their difference."""
    at = F.struct(time, *tie)
    return df.groupBy(*key).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.count(F.lit(1)).alias("n")).withColumn(
        "delta", F.col("last") - F.col("first"))


def label_stability(df: DataFrame, key: Sequence[str], time: str, label: str, width: float | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Agreement of a label between consecutive rows of a key; kappa against the squared baseline shares."""
    d = scan(df.select(*key, time, *[c for c in tie if c not in (time, label)], label), key, time, {"_to": ("lead", label)}, width, tie)
    g = d.filter(F.col("_to").isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("_to") == F.col(label)).cast("int")).alias("_a"))
    out = g.agg(F.sum("_n").alias("n_pairs"), (F.sum("_a") / F.sum("_n")).alias("agreement"),
                (F.sum(F.col("_n") * F.col("_n")) / (F.sum("_n") * F.sum("_n"))).alias("expected_agreement"))
    po, pe = F.col("agreement"), F.col("expected_agreement")
    return out.withColumn("kappa", F.when(pe < 1, (po - pe) / (1 - pe)))


def circular_summary(df: DataFrame, by: Sequence[str], hour: str, min_n: int = 1, shift_hours: Sequence[float] = (7.0, 19.0),
                     shift_window: float = 0.5) -> DataFrame:
    """Mean resultant length and hour, Rayleigh z and p, peak/trough of the hourly histogram, share near a shift change."""
    h = F.col(hour)
    angle = h * (2 * math.pi / 24)
    dist = F.least(*[F.least(F.pmod(h - s, F.lit(24.0)), F.pmod(F.lit(s) - h, F.lit(24.0))) for s in shift_hours])
    bins = [F.sum(F.when(F.floor(h) == i, 1).otherwise(0)) for i in range(24)]
    g = df.filter(h.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.cos(angle)).alias("_c"), F.avg(F.sin(angle)).alias("_s"),
        F.greatest(*bins).alias("peak"), F.least(*bins).alias("trough"), F.avg((dist <= shift_window).cast("double")).alias("shift_share"))
    r = F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))
    mean = F.pmod(F.atan2("_s", "_c") * (24 / (2 * math.pi)), F.lit(24.0))
    n, rn = F.col("n"), F.col("n") * r
    p = F.exp(F.sqrt(1 + 4 * n + 4 * (n * n - rn * rn)) - (1 + 2 * n))
    return g.filter(n >= min_n).select(*by, "n", r.alias("resultant"), mean.alias("mean_hour"), (rn * rn / n).alias("z"),
                                       F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"), "peak", "trough", "shift_share")
