"""Time-to-event tables, curves, tests, landmarks and concordance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import Z975, gammainc
from ..plans.lineage import cut
from ..plans.ordered import add_slices, axis, near, ordered_pairs, scan
from .joins import asof_join


def time_to_event(entities: DataFrame, events: DataFrame, key: str, origin: str, kind: str, at: str, kinds: Sequence[str], cut: Column,
                  last: str | None = None, landmark_days: float = 0.0, unit_days: float = 1.0, floor: float = 0.001) -> DataFrame:
    """Duration from the landmark and the first event's kind.

    The earliest event decides; at equal times the kind listed first in ``kinds`` wins.  Entities
    with an event up to the landmark, or whose landmark is not before the cut, are left out.  Without
    an event by the cut the row is censored at ``last`` (if given) or the cut.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    first = events.filter(F.col(kind).isin(*kinds) & F.col(at).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(at).alias("at"), order.alias("o"), F.col(kind).alias("k"))).alias("_e"))
    d = entities.join(first, key, "left")
    day = 86400.0
    zero = axis(entities, origin) + landmark_days * day
    when = F.col("_e.at").cast("timestamp").cast("double")
    end = cut.cast("timestamp").cast("double")
    stop = F.least(axis(entities, last), end) if last else end
    d = d.withColumn("_zero", zero).withColumn("_when", when).withColumn("_end", end).withColumn("_stop", stop)
    d = d.filter((F.col("_zero") < F.col("_end")) & (F.col("_when").isNull() | (F.col("_when") > F.col("_zero"))))
    hit = F.coalesce(F.col("_when") <= F.col("_end"), F.lit(False))
    span = (F.when(hit, F.col("_when")).otherwise(F.col("_stop")) - F.col("_zero")) / day / unit_days
    return d.select(*entities.columns, F.greatest(span, F.lit(floor)).alias("duration"), hit.cast("int").alias("event"),
                    F.when(hit, F.col("_e.k")).otherwise("censored").alias("event_kind"))


def _times(df: DataFrame, by: Sequence[str], time: str, counts: dict[str, Column], entry: str | None, width: float | None = None) -> DataFrame:
    """Counts per distinct time with the number at risk (entry < t <= time), from sums running over the times."""
    ends = df.groupBy(*by, F.col(time).cast("double").alias("_t")).agg(F.count("*").alias("_out"), *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in counts.items()])
    start = F.col(entry).cast("double") if entry else F.lit(0.0)
    ins = df.groupBy(*by, start.alias("_t")).agg(F.count("*").alias("_in"))
    line = ends.unionByName(ins, allowMissingColumns=True).groupBy(*by, "_t").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("_out", "_in", *counts)])
    line = cut(line)      # one row per distinct time; every later step reads this table, not the input
    line = scan(add_slices(line, "_t", width), by, "_t", {"_before_in": ("prev_sum", "_in"), "_before_out": ("prev_sum", "_out")}, keep_slice=True)
    return line.withColumn("at_risk", F.coalesce("_before_in", F.lit(0)) - F.coalesce("_before_out", F.lit(0))).drop("_before_in", "_before_out", "_in", "_out")


def _curve(times: DataFrame, by: Sequence[str], deaths: str) -> DataFrame:
    """Product-limit survival after each time; a factor of zero is carried as a count, not a logarithm."""
    d, n = F.col(deaths), F.col("at_risk")
    return scan(times, by, "_t", {
        "_log": ("sum", F.when((d > 0) & (n > d), F.log(1 - d / n)).otherwise(0.0)), "_zero": ("count", F.when((d > 0) & (n == d), 1)),
        "_var": ("sum", F.when((d > 0) & (n > d), d / (n * (n - d))).otherwise(0.0))}, keep_slice=True).withColumn(
        "survival", F.when(F.col("_zero") > 0, 0.0).otherwise(F.exp("_log")))


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str] = (), entry: str | None = None, width: float | None = None) -> DataFrame:
    """Survival at each event time with Greenwood SE and log-log limits."""
    d = _curve(_times(df, by, time, {"events": F.col(event) == 1}, entry, width), by, "events").filter((F.col("events") > 0) & (F.col("at_risk") > 0))
    s = F.col("survival")
    inside = (s > 0) & (s < 1)
    ll, sell = F.log(-F.log(s)), F.sqrt("_var") / F.abs(F.log(s))
    return d.select(*by, F.col("_t").alias("time"), "at_risk", "events", "survival", (s * F.sqrt("_var")).alias("se"),
                    F.when(inside, F.exp(-F.exp(ll + Z975 * sell))).otherwise(s).alias("ci_lo"), F.when(inside, F.exp(-F.exp(ll - Z975 * sell))).otherwise(s).alias("ci_hi"))


def median_and_mean(km: DataFrame, by: Sequence[str], tau: float, width: float | None = None) -> DataFrame:
    """First time with survival at most one half, and the area under the curve up to ``tau``."""
    d = scan(km.select(*by, "time", "survival"), by, "time", {"_next": ("lead", "time")}, width)
    cap = lambda c: F.least(c, F.lit(float(tau)))
    step = F.col("survival") * (cap(F.coalesce("_next", F.lit(float(tau)))) - cap(F.col("time")))
    return d.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"), (F.sum(step) + cap(F.min("time"))).alias("rmst"))


def logrank(df: DataFrame, time: str, event: str, group: str, groups: Sequence, entry: str | None = None, width: float | None = None) -> DataFrame:
    """Observed and expected events per group and the k-sample chi-square (k - 1 degrees of freedom)."""
    k = len(groups)
    code = F.coalesce(*[F.when(F.col(group) == g, F.lit(i)) for i, g in enumerate(groups)])
    known = df.withColumn("_g", code).filter(F.col("_g").isNotNull())
    parts = _times(known, ["_g"], time, {"d": F.col(event) == 1}, entry, width).select("_t", "_g", "d", "at_risk")
    # every group's number at risk is needed at every event time: take the next known count of the group
    deaths = parts.filter("d > 0").select("_t").distinct()
    frame = deaths.select("_t", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("_g"))
    line = parts.withColumn("_ask", F.lit(0)).unionByName(frame.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    nearest = F.when(F.col("_ask") == 0, F.struct(F.col("_t").alias("t"), F.col("d").alias("d")))
    line = scan(line.withColumn("_late", 1 - F.col("_ask")), ["_g"], "_t", {"_n": ("next", "at_risk"), "_near": ("next", nearest)}, width, ["_late"])
    ask = line.filter("_ask = 1").select("_t", "_g", F.coalesce("_n", F.lit(0)).alias("n"), F.when(F.col("_near.t") == F.col("_t"), F.col("_near.d")).otherwise(0).alias("d"))
    wide = ask.groupBy("_t").agg(*[F.sum(F.when(F.col("_g") == i, F.col("n"))).alias(f"n{i}") for i in range(k)], *[F.sum(F.when(F.col("_g") == i, F.col("d"))).alias(f"d{i}") for i in range(k)])
    n, d = sum((F.col(f"n{i}") for i in range(k)), F.lit(0)), sum((F.col(f"d{i}") for i in range(k)), F.lit(0))
    wide = wide.withColumn("_nn", n.cast("double")).withColumn("_dd", d.cast("double")).filter("_nn > 0")
    nn, dd = F.col("_nn"), F.col("_dd")
    aggs = []
    for i in range(k):
        aggs += [F.sum(f"d{i}").cast("double").alias(f"o{i}"), F.sum(dd * F.col(f"n{i}") / nn).alias(f"e{i}")]
        for j in range(k):
            v = dd * (F.col(f"n{i}") / nn) * ((1.0 if i == j else 0.0) - F.col(f"n{j}") / nn) * (nn - dd) / (nn - 1)
            aggs.append(F.sum(F.when(nn > 1, v).otherwise(0.0)).alias(f"v{i}_{j}"))
    sums = wide.agg(*aggs)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, r in b.iterrows():
                o = np.array([r[f"o{i}"] for i in range(k)])
                e = np.array([r[f"e{i}"] for i in range(k)])
                v = np.array([[r[f"v{i}_{j}"] for j in range(k)] for i in range(k)])
                diff = (o - e)[:-1]
                chi2 = float(diff @ np.linalg.solve(v[:-1, :-1], diff))
                p = float(1 - gammainc((k - 1) / 2, chi2 / 2))
                yield pd.DataFrame({"group": [str(g) for g in groups], "observed": o, "expected": e, "chi2": chi2, "df": k - 1, "p": p})

    return sums.mapInPandas(solve, "group STRING, observed DOUBLE, expected DOUBLE, chi2 DOUBLE, df INT, p DOUBLE")


def aalen_johansen(df: DataFrame, time: str, kind: str, cause: str, censored: str, by: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """Cumulative incidence of a cause with the other kinds competing."""
    t = _times(df, by, time, {"any": F.col(kind) != censored, "mine": F.col(kind) == cause}, None, width)
    t = _curve(t, by, "any").filter("any > 0 AND at_risk > 0")
    t = scan(t, by, "_t", {"_before": ("lag", "survival")}, keep_slice=True)
    t = scan(t, by, "_t", {"incidence": ("sum", F.coalesce("_before", F.lit(1.0)) * F.col("mine") / F.col("at_risk"))})
    return t.select(*by, F.col("_t").alias("time"), "at_risk", "mine", "incidence")


def concordance(df: DataFrame, time: str, event: Column, risk: str, by: Sequence[str] = ()) -> DataFrame:
    """Harrell's C over pairs where i has the event and T_j > T_i; equal risks count one half.  Pairs are never formed."""
    g = ordered_pairs(df, by, time, risk, event.cast("double"), F.lit(1.0))
    good = F.col("total") - F.col("below") - F.col("equal") + 0.5 * F.col("equal")
    return g.select(*by, F.col("total").cast("bigint").alias("comparable"), F.when(F.col("total") > 0, good / F.col("total")).alias("c_index"))


def person_period(subjects: DataFrame, obs: DataFrame, key: str, time: str, stop: str, event: str, length: float, max_period: int | None = None) -> DataFrame:
    """ceil(T / length) rows per subject, the event in the last; covariates as last observed by the period start, else the first ones."""
    n = F.greatest(F.ceil(F.greatest(F.col(stop), F.lit(1e-9)) / length), F.lit(1)).cast("bigint")
    d = subjects.withColumn("period", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    d = d.withColumn("y", ((F.col(event) == 1) & (F.col("period") == n - 1)).cast("int")).withColumn("_at", F.col("period") * length + 1e-9)
    covars = [c for c in obs.columns if c not in (key, time)]
    first = obs.groupBy(key).agg(F.min_by(F.struct(*covars), F.struct(time, *covars)).alias("_f"))
    got = asof_join(d, obs.withColumn("_tie", F.struct(*covars)).withColumnRenamed(time, "_ot"), [key], "_at", "_ot", width=length * 8, tie=["_tie"])
    got = got.join(first, key, "left")
    lump = F.col("period") if max_period is None else F.least(F.col("period"), F.lit(max_period))
    return got.select(*subjects.columns, "period", lump.alias("period_cat"), "y", *[F.coalesce(F.col(c), F.col(f"_f.{c}")).alias(c) for c in covars])


def landmark_dataset(entities: DataFrame, obs: DataFrame, key: str, exit_: str, event_at: str, t: str, x: str, step: float, horizon: float,
                     window: float, width: float) -> DataFrame:
    """One row per entity and landmark L still at risk, with strictly past features and the outcome in (L, L + horizon].

    Features: last, minimum, count, slope over the whole past, mean over the last ``window`` and time since the last
    observation.  ``censored`` marks follow-up ending inside the horizon without the event.
    """
    last = F.greatest(F.ceil(F.col(exit_) / step).cast("bigint") - 1, F.lit(0).cast("bigint"))
    lm = entities.withColumn("landmark", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("landmark", F.col("landmark") * float(step))
    lm = lm.filter((F.col("landmark") < F.col(exit_)) & (F.col(event_at).isNull() | (F.col(event_at) > F.col("landmark"))))
    line = obs.select(key, F.col(t).cast("double").alias("_t"), F.col(x).cast("double").alias("_x"), F.lit(1).alias("_o"))
    marks = lm.select(key, F.col("landmark").alias("_t"), F.struct(*lm.columns).alias("_l"), F.lit(0).alias("_o"))
    line = line.unionByName(marks, allowMissingColumns=True)
    tt, xx = F.col("_t"), F.col("_x")
    seen = F.when(xx.isNotNull(), tt)
    line = near(line, [key], "_t", window, 0.0, width, {"recent_mean": F.avg("_x")}, (True, False))
    line = scan(line, [key], "_t", {"last": ("prev_last", "_x"), "_seen": ("prev_last", seen), "min": ("prev_min", "_x"), "count": ("prev_count", "_x"),
                                    "_sx": ("prev_sum", "_x"), "_st": ("prev_sum", seen), "_stt": ("prev_sum", seen * tt), "_stx": ("prev_sum", tt * xx)}, width, ["_o", "_x"])
    n = F.col("count")
    den = n * F.col("_stt") - F.col("_st") * F.col("_st")
    slope = F.when((n >= 2) & (den > 1e-9), (n * F.col("_stx") - F.col("_st") * F.col("_sx")) / den)
    out = line.filter(F.col("_l").isNotNull())
    ev, L = F.col(f"_l.{event_at}"), F.col("_l.landmark")
    y = F.coalesce((ev > L) & (ev <= L + horizon), F.lit(False))
    return out.select("_l.*", "last", "min", "count", "recent_mean", slope.alias("slope"), (tt - F.col("_seen")).alias("since_last"), y.cast("int").alias("y"),
                      ((~y) & (F.col(f"_l.{exit_}") < L + horizon)).alias("censored"))


def landmark_states(windows: DataFrame, key: Sequence[str], step: str, state: str, horizon: int, first: int, terminal: Sequence[str]) -> DataFrame:
    """Current windows from ``first`` on that are not terminal, with the state ``horizon`` windows ahead (the latest known before that if the stay ended)."""
    d = near(windows, key, step, 0, horizon, 4096, {"future_state": F.last(state)}, (False, True))
    return d.filter((F.col(step) >= first) & ~F.col(state).isin(*terminal) & F.col("future_state").isNotNull())


def ipcw_brier(df: DataFrame, pred: str, time: str, kind: str, cause: str, censored: str, horizon: float, width: float | None = None) -> DataFrame:
    """Brier score at the horizon with inverse censoring-probability weights."""
    g = _curve(_times(df, [], time, {"_c": F.col(kind) == censored}, None, width), [], "_c").select(F.col("_t").alias("_gt"), F.col("survival").alias("_g"))
    end = g.filter(F.col("_gt") <= horizon).agg(F.max_by("_g", "_gt").alias("_gh"))
    d = df.join(g, df[time].cast("double") == F.col("_gt")).join(F.broadcast(end))
    early = F.col(time) <= horizon
    w = F.when(early & (F.col(kind) != censored), 1 / F.greatest("_g", F.lit(1e-8))).when(~early, 1 / F.greatest(F.coalesce("_gh", F.lit(1.0)), F.lit(1e-8))).otherwise(0.0)
    miss = F.when(early & (F.col(kind) == cause), 1 - F.col(pred)).otherwise(F.col(pred))
    return d.agg(F.count("*").alias("n"), (F.sum(w * miss * miss) / F.count("*")).alias("brier"))
