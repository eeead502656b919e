"""Discrimination, calibration, decision, shift, resampling and event scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import poisson
from ..functions.stats import t_p, two_sided_p
from ..plans.blocks import met, packed
from ..plans.fits import stopped
from ..plans.lineage import cut
from ..plans.ordered import quantiles, range_pairs, scan, value_ranks
from .joins import closest_pairs
from .permutations import permuted_means
from .timeseries import merge_events, split_events


def _both(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(other, list(by)) if by else df.join(F.broadcast(other))


def score_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = (), w: str | None = None) -> DataFrame:
    """Positive and negative weight per distinct (by, score): all rank metrics need no more than this."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    ok = F.col(y).isNotNull() & F.col(score).isNotNull()
    return df.filter(ok).groupBy(*by, F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(y) == 1, weight).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 0, weight).otherwise(0.0)).alias("neg"), F.count("*").alias("rows"))


def auroc(df: DataFrame, y: str, score: str, by: Sequence[str] = (), w: str | None = None) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties one half; NULL with a single class."""
    d = scan(score_counts(df, y, score, by, w), by, "s", {"below": ("prev_sum", "neg")})
    g = d.groupBy(*by).agg(F.sum("rows").alias("n"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum(F.col("pos") * (F.coalesce("below", F.lit(0.0)) + 0.5 * F.col("neg"))).alias("_u"),
                           F.sum(F.when(F.col("pos") > 0, F.col("pos")).otherwise(0)).cast("bigint").alias("n_pos"))
    return g.select(*by, "n", "n_pos", F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auroc"))


def _from_top(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cumulative positives and all rows from the highest score down to each distinct score."""
    d = counts.withColumn("_neg_s", -F.col("s"))
    return scan(d, by, "_neg_s", {"tp": ("sum", "pos"), "fp": ("sum", "neg")}).drop("_neg_s")


def auprc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision over distinct thresholds."""
    d = _from_top(score_counts(df, y, score, by), by)
    return d.groupBy(*by).agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("auprc"))


def precision_at_k(df: DataFrame, y: str, score: str, k: int, tie: str) -> DataFrame:
    top = df.orderBy(F.desc(score), tie).limit(k)
    total = df.agg(F.sum(y).alias("_p"))
    return top.agg(F.sum(y).alias("_h"), F.count("*").alias("k")).join(F.broadcast(total)).select("k", (F.col("_h") / F.col("k")).alias("precision"), (F.col("_h") / F.col("_p")).alias("recall"))


def brier_logloss(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-12)), F.lit(1e-12))
    return df.groupBy(*by).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """Rows, mean prediction and observed rate per bin; quantile edges are exact and repeated edges merge."""
    if strategy == "uniform":
        b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
        d = df.withColumn("bin", b)
    else:
        e = quantiles(df, [], p, {f"_e{i}": i / bins for i in range(bins + 1)})
        d = df.join(F.broadcast(e.select(F.array_distinct(F.array(*[f"_e{i}" for i in range(bins + 1)])).alias("_edges"))))
        at = F.size(F.filter("_edges", lambda v: v <= F.col(p))) - 1
        d = d.withColumn("bin", F.greatest(F.least(at, F.size("_edges") - 2), F.lit(0)).cast("int"))
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))


def ece(table: DataFrame) -> DataFrame:
    """Expected calibration error and the reliability and resolution parts of the Brier score from a reliability table."""
    t = table.agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("observed")) / F.sum("n")).alias("_base"))
    gap = F.col("mean_p") - F.col("observed")
    off = F.col("observed") - F.col("_base")
    w = F.col("n") / F.col("_n")
    return table.join(F.broadcast(t)).agg(F.sum(w * F.abs(gap)).alias("ece"), F.sum(w * gap * gap).alias("reliability"), F.sum(w * off * off).alias("resolution"),
                                          F.first(F.col("_base") * (1 - F.col("_base"))).alias("uncertainty"))


def calibration(df: DataFrame, y: str, p: str, w: str | None = None, steps: int = 50) -> DataFrame:
    """Calibration in the large (slope fixed at 1) and slope of logit(p); every Newton step is one aggregate over distinct p."""
    weight = F.col(w) if w else F.lit(1.0)
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    d = df.select(F.log(q / (1 - q)).alias("x"), F.col(y).cast("double").alias("y"), weight.cast("double").alias("w")).groupBy("x").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).persist()
    a, (b0, b1) = 0.0, (0.0, 0.0)
    for _ in range(steps):
        def fit(eta):
            return 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))))
        p1, p2 = fit(F.col("x") + a), fit(b0 + b1 * F.col("x"))
        v1, v2 = F.col("w") * p1 * (1 - p1), F.col("w") * p2 * (1 - p2)
        r2 = F.col("wy") - F.col("w") * p2
        s = d.agg(F.sum(F.col("wy") - F.col("w") * p1), F.sum(v1), F.sum(r2), F.sum(r2 * F.col("x")), F.sum(v2), F.sum(v2 * F.col("x")), F.sum(v2 * F.col("x") * F.col("x"))).first()
        da = s[0] / (s[1] + 1e-8)
        h = np.array([[s[4] + 1e-8, s[5]], [s[5], s[6] + 1e-8]])
        db = np.linalg.solve(h, np.array([s[2], s[3]]))
        a, b0, b1 = a + da, b0 + float(db[0]), b1 + float(db[1])
        if max(abs(da), float(np.abs(db).max())) < 1e-8:
            break
    else:
        stopped("calibration", steps)
    d.unpersist()
    return df.sparkSession.createDataFrame([(float(a), float(b1), float(b0))], "intercept DOUBLE, slope DOUBLE, intercept_free DOUBLE")


def recalibrate(p: Column, intercept: float, slope: float = 1.0) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return 1 / (1 + F.exp(-(intercept + slope * F.log(q / (1 - q)))))


def net_benefit(df: DataFrame, y: str, p: str, thresholds: Sequence[float]) -> DataFrame:
    """Net benefit of model, treat-all and treat-none with sensitivity and specificity per threshold, in one pass over the rows."""
    aggs = []
    for i, t in enumerate(thresholds):
        on = F.col(p) >= t
        aggs += [F.sum(F.when(on & (F.col(y) == 1), 1).otherwise(0)).alias(f"tp{i}"), F.sum(F.when(on & (F.col(y) == 0), 1).otherwise(0)).alias(f"fp{i}")]
    one = df.agg(F.count("*").alias("n"), F.sum(y).alias("pos"), *aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)])
    d = one.select("n", "pos", F.inline(rows))
    n, pos, odds = F.col("n"), F.col("pos"), F.col("threshold") / (1 - F.col("threshold"))
    return d.select("threshold", (F.col("tp") / n - F.col("fp") / n * odds).alias("nb_model"), (pos / n - (n - pos) / n * odds).alias("nb_all"), F.lit(0.0).alias("nb_none"),
                    ((F.col("tp") + F.col("fp")) / n).alias("flagged"), (F.col("tp") / pos).alias("sensitivity"), (1 - F.col("fp") / (n - pos)).alias("specificity"))


def operating_points(df: DataFrame, y: str, p: str, targets: Mapping[str, float]) -> DataFrame:
    """Threshold, sensitivity, specificity and PPV at each target: highest threshold with that ``sensitivity``, lowest with
    at most that ``alert_rate`` or ``fpr``."""
    c = score_counts(df, y, p)
    d = _from_top(c, []).join(F.broadcast(c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))))
    sens, fpr, rate = F.col("tp") / F.col("P"), F.col("fp") / F.col("N"), (F.col("tp") + F.col("fp")) / (F.col("P") + F.col("N"))
    point = F.struct(F.col("s").alias("threshold"), sens.alias("sensitivity"), (1 - fpr).alias("specificity"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ppv"), rate.alias("alert_rate"))
    outs = []
    for kind, v in targets.items():
        if kind == "sensitivity":
            outs.append(F.max_by(point, F.when(sens >= v - 1e-12, F.col("s"))))
        else:
            outs.append(F.min_by(point, F.when((rate if kind == "alert_rate" else fpr) <= v + 1e-12, F.col("s"))))
    one = d.agg(*[o.alias(k) for o, k in zip(outs, targets)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("target"), *[F.col(f"{k}.{c}").alias(c) for c in ("threshold", "sensitivity", "specificity", "ppv", "alert_rate")]) for k in targets])))


def screening_policies(df: DataFrame, y: str, p: str, thresholds: Sequence[float], cost_test: float, cost_screen: float = 0.0, cost_missed: float = 0.0) -> DataFrame:
    """Per threshold: referrals, cases found and missed per 1,000 screened, cost per 1,000 and cost per case found."""
    on, case = lambda t: F.col(p) >= t, F.col(y) == 1
    one = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(F.avg(case.cast("double")).alias("_c"), *[e for i, t in enumerate(thresholds) for e in (F.avg(on(t).cast("double")).alias(f"r{i}"), F.avg((on(t) & case).cast("double")).alias(f"h{i}"))])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"r{i}").alias("_r"), F.col(f"h{i}").alias("_h")) for i, t in enumerate(thresholds)])
    d = one.select(F.col("_c"), F.inline(rows))
    cost = 1000 * (F.col("_r") * cost_test + cost_screen + (F.col("_c") - F.col("_h")) * cost_missed)
    return d.select("threshold", (1000 * F.col("_r")).alias("referred_per_1000"), (1000 * F.col("_h")).alias("found_per_1000"), (1000 * (F.col("_c") - F.col("_h"))).alias("missed_per_1000"),
                    cost.alias("cost_per_1000"), F.when(F.col("_h") > 0, cost / (1000 * F.col("_h"))).alias("cost_per_found"))


def gray_zone(df: DataFrame, y: str, score: str, sensitivity: float = 0.9, specificity: float = 0.9) -> DataFrame:
    """The scores between the cut with that sensitivity and the cut with that specificity, and the share of rows inside."""
    c = score_counts(df, y, score)
    d = _from_top(c, []).join(F.broadcast(c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))))
    lo = F.coalesce(F.max(F.when(F.col("tp") >= (sensitivity - 1e-12) * F.col("P"), F.col("s"))), F.min("s"))
    hi = F.coalesce(F.min(F.when(F.col("N") - F.col("fp") >= (specificity - 1e-12) * F.col("N"), F.col("s"))), F.max("s"))
    b = d.agg(lo.alias("_a"), hi.alias("_b")).select(F.least("_a", "_b").alias("lo"), F.greatest("_a", "_b").alias("hi"))
    return c.join(F.broadcast(b)).groupBy("lo", "hi").agg(F.sum("rows").alias("n"), (F.sum(F.when(F.col("s").between(F.col("lo"), F.col("hi")), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("inside"))


def replicate_counts(counts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Bootstrap replicates 1 to ``n`` of a score histogram: rep, s, pos, neg and rows; rows of one score are drawn together, as many as a Poisson number of the count says.

    Rows of the source are never copied: a replicate has at most one row per distinct score.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), max(1, 200_000 // n)):
                part = b.iloc[start:start + max(1, 200_000 // n)]
                pos, neg = poisson(part["key"].to_numpy(), part["pos"].to_numpy(), n, seed), poisson(part["key"].to_numpy(), part["neg"].to_numpy(), n, seed + 7)
                row, rep = np.nonzero(pos + neg)
                yield pd.DataFrame({"rep": rep + 1, "s": part["s"].to_numpy()[row], "pos": pos[row, rep], "neg": neg[row, rep], "rows": pos[row, rep] + neg[row, rep]})
    return counts.select(F.xxhash64("s").alias("key"), "s", "pos", "neg").mapInPandas(run, "rep INT, s DOUBLE, pos DOUBLE, neg DOUBLE, rows DOUBLE")


def gray_zone_limits(df: DataFrame, y: str, score: str, sensitivity: float = 0.9, specificity: float = 0.9, n: int = 500, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """The bounds of `gray_zone` with percentile limits of each: lo, lo_low, lo_high, hi, hi_low, hi_high, and the replicates with both classes that they rest on.

    All replicates pass one cumulative count, keyed by replicate; a bound is the order statistic of the drawn histogram.
    """
    r = replicate_counts(score_counts(df, y, score), n, seed)
    d = _both(_from_top(r, ["rep"]), r.groupBy("rep").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).filter("P > 0 AND N > 0"), ["rep"])
    lo = F.coalesce(F.max(F.when(F.col("tp") >= (sensitivity - 1e-12) * F.col("P"), F.col("s"))), F.min("s"))
    hi = F.coalesce(F.min(F.when(F.col("N") - F.col("fp") >= (specificity - 1e-12) * F.col("N"), F.col("s"))), F.max("s"))
    per = d.groupBy("rep").agg(lo.alias("_a"), hi.alias("_b")).select(F.lit(1).alias("one"), F.least("_a", "_b").alias("lo"), F.greatest("_a", "_b").alias("hi"))
    low, high = (quantiles(per, ["one"], c, {f"{c}_low": alpha / 2, f"{c}_high": 1 - alpha / 2}) for c in ("lo", "hi"))
    point = gray_zone(df, y, score, sensitivity, specificity).select(F.lit(1).alias("one"), "lo", "hi")
    used = per.groupBy("one").agg(F.count("*").alias("replicates"))
    return point.join(low, "one").join(high, "one").join(used, "one").select("lo", "lo_low", "lo_high", "hi", "hi_low", "hi_high", "replicates")


def matched_triage(df: DataFrame, y: str, score: str, rater: str, group: str) -> DataFrame:
    """Missed cases of a yes/no rater and of a score per subgroup, at the score threshold that flags as many non-cases as the rater does (over-triage held equal).

    One row per subgroup with a case: n_cases, threshold, rater_missed, model_missed.  A rater that flags no non-case puts the
    threshold just above the highest score of one; a table without non-cases, at 1.
    """
    d = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull() & F.col(rater).isNotNull())
    case, on = F.col(y) == 1, F.col(rater) == 1
    wanted = d.agg(F.count_if(~case & on).alias("k"))
    falls = _from_top(score_counts(d, y, score), []).filter("neg > 0")
    cut_ = falls.join(F.broadcast(wanted)).agg(F.max(F.when(F.col("fp") >= F.col("k"), F.col("s"))).alias("t"), F.max("s").alias("top"), F.max("k").alias("k"))
    threshold = F.when(F.col("top").isNull(), 1.0).when(F.col("k") == 0, F.col("top") + 1e-9).otherwise(F.col("t"))
    rows = d.filter(case).join(F.broadcast(cut_.select(threshold.alias("threshold"))))
    missed = lambda c: F.avg((~c).cast("double"))
    return rows.groupBy(group).agg(F.count("*").alias("n_cases"), F.max("threshold").alias("threshold"), missed(on).alias("rater_missed"), missed(F.col(score) >= F.col("threshold")).alias("model_missed"))


def subgroup_metrics(df: DataFrame, y: str, p: str, group: str, threshold: float, min_n: int = 1) -> DataFrame:
    """n, prevalence, TPR, FPR, PPV, alert rate and AUROC per subgroup."""
    on = F.col(p) >= threshold
    pos = F.col(y) == 1
    g = df.groupBy(group).agg(F.avg(F.col(y).cast("double")).alias("prevalence"), F.avg(F.when(pos, on.cast("double"))).alias("tpr"), F.avg(F.when(~pos, on.cast("double"))).alias("fpr"),
                              F.avg(F.when(on, F.col(y).cast("double"))).alias("ppv"), F.avg(on.cast("double")).alias("alert_rate"))
    return g.join(auroc(df, y, p, [group]), group).filter(F.col("n") >= min_n)


def subgroup_gaps(table: DataFrame, group: str, metrics: Sequence[str], reference=None) -> DataFrame:
    """Largest minus smallest value of each metric over subgroups, and each group's distance from a reference."""
    spans = table.agg(*[(F.max(m) - F.min(m)).alias(f"{m}_gap") for m in metrics])
    out = table.join(F.broadcast(spans))
    if reference is not None:
        ref = table.filter(F.col(group) == reference).select(*[F.col(m).alias(f"_ref_{m}") for m in metrics])
        out = out.join(F.broadcast(ref))
        for m in metrics:
            out = out.withColumn(f"{m}_vs_ref", F.col(m) - F.col(f"_ref_{m}")).drop(f"_ref_{m}")
    return out


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), lo: str | None = None, hi: str | None = None, naive: str | None = None) -> DataFrame:
    e = F.col(yhat) - F.col(y)
    aggs = [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
            (1 - F.sum(e * e) / (F.var_pop(y) * F.count(e))).alias("r2"), F.corr(y, yhat).alias("pearson")]
    if lo and hi:
        aggs.append(F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"))
    if naive:
        n = F.col(naive) - F.col(y)
        aggs.append((1 - F.sqrt(F.avg(e * e)) / F.sqrt(F.avg(n * n))).alias("skill"))
    return df.groupBy(*by).agg(*aggs)


def label_shift_bbse(src: DataFrame, tgt: DataFrame, y: str, yhat: str, ridge: float = 1e-6) -> DataFrame:
    """Target / source label ratios: solve C w = mu from the joint counts of label and prediction (k x k)."""
    joint = src.groupBy(y, yhat).agg(F.count("*").alias("n")).select(F.col(y).cast("string").alias("a"), F.col(yhat).cast("string").alias("b"), "n", F.lit(0).alias("side"))
    mu = tgt.groupBy(yhat).agg(F.count("*").alias("n")).select(F.col(yhat).cast("string").alias("b"), "n", F.lit(1).alias("side"))
    table = joint.unionByName(mu, allowMissingColumns=True)       # at most k * k + k rows for k classes

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        s, t = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        labels = sorted(set(s["a"]))
        c = s.pivot_table(index="b", columns="a", values="n", aggfunc="sum").reindex(index=labels, columns=labels).fillna(0.0).to_numpy()
        m = t.set_index("b")["n"].reindex(labels).fillna(0.0).to_numpy()
        c, m = c / c.sum(), m / m.sum()
        w = np.linalg.solve(c.T @ c + ridge * np.eye(len(labels)), c.T @ m)
        return pd.DataFrame({"label": labels, "ratio": np.clip(w, 0, None)})

    return table.groupBy(F.lit(1).alias("_all")).applyInPandas(solve, "label STRING, ratio DOUBLE")


def weighted_metric(df: DataFrame, y: str, p: str, w: str | None, metric: str) -> DataFrame:
    if metric == "auroc":
        return auroc(df, y, p, [], w).select(F.col("auroc").alias("value"))
    weight = F.col(w) if w else F.lit(1.0)
    e = F.col(p) - F.col(y)
    return df.agg((F.sum(weight * e * e) / F.sum(weight)).alias("value"))


def gap_decomposition(src: DataFrame, tgt: DataFrame, y: str, p: str, w_x: str, w_y: str, metric: str = "brier") -> DataFrame:
    """Source-to-target metric gap split into covariate and label parts (mean of both orders) and the concept remainder."""
    d = src.withColumn("_wxy", F.col(w_x) * F.col(w_y))
    parts = {"s": weighted_metric(src, y, p, None, metric), "t": weighted_metric(tgt, y, p, None, metric), "x": weighted_metric(d, y, p, w_x, metric),
             "l": weighted_metric(d, y, p, w_y, metric), "xl": weighted_metric(d, y, p, "_wxy", metric)}
    one = None
    for k, v in parts.items():
        v = v.withColumnRenamed("value", k)
        one = v if one is None else one.join(F.broadcast(v))
    cov = ((F.col("x") - F.col("s")) + (F.col("xl") - F.col("l"))) / 2
    lab = ((F.col("l") - F.col("s")) + (F.col("xl") - F.col("x"))) / 2
    return one.select(F.col("s").alias("source"), F.col("t").alias("target"), (F.col("t") - F.col("s")).alias("gap"), cov.alias("covariate"), lab.alias("label"), (F.col("t") - F.col("xl")).alias("concept"))


def shapley_gap(values: DataFrame, terms: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """How much of a gap each correction closes, averaged over all orders in which corrections can be applied.

    ``values`` has one row per (by, subset): a boolean column per term says whether it is applied, ``value`` is the gap that
    remains.  Subsets meet their extension by one term on a bit mask; a missing subset leaves its orders out.
    """
    k = len(terms)
    mask = sum((F.when(F.col(t), 1 << i).otherwise(0) for i, t in enumerate(terms)), F.lit(0))
    v = values.select(*by, mask.alias("_m"), sum((F.col(t).cast("int") for t in terms), F.lit(0)).alias("_n"), F.col(value).cast("double").alias("_v"))
    steps = v.select(*by, "_n", F.col("_v").alias("_before"), F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.when(F.col("_m").bitwiseAND(1 << i) == 0, F.col("_m") + (1 << i)).alias("_to")) for i, t in enumerate(terms)]))).filter("_to IS NOT NULL")
    j = steps.join(v.select(*by, F.col("_m").alias("_to"), F.col("_v").alias("_after")), [*by, "_to"])
    orders = F.element_at(F.array(*[F.lit(math.factorial(n) * math.factorial(k - n - 1) / math.factorial(k)) for n in range(k)]), F.col("_n") + 1)
    closed = F.col("_before") - F.col("_after")
    g = j.groupBy(*by, "term").agg((F.sum(orders * closed) / F.sum(orders)).alias("closed_mean"), (F.sum(orders * closed * closed) / F.sum(orders)).alias("_q"))
    raw = v.filter("_m = 0").select(*by, F.col("_v").alias("_raw"))
    d = g.join(raw, list(by), "left") if by else g.join(F.broadcast(raw))
    return d.select(*by, "term", "closed_mean", F.sqrt(F.greatest(F.col("_q") - F.col("closed_mean") * F.col("closed_mean"), F.lit(0.0))).alias("closed_sd"), F.when(F.col("_raw") != 0, F.col("closed_mean") / F.col("_raw")).alias("share_of_raw"))


# --- resampling -----------------------------------------------------------------------------------

def poisson_weight(n: int, group: Sequence[str], seed: int) -> Column:
    """Reproducible Poisson(1) weight of a group in replicate ``rep``, by inverting a hash."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), *[F.col(g) for g in group]), F.lit(1 << 53)) / float(1 << 53)
    out, cum, p = F.lit(18), 0.0, math.exp(-1)
    steps = []
    for k in range(18):                                             # beyond 18 no hash of 53 bits is left
        cum += p
        steps.append((cum, k))
        p /= k + 1
    for c, k in reversed(steps):
        out = F.when(u < c, k).otherwise(out)
    return out.cast("double")


def cluster_bootstrap(sums: DataFrame, group: Sequence[str], stat: Column, parts: Sequence[str], n: int, seed: int = 0, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of a statistic of sums, whole groups resampled.

    ``sums`` holds additive parts; they are first summed per group, so a replicate costs one
    row per group.  ``stat`` is a column expression over the summed parts.  Replicate 0 is the
    plain estimate.
    """
    g = sums.groupBy(*by, *group).agg(*[F.sum(c).alias(c) for c in parts])
    r = g.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("_w", F.when(F.col("rep") == 0, 1.0).otherwise(poisson_weight(n, group, seed)))
    per = r.groupBy(*by, "rep").agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in parts]).select(*by, "rep", stat.alias("value"))
    est = per.filter("rep = 0").select(*by, F.col("value").alias("estimate"))
    q = quantiles(per.filter("rep > 0"), by, "value", {"low": alpha / 2, "high": 1 - alpha / 2})
    return est.join(q, list(by)) if by else est.join(F.broadcast(q))


def permutation_test(df: DataFrame, row_id: str, label: str, value: str, strata: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Difference of means between labels 1 and 0 against shuffles of the label inside strata; p = (1 + #>=) / (1 + n), two-sided.

    Labels are drawn over the counts of distinct values (`permuted_sums`); rows with a null label take no part.
    """
    d = df.filter(F.col(label).isNotNull())
    per = permuted_means(d, strata, label, value, n, seed)
    whole = d.agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(value).alias("_c"))
    rest = F.col("_c") - F.col("count")
    per = per.join(F.broadcast(whole)).select("rep", (F.col("sum") / F.when(F.col("count") > 0, F.col("count")) - (F.col("_s") - F.col("sum")) / F.when(rest > 0, rest)).alias("d"))
    seen = per.filter("rep = 0").select(F.col("d").alias("observed"))
    return per.filter("rep > 0").join(F.broadcast(seen)).groupBy("observed").agg(
        F.count("*").alias("n"), ((1 + F.sum((F.abs("d") >= F.abs("observed") - 1e-12).cast("int"))) / (1 + F.count("*"))).alias("p"))


def delong(df: DataFrame, row_id: str, y: str, a: str, b: str) -> DataFrame:
    """Difference of two AUROCs on the same rows with its variance from placement values."""
    d = df.select(row_id, F.col(y).alias("_y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    size = d.agg(F.sum("_y").cast("double").alias("_p"), F.sum(1 - F.col("_y")).cast("double").alias("_n"))
    for s in ("a", "b"):
        c = d.groupBy(F.col(s).alias("_s")).agg(F.sum("_y").cast("double").alias("_pos"), F.sum(1 - F.col("_y")).cast("double").alias("_neg"))
        c = scan(c, [], "_s", {"_bp": ("prev_sum", "_pos"), "_bn": ("prev_sum", "_neg")}).join(F.broadcast(size))
        up = (F.coalesce("_bn", F.lit(0.0)) + 0.5 * F.col("_neg")) / F.col("_n")
        down = 1 - (F.coalesce("_bp", F.lit(0.0)) + 0.5 * F.col("_pos")) / F.col("_p")
        d = d.join(c.select(F.col("_s").alias(s), up.alias(f"_u{s}"), down.alias(f"_d{s}")), s)
    v = F.when(F.col("_y") == 1, 1)
    pos = lambda e: F.when(F.col("_y") == 1, e)
    neg = lambda e: F.when(F.col("_y") == 0, e)
    du, dd = F.col("_ua") - F.col("_ub"), F.col("_da") - F.col("_db")
    g = d.agg(F.avg(pos(F.col("_ua"))).alias("auroc_a"), F.avg(pos(F.col("_ub"))).alias("auroc_b"),
              (F.var_samp(pos(du)) / F.count(v) + F.var_samp(neg(dd)) / F.count(neg(F.lit(1)))).alias("_v"))
    diff = F.col("auroc_a") - F.col("auroc_b")
    se = F.sqrt("_v")
    return g.select("auroc_a", "auroc_b", diff.alias("difference"), se.alias("se"), F.when(se > 0, two_sided_p(diff / se)).alias("p"))


# --- conformal ------------------------------------------------------------------------------------

def conformal_quantile(cal: DataFrame, score: str, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest calibration score per group, infinite when beyond n."""
    r = value_ranks(cal, by, score)
    n = r.groupBy(*by).agg(F.sum("n").alias("_t"))
    k = F.ceil((F.col("_t") + 1) * (1 - alpha) - 1e-9)
    hit = F.when((F.col("below") < k) & (k <= F.col("below") + F.col("n")), F.col(score).cast("double"))
    return _both(r, n, by).groupBy(*by).agg(F.max("_t").alias("n_cal"), F.coalesce(F.max(hit), F.lit(float("inf"))).alias("q"))


def weighted_conformal_quantile(cal: DataFrame, score: str, w: str, w_test: Sequence[float], alpha: float) -> DataFrame:
    """Per test weight: smallest score whose share of the weight, an infinite atom of the test weight included, reaches 1 - alpha."""
    c = cal.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(w).alias("w"))
    c = scan(c, [], "s", {"cum": ("sum", "w")}).join(F.broadcast(c.agg(F.sum("w").alias("_t"))))
    d = c.withColumn("w_test", F.explode(F.array(*[F.lit(float(x)) for x in w_test])))
    enough = F.col("cum") / (F.col("_t") + F.col("w_test")) >= 1 - alpha
    return d.groupBy("w_test").agg(F.coalesce(F.min(F.when(enough, F.col("s"))), F.lit(float("inf"))).alias("q"))


def coverage(test: DataFrame, hit: Column, width: Column, by: Sequence[str] = ()) -> DataFrame:
    return test.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("coverage"), F.avg(width).alias("mean_width"))


# --- shift ----------------------------------------------------------------------------------------

def psi(ref: DataFrame, cur: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Population stability index on unique reference quantile edges; outside values stay in the denominator; < 3 edges give 0."""
    e = quantiles(ref, [], col, {f"_e{i}": i / bins for i in range(bins + 1)}).select(F.array_distinct(F.array(*[f"_e{i}" for i in range(bins + 1)])).alias("_edges"))
    both = ref.select(F.col(col).cast("double").alias("x"), F.lit(0).alias("side")).union(cur.select(F.col(col).cast("double"), F.lit(1))).filter("x IS NOT NULL")
    size = both.agg(F.sum(1 - F.col("side")).cast("double").alias("_nr"), F.sum("side").cast("double").alias("_nc"))
    d = both.groupBy("x", "side").agg(F.count("*").alias("k")).join(F.broadcast(e))
    at = F.size(F.filter("_edges", lambda v: v <= F.col("x"))) - 1
    last = F.size("_edges") - 2
    b = F.when((F.col("x") >= F.element_at("_edges", 1)) & (F.col("x") <= F.element_at("_edges", -1)), F.least(at, last))
    frame = e.select(F.explode(F.sequence(F.lit(0), F.greatest(F.size("_edges") - 2, F.lit(0)))).alias("_b"), (F.size("_edges") < 3).alias("_flat"))
    g = d.withColumn("_b", b).filter("_b IS NOT NULL").groupBy("_b").agg(F.sum(F.when(F.col("side") == 0, F.col("k")).otherwise(0)).alias("r"), F.sum(F.when(F.col("side") == 1, F.col("k")).otherwise(0)).alias("c"))
    j = frame.join(g, "_b", "left").fillna(0, ["r", "c"]).join(F.broadcast(size))
    r, c = F.col("r") / F.col("_nr") + 1e-6, F.col("c") / F.col("_nc") + 1e-6
    return j.agg(F.when(F.first("_flat"), 0.0).otherwise(F.sum((c - r) * F.log(c / r))).alias("psi"))


def distribution_distance(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Kolmogorov-Smirnov, Wasserstein and energy distances from the two step functions on the union of values, and the missing share difference."""
    both = ref.select(F.col(col).cast("double").alias("x"), F.lit(0).alias("side")).union(cur.select(F.col(col).cast("double"), F.lit(1)))
    c = both.filter("x IS NOT NULL").groupBy("x").agg(F.sum(1 - F.col("side")).cast("double").alias("r"), F.sum("side").cast("double").alias("c"))
    t = c.agg(F.sum("r").alias("_tr"), F.sum("c").alias("_tc"))
    d = scan(c, [], "x", {"fr": ("sum", "r"), "fc": ("sum", "c"), "nx": ("lead", "x")}).join(F.broadcast(t))
    gap = F.abs(F.col("fr") / F.col("_tr") - F.col("fc") / F.col("_tc"))
    miss = both.agg((F.avg(F.when(F.col("side") == 1, F.col("x").isNull().cast("double"))) - F.avg(F.when(F.col("side") == 0, F.col("x").isNull().cast("double")))).alias("missing_diff"))
    return d.agg(F.max(gap).alias("ks"), F.sum(gap * (F.coalesce("nx", F.col("x")) - F.col("x"))).alias("wasserstein"),
                 F.sum(2 * gap * gap * (F.coalesce("nx", F.col("x")) - F.col("x"))).alias("energy")).join(F.broadcast(miss))


def mmd(df: DataFrame, row_id: str, vec: str, side: Column, dim: int, features: int = 256, seed: int = 0, gamma: float | None = None, n_perm: int = 0) -> DataFrame:
    """Unbiased squared MMD with an RBF kernel over all rows, by ``features`` random Fourier frequencies.

    The kernel becomes a product of cosine and sine features, so a task sends one vector of sums per replicate whatever
    its rows; the error of the approximation falls with the root of ``features``.  ``gamma`` defaults to one over the mean
    squared distance of two rows.  Replicates deal each row to a side by a hash of its identifier.  A side with fewer
    than two rows gives NULL; rows with a NULL vector or side are left out.
    """
    d = df.select(F.xxhash64(F.lit(seed), row_id).alias("_h"), F.col(vec).alias("_v"), side.cast("int").alias("_s")).filter("_v IS NOT NULL AND _s IS NOT NULL")
    spread = sum((F.var_samp(F.col("_v")[i].cast("double")) for i in range(dim)), F.lit(0.0))
    width = F.lit(float(gamma)) if gamma is not None else F.when(spread > 0, 0.5 / spread).otherwise(1.0)
    one = d.agg(F.count("*").alias("n"), F.avg("_s").alias("share"), width.alias("gamma"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.random.default_rng(seed).standard_normal((dim, features))
        salts = np.random.default_rng(seed + 1).integers(1, 1 << 63, n_perm, dtype=np.uint64)
        sums, sizes, whole = np.zeros((n_perm + 1, 2 * features)), np.zeros(n_perm + 1), np.zeros(2 * features)
        for b in batches:
            if not len(b):
                continue
            z = np.vstack(b["_v"].to_numpy()).astype(float) @ w * np.sqrt(2 * b["gamma"].iloc[0])
            f = np.hstack([np.cos(z), np.sin(z)]) / np.sqrt(features)
            x = (b["_h"].to_numpy().view(np.uint64)[None, :] ^ salts[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            dealt = (x >> np.uint64(11)) / float(1 << 53) < b["share"].iloc[0]
            on = np.vstack([b["_s"].to_numpy()[None, :] == 1, dealt]).astype(float)
            sums, sizes, whole = sums + on @ f, sizes + on.sum(1), whole + f.sum(0)
        yield pd.DataFrame({"rep": np.arange(-1, n_perm + 1), "m": np.r_[0.0, sizes], "v": [whole.tolist(), *sums.tolist()]})

    parts = d.join(F.broadcast(one)).mapInPandas(run, "rep INT, m DOUBLE, v ARRAY<DOUBLE>")
    g = parts.groupBy("rep").agg(F.sum("m").alias("m"), vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    r = g.filter("rep >= 0").join(F.broadcast(g.filter("rep = -1").select(F.col("v").alias("t")))).join(F.broadcast(one))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    r = r.withColumn("u", F.zip_with("t", "v", lambda x, y: x - y)).withColumn("k", F.col("n") - F.col("m"))
    m, k = F.col("m"), F.col("k")
    value = F.when((m > 1) & (k > 1), (dot("v", "v") - m) / (m * (m - 1)) + (dot("u", "u") - k) / (k * (k - 1)) - 2 * dot("v", "u") / (m * k))
    r = r.select("rep", "n", "gamma", value.alias("e"))
    seen = r.filter("rep = 0").select("n", "gamma", F.col("e").alias("mmd2"))
    high = r.join(F.broadcast(seen.select("mmd2"))).agg(F.sum(((F.col("rep") > 0) & (F.col("e") >= F.col("mmd2"))).cast("int")).alias("_k"))
    p = (1 + F.coalesce("_k", F.lit(0))) / F.lit(1.0 + n_perm) if n_perm else F.lit(None).cast("double")
    return seen.join(F.broadcast(high)).select("n", "gamma", "mmd2", F.when(F.col("mmd2").isNotNull(), p).alias("p"))


def centroid_distance(df: DataFrame, vec: str, side: Column, dim: int) -> DataFrame:
    """Cosine distance of the two sides' mean vectors; the means are ``dim`` columns of one aggregate row."""
    g = df.agg(*[F.avg(F.when(side == s, F.col(vec)[i].cast("double"))).alias(f"m{s}_{i}") for s in (0, 1) for i in range(dim)])
    dot = lambda a, b: sum((F.col(f"m{a}_{i}") * F.col(f"m{b}_{i}") for i in range(dim)), F.lit(0.0))
    return g.select((1 - dot(0, 1) / F.sqrt(dot(0, 0) * dot(1, 1))).alias("cosine_distance"), F.sqrt(dot(0, 0) + dot(1, 1) - 2 * dot(0, 1)).alias("mean_shift"))


def closest_record(train: DataFrame, synthetic: DataFrame, row_id: str, vec: str, dim: int) -> DataFrame:
    """Exact distance of each synthetic row to its nearest training row (of equally near ones the smallest id).

    Rows are packed into blocks of flat numbers; every training block meets every synthetic block once, a few pairs to a task, and only the
    block minimum per synthetic row leaves it.  Block pairs, not row pairs, are shuffled.  A product of matrices finds the rows that
    may be nearest, their differences tell which one is.
    """
    def blocks(df):
        held, n = packed(df, df.count(), F.xxhash64(row_id), r=F.struct(F.col(row_id).alias("i"), F.col(vec).alias("v")))
        return held.select("_b", F.transform("r", lambda r: r["i"]).alias("i"), F.flatten(F.transform("r", lambda r: r["v"])).alias("v")), n
    (s, ns), (t, nt) = blocks(synthetic), blocks(train)
    pairs = met(s.withColumnsRenamed({"i": "qi", "v": "qv"}), ns, t.withColumnsRenamed({"i": "ti", "v": "tv"}), nt)
    kind = synthetic.schema[row_id].dataType
    schema = T.StructType([T.StructField(row_id, kind), T.StructField("nearest", kind), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                x, y = (b.column(c)[at].values.to_numpy().astype(float).reshape(len(b.column(c - 1)[at]), dim) for c in (1, 3))
                qi, ti = b.column(0)[at].values, b.column(2)[at].values
                place = np.argsort(ti.to_numpy(zero_copy_only=False), kind="stable")
                y, ti = y[place], ti.take(pa.array(place))
                yy = (y ** 2).sum(1)
                top = yy.max(initial=0.0, where=np.isfinite(yy))
                for i in range(0, len(x), 256):
                    part = x[i:i + 256]
                    xx = (part ** 2).sum(1)
                    d2 = xx[:, None] + yy - 2 * part @ y.T
                    d2[np.isnan(d2)] = np.inf
                    # what rounding may have put behind the nearest row
                    row, col = np.nonzero(d2 <= (d2.min(1) + 1e-12 * (xx + top))[:, None])
                    best, low = np.full(len(part), -1), np.full(len(part), np.inf)
                    for c in range(0, len(row), 65_536):
                        r, k = row[c:c + 65_536], col[c:c + 65_536]
                        exact = np.sqrt(((part[r] - y[k]) ** 2).sum(1))
                        order = np.lexsort((k, exact, r))
                        first = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
                        better = first[exact[first] < low[r[first]]]
                        low[r[better]], best[r[better]] = exact[better], k[better]
                    # without a distance (not a number) any row stands for the nearest, behind all others
                    low[best < 0], best[best < 0] = np.nan, 0
                    yield pa.RecordBatch.from_arrays([qi.slice(i, len(part)), ti.take(pa.array(best)), pa.array(low)], names=[row_id, "nearest", "distance"])

    near = pairs.select("qi", "qv", "ti", "tv").mapInArrow(run, schema)
    return near.groupBy(row_id).agg(F.min(F.struct("distance", "nearest")).alias("_m")).select(row_id, "_m.nearest", "_m.distance")


def standardise(df: DataFrame, reference: DataFrame, vec: str, dim: int) -> DataFrame:
    """``vec`` by the reference rows' mean and population SD of each dimension (constant dimensions are only centred)."""
    x = lambda i: F.col(vec)[i].cast("double")
    sd = lambda i: F.when(F.stddev_pop(x(i)) > 0, F.stddev_pop(x(i))).otherwise(1.0)
    m = reference.agg(F.array(*[F.avg(x(i)) for i in range(dim)]).alias("_m"), F.array(*[sd(i) for i in range(dim)]).alias("_d"))
    centred = F.zip_with(F.zip_with(vec, "_m", lambda a, b: a.cast("double") - b), "_d", lambda a, b: a / b)
    return df.join(F.broadcast(m)).withColumn(vec, centred).drop("_m", "_d")


def closest_record_report(train: DataFrame, others: dict[str, DataFrame], row_id: str, vec: str, dim: int) -> DataFrame:
    """Rows, 5 % point and median of the distance to the closest training row, for each named table (synthetic, holdout).

    Distances are Euclidean after standardising by the training rows; a synthetic table that lies nearer than the
    holdout has learnt training rows by heart.
    """
    fixed, near = standardise(train, train, vec, dim), None
    for name, table in others.items():
        one = closest_record(fixed, standardise(table, train, vec, dim), row_id, vec, dim).select(F.lit(name).alias("side"), "distance")
        near = one if near is None else near.unionByName(one)
    return quantiles(cut(near), ["side"], "distance", {"p5": 0.05, "median": 0.5})


# --- event scoring ---------------------------------------------------------------------------------

def _overlaps(ref: DataFrame, hyp: DataFrame, key: Sequence[str], width: float) -> DataFrame:
    """Overlapping (reference, hypothesis) events of a record through shared time bins, each pair once."""
    def binned(df, s, e, pre):
        lo, hi = F.floor(F.col(s) / width).cast("bigint"), F.floor(F.col(e) / width).cast("bigint")
        return df.withColumn(f"_{pre}lo", lo).withColumn("_bin", F.explode(F.sequence(lo, hi)))
    j = binned(ref, "r_s", "r_e", "r").join(binned(hyp, "h_s", "h_e", "h"), [*key, "_bin"])
    j = j.filter((F.col("r_s") < F.col("h_e")) & (F.col("h_s") < F.col("r_e")) & (F.col("_bin") == F.greatest("_rlo", "_hlo")))
    return j.withColumn("ov", F.least("r_e", "h_e") - F.greatest("r_s", "h_s"))


def event_scores(ref: DataFrame, hyp: DataFrame, key: Sequence[str], start: str, end: str, method: str, width: float,
                 before: float = 30.0, after: float = 60.0, merge_gap: float = 90.0, max_len: float = 300.0) -> DataFrame:
    """tp, fp, fn per record: ``overlap`` (any overlap), ``time`` (credit by covered time) or ``tolerance`` (merged, split, extended windows)."""
    if method == "tolerance":
        ref = split_events(merge_events(ref, key, start, end, merge_gap), start, end, max_len)
        hyp = split_events(merge_events(hyp, key, start, end, merge_gap), start, end, max_len)
    r = ref.select(*key, F.col(start).alias("r_s"), F.col(end).alias("r_e")).distinct()
    h = hyp.select(*key, F.col(start).alias("h_s"), F.col(end).alias("h_e")).distinct()
    if method == "tolerance":
        r = r.withColumn("r_s", F.greatest(F.col("r_s") - before, F.lit(0.0))).withColumn("r_e", F.col("r_e") + after)
    o = _overlaps(r, h, key, width)
    rs = r.join(o.groupBy(*key, "r_s", "r_e").agg(F.sum("ov").alias("inside"), F.sum(F.col("h_e") - F.col("h_s") - F.col("ov")).alias("outside")), [*key, "r_s", "r_e"], "left")
    length = F.col("r_e") - F.col("r_s")
    credit = F.least(F.coalesce("inside", F.lit(0.0)) / length, F.lit(1.0)) if method == "time" else F.col("inside").isNotNull().cast("double")
    extra = F.coalesce("outside", F.lit(0.0)) / length if method == "time" else F.lit(0.0)
    a = rs.groupBy(*key).agg(F.sum(credit).alias("tp"), F.sum(1 - credit).alias("fn"), F.sum(extra).alias("_x"))
    loose = h.join(o.select(*key, "h_s", "h_e").distinct(), [*key, "h_s", "h_e"], "left_anti").groupBy(*key).agg(F.count("*").cast("double").alias("_f"))
    d = a.join(loose, list(key), "full").fillna(0.0)
    return d.select(*key, "tp", (F.col("_x") + F.col("_f")).alias("fp"), "fn")


def match_events(ref: DataFrame, hyp: DataFrame, key: Sequence[str], row_id: str, at: str, tolerance: float) -> DataFrame:
    """One-to-one matches of reference and detected times within a tolerance, closest first; tp, fp and fn per record."""
    both = (ref.select(*key, F.concat(F.lit("r"), F.col(row_id).cast("string")).alias("_id"), F.lit(1).alias("_arm"), F.col(at).cast("double").alias("_x"))
            .unionByName(hyp.select(*key, F.concat(F.lit("h"), F.col(row_id).cast("string")).alias("_id"), F.lit(0).alias("_arm"), F.col(at).cast("double").alias("_x"))))
    hit = closest_pairs(both, "_id", key, tolerance).groupBy(*key).agg(F.count("*").alias("tp"))
    n = both.groupBy(*key).agg(F.sum("_arm").alias("_r"), F.sum(1 - F.col("_arm")).alias("_h")).join(hit, list(key), "left").fillna(0, ["tp"])
    return n.select(*key, "tp", (F.col("_h") - F.col("tp")).alias("fp"), (F.col("_r") - F.col("tp")).alias("fn"))


def pooled_scores(scores: DataFrame, hours: float) -> DataFrame:
    """Sensitivity, precision, F1 and false alarms per 24 h over all records of ``hours`` each."""
    g = scores.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count("*").alias("n"))
    return g.select("tp", "fp", "fn", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("sensitivity"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"), (24 * F.col("fp") / (F.col("n") * hours)).alias("fp_per_24h"))


def alarm_scores(alarms: DataFrame, events: DataFrame, key: Sequence[str], at: str, onset: str, horizon_gap: float, occurrence: float, width: float) -> DataFrame:
    """An alarm is right if an event starts in [alarm + gap, alarm + gap + occurrence]; an event is caught if an alarm is right for it."""
    a = alarms.select(*key, F.col(at).alias("_a")).withColumn("_lo", F.col("_a") + horizon_gap).withColumn("_hi", F.col("_a") + horizon_gap + occurrence)
    hit = range_pairs(a, events.select(*key, F.col(onset).alias("_e")), key, "_lo", "_hi", "_e", width)
    good = hit.select(*key, "_a").distinct().groupBy(*key).agg(F.count("*").alias("true_alarms"))
    caught = hit.select(*key, "_e").distinct().groupBy(*key).agg(F.count("*").alias("caught"))
    n = alarms.groupBy(*key).agg(F.count("*").alias("n_alarms"))
    m = events.select(*key, onset).distinct().groupBy(*key).agg(F.count("*").alias("n_events"))
    return n.join(m, list(key), "full").join(good, list(key), "left").join(caught, list(key), "left").fillna(0)


# --- clinical grading ------------------------------------------------------------------------------

def clarke_zone(ref: Column, est: Column) -> Column:
    """Error-grid zone of a glucose pair in mg/dL."""
    a = ((ref <= 70) & (est <= 70)) | (F.abs(est - ref) <= 0.2 * ref)
    e = ((ref <= 70) & (est >= 180)) | ((ref >= 180) & (est <= 70))
    c = ((ref >= 70) & (ref <= 290) & (est >= ref + 110)) | ((ref >= 130) & (ref <= 180) & (est <= 7 / 5 * ref - 182))
    d = ((ref >= 240) & (est >= 70) & (est <= 180)) | ((ref <= 175 / 3) & (est >= 70) & (est <= 180)) | ((ref >= 175 / 3) & (ref <= 70) & (est >= 6 / 5 * ref))
    return F.when(a, "A").when(e, "E").when(c, "C").when(d, "D").otherwise("B")


def bhs_grade(df: DataFrame, ref: str, est: str, by: Sequence[str] = ()) -> DataFrame:
    """Shares of errors within 5, 10 and 15 with the letter grade, and the mean / SD criterion (|mean| <= 5, SD <= 8)."""
    e = F.col(est) - F.col(ref)
    g = df.groupBy(*by).agg(F.count(e).alias("n"), *[(100 * F.avg((F.abs(e) <= k).cast("double"))).alias(f"within_{k}") for k in (5, 10, 15)], F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("sd_error"))
    # Required percentages within 5, 10 and 15 for grades A, B and C.
    limits = [("A", 60, 85, 95), ("B", 50, 75, 90), ("C", 40, 65, 85)]
    letter = F.lit("D")
    for name, a, b, c in reversed(limits):
        letter = F.when((F.col("within_5") >= a) & (F.col("within_10") >= b) & (F.col("within_15") >= c), name).otherwise(letter)
    return g.withColumn("grade", letter).withColumn("aami_pass", (F.abs("mean_error") <= 5) & (F.col("sd_error") <= 8))


def ieee_grade(df: DataFrame, ref: str, est: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute difference and its letter."""
    # Upper limits of the mean absolute difference for grades A, B and C.
    a, b, c = 5, 6, 7
    g = df.groupBy(*by).agg(F.count(F.col(est) - F.col(ref)).alias("n"), F.avg(F.abs(F.col(est) - F.col(ref))).alias("mad"))
    return g.withColumn("grade", F.when(F.col("mad") <= a, "A").when(F.col("mad") <= b, "B").when(F.col("mad") <= c, "C").when(F.col("mad").isNotNull(), "D"))


def alarm_cost(df: DataFrame, ref: str, est: str, low: float, cost: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Low-value alarm sensitivity and specificity, and the mean cost of zones from a table."""
    r, p = F.col(ref) < low, F.col(est) < low
    table = F.create_map(*[F.lit(x) for kv in cost.items() for x in (kv[0], float(kv[1]))])
    return df.groupBy(*by).agg(F.avg(F.when(r, p.cast("double"))).alias("sensitivity"), F.avg(F.when(~r, (~p).cast("double"))).alias("specificity"),
                               F.avg(table[clarke_zone(F.col(ref), F.col(est))]).alias("mean_cost"))


def triage_curve(df: DataFrame, score: str, flag: str, fractions: Sequence[float], row_id: str) -> DataFrame:
    """Recall of flagged rows when the top fraction by score is reviewed (ceil(n * fraction) rows, ties by id)."""
    d = scan(df.select(row_id, F.col(flag).cast("int").alias("_f"), (-F.col(score)).alias("_neg")), [], "_neg", {"_rk": ("row_number", None)}, None, [row_id])
    t = d.agg(F.count("*").alias("_n"), F.sum("_f").alias("_p"))
    j = d.join(F.broadcast(t))
    one = j.agg(F.first("_p").alias("_p"), F.first("_n").alias("_n"), *[F.sum(F.when(F.col("_rk") <= F.ceil(F.col("_n") * f - 1e-9), F.col("_f")).otherwise(0)).alias(f"h{i}") for i, f in enumerate(fractions)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.ceil(F.col("_n") * f - 1e-9).alias("reviewed"), (F.col(f"h{i}") / F.col("_p")).alias("recall")) for i, f in enumerate(fractions)])))


def deferral_curve(df: DataFrame, y: str, p: str, uncertainty: str, coverages: Sequence[float], row_id: str) -> DataFrame:
    """Accuracy, Brier score, AUROC and mean uncertainty of the most certain rows, per share of rows that are not deferred.

    Rows are counted per (first coverage that holds them, label, score); only those counts are copied to the wider coverages.
    """
    levels = sorted(coverages)
    ok = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull() & F.col(uncertainty).isNotNull()).select(row_id, F.col(y).cast("int").alias("_y"), F.col(p).cast("double").alias("_p"), F.col(uncertainty).cast("double").alias("_u"))
    d = scan(ok, [], "_u", {"_rk": ("row_number", None)}, None, [row_id]).join(F.broadcast(ok.agg(F.count("*").alias("_n"))))
    kept = lambda c: F.greatest(F.rint(F.col("_n") * c), F.lit(1.0))
    level = F.lit(None).cast("int")
    for i in range(len(levels) - 1, -1, -1):
        level = F.when(F.col("_rk") <= kept(levels[i]), i).otherwise(level)
    c = d.groupBy(level.alias("_l"), "_y", "_p").agg(F.count("*").alias("_k"), F.sum("_u").alias("_su")).filter("_l IS NOT NULL")
    c = c.withColumn("coverage", F.explode(F.slice(F.array(*[F.lit(float(x)) for x in levels]), F.col("_l") + 1, F.lit(len(levels)))))
    k, e = F.col("_k"), F.col("_p") - F.col("_y")
    g = c.groupBy("coverage").agg(F.sum("_k").alias("n_kept"), (F.sum(k * ((F.col("_p") >= 0.5).cast("int") == F.col("_y")).cast("int")) / F.sum("_k")).alias("accuracy"), (F.sum(k * e * e) / F.sum("_k")).alias("brier"), (F.sum("_su") / F.sum("_k")).alias("mean_uncertainty"))
    return g.join(auroc(c, "_y", "_p", ["coverage"], "_k").select("coverage", "auroc"), "coverage")


def exclusion_elasticity(df: DataFrame, value: str, thresholds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Share of rows above each threshold per group, its slope on the logarithm of the threshold, and its range."""
    logs = np.log(np.asarray(thresholds, float))
    logs = logs - logs.mean()
    total = float(logs @ logs)
    g = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *[F.avg((F.col(value) > t).cast("double")).alias(f"excluded_{i}") for i, t in enumerate(thresholds)])
    shares = [F.col(f"excluded_{i}") for i in range(len(thresholds))]
    slope = sum((float(w) / total * c for w, c in zip(logs, shares)), F.lit(0.0)) if total > 0 else F.lit(None).cast("double")
    return g.withColumn("elasticity", slope).withColumn("range", F.array_max(F.array(*shares)) - F.array_min(F.array(*shares)))


def leaderboard(results: DataFrame, model: str, cell: str, value: str) -> DataFrame:
    """One row per model: mean over cells, worst cell, gap between best and worst cell, and rank by mean."""
    g = results.groupBy(model).agg(F.count("*").alias("n_cells"), F.avg(value).alias("mean"), F.min(value).alias("worst"), (F.max(value) - F.min(value)).alias("gap"))
    d = scan(g.withColumn("_neg", -F.col("mean")), [], "_neg", {"rank": ("row_number", None)}, None, [model])
    return d.drop("_neg")


def axis_summary(results: DataFrame, axes: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean value of the result rows tagged with an axis and of those without, per group; ``axes`` is an array of tags."""
    r = results.filter(F.col(value).isNotNull())
    tagged = r.select(*by, F.explode(F.array_distinct(axes)).alias("axis"), value).groupBy(*by, "axis").agg(F.count("*").alias("n_with"), F.sum(value).alias("_s"))
    d = _both(tagged, r.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(value).alias("_t")), by)
    rest = F.col("_n") - F.col("n_with")
    return d.select(*by, "axis", "n_with", rest.alias("n_without"), (F.col("_s") / F.col("n_with")).alias("mean_with"), F.when(rest > 0, (F.col("_t") - F.col("_s")) / rest).alias("mean_without"))


def shift_loss_correlation(results: DataFrame, diagnostic: str, loss: str, stratum: str) -> DataFrame:
    """Spearman correlation of a shift diagnostic with a loss, pooled and per stratum; NULL below three cells or without spread."""
    d = results.filter(F.col(diagnostic).isNotNull() & F.col(loss).isNotNull()).select(F.col(stratum).cast("string").alias("stratum"), F.col(diagnostic).cast("double").alias("_a"), F.col(loss).cast("double").alias("_b"))
    d = d.unionByName(d.withColumn("stratum", F.lit("pooled")))
    for c in ("_a", "_b"):
        d = d.join(value_ranks(d, ["stratum"], c).select("stratum", c, F.col("rank").alias(f"{c}r")), ["stratum", c])
    g = d.groupBy("stratum").agg(F.count("*").alias("n_cells"), F.when((F.count("*") >= 3) & (F.stddev_pop("_ar") > 0) & (F.stddev_pop("_br") > 0), F.corr("_ar", "_br")).alias("spearman_rho"))
    t = F.col("spearman_rho") * F.sqrt((F.col("n_cells") - 2) / F.greatest(1 - F.col("spearman_rho") * F.col("spearman_rho"), F.lit(1e-300)))
    return g.withColumn("p", t_p(t, (F.col("n_cells") - 2).cast("double")))
