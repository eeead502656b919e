"""Grouped summaries, agreement, effects, composition and rank statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import Z975, gamma_ppf, gammainc, t_p, t_ppf, two_sided_p
from ..plans.ordered import SLICE, add_slices, ordered_pairs, quantiles, scan, value_ranks
from .permutations import permuted_sums


def adjust_pvalues(df: DataFrame, p: str, row_id: Sequence[str], group: Sequence[str] = (), method: str = "bh", alpha: float | None = None) -> DataFrame:
    """Add ``p_adjusted`` (Benjamini-Hochberg or Holm) inside each group; NULL p values stay NULL and are not counted.

    Equal p values have equal results, so the work is on distinct values with their counts; a NULL group is a group.
    ``row_id`` names the rows and plays no part in the result.
    """
    known = df.filter(F.col(p).isNotNull())
    by = [f"_g{i}" for i in range(len(group))]
    counts = known.groupBy(*[F.col(g).alias(b) for g, b in zip(group, by, strict=True)], F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    n = counts.groupBy(*[F.col(b).alias(f"_n{b}") for b in by]).agg(F.sum("_k").alias("_n"))
    d = scan(add_slices(counts, "_p"), by, "_p", {"_cum": ("sum", "_k")}, keep_slice=True)
    d = d.join(n, [F.col(b).eqNullSafe(F.col(f"_n{b}")) for b in by]) if by else d.join(F.broadcast(n))
    if method == "bh":
        d = d.withColumn("_v", F.col("_p") * F.col("_n") / F.col("_cum")).withColumn("_neg", -F.col("_p")).withColumn(SLICE, -F.col(SLICE))
        d = scan(d, by, "_neg", {"_q": ("min", "_v")})
    else:
        d = scan(d.withColumn("_v", F.col("_p") * (F.col("_n") - F.col("_cum") + F.col("_k"))), by, "_p", {"_q": ("max", "_v")})
    on = [F.col(g).eqNullSafe(F.col(b)) for g, b in zip(group, by, strict=True)] + [F.col(p) == F.col("_p")]
    d = known.join(d.select(*by, "_p", "_q"), on)
    done = d.select(*df.columns, F.least("_q", F.lit(1.0)).alias("p_adjusted"))
    out = done.unionByName(df.filter(F.col(p).isNull()).withColumn("p_adjusted", F.lit(None).cast("double")))
    return out if alpha is None else out.withColumn("significant", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False)))


@F.pandas_udf(T.DoubleType())
def _chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(1 - gammainc(df.to_numpy(float) / 2, x.to_numpy(float) / 2))


def combine_pvalues(df: DataFrame, p: str, group: Sequence[str]) -> DataFrame:
    """Fisher and Cauchy combinations per group."""
    g = df.filter(F.col(p).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("k"), (-2 * F.sum(F.log(F.greatest(F.col(p), F.lit(1e-300))))).alias("_x"), F.avg(F.tan((0.5 - F.col(p)) * math.pi)).alias("_t"))
    return g.select(*group, "k", _chi2_upper("_x", (2 * F.col("k")).cast("double")).alias("fisher"), (0.5 - F.atan("_t") / math.pi).alias("cauchy"))


def wilson(k: Column, n: Column, z: float = Z975) -> tuple[Column, Column]:
    """Score interval of k / n, exactly 0 and 1 at the ends."""
    p = k / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    return (F.when(k == 0, 0.0).otherwise(F.greatest(centre - half, F.lit(0.0))), F.when(k == n, 1.0).otherwise(F.least(centre + half, F.lit(1.0))))


def proportion_table(df: DataFrame, group: Sequence[str], flag: Column, reference: Mapping | None = None, per: float = 1.0, min_n: int = 1) -> DataFrame:
    """k, n, rate and Wilson limits per group; a risk ratio against a reference group if named."""
    g = df.groupBy(*group).agg(F.sum(F.when(flag, 1).otherwise(0)).alias("k"), F.count("*").alias("n")).filter(F.col("n") >= min_n)
    lo, hi = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    out = g.select(*group, "k", "n", (per * F.col("k") / F.col("n")).alias("rate"), (per * lo).alias("low"), (per * hi).alias("high"))
    if reference is None:
        return out
    ref = out
    for c, v in reference.items():
        ref = ref.filter(F.col(c) == v)
    ref = ref.select(F.col("rate").alias("_ref")).limit(1)
    return out.join(F.broadcast(ref)).withColumn("risk_ratio", F.when(F.col("_ref") > 0, F.col("rate") / F.col("_ref"))).drop("_ref")


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def _poisson_limits(n: pd.Series) -> pd.DataFrame:
    n = n.to_numpy(float)
    lo = np.where(n > 0, gamma_ppf(0.025, np.maximum(n, 1e-9)), 0.0)
    return pd.DataFrame({"lo": lo, "hi": gamma_ppf(0.975, n + 1)})


def exposure_rates(counts: DataFrame, exposure: DataFrame, keys: Sequence[str], n: str, e: str, per: float = 10_000.0, exact: bool = False) -> DataFrame:
    """Events per ``per`` exposed, with exact Poisson limits if asked (computed on the grouped rows)."""
    d = counts.join(exposure, list(keys)).withColumn("rate", per * F.col(n) / F.col(e))
    if not exact:
        return d
    d = d.withColumn("_l", _poisson_limits(F.col(n).cast("double")))
    return d.withColumn("rate_lo", per * F.col("_l.lo") / F.col(e)).withColumn("rate_hi", per * F.col("_l.hi") / F.col(e)).drop("_l")


def rate_ratio(rates: DataFrame, keys: Sequence[str], level: str, top: str, bottom: str, n: str, e: str) -> DataFrame:
    """Ratio of two levels' rates with log-normal limits, next to the crude count ratio."""
    def side(v, s):
        return rates.filter(F.col(level) == v).select(*keys, F.col(n).cast("double").alias(f"n_{s}"), F.col(e).cast("double").alias(f"e_{s}"))
    d = side(top, "a").join(side(bottom, "b"), list(keys))
    ratio = (F.col("n_a") / F.col("e_a")) / (F.col("n_b") / F.col("e_b"))
    se = F.sqrt(1 / F.greatest(F.col("n_a"), F.lit(0.5)) + 1 / F.greatest(F.col("n_b"), F.lit(0.5)))
    return d.select(*keys, (F.col("n_a") / F.col("n_b")).alias("crude_ratio"), (F.col("e_a") / F.col("e_b")).alias("exposure_ratio"), ratio.alias("rate_ratio"),
                    F.exp(F.log(ratio) - 1.96 * se).alias("ratio_lo"), F.exp(F.log(ratio) + 1.96 * se).alias("ratio_hi"))


def standardised_rate(rates: DataFrame, keys: Sequence[str], stratum: str, n: str, e: str, standard: Mapping[str, float], per: float = 10_000.0) -> DataFrame:
    """Direct standardisation: stratum rates weighted by a standard population."""
    total = sum(standard.values())
    weight = F.create_map(*[F.lit(x) for k, v in standard.items() for x in (k, v / total)])[F.col(stratum)]
    return rates.groupBy(*keys).agg((per * F.sum(F.col(n) / F.col(e) * weight)).alias("standardised"), (per * F.sum(n) / F.sum(e)).alias("crude"))


def weighted_persons(events: DataFrame, persons: DataFrame, key: str, weight: str, by: Sequence[str]) -> DataFrame:
    """Sum of survey weights of the distinct persons with an event, by stratum."""
    d = persons.join(events.select(key).distinct(), key, "left_semi")
    return d.groupBy(*by).agg(F.count("*").alias("n_persons"), F.sum(weight).alias("weighted"))


def profile_divergence(items: DataFrame, group: str, a: str, b: str, item: str, top_k: int) -> DataFrame:
    """Jensen-Shannon divergence (bits) of two groups' item shares over the ``top_k`` pooled items (ties by name)."""
    d = items.filter(F.col(group).isin(a, b))
    n = d.groupBy(item).agg(F.count("*").alias("_n"), F.sum((F.col(group) == a).cast("int")).alias("_a"), F.sum((F.col(group) == b).cast("int")).alias("_b"))
    top = n.orderBy(F.desc("_n"), item).limit(top_k)
    total = top.agg(F.sum("_a").cast("double").alias("_ta"), F.sum("_b").cast("double").alias("_tb"))
    s = top.join(F.broadcast(total)).select((F.col("_a") / F.col("_ta")).alias("p"), (F.col("_b") / F.col("_tb")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    def kl(x):
        return F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return s.agg(F.count("*").alias("n_items"), (0.5 * F.sum(kl("p")) + 0.5 * F.sum(kl("q"))).alias("divergence"))


def profile_permutation(reports: DataFrame, report: str, group: str, a: str, b: str, item: str, top_k: int, n: int, seed: int = 0) -> DataFrame:
    """Observed divergence and p: the share of report-level relabelings with at least that divergence.

    The vocabulary is fixed by the pooled reports.  A replicate draws as many reports as group ``a`` has, without replacement, so both
    groups keep their sizes (`permuted_sums`: reports with the same items are one cell, items a few sums).
    """
    d = reports.filter(F.col(group).isin(a, b))
    vocab = d.groupBy(item).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), item).limit(top_k)
    # numbers 0 to top_k - 1: one row for each item kept
    places = vocab.agg(F.array_sort(F.collect_list(item)).alias("_i")).select(F.posexplode("_i").alias("_at", item))
    who = d.groupBy(report).agg(F.max((F.col(group) == a).cast("int")).alias("k"))
    held = d.join(F.broadcast(places), item).groupBy(report, "_at").agg(F.count("*").alias("_c"))
    held = held.groupBy(report).agg(F.array_sort(F.collect_list(F.struct("_at", "_c"))).alias("held"))
    cells = who.join(held, report, "left").groupBy("held").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    cells = cells.select("n", "k", F.xxhash64("held").alias("key"), F.transform("held", lambda x: x["_at"]).alias("at"), F.transform("held", lambda x: x["_c"]).alias("c"))

    def prepare(rows: pd.DataFrame):
        filled = [x if x is not None else [] for x in rows["at"]]
        at = np.concatenate([np.asarray(x, np.int64) for x in filled]) if len(filled) else np.zeros(0, np.int64)
        c = np.concatenate([np.asarray(x if x is not None else [], float) for x in rows["c"]])
        row = np.repeat(np.arange(len(rows)), [len(x) for x in filled])
        return lambda x: np.bincount(at, c * x[row], top_k)
    sums = permuted_sums(cells, [], prepare, n, seed)
    all_ = d.join(F.broadcast(places), item).groupBy("_at").agg(F.count("*").alias("_n"))
    reps = all_.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n))))          # top_k rows each
    c = reps.join(sums.withColumnRenamed("place", "_at"), ["rep", "_at"], "left").select(F.col("rep").alias("_rep"), F.coalesce("v", F.lit(0.0)).alias("_p"), (F.col("_n") - F.coalesce("v", F.lit(0.0))).alias("_q"))
    t = c.groupBy("_rep").agg(F.sum("_p").alias("_tp"), F.sum("_q").alias("_tq"))
    s = c.join(F.broadcast(t), "_rep").select("_rep", (F.col("_p") / F.col("_tp")).alias("p"), (F.col("_q") / F.col("_tq")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    js = s.groupBy("_rep").agg((0.5 * F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2(F.col("p") / m)).otherwise(0.0))
                                + 0.5 * F.sum(F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / m)).otherwise(0.0))).alias("js"))
    seen = js.filter("_rep = 0").select(F.col("js").alias("divergence"))
    return js.filter("_rep > 0").join(F.broadcast(seen)).groupBy("divergence").agg(((1 + F.sum((F.col("js") >= F.col("divergence") - 1e-12).cast("int"))) / (1 + F.count("*"))).alias("p"))


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, width: float | None = None) -> DataFrame:
    """n, mean, missing share and the 10/25/50/75/90% points of a column per group."""
    q = quantiles(df, by, value, {"p10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9}, width)
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg(F.col(value).isNull().cast("double")).alias("missing_share"))
    return base.join(q, list(by), "left").withColumn("iqr", F.col("q75") - F.col("q25"))


def capture_recapture(df: DataFrame, by: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Two-detector estimates of the number of positives per group."""
    g = df.groupBy(*by).agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for c, n in ((a, "n1"), (b, "n2"), (a & b, "m"))])
    x, y, m = (F.col(c).cast("double") for c in ("n1", "n2", "m"))
    var = (x + 1) * (y + 1) * (x - m) * (y - m) / ((m + 1) * (m + 1) * (m + 2))
    return g.select(*by, "n1", "n2", "m", ((x + 1) * (y + 1) / (m + 1) - 1).alias("chapman"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("chapman_se"),
                    F.when(m > 0, x * y / m).alias("lincoln"), F.when(m > 0, F.sqrt(x * y * (x - m) * (y - m) / (m * m * m))).alias("lincoln_se"))


def confusion(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, kappa and PABAK of two labelings per group; everything follows from the confusion counts."""
    c = confusion(df, a, b, by)
    pa = c.groupBy(*by, F.col(a).alias("_k")).agg(F.sum("n").alias("_na"))
    pb = c.groupBy(*by, F.col(b).alias("_k")).agg(F.sum("n").alias("_nb"))
    both = pa.join(pb, [*by, "_k"], "full").fillna(0, ["_na", "_nb"])
    pe = both.groupBy(*by).agg(F.sum(F.col("_na") * F.col("_nb")).alias("_pe"), F.count("*").alias("_c"))
    g = c.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("_ok"))
    d = g.join(pe, list(by)) if by else g.join(F.broadcast(pe))
    po, e, k = F.col("_ok") / F.col("n"), F.col("_pe") / (F.col("n") * F.col("n")), F.col("_c")
    return d.select(*by, "n", po.alias("accuracy"), F.when(e < 1, (po - e) / (1 - e)).alias("kappa"), F.when(k > 1, (k * po - 1) / (k - 1)).alias("pabak"))


def class_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Recall, precision, F1 and Jaccard per class."""
    c = confusion(df, truth, guess)
    row = c.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("hit"))
    col = c.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("called"))
    d = row.join(col, "label", "full").fillna(0, ["support", "hit", "called"])
    s, h, k = F.col("support"), F.col("hit"), F.col("called")
    return d.select("label", "support", F.when(s > 0, h / s).alias("recall"), F.when(k > 0, h / k).alias("precision"),
                    F.when(s + k > 0, 2 * h / (s + k)).alias("f1"), F.when(s + k - h > 0, h / (s + k - h)).alias("jaccard"))


def set_overlap(df: DataFrame, set_id: str, member: str) -> DataFrame:
    """Intersection, union and Jaccard of every two sets.

    Members with the same list of sets are counted together first, so pairs are formed from
    the distinct lists only; a list is no longer than the number of sets.
    """
    lists = df.select(set_id, member).dropna().groupBy(member).agg(F.array_sort(F.collect_set(set_id)).alias("s"))
    kinds = lists.groupBy("s").agg(F.count("*").alias("k"))
    size = kinds.select(F.explode("s").alias("s"), "k").groupBy("s").agg(F.sum("k").alias("n"))
    a = kinds.select("s", "k", F.posexplode("s").alias("i", "set_a"))
    pairs = a.select("set_a", "k", F.explode(F.slice("s", F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0)))).alias("set_b"))
    n = pairs.groupBy("set_a", "set_b").agg(F.sum("k").alias("intersection"))
    d = n.join(size.select(F.col("s").alias("set_a"), F.col("n").alias("_na")), "set_a").join(size.select(F.col("s").alias("set_b"), F.col("n").alias("_nb")), "set_b")
    union = F.col("_na") + F.col("_nb") - F.col("intersection")
    return d.select("set_a", "set_b", "intersection", union.alias("union"), (F.col("intersection") / union).alias("jaccard"))


def eta_squared(df: DataFrame, outcome: str, factors: Sequence[str], pairs: bool = False) -> DataFrame:
    """Share of the total sum of squares explained by each factor alone, and the increment of each pair over its two.

    Rows are reduced to sums per combination of levels first; only those sums are used after.
    """
    d = df.filter(F.col(outcome).isNotNull()).groupBy(*factors).agg(F.count("*").alias("_n"), F.sum(outcome).alias("_s"), F.sum(F.col(outcome) * F.col(outcome)).alias("_q"))
    whole = d.agg(F.sum("_n").alias("_N"), F.sum("_s").alias("_S"), F.sum("_q").alias("_Q")).select((F.col("_S") / F.col("_N")).alias("_mu"), (F.col("_Q") - F.col("_S") * F.col("_S") / F.col("_N")).alias("_sst"))
    parts = []
    for f in factors:
        g = d.groupBy(f).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")).join(F.broadcast(whole))
        m = F.col("_s") / F.col("_n") - F.col("_mu")
        parts.append(g.agg((F.sum(F.col("_n") * m * m) / F.first("_sst")).alias("eta2"), F.count("*").alias("n_levels")).select(F.lit(f).alias("term"), "eta2", "n_levels"))
    if pairs:
        for i, f in enumerate(factors):
            for h in factors[i + 1:]:
                mean = lambda keys, name: d.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias(name))
                g = d.groupBy(f, h).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")).join(mean([f], "_mf"), f).join(mean([h], "_mh"), h).join(F.broadcast(whole))
                m = F.col("_s") / F.col("_n") - F.col("_mf") - F.col("_mh") + F.col("_mu")
                parts.append(g.agg((F.sum(F.col("_n") * m * m) / F.first("_sst")).alias("eta2"), F.count("*").alias("n_levels")).select(F.lit(f"{f}:{h}").alias("term"), "eta2", "n_levels"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def icc(df: DataFrame, subject: str, value: str, rater: str | None = None) -> DataFrame:
    """ICC(1) from a one-way table; with a rater also ICC(2,1), ICC(3,1), within-subject SD and MDC95 from a complete table."""
    d = df.filter(F.col(value).isNotNull())
    s = d.groupBy(subject).agg(F.count("*").cast("double").alias("_in"), F.sum(value).alias("_is"), F.sum(F.col(value) * F.col(value)).alias("_iq"))
    t = s.agg(F.count("*").cast("double").alias("k"), F.sum("_in").alias("N"), F.sum("_is").alias("S"), F.sum("_iq").alias("Q"),
              F.sum(F.col("_is") * F.col("_is") / F.col("_in")).alias("B"), F.sum(F.col("_in") * F.col("_in")).alias("n2"))
    k, n, grand = F.col("k"), F.col("N"), F.col("S") * F.col("S") / F.col("N")
    msb, msw = (F.col("B") - grand) / (k - 1), (F.col("Q") - F.col("B")) / (n - k)
    between = F.greatest(F.lit(0.0), (msb - msw) / ((n - F.col("n2") / n) / (k - 1)))
    one = t.select(F.col("k").cast("bigint").alias("n_subjects"), F.when(between + msw > 0, between / (between + msw)).alias("icc1"), F.sqrt(msw).alias("within_sd"),
                   (1.96 * math.sqrt(2) * F.sqrt(msw)).alias("mdc95"), "k", "N", "B", "Q", "S")
    if rater is None:
        return one.select("n_subjects", "icc1", "within_sd", "mdc95")
    c = d.groupBy(rater).agg(F.count("*").alias("_in"), F.sum(value).alias("_is")).agg(F.count("*").cast("double").alias("r"), F.sum(F.col("_is") * F.col("_is") / F.col("_in")).alias("C"))
    j = one.join(F.broadcast(c))
    r, grand = F.col("r"), F.col("S") * F.col("S") / F.col("N")
    msr, msc = (F.col("B") - grand) / (F.col("k") - 1), (F.col("C") - grand) / (r - 1)
    mse = (F.col("Q") - F.col("B") - F.col("C") + grand) / ((F.col("k") - 1) * (r - 1))
    return j.select("n_subjects", "icc1", ((msr - mse) / (msr + (r - 1) * mse + r * (msc - mse) / F.col("k"))).alias("icc2"),
                    ((msr - mse) / (msr + (r - 1) * mse)).alias("icc3"), "within_sd", "mdc95")


def twin_heritability(pairs: DataFrame, zyg: str, a: str, b: str, mz: str, dz: str) -> DataFrame:
    """Double-entry intraclass correlation per zygosity and Falconer's 2 (r_MZ - r_DZ)."""
    both = pairs.select(zyg, F.inline(F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))))
    r = both.groupBy(zyg).agg(F.corr("x", "y").alias("r"))
    out = r.agg(F.max(F.when(F.col(zyg) == mz, F.col("r"))).alias("r_mz"), F.max(F.when(F.col(zyg) == dz, F.col("r"))).alias("r_dz"))
    return out.withColumn("h2", 2 * (F.col("r_mz") - F.col("r_dz")))


def bland_altman(df: DataFrame, a: str, b: str, by: Sequence[str] = (), subject: str | None = None) -> DataFrame:
    """Bias, SD, 95% limits, percentage error and concordance correlation; with a subject the limits use both variance parts."""
    x, y = F.col(a), F.col(b)
    d = df.filter(x.isNotNull() & y.isNotNull())
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x - y).alias("bias"), F.stddev_samp(x - y).alias("sd"), F.avg(x).alias("_ma"), F.avg(y).alias("_mb"),
                           F.var_pop(x).alias("_va"), F.var_pop(y).alias("_vb"), F.covar_pop(x, y).alias("_c"))
    ccc = 2 * F.col("_c") / (F.col("_va") + F.col("_vb") + (F.col("_ma") - F.col("_mb")) * (F.col("_ma") - F.col("_mb")))
    sd = F.col("sd")
    if subject is not None:
        s = d.groupBy(*by, subject).agg(F.count("*").cast("double").alias("_in"), F.sum(x - y).alias("_is"), F.sum((x - y) * (x - y)).alias("_iq"))
        t = s.groupBy(*by).agg(F.count("*").cast("double").alias("k"), F.sum("_in").alias("N"), F.sum("_is").alias("S"), F.sum("_iq").alias("Q"),
                               F.sum(F.col("_is") * F.col("_is") / F.col("_in")).alias("B"), F.sum(F.col("_in") * F.col("_in")).alias("n2"))
        msb, msw = (F.col("B") - F.col("S") * F.col("S") / F.col("N")) / (F.col("k") - 1), (F.col("Q") - F.col("B")) / (F.col("N") - F.col("k"))
        n0 = (F.col("N") - F.col("n2") / F.col("N")) / (F.col("k") - 1)
        t = t.select(*by, F.sqrt(F.greatest((msb - msw) / n0, F.lit(0.0)) + msw).alias("_sd"))
        g = g.join(t, list(by)) if by else g.join(F.broadcast(t))
        sd = F.col("_sd")
    return g.select(*by, "n", "bias", sd.alias("sd"), (F.col("bias") - 1.96 * sd).alias("lower"), (F.col("bias") + 1.96 * sd).alias("upper"),
                    (100 * 1.96 * sd / ((F.col("_ma") + F.col("_mb")) / 2)).alias("percentage_error"), ccc.alias("ccc"))


def four_quadrant(df: DataFrame, key: Sequence[str], time: str, a: str, b: str, exclusion: float, tie: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """Share of consecutive changes with the same sign, small changes (both below ``exclusion``) left out."""
    d = scan(df, key, time, {"_pa": ("lag", a), "_pb": ("lag", b)}, width, tie)
    da, db = F.col(a) - F.col("_pa"), F.col(b) - F.col("_pb")
    d = d.select(da.alias("x"), db.alias("y")).filter((F.abs("x") >= exclusion) | (F.abs("y") >= exclusion))
    return d.agg(F.count("*").alias("n"), F.avg((F.col("x") * F.col("y") > 0).cast("double")).alias("concordance"))


def effect_size(df: DataFrame, by: Sequence[str], group: Column, value: str) -> DataFrame:
    """Hedges g (group minus rest) with its variance, Cohen d and Welch t per stratum."""
    x, y = F.when(group, F.col(value)), F.when(~group, F.col(value))
    g = df.groupBy(*by).agg(F.count(x).cast("double").alias("nx"), F.count(y).cast("double").alias("ny"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
                            F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"))
    nx, ny, vx, vy = (F.col(c) for c in ("nx", "ny", "vx", "vy"))
    dof = nx + ny - 2
    d = (F.col("mx") - F.col("my")) / F.sqrt(((nx - 1) * vx + (ny - 1) * vy) / dof)
    hg = (1 - 3 / (4 * dof - 1)) * d
    a, b = vx / nx, vy / ny
    ok = (nx >= 2) & (ny >= 2)
    return g.select(*by, nx.cast("bigint").alias("nx"), ny.cast("bigint").alias("ny"), F.when(ok, d).alias("cohen_d"), F.when(ok, hg).alias("hedges_g"),
                    F.when(ok, (nx + ny) / (nx * ny) + hg * hg / (2 * (nx + ny))).alias("var_g"), F.when(ok, (F.col("mx") - F.col("my")) / F.sqrt(a + b)).alias("welch_t"),
                    F.when(ok, (a + b) * (a + b) / (a * a / (nx - 1) + b * b / (ny - 1))).alias("welch_df"))


def paired_effect(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the differences a - b, its effect size over their SD, t statistic and two-sided p per stratum."""
    d = F.col(a) - F.col(b)
    g = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_sd"))
    stat = F.col("mean_difference") / (F.col("_sd") / F.sqrt("n"))
    return g.select(*by, "n", "mean_difference", (F.col("mean_difference") / F.col("_sd")).alias("dz"), stat.alias("t"), t_p(stat, (F.col("n") - 1).cast("double")).alias("p"))


def standardised_differences(df: DataFrame, treated: str, covars: Sequence[str], weight: str | None = None) -> DataFrame:
    """Difference of (weighted) means over the pooled SD, one row per covariate, from one aggregate row."""
    w = F.col(weight) if weight else F.lit(1.0)
    aggs = []
    for c in covars:
        for arm in (0, 1):
            on = (F.col(treated) == arm) & F.col(c).isNotNull()
            aggs += [F.sum(F.when(on, w)).alias(f"w_{c}_{arm}"), F.sum(F.when(on, w * F.col(c))).alias(f"s_{c}_{arm}"), F.sum(F.when(on, w * F.col(c) * F.col(c))).alias(f"q_{c}_{arm}")]
    one = df.agg(*aggs)
    def part(c):
        m = [F.col(f"s_{c}_{a}") / F.col(f"w_{c}_{a}") for a in (0, 1)]
        v = [F.col(f"q_{c}_{a}") / F.col(f"w_{c}_{a}") - m[a] * m[a] for a in (0, 1)]
        return F.struct(F.lit(c).alias("covariate"), m[1].alias("mean_treated"), m[0].alias("mean_control"), ((m[1] - m[0]) / F.sqrt((v[0] + v[1]) / 2)).alias("smd"))
    return one.select(F.inline(F.array(*[part(c) for c in covars])))


@F.pandas_udf(T.DoubleType())
def _t_crit(df: pd.Series) -> pd.Series:
    known = {d: t_ppf(0.975, d) for d in df.dropna().unique() if d > 0}
    return df.map(known)


def pool_effects(df: DataFrame, y: str, v: str, by: Sequence[str] = (), hartung_knapp: bool = False) -> DataFrame:
    """Fixed and DerSimonian-Laird pooled effects with Q, I2 and tau2; optional truncated Hartung-Knapp limits on t(k-1)."""
    d = df.filter(F.col(y).isNotNull() & (F.col(v) > 0)).select(*by, F.col(y).alias("_y"), F.col(v).alias("_v"))
    w = 1 / F.col("_v")
    one = d.groupBy(*by).agg(F.count("*").alias("k"), F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), F.sum(w * F.col("_y")).alias("_wy"), F.sum(w * F.col("_y") * F.col("_y")).alias("_wyy"))
    q = F.greatest(F.col("_wyy") - F.col("_wy") * F.col("_wy") / F.col("_w"), F.lit(0.0))
    c = F.col("_w") - F.col("_w2") / F.col("_w")
    one = one.select(*by, "k", (F.col("_wy") / F.col("_w")).alias("fixed"), F.sqrt(1 / F.col("_w")).alias("fixed_se"), q.alias("q"),
                     F.when(F.col("k") > 1, F.greatest((q - (F.col("k") - 1)) / c, F.lit(0.0))).otherwise(0.0).alias("tau2"),
                     F.when((F.col("k") > 1) & (q > 0), F.greatest(100 * (q - (F.col("k") - 1)) / q, F.lit(0.0))).otherwise(0.0).alias("i2"))
    j = d.join(one, list(by)) if by else d.join(F.broadcast(one))
    w = 1 / (F.col("_v") + F.col("tau2"))
    two = j.groupBy(*by).agg(F.sum(w).alias("_w"), F.sum(w * F.col("_y")).alias("_wy"), F.sum(w * F.col("_y") * F.col("_y")).alias("_wyy"))
    out = one.join(two, list(by)) if by else one.join(F.broadcast(two))
    mu, se = F.col("_wy") / F.col("_w"), F.sqrt(1 / F.col("_w"))
    out = out.withColumn("random", mu).withColumn("random_se", se)
    if hartung_knapp:
        star = (F.col("_wyy") - F.col("_wy") * F.col("_wy") / F.col("_w")) / (F.col("k") - 1)
        out = out.withColumn("random_se", F.when(F.col("k") > 1, F.sqrt(F.greatest(star, F.lit(1.0)) / F.col("_w"))).otherwise(se))
        crit = F.when(F.col("k") > 1, _t_crit((F.col("k") - 1).cast("double"))).otherwise(1.959963984540054)
    else:
        crit = F.lit(1.959963984540054)
    return (out.withColumn("low", F.col("random") - crit * F.col("random_se")).withColumn("high", F.col("random") + crit * F.col("random_se"))
            .drop("_w", "_wy", "_wyy"))


def leave_one_out(df: DataFrame, y: str, v: str, study: str) -> DataFrame:
    """Fixed effect without each study in turn, from the totals minus the study's own sums."""
    d = df.filter(F.col(y).isNotNull() & (F.col(v) > 0))
    w = 1 / F.col(v)
    t = d.agg(F.sum(w).alias("_w"), F.sum(w * F.col(y)).alias("_wy"))
    return d.join(F.broadcast(t)).select(study, ((F.col("_wy") - w * F.col(y)) / (F.col("_w") - w)).alias("fixed_without"))


def egger(df: DataFrame, y: str, v: str, by: Sequence[str] = ()) -> DataFrame:
    """Intercept of y/se on 1/se with its Student p value."""
    se = F.sqrt(F.col(v))
    d = df.filter(F.col(y).isNotNull() & (F.col(v) > 0)).select(*by, (1 / se).alias("x"), (F.col(y) / se).alias("z"))
    g = d.groupBy(*by).agg(F.count("*").cast("double").alias("k"), F.regr_intercept("z", "x").alias("intercept"), F.regr_sxx("z", "x").alias("sxx"),
                           F.regr_syy("z", "x").alias("syy"), F.regr_sxy("z", "x").alias("sxy"), F.avg("x").alias("mx"))
    s2 = (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("k") - 2)
    stat = F.col("intercept") / F.sqrt(s2 * (1 / F.col("k") + F.col("mx") * F.col("mx") / F.col("sxx")))
    return g.filter(F.col("k") >= 3).select(*by, F.col("k").cast("bigint").alias("k"), "intercept", t_p(stat, F.col("k") - 2).alias("p"))


def pseudobulk(df: DataFrame, label: str, item: str, value: str, member: str, min_n: int, how: str = "mean") -> DataFrame:
    """Mean or sum per (label, item) over the label's members, absent values counting 0; small labels drop out."""
    size = df.groupBy(label).agg(F.countDistinct(member).alias("members")).filter(F.col("members") >= min_n)
    g = df.groupBy(label, item).agg(F.sum(value).alias("_s")).join(size, label)
    return g.select(label, item, "members", (F.col("_s") if how == "sum" else F.col("_s") / F.col("members")).alias("level"))


def specificity(bulk: DataFrame, label: str, item: str, level: str) -> DataFrame:
    """Share of an item's level over all labels."""
    t = bulk.groupBy(item).agg(F.sum(level).alias("_t"))
    return bulk.join(t, item).withColumn("specificity", F.when(F.col("_t") > 0, F.col(level) / F.col("_t"))).drop("_t")


def top_share(df: DataFrame, by: Sequence[str], value: str, share: float = 0.1) -> DataFrame:
    """Rows in the top ``share`` of their group by rank (ties at the border are kept)."""
    ranks = value_ranks(df, by, value).select(*by, value, "below", "n")
    total = ranks.groupBy(*by).agg(F.sum("n").alias("_t"))
    cut_ = ranks.join(total, list(by)).filter(F.col("below") + F.col("n") > F.col("_t") * (1 - share)).select(*by, value)
    return df.join(cut_, [*by, value], "left_semi")


def roll_up(bulk: DataFrame, parent: Mapping[str, str], label: str, item: str, level: str, members: str) -> DataFrame:
    """Fine labels to coarse ones by the member-weighted mean."""
    up = F.create_map(*[F.lit(x) for kv in parent.items() for x in kv])[F.col(label)]
    return bulk.groupBy(up.alias("parent"), item).agg((F.sum(F.col(level) * F.col(members)) / F.sum(members)).alias("level"))


def composition(df: DataFrame, group: str, kind: str, min_n: int = 1) -> DataFrame:
    """Share of each kind in its group, centred log-ratio of log1p counts over all kinds, and the group's evenness (0 to 1)."""
    c = df.groupBy(group, kind).agg(F.count("*").alias("n"))
    kinds = c.agg(F.countDistinct(kind).alias("_k"))
    t = c.groupBy(group).agg(F.sum("n").alias("_t"), F.sum(F.log1p("n")).alias("_l")).filter(F.col("_t") >= min_n)
    d = c.join(t, group).join(F.broadcast(kinds)).withColumn("share", F.col("n") / F.col("_t"))
    ent = d.groupBy(group).agg((-F.sum(F.col("share") * F.log("share")) / F.log(F.first("_k"))).alias("evenness"))
    return d.join(ent, group).select(group, kind, "n", "share", (F.log1p("n") - F.col("_l") / F.col("_k")).alias("clr"), "evenness")


def corr_matrix(df: DataFrame, entity: str, time: str, value: str, method: str = "pearson") -> DataFrame:
    """Correlation of every two entities over their shared steps, long form with a < b; constant series give 0; Fisher z clipped at 0.999999.

    ``df`` holds one value per (entity, step), so a step never joins more rows than there are entities.
    """
    d = df.select(entity, time, F.col(value).cast("double").alias("_x"))
    if method == "spearman":
        r = value_ranks(d, [entity], "_x").select(entity, "_x", "rank")
        d = d.join(r, [entity, "_x"]).select(entity, time, F.col("rank").alias("_x"))
    a = d.select(F.col(entity).alias("a"), time, F.col("_x").alias("x"))
    b = d.select(F.col(entity).alias("b"), time, F.col("_x").alias("y"))
    g = a.join(b, time).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    r = F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0))
    clip = F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999))
    return g.select("a", "b", "n", r.alias("r"), F.atanh(clip).alias("z"))


def corr_with(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """r of two columns per group with the two-sided Student p value."""
    g = df.groupBy(*by).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.corr(x, y).alias("r"))
    stat = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return g.withColumn("p", t_p(stat, (F.col("n") - 2).cast("double")))


def rank_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman and Kendall (tau-b) of two scores; concordant pairs are counted by bit levels, never formed."""
    d = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).dropna()
    ra = value_ranks(d, [], "x").select("x", F.col("rank").alias("rx"))
    rb = value_ranks(d, [], "y").select("y", F.col("rank").alias("ry"))
    rho = d.join(ra, "x").join(rb, "y").agg(F.corr("rx", "ry").alias("spearman"), F.count("*").alias("n"))
    ties = lambda cols, name: d.groupBy(*cols).agg(F.count("*").cast("double").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias(name))
    conc = ordered_pairs(d, [], "x", "y", F.lit(1.0), F.lit(1.0)).select(F.col("below").alias("c"))
    one = rho.join(F.broadcast(conc)).join(F.broadcast(ties(["x"], "ta"))).join(F.broadcast(ties(["y"], "tb"))).join(F.broadcast(ties(["x", "y"], "tab")))
    t0 = F.col("n") * (F.col("n") - 1) / 2
    disc = t0 - F.col("c") - F.col("ta") - F.col("tb") + F.col("tab")
    return one.select("n", "spearman", ((F.col("c") - disc) / F.sqrt((t0 - F.col("ta")) * (t0 - F.col("tb")))).alias("kendall"))


def kendall_w(df: DataFrame, item: str, judge: str, rank: str) -> DataFrame:
    """W = 12 S / (m^2 (k^3 - k)) over m complete rankings of k items."""
    s = df.groupBy(item).agg(F.sum(rank).alias("_s"))
    m = df.agg(F.countDistinct(judge).alias("m"))
    g = s.agg(F.count("*").alias("k"), (F.var_pop("_s") * F.count("*")).alias("_S")).join(F.broadcast(m))
    return g.select("m", "k", (12 * F.col("_S") / (F.col("m") * F.col("m") * (F.col("k") * F.col("k") * F.col("k") - F.col("k")))).alias("w"))


def top_k_overlap(a: DataFrame, b: DataFrame, item: str, score: str, k: int) -> DataFrame:
    """Jaccard of two top-``k`` lists (ties by item)."""
    x = a.orderBy(F.desc(score), item).limit(k).select(item, F.lit(1).alias("_a"))
    y = b.orderBy(F.desc(score), item).limit(k).select(item, F.lit(1).alias("_b"))
    d = x.join(y, item, "full")
    both = F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0))
    return d.agg(both.alias("common"), (both / F.count("*")).alias("jaccard"))


def mode_with_conflict(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key (ties to the smallest) and whether the key holds several."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    return c.groupBy(*key).agg(F.min_by(value, F.struct((-F.col("_n")).alias("o"), value)).alias("mode"), (F.count("*") > 1).alias("conflict"))


def quantile_strata(df: DataFrame, by: Sequence[str], metrics: Mapping[str, bool], n: int, row_id: str) -> DataFrame:
    """n-tile of the mean rank over several metrics inside each group; ``metrics`` says whether a high value is bad.  Stratum 1 is best."""
    d = df
    for i, (m, high_is_bad) in enumerate(metrics.items()):
        v = f"_v{i}"
        d = d.withColumn(v, F.col(m) if high_is_bad else -F.col(m))
        ranks = value_ranks(d, by, v).select(*by, v, F.col("rank").alias(f"_r{i}"))
        d = d.join(ranks, [*by, v])
    mean = sum((F.col(f"_r{i}") for i in range(len(metrics))), F.lit(0.0)) / len(metrics)
    d = d.withColumn("_mean", mean)
    size = d.groupBy(*by).agg(F.count("*").alias("_n"))
    d = scan(d, by, "_mean", {"_rk": ("row_number", None)}, None, [row_id]).join(size, list(by))
    small, extra = F.floor(F.col("_n") / n), F.col("_n") % n
    edge = extra * (small + 1)
    tile = F.when(F.col("_rk") <= edge, F.ceil(F.col("_rk") / (small + 1))).otherwise(extra + F.ceil((F.col("_rk") - edge) / small))
    return d.select(row_id, *by, tile.cast("int").alias("stratum"))


def collapse_repeats(df: DataFrame, key: Sequence[str], cols: Mapping[str, str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: ``mean`` (with n and SE), ``first``, ``last``, ``high`` (worst is high) or ``low`` per column."""
    at = F.struct(*order) if order else None
    aggs = []
    for c, how in cols.items():
        if how == "mean":
            aggs += [F.avg(c).alias(c), F.count(c).alias(f"{c}_n"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_se")]
        else:
            aggs.append({"first": lambda: F.min_by(c, at), "last": lambda: F.max_by(c, at), "high": lambda: F.max(c), "low": lambda: F.min(c)}[how]().alias(c))
    return df.groupBy(*key).agg(*aggs)
