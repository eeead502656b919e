"""Group-safe splits, leakage audits and specification grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import SLICE, axis, quantiles, scan
from .evaluation import cluster_bootstrap
from .joins import hash_order

#: Rows of a slice of the hash range, about.
SLICE_ROWS = 200_000


def _hash_ranked(groups: DataFrame, name: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Rank rows by hash inside ``by``; the hash range is cut into as many slices as the rows ask for, so no rank needs one task."""
    d = groups.withColumn("_h", hash_order(name, seed=seed))
    pieces = groups.select(F.ceil(F.greatest(F.count(F.lit(1)), F.lit(1)) / SLICE_ROWS).cast("double")).scalar()
    d = d.withColumn(SLICE, F.floor(F.col("_h").cast("double") / F.lit(2.0 ** 64) * pieces).cast("bigint"))
    return scan(d, by, "_h", {"_rank": ("row_number", None)}, tie=[name]).drop("_h")


def group_split(df: DataFrame, group: str, fractions: Mapping[str, float], seed: int = 0) -> DataFrame:
    """Label every row with its group's split; exact shares (rounded) of the groups in hash order."""
    ranked = _hash_ranked(df.select(group).distinct(), group, seed)
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    label, total = None, 0.0
    for name, share in list(fractions.items())[:-1]:
        total += share
        edge = F.col("_rank") <= F.round(F.col("_n") * total)
        label = F.when(edge, name) if label is None else label.when(edge, name)
    last = list(fractions)[-1]
    label = F.lit(last) if label is None else label.otherwise(last)
    splits = ranked.join(F.broadcast(n)).select(group, label.alias("split"))
    return df.join(splits, group)


def grouped_folds(df: DataFrame, group: str, k: int, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """Whole groups to ``k`` folds of near-equal weight.

    Groups are dealt in order of falling weight, back and forth over the folds, which
    keeps the totals close without a sequential pass over the groups.
    """
    w = F.sum(F.lit(1.0) if weight is None else weight.cast("double")).alias("_w")
    totals = df.groupBy(group).agg(w).withColumn("_o", -F.col("_w"))
    ranked = scan(totals, [], "_o", {"_rank": ("row_number", None)}, tie=[group])
    turn = F.floor((F.col("_rank") - 1) / k)
    spot = (F.col("_rank") - 1) % k
    fold = F.when(turn % 2 == 0, spot).otherwise(k - 1 - spot).cast("int")
    return df.join(ranked.select(group, fold.alias("fold")), group)


def temporal_split(df: DataFrame, key: Sequence[str], time: str, share: float, tie: Sequence[str], width: float | None = None) -> DataFrame:
    """The earliest floor(n * share) rows of each key are ``train``, the rest ``test``."""
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    d = scan(df, key, time, {"_rk": ("row_number", None)}, width, tie)
    split = F.when(F.col("_rk") <= F.floor(F.col("_n") * share), "train").otherwise("test")
    return d.join(n, list(key)).withColumn("split", split).drop("_rk", "_n")


def rolling_origin(eras: DataFrame, era: str) -> DataFrame:
    """For each era but the first: it is tested, all earlier ones train.  One row per (test era, train era)."""
    e = eras.select(era).distinct()
    e = scan(e, [], era, {"_rk": ("row_number", None)})
    pieces = e.withColumn("_upto", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rk"))))
    named = e.select(F.col("_rk").alias("_upto"), F.col(era).alias("train_era"))
    return pieces.filter(F.col("_upto") < F.col("_rk")).join(named, "_upto").select(F.col(era).alias("test_era"), "train_era")


def leakage_audit(df: DataFrame, subject: str, record: Sequence[str], time: str, split: str, gap: float, width: float | None = None) -> DataFrame:
    """Subjects and records in both splits, and test rows within ``gap`` of a training row of their subject; ``clean`` when none.

    Nearness asks only for the neighbouring training row on either side; at equal times the training row comes first, so it counts.
    """
    train = F.col(split) == "train"

    def shared(cols):
        g = df.groupBy(*cols).agg(F.max(train.cast("int")).alias("_a"), F.max((~train).cast("int")).alias("_b"))
        return g.agg(F.sum(F.when((F.col("_a") == 1) & (F.col("_b") == 1), 1).otherwise(0)).alias("_s"), F.sum("_b").alias("_t"))

    subjects = shared([subject]).select(F.col("_s").alias("shared_subjects"), (F.col("_s") / F.col("_t")).alias("subject_overlap"))
    records = shared(list(record)).select(F.col("_s").alias("shared_records"))
    t = F.when(train, F.col("_x"))
    line = df.withColumn("_x", axis(df, time)).withColumn("_o", (~train).cast("int"))
    line = scan(line.select(subject, split, "_x", "_o"), [subject], "_x", {"_p": ("max", t)}, width, tie=["_o"])
    line = scan(line.withColumn("_neg", -F.col("_x")), [subject], "_neg", {"_q": ("max", F.when(train, F.col("_neg")))}, width, tie=["_o"])
    near = (F.col("_x") - F.col("_p") <= gap) | (F.col("_q") - F.col("_neg") >= -gap)
    close = line.filter(~train).agg(F.sum(F.when(near, 1).otherwise(0)).alias("near_rows"), F.count(F.lit(1)).alias("test_rows"))
    out = subjects.join(F.broadcast(records)).join(F.broadcast(close))
    return out.withColumn("clean", (F.col("shared_subjects") == 0) & (F.col("shared_records") == 0) & (F.col("near_rows") == 0))


def leakage_inflation(folds: DataFrame, fold: Sequence[str], metric: str, leaky: str, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """How much a metric gains from a leaky split: mean over leaky folds less mean over clean ones (``absolute``), the same over the clean mean
    (``relative``), and percentile limits with folds drawn anew.

    ``folds`` has one metric per fold (or subject) and split kind, ``leaky`` tells the kind; null metrics are left out.
    """
    yes = F.col(leaky) & F.col(metric).isNotNull()
    no = ~F.col(leaky) & F.col(metric).isNotNull()
    d = folds.select(*fold, leaky, *[F.when(w, v).otherwise(0.0).alias(name) for name, w, v in (("sa", yes, F.col(metric)), ("na", yes, F.lit(1.0)), ("sb", no, F.col(metric)), ("nb", no, F.lit(1.0)))])
    gain = F.col("sa") / F.nullif(F.col("na"), F.lit(0.0)) - F.col("sb") / F.nullif(F.col("nb"), F.lit(0.0))
    out = cluster_bootstrap(d, [leaky, *fold], gain, ["sa", "na", "sb", "nb"], n_boot, seed)
    clean = folds.filter(no).agg(F.avg(metric).alias("_m"))
    return out.join(F.broadcast(clean)).select(F.col("estimate").alias("absolute"), (F.col("estimate") / F.greatest(F.abs("_m"), F.lit(1e-12))).alias("relative"), "low", "high")


def stratified_sample(df: DataFrame, by: str, row_id: str, k: int | None = None, seed: int = 0) -> DataFrame:
    """``k`` rows of each class in hash order, or as many as the smallest class has (``k=None``)."""
    ranked = _hash_ranked(df, row_id, seed, [by])
    if k is not None:
        return ranked.filter(F.col("_rank") <= k).drop("_rank")
    least = df.groupBy(by).count().agg(F.min("count").alias("_k"))
    return ranked.join(F.broadcast(least)).filter(F.col("_rank") <= F.col("_k")).drop("_rank", "_k")


# --- specification grids -------------------------------------------------------------------------

def spec_grid(spark, levels: Mapping[str, Sequence], collapse: Mapping[str, tuple[str, object]] | None = None) -> DataFrame:
    """All combinations of factor levels with a stable ``spec`` name.

    ``collapse`` maps a factor to (other factor, level): where the other factor is not at
    that level the factor does not matter and is fixed to its first level.
    """
    collapse = collapse or {}
    d = spark.range(1).select()
    for name, values in levels.items():
        d = d.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    for name, (other, level) in collapse.items():
        d = d.withColumn(name, F.when(F.col(other) == level, F.col(name)).otherwise(F.lit(levels[name][0])))
    d = d.distinct()
    return d.withColumn("spec", F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in levels]))


def run_specs(df: DataFrame, levels: Mapping[str, Sequence], keep: Mapping[str, object], measures: Mapping[str, object]) -> DataFrame:
    """Every specification over one scan.

    ``keep`` maps a factor to a function of its level giving a row condition, ``measures``
    a name to a function of the row condition giving an aggregate.  Rows are first reduced
    to the distinct patterns of passed conditions, so the grid never multiplies the rows.
    """
    rules = {(n, v): keep[n](v) for n in keep for v in levels[n]}
    flags = {key: f"_c{i}" for i, key in enumerate(rules)}
    marked = df.select("*", *[F.coalesce(rules[k], F.lit(False)).alias(flags[k]) for k in rules])
    cells = marked.groupBy(*flags.values()).agg(*[m.alias(f"_m_{n}") for n, m in measures.items()])
    grid = F.array(F.struct())
    names = list(levels)
    combos = [()]
    for n in names:
        combos = [(*c, v) for c in combos for v in levels[n]]
    grid = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c)],
                              F.expr(" AND ".join(flags[(n, v)] for n, v in zip(names, c) if n in keep) or "true").alias("_in")) for c in combos])
    d = cells.select("*", F.inline(grid))
    sums = [F.sum(F.when(F.col("_in"), F.col(f"_m_{n}")).otherwise(0)).alias(n) for n in measures]
    return d.groupBy(*names).agg(*sums)


def spec_curve(results: DataFrame, order: Sequence[str], effect: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Specifications ranked by effect, with the shares significant and of the majority sign.

    ``results`` holds one row per specification, so it is small by construction.
    """
    d = scan(results, [], effect, {"rank": ("row_number", None)}, tie=order)
    whole = results.agg(F.avg((F.col(p) < alpha).cast("double")).alias("share_significant"), F.avg((F.col(effect) > 0).cast("double")).alias("_pos"),
                        F.percentile(effect, 0.5).alias("median_effect"))
    whole = whole.select("share_significant", F.greatest("_pos", 1 - F.col("_pos")).alias("share_same_sign"), "median_effect")
    return d.join(F.broadcast(whole))


def label_shift_between(a: DataFrame, b: DataFrame, key: str, onset: str, moved_h: float = 6.0) -> DataFrame:
    """Members of both definitions, quartiles of the onset shift, the share moved by more than ``moved_h`` and the flip rate."""
    d = a.select(key, F.col(onset).alias("_a")).join(b.select(key, F.col(onset).alias("_b")), key, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    shift = F.when(both, F.col("_b") - F.col("_a"))
    d = d.withColumn("_shift", shift)
    out = d.agg(F.sum(F.when(both, 1).otherwise(0)).alias("n_both"), F.avg((F.abs("_shift") > moved_h).cast("double")).alias("share_moved"),
                F.avg((F.col("_a").isNull() != F.col("_b").isNull()).cast("double")).alias("flip_rate"))
    q = quantiles(d, [], "_shift", {"shift_q25": 0.25, "shift_median": 0.5, "shift_q75": 0.75})
    return out.join(F.broadcast(q))
