"""Interval, nearest, as-of, window and fuzzy joins, pairing and matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from ..plans.ordered import SLICE, add_slices, axis, halo, range_pairs, scan, ticks

HASH_SPAN = 2.0 ** 64


def hash_order(*cols: str, seed: int = 0) -> Column:
    """A reproducible pseudo-random order: the same rows get the same place on every run."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def hash_unit(*cols: str, seed: int = 0) -> Column:
    """A reproducible pseudo-random number in [0, 1)."""
    return F.pmod(hash_order(*cols, seed=seed), F.lit(1 << 53)) / float(1 << 53)


def interval_join(points: DataFrame, intervals: DataFrame, key: Sequence[str], ts: str, start: str, end: str,
                  width: float, tie: Sequence[str] = ()) -> DataFrame:
    """Attach to every point the interval of its key that contains it, the latest start winning.

    Points outside all intervals are dropped.  Pairs meet on (key, slice) and are
    reduced by a partial ``max_by`` before anything is shuffled again.
    """
    found = range_pairs(intervals, points, key, start, end, ts, width)
    keep = [c for c in intervals.columns if c not in key]
    best = F.max_by(F.struct(*keep), F.struct(start, end, *tie)).alias("_best")
    return found.groupBy(*points.columns).agg(best).select(*points.columns, "_best.*")


def _timeline(left: DataFrame, right: DataFrame, key: Sequence[str], lt: str, rt: str, tie: Sequence[str]) -> DataFrame:
    """Left and right rows of each key on one time line; at equal times right rows come first."""
    rows = F.struct(*[F.col(c) for c in right.columns])
    if tie:
        first = right.withColumn("_t", axis(right, rt)).groupBy(*key, "_t").agg(F.min_by(rows, F.struct(*tie)).alias("_r"))
    else:
        first = right.select(*key, axis(right, rt).alias("_t"), rows.alias("_r"))
    l = left.select(*key, axis(left, lt).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(1).alias("_side"))
    return first.withColumn("_side", F.lit(0)).unionByName(l, allowMissingColumns=True)


def _right_columns(left: DataFrame, right: DataFrame, key: Sequence[str]) -> list[str]:
    clash = [c for c in right.columns if c in left.columns and c not in key]
    if clash:
        raise ValueError(f"rename the right columns {clash}")
    return [c for c in right.columns if c not in key]


def asof_join(left: DataFrame, right: DataFrame, key: Sequence[str], lt: str, rt: str,
              max_staleness: float | None = None, width: float | None = None, tie: Sequence[str] = (),
              strict: bool = False) -> DataFrame:
    """Last right row of the key at or before the left time (before it if ``strict``), with a ``missing`` flag.

    Both sides share one time line and the last right row is carried along it, so
    no left-right pairs are formed.  Of right rows at one time the smallest ``tie`` is used.
    """
    keep = _right_columns(left, right, key)
    line = _timeline(left, right, key, lt, rt, tie or [rt])
    if strict:
        line = line.withColumn("_side", 1 - F.col("_side"))
    line = scan(line, key, "_t", {"_m": ("last", "_r")}, width, tie=["_side"])
    fresh = F.lit(True) if max_staleness is None else (F.col("_t") - axis_of(right, "_m", rt) <= max_staleness)
    line = line.filter(F.col("_l").isNotNull()).withColumn("_m", F.when(fresh, F.col("_m")))
    return line.select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in keep], F.col("_m").isNull().alias("missing"))


def axis_of(df: DataFrame, holder: str, col: str) -> Column:
    """``axis`` of a column held inside a struct."""
    kind = df.schema[col].dataType
    c = F.col(f"{holder}.{col}")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp").cast("double")
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    return c.cast("double")


def nearest_join(left: DataFrame, right: DataFrame, key: Sequence[str], lt: str, rt: str, max_gap: float,
                 width: float | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Nearest right row of the key on either side within ``max_gap``; ties go to the earlier one.

    Only the neighbour before and the neighbour after are looked at, both carried
    along the shared time line.
    """
    keep = _right_columns(left, right, key)
    line = _timeline(left, right, key, lt, rt, tie or [rt])
    line = scan(line, key, "_t", {"_p": ("last", "_r"), "_n": ("next", "_r")}, width, tie=["_side"])
    line = (line.filter(F.col("_l").isNotNull())
            .withColumn("_gp", F.col("_t") - axis_of(right, "_p", rt))
            .withColumn("_gn", axis_of(right, "_n", rt) - F.col("_t")))
    pick = (F.when((F.col("_gp") <= max_gap) & (F.col("_gn").isNull() | (F.col("_gp") <= F.col("_gn"))), F.col("_p"))
            .when(F.col("_gn") <= max_gap, F.col("_n")))
    gap = F.when(F.col("_m").isNotNull(), F.least("_gp", "_gn"))
    return line.withColumn("_m", pick).select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in keep], gap.alias("gap"))


def pre_post_windows(index: DataFrame, obs: DataFrame, key: Sequence[str], index_id: str, start: str, end: str,
                     ts: str, value: str, pre: float, post: float, min_n: int, width: float) -> DataFrame:
    """Statistics of ``value`` in [start - pre, start) and [end, end + post) of each index event.

    ``baseline`` is the latest value inside the first window and ``valid`` asks for
    ``min_n`` values in both.  Index events are put on the observation time line and
    read their windows as RANGE frames.
    """
    from pyspark.sql import Window
    line = (obs.select(*key, ticks(obs, ts).alias("_tick"), F.col(value).cast("double").alias("_x"))
            .unionByName(index.select(*key, ticks(index, start).alias("_tick"), F.col(index_id), F.lit("pre").alias("_mark")),
                         allowMissingColumns=True)
            .unionByName(index.select(*key, ticks(index, end).alias("_tick"), F.col(index_id), F.lit("post").alias("_mark")),
                         allowMissingColumns=True))
    lo, hi = int(round(pre * 1e6)), int(round(post * 1e6))
    line = halo(line, F.col("_tick"), lo, hi, width * 1e6)
    w = Window.partitionBy(*key, SLICE).orderBy("_tick")
    before, after = w.rangeBetween(-lo, -1), w.rangeBetween(0, hi - 1)

    def stats(frame):
        return F.struct(F.count("_x").over(frame).alias("n"), F.avg("_x").over(frame).alias("mean"),
                        F.max("_x").over(frame).alias("max"), F.min("_x").over(frame).alias("min"),
                        F.last("_x", ignorenulls=True).over(frame).alias("last"))

    read = line.select(*key, index_id, "_mark", "_own", stats(before).alias("_b"), stats(after).alias("_a"))
    read = read.filter(F.col("_own") & F.col("_mark").isNotNull())
    out = read.groupBy(*key, index_id).agg(
        F.max(F.when(F.col("_mark") == "pre", F.col("_b"))).alias("b"),
        F.max(F.when(F.col("_mark") == "post", F.col("_a"))).alias("a"))
    return out.select(*key, index_id,
                      F.col("b.n").alias("pre_n"), F.col("b.mean").alias("pre_mean"), F.col("b.max").alias("pre_max"),
                      F.col("b.last").alias("baseline"), F.col("a.n").alias("post_n"),
                      F.col("a.mean").alias("post_mean"), F.col("a.max").alias("post_max"),
                      ((F.col("b.n") >= min_n) & (F.col("a.n") >= min_n)).alias("valid"))


def responder(windows: DataFrame, threshold_pct: float = 10.0, use_peak: bool = False) -> DataFrame:
    """Relative change from the pre mean to the post mean (or peak), and whether it reaches the threshold."""
    post = F.col("post_max" if use_peak else "post_mean")
    change = F.when(F.col("pre_mean") != 0, 100 * (post - F.col("pre_mean")) / F.col("pre_mean"))
    return windows.withColumn("delta_pct", change).withColumn(
        "responder", F.coalesce((change >= threshold_pct) & F.col("valid"), F.lit(False)))


def window_share_ratio(series: DataFrame, events: DataFrame, key: Sequence[str], step: str, hits: str, total: str,
                       at: str, window: int, eps: float = 0.5) -> DataFrame:
    """Share ``hits / total`` in the ``window`` steps after an event step over the share before it (event step left out)."""
    offsets = [*range(-window, 0), *range(1, window + 1)]
    want = events.withColumn("_o", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn(step, F.col(at) + F.col("_o"))
    got = want.join(series.select(*key, step, hits, total), [*key, step], "left")
    pre = F.col("_o") < 0

    def side(c, cond):
        return F.sum(F.when(cond, F.coalesce(F.col(c), F.lit(0))).otherwise(0)).cast("double")

    out = got.groupBy(*key, at).agg(side(hits, pre).alias("pre_hits"), side(total, pre).alias("pre_total"),
                                    side(hits, ~pre).alias("post_hits"), side(total, ~pre).alias("post_total"))
    out = (out.withColumn("pre_share", (F.col("pre_hits") + eps) / (F.col("pre_total") + eps))
           .withColumn("post_share", (F.col("post_hits") + eps) / (F.col("post_total") + eps)))
    return out.withColumn("ratio", F.col("post_share") / F.col("pre_share"))


def paired_window(first: DataFrame, second: DataFrame, key: Sequence[str], ft: str, st: str, back: float,
                  forward: float, pick: str, width: float | None = None) -> DataFrame:
    """Time of the earliest ``first`` row with a ``second`` row in [first - back, first + forward].

    ``pick`` names the reported time: ``min`` of the two, ``first`` or ``second``.
    The bounds have no default because published rules disagree.
    """
    probe = first.select(*key, F.col(ft).alias("_first"), (axis(first, ft) - float(back)).alias("_probe"))
    found = second.select(*key, F.col(st).alias("_second"), axis(second, st).alias("_at"))
    line = (probe.select(*key, F.col("_probe").alias("_t"), "_first", F.lit(0).alias("_side"))
            .unionByName(found.select(*key, F.col("_at").alias("_t"), "_second", F.lit(1).alias("_side")),
                         allowMissingColumns=True))
    line = scan(line, key, "_t", {"_hit": ("next", "_second")}, width, tie=["_side"])
    pairs = line.filter(F.col("_first").isNotNull() & F.col("_hit").isNotNull())
    pairs = pairs.filter(axis(pairs, "_hit") <= axis(pairs, "_first") + float(forward))
    time = {"min": F.least("_first", "_hit"), "first": F.col("_first"), "second": F.col("_hit")}[pick]
    return pairs.groupBy(*key).agg(F.min_by(time, F.struct("_first", "_hit")).alias("pair_time"))


def repeat_within(df: DataFrame, key: Sequence[str], item: str, ts: str, hours: float, width: float | None = None) -> DataFrame:
    """Earliest time per key whose next record of the same item follows within ``hours``."""
    d = scan(df.select(*key, item, ts), [*key, item], ts, {"_next": ("lead", ts)}, width)
    return (d.filter(axis(d, "_next") - axis(d, ts) <= hours * 3600.0)
            .groupBy(*key).agg(F.min(ts).alias("repeat_time")))


def next_within(df: DataFrame, key: Sequence[str], start: str, end: str, hours: float, width: float | None = None,
                tie: Sequence[str] = ()) -> DataFrame:
    """Flag rows whose key's next record starts 0 to ``hours`` after this one ends (an overlap gives 0)."""
    d = scan(df, key, start, {"_next": ("lead", start)}, width, tie)
    gap = (axis(d, "_next") - axis(d, end)) / 3600.0
    return d.withColumn("returned", F.coalesce(gap.between(0, hours), F.lit(False)).cast("int")).drop("_next")


def entry_after(base: DataFrame, stays: DataFrame, key: Sequence[str], base_id: str, start: str, end: str,
                stay_start: str, stay_end: str, hours: float, planned: Column, width: float) -> DataFrame:
    """Unplanned entry: a stay begins 0..hours after ``end``, none was open at ``start``, and the row is not ``planned``."""
    window = base.select(*key, base_id, F.col(end).alias("_lo"), (axis(base, end) + hours * 3600.0).alias("_hi"))
    after = range_pairs(window, stays.select(*key, stay_start), key, "_lo", "_hi", stay_start, width)
    inside = range_pairs(stays.select(*key, stay_start, stay_end), base.select(*key, base_id, start), key,
                         stay_start, stay_end, start, width).filter(axis(stays, stay_end) > axis(base, start))
    out = (base.join(after.select(base_id).distinct().withColumn("_after", F.lit(True)), base_id, "left")
           .join(inside.select(base_id).distinct().withColumn("_inside", F.lit(True)), base_id, "left"))
    flag = F.col("_after").isNotNull() & F.col("_inside").isNull() & ~F.coalesce(planned, F.lit(False))
    return out.withColumn("unplanned", flag.cast("int")).drop("_after", "_inside")


def semi_anti_filter(base: DataFrame, require: Sequence[tuple[DataFrame, Sequence[str]]] = (),
                     exclude: Sequence[tuple[DataFrame, Sequence[str]]] = ()) -> DataFrame:
    """Keep rows that exist in every ``require`` table and in no ``exclude`` table.

    A NULL key never matches, so it fails a requirement and passes an exclusion.
    """
    for table, keys in require:
        base = base.join(table.select(*keys).distinct(), list(keys), "left_semi")
    for table, keys in exclude:
        base = base.join(table.select(*keys).distinct(), list(keys), "left_anti")
    return base


def name_similarity(a: Column, b: Column) -> Column:
    """Blend of character similarity and token Jaccard, at least 0.9 when a name (>= 5 characters) prefixes the other."""
    longest = F.greatest(F.length(a), F.length(b))
    seq = 1 - F.levenshtein(a, b) / longest
    ta = F.array_distinct(F.split(a, " "))
    tb = F.array_distinct(F.split(b, " "))
    jaccard = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    prefix = (F.startswith(a, b) | F.startswith(b, a)) & (F.least(F.length(a), F.length(b)) >= 5)
    blend = F.greatest(0.5 * seq + 0.5 * jaccard, F.when(prefix, 0.9).otherwise(0.0))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(blend)


#: Names of a block that hold a word before the word's names are told apart by letter pairs too.
HOT_NAMES = 256


def name_candidates(left: DataFrame, right: DataFrame, block: str, lname: str, rname: str, threshold: float) -> DataFrame:
    """Distinct (block, left name, right name) that can still reach ``threshold``; no pair that reaches it is lost.

    The blend needs a token Jaccard of ``2 * threshold - 1`` or the prefix rule, so names meet in two ways:

    * On the rarest words that such a Jaccard forces them to share.  A word of more than ``HOT_NAMES`` names is not
      enough there: a pair whose first shared word stands late in a name shares few words, so its characters must agree
      the more, and the names also have to meet on the rarest letter pairs that the number of edits left leaves whole.
      Names too short for that rule meet all names of the word.
    * For the prefix rule, the beginnings of a name meet the names that equal one of them: those pairs are results.

    Empty and null names, and names of a null block, meet nothing.
    """
    floor = 2 * threshold - 1
    if floor <= 0:
        raise ValueError("the threshold must be above 0.5, below it any pair of names could match")
    names = (left.select(F.col(block).alias("block"), F.col(lname).alias("name"), F.lit(0).alias("side"))
             .unionByName(right.select(F.col(block).alias("block"), F.col(rname).alias("name"), F.lit(1).alias("side")))
             .filter((F.col("name") != "") & F.col("block").isNotNull()).distinct())
    words = names.select("block", "name", "side", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    freq = words.groupBy("block", "word").agg(F.count(F.lit(1)).alias("df"))
    ranked = (words.join(freq, ["block", "word"]).groupBy("block", "name", "side")
              .agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ws")))
    n_words = F.size("ws")
    n_keys = (n_words - F.ceil(floor * n_words - 1e-9) + 1).cast("int")
    keyed = ranked.select("block", "name", "side", n_words.alias("n"), F.posexplode(F.slice("ws", F.lit(1), n_keys)).alias("before", "_w"))
    keyed = keyed.select("block", "name", "side", "n", "before", F.col("_w.word").alias("word"), F.col("_w.df").alias("df"))
    cold = keyed.filter(F.col("df") <= HOT_NAMES).select("block", "name", "side", F.lit("word").alias("by"), F.array("word").alias("k"))
    keys = cold.unionByName(_hot_keys(keyed.filter(F.col("df") > HOT_NAMES), threshold))
    if threshold <= 0.9:
        keys = keys.unionByName(_prefix_keys(names))
    l = keys.filter("side = 0").select("block", "by", "k", F.col("name").alias("l_name"))
    r = keys.filter("side = 1").select("block", "by", "k", F.col("name").alias("r_name"))
    return l.join(r, ["block", "by", "k"]).select(F.col("block").alias(block), "l_name", "r_name").distinct()


def _prefix_keys(names: DataFrame) -> DataFrame:
    """Names of five characters and more: the openings of one side meet the whole names of the other."""
    long = names.filter(F.length("name") >= 5)
    opening = F.transform(F.sequence(F.lit(5), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))
    one = lambda by, longer: F.transform(F.when(F.col("side") == longer, opening).otherwise(F.array("name")), lambda o: F.struct(F.lit(by).alias("by"), F.array(o).alias("k")))
    return long.select("block", "name", "side", F.explode(F.concat(one("left opens", 0), one("right opens", 1))).alias("_k")).select("block", "name", "side", "_k.*")


def _hot_keys(keyed: DataFrame, threshold: float) -> DataFrame:
    """Keys of names whose first shared word is a hot one.

    With ``before`` of n words not shared, the Jaccard is at most (n - before) / n, so the character similarity is at least
    s = 2 * threshold - that.  Names of lengths a <= b then differ by at most (1 - s) * b edits, where b <= a / s.  One
    edit changes two letter pairs at most, so of any 2 * edits + 1 pairs of a name one is left, and as both names order
    their pairs alike, the first so many of each share one.
    """
    least = 2 * threshold - (F.col("n") - F.col("before")) / F.col("n")
    chars = F.length("name")
    edits = F.when(least > 0, F.floor((1 - least) * chars / least + 1e-9)).otherwise(chars).cast("int")
    d = keyed.filter(least <= 1 + 1e-9).withColumn("need", 2 * edits + 1).withColumn("short", F.col("need") > chars - 1)
    d = d.select("block", "word", "name", "side", "need", "short")
    # names too short for the rule meet every name of the word on the other side
    meets = lambda by, side: F.when(F.col("short") | (F.col("side") != side), F.array(F.lit(by))).otherwise(F.array().cast("array<string>"))
    wide = d.select("block", "name", "side", F.explode(F.concat(meets("left short", 0), meets("right short", 1))).alias("by"), F.array("word").alias("k"))
    pairs = F.when(chars >= 2, F.transform(F.sequence(F.lit(1), chars - 1), lambda i: F.substring(F.col("name"), i, F.lit(2))))
    # the k-th occurrence of a letter pair is a pair of its own
    letters = d.select("block", "word", "name", "side", "need", "short", F.explode(pairs).alias("pair")).groupBy("block", "word", "name", "side", "need", "short", "pair").agg(F.count(F.lit(1)).alias("k"))
    letters = letters.select("block", "word", "name", "side", "need", "short", F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: F.concat(F.col("pair"), i.cast("string")))).alias("pair"))
    often = letters.groupBy("block", "word", "pair").agg(F.count(F.lit(1)).alias("df"))
    ordered = (letters.filter("NOT short").join(often, ["block", "word", "pair"]).groupBy("block", "word", "name", "side", "need")
               .agg(F.array_sort(F.collect_list(F.struct("df", "pair"))).alias("ps")))
    firm = ordered.select("block", "name", "side", F.lit("letters").alias("by"), "word", F.explode(F.slice("ps", F.lit(1), F.col("need"))).alias("p"))
    return wide.unionByName(firm.select("block", "name", "side", "by", F.array("word", "p.pair").alias("k")))


def fuzzy_block_join(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, lname: str,
                     rname: str, threshold: float = 0.85, second: tuple[str, str] | None = None,
                     dates: tuple[str, str] | None = None) -> DataFrame:
    """Best right row inside the block for every left row, or NULL.

    Scores are computed once per distinct name pair.  ``second`` names a further
    column pair that breaks ties; a match whose right date is after the left date
    is rejected (``dates``).
    """
    pairs = name_candidates(left, right, block, lname, rname, threshold)
    pairs = (pairs.withColumn("score", name_similarity(F.col("l_name"), F.col("r_name")))
             .filter(F.col("score") >= threshold))
    l_cols = [block, left_id, F.col(lname).alias("l_name")] + ([F.col(second[0]).alias("l_second")] if second else [])
    r_cols = [block, right_id, F.col(rname).alias("r_name")] + ([F.col(second[1]).alias("r_second")] if second else [])
    if dates:
        l_cols.append(F.col(dates[0]).alias("l_date"))
        r_cols.append(F.col(dates[1]).alias("r_date"))
    l, r = left.select(*l_cols), right.select(*r_cols)
    if second:
        l_keys = l.select(block, "l_name", "l_second").distinct()
        r_best = r.groupBy(block, "r_name", "r_second").agg(
            F.min(F.struct(right_id, *(["r_date"] if dates else []))).alias("_r"))
        cand = pairs.join(l_keys, [block, "l_name"]).join(r_best, [block, "r_name"])
        cand = cand.withColumn("score2", name_similarity(F.coalesce("l_second", F.lit("")), F.coalesce("r_second", F.lit(""))))
        keys = [block, "l_name", "l_second"]
    else:
        r_best = r.groupBy(block, "r_name").agg(F.min(F.struct(right_id, *(["r_date"] if dates else []))).alias("_r"))
        cand = pairs.join(r_best, [block, "r_name"]).withColumn("score2", F.lit(0.0))
        keys = [block, "l_name"]
    best = cand.groupBy(*keys).agg(F.max_by(F.struct("_r", "score", "score2"),
                                            F.struct("score", "score2", (-F.col(f"_r.{right_id}")).alias("o"))
                                            if isinstance(right.schema[right_id].dataType, T.NumericType)
                                            else F.struct("score", "score2", F.col(f"_r.{right_id}").alias("o"))).alias("_b"))
    cond = [l[k].eqNullSafe(best[k]) for k in keys]
    out = l.join(best.select(*[F.col(k).alias(f"_{k}") for k in keys], "_b"),
                 [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    ok = F.col("_b").isNotNull()
    if dates:
        ok = ok & ~F.coalesce(F.col("_b._r.r_date") > F.col("l_date"), F.lit(False))
    return out.select(left_id, F.when(ok, F.col(f"_b._r.{right_id}")).alias(right_id),
                      F.when(ok, F.col("_b.score")).alias("score"))


def tiered_match(reports: DataFrame, devices: DataFrame, block: str, report_id: str, device_id: str,
                 brand: tuple[str, str], company: tuple[str, str], brand_min: float = 0.85,
                 company_min: float = 0.80) -> DataFrame:
    """Best device per report: tier 1 by brand similarity, tier 2 by company similarity, then the score.

    Pairs that reach neither threshold (tier 3) never win, so only name pairs above a
    threshold are built, once per distinct name pair.
    """
    parts = []
    for tier, (lname, rname), floor in ((1, brand, brand_min), (2, company, company_min)):
        good = name_candidates(reports, devices, block, lname, rname, floor)
        good = good.withColumn("score", name_similarity(F.col("l_name"), F.col("r_name"))).filter(F.col("score") >= floor)
        dev = devices.groupBy(block, F.col(rname).alias("r_name")).agg(F.min(device_id).alias(device_id))
        best = good.join(dev, [block, "r_name"]).groupBy(block, "l_name").agg(
            F.min(F.struct((-F.col("score")).alias("neg"), F.col(device_id))).alias("b"))
        parts.append(reports.select(block, report_id, F.col(lname).alias("l_name")).join(best, [block, "l_name"])
                     .select(report_id, F.lit(tier).alias("tier"), (-F.col("b.neg")).alias("score"), f"b.{device_id}"))
    both = parts[0].unionByName(parts[1])
    return both.groupBy(report_id).agg(F.min(F.struct("tier", (-F.col("score")).alias("neg"), F.col(device_id))).alias("b")).select(
        report_id, "b.tier", (-F.col("b.neg")).alias("score"), f"b.{device_id}")


def within_group_pairs(df: DataFrame, group: Sequence[str], order: str, member: str, kind: str = "consecutive",
                       max_gap: float | None = None, width: float | None = None) -> DataFrame:
    """Pairs of members of a group.

    ``consecutive``: neighbours in ``order``; ``first_two``: the two earliest (twins);
    ``within``: every pair at most ``max_gap`` apart in ``order``.
    """
    d = df.select(*group, order, member)
    if kind == "consecutive":
        d = scan(d, group, order, {"_o": ("lead", F.struct(order, member))}, width, tie=[member])
        d = d.filter(F.col("_o").isNotNull())
        return d.select(*group, F.col(member).alias("a"), F.col(f"_o.{member}").alias("b"),
                        F.col(order).alias("order_a"), F.col(f"_o.{order}").alias("order_b"))
    if kind == "first_two":
        spot = F.struct(order, member)
        first = d.groupBy(*group).agg(F.min(spot).alias("_a"))
        rest = d.join(first, list(group)).filter(spot > F.col("_a"))
        both = rest.groupBy(*group).agg(F.first("_a").alias("_a"), F.min(spot).alias("_b"))
        return both.select(*group, F.col(f"_a.{member}").alias("a"), F.col(f"_b.{member}").alias("b"),
                           F.col(f"_a.{order}").alias("order_a"), F.col(f"_b.{order}").alias("order_b"))
    if kind == "within":
        l = d.select(*group, F.col(member).alias("a"), F.col(order).alias("order_a"),
                     axis(d, order).alias("_from"), (axis(d, order) + float(max_gap)).alias("_to"))
        r = d.select(*group, F.col(member).alias("b"), F.col(order).alias("order_b"))
        out = range_pairs(l, r, group, "_from", "_to", "order_b", width or max(float(max_gap), 1.0))
        later = (F.col("order_b") > F.col("order_a")) | ((F.col("order_b") == F.col("order_a")) & (F.col("b") > F.col("a")))
        return out.filter(later).select(*group, "a", "b", "order_a", "order_b")
    raise ValueError(f"unknown kind {kind!r}")


def coreported_pairs(df: DataFrame, report: str, item: str, min_count: int) -> DataFrame:
    """Unordered item pairs reported together at least ``min_count`` times, with the count.

    Items below ``min_count`` reports cannot be in such a pair and leave before the self join.
    """
    d = df.select(report, item).distinct()
    common = d.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_count).select(item)
    d = d.join(common, item, "left_semi")
    r = d.select(report, F.col(item).alias("item_b"))
    pairs = d.select(report, F.col(item).alias("item_a")).join(r, report).filter(F.col("item_a") < F.col("item_b"))
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def sharing_members(target: DataFrame, df: DataFrame, member: str, shared: Sequence[str]) -> DataFrame:
    """Members that share all ``shared`` values with a target member (substitutes of the same class and route).

    ``target`` lists the members asked about; the equi join is on the shared values.
    """
    d = df.select(member, *shared).dropna().distinct()
    t = d.join(target.select(member).distinct(), member, "left_semi").withColumnRenamed(member, "target")
    return t.join(d, list(shared)).filter(F.col("target") != F.col(member)).select("target", member).distinct()


def exact_match(df: DataFrame, treated: str, strata: Sequence[str], row_id: str, ratio: int = 1, seed: int = 0) -> DataFrame:
    """Up to ``ratio`` controls per treated row without replacement inside exact strata, in hash order.

    Ranks inside a stratum come from a sliced scan, so a stratum holding most rows is spread.
    """
    d = df.dropna(subset=list(strata)).select(row_id, treated, *strata).withColumn("_h", hash_order(row_id, seed=seed))
    d = scan(d, [*strata, treated], "_h", {"_rk": ("row_number", None)}, width=HASH_SPAN / _tasks(df), tie=[row_id])
    t = d.filter(F.col(treated) == 1).select(*strata, F.col(row_id).alias("treated_id"), F.col("_rk").alias("_slot"))
    c = d.filter(F.col(treated) == 0).select(*strata, F.col(row_id).alias("control_id"),
                                             F.ceil(F.col("_rk") / ratio).alias("_slot"))
    return t.join(c, [*strata, "_slot"]).select(*strata, "treated_id", "control_id")


def _tasks(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def closest_pairs(free: DataFrame, row_id: str, strata: Sequence[str], limit: float) -> DataFrame:
    """One-to-one pairs of rows of the two arms (``_arm`` 1 and 0) on the axis ``_x``, closest first, at most ``limit`` apart.

    In each round every free row looks at its nearest free neighbours of the other arm on the sorted axis; rows that
    choose each other are paired and leave.  Rounds end when no pair within the limit is left, which gives the greedy
    closest-first pairing whatever the size of a stratum.  Pairs come as (strata, t, c, d).
    """
    free = cut(free)
    done = None
    while True:
        spot = F.struct(F.col("_x").alias("x"), F.col(row_id).alias("id"))
        other = {f"_{way}{arm}": (kind, F.when(F.col("_arm") == arm, spot))
                 for arm in (0, 1) for way, kind in (("p", "prev_last"), ("n", "after_next"))}
        line = scan(free, strata, "_x", other, tie=[row_id])
        near = [F.when(F.col("_arm") == 1, F.col(f"_{w}0")).otherwise(F.col(f"_{w}1")) for w in "pn"]
        choices = [F.when(F.abs(n["x"] - F.col("_x")) <= limit,
                          F.struct(F.abs(n["x"] - F.col("_x")).alias("d"), n["id"].alias("id"))) for n in near]
        # order pairs by (distance, treated id, control id) so both arms agree on the closest pair
        def ranked(c):
            return F.when(c.isNotNull(), F.struct(
                c["d"].alias("d"), F.when(F.col("_arm") == 1, F.col(row_id)).otherwise(c["id"]).alias("t"),
                F.when(F.col("_arm") == 1, c["id"]).otherwise(F.col(row_id)).alias("c")))
        best = F.least(*[ranked(c) for c in choices])
        line = cut(line.select("*", best.alias("_best")).drop(*other))
        wish = line.filter(F.col("_best").isNotNull()).select(*strata, F.col("_arm"), "_best.*")
        t = wish.filter("_arm = 1").select(*strata, "t", "c", "d")
        c = wish.filter("_arm = 0").select("t", "c")
        mutual = cut(t.join(c, ["t", "c"], "left_semi"))
        done = mutual if done is None else done.unionByName(mutual)
        if mutual.isEmpty():
            return done
        used = mutual.select(F.explode(F.array("t", "c")).alias(row_id))
        free = cut(line.drop("_best").join(used, row_id, "left_anti"))


def caliper_match(df: DataFrame, row_id: str, treated: str, score: str, strata: Sequence[str] = (),
                  caliper_sd: float = 0.2) -> DataFrame:
    """1:1 nearest-neighbour matching on the logit of ``score`` without replacement within a caliper, closest pairs first.

    The caliper is ``caliper_sd`` population standard deviations of the logit.
    """
    p = F.col(score)
    free = df.select(row_id, *strata, F.col(treated).cast("int").alias("_arm"), F.log(p / (1 - p)).alias("_x"))
    free = cut(free.filter(F.col("_x").isNotNull()))
    sd = free.agg(F.stddev_pop("_x")).first()[0] or 0.0
    done = closest_pairs(free, row_id, strata, caliper_sd * sd)
    return done.select(*strata, F.col("t").alias("treated_id"), F.col("c").alias("control_id"), F.col("d").alias("distance"))


def align_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], counts: Sequence[str], min_n: int = 0,
                 how: str = "full", suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Two result tables side by side on ``keys``; missing counts become 0, rows under ``min_n`` on a side drop out."""
    def side(df, s):
        return df.select(*keys, *[F.col(c).alias(c + s) for c in df.columns if c not in keys])
    out = side(a, suffixes[0]).join(side(b, suffixes[1]), list(keys), how)
    out = out.fillna(0, subset=[c + s for c in counts for s in suffixes])
    for c in counts[:1] if min_n else []:
        out = out.filter((F.col(c + suffixes[0]) >= min_n) & (F.col(c + suffixes[1]) >= min_n))
    return out


def with_grid(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    """Every row once per value of a small literal grid (landmarks, thresholds, offsets)."""
    if len(values) > 10_000:
        raise ValueError("a grid this long belongs in a table with a join key")
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
