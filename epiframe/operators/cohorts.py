"""Cohort rules and derived clinical labels on event tables and hourly grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import axis, near, range_pairs
from .joins import next_within

HOUR = 3600.0


def visit_cohort(visits: DataFrame, persons: DataFrame, children: DataFrame, admissions: DataFrame, critical: DataFrame, person: str, visit: str, start: str, end: str,
                 min_age: float, critical_h: float, revisit_h: float, width: float) -> DataFrame:
    """Visit table: age filter, child rows, admission flag, critical event within hours of the end, revisit, and the
    person's latest admission language where the visit has none.

    ``persons`` has (person, age); ``admissions`` (person, visit, admit_at, language); ``critical`` (person, at).
    """
    d = visits.join(persons, person).filter(F.col("age") >= min_age)
    n = children.groupBy(visit).agg(F.count("*").alias("n_children"))
    own = admissions.select(visit, F.col("language").alias("_own"), F.lit(1).alias("_adm"))
    latest = admissions.filter("language IS NOT NULL").groupBy(person).agg(F.max_by("language", F.struct("admit_at", visit)).alias("_latest"))
    window = d.select(person, visit, F.col(start).alias("_lo"), (axis(d, end) + critical_h * HOUR).alias("_hi"))
    hit = range_pairs(window, critical.select(person, "at"), [person], "_lo", "_hi", "at", width).select(visit).distinct().withColumn("_crit", F.lit(1))
    d = d.join(n, visit, "left").join(own, visit, "left").join(latest, person, "left").join(hit, visit, "left")
    d = next_within(d, [person], start, end, revisit_h, width, [visit])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return d.select(*visits.columns, "age", zero("n_children").alias("n_children"), zero("_adm").alias("admitted"), zero("_crit").alias("critical"), F.col("returned").alias("revisit"),
                    F.coalesce("_own", "_latest", F.lit("unknown")).alias("language"))


def cohort_from_spec(spec: Mapping, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Cohort of a declarative definition, and the rows left after each criterion; all are counted in one pass.

    ``spec``: ``unit`` (stay, visit or subject), ``criteria`` (list of dicts with ``kind``) and ``outcome``.  Tables: ``stays``
    (subject, visit, stay, start, end, age, unit, death), ``codes`` (visit, code), ``labs`` (stay, item, at).
    """
    stays = tables["stays"]
    names, s = ["start"], stays.withColumn("_at", F.lit(0))

    def passed(d: DataFrame, name: str, ok: Column) -> DataFrame:
        """``_at`` counts the criteria that a row has passed one after the other."""
        names.append(name)
        n = len(names) - 1
        return d.withColumn("_at", F.when((F.col("_at") == n - 1) & ok, n).otherwise(F.col("_at"))).select(*stays.columns, "_at")

    def found(d: DataFrame, hits: DataFrame, key: str) -> DataFrame:
        return d.join(hits.filter(F.col(key).isNotNull()).select(F.col(key)).distinct().withColumn("_hit", F.lit(True)), key, "left")

    def first_of(d: DataFrame, key: str) -> DataFrame:
        """Marks the earliest of each key's stays that have passed all criteria so far."""
        still = F.col("_at") == len(names) - 1
        return found(d, d.filter(still).groupBy(key).agg(F.min(F.struct("start", "stay")).alias("_f")).select(F.col("_f.stay").alias("stay")), "stay")

    for c in spec["criteria"]:
        kind = c["kind"]
        if kind == "age":
            s = passed(s, kind, F.col("age").between(c.get("min", 0), c.get("max", 200)))
        elif kind == "first_stay":
            s = passed(first_of(s, "subject"), kind, F.col("_hit").isNotNull())
        elif kind == "length":
            s = passed(s, kind, (axis(s, "end") - axis(s, "start")) / HOUR >= c["min_hours"])
        elif kind == "unit":
            s = passed(s, kind, F.col("unit").isin(list(c["values"])))
        elif kind in ("code_in", "code_out"):
            hits = tables["codes"].filter(F.col("code").rlike("^(?:" + "|".join(c["prefixes"]) + ")"))
            s = passed(found(s, hits, "visit"), kind, F.col("_hit").isNotNull() if kind == "code_in" else F.col("_hit").isNull())
        elif kind == "measured":
            lab = tables["labs"].filter(F.col("item") == c["item"]).join(stays.select("stay", F.col("start").alias("_s")), "stay")
            gap = (axis(lab, "at") - axis(lab, "_s")) / HOUR
            s = passed(found(s, lab.filter(gap.between(c.get("from_hours", 0), c["to_hours"])), "stay"), kind, F.col("_hit").isNotNull())
        elif kind == "survived":
            s = passed(s, kind, F.col("death").isNull() | ((axis(s, "death") - axis(s, "start")) / HOUR > c["hours"]))
        else:
            raise ValueError(f"unknown criterion {kind!r}")
    if spec.get("unit", "stay") != "stay":
        key = spec["unit"]
        s = passed(first_of(s, key), f"first per {key}", F.col("_hit").isNotNull())
    counts = s.agg(*[F.coalesce(F.sum((F.col("_at") >= i).cast("long")), F.lit(0)).alias(f"_n{i}") for i in range(len(names))])
    counts = counts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("criterion"), F.col(f"_n{i}").alias("n")) for i, name in enumerate(names)])))
    s = s.filter(F.col("_at") == len(names) - 1).drop("_at")
    outcome = spec.get("outcome", {"kind": "death"})
    if outcome["kind"] == "death":
        s = s.withColumn("outcome", F.col("death").isNotNull().cast("int"))
    elif outcome["kind"] == "long_stay":
        s = s.withColumn("outcome", ((axis(s, "end") - axis(s, "start")) / HOUR >= outcome["hours"]).cast("int"))
    elif outcome["kind"] == "return":
        s = next_within(s, ["subject"], "start", "end", outcome["hours"], None, ["stay"]).withColumnRenamed("returned", "outcome")
    else:
        raise ValueError(f"unknown outcome {outcome['kind']!r}")
    return s, counts


# Component thresholds (limit, points), the last satisfied one counts.
PLATELET_STEPS = [(150, 1), (100, 2), (50, 3), (20, 4)]
BILIRUBIN_STEPS = [(1.2, 1), (2.0, 2), (6.0, 3), (12.0, 4)]
COMA_STEPS = [(14, 1), (12, 2), (9, 3), (5, 4)]
CREATININE_STEPS = [(1.2, 1), (2.0, 2), (3.5, 3), (5.0, 4)]
RATIO_STEPS = [(400, 1), (300, 2)]


def _steps(c: Column, steps: Sequence[tuple[float, int]], side: str) -> Column:
    test = {"<": lambda v: c < v, "<=": lambda v: c <= v, ">=": lambda v: c >= v}[side]
    return F.when(c.isNull(), None).otherwise(F.greatest(F.lit(0), *[F.when(test(v), p).otherwise(0) for v, p in steps]))


def sofa(grid: DataFrame, key: Sequence[str], hour: str, assume_normal: bool = True, urine_hours: int = 24, require_full_urine: bool = False, block: int = 4096) -> DataFrame:
    """Six ordinal components and their total on an hourly grid.

    Columns used: pao2, fio2 (percent), vent, platelets, bilirubin, map, norepinephrine, epinephrine, gcs, creatinine,
    urine.  A missing component scores 0, or stays NULL with ``assume_normal=False`` (and makes the total NULL).
    """
    d = near(grid, key, hour, urine_hours - 1, 0, block, {"_uo": F.sum("urine"), "_un": F.count("urine")})
    uo = F.when(F.col("_un") >= urine_hours, F.col("_uo")) if require_full_urine else F.col("_uo")
    pf = F.col("pao2") / (F.col("fio2") / 100.0)
    vent = F.coalesce(F.col("vent"), F.lit(0)) > 0
    resp = F.when(pf.isNotNull(), F.greatest(_steps(pf, RATIO_STEPS, "<"), F.when((pf < 100) & vent, 4).when((pf < 200) & vent, 3).otherwise(0)))
    dose = F.greatest(F.coalesce("norepinephrine", F.lit(0.0)), F.coalesce("epinephrine", F.lit(0.0)))
    cardio = F.when(dose > 0.1, 4).when(dose > 0, 3).when(F.col("map").isNull(), None).when(F.col("map") < 70, 1).otherwise(0)
    cr, low = _steps(F.col("creatinine"), CREATININE_STEPS, ">="), F.when(uo < 200, 4).when(uo < 500, 3).when(uo.isNotNull(), 0)
    parts = {"respiratory": resp, "coagulation": _steps(F.col("platelets"), PLATELET_STEPS, "<"), "liver": _steps(F.col("bilirubin"), BILIRUBIN_STEPS, ">="),
             "cardiovascular": cardio, "nervous": _steps(F.col("gcs"), COMA_STEPS, "<="), "renal": F.greatest(cr, low)}
    cols = {k: (F.coalesce(v, F.lit(0)) if assume_normal else v) for k, v in parts.items()}
    out = d.select(*key, hour, *[v.alias(k) for k, v in cols.items()])
    return out.withColumn("sofa", sum((F.col(k) for k in parts), F.lit(0)))


def sepsis_onset(score: DataFrame, suspicion: DataFrame, key: str, hour: str, value: str, suspected: str, before: float = 48.0, after: float = 24.0,
                 baseline: str = "min_prior", delta: int = 2) -> DataFrame:
    """First hour in [suspicion - before, suspicion + after] whose score exceeds the baseline by ``delta``; NULL if none.

    Baselines: ``zero``; ``min_prior`` (lowest before the window, 0 if unobserved); ``min_window`` (lowest in the window's part before
    suspicion); ``first`` (the key's first score).  A key has one suspicion time, so the join is on the key and the rest is one aggregate.
    """
    d = score.join(suspicion.groupBy(key).agg(F.min(suspected).alias("_t")), key)
    h, t, v = F.col(hour), F.col("_t"), F.col(value)
    inside = (h >= t - before) & (h <= t + after)
    pick = {"zero": F.lit(0), "min_prior": F.coalesce(F.min(F.when(h < t - before, v)), F.lit(0)), "min_window": F.coalesce(F.min(F.when(inside & (h < t), v)), F.lit(0)),
            "first": F.min_by(value, F.when(v.isNotNull(), h))}[baseline]
    base = d.groupBy(key).agg(pick.alias("_base"))
    hit = F.when(inside & (v - F.col("_base") >= delta), h)
    return d.join(base, key).groupBy(key).agg(F.min(hit).alias("onset"), F.first("_base").alias("baseline"))


def kdigo(creatinine: DataFrame, key: Sequence[str], hours: str, value: str, strict_stage3: bool = True, window_h: float = 168.0, width: float = 1000.0) -> DataFrame:
    """Stage of every measurement: baseline = lowest in the previous ``window_h`` hours, else the key's first value; rise over 48 h.

    ``strict_stage3`` asks for a stage-1 rise before a value of 4.0 counts as stage 3.
    """
    d = near(creatinine, key, hours, window_h, 0.0, width, {"_low": F.min(value)}, (True, False))
    d = near(d, key, hours, 48.0, 0.0, width, {"_low48": F.min(value)}, (True, False))
    first = creatinine.groupBy(*key).agg(F.min_by(value, F.struct(hours, value)).alias("_first"))
    d = d.join(first, list(key))
    v, base = F.col(value), F.coalesce("_low", "_first")
    rise, ratio = v - F.coalesce("_low48", v), F.when(base > 0, v / base).otherwise(1.0)
    one = (rise >= 0.3) | (ratio >= 1.5)
    three = (ratio >= 3.0) | ((v >= 4.0) & one if strict_stage3 else (v >= 4.0))
    return d.select(*creatinine.columns, base.alias("baseline"), F.when(three, 3).when(ratio >= 2.0, 2).when(one, 1).otherwise(0).alias("stage"))


def oliguria(grid: DataFrame, key: Sequence[str], hour: str, urine: str, weight: str, hours: int = 6, limit: float = 0.5, block: int = 4096) -> DataFrame:
    """Grid hours whose complete trailing window has less than ``limit`` per weight and hour."""
    d = near(grid, key, hour, hours - 1, 0, block, {"_s": F.sum(urine), "_n": F.count(urine)})
    return d.withColumn("oliguria", F.coalesce((F.col("_n") >= hours) & (F.col("_s") / (hours * F.col(weight)) < limit), F.lit(False))).drop("_s", "_n")


def horizon_label(event: Column, pred: Column | float, horizon: float, exclude_prior: bool = False) -> Column:
    """1 if the event lies in (pred, pred + horizon]; an earlier event gives 0, or NULL with ``exclude_prior``."""
    p = F.lit(float(pred)) if not isinstance(pred, Column) else pred
    y = F.when((event > p) & (event <= p + horizon), 1).otherwise(0)
    return F.when(event <= p, None).otherwise(y) if exclude_prior else y


def incident_outcome(index: DataFrame, labs: DataFrame, key: Sequence[str], index_id: str, index_at: str, at: str, value: str, baseline_s: float, window_s: float,
                     normal: tuple[float, float], above: float | None = None, drop: float | None = None, multiple: float | None = None, width: float = 1e7) -> DataFrame:
    """Baseline, follow-up and first breach per index row.

    Baseline = last value in (index - b, index]; follow-up = (index, index + w].  A breach is a value above a limit, a fall by the
    share ``drop``, or ``multiple`` times baseline.  Rows without a normal baseline or follow-up value are not eligible.
    """
    x = index.select(*key, index_id, axis(index, index_at).alias("_i")).withColumn("_lo", F.col("_i") - baseline_s).withColumn("_hi", F.col("_i") + window_s)
    got = range_pairs(x, labs.select(*key, axis(labs, at).alias("_t"), F.col(value).alias("_v")), key, "_lo", "_hi", "_t", width).filter(F.col("_t") > F.col("_lo"))
    pre = F.col("_t") <= F.col("_i")
    base = got.groupBy(index_id).agg(F.max_by("_v", F.when(pre, F.struct("_t", "_v"))).alias("baseline"), F.sum(F.when(pre, 0).otherwise(1)).alias("n_follow"))
    post = got.filter(~pre).join(base.select(index_id, "baseline"), index_id)
    v, b = F.col("_v"), F.col("baseline")
    breach = F.lit(False)
    if above is not None:
        breach = breach | (v > above)
    if drop is not None:
        breach = breach | F.coalesce(v <= (1 - drop) * b, F.lit(False))
    if multiple is not None:
        breach = breach | F.coalesce(v >= multiple * b, F.lit(False))
    hit = post.groupBy(index_id).agg(F.min(F.when(breach, F.col("_t"))).alias("event_s"))
    d = index.join(base, index_id, "left").join(hit, index_id, "left")
    ok = F.coalesce(F.col("baseline").between(*normal), F.lit(False))
    n = F.coalesce("n_follow", F.lit(0))
    return d.select(*index.columns, "baseline", n.alias("n_follow"), "event_s", F.col("event_s").isNotNull().cast("int").alias("outcome"), (ok & (n > 0)).alias("eligible"))


def boluses(inputs: DataFrame, key: Sequence[str], row_id: str, start: str, end: str, amount: Column, min_ml: float = 250.0, max_min: float = 30.0, pre_min: float = 60.0,
            post_min: float = 30.0, width: float = 86400.0) -> DataFrame:
    """Fast large volumes; ``isolated`` when no other one starts within [start - pre, end + post]."""
    d = inputs.withColumn("amount_ml", amount).withColumn("minutes", (axis(inputs, end) - axis(inputs, start)) / 60)
    d = d.filter((F.col("amount_ml") >= min_ml) & F.col("minutes").between(0, max_min))
    probe = d.select(*key, F.col(row_id).alias("_me"), (axis(d, start) - pre_min * 60).alias("_lo"), (axis(d, end) + post_min * 60).alias("_hi"))
    n = range_pairs(probe, d.select(*key, F.col(start).alias("_os")), key, "_lo", "_hi", "_os", width).groupBy("_me").agg(F.count("*").alias("_n"))
    return d.join(n, F.col(row_id) == F.col("_me"), "left").withColumn("isolated", F.coalesce(F.col("_n"), F.lit(0)) <= 1).drop("_me", "_n")


def sham_windows(bolus: DataFrame, candidates: DataFrame, key: Sequence[str], bolus_id: str, start: str, at: str, level: str, tol: float, min_gap_s: float, seed: int = 0,
                 width: float = 86400.0) -> DataFrame:
    """One pseudo-event per bolus: a candidate time of the same key at least ``min_gap_s`` from every real bolus, with a similar level.

    Candidates near a bolus leave by a range anti-join.  Of the rest, those whose level rounds into a neighbouring cell are
    compared, and the first in hash order is taken.
    """
    near_real = bolus.select(*key, (axis(bolus, start) - min_gap_s).alias("_lo"), (axis(bolus, start) + min_gap_s).alias("_hi"))
    c = candidates.select(*key, F.col(at).alias("sham_at"), F.col(level).alias("sham_level")).dropna().distinct()
    bad = range_pairs(near_real, c.select(*key, "sham_at"), key, "_lo", "_hi", "sham_at", width).filter(
        (axis(c, "sham_at") > F.col("_lo")) & (axis(c, "sham_at") < F.col("_hi"))).select(*key, "sham_at").distinct()
    c = c.join(bad, [*key, "sham_at"], "left_anti").withColumn("_cell", F.floor(F.col("sham_level") / tol))
    b = bolus.select(*key, bolus_id, F.col(level).alias("_lv")).dropna(subset=["_lv"])
    b = b.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("_lv") - tol) / tol), F.floor((F.col("_lv") + tol) / tol))))
    j = b.join(c, [*key, "_cell"]).filter(F.abs(F.col("_lv") - F.col("sham_level")) <= tol)
    order = F.struct(F.xxhash64(F.lit(seed), bolus_id, "sham_at").alias("h"), "sham_at", "sham_level")
    return j.groupBy(*key, bolus_id).agg(F.min(order).alias("_b")).select(*key, bolus_id, "_b.sham_at", "_b.sham_level")


def doses(infusions: DataFrame, given: DataFrame, columns: Mapping[str, str], default_minutes: float, administered: Sequence[str], to_mg: Mapping[str, float]) -> DataFrame:
    """Two dose sources in one schema (subject, drug, start, mg, minutes, imputed, source).

    Infusions carry start and end; given doses carry an event name and an optional rate (amount per hour).  Unknown units give no dose.
    """
    c = columns
    mg = lambda a, u: F.col(a) * F.create_map(*[F.lit(x) for kv in to_mg.items() for x in (kv[0], float(kv[1]))])[F.lower(F.col(u))]
    minutes = (axis(infusions, c["end"]) - axis(infusions, c["start"])) / 60
    a = infusions.select(F.col(c["subject"]).alias("subject"), F.col(c["drug"]).alias("drug"), F.col(c["start"]).alias("start"), mg(c["amount"], c["unit"]).alias("mg"),
                         minutes.alias("minutes"), F.lit(False).alias("imputed"), F.lit("infusion").alias("source")).filter("minutes >= 0")
    run = F.when(F.col(c["rate"]) > 0, 60 * F.col(c["amount"]) / F.col(c["rate"]))
    b = given.filter(F.col(c["event"]).isin(list(administered))).select(
        F.col(c["subject"]).alias("subject"), F.col(c["drug"]).alias("drug"), F.col(c["start"]).alias("start"), mg(c["amount"], c["unit"]).alias("mg"),
        F.coalesce(run, F.lit(float(default_minutes))).alias("minutes"), run.isNull().alias("imputed"), F.lit("given").alias("source"))
    return a.unionByName(b).filter(F.col("mg") > 0)


def window_states(timeline: DataFrame, stays: DataFrame, stay: str, at: str, kind: str, value: str, start: str, end: str, hours: float, death: str | None = None) -> DataFrame:
    """State of every fixed window of a stay and one terminal row.

    ``kind`` is ``screen`` (positive, negative, unable) or ``sedation`` (a number).  Delirium if any positive, else normal if any
    negative, else coma if any unable or all sedation values <= -4, else unscreened.
    """
    span = hours * HOUR
    n = F.greatest(F.ceil((axis(stays, end) - axis(stays, start)) / span), F.lit(1)).cast("bigint")
    frame = stays.select(stay, F.col(start).alias("_s"), n.alias("_n"), (F.col(death) if death else F.lit(None).cast("timestamp")).alias("_d"), F.col(end).alias("_e"))
    w = frame.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))).alias("window"))
    t = timeline.join(frame.select(stay, "_s", "_n"), stay)
    t = t.withColumn("window", F.floor((axis(timeline, at) - t["_s"].cast("timestamp").cast("double")) / span)).filter((F.col("window") >= 0) & (F.col("window") < F.col("_n")))
    screen, sed = F.col(kind) == "screen", F.when(F.col(kind) == "sedation", F.col(value).try_cast("double"))
    g = t.groupBy(stay, "window").agg(F.max(F.when(screen & (F.col(value) == "positive"), 1)).alias("pos"), F.max(F.when(screen & (F.col(value) == "negative"), 1)).alias("neg"),
                                      F.max(F.when(screen & (F.col(value) == "unable"), 1)).alias("uta"), F.max(sed).alias("deepest"), F.count(sed).alias("n_sedation"), F.sum(screen.cast("int")).alias("n_screen"))
    last = F.col("window") == F.col("_n")
    died = F.col("_d").cast("timestamp").cast("double") <= F.col("_e").cast("timestamp").cast("double") + span
    state = (F.when(last, F.when(F.coalesce(died, F.lit(False)), "dead").otherwise("discharged")).when(F.col("pos") == 1, "delirium").when(F.col("neg") == 1, "normal")
             .when((F.col("uta") == 1) | (F.col("deepest") <= -4), "coma").otherwise("unscreened"))
    return w.join(g, [stay, "window"], "left").select(stay, "window", state.alias("state"), F.coalesce("n_screen", F.lit(0)).alias("n_screen"), F.coalesce("n_sedation", F.lit(0)).alias("n_sedation"))


def free_days(windows: DataFrame, stay: str, hours: float, days: int) -> DataFrame:
    """Days without delirium or coma: normal and unscreened windows and time after discharge count, death inside the horizon gives 0."""
    per = 24 / hours
    total = int(days * per)
    d = windows.filter(F.col("window") < total)
    live = ~F.col("state").isin("dead", "discharged")
    g = d.groupBy(stay).agg(F.max((F.col("state") == "dead").cast("int")).alias("died"), F.sum(F.col("state").isin("normal", "unscreened").cast("int")).alias("_f"), F.sum(live.cast("int")).alias("_n"))
    return g.select(stay, F.when(F.col("died") == 1, 0.0).otherwise((F.col("_f") + F.greatest(total - F.col("_n"), F.lit(0))) / per).alias("free_days"), (F.col("died") == 1).alias("died"))


def order_features(long: DataFrame, stays: DataFrame, stay: str, t: str, item: str, value: str, items: Sequence, window: float, hour_of_day: Column, stat: Column,
                   delay: Column, morning: tuple[float, float] = (4.0, 8.0)) -> DataFrame:
    """Per item last/mean/min/max, counts, any, hours since, urgent and off-schedule counts; pending results count but give no values."""
    lo, hi = morning
    d = long.filter(F.col(t).between(0, window)).withColumn("_stat", stat).withColumn("_off", ~((hour_of_day >= lo) & (hour_of_day < hi) & ~stat)).withColumn("_late", F.col(t) + F.coalesce(delay, F.lit(0.0)) > window)
    aggs = []
    for it in items:
        mine = (F.col(item) == it) & ~F.col("_late")
        v = F.when(mine, F.col(value))
        last = F.max_by(value, F.when(mine, F.struct(t, value)))
        n = F.sum(mine.cast("int"))
        aggs += [last.alias(f"{it}_last"), F.avg(v).alias(f"{it}_mean"), F.min(v).alias(f"{it}_min"), F.max(v).alias(f"{it}_max"), n.alias(f"{it}_n"), (window - F.max(F.when(mine, F.col(t)))).alias(f"{it}_hrs_since"),
                 F.sum((mine & F.col("_stat")).cast("int")).alias(f"{it}_n_stat"), F.sum((mine & F.col("_off")).cast("int")).alias(f"{it}_n_off"),
                 F.sum(((F.col(item) == it) & F.col("_late")).cast("int")).alias(f"{it}_pending")]
    g = stays.select(stay).join(d.groupBy(stay).agg(*aggs), stay, "left")
    counts = [f"{it}_{s}" for it in items for s in ("n", "n_stat", "n_off", "pending")]
    return g.fillna(0, counts).fillna(float(window), [f"{it}_hrs_since" for it in items])


def mistriage(df: DataFrame, acuity: str, critical: Column, admitted: Column, resource_variant: bool = False) -> DataFrame:
    """Under- and over-triage flags with their denominators."""
    a = F.col(acuity)
    under = (a >= 3) & critical
    if resource_variant:
        under = under | ((a >= 4) & admitted)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return (df.withColumn("under_triage", flag(under)).withColumn("over_triage", flag((a <= 2) & ~critical & ~admitted))
            .withColumn("eligible_under", flag(critical)).withColumn("eligible_over", flag(~critical & ~admitted)))


def exam_table(reports: DataFrame, details: DataFrame, report: str, ordered: str, stored: str, field: str, value: str, fields: Sequence[str], max_days: float = 7.0) -> DataFrame:
    """Turnaround hours with quarantine and auto-store flags, key-value details as columns."""
    wide = details.groupBy(report).agg(*[F.max(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields])
    tat = (axis(reports, stored) - axis(reports, ordered)) / HOUR
    bad = F.col(stored).isNull() | (tat < 0) | (tat > 24 * max_days)
    return reports.join(wide, report, "left").withColumn("tat_h", tat).withColumn("auto_stored", F.coalesce(tat == 0, F.lit(False))).withColumn("quarantine", bad)


def index_exam(exams: DataFrame, stay: str, kind: str, at: str, row_id: str, priority: Sequence[str]) -> DataFrame:
    """One exam per stay: highest priority kind, then earliest."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(kind)), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    rest = [c for c in exams.columns if c != stay]
    return exams.groupBy(stay).agg(F.min_by(F.struct(*rest), F.struct(rank.alias("r"), at, row_id)).alias("_b")).select(stay, "_b.*")
