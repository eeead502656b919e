"""Logged trajectories: transitions, empirical decision process, off-policy estimates and rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from ..plans.ordered import scan


def trajectories(grid: DataFrame, outcomes: DataFrame, key: str, step: str, state: str, action: str, died: str, min_len: int = 6, terminal: float = 1.0,
                 shaping: Mapping[str, tuple[float, float, float]] | None = None, tie: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """Transitions (state, action, reward, next state, done) of keys with at least ``min_len`` steps.

    The last step earns plus or minus ``terminal``; ``shaping`` subtracts a penalty per step outside [low, high].
    """
    n = grid.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_len)
    d = grid.join(n, key).join(outcomes.select(key, F.col(died).alias("_died")), key)
    d = scan(d, [key], step, {"t": ("row_number", None), "next_state": ("lead", state)}, width, tie)
    done = F.col("t") == F.col("_n")
    r = F.when(done, F.when(F.col("_died") == 1, -terminal).otherwise(terminal)).otherwise(0.0)
    for c, (lo, hi, pen) in (shaping or {}).items():
        r = r - F.when((F.col(c) < lo) | (F.col(c) > hi), pen).otherwise(0.0)
    return d.select(key, (F.col("t") - 1).alias("t"), F.col(state).alias("state"), F.col(action).alias("action"), r.alias("reward"), F.coalesce("next_state", F.col(state)).alias("next_state"), done.alias("done"))


def empirical_mdp(traj: DataFrame, n_states: int, n_actions: int) -> tuple[DataFrame, DataFrame]:
    """(state, action) table with visits, mean reward and terminal rate, and the non-terminal transition shares.

    Unvisited pairs get reward 0, terminal 1 and uniform next states.
    """
    spark = traj.sparkSession
    frame = spark.range(n_states * n_actions).select((F.col("id") / n_actions).cast("int").alias("state"), (F.col("id") % n_actions).cast("int").alias("action"))
    g = traj.groupBy("state", "action").agg(F.count("*").alias("n"), F.avg("reward").alias("reward"), F.avg(F.col("done").cast("double")).alias("terminal"))
    sa = frame.join(g, ["state", "action"], "left").select("state", "action", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("reward", F.lit(0.0)).alias("reward"), F.coalesce("terminal", F.lit(1.0)).alias("terminal"))
    c = traj.filter(~F.col("done")).groupBy("state", "action", "next_state").agg(F.count("*").alias("k"))
    t = c.groupBy("state", "action").agg(F.sum("k").alias("_t"))
    seen = c.join(t, ["state", "action"]).select("state", "action", "next_state", (F.col("k") / F.col("_t")).alias("p"))
    blank = frame.join(t, ["state", "action"], "left_anti").select("state", "action", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))).alias("next_state"), F.lit(1.0 / n_states).alias("p"))
    return sa, seen.unionByName(blank)


def behaviour_policy(traj: DataFrame, n_states: int, n_actions: int, alpha: float = 0.5) -> DataFrame:
    """Smoothed action frequencies per state."""
    frame = traj.sparkSession.range(n_states * n_actions).select((F.col("id") / n_actions).cast("int").alias("state"), (F.col("id") % n_actions).cast("int").alias("action"))
    c = traj.groupBy("state", "action").agg(F.count("*").alias("k"))
    t = traj.groupBy("state").agg(F.count("*").alias("_t"))
    d = frame.join(c, ["state", "action"], "left").join(t, "state", "left").fillna(0, ["k", "_t"])
    return d.select("state", "action", ((F.col("k") + alpha) / (F.col("_t") + alpha * n_actions)).alias("p"))


def importance_sampling(traj: DataFrame, key: str, target: DataFrame, behaviour: DataFrame, gamma: float = 1.0, kind: str = "wis", clip: float | None = None,
                        horizon: int | None = None) -> DataFrame:
    """Value of a target policy: ``wis`` (trajectory weights) or ``pdis`` (per step, weights carried on after termination), with the effective sample size.

    Policies are (state, action, p) tables.  A running product is a running sum of logarithms.
    """
    pe, pb = target.withColumnRenamed("p", "_e"), behaviour.withColumnRenamed("p", "_b")
    d = traj.join(pe, ["state", "action"], "left").join(pb, ["state", "action"], "left")
    rho = F.coalesce("_e", F.lit(0.0)) / F.greatest(F.coalesce("_b", F.lit(0.0)), F.lit(1e-12))
    if clip is not None:
        rho = F.least(rho, F.lit(float(clip)))
    d = d.withColumn("_log", F.log(F.greatest(rho, F.lit(1e-300)))).withColumn("_disc", F.pow(F.lit(float(gamma)), F.col("t")))
    if kind == "wis":
        g = d.groupBy(key).agg(F.exp(F.sum("_log")).alias("w"), F.sum(F.col("_disc") * F.col("reward")).alias("g"))
        return g.agg((F.sum(F.col("w") * F.col("g")) / F.sum("w")).alias("value"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.count("*").alias("n_traj"))
    d = scan(d, [key], "t", {"_cum": ("sum", "_log")}, 4096).withColumn("w", F.exp("_cum"))
    # the weight of an ended trajectory goes on at every later step: add its last weight once, at its end, and run along t
    per = d.groupBy("t").agg(F.sum("w").alias("_live"), F.sum(F.col("w") * F.col("reward")).alias("_wr"), F.sum(F.when(F.col("done"), F.col("w")).otherwise(0.0)).alias("_end"), F.first("_disc").alias("_disc"))
    per = scan(per, [], "t", {"_ended": ("prev_sum", "_end")}, 4096)
    value = per.agg(F.sum(F.col("_disc") * F.col("_wr") / (F.col("_live") + F.coalesce("_ended", F.lit(0.0)))).alias("value"))
    first = d.filter("t = 0").agg((F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.count("*").alias("n_traj"))
    return value.join(F.broadcast(first))


def doubly_robust(traj: DataFrame, key: str, target: DataFrame, behaviour: DataFrame, q: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Step-wise doubly robust value with a given (state, action, q) table."""
    v = target.join(q, ["state", "action"]).groupBy("state").agg(F.sum(F.col("p") * F.col("q")).alias("v"))
    d = (traj.join(target.withColumnRenamed("p", "_e"), ["state", "action"], "left").join(behaviour.withColumnRenamed("p", "_b"), ["state", "action"], "left")
         .join(q, ["state", "action"], "left").join(v, "state", "left").join(v.select(F.col("state").alias("next_state"), F.col("v").alias("_vn")), "next_state", "left"))
    rho = F.coalesce("_e", F.lit(0.0)) / F.greatest(F.coalesce("_b", F.lit(0.0)), F.lit(1e-12))
    d = scan(d.withColumn("_log", F.log(F.greatest(rho, F.lit(1e-300)))), [key], "t", {"_cum": ("sum", "_log")}, 4096)
    nxt = F.when(F.col("done"), 0.0).otherwise(F.col("_vn"))
    term = F.when(F.col("t") == 0, F.col("v")).otherwise(0.0) + F.pow(F.lit(float(gamma)), F.col("t")) * F.exp("_cum") * (F.col("reward") + gamma * nxt - F.col("q"))
    return d.groupBy(key).agg(F.sum(term).alias("x")).agg(F.avg("x").alias("value"), F.count("*").alias("n_traj"))


def policy_evaluation(sa: DataFrame, p: DataFrame, policy: DataFrame | None, gamma: float, tol: float = 1e-6, cut_every: int = 8) -> DataFrame:
    """Bellman sweeps on (state, action) tables: a given policy's values, or the best ones (``policy=None``).  Returns (state, v).

    Sweeps go on until no value moves by ``tol`` in one sweep; lineage is cut every ``cut_every`` sweeps, where the change is
    read.  ``gamma`` must be below 1, so the sweeps contract.  A next state without a row of its own is worth nothing.
    """
    if not 0 <= gamma < 1:
        raise ValueError("gamma must be at least 0 and below 1")
    base, move = written(sa), written(p)
    pi = None if policy is None else written(policy.select("state", "action", F.col("p").alias("_pi")))

    def sweep(v):
        nxt = move.join(v.withColumnRenamed("state", "next_state"), "next_state").groupBy("state", "action").agg(F.sum(F.col("p") * F.col("v")).alias("_x"))
        q = base.join(nxt, ["state", "action"], "left").withColumn("q", F.col("reward") + gamma * (1 - F.col("terminal")) * F.coalesce("_x", F.lit(0.0)))
        return q.groupBy("state").agg(F.max("q").alias("v")) if pi is None else q.join(pi, ["state", "action"]).groupBy("state").agg(F.sum(F.col("_pi") * F.col("q")).alias("v"))

    v = written(base.select("state").distinct().withColumn("v", F.lit(0.0)))
    while True:
        old = v
        for _ in range(cut_every):
            old = sweep(old)
        old = written(old)
        both = written(sweep(old).join(old.withColumnRenamed("v", "_o"), "state"))
        v = both.select("state", "v")
        gap = both.agg(F.max(F.abs(F.col("v") - F.col("_o")))).first()[0]
        if gap is None or gap < tol:
            return v


def initial_value(traj: DataFrame, values: DataFrame) -> DataFrame:
    """Mean value over the logged initial states."""
    return traj.filter("t = 0").join(values, "state").agg(F.avg("v").alias("value"), F.count("*").alias("n_traj"))


def action_rules(df: DataFrame, limits: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Add the list of violated rules per row; a NULL value breaks no rule."""
    out = []
    for c, (lo, hi) in limits.items():
        if hi is not None:
            out.append(F.when(F.col(c) > hi, F.lit(f"{c} high")))
        if lo is not None:
            out.append(F.when(F.col(c) < lo, F.lit(f"{c} low")))
    return df.withColumn("violations", F.array_compact(F.array(*out)))


def rule_rates(df: DataFrame) -> DataFrame:
    """Rows and share breaking each rule."""
    n = df.agg(F.count("*").alias("_n"))
    return df.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).join(F.broadcast(n)).select("rule", "n", (F.col("n") / F.col("_n")).alias("share"))


def allowed_actions(actions: DataFrame, ok: Column) -> DataFrame:
    """Actions that pass a static rule; all of them if none does, so an agent is never left without one."""
    d = actions.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    any_ok = d.agg(F.max(F.col("_ok").cast("int")).alias("_any"))
    return d.join(F.broadcast(any_ok)).withColumn("allowed", F.col("_ok") | (F.col("_any") == 0)).drop("_ok", "_any")


def policy_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Total variation distance of two policies per state."""
    d = a.withColumnRenamed("p", "_a").join(b.withColumnRenamed("p", "_b"), ["state", "action"], "full").fillna(0.0, ["_a", "_b"])
    return d.groupBy("state").agg((F.sum(F.abs(F.col("_a") - F.col("_b"))) / 2).alias("distance"))
