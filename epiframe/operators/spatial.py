"""Region summaries, voxel assignment and spatial autocorrelation."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.blocks import met, packed
from ..plans.lineage import cut
from ..plans.ordered import quantiles, scan, value_ranks
from .permutations import permuted_means


def region_stats(points: DataFrame, label: str, value: str, min_n: int = 1, ignore=0, peak_share: float | None = None, coords: Sequence[str] = ()) -> DataFrame:
    """Mean, median, 5% and 95% points per region; optionally centroid and the share of rows above a fraction of the region's peak."""
    d = points.filter(F.col(label) != ignore)
    g = d.groupBy(label).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak"), *[F.avg(c).alias(f"centre_{c}") for c in coords]).filter(F.col("n") >= min_n)
    out = g.join(quantiles(d, [label], value, {"median": 0.5, "p05": 0.05, "p95": 0.95}), label)
    if peak_share is not None:
        above = d.join(g.select(label, "peak"), label).groupBy(label).agg(F.avg((F.col(value) >= peak_share * F.col("peak")).cast("double")).alias("share_above"))
        out = out.join(above, label)
    return out


def weighted_percentile(points: DataFrame, label: str, value: str, weight: str, p: float) -> DataFrame:
    """Smallest value at which the running weight reaches the share ``p`` of the region."""
    c = points.groupBy(label, value).agg(F.sum(weight).alias("w"))
    c = scan(c, [label], value, {"cum": ("sum", "w")}).join(points.groupBy(label).agg(F.sum(weight).alias("_t")), label)
    return c.groupBy(label).agg(F.min(F.when(F.col("cum") >= p * F.col("_t") - 1e-12, F.col(value))).alias("percentile"))


def spread_back(points: DataFrame, stats: DataFrame, label: str, stat: str) -> DataFrame:
    """Region statistic on every point of the region."""
    return points.join(stats.select(label, stat), label, "left")


def assign_voxels(points: DataFrame, coords: Sequence[str], resolution: float, lookup: DataFrame, region: str, midline: float) -> DataFrame:
    """Voxel index, region id (0 outside the lookup) and hemisphere of every point."""
    d = points.select("*", *[F.floor(F.col(c) / resolution).cast("bigint").alias(f"v{i}") for i, c in enumerate(coords)])
    d = d.join(lookup, [f"v{i}" for i in range(len(coords))], "left").fillna(0, [region])
    return d.withColumn("side", F.when(F.col(coords[0]) < midline, "left").otherwise("right"))


def region_counts(assigned: DataFrame, by: Sequence[str], region: str, lookup: DataFrame, resolution: float) -> DataFrame:
    """Points, share and density (per volume of the region's voxels) per group and region."""
    vol = lookup.groupBy(region).agg((F.count("*") * resolution ** 3).alias("_vol"))
    c = assigned.groupBy(*by, region).agg(F.count("*").alias("n"))
    t = assigned.groupBy(*by).agg(F.count("*").alias("_t")) if by else assigned.agg(F.count("*").alias("_t"))
    d = c.join(vol, region, "left")
    d = d.join(t, list(by)) if by else d.join(F.broadcast(t))
    return d.select(*by, region, "n", (F.col("n") / F.col("_t")).alias("share"), (F.col("n") / F.col("_vol")).alias("density"))


def nearest_neighbours(points: DataFrame, row_id: str, coords: Sequence[str], k: int, cell: float) -> DataFrame:
    """Exact ``k`` nearest other points of every point (ties by id), through grid tiles.

    Points of one place have the same neighbours but for themselves, so places look for their ``k + 1`` smallest (distance, id).  A tile is
    compared inside a task with the places in it and within a reach of a quarter of its width around it; only the nearest leave the task.  If
    the last distance is within reach nothing nearer can lie outside; the other places go on with doubled tiles.  The first width starts
    from ``cell`` and follows how many places a place finds in its tile.  Points without a full set of coordinates have no neighbours.
    """
    most = 20_000          # places of a tile that a task compares at once
    axes = [f"_x{c}" for c in range(len(coords))]
    base = points.select(F.col(row_id).alias("i"), *[F.col(c).cast("double").alias(a) for c, a in zip(coords, axes, strict=True)]).dropna()
    base = cut(base.filter(" AND ".join(f"abs({a}) < double('infinity')" for a in axes)))
    n = base.count()
    need = min(k + 1, n)
    first = base.withColumn("_r", F.row_number().over(Window.partitionBy(*axes).orderBy("i"))).filter(F.col("_r") <= need)
    places = cut(first.groupBy(*axes).agg(F.array_sort(F.collect_list("i")).alias("ids")).select(F.col("ids")[0].alias("p"), *axes, "ids"))

    def home(h):
        return [F.floor(F.col(a) / (4 * h)).alias(f"_t{c}") for c, a in enumerate(axes)]
    tile = [f"_t{c}" for c in range(len(axes))]

    def company(h):
        c = places.groupBy(*home(h)).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("s"), F.sum("c").alias("n"), F.count("*").alias("t")).first()
        return (c.s / c.n if c.n else 0.0), c.t
    h, left, done = float(cell), places.select("p", *axes), None
    mean, tiles = company(h)
    corners = 2 ** len(axes)           # tiles around the origin, which never become one
    grown = mean < 200 and tiles > corners
    for _ in range(40):
        if not (mean < 200 and tiles > corners if grown else mean > 2000):
            break
        h = h * 2 if grown else h / 2
        mean, tiles = company(h)
    result = T.StructType([T.StructField("p", base.schema["i"].dataType), T.StructField("j", base.schema["i"].dataType), T.StructField("d", T.DoubleType())])

    def compare(q: pa.Table, o: pa.Table) -> pa.Table:
        x, y = (np.column_stack([t.column(a).to_numpy() for a in axes]) if t.num_rows else np.zeros((0, len(axes))) for t in (q, o))
        ids = o.column("ids").combine_chunks()
        names = ids.flatten()
        start, many = np.asarray(ids.offsets)[:-1] - (np.asarray(ids.offsets)[0] if len(ids) else 0), np.diff(np.asarray(ids.offsets))
        order = np.argsort(names.to_numpy(zero_copy_only=False), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        out = []
        for at in range(0, len(x) if len(y) else 0, max(1, 2_000_000 // max(len(y), 1))):
            part = x[at:at + max(1, 2_000_000 // max(len(y), 1))]
            d = np.zeros((len(part), len(y)))
            for c in range(len(axes)):
                gap = part[:, c, None] - y[:, c]
                d += gap * gap
            np.sqrt(d, out=d)
            last = np.partition(d, min(need, len(y)) - 1, axis=1)[:, min(need, len(y)) - 1]
            row, col = np.nonzero(d <= last[:, None])
            times = many[col]
            own = np.repeat(start[col], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, far = np.repeat(row, times), np.repeat(d[row, col], times)
            by = np.lexsort((rank[own], far, row))
            row, far, own = row[by], far[by], own[by]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < need
            out.append((q.column("p").take(pa.array(row[keep] + at)), names.take(pa.array(own[keep])), far[keep]))
        kind = q.schema.field("p").type
        if not out:
            return pa.table({"p": pa.array([], kind), "j": pa.array([], kind), "d": pa.array([], pa.float64())})
        return pa.table({"p": pa.chunked_array([c for o in out for c in o[0].chunks], kind), "j": pa.chunked_array([o[1] for o in out], kind), "d": np.concatenate([o[2] for o in out])})

    while True:
        q = left.select("*", *home(h))
        o = places
        for c, a in enumerate(axes):
            side = lambda s: F.floor((F.col(a) + s * h * 1.000001) / (4 * h))  # noqa: E731, B023
            o = o.withColumn(f"_t{c}", F.explode(F.sequence(side(-1), side(1))))
        o = o.join(q.select(*tile).distinct(), tile, "left_semi")
        parts = o.groupBy(*tile).agg(F.ceil(F.count("*") / most).alias("_n"))
        q = q.join(parts, tile).withColumn("_q", F.pmod(F.xxhash64("p"), F.col("_n"))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).drop("_n")
        o = o.join(parts, tile).withColumn("_o", F.pmod(F.xxhash64("p"), F.col("_n"))).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).drop("_n")
        group = [*tile, "_q", "_o"]
        q, o = (t.toDF(*t.columns) for t in (q, o))          # columns of their own for the two sides
        near = q.groupBy(*group).cogroup(o.groupBy(*group)).applyInArrow(compare, result)
        near = near.groupBy("p").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "j"))), 1, need).alias("near"))
        part = cut(near.filter((F.size("near") >= need) & (F.element_at("near", need)["d"] <= h)))
        done = part if done is None else done.unionByName(part)
        left = cut(left.join(part, "p", "left_anti"))
        if not n or left.isEmpty():
            break
        h *= 2
    own = base.join(places.join(done, "p").select(*axes, "near"), axes).select("i", F.slice(F.filter("near", lambda r: r["j"] != F.col("i")), 1, max(min(k, n - 1), 0)).alias("near"))
    return own.select("i", F.inline("near")).select("i", "j", "d")


def morans_i(points: DataFrame, row_id: str, value: str, coords: Sequence[str], k: int = 8, cell: float = 1.0) -> DataFrame:
    """Moran's I with symmetrised binary nearest-neighbour weights."""
    nn = nearest_neighbours(points, row_id, coords, k, cell)
    sym = nn.select("i", "j").union(nn.select("j", "i")).distinct()
    z = points.select(F.col(row_id).alias("i"), F.col(value).cast("double").alias("v"))
    m = z.agg(F.avg("v").alias("_m"), F.count("*").alias("n"), (F.var_pop("v") * F.count("*")).alias("_ss"))
    z = z.join(F.broadcast(m)).select("i", (F.col("v") - F.col("_m")).alias("z"))
    s = sym.join(z, "i").join(z.select(F.col("i").alias("j"), F.col("z").alias("zj")), "j").agg(F.count("*").alias("w"), F.sum(F.col("z") * F.col("zj")).alias("_x"))
    return s.join(F.broadcast(m)).select("n", "w", (F.col("n") / F.col("w") * F.col("_x") / F.col("_ss")).alias("moran_i"))


def block_pairs(points: DataFrame, cols: Sequence[str], fn: Callable, schema: T.StructType) -> DataFrame:
    """Apply ``fn(a, b, same)`` to every two blocks of rows and return its small results.

    For statistics that truly need all distances: rows are packed into blocks of bounded size, each pair of blocks is one
    Arrow row, a task gets a few of them, and only sums leave it.  No row pairs are shuffled.
    """
    d = points.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    held, n = packed(d, points.count(), F.xxhash64(*cols), rows=F.array(*cols))
    held = held.withColumn("rows", F.flatten("rows"))
    j = met(held.withColumnRenamed("rows", "ra"), n, held.withColumnRenamed("rows", "rb"), n, upper=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values.to_numpy().reshape(-1, len(cols)) for c in (2, 3))
                yield pa.RecordBatch.from_pydict(fn(a, b, batch.column(0)[i].as_py() == batch.column(1)[i].as_py()))

    return j.select("a", "b", "ra", "rb").mapInArrow(run, schema)


def _tiles(a: np.ndarray, b: np.ndarray, k: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(distances, values of a, values of b) of the row pairs of two blocks, each pair of one block once, in tiles that stay in the cache."""
    bt = np.ascontiguousarray(b.T)
    step = max(1, 65_536 // max(len(b), 1))
    for at in range(0, len(a), step):
        x, y = a[at:at + step], bt[:, at + 1:] if same else bt
        d = np.zeros((len(x), y.shape[1]))
        for c in range(k):
            gap = x[:, c, None] - y[c]
            d += gap * gap
        np.sqrt(d, out=d)
        va, vb = np.broadcast_to(x[:, k, None], d.shape), np.broadcast_to(y[k], d.shape)
        if same:
            later = np.arange(d.shape[1]) >= np.arange(len(x))[:, None]
            yield d[later], va[later], vb[later]
        else:
            yield d.ravel(), va.ravel(), vb.ravel()


def _rim(points: DataFrame, cols: Sequence[str], coords: Sequence[str]) -> DataFrame:
    """The points that may be one of the two farthest.

    Extreme points along some directions give a distance that the largest one reaches.  A point whose distance from the centre and the
    farthest point's add up to less has no part in it.
    """
    d = points.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    centre = d.agg(*[F.avg(c).alias(c) for c in coords]).first()
    if centre[0] is None:
        return d
    away = F.sqrt(sum(((F.col(c) - F.lit(centre[c])) * (F.col(c) - F.lit(centre[c])) for c in coords), F.lit(0.0)))
    ways = [w for w in itertools.product((-1, 0, 1), repeat=len(coords)) if any(w)] if len(coords) <= 4 else [tuple(int(i == j) * s for j in range(len(coords))) for i in range(len(coords)) for s in (-1, 1)]
    ends = d.agg(F.max(away).alias("_far"), *[F.max_by(F.array(*coords), sum((F.col(c) * m for c, m in zip(coords, w, strict=True)), F.lit(0.0))).alias(f"_e{i}") for i, w in enumerate(ways)]).first()
    some = np.array([ends[f"_e{i}"] for i in range(len(ways))], float)
    reached = max(float(np.sqrt(((x - some) ** 2).sum(-1)).max()) for x in some)
    least = (reached - ends["_far"]) - 1e-9 * (abs(reached) + abs(ends["_far"]))
    return d.filter(away >= F.lit(least)) if np.isfinite(least) else d


def variogram(points: DataFrame, value: str, coords: Sequence[str], bins: int = 10, max_frac: float = 0.5) -> DataFrame:
    """Mean of 0.5 (x_i - x_j)^2 per distance bin up to a share of the largest distance; empty bins are left out."""
    k, cols = len(coords), [*coords, value]

    def widest(a, b, same):
        return {"m": [max((float(d.max()) for d, _, _ in _tiles(a, b, k, same) if len(d)), default=0.0)]}

    rim = cut(_rim(points, cols, coords))
    top = block_pairs(rim, cols, widest, T.StructType().add("m", "double")).agg(F.max("m")).first()[0]
    edge = (top or 0.0) * max_frac

    def sums(a, b, same):
        total = np.zeros((3, bins + 1))
        for d, va, vb in _tiles(a, b, k, same):
            if not len(d) or not edge:
                continue
            ix = np.minimum((d / edge * bins).astype(np.intp), bins - 1)
            ix[d >= edge] = bins       # a last bin for what lies too far
            gap = va - vb
            gap *= gap
            total += [np.bincount(ix, minlength=bins + 1), np.bincount(ix, gap, bins + 1), np.bincount(ix, d, bins + 1)]
        return {"bin": np.arange(bins, dtype=np.int32), "n": total[0, :bins].astype(np.int64), "s": 0.5 * total[1, :bins], "sd": total[2, :bins]}

    g = block_pairs(points, cols, sums, T.StructType().add("bin", "integer").add("n", "long").add("s", "double").add("sd", "double")).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("sd").alias("sd"))
    return g.filter("n > 0").select("bin", "n", (F.col("sd") / F.col("n")).alias("mean_distance"), (F.col("s") / F.col("n")).alias("gamma"))


def morans_i_distance(points: DataFrame, value: str, coords: Sequence[str]) -> DataFrame:
    """Moran's I with inverse-distance weights (coincident points get no weight)."""
    k, cols = len(coords), [*coords, value]
    m = points.agg(F.avg(value)).first()[0]

    def sums(a, b, same):
        w = x = 0.0
        for d, va, vb in _tiles(a, b, k, same):
            with np.errstate(divide="ignore"):
                near = 1 / d
            near[d == 0] = 0
            w += near.sum() * 2
            x += (near * ((va - m) * (vb - m))).sum() * 2
        return {"w": [w], "x": [x]}

    s = block_pairs(points, cols, sums, T.StructType().add("w", "double").add("x", "double")).agg(F.sum("w").alias("w"), F.sum("x").alias("x"))
    t = points.agg(F.count(value).alias("n"), (F.var_pop(value) * F.count(value)).alias("_ss"))
    return s.join(F.broadcast(t)).select("n", (F.col("n") / F.col("w") * F.col("x") / F.col("_ss")).alias("moran_i"))


def matched_set_enrichment(scores: DataFrame, item: str, score: str, member: str, match_on: str, bins: int, n: int, seed: int = 0) -> DataFrame:
    """Mean score of the set against random sets with the same number of items per quantile bin of ``match_on``.

    z and p = (1 + #>=) / (1 + n).  A random set is drawn over the counts of distinct scores in each bin (`permuted_sums`).
    """
    r = value_ranks(scores, [], match_on).select(F.col(match_on).cast("double").alias("_m"), "below")
    total = scores.filter(F.col(match_on).isNotNull()).agg(F.count("*").alias("_t"))
    d = scores.withColumn("_m", F.col(match_on).cast("double")).join(r, "_m").join(F.broadcast(total))
    d = d.select(F.col(score).alias("_v"), F.coalesce(F.col(member).cast("int"), F.lit(0)).alias("_in"), F.least(F.floor(F.col("below") * bins / F.col("_t")), F.lit(bins - 1)).cast("int").alias("_bin"))
    sums = permuted_means(d, ["_bin"], "_in", "_v", n, seed)
    null = sums.filter("rep > 0").select((F.col("sum") / F.when(F.col("count") > 0, F.col("count"))).alias("v"))
    seen = d.filter("_in = 1").agg(F.avg("_v").alias("observed"), F.count("*").alias("set_size"))
    j = null.join(F.broadcast(seen)).groupBy("observed", "set_size").agg(F.avg("v").alias("null_mean"), F.stddev_samp("v").alias("_sd"), ((1 + F.sum((F.col("v") >= F.col("observed")).cast("int"))) / (1 + F.count("*"))).alias("p"))
    return j.select("set_size", "observed", "null_mean", ((F.col("observed") - F.col("null_mean")) / F.col("_sd")).alias("z"), "p")
