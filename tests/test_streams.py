"""Streams over five batches with late rows against plain Python that keeps the watermark itself."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest

from epiframe.streaming import online as O

DAY, HOUR = 86_400, 3600
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
DELAY = DAY


def feed(seed=3):
    """Five batches of (id, key, second): mostly in order, some late within the watermark, some far beyond it, one hot key."""
    rng = random.Random(seed)
    out = []
    for b in range(5):
        rows = [(b * 1000 + i, "hot" if rng.random() < 0.4 else rng.choice("abc"), int(b * 4 * DAY + rng.random() * 4 * DAY) + 1) for i in range(150)]
        if b:
            rows += [(b * 1000 + 500 + i, rng.choice(["hot", "a", "b"]), max(1, int(b * 4 * DAY - rng.random() * 0.8 * DAY))) for i in range(20)]
            rows += [(b * 1000 + 700 + i, rng.choice(["hot", "a", "b"]), max(1, int((b * 4 - 3) * DAY - rng.random() * DAY))) for i in range(20)]
        out.append(rows)
    return out


@pytest.fixture(scope="module")
def batches(spark):
    told = feed()
    return told, [spark.createDataFrame([(i, k, START + dt.timedelta(seconds=s)) for i, k, s in rows], "id long, key string, ts timestamp").repartition(3) for rows in told]


def seconds(t):
    return round((t.replace(tzinfo=dt.timezone.utc) - START).total_seconds()) if t.tzinfo is None else round((t - START).total_seconds())


def test_counts_drop_late_windows(batches):
    told, frames = batches
    rows = []
    # a window takes rows until the watermark has passed its end
    mark, top = 0, 0
    for b in told:
        rows += [r for r in b if (r[2] // DAY + 1) * DAY > mark]
        top = max([top, *[r[2] for r in b]])
        mark = max(mark, top - DELAY)
    want = defaultdict(int)
    for _, k, s in rows:
        want[k, s // DAY * DAY] += 1
    update = O.run_arrivals(frames, lambda d: O.stream_counts(d, ["key"], "ts", "1 day", "1 day"), "update", ["key", "window_start"])
    assert {(r.key, seconds(r.window_start)): r.n for r in update.collect()} == dict(want)
    append = O.run_arrivals(frames, lambda d: O.stream_counts(d, ["key"], "ts", "1 day", "1 day"), "append")
    assert {(r.key, seconds(r.window_start)): r.n for r in append.collect()} == {w: n for w, n in want.items() if w[1] + DAY <= mark}
    assert sum(want.values()) < sum(map(len, told))


def test_sessions_leave_when_closed(batches):
    told, frames = batches
    gap = 6 * HOUR
    open_, closed, mark, top = defaultdict(list), [], 0, 0
    for b in told:
        for _, k, s in b:
            # a row opens a session of its own, which is late if it ends before the watermark
            if s + gap > mark:
                span = [s, s, 1]
                for other in [o for o in open_[k] if o[0] <= span[1] + gap and span[0] <= o[1] + gap]:
                    open_[k].remove(other)
                    span = [min(span[0], other[0]), max(span[1], other[1]), span[2] + other[2]]
                open_[k].append(span)
        top = max([top, *[r[2] for r in b]])
        mark = max(mark, top - DELAY)
        for k in open_:
            closed += [(k, *o) for o in open_[k] if o[1] + gap <= mark]
            open_[k] = [o for o in open_[k] if o[1] + gap > mark]
    got = O.run_arrivals(frames, lambda d: O.stream_sessions(d, ["key"], "ts", "1 day", "6 hours"), "append")
    assert sorted((r.key, seconds(r.session_start), seconds(r.last_seen), r.n) for r in got.collect()) == sorted(closed)
    assert any(open_.values()) and len(closed) > 30


def test_dedupe_within_the_watermark(batches):
    _, frames = batches
    got = O.run_arrivals([*frames, frames[-1]], lambda d: O.stream_dedupe(d, ["id"], "ts", "30 days"), "append")
    ids = [r.id for r in got.collect()]
    assert len(ids) == len(set(ids)) == sum(f.count() for f in frames)


def brute_cusum(told, k, h):
    counts, mark, top = defaultdict(lambda: defaultdict(int)), 0, 0
    for b in told:
        for _, key, s in b:
            if s > mark and (s // DAY + 1) * DAY > mark:
                counts[key][s // DAY] += 1
        top = max([top, *[r[2] for r in b]])
        mark = max(mark, top - DELAY)
    out = {}
    for key, steps in counts.items():
        s = 0.0
        for day in range(min(steps), max(steps) + 1):
            if (day + 1) * DAY > mark:
                break
            s = max(0.0, s + steps.get(day, 0) - k)
            if s >= h:
                out[key] = (day * DAY, round(s, 6))
                break
    return out


@pytest.mark.parametrize("h", [4.0, 40.0, 1e9])
def test_cusum_sums_steps_before_the_statistic(batches, h):
    told, frames = batches
    got = O.run_arrivals(frames, lambda d: O.stream_cusum(d, "key", "ts", "1 day", DAY, 7.0, 2.0, h), "append").collect()
    assert {r.key: (seconds(r.signal_step), round(r.statistic, 6)) for r in got} == brute_cusum(told, 7.0 / math.log(2.0), h)
    assert len(got) == len({r.key for r in got})


def test_cusum_sums_a_column_like_rows(spark, batches):
    told, frames = batches
    weighed = [f.selectExpr("*", "2.0D AS x") for f in frames]
    got = O.run_arrivals(weighed, lambda d: O.stream_cusum(d, "key", "ts", "1 day", DAY, 14.0, 2.0, 8.0, "x"), "append").collect()
    assert {r.key: (seconds(r.signal_step), round(r.statistic / 2, 6)) for r in got} == brute_cusum(told, 7.0 / math.log(2.0), 4.0)


def test_arrivals_hold_every_row_once(spark):
    d = spark.createDataFrame([(i, START + dt.timedelta(seconds=i * 977)) for i in range(2000)], "id long, ts timestamp")
    slices = O.arrivals(d, "ts", 5, 18 * HOUR, "id")
    sizes = [s.count() for s in slices]
    assert sum(sizes) == 2000 and min(sizes) > 100
    top = 0
    for s in slices:
        times = [seconds(r.ts) for r in s.collect()]
        assert min(times) > top - DAY
        top = max([top, *times])
    assert sum(s.count() for s in O.arrivals(d.filter("false"), "ts", 5, HOUR, "id")) == 0
