"""The online-shaped operators as Structured Streaming queries."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.lineage import checkpoint_dir


def stream_counts(events: DataFrame, key: Sequence[str], ts: str, watermark: str, size: str, step: str | None = None) -> DataFrame:
    """Counts per key and tumbling (or sliding) window; rows later than the watermark are dropped."""
    win = F.window(ts, size, step) if step else F.window(ts, size)
    g = events.withWatermark(ts, watermark).groupBy(*key, win.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*key, F.col("w.start").alias("window_start"), "n")


def stream_sessions(events: DataFrame, key: Sequence[str], ts: str, watermark: str, gap: str) -> DataFrame:
    """Sessions per key that close after ``gap`` without a row.  In append mode a session leaves, and its state with it, when the watermark passes its end."""
    g = events.withWatermark(ts, watermark).groupBy(*key, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_seen"))
    return g.select(*key, F.col("w.start").alias("session_start"), "last_seen", "n")


def stream_dedupe(events: DataFrame, keys: Sequence[str], ts: str, watermark: str) -> DataFrame:
    """The first arrival of each key within the watermark."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


class _Cusum(StatefulProcessor):
    """Open steps of a key and their sums until the watermark closes them, then the statistic; the state of a key is one value: its open steps and three numbers.

    Every call of the state is a message to the JVM, so a key reads and writes its value once a batch and has one timer, that of its first open step.
    """

    def __init__(self, key: str, ts: str, x: str | None, step: int, k: float, h: float):
        self.key, self.ts, self.x, self.step, self.k, self.h = key, ts, x, step, k, h

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "steps array<long>, sums array<double>, s double, at long, done boolean")

    def _load(self) -> tuple[dict[int, float], float, int | None, bool]:
        held = self.held.get()
        return (dict(zip(held[0], held[1], strict=True)), *held[2:]) if held is not None else ({}, 0.0, None, False)

    def _keep(self, steps: dict[int, float], s: float, last: int | None, done: bool) -> None:
        self.held.update((list(steps), list(steps.values()), s, last, done))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        steps, s, last, done = self._load()
        first = min(steps, default=None)
        added = False
        for chunk in rows:
            if done:
                continue
            step = chunk[self.ts].to_numpy().astype("datetime64[ms]").astype("int64") // self.step
            at, where = np.unique(step, return_inverse=True)
            sums = np.bincount(where, chunk[self.x].to_numpy(float, na_value=0.0) if self.x else None, len(at))
            for i, n in zip(at.tolist(), sums.tolist(), strict=True):
                if (i + 1) * self.step > closed:
                    steps[i] = steps.get(i, 0.0) + float(n)
                    added = True
        if added:
            if first is None or min(steps) < first:
                self.handle.registerTimer((min(steps) + 1) * self.step)
            self._keep(steps, s, last, done)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        steps, s, last, done = self._load()
        ready = sorted(at for at in steps if (at + 1) * self.step <= closed)
        for at in ready:
            n = steps.pop(at)
            if done:
                continue
            quiet = 0 if last is None else at - last - 1
            s, last = max(0.0, max(0.0, s - quiet * self.k) + n - self.k), at
            if s >= self.h:
                done = True
                yield pd.DataFrame({self.key: [key[0]], "signal_step": [pd.Timestamp(at * self.step, unit="ms", tz="UTC")], "statistic": [s]})
        if ready:
            # after its signal a key keeps no steps and needs no timer
            steps = {} if done else steps
            self._keep(steps, s, last, done)
            if steps:
                self.handle.registerTimer((min(steps) + 1) * self.step)

    def close(self) -> None:
        pass


def stream_cusum(events: DataFrame, key: str, ts: str, watermark: str, step: float, l0: float, multiplier: float, h: float, x: str | None = None) -> DataFrame:
    """Poisson CUSUM per key across micro-batches, over steps of ``step`` seconds; one row when a key first reaches ``h``: key, signal_step (its begin), statistic.

    A step counts rows (or sums ``x``) until the watermark passes its end; a timer of event time then adds it to the statistic, steps in order
    however rows arrive, steps without rows as zero.  Rows later than the watermark are dropped.  After its signal a key keeps one flag.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    k = l0 * (multiplier - 1) / math.log(multiplier)
    out = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField("signal_step", T.TimestampType()), T.StructField("statistic", T.DoubleType())])
    rows = events.select(key, ts, *([x] if x else [])).withWatermark(ts, watermark)
    return rows.groupBy(key).transformWithStateInPandas(_Cusum(key, ts, x, int(step * 1000), k, h), out, "Append", "EventTime")


def arrivals(df: DataFrame, ts: str, n: int, disorder: float, row_id: str) -> list[DataFrame]:
    """``df`` in ``n`` slices as it might arrive: each row up to ``disorder`` seconds after its time, by a hash of its identifier."""
    at = F.col(ts).cast("timestamp").cast("double") + F.pmod(F.xxhash64(row_id), F.lit(1 << 20)) * (float(disorder) / (1 << 20))
    low, high = df.agg(F.min(at), F.max(at)).first()
    width = ((high or 0.0) - (low or 0.0)) / n or 1.0
    place = F.least(F.floor((at - F.lit(low or 0.0)) / width), F.lit(n - 1))
    return [df.filter(place == i) for i in range(n)]


def run_arrivals(batches: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Feed ``batches`` one by one to the stream that ``build`` makes of them, each in a run of its own that goes on from the checkpoint of the last; the result as a table.

    What a run emits lies in a folder beside the checkpoints, which all executors share.  In ``update`` mode the last row of each of ``keys`` counts.
    """
    spark = batches[0].sparkSession
    home = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = None
    for i, batch in enumerate(batches):
        batch.write.parquet(f"{home}/in/a{i}")
        if stream is None:
            stream = build(spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{home}/in"))
        _run(stream, mode, home)
    return _emitted(stream, mode, home, keys)


def run_available(stream: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over what is there now and return its result as a table.

    Output goes to a folder beside the checkpoints, which all executors share.  In
    ``update`` mode a row may be written again by a later batch and the last one counts; in
    ``complete`` mode (session windows) the last batch holds the whole result.
    """
    home = f"{checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    _run(stream, mode, home)
    return _emitted(stream, mode, home, keys)


def _run(stream: DataFrame, mode: str, home: str) -> None:
    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{home}/out/part={number}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state")
         .trigger(availableNow=True).foreachBatch(keep).start())
    q.awaitTermination()


def _emitted(stream: DataFrame, mode: str, home: str, keys: Sequence[str]) -> DataFrame:
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    d = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{home}/out")
    if mode == "append":
        return d.drop("_batch")
    if mode == "complete":
        last = d.agg(F.max("_batch").alias("_last"))
        return d.join(F.broadcast(last)).filter(F.col("_batch") == F.col("_last")).drop("_batch", "_last")
    rest = [c for c in stream.columns if c not in keys]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
