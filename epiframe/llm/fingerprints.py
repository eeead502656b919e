"""Bottom-k fingerprints: the k smallest hashes of a text's byte shingles.

The sketch of a union is the bottom k of two sketches, so parts of a corpus merge in any order.  Two sketches estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import draws, mix, pieces

K = 128
#: Bytes in a shingle.
WIDTH = 12
#: Hashes have 48 bits, so that one takes eight letters of a fingerprint.
BITS = 48
_VALUES = draws(7, 256)


def _windows(data: bytes, width: int) -> np.ndarray:
    """Hash of each window of ``width`` bytes; a shorter text is one window, an empty one none."""
    if not data:
        return np.empty(0, np.uint64)
    width = min(width, len(data))
    values = _VALUES[np.frombuffer(data, np.uint8)]
    total, power = np.zeros(len(data) - width + 1, np.uint64), 1
    for j in range(width):
        total += values[j:len(data) - width + 1 + j] * np.uint64(power)
        power = power * 0x9E3779B97F4A7C15 % (1 << 64)
    return mix(total + np.uint64(width)) >> np.uint64(64 - BITS)


def bottom_k(data: bytes, k: int = K, width: int = WIDTH, block: int = 1 << 20) -> np.ndarray:
    """The ``k`` smallest distinct shingle hashes, ascending; long texts go through in overlapping blocks."""
    kept = np.empty(0, np.uint64)
    for start in range(0, max(1, len(data) - width + 1), block):
        h = _windows(data[start:start + block + width - 1], width)
        if len(h) > 8 * k:
            few = h[h < np.uint64((1 << BITS) // len(h) * 4 * k)]
            few = np.unique(few)
            h = few if len(few) >= k else h
        kept = np.unique(np.concatenate([kept, h]))[:k]
    return kept


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode() if len(sketch) else ""


def decode(fingerprint: str) -> np.ndarray:
    if not fingerprint:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").reshape(-1).astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_shingles(sketch: np.ndarray, k: int = K) -> float:
    """Exact below k hashes, else (k - 1) over the share of the hash range that the sketch spans."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * float(1 << BITS) / float(sketch[-1] + np.uint64(1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the bottom k of the union that lies in both; two empty sketches resemble each other fully."""
    union = merged(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty a is contained in anything."""
    size = distinct_shingles(a, k)
    return 1.0 if not size else min(1.0, resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / size)


_SKETCH_SQL = "doc_id long, n_chars long, fingerprint string, n_shingles double"


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, n_chars, fingerprint, estimated n_shingles of every whole text.

    A null text counts as empty and has the fingerprint ''; repeated rows and null identifiers pass through; other columns are
    not looked at.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                s = [bottom_k(x, k, width) for x in texts]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_chars": pa.array([len(x.decode()) for x in texts], pa.int64()), "fingerprint": [encode(x) for x in s], "n_shingles": [distinct_shingles(x, k) for x in s]})
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(work, _SKETCH_SQL)


def merge_sketches(sketches: DataFrame, by: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each value of ``by`` (null is a value): parts merge inside map tasks, then across them.

    A hot value leaves every map task as one sketch, so no task meets more sketches of it than there are map tasks.
    """
    import pandas as pd
    kind = sketches.schema[by].dataType.simpleString()

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for key, value in zip(f["by"].where(f["by"].notna(), None), f["s"].fillna(""), strict=True):
                s = decode(value)
                held[key] = merged(held[key], s, k) if key in held else s
            if len(held) > 20_000:
                yield pd.DataFrame({"by": list(held), "s": [encode(x) for x in held.values()]})
                held = {}
        yield pd.DataFrame({"by": list(held), "s": [encode(x) for x in held.values()]})

    def second(f: pd.DataFrame) -> pd.DataFrame:
        total = np.empty(0, np.uint64)
        for value in f["s"]:
            total = merged(total, decode(value), k)
        return pd.DataFrame({by: [f["by"].iloc[0]], "fingerprint": [encode(total)], "n_shingles": [distinct_shingles(total, k)]})

    parts = sketches.select(F.col(f"`{by}`").alias("by"), F.col(f"`{fingerprint}`").alias("s")).mapInPandas(first, f"by {kind}, s string")
    return parts.groupBy("by").applyInPandas(second, f"`{by}` {kind}, fingerprint string, n_shingles double")


_PAIRS_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _slot(rows: DataFrame, total: int, low: int | None, high: int | None, rows_per_slice: int) -> Column:
    """Number of the slice of an identifier, 0 for the largest: quantiles of the axis, each cut into equal lengths."""
    slices = max(math.ceil(total / rows_per_slice), 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = min(slices, 64)
    inner = sorted(set(rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []) - {low}, reverse=True)
    if low is None:
        return F.lit(0)
    each = math.ceil(slices / (len(inner) + 1))
    above = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in inner]), lambda c: c > F.col("doc_id"))) if inner else F.lit(0)
    ends = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), above + 1)
    top, bottom = ends([high, *inner]), ends([*inner, low])
    step = F.floor((top - F.col("doc_id").cast("double")) / F.greatest(top - bottom, F.lit(1.0)) * each)
    return F.when(F.col("doc_id").isNull(), F.lit((len(inner) + 1) * each)).otherwise(above * each + F.least(F.greatest(step, F.lit(0)), F.lit(each - 1))).cast("int")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH, rows_per_slice: int = 50_000) -> DataFrame:
    """Fingerprints of each text and of its edit by the next document, descending by identifier and round to the first.

    The edit replaces the last floor(n_chars / 2) code points by the first as many (or all) of the next text.  Texts are dealt
    once, by slices of the identifier axis; the first row of the following slice travels along, so that a task holds two
    documents at a time.  Rows that share an identifier follow each other by hash and bytes of their texts.  A null text counts
    as empty (its likeness to another empty text is 1); null identifiers come last.  A lone row is its own next document; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    total, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    if not total:
        return spark.createDataFrame([], _PAIRS_SQL)
    rows = rows.withColumn("slot", _slot(rows, total, low, high, rows_per_slice))
    heads = rows.groupBy("slot").agg(F.max("doc_id").alias("head"))                        # one row for each slice
    around = Window.orderBy("slot")
    heads = heads.select("head", F.coalesce(F.lag("slot").over(around), F.max("slot").over(Window.partitionBy())).alias("also"))
    halo = rows.select("doc_id", "text").join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("also").alias("slot"), F.lit(1).alias("halo"))
    dealt = rows.select("doc_id", "text", "slot", F.lit(0).alias("halo")).unionByName(halo)
    placed = dealt.repartition("slot").sortWithinPartitions("slot", "halo", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                for part, texts in pieces(batch, "text"):
                    yield from zip(part.column("doc_id").to_pylist(), part.column("slot").to_pylist(), part.column("halo").to_pylist(), texts, strict=True)
        out: list[list] = []
        held, size = None, 0
        for doc, slot, halo, body in stream():
            if halo and (held is None or held[1] != slot):
                continue
            whole = body.decode()
            sketch = bottom_k(body, k, width)
            if held is not None and held[1] == slot:
                d, _, text, old = held
                n = len(text)
                changed = (text[:n - n // 2] + whole[:n // 2]).encode()
                edited = bottom_k(changed, k, width)
                out.append([d, n, hashlib.sha256(changed).hexdigest(), encode(old), encode(edited), resemblance(old, edited, k), resemblance(old, sketch, k)])
                size += 1
            held = None if halo else (doc, slot, whole, sketch)
            if size >= 1000:
                yield _pairs(out)
                out, size = [], 0
        if out:
            yield _pairs(out)
    return placed.mapInArrow(work, _PAIRS_SQL)


def _pairs(rows: list[list]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
