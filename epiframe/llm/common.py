"""Helpers shared by the operators: written lineage cuts, Arrow batches as bytes, hashes of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_dir

#: Texts are worked on in slices of about this many bytes, so that the arrays of a task stay small.
PIECE_BYTES = 1 << 20
GOLD = 0x9E3779B97F4A7C15


def cut(df: DataFrame, **options: int) -> DataFrame:
    """Write ``df`` (with further Parquet options) to the shared checkpoint folder and read it back: its lineage ends, its columns can be pruned."""
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the identifier as text, modulo ``divisor``; a null identifier counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(divisor)).cast("int")


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of ``batch`` with the bytes of ``column`` (null: empty); a slice holds one text or at most ``limit`` bytes."""
    values = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()), b"")
    sizes = pc.binary_length(values).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start), values.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start), values.slice(start).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads 64-bit values (wraps modulo 2^64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(GOLD))


_BYTE_VALUES = draws(11, 256)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b), np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes other than space and \\x09-\\x0D) and, per text, where its words begin in that array.

    Equal words have equal hashes everywhere; the array of borders has one entry more than there are texts.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    inner = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(buf) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_VALUES[buf] * power[:len(buf)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, begins)


def word_shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text; fewer words form one shingle, none give none."""
    words, at = word_hashes(texts)
    run = words.copy()
    for k in range(1, width):
        run = mix(run[:-1] * np.uint64(GOLD) + words[k:]) if len(run) > 1 else run[:0]
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(run[a:b - width + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix(h ^ w)
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out
