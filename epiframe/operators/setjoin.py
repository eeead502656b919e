"""Exact similarity search over sets of shingles: prefix filter on the rarest shingles, length and position bounds, blocks of split groups.

Two sets of Jaccard similarity t or more must share a shingle among the first n - ceil(t n) + 1 of each, in any order of all shingles; with the
rarest first, few other sets do.  Sets that share fewer shingles with anyone than t asks for leave at once.  The rest is dealt
into blocks by the first shingle that they share, a hot one into several, so that like sets lie together.  Prefix shingles
link blocks, not sets: a block tells its shortest and longest set and how much can follow the shingle, and two blocks whose bounds allow
no pair are not linked.  Linked blocks meet in one task, where every pair is decided on whole sets.  The sets of a
shingle meet once, packed, to be counted; their pairs are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .text import word_shingles

#: Shingles of the sets of one block, about; a single larger set is a block of its own.
BLOCK_SHINGLES = 200_000
#: Shingles of a bucket where shared ones are found, about; 2 to this power classes of neighbouring numbers are a chunk; the bits of a shingle that say its bucket.
BUCKET_SHINGLES, CHUNK_BITS, LOW = 1_000_000, 11, (1 << 24) - 1


def _hashed(shingles: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(shingles, F.array().cast("array<string>")), lambda s: F.xxhash64(s))))


def _mark(hashes: str) -> Column:
    """128 bits that stand for a set."""
    return F.concat(F.hex(F.xxhash64(F.lit(1), hashes)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), hashes)))


def set_classes(docs: DataFrame, row_id: str, shingles: Column) -> tuple[DataFrame, DataFrame]:
    """(members, classes): row_id and mark of every row, and per class (rows of equal sets) its mark, a number cid, class_id (smallest row_id), n_rows, n and the sorted set.

    ``shingles`` is an array of strings; its distinct values become 64-bit hashes.  Empty sets are one class.
    """
    d = docs.select(F.col(row_id).alias("row_id"), _hashed(shingles).alias("set")).withColumn("mark", _mark("set"))
    classes = written(d.groupBy("mark").agg(F.min("row_id").alias("class_id"), F.count("*").alias("n_rows"), F.min_by("set", "row_id").alias("set")).withColumn("n", F.size("set")).withColumn("cid", F.monotonically_increasing_id()))
    return d.select("row_id", "mark"), classes


def _dealt(buckets: int):
    """Packs the shingles of each chunk of classes by bucket, as 40 bits and the place of the class in its chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, sets = b.column(0).to_numpy(), b.column(1)
            flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(cid, sets.value_lengths().to_numpy(zero_copy_only=False))
            bucket = (flat & np.uint64(LOW)) % np.uint64(buckets)
            for chunk in np.unique(owner >> CHUNK_BITS):
                here = np.flatnonzero(owner >> CHUNK_BITS == chunk)
                here = here[np.argsort(bucket[here], kind="stable")]
                some, first = np.unique(bucket[here], return_index=True)
                places = (owner[here] & ((1 << CHUNK_BITS) - 1)).astype("<u2")
                ends = [*first[1:].tolist(), len(here)]
                keys = _bytes(flat[here] >> np.uint64(24))
                pieces = list(zip(first.tolist(), ends, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk)), pa.array([keys[i:j].tobytes() for i, j in pieces], pa.binary()), pa.array([places[i:j].tobytes() for i, j in pieces], pa.binary())],
                                                 names=["bucket", "chunk", "keys", "places"])
    return run


def _bytes(keys: np.ndarray) -> np.ndarray:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, place) of all entries of packed rows."""
    raw = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.uint8).reshape(-1, 5)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :5] = raw
    places = np.frombuffer(b"".join(rows.column("places").to_pylist()), "<u2")
    lengths = pc.binary_length(rows.column("places")).to_numpy() // 2
    return np.repeat(np.arange(rows.num_rows), lengths), keys.view("<u8").ravel(), places


def _counted(rows: pa.Table) -> pa.Table:
    """What of a bucket's shingles is in several sets, packed as it came, with the number of sets (65,535 for more)."""
    row, keys, places = _unpacked(rows)
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    c = np.minimum(count[at], 65_535)
    kept = np.flatnonzero(c > 1)
    some, first = np.unique(row[kept], return_index=True)
    pieces = list(zip(first.tolist(), [*first[1:].tolist(), len(kept)], strict=True))
    packed, places, c = _bytes(keys[kept]), places[kept], c[kept].astype("<u2")
    return pa.table([rows.column("bucket").take(pa.array(some)), rows.column("chunk").take(pa.array(some)), *[pa.array([x[i:j].tobytes() for i, j in pieces], pa.binary()) for x in (packed, places, c)]],
                    names=["bucket", "chunk", "keys", "places", "counts"])


def _prefixes(t: float):
    """(cid, n, number of shared shingles, those of the prefix) of a chunk's classes that share enough."""
    def run(rows: pa.Table, sizes: pa.Table) -> pa.Table:
        row, keys, place = _unpacked(rows)
        c = np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<u2")
        h = (keys << np.uint64(24)) | rows.column("bucket").to_numpy().astype(np.uint64)[row]
        order = np.lexsort([h, c, place])
        h, place = h[order].view(np.int64), place[order].astype(np.int64)
        cid, n = sizes.column("cid").to_numpy(), sizes.column("n").to_numpy().astype(np.int64)
        at = cid & ((1 << CHUNK_BITS) - 1)
        shared = np.bincount(place, minlength=1 << CHUNK_BITS)
        needed = np.ceil(t * n - 1e-9).astype(np.int64)
        good = np.flatnonzero((shared[at] >= needed) & (shared[at] > 0))
        length = np.zeros(1 << CHUNK_BITS, np.int64)
        length[at[good]] = np.minimum(shared[at] - needed + 1, shared[at])[good]
        good = good[np.argsort(at[good])]
        rank = np.arange(len(place)) - (np.cumsum(shared) - shared)[place]
        flat = pa.array(h[rank < length[place]])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length[at[good]])]), pa.int32()), flat)
        return pa.table([pa.array(cid[good]), pa.array(n[good], pa.int32()), pa.array(shared[at[good]], pa.int32()), lists], names=["cid", "n", "shared", "first"])
    return run


def _blocks(classes: DataFrame, t: float, limit: int) -> DataFrame:
    """Classes that can have a partner: with their prefix (shingle, shingles from there on) and a block.

    All shingles are dealt out once, packed by chunk of classes: a shingle costs seven bytes, and what comes back are the shared ones.  A shingle
    is known here by 40 bits and its bucket; two that agree in these count as one, which only lets more sets meet.  A task holds a bucket: about `BUCKET_SHINGLES`, and one entry of each class for a shingle that all have.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = min(LOW, max(1, math.ceil(total / BUCKET_SHINGLES)))
    packed = classes.select("cid", "set").mapInArrow(_dealt(buckets), "bucket int, chunk long, keys binary, places binary")
    shared = packed.groupBy("bucket").applyInArrow(_counted, "bucket int, chunk long, keys binary, places binary, counts binary")
    sizes = classes.select("cid", "n", F.shiftright("cid", CHUNK_BITS).alias("of"))
    d = shared.groupBy("chunk").cogroup(sizes.groupBy("of")).applyInArrow(_prefixes(t), "cid long, n int, shared int, first array<long>")
    prefix = F.transform("first", lambda h, i: F.struct(h.alias("h"), (F.col("shared") - i).alias("rest")))
    d = written(d.select("cid", "n", prefix.alias("prefix")).withColumn("lead", F.col("prefix")[0]["h"]))
    parts = d.groupBy("lead").agg(F.ceil(F.sum("n") / limit).cast("int").alias("parts"))
    return d.join(parts, "lead").withColumn("block", F.xxhash64("lead", F.pmod(F.xxhash64("cid"), F.col("parts")))).select("cid", "n", "prefix", "block")


def _linked(blocks: DataFrame, t: float) -> DataFrame:
    """Pairs of blocks (a <= b) that share a prefix shingle and whose bounds allow a pair."""
    p = blocks.select("block", "n", F.inline("prefix")).groupBy("h", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
    p = written(p)
    left, right = (p.select("h", *[F.col(c).alias(f"{side}_{c}") for c in ("block", "least", "most", "rest")]) for side in ("a", "b"))
    fits = (F.col("a_block") <= F.col("b_block")) & (F.col("a_most") >= t * F.col("b_least") - 1e-9) & (F.col("b_most") >= t * F.col("a_least") - 1e-9)
    fits &= F.least("a_rest", "b_rest") >= t / (1 + t) * (F.col("a_least") + F.col("b_least")) - 1e-9
    return left.join(right, "h").filter(fits).select(F.col("a_block").alias("a"), F.col("b_block").alias("b")).distinct()


def _pairs(rows: pa.Table, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the pairs of rows that reach ``t``; rows of the other side only where the cell has two."""
    side = rows.column("side").to_numpy()
    sets = rows.column("set").combine_chunks()
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    # by size: the partners of a row are a stretch
    order = np.argsort(sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes, side = sizes[order], side[order]
    flat = np.concatenate([tokens[s:s + n] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]) if len(order) else tokens
    at = np.concatenate([[0], np.cumsum(sizes)])
    flag = np.zeros(int(tokens.max(initial=-1)) + 1, np.int32)
    two, out = len(np.unique(side)) > 1, [[], [], []]
    for i in range(1, len(order)):
        first = int(np.searchsorted(sizes, t * sizes[i] - 1e-9))
        if first >= i:
            continue
        own = flat[at[i]:at[i + 1]]
        flag[own] = 1
        common = np.add.reduceat(flag[flat[at[first]:at[i]]], at[first:i] - at[first])
        flag[own] = 0
        similarity = common / (sizes[i] + sizes[first:i] - common)
        good = similarity >= t - 1e-12
        if two:
            good &= side[first:i] != side[i]
        j = np.flatnonzero(good)
        out[0].append(np.full(len(j), order[i]))
        out[1].append(order[first + j])
        out[2].append(similarity[j])
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.int64, np.int64, float), strict=True))


def _cells(classes: DataFrame, t: float, limit: int) -> DataFrame:
    """The rows of each pair of linked blocks: cell, side, cid, class_id, n_rows and set."""
    blocks = written(_blocks(classes.filter("n > 0"), t, limit))
    linked = _linked(blocks, t).withColumn("cell", F.xxhash64("a", "b"))
    # a block that meets itself is one side
    sides = linked.select("cell", F.inline(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side"))))
                                           .otherwise(F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side"))))))
    whole = blocks.select("cid", "block").join(classes, "cid")
    return sides.join(whole, "block").select("cell", "side", "cid", "class_id", "n_rows", "set")


def similar_pairs(classes: DataFrame, t: float, limit: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b and similarity of all pairs of classes (a < b) with Jaccard similarity ``t`` or more; ``classes`` as from `set_classes`."""
    kind = classes.schema["class_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        i, j, similarity = _pairs(rows, t)
        ids = rows.column("class_id").combine_chunks()
        return pa.table([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(similarity)], names=["x", "y", "similarity"])
    found = _cells(classes, t, limit).groupBy("cell").applyInArrow(run, f"x {kind}, y {kind}, similarity double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def similar_documents(docs: DataFrame, row_id: str, text: str, k: int = 5, threshold: float = 0.8, limit: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: row_id, n_shingles, class_id (smallest row_id of equal shingle sets), class_rows, links (rows of other classes with
    Jaccard similarity of the k-word shingles ``threshold`` or more), best_id (class of the most similar of them, ties by class_id) and best_similarity.

    Texts that are null or have no word have no shingles, share a class and link with nothing.  Rows with a null row_id count as rows of their class;
    repeated rows are rows of their own, and one row_id with two texts is in two classes.  Links of one task are summed there, so a group of like texts costs its comparisons, not its pairs as rows.
    """
    words = F.when(F.col(text).rlike(r"[\p{L}\p{N}]"), word_shingles(F.col(text), k))
    members, classes = set_classes(docs, row_id, words)
    kind = classes.schema["class_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        i, j, similarity = _pairs(rows, threshold)
        own, other, value = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([similarity, similarity])
        ids = rows.column("class_id").combine_chunks()
        rank = np.argsort(pc.sort_indices(ids).to_numpy())
        links = np.bincount(own, weights=rows.column("n_rows").to_numpy()[other], minlength=rows.num_rows).astype(np.int64)
        order = np.lexsort([rank[other], -value, own])
        some, first = np.unique(own[order], return_index=True)
        best = order[first]
        return pa.table([rows.column("cid").combine_chunks().take(pa.array(some)), pa.array(links[some]), ids.take(pa.array(other[best])), pa.array(value[best])], names=["cid", "links", "best_id", "best_similarity"])
    cells = _cells(classes, threshold, limit).groupBy("cell").applyInArrow(run, f"cid long, links long, best_id {kind}, best_similarity double")
    # the most similar first, of equal ones the smallest: a negated similarity puts both in one minimum
    told = cells.groupBy("cid").agg(F.sum("links").alias("links"), F.min(F.struct((-F.col("best_similarity")).alias("s"), F.col("best_id").alias("id"))).alias("best"))
    per_class = classes.select("cid", "mark", "class_id", "n_rows", "n").join(told, "cid", "left")
    return members.join(per_class, "mark").select(F.col("row_id").alias(row_id), F.col("n").cast("long").alias("n_shingles"), "class_id", F.col("n_rows").alias("class_rows"), F.coalesce("links", F.lit(0).cast("long")).alias("links"),
                                                      F.col("best.id").alias("best_id"), (-F.col("best.s")).alias("best_similarity"))
