"""MinHash near-duplicates by tensored banding, every link confirmed on the full shingle sets.

Two collections of A and B bands are cut from one short signature; a table is keyed by a pair (band i of the first, band j of the
second), so A x B tables cost A + B bands of hashing.  Documents with equal sets are one class from the start.  Inside a bucket
all members are compared with its most central one.  Members that this leaves outside the centre's component are then compared
with the whole bucket, in blocks inside tasks: a pair is looked at in the first table that it shares, and is passed on only if an
upper bound of its overlap allows the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, draws, mix, pieces, word_shingles
from .components import components

#: Bands in each of the two collections and hashes in a band.  At a similarity of 0.8 a pair meets in a table with 0.9994.
BANDS, ROWS = 8, 2
#: Cells of the counts that bound an overlap from above, and rows of a block.
CELLS, BLOCK = 256, 1500


def _bands(sets: list[np.ndarray], bands: int, rows: int) -> list[list[int]]:
    keys, add = draws(3, 2 * bands * rows) | np.uint64(1), draws(4, 2 * bands * rows)
    out = []
    for s in sets:
        if not len(s):
            out.append([])
            continue
        low = np.full(2 * bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 4096):
            low = np.minimum(low, (((s[i:i + 4096, None] ^ add) * keys) ^ (add >> np.uint64(17))).min(0))
        h = mix(low).reshape(2 * bands, rows)
        total = h[:, 0]
        for j in range(1, rows):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[:, j])
        out.append(total.view(np.int64).tolist())
    return out


def _cells(s: np.ndarray) -> bytes:
    """Shingles by hash cell; 255 stands for that many or more."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n, d1, d2, bands, cells): size of a document's shingle set, a 128-bit digest of the set, band hashes, counts by cell."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                sets = word_shingles([x.lower() for x in texts], width)
                d1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1), pa.array(d2), pa.array(_bands(sets, bands, rows), pa.list_(pa.int64())), pa.array([_cells(s) for s in sets], pa.binary())], names=["id", "n", "d1", "d2", "bands", "cells"])
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"id {kind}, n long, d1 long, d2 long, bands array<long>, cells binary")


def _confirm(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have 100 |A and B| >= percent |A or B|.

    Sets are made again from the texts of the documents in question only; a leader with very many pairs is one row that the
    join splits over tasks.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(ids, "id", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bodies in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in word_shingles([x.lower() for x in bodies], width)], pa.binary())], names=["id", "s"])
    sets = cut(texts.mapInArrow(make, f"id {kind}, s binary"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("s"), batch.column("t"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    joined = pairs.join(sets.withColumnRenamed("id", "a"), "a").join(sets.withColumnsRenamed({"id": "b", "s": "t"}), "b").select("a", "b", "s", "t")
    return joined.mapInArrow(check, f"a {kind}, b {kind}")


def _across(rows: DataFrame, kind: str, bands: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and may be similar enough.

    ``rows`` has key, t (number of the table), rep, n, own (component), inner (in the component of the bucket's centre).  Rows
    outside the centre's component meet all rows of the bucket, block by block; no pair is made before it has passed the bound.
    """
    mixed = rows.groupBy("key").agg(F.count("*").alias("m"), F.count(F.when(~F.col("inner"), 1)).alias("x")).filter("x > 0 AND m > 2")
    at = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    some = rows.join(mixed.select("key", F.ceil(F.col("m") / BLOCK).alias("mb"), F.ceil(F.col("x") / BLOCK).alias("xb")), "key")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    members = some.select("key", "t", "rep", "n", "own", "bands", "cells", F.lit(False).alias("outer"), at("mb").alias("i"), upto("xb").alias("j"))
    others = some.filter("NOT inner").select("key", "t", "rep", "n", "own", "bands", "cells", F.lit(True).alias("outer"), upto("mb").alias("i"), at("xb").alias("j"))
    placed = members.unionByName(others).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(part: pa.Table) -> tuple[list, list]:
        outer = np.array(part["outer"].to_pylist(), bool)
        n, t = part["n"].to_numpy(), part["t"][0].as_py()
        band = np.array(part["bands"].to_pylist(), np.int64).reshape(len(n), 2, bands)
        cell = np.frombuffer(b"".join(part["cells"].to_pylist()), np.uint8).reshape(len(n), CELLS)
        rep, own = np.array(part["rep"].to_pylist(), object), np.array(part["own"].to_pylist(), object)
        full, a, b = (cell == 255).any(1), [], []
        inside = np.flatnonzero(~outer)
        for x in np.flatnonzero(outer):
            y = inside[(own[inside] != own[x]).astype(bool)]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            same = band[y] == band[x]
            first = same.argmax(2)
            y = y[(first[:, 0] * bands + first[:, 1] == t) & same.any(2).all(1)]
            most = np.minimum(cell[y], cell[x]).sum(1, dtype=np.int64)
            most = np.where(full[y] | full[x], np.minimum(n[y], n[x]), most)
            y = y[100 * most >= percent * (n[y] + n[x] - most)]
            a.extend([rep[x]] * len(y))
            b.extend(rep[y])
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups():
            nonlocal held
            for batch in batches:
                k = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "i", "j")]
                edge = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in k], axis=0)) + 1).tolist(), batch.num_rows]
                for s, e in zip(edge[:-1], edge[1:], strict=True):
                    one = batch.slice(s, e - s)
                    if held and any(held[-1].column(c)[0].as_py() != one.column(c)[0].as_py() for c in ("key", "i", "j")):
                        yield pa.Table.from_batches(held)
                        held = []
                    if e > s:
                        held.append(one)
            if held:
                yield pa.Table.from_batches(held)
        of = None
        out_a, out_b = [], []
        for group in groups():
            of = group.schema.field("rep").type
            a, b = compare(group)
            out_a += a
            out_b += b
            if len(out_a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, of), pa.array(out_b, of)], names=["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, of), pa.array(out_b, of)], names=["a", "b"])
    return placed.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased; a set holds the distinct ``width``-word
    shingles, or the whole sequence of fewer words.  Texts without words and null texts have an empty set and link with nothing.
    Components join documents over links of at least ``percent`` / 100 similarity; component_id is the smallest identifier in
    one.  Rows that repeat an identifier count as one document, so they share a component and are kept or dropped together; a
    row with a null identifier is kept by itself.  An empty table gives no rows; other columns are not looked at.
    """
    signed = cut(signatures(docs, doc_id, text, width, bands, rows))
    real = signed.filter("n > 0 AND id IS NOT NULL")
    classes = real.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("cells").alias("cells"))
    alike = real.select("id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    classes = cut(classes.drop("d1", "d2"))
    kind = docs.schema[doc_id].dataType.simpleString()

    numbers = F.sequence(F.lit(0), F.lit(bands * bands - 1))
    table = lambda t: F.xxhash64(t, F.element_at("bands", F.floor(t / bands).cast("int") + 1), F.element_at("bands", (t % bands).cast("int") + bands + 1))
    keyed = classes.select("rep", "n", F.posexplode(F.transform(numbers, table)).alias("t", "key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("key")
    buckets = cut(keyed.join(shared, "key"))
    possible = f"100 * least(n, m) >= {percent} * greatest(n, m)"

    sizes = buckets.groupBy("key").agg(F.count("*").alias("size"))
    central = buckets.join(sizes, "key").groupBy("rep").agg(F.sum("size").alias("central"))   # who shares most with most
    leaders = cut(buckets.join(central, "rep").groupBy("key").agg(F.min_by(F.struct(F.col("rep").alias("a"), F.col("n").alias("m")), F.struct(-F.col("central"), F.col("rep"))).alias("l")).select("key", "l.*"))
    pairs = buckets.join(leaders, "key").filter(f"rep <> a AND {possible}").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))
    links = cut(_confirm(cut(pairs.distinct()), docs, doc_id, text, width, percent))

    of = cut(components(links).withColumnRenamed("node", "rep"))
    owned = buckets.join(of, "rep", "left").select("key", "t", "rep", "n", F.coalesce("component", "rep").alias("own"))
    centres = leaders.join(of, F.col("a") == F.col("rep"), "left").select("key", F.coalesce("component", "a").alias("centre"))
    owned = owned.join(centres, "key").withColumn("inner", F.col("own") == F.col("centre")).drop("centre")
    more = cut(_across(owned.join(classes.select("rep", "bands", "cells"), "rep"), kind, bands, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = links.unionByName(_confirm(more, docs, doc_id, text, width, percent))
    whole = components(alike.unionByName(links)).withColumnRenamed("node", "id")
    out = signed.join(whole, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
