"""Exact de-duplication by owners kept in compressed radix tries.

Every text is inserted, byte for byte, into a Patricia trie; the terminal node of a text keeps the identifier of its owner
(smallest or largest) and the number of rows.  Map tasks insert their own rows first, so a text with a third of all rows
leaves each of them as one terminal; those meet in the trie of their (length, content hash) partition.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces

#: Bytes of text a map task holds before it passes its terminals on and starts anew.
MAP_BYTES = 24 << 20
#: Bytes of text the trie of a partition holds before it spills a subtree.
TRIE_BYTES = 48 << 20
_NODE_BYTES = 400


class Node:
    __slots__ = ("label", "children", "value", "spilled")

    def __init__(self, label: bytes = b"", children: dict | None = None):
        self.label, self.children, self.value, self.spilled = label, children or {}, None, None


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by bisection."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """Texts to values; ``merge(old, new)`` joins the values of equal texts.

    Beyond ``limit`` bytes the heaviest subtree below the first fork goes to a file of the task, later texts of that subtree
    follow it there, and ``items`` reads it back as a trie of its own.  The files have no name in the file system.
    """

    def __init__(self, merge, limit: int = TRIE_BYTES):
        self.root, self.merge, self.limit, self.held, self.spills = Node(), merge, limit, 0, 0

    def insert(self, key: bytes, value) -> bool:
        """True if the text is new here (always so for a spilled subtree)."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(key) - at + _NODE_BYTES
            elif child.spilled is not None:
                pickle.dump((key, value), child.spilled)
                return True
            elif not key.startswith(child.label, at):
                n = _common(child.label, key, at)
                fork = Node(child.label[:n], {child.label[n]: child})
                child.label = child.label[n:]
                node.children[key[at]] = child = fork
                self.held += _NODE_BYTES
            node, at = child, at + len(child.label)
        new = node.value is None
        node.value = value if new else self.merge(node.value, value)
        if self.held > self.limit:
            self._spill()
        return new

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while node.value is None and len(node.children) == 1 and (only := next(iter(node.children.values()))).spilled is None:
            node, prefix = only, prefix + only.label
        sizes = {k: self._bytes(c) for k, c in node.children.items() if c.spilled is None}
        if not sizes:
            return
        k = max(sizes, key=sizes.get)
        file = tempfile.TemporaryFile()
        for pair in self._walk(node.children[k], prefix):
            pickle.dump(pair, file)
        node.children[k] = Node()
        node.children[k].spilled = file
        self.held -= sizes[k]
        self.spills += 1

    @staticmethod
    def _bytes(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            n = stack.pop()
            total += len(n.label) + _NODE_BYTES
            stack.extend(c for c in n.children.values() if c.spilled is None)
        return total

    @staticmethod
    def _walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            n, p = stack.pop()
            if n.spilled is not None:
                n.spilled.seek(0)
                try:
                    while True:
                        yield pickle.load(n.spilled)
                except EOFError:
                    n.spilled.close()
                continue
            p += n.label
            if n.value is not None:
                yield p, n.value
            stack.extend((c, p) for c in n.children.values())

    def items(self) -> Iterator[tuple[bytes, object]]:
        files, stack = [], [(self.root, b"")]
        while stack:
            n, p = stack.pop()
            if n.spilled is not None:
                files.append(n)
                continue
            p += n.label
            if n.value is not None:
                yield p, n.value
            stack.extend((c, p) for c in n.children.values())
        self.root, self.held = Node(), 0
        for n in files:
            again = RadixTrie(self.merge, self.limit)
            for key, value in self._walk(n, b""):
                again.insert(key, value)
            yield from again.items()


_LOCAL = pa.schema([("doc_id", pa.int64()), ("terminal", pa.int64()), ("rows", pa.int64()), ("body", pa.large_binary())])
_LOCAL_SQL = "doc_id long, terminal long, rows long, body binary"


def _better(a, b, largest: bool):
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


def local_owners(batches: Iterator[pa.RecordBatch], largest: bool, limit: int) -> Iterator[pa.RecordBatch]:
    """For each row (doc_id, terminal); for each terminal of this task its owner, rows and text."""
    from pyspark import TaskContext
    number = TaskContext.get().partitionId() << 36
    table: list = []

    def join(old, new):
        old[1], old[2] = _better(old[1], new[1], largest), old[2] + 1
        table.append(old[0])
        return old

    def terminals(trie):
        for key, (terminal, owner, rows) in trie.items():
            yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([terminal], pa.int64()), pa.array([rows], pa.int64()), pa.array([key], pa.large_binary())], schema=_LOCAL)

    def gathered(trie):
        part, size = [], 0
        for b in terminals(trie):
            part.append(b)
            size += b.nbytes
            if size > 2 << 20 or len(part) >= 2000:
                yield pa.Table.from_batches(part).combine_chunks().to_batches()[0]
                part, size = [], 0
        if part:
            yield pa.Table.from_batches(part).combine_chunks().to_batches()[0]

    trie = RadixTrie(join, limit=1 << 62)
    for batch in batches:
        for part, texts in pieces(batch, "body"):
            ids, table = part.column("doc_id").to_pylist(), []
            for doc_id, key in zip(ids, texts, strict=True):
                if trie.insert(key, [number, doc_id, 1]):
                    table.append(number)
                    number += 1
            n = len(ids)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(table, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.large_binary())], schema=_LOCAL)
            if trie.held > limit:
                yield from gathered(trie)
                trie = RadixTrie(join, limit=1 << 62)
    yield from gathered(trie)


_OWNERS = pa.schema([("terminal", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])
_OWNERS_SQL = "terminal long, keep_id long, group_size long, text_sha256 string"


def merged_owners(batches: Iterator[pa.RecordBatch], largest: bool, limit: int) -> Iterator[pa.RecordBatch]:
    """Terminals of all map tasks that fell into this partition, joined in one trie."""
    trie = RadixTrie(lambda a, b: (_better(a[0], b[0], largest), a[1] + b[1], a[2] + b[2]), limit)
    for batch in batches:
        for part, texts in pieces(batch, "body"):
            for owner, terminal, rows, key in zip(part.column("doc_id").to_pylist(), part.column("terminal").to_pylist(), part.column("rows").to_pylist(), texts, strict=True):
                trie.insert(key, (owner, rows, [terminal]))
    out: list[tuple] = []
    for key, (owner, rows, terminals) in trie.items():
        digest = hashlib.sha256(key).hexdigest()
        out.extend((t, owner, rows, digest) for t in terminals)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OWNERS, strict=True)], schema=_OWNERS)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OWNERS, strict=True)], schema=_OWNERS)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min", map_bytes: int = MAP_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty.  Of equal texts the row with the smallest (``keep="min"``)
    or largest identifier stays.  Rows that repeat an identifier and its text are all marked kept.  A null identifier never owns
    a group unless all are null; then keep_id is null and the rows are kept.  An empty table gives no rows; other columns are
    not looked at.
    """
    largest = keep == "max"
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("body"))
    local = cut(rows.mapInArrow(lambda b: local_owners(b, largest, map_bytes), _LOCAL_SQL))
    terminals = local.filter("rows IS NOT NULL").repartition(F.length("body"), F.xxhash64("body"))
    owners = terminals.mapInArrow(lambda b: merged_owners(b, largest, trie_bytes), _OWNERS_SQL)
    members = local.filter("rows IS NULL").select("doc_id", "terminal")
    return members.join(owners, "terminal").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
