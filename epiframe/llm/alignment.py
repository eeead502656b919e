"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Both encodings of a text are cut into groups where tokens of both end together.  Every token points to the token that overlaps it and
reaches farthest right (of two that end together, the one of the second tokenizer); replacing each pointer by the pointer of its target doubles
its reach, so after a number of rounds that grows with the logarithm of the longest chain all tokens of a group point to its
last token, which is its label.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spiece
from .bpe import Codec
from .common import cut, pieces

#: Bytes of text that are encoded at once, tokens that are aligned at once (or one text), and units that either codec remembers between batches.
BATCH_BYTES, SLICE_TOKENS, REMEMBERED = 4 << 20, 200_000, 200_000
#: Bytes of a row group of the written links: what a writer holds in memory.
ROW_GROUP = 16 << 20


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others count up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class ByteLevelCodec(Codec):
    """Byte-level BPE from a vocabulary with an explicit list of merges (no normaliser, no added prefix)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, split = whole["model"], whole["pre_tokenizer"]
        if model["type"] != "BPE" or whole["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("only byte-level BPE without normaliser and prefix")
        alphabet, vocabulary = byte_alphabet(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        if (np.diff(made) <= 0).any():
            raise ValueError("ids must grow in the order of the merges")
        tokens = [b""] * (max(vocabulary.values()) + 1)
        special = {t["content"] for t in whole.get("added_tokens") or ()}
        for name, i in vocabulary.items():
            tokens[i] = name.encode() if name in special else bytes(map(alphabet.__getitem__, name))
        self.ranks, self.rank, self.find = len(tokens), {}, regex.compile(pattern).findall
        self.byte = np.zeros(256, np.int32)
        for sign, byte in alphabet.items():
            self.byte[byte] = vocabulary[sign]
        self.bytes_of, self.bytes_at = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        left, right = (np.array([vocabulary[m[k]] for m in merges], np.int64) for k in (0, 1))
        order = np.argsort(key := left << 32 | right)
        self.pair, self.pair_rank = key[order], np.append(made[order], 2_000_000_000).astype(np.int32)
        self._forget()


@dataclass
class Aligned:
    """Tokens of a batch of texts behind each other; ``at_a`` and ``at_b`` tell where a text begins, ``group_a`` and ``group_b`` the group of each
    token (groups count through the batch), ``last_a`` and ``last_b`` the two tokens that end a group."""

    a: np.ndarray
    at_a: np.ndarray
    b: np.ndarray
    at_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    def groups_at(self) -> np.ndarray:
        """Where each text begins among the groups."""
        return np.searchsorted(self.last_b, self.at_b)


def jump(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Terminal token of each token: numbers of the first tokenizer's tokens, then of the second's.  Both must end at the same byte."""
    n = len(ends_a)
    right = np.searchsorted(ends_b, ends_a) + n        # the other side's token over one's last byte reaches farthest
    back = np.searchsorted(ends_a, ends_b)
    target = np.concatenate([right, np.where(ends_a[back] > ends_b, back, np.arange(n, n + len(ends_b)))]) if n else np.zeros(0, np.int64)
    while True:
        doubled = target[target]
        if np.array_equal(doubled, target):
            return target
        target = doubled


def align(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """Groups of tokens that spell the same texts; ``sizes_a`` and ``sizes_b`` are the bytes of each id."""
    ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
    n = len(a)
    target = jump(ends_a, ends_b)
    last_b = np.flatnonzero(target[n:] == np.arange(n, n + len(b)))
    number = np.zeros(len(b), np.int64)
    number[last_b] = np.arange(len(last_b))
    group = number[target - n]
    return Aligned(a, at_a, b, at_b, group[:n], group[n:], np.searchsorted(ends_a, ends_b[last_b]), last_b)


def align_texts(first: Codec, second: spiece.PieceCodec, texts: list[bytes]) -> Iterator[tuple[slice, Aligned]]:
    """Tokens and groups of whole texts, with a space before each, a slice of the texts at a time; none for texts that are empty or that the tokens do not spell."""
    for codec in (first, second):
        if len(codec.seen) > REMEMBERED:
            codec._forget()
    told = [x.decode("utf-8", "replace") for x in texts]
    a, at_a = first.encode_batch([" " + x for x in told])
    b, at_b = second.ids_batch(told)
    spelled = zip(texts, Codec._spelled(first, a, at_a, first.bytes_of, first.bytes_at), Codec._spelled(second, b, at_b, second.bytes_of, second.bytes_at), strict=True)
    good = np.array([bool(x) and u == (whole := b" " + x) and v == whole for x, u, v in spelled], bool)
    if not good.all():
        (a, at_a), (b, at_b) = ((ids[np.repeat(good, np.diff(at))], np.concatenate([[0], np.cumsum(np.diff(at) * good)])) for ids, at in ((a, at_a), (b, at_b)))
    sizes_a, sizes_b = (np.diff(c.bytes_at).astype(np.int64) for c in (first, second))
    both, i = at_a + at_b, 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(both, both[i] + SLICE_TOKENS, "right")) - 1)
        yield slice(i, j), align(a[at_a[i]:at_a[j]], at_a[i:j + 1] - at_a[i], b[at_b[i]:at_b[j]], at_b[i:j + 1] - at_b[i], sizes_a, sizes_b)
        i = j


class _Spelling:
    """Decimal ids of both sides with the sign that follows them: comma, bar after the last of the first side, semicolon after the last of the second."""

    def __init__(self, first: Codec, second: spiece.PieceCodec):
        self.n, self.m = len(first.bytes_at) - 1, len(second.bytes_at) - 1
        names = [b"%d%c" % (i, sign) for size, signs in ((self.n, b",|"), (self.m, b",;")) for sign in signs for i in range(size)]
        self.flat, self.at = np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in names])])

    def texts(self, x: Aligned) -> Iterator[memoryview]:
        end_a, end_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        end_a[x.last_a], end_b[x.last_b] = 1, 1
        row = np.empty(len(x.a) + len(x.b), np.int64)
        row[np.arange(len(x.a)) + np.concatenate([[0], x.last_b + 1])[x.group_a]] = x.a + self.n * end_a
        row[np.arange(len(x.b)) + x.last_a[x.group_b] + 1] = x.b + 2 * self.n + self.m * end_b
        return (view[:-1] for view in Codec._spelled(self, row, x.at_a + x.at_b, self.flat, self.at))


@lru_cache(maxsize=1)
def codecs(path_a: str, pattern: str, path_b: str) -> tuple[Codec, spiece.PieceCodec, _Spelling]:
    """One pair of codecs for each pair of files and Python worker."""
    first, second = ByteLevelCodec(path_a, pattern), spiece.PieceCodec(path_b)
    return first, second, _Spelling(first, second)


def _lists(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _width(first: Codec, second: spiece.PieceCodec) -> int:
    """Bytes of a link's number."""
    return 4 if (len(first.bytes_at) - 1) * (len(second.bytes_at) - 1) < 1 << 31 else 8


def _numbers(at: np.ndarray, values: np.ndarray, width: int) -> pa.Array:
    """Rows of a ragged array of numbers as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype("<i4")), pa.py_buffer(values.astype(f"<i{width}"))])


def _links(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some rows at a time: which, the numbers of their last column, and where each row begins among them."""
    column = batch.column(batch.num_columns - 1)
    at = np.frombuffer(column.buffers()[1], "<i4")[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body, i = np.frombuffer(column.buffers()[2] or b"", np.uint8), 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + width * SLICE_TOKENS, "right")) - 1)
        yield slice(i, j), body[at[i]:at[j]].view(f"<i{width}"), (at[i:j + 1] - at[i]) // width
        i = j


def align_documents(docs: DataFrame, path_a: str, pattern: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and, of every whole text, arrays a_ids, b_ids, a_groups and b_groups (the group of each token, from 0).

    Null and empty texts, and texts that the tokens do not spell (a literal U+2581 reads as a space), give empty arrays.  Rows pass through one
    by one: repeated rows and null identifiers stay, an empty table gives none, other columns are not looked at.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", BATCH_BYTES):
                first, second, _ = codecs(path_a, pattern, path_b)
                for rows, x in align_texts(first, second, texts):
                    base = x.groups_at()[:-1]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id")[rows], _lists(x.at_a, x.a, pa.int32()), _lists(x.at_b, x.b, pa.int32()),
                                                      _lists(x.at_a, x.group_a - np.repeat(base, np.diff(x.at_a)), pa.int32()), _lists(x.at_b, x.group_b - np.repeat(base, np.diff(x.at_b)), pa.int32())],
                                                     names=["doc_id", "a_ids", "b_ids", "a_groups", "b_groups"])
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>")


def linked_documents(docs: DataFrame, path_a: str, pattern: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links of every text.

    ``links`` holds a_id * (size of the second vocabulary) + b_id for the two tokens that end a group, as little-endian numbers (of 4 bytes where
    all fit, else 8) behind each other: tokens have bytes, so exactly one token of each side ends there.  ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``, an empty string where there are no tokens.
    Odd rows as in ``align_documents``.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", BATCH_BYTES):
                first, second, spelling = codecs(path_a, pattern, path_b)
                for rows, x in align_texts(first, second, texts):
                    at = x.groups_at()
                    told = [hashlib.sha256(view).hexdigest() if len(view) else "" for view in spelling.texts(x)]
                    links = x.a[x.last_a].astype(np.int64) * spelling.m + x.b[x.last_b]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id")[rows], *(pa.array(np.diff(n), pa.int64()) for n in (x.at_a, x.at_b, at)), pa.array(told, pa.string()), _numbers(at, links, _width(first, second))],
                                                     names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def link_counts(linked: DataFrame, b_size: int, width: int) -> DataFrame:
    """link, n (how many links of the corpus it holds) and best (n is the highest of its b_id, ties included).

    Two tokens that end together end in the same bytes, so one is a suffix of the other: the table has at most as many rows as the tokens of both
    vocabularies have bytes, whatever the corpus.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, links, _ in _links(batch, width):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.unique(links, return_counts=True)], names=["link", "n"])
    counts = linked.select("links").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    highest = counts.groupBy((F.col("link") % b_size).alias("b")).agg(F.max("n").alias("top"))
    return counts.join(highest, F.col("link") % b_size == F.col("b")).select("link", "n", (F.col("n") == F.col("top")).alias("best"))


def scored(linked: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """``linked`` with n_links, n_best and count_sum in place of its links; ``counts`` (see ``link_counts`` for its bound) goes to every task."""
    rows = counts.orderBy("link").toArrow()
    table = linked.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("link", "n", "best")))
    names = [c for c in linked.columns if c != "links"]
    kinds = [f"`{c}` {linked.schema[c].dataType.simpleString()}" for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = table.value
        for batch in batches:
            for rows, links, at in _links(batch, width):
                place = np.searchsorted(key, links)
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[place], dtype=np.int64)])[at]) if len(key) else np.zeros(len(at) - 1, np.int64) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([*(x[rows] for x in batch.columns[:-1]), pa.array(np.diff(at), pa.int64()), *(pa.array(x, pa.int64()) for x in sums)], names=[*names, "n_links", "n_best", "count_sum"])
    return linked.select(*[F.col(f"`{c}`") for c in names], "links").mapInArrow(run, ", ".join([*kinds, "n_links long", "n_best long", "count_sum long"]))


def alignment_counts(docs: DataFrame, path_a: str, pattern: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best (links whose pair is its b_id's commonest in the corpus) and count_sum (over the counts of its links)."""
    linked = cut(linked_documents(docs, path_a, pattern, path_b, doc_id, text), **{"parquet.block.size": ROW_GROUP})
    first, second, _ = codecs(path_a, pattern, path_b)
    width = _width(first, second)
    return scored(linked, link_counts(linked, len(second.names), width), width)
