"""Byte-level BPE with a rank queue of hierarchical bitmaps, over all new pre-tokens of a batch at once.

The parts of the pre-tokens form linked lists in arrays.  Each adjacent pair that the vocabulary can merge puts the position of
its left part into the bucket of the merged rank; a bitmap marks the ranks with a bucket, a bitmap above it marks its non-zero
words.  Find-first-set from the top gives the next rank, whose positions merge together.  Entries whose pair has changed since
are skipped when they come up.  A pre-token of n bytes costs O(n) queue entries, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Pre-tokens that a worker remembers before it starts anew with the next batch, and bytes of text in a batch.
REMEMBERED, BATCH_BYTES = 400_000, 24 << 20
_NONE = np.int32(2_000_000_000)


class RankQueue:
    """Arrays of positions by rank; ``pop`` gives the smallest rank with its positions, ascending.

    Python's integers are the bitmaps: one bit a rank in words of 1,024, and above them one bit for each word in use.
    """

    __slots__ = ("buckets", "words", "top")

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.words = [0] * (ranks // 1024 + 1)
        self.top = 0

    def push(self, rank: int, places: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(places)
            return
        self.buckets[rank] = [places]
        word = rank >> 10
        self.top |= 1 << word
        self.words[word] |= 1 << (rank & 1023)

    def push_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Each place into the bucket of its rank; places without a rank are left out."""
        real = ranks != _NONE
        ranks, places = ranks[real], places[real]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        edge = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
        push, first = self.push, ranks[edge[:-1]].tolist()
        for i, rank in enumerate(first):
            push(rank, places[edge[i]:edge[i + 1]])

    def pop(self) -> tuple[int, np.ndarray] | None:
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        rest = bits & (bits - 1)
        rank = word << 10 | (bits ^ rest).bit_length() - 1
        self.words[word] = rest
        if not rest:
            self.top = top & (top - 1)
        parts = self.buckets.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class _Seen(dict):
    """Numbers for pre-tokens in the order in which they first come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def ragged(flat: np.ndarray, offset: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``index`` of a ragged array behind each other, and where each begins."""
    starts = offset[index]
    counts = offset[index + 1] - starts
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)
    return flat[at], np.concatenate([[0], ends])


class Codec:
    """Encoder and decoder for one vocabulary file of merge ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.ranks = max(self.rank.values()) + 1
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * self.ranks
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.bytes_of, self.bytes_at = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        names = [b"%d," % i for i in range(self.ranks)]
        self.name_of, self.name_at = np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in names])])
        look = self.rank.get
        pairs = [(a << 32 | b, r) for token, r in self.rank.items() for i in range(1, len(token)) if (a := look(token[:i])) is not None and (b := look(token[i:])) is not None]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair, self.pair_rank = table[:, 0].copy(), np.append(table[:, 1], _NONE).astype(np.int32)
        self._forget()

    def _forget(self) -> None:
        self.seen, self.flat, self.offset = _Seen(), np.empty(0, np.int32), np.zeros(1, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two ids, or none."""
        if not len(self.pair):
            return np.full(len(left), _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        at[self.pair[at] != key] = len(self.pair)
        return self.pair_rank[at]

    def merge(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens behind each other, and where each begins."""
        sizes = np.array([len(x) for x in parts], np.int64)
        whole = np.array([self.rank.get(x, -1) for x in parts], np.int32)
        token, alive = self.merged(self.byte[np.frombuffer(b"".join(parts), np.uint8)], sizes, whole < 0)
        first = np.cumsum(sizes) - sizes
        single = whole >= 0
        token[first[single]] = whole[single]
        alive &= ~np.repeat(single, sizes)
        alive[first[single]] = True
        return token[alive], np.concatenate([[0], np.cumsum(np.add.reduceat(alive, first, dtype=np.int64))]) if len(token) else np.zeros(1, np.int64)

    def merged(self, token: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``token`` (sequences of ``sizes`` behind each other) after all merges inside the ``wanted`` ones, and which places still begin a token."""
        n, ends = len(token), np.cumsum(sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        now = np.full(n, _NONE, np.int32)          # rank of the pair that begins here
        open_ = (after >= 0) & np.repeat(wanted, sizes)
        at = np.flatnonzero(open_).astype(np.int32)
        now[at] = self._ranks(token[at], token[after[at]])
        alive = np.ones(n, bool)
        queue = RankQueue(self.ranks)
        queue.push_all(now[at], at)
        while (top := queue.pop()) is not None:
            rank, at = top
            at = at[now[at] == rank]               # the others are stale
            if not len(at):
                continue
            right = after[at]
            if (now[right] == rank).any():         # runs such as aaa: every other pair, from the left
                at = self._apart(at, after)
                right = after[at]
            beyond = after[right]
            token[at], after[at] = rank, beyond
            now[right], alive[right] = _NONE, False
            more = beyond >= 0
            before[beyond[more]] = at[more]
            left = before[at]
            has = left >= 0
            now[at] = _NONE
            places = np.concatenate([at[more], left[has]])
            if len(places):
                ranks = self._ranks(token[places], token[after[places]])
                now[places] = ranks
                queue.push_all(ranks, places)
        return token, alive

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        taken, out = set(), []
        for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
            if p not in taken:
                out.append(p)
                taken.add(q)
        return np.array(out, np.int32)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text begins."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        seen, find = self.seen.__getitem__, self.find
        index = [np.fromiter(map(seen, find(x)), np.int32) for x in texts]
        known = len(self.offset) - 1
        if len(self.seen) > known:
            new = [x.encode() for x in list(self.seen)[known:]]
            ids, at = self.merge(new)
            self.flat, self.offset = np.concatenate([self.flat, ids]), np.concatenate([self.offset, at[1:] + self.offset[-1]])
        ids, at = ragged(self.flat, self.offset, np.concatenate([*index, np.empty(0, np.int32)]).astype(np.int64))
        return ids, at[np.concatenate([[0], np.cumsum([len(x) for x in index], dtype=np.int64)])]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def _spelled(self, ids: np.ndarray, at: np.ndarray, flat: np.ndarray, offset: np.ndarray) -> Iterator[memoryview]:
        """Spelling of each text's ids by a table of tokens, a few texts at a time."""
        i = 0
        while i < len(at) - 1:
            j = i + 1
            while j < len(at) - 1 and at[j + 1] - at[i] <= 200_000:
                j += 1
            body, begin = ragged(flat, offset, ids[at[i]:at[j]].astype(np.int64))
            view = memoryview(body)
            for k in range(i, j):
                yield view[begin[at[k] - at[i]]:begin[at[k + 1] - at[i]]]
            i = j

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> Iterator[memoryview]:
        return self._spelled(ids, at, self.bytes_of, self.bytes_at)

    def decode(self, ids: list[int]) -> bytes:
        return bytes(next(self.decode_batch(np.array(ids, np.int32), np.array([0, len(ids)]))))

    def written(self, ids: np.ndarray, at: np.ndarray) -> Iterator[memoryview]:
        """Decimal ids joined by commas."""
        return (x[:-1] for x in self._spelled(ids, at, self.name_of, self.name_at))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    return Codec(path, pattern)


def _over(docs: DataFrame, doc_id: str, column: str, sql: str, work) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *work(texts)], names=[x.split()[0] for x in sql.split(", ")])
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{column}`").alias("text")).mapInArrow(run, sql)


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the array ids of every whole text; a null text gives an empty array.

    ``path`` is a vocabulary file on every machine.  Rows pass through one by one: repeated rows and null identifiers stay, an
    empty table gives none, other columns are not looked at.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(texts):
        ids, at = codec(path, pattern).encode_batch([x.decode() for x in texts])
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
    return _over(docs, doc_id, text, f"doc_id {kind}, ids array<int>", work)


def decode_documents(encoded: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the bytes behind ``ids``; a null array gives null.  Ids that the vocabulary lacks are an error."""
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else c.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "body"])
    return encoded.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, f"doc_id {kind}, body binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of the bytes that the ids decode to."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(texts):
        c = codec(path, pattern)
        ids, at = c.encode_batch([x.decode() for x in texts])
        return [pa.array(np.diff(at), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in c.written(ids, at)], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in c.decode_batch(ids, at)], pa.string())]
    return _over(docs, doc_id, text, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
