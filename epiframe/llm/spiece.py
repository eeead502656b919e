"""SentencePiece encoding that keeps offsets: normalisation through the compiled character map, BPE merges, byte spans, decoding.

At each place of a text the longest rule of the character map that fits replaces what it matches; a character without a rule
stands for itself.  Beside every normalised character goes the place in the source where its rule began, so every piece, once the
merges are done, is projected to the bytes of the original text that it came from.  Merges run over all new units of a batch with
the rank queue of ``bpe``; units that hold pieces of equal score merge one pair at a time.  A unit is a run of spaces with what follows it,
cut further only where no piece of the vocabulary and no rule reaches across, so the pieces of a text are those of its units.  Where a
rule moves a space over such a border, and in models that squeeze white space, the whole text is one unit.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import REMEMBERED, Codec, _Seen, ragged
from .common import pieces

#: Fixed values of the model format: the sign for a space, kinds of pieces, the BPE model type.
SPACE, NORMAL, UNKNOWN_KIND, CONTROL, BYTE, BPE_MODEL = "▁", 1, 2, 3, 6, 2
#: Bytes of text in a batch.
BATCH_BYTES = 8 << 20
#: Stands before the first unit of a text for the space that the model adds there; no text holds a lone surrogate.
_ADDED = "\ud800"


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    def number(i):
        value = shift = 0
        while True:
            byte = blob[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i
    i = 0
    while i < len(blob):
        tag, i = number(i)
        kind = tag & 7
        if kind == 0:
            value, i = number(i)
        else:
            size, i = number(i) if kind == 2 else ({5: 4, 1: 8}[kind], i)
            value = blob[i:i + size]
            i += size
        yield tag >> 3, value


class CharacterMap:
    """Rules of a compiled map: a double-array trie over source bytes whose leaves point into a block of replacements."""

    def __init__(self, blob: bytes = b""):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.block = blob[4 + size:]

    def _below(self, at: int) -> int:
        unit = self.units[at]
        return at ^ (unit >> 10 << ((unit & 512) >> 6))

    def longest(self, source: bytes, start: int) -> tuple[bytes | None, int]:
        """Replacement and length of the longest rule that fits at ``start``; (None, 0) if there is none."""
        if not self.units:
            return None, 0
        node, best, length = self._below(0), None, 0
        for i in range(start, len(source)):
            at = node ^ source[i]
            if at >= len(self.units) or self.units[at] & 0x800000FF != source[i]:
                break
            node = self._below(at)
            if self.units[at] >> 8 & 1:
                best, length = self.units[node] & 0x7FFFFFFF, i + 1 - start
        return (None, 0) if best is None else (self.block[best:self.block.index(b"\0", best)], length)

    def keys(self) -> Iterator[bytes]:
        """The left sides of all rules."""
        table, every = np.append(np.array(self.units, np.int64), np.zeros(256, np.int64)), np.arange(1, 256)
        stack = [(self._below(0), b"")] if self.units else []
        while stack:
            node, key = stack.pop()
            for byte in every[table[np.minimum(node ^ every, len(table) - 1)] & 0x800000FF == every].tolist():
                at = node ^ byte
                if self.units[at] >> 8 & 1:
                    yield key + bytes([byte])
                stack.append((self._below(at), key + bytes([byte])))


class PieceCodec:
    """Encoder and decoder for a model file of BPE type with normal, control, unknown and byte pieces."""

    def __init__(self, path: str | None = None, model: bytes | None = None):
        if model is None:
            with open(path, "rb") as file:
                model = file.read()
        top: dict[int, list] = {}
        for field, value in _fields(model):
            top.setdefault(field, []).append(value)
        trainer, normal = dict(_fields(top.get(2, [b""])[0])), dict(_fields(top.get(3, [b""])[0]))
        rows = [dict(_fields(x)) for x in top[1]]
        self.names = [r.get(1, b"").decode() for r in rows]
        self.kinds = [r.get(3, NORMAL) for r in rows]
        scores = [struct.unpack("<f", r.get(2, b"\0" * 4))[0] for r in rows]
        if trainer.get(3, 1) != BPE_MODEL or set(self.kinds) - {NORMAL, UNKNOWN_KIND, CONTROL, BYTE} or trainer.get(24, 0) or not normal.get(5, 1):
            raise ValueError("only BPE models of normal, control, unknown and byte pieces, with spaces written before words")
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.map = CharacterMap(normal.get(2, b""))
        self.unknown = self.kinds.index(UNKNOWN_KIND)
        self.byte_id = np.full(256, self.unknown, np.int64)
        self.fallback = bool(trainer.get(35, 0))
        for i, (name, kind) in enumerate(zip(self.names, self.kinds, strict=True)):
            if kind == BYTE:
                self.byte_id[int(name[3:5], 16)] = i
        self._symbols(scores)
        self._borders(scores)
        surface = trainer.get(44, " ⁇ ".encode())
        spelled = [surface if k == UNKNOWN_KIND else b"" if k == CONTROL else bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(SPACE, " ").encode() for n, k in zip(self.names, self.kinds, strict=True)]
        self.bytes_of, self.bytes_at = np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in spelled])])
        digits = [b"%d," % i for i in range(len(self.names))]
        self.name_of, self.name_at = np.frombuffer(b"".join(digits), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in digits])])
        self._forget()

    def _symbols(self, scores: list[float]) -> None:
        """Numbers for what merges work on: pieces of several characters by falling score, then the characters, then any other character."""
        self.place_of = piece = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == NORMAL}
        longer = sorted((n for n in piece if len(n) > 1), key=lambda n: -scores[piece[n]])
        single = sorted({c for n in piece for c in n})
        self.score = {n: scores[i] for n, i in piece.items()}
        symbol = {n: i for i, n in enumerate([*longer, *single])}
        self.char_of = np.array([ord(c) for c in single], np.int64)
        self.first_char, self.other = len(longer), len(symbol)
        self.id_of = np.array([piece.get(n, -1) for n in symbol] + [-1], np.int64)
        look = symbol.get
        pairs = sorted((a << 32 | b, symbol[n]) for n in longer for i in range(1, len(n)) if (a := look(n[:i])) is not None and (b := look(n[i:])) is not None)
        self.queue = Codec.__new__(Codec)              # its rank queue and merges, over these numbers
        table = np.array(pairs, np.int64).reshape(-1, 2)
        self.queue.pair, self.queue.pair_rank = table[:, 0].copy(), np.append(table[:, 1], 2_000_000_000).astype(np.int32)
        self.queue.ranks = max(len(longer), 1)

    def _borders(self, scores: list[float]) -> None:
        """The pattern of the units, and which units hold pieces of equal score."""
        names = list(self.score)
        rules = [k.decode(errors="surrogateescape") for k in self.map.keys()]
        held, ruled = set("".join(n for n in names if len(n) > 1)), set("".join(rules))
        safe = not self.squeeze and not any(re.search(f"[^{SPACE}]{SPACE}", n) for n in names) and not any(re.search("[^ ] ", k) or k.endswith(" ") and k.strip(" ") for k in rules)
        ruled |= set(self.map.block.decode(errors="replace"))
        apart = [c for c in "\n\t\r" if c not in held and c not in ruled and c not in self.score]
        no = re.escape("".join(apart))
        runs = [f" *[^ {no}]+", *([f"[{no}]+"] if apart else []), " +"]
        self.find = re.compile("|".join(runs)).findall if safe else None
        by_score: dict[float, list[str]] = {}
        for n in names:
            if len(n) > 1:
                by_score.setdefault(self.score[n], []).append(n)
        tied = [n for group in by_score.values() if len(group) > 1 for n in group]
        least = [n for n in tied if not any(o != n and o in n for o in tied)]
        # in units as they stand in the source, where the sign for a space may still be one
        self.tied = re.compile("|".join(re.escape(n).replace(SPACE, f"[ {SPACE}{_ADDED}]") for n in least)) if least else None

    def _forget(self) -> None:
        self.seen, self.flat, self.ends, self.offset = _Seen(), np.empty(0, np.int32), np.empty(0, np.int64), np.zeros(1, np.int64)
        self.source, self.starts, self.loose = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), bool)

    def normalise(self, text: str, added: bool = True) -> tuple[str, list[int]]:
        """The normalised text, and for each of its characters (and its end) the byte of the source where the rule behind it began."""
        source = text.encode("utf-8", "surrogatepass")
        out, places, at, spaced = [], [], 0, self.squeeze

        def step(at):
            new, length = self.map.longest(source, at)
            if new is None:
                length = 1 + (source[at] >= 0xC0) + (source[at] >= 0xE0) + (source[at] >= 0xF0)
                new = source[at:at + length]
            return new.decode(), length
        while self.squeeze and at < len(source):
            new, length = step(at)
            if new != " ":
                break
            at += length
        if at < len(source) and added and self.prefix:
            out.append(SPACE)
            places.append(at)
        while at < len(source):
            new, length = step(at)
            if spaced:
                new = new.lstrip(" ")
            out.extend(new.replace(" ", SPACE))
            places.extend([at] * len(new))
            if new:
                spaced = self.squeeze and new.endswith(" ")
            at += length
        while self.squeeze and out and out[-1] == SPACE:
            out.pop()
            at = places.pop()
        return "".join(out), [*places, at]

    def _one_by_one(self, unit: str) -> list[tuple[int, int]]:
        """(place, length) of the pieces of a normalised unit: the pair of the highest score merges first, of equal ones the leftmost."""
        n = len(unit)
        size, after, before = [1] * n, [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def push(i):
            if i >= 0 and after[i] >= 0:
                j = after[i]
                score = self.score.get(unit[i:j + size[j]])
                if score is not None:
                    heapq.heappush(heap, (-score, i, size[i], size[j]))
        for i in range(n):
            push(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if size[i] != left or j < 0 or size[j] != right:
                continue
            size[i], size[j], after[i] = left + right, 0, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [(i, s) for i, s in enumerate(size) if s]

    def _learn(self, units: list[str]) -> None:
        """Ids and ends (bytes of the source from where the unit begins) of new units."""
        told, texts = [], []
        if self.map.units or self.squeeze:
            told = [self.normalise(u.lstrip(_ADDED), u[:1] == _ADDED) for u in units]
            texts = [t for t, _ in told]
            code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            sizes = np.array([len(t) for t in texts], np.int64)
            last = np.array([p[-1] for _, p in told], np.int64)
            begin = np.array([x for _, p in told for x in p[:-1]], np.int64)
            width = np.array([len(u.lstrip(_ADDED).encode("utf-8", "surrogatepass")) for u in units], np.int64)
        else:
            code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.int32).copy()
            sizes = np.array([len(u) for u in units], np.int64)
            bytes_ = (np.int8(1) + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)).astype(np.int8)
            bytes_[code == ord(_ADDED)] = 0
            code[(code == 32) | (code == ord(_ADDED))] = ord(SPACE)
            total = np.concatenate([[0], np.cumsum(bytes_, dtype=np.int64)])
            stop = np.cumsum(sizes)
            width = last = total[stop] - total[stop - sizes]
            begin = total[:-1] - np.repeat(total[stop - sizes], sizes)
        stop = np.cumsum(sizes)
        at = np.searchsorted(self.char_of, code)
        at[at == len(self.char_of)] = 0
        symbol = np.where(self.char_of[at] == code, at + self.first_char, self.other).astype(np.int32)
        wanted = np.ones(len(sizes), bool)
        if self.tied is not None:
            search = self.tied.search
            wanted[[k for k, u in enumerate(texts if told else units) if search(u)]] = False
        symbol, alive = self.queue.merged(symbol, sizes, wanted) if len(symbol) else (symbol, np.zeros(0, bool))
        for k in np.flatnonzero(~wanted).tolist():
            first = int(stop[k] - sizes[k])
            unit = "".join(map(chr, code[first:stop[k]].tolist()))
            alive[first:stop[k]] = False
            for i, n in self._one_by_one(unit):
                alive[first + i] = True
                if n > 1:
                    symbol[first + i] = -1 - self.place_of[unit[i:i + n]]
        place = np.flatnonzero(alive)
        symbol = symbol[place].astype(np.int64)
        ids = np.where(symbol < 0, -1 - symbol, self.id_of[np.maximum(symbol, 0)])
        unit_of = np.searchsorted(stop, place, "right")
        following = np.append(place[1:], len(code))
        inner = following < stop[unit_of] if len(place) else np.zeros(0, bool)
        ends = np.where(inner, np.append(begin, 0)[following], last[unit_of]) if len(place) else np.zeros(0, np.int64)
        counts = np.ones(len(place), np.int64)
        lacking = np.flatnonzero(ids < 0)
        if len(lacking) and self.fallback:
            codes, which = np.unique(code[place[lacking]], return_inverse=True)
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
            counts[lacking] = np.array([len(s) for s in spelled])[which]
            out = np.repeat(ids, counts)
            body, _ = ragged(np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in spelled])]), which)
            out[out < 0] = self.byte_id[body]
            start = np.append(begin, 0)[place]
            finals = np.cumsum(counts) - 1
            spread = np.repeat(start, counts)          # the bytes before the last one of a character cover nothing
            spread[finals] = ends
            ids, ends = out, spread
        else:
            ids[lacking] = self.unknown
        per_unit = np.bincount(unit_of, weights=counts, minlength=len(sizes)).astype(np.int64) if len(place) else np.zeros(len(sizes), np.int64)
        head = np.append(begin, 0)[np.minimum(stop - sizes, len(begin))]
        self.flat, self.ends = np.concatenate([self.flat, ids.astype(np.int32)]), np.concatenate([self.ends, ends])
        self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum(per_unit)])
        self.source, self.starts = np.concatenate([self.source, width]), np.concatenate([self.starts, np.where(sizes > 0, head, last)])
        # rules can take the space from the front of a unit or put one at its end: pieces may then reach across its borders
        padded = np.concatenate([[0], code])
        front, back = padded[np.minimum(stop - sizes + 1, len(code))] == ord(SPACE), padded[stop] == ord(SPACE)
        spaces = np.array([[u[:1] == " ", u[-1:] == " "] for u in units], bool)
        self.loose = np.concatenate([self.loose, np.stack([spaces[:, 0] & ~front, back & ~spaces[:, 1]], axis=1) | (sizes == 0)[:, None]])

    def _units(self, text: str, whole: bool = False) -> list[str]:
        if not text:
            return []
        text = _ADDED + text if self.prefix else text
        if self.find is None or whole:
            return [text]
        return self.find(text)

    def _index(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts behind each other, and where each text begins; new units are learnt."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        seen = self.seen.__getitem__
        index = [np.fromiter(map(seen, self._units(x)), np.int32) for x in texts]
        self._catch_up()
        if self.loose.any():
            index = [np.fromiter(map(seen, self._units(x, True)), np.int32) if self.loose[i[1:], 0].any() or self.loose[i[:-1], 1].any() else i for x, i in zip(texts, index, strict=True)]
            self._catch_up()
        return np.concatenate([*index, np.empty(0, np.int32)]), np.concatenate([[0], np.cumsum([len(x) for x in index], dtype=np.int64)])

    def ids_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text begins among them."""
        each, many = self._index(texts)
        ids, at = ragged(self.flat, self.offset, each)
        return ids, at[many]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, where each text begins among them, and begin and end of each piece in bytes of its source."""
        each, many = self._index(texts)
        ids, at = ragged(self.flat, self.offset, each)
        ends, _ = ragged(self.ends, self.offset, each)
        total = np.concatenate([[0], np.cumsum(self.source[each])])
        ends += np.repeat(total[:-1] - np.repeat(total[many[:-1]], np.diff(many)), np.diff(at))
        text_at = at[many]
        begins = np.concatenate([[0], ends[:-1]])
        some = np.flatnonzero(np.diff(text_at) > 0)
        begins[text_at[some]] = self.starts[each[many[some]]]
        return ids, text_at, begins, ends

    def _catch_up(self) -> None:
        known = len(self.offset) - 1
        if len(self.seen) > known:
            self._learn(list(self.seen)[known:])

    def encode(self, text: str) -> list[int]:
        return self.ids_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> Iterator[memoryview]:
        """UTF-8 of each text's ids: the added space goes, bytes that form no character become U+FFFD each."""
        for k, body in enumerate(Codec._spelled(self, ids, at, self.bytes_of, self.bytes_at)):
            own = ids[at[k]:at[k + 1]]
            drop = self._added(own) if self.prefix or self.squeeze else 0
            body = body[drop:]
            try:
                str(body, "utf-8")
            except UnicodeDecodeError:
                body = memoryview(self._patched(own.tolist())[drop:])
            yield body

    def _added(self, own: np.ndarray) -> int:
        """Leading spaces that decoding takes off: one, or one of each piece while nothing else has come (where white space is squeezed)."""
        drop = 0
        for i in own.tolist():
            if self.kinds[i] == CONTROL:
                continue
            if self.kinds[i] != NORMAL or not self.names[i].startswith(SPACE):
                break
            drop += 1
            if not self.squeeze or self.names[i] != SPACE:
                break
        return drop

    def _patched(self, ids: list[int]) -> bytes:
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += bytes([int(self.names[i][3:5], 16)])
                continue
            while run:
                size = next((n for n in range(1, 5) if _is_character(run[:n])), 0)
                out.append(run[:size] or "�".encode())
                run = run[size or 1:]
            if i is not None:
                out.append(bytes(self.bytes_of[self.bytes_at[i]:self.bytes_at[i + 1]]))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return str(next(self.decode_batch(np.array(ids, np.int32), np.array([0, len(ids)]))), "utf-8")

    def written(self, ids: np.ndarray, at: np.ndarray) -> Iterator[memoryview]:
        """Decimal ids joined by commas."""
        return (x[:-1] for x in Codec._spelled(self, ids, at, self.name_of, self.name_at))


def _is_character(body: bytes) -> bool:
    try:
        return len(body.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec for each model file and Python worker."""
    return PieceCodec(path)


def _over(docs: DataFrame, doc_id: str, column: str, sql: str, work) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *work([x.decode("utf-8", "replace") for x in texts])], names=[x.split()[0] for x in sql.split(", ")])
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{column}`").alias("text")).mapInArrow(run, sql)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and, for every whole text, arrays of equal length: ids, begins, ends.

    ``begins`` and ``ends`` are byte positions in the original text: piece k came from the bytes between them, which are none for the
    space that the model adds and for all but the last of the bytes of a character.  ``path`` is a model file on every
    machine.  A null or empty text gives empty arrays; rows pass through one by one: repeated rows and null identifiers stay, an
    empty table gives none, other columns are not looked at.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(texts):
        ids, at, begins, ends = codec(path).encode_batch(texts)
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (ids, begins, ends)]
    return _over(docs, doc_id, text, f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>", work)


def decode_documents(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the text behind ``ids``; a null array gives null.  Ids that the vocabulary lacks are an error."""
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else c.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])
    return encoded.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, digests of the decimal ids (joined by commas) and of the decoded text, spans_sha256 of the ends (8-byte little-endian), n_bytes covered by pieces."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(texts):
        c = codec(path)
        ids, at, begins, ends = c.encode_batch(texts)
        covered = np.concatenate([[0], np.cumsum(ends - begins)])[at]
        told = [hashlib.sha256(memoryview(ends[a:b].astype("<i8"))).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [pa.array(np.diff(at), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in c.written(ids, at)], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in c.decode_batch(ids, at)], pa.string()), pa.array(told, pa.string()), pa.array(np.diff(covered), pa.int64())]
    return _over(docs, doc_id, text, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, n_bytes long", work)
