"""Secret scan: wide candidate search, then a random forest that removes false positives.

A candidate is a run of letters, digits and ``+/_=-.`` of some length.  The forest sees its length, its character transitions, how
much of it dictionary words cover, the path of its document and the words around it.  It is trained from labelled findings;
``planted_findings`` makes such a table from any corpus by planting generated secrets and look-alikes.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pieces

SHORTEST, CONTEXT = 16, 64
MASK = b"[SECRET]"
#: Documents from which labelled findings are made.
SAMPLE = 3000
#: Least share of all words that a dictionary word has, and different words that a task holds before it passes its counts on.
WORD_SHARE, HELD_WORDS = 1e-5, 200_000
CUES = ("token", "secret", "key", "password", "passwd", "pwd", "auth", "credential", "bearer", "apikey", "access", "private")
BENIGN = ("commit", "sha", "checksum", "hash", "digest", "md5", "sha1", "sha256", "etag", "revision", "uuid", "id", "version", "build", "url", "href")
FEATURES = ("length", "entropy", "digits", "capitals", "lower", "signs", "class_changes", "surprise", "hex", "run", "dictionary", "longest_word", "slashes", "dots", "assigned", "quoted", "cue_before", "benign_before",
            "cue_inside", "word_before", "known_before", "path_example", "path_code", "path_hash")

_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-."]] = True
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")
_KIND = np.zeros(256, np.int8)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 1, 2, 3
_KIND[list(b"+/_=-.")] = 4


def candidates(data: bytes) -> list[tuple[int, int]]:
    """Byte spans of runs of at least SHORTEST characters, without signs at their ends."""
    inner = _RUN[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]]).view(np.int8)))
    out = []
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if e - s >= SHORTEST:
            part = data[s:e]
            s, e = s + len(part) - len(part.lstrip(b".-=+/_")), e - (len(part) - len(part.rstrip(b".-_")))
            if e - s >= SHORTEST:
                out.append((s, e))
    return out


@dataclass
class Language:
    """What ordinary text looks like: frequent words and character pairs."""

    words: frozenset = frozenset()
    pairs: np.ndarray = field(default_factory=lambda: np.full((27, 27), math.log(1 / 27)))


def _letters(data: bytes) -> np.ndarray:
    x = np.frombuffer(data.lower(), np.uint8).astype(np.int64) - 96
    return np.where((x < 1) | (x > 26), 0, x)


def corpus_language(docs: DataFrame, text: str = "text", share: float = WORD_SHARE) -> Language:
    """Dictionary and character pairs of all whole texts.

    Candidates are blanked before anything is counted, so that no secret becomes a word, however often it is copied.  A dictionary
    word makes up at least ``share`` of all words and stands at least three times; that bounds the dictionary by 1 / ``share``
    words at every size of the corpus.  Null and empty texts count nothing; without any text there is no word and every pair is
    equally likely.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Counter(), np.zeros(27 * 27, np.int64)

        def rows() -> pa.RecordBatch:
            some = np.flatnonzero(pairs)
            columns = [*words, *[None] * len(some)], [*[None] * len(words), *some.tolist()], [*words.values(), *pairs[some].tolist()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["word", "pair", "n"])
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                for body in texts:
                    plain = bytearray(body.lower())
                    for s, e in candidates(body):
                        plain[s:e] = b" " * (e - s)
                    words.update(w for w in (m.group() for m in _WORD.finditer(plain)) if 3 <= len(w) <= 24)
                    x = _letters(bytes(plain))
                    pairs += np.bincount(x[:-1] * 27 + x[1:], minlength=27 * 27)
                if len(words) > HELD_WORDS:
                    yield rows()
                    words.clear()
                    pairs[:] = 0
        yield rows()
    counted = docs.select(F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL").mapInArrow(count, "word binary, pair int, n long")
    totals = cut(counted.groupBy("word", "pair").agg(F.sum("n").alias("n")))
    every = totals.filter("word IS NOT NULL").agg(F.sum("n")).first()[0] or 0
    pairs = np.ones(27 * 27)
    for r in totals.filter("pair IS NOT NULL").collect():           # 729 at most
        pairs[r.pair] += r.n
    pairs = pairs.reshape(27, 27)
    words = totals.filter(F.col("word").isNotNull() & (F.col("n") >= F.lit(max(3.0, share * every)))).collect()
    return Language(frozenset(bytes(r.word) for r in words), np.log(pairs / pairs.sum(1, keepdims=True)))


def features(data: bytes, s: int, e: int, path: str, language: Language) -> list[float]:
    """FEATURES of the candidate ``data[s:e]``."""
    part = data[s:e]
    n = e - s
    kinds = _KIND[np.frombuffer(part, np.uint8)]
    counts = Counter(part)
    share = [float((kinds == k).mean()) for k in (1, 2, 3, 4)]
    x = _letters(part)
    low, covered, longest, at = part.lower(), 0, 0, 0
    while at < n:                                       # longest known word from here, else one character on
        for size in range(min(12, n - at), 2, -1):
            if low[at:at + size] in language.words:
                covered, longest = covered + size, max(longest, size)
                at += size
                break
        else:
            at += 1
    before = data[max(0, s - CONTEXT):s]
    around = _WORD.findall(before)
    near = [w.lower().decode("utf-8", "replace") for w in around[-3:]]
    tail = before.rstrip(b" \t\"'`")
    lower_path = path.lower()
    run = max(len(m.group()) for m in re.finditer(rb"(.)\1*", part))
    return [n, -sum(c / n * math.log2(c / n) for c in counts.values()), *share, float((kinds[1:] != kinds[:-1]).mean()), -float(language.pairs[x[:-1], x[1:]].mean()), float(all(c in b"0123456789abcdefABCDEF" for c in part)), run,
            covered / n, longest, part.count(b"/"), part.count(b"."), float(tail[-1:] in (b"=", b":")), float(before[-1:] in (b'"', b"'", b"`")), float(any(c in w for w in near for c in CUES)), float(any(w in BENIGN for w in near)),
            float(any(c.encode() in low for c in CUES)), zlib.crc32(near[-1].encode()) % 16 if near else -1.0, sum(w.lower() in language.words for w in around) / max(1, len(around)),
            float(any(w in lower_path for w in ("test", "example", "sample", "mock", "fixture", "doc"))), float(lower_path.endswith((".py", ".js", ".java", ".env", ".yml", ".yaml", ".json", ".conf", ".ini", ".sh"))), zlib.crc32(lower_path.rsplit(".", 1)[-1].encode()) % 8]


def _generated(rng: random.Random) -> tuple[str, int]:
    """A string to plant with its label: a secret in some setting, or a look-alike."""
    raw = hashlib.sha512(rng.randbytes(32)).digest()
    secret = rng.choice([raw[:16].hex(), raw[:20].hex(), raw[:32].hex(), raw[:20].hex().upper(), base64.b64encode(raw[:30]).decode(), base64.urlsafe_b64encode(raw[:24]).decode(), "AKIA" + base64.b32encode(raw[:10]).decode(), "ghp_" + base64.b64encode(raw[:27]).decode().replace("/", "x").replace("+", "y"), "sk_live_" + raw[:12].hex()])
    if rng.random() < 0.5:
        return rng.choice(['token = "{}"', "api_key: {}", "password={}", "SECRET_KEY='{}'", "Authorization: Bearer {}", 'auth_token = "{}"', "TOKEN = \"{}\"", "access key {}", "{}"]).format(secret), 1
    digest = rng.choice([raw[:16].hex(), raw[:20].hex(), raw[:32].hex()])
    return rng.choice([f"commit {digest}", f"sha256: {digest}", f"checksum = {digest}", f"md5 {digest}", f"revision {digest}", f"etag: \"{digest}\"", "/usr/lib/python3/dist-packages/module", "https://www.example.com/some/long/page.html", "your_api_key_goes_here", "xxxxxxxxxxxxxxxxxxxxxxxx", "00000000000000000000000000",
                       "some-long-name-with-hyphens", "password = changeme.changeme.changeme", f"version-{rng.randrange(10)}.{rng.randrange(100)}.{rng.randrange(1000)}-snapshot.release", "first.last.someone@department.example.org"]), 0


def planted_findings(docs: DataFrame, text: str = "text", path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """Labelled findings (body, begin, stop, path, label) from about ``sample`` different texts, drawn by hash.

    Secrets and look-alikes are planted between words; their spans carry their labels.  The first three candidates of the document itself that are
    letters throughout and unassigned are labelled 0 (more would only weigh long documents); the others stay out, since they may be secrets.
    """
    rows = docs.select(F.col(f"`{text}`").alias("body"), (F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")).alias("path")).filter("body IS NOT NULL")
    total = rows.agg(F.approx_count_distinct(F.xxhash64("body", F.lit(7)))).first()[0]
    drawn = rows.filter(F.pmod(F.xxhash64("body", F.lit(7)), F.lit(1 << 20)) < F.lit(int(min(1.0, sample / max(1, total)) * (1 << 20)))).dropDuplicates(["body", "path"])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "body"):
                out = []
                for body, where in zip(texts, part.column("path").to_pylist(), strict=True):
                    rng = random.Random(zlib.crc32(body))
                    gaps = [i for i, c in enumerate(body) if c == 32] or [len(body)]
                    for _ in range(3):
                        string, label = _generated(rng)
                        at = rng.choice(gaps)
                        grown = body[:at] + b" " + string.encode() + b" " + body[at:]
                        out.extend((grown[max(0, s - 200):e + 20], s - max(0, s - 200), e - max(0, s - 200), where, label) for s, e in candidates(grown[:at + len(string) + 200]) if at < s and e <= at + 1 + len(string))
                    plain = [(s, e) for s, e in candidates(body) if body[s:e].isalpha() and body[:s].rstrip(b" \"'")[-1:] not in (b"=", b":")]
                    for form in (body, body.upper()):
                        out.extend((form[max(0, s - 200):e + 20], s - max(0, s - 200), e - max(0, s - 200), where, 0) for s, e in plain[:3])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True)], names=["body", "begin", "stop", "path", "label"])
    return drawn.mapInArrow(plant, "body binary, begin int, stop int, path string, label int")


@dataclass
class Forest:
    """Trees as arrays, so that tasks score candidates beside the text that they stand in."""

    language: Language = field(default_factory=Language)
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves; 0 without trees."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := left[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += value[at]
        return total / max(1, len(self.trees))


def _arrays(root) -> tuple[np.ndarray, ...]:
    rows: list[list[float]] = []

    def add(node) -> int:
        k = len(rows)
        rows.append([-1, 0.0, -1, -1, 0.0])
        if node.subtreeDepth():
            rows[k][0], rows[k][1] = node.split().featureIndex(), node.split().threshold()
            rows[k][2], rows[k][3] = add(node.leftChild()), add(node.rightChild())
        else:
            stats = list(node.impurityStats().stats())
            rows[k][4] = stats[1] / max(1e-9, sum(stats)) if len(stats) > 1 else 0.0
        return k
    add(root)
    c = list(zip(*rows, strict=True))
    return np.array(c[0], np.int64), np.array(c[1]), np.array(c[2], np.int64), np.array(c[3], np.int64), np.array(c[4])


def fit(findings: DataFrame, language: Language | None = None, trees: int = 20, depth: int = 7) -> Forest:
    """Fit on labelled findings (body, begin, stop, path, label); null labels are left out.

    ``language`` is that of the corpus (``corpus_language``); without it, it is counted over the bodies labelled 0.  Without
    findings of both labels the forest is empty and nothing is a secret.
    """
    rows = cut(findings.filter("label IS NOT NULL"))
    kinds = [r[0] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return Forest()
    language = language or corpus_language(rows.filter("label = 0"), "body")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.to_pylist()
            x = [features(q["body"], q["begin"], q["stop"], q["path"] or "", language) for q in r]
            yield pa.RecordBatch.from_arrays([pa.array([float(q["label"]) for q in r]), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])
    table = cut(rows.mapInArrow(work, "label double, x array<double>"))
    model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=23).fit(table.select("label", array_to_vector("x").alias("v")))
    return Forest(language, [_arrays(t._java_obj.rootNode()) for t in model.trees])


def scan(docs: DataFrame, forest: Forest, text: str = "text", path: str | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` with secrets masked in the text and the columns n_candidates, n_secrets, spans (columns of these names are replaced).

    ``spans`` has begin and stop (bytes of the original text) and score of each secret.  A null text stays null with no
    candidates, an empty text stays empty; the other columns, repeated rows and null identifiers pass through.
    """
    docs = docs.drop("n_candidates", "n_secrets", "spans")
    names = docs.columns
    span = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_candidates", T.IntegerType()), T.StructField("n_secrets", T.IntegerType()), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text):
                null = part.column(text).is_null().to_pylist()
                paths = part.column(path).cast(pa.string()).to_pylist() if path else [""] * len(texts)
                found = [candidates(x) for x in texts]
                flat = [features(x, s, e, p or "", forest.language) for x, c, p in zip(texts, found, paths, strict=True) for s, e in c]
                score = iter(forest.score(np.array(flat)).tolist() if flat else [])
                out, spans = [], []
                for x, c in zip(texts, found, strict=True):
                    own = [{"begin": s, "stop": e, "score": p} for (s, e), p in ((se, next(score)) for se in c) if p >= least]
                    at, pieces_ = 0, []
                    for q in own:
                        pieces_ += [x[at:q["begin"]], MASK]
                        at = q["stop"]
                    out.append(b"".join([*pieces_, x[at:]]).decode())
                    spans.append(own)
                body = pa.array([None if z else x for x, z in zip(out, null, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*[body if c == text else part.column(c) for c in names], pa.array([len(c) for c in found], pa.int32()), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, kind)], names=[*names, "n_candidates", "n_secrets", "spans"])
    return docs.mapInArrow(run, schema)
