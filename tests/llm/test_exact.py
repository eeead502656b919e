"""Exact de-duplication, fingerprints and byte-level BPE against brute force."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from epiframe.llm import bpe
from epiframe.llm import exact_dedup as X
from epiframe.llm import fingerprints as P

SCHEMA = "doc_id long, text string, terminal string, n long, slot int, key string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("ab cé\n") for _ in range(30_000))
    texts = [None, "", "a", "a", "ab", "abc", "é", " ", "\n\n", long, long, long + "x", "same"] + ["same"] * 40
    rows = [(i, t, "x", 1, 2, "k") for i, t in enumerate(texts)] + [(3, "a", "x", 1, 2, "k"), (None, "same", "y", 1, 2, "k"), (None, "only", "y", 1, 2, "k")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("limits", [(X.MAP_BYTES, X.TRIE_BYTES), (2000, 2000)])
def test_exact_groups(odd, keep, limits):
    df, rows = odd
    got = sorted(map(tuple, X.exact_groups(df, keep=keep, map_bytes=limits[0], trie_bytes=limits[1]).collect()), key=str)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        owner = (max if keep == "max" else min)(ids) if ids else None
        want.append((i, owner, len(groups[t or ""]), i == owner, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert X.exact_groups(df.filter("false")).collect() == []


def test_trie_spills_by_subtree():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(3000)]
    trie = X.RadixTrie(lambda a, b: a + b, limit=30_000)
    for k in keys:
        trie.insert(k, 1)
    assert trie.spills > 1 and dict(trie.items()) == Counter(keys)


def test_edited_likeness(odd):
    df, rows = odd
    rows = [r for r in rows if r[0] is not None]
    df = df.filter("doc_id IS NOT NULL AND NOT (doc_id = 3 AND n > 1)").dropDuplicates(["doc_id"])
    texts = {i: t or "" for i, t, *_ in rows}
    order = sorted(texts, reverse=True)
    for slice_rows in (50_000, 5):
        got = {r.doc_id: r for r in P.edited_likeness(df, rows_per_slice=slice_rows).collect()}
        assert set(got) == set(texts)
        for i, d in enumerate(order):
            t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
            n = len(t)
            e = (t[:n - n // 2] + nxt[:n // 2]).encode()
            r = got[d]
            a, b, c = P.bottom_k(t.encode()), P.bottom_k(e), P.bottom_k(nxt.encode())
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, hashlib.sha256(e).hexdigest(), P.encode(a), P.encode(b))
            assert r.near_edited == P.resemblance(a, b) and r.near_next == P.resemblance(a, c)
    assert P.edited_likeness(df.filter("false")).collect() == []


def test_sketch_estimates_and_blocks():
    rng = random.Random(3)
    a = bytes(rng.randrange(97, 123) for _ in range(40_000))
    b = a[:30_000] + bytes(rng.randrange(97, 123) for _ in range(10_000))
    grams = lambda x: {x[i:i + P.WIDTH] for i in range(len(x) - P.WIDTH + 1)}
    x, y = grams(a), grams(b)
    s, t = P.bottom_k(a, 512), P.bottom_k(b, 512)
    assert abs(P.resemblance(s, t, 512) - len(x & y) / len(x | y)) < 0.08
    assert abs(P.containment(s, t, 512) - len(x & y) / len(x)) < 0.12
    assert abs(P.distinct_shingles(s, 512) / len(x) - 1) < 0.15
    assert (P.bottom_k(a, 64, block=1000) == P.bottom_k(a, 64)).all()
    whole = np.unique(P._windows(a, P.WIDTH))[:64]
    assert (P.bottom_k(a, 64) == whole).all() and (P.decode(P.encode(whole)) == whole).all()


def test_merge_of_sketches_is_the_sketch_of_the_union(spark, odd):
    df, rows = odd
    got = {r["key"]: r for r in P.merge_sketches(P.fingerprints(df).join(df.select("doc_id", "key"), "doc_id"), "key").collect()}
    total = np.empty(0, np.uint64)
    for i, t, *_ in rows:
        if i is not None:
            total = P.merged(total, P.bottom_k((t or "").encode()))
    assert got["k"].fingerprint == P.encode(total)


def test_bpe_equals_the_library(spark, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", "a" * 3000, "ab" * 999, "日本語 éé\n\n  x ", "<|endoftext|> it's", "".join(rng.choice("abcdefgh") for _ in range(9000)), "".join(chr(rng.choice([97, 233, 0x1F600, 32, 10, 48, 0x4E2D])) for _ in range(5000))]
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for t in texts:
        ids = c.encode(t)
        assert ids == own.encode_ordinary(t) and c.decode(ids) == t.encode()
    df, rows = odd
    got = Counter(map(tuple, bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()))
    want = Counter()
    for i, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.body)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t, *_ in rows)
    assert bpe.round_trip(df.filter("false"), RANKS, public_tokenizers.PATTERN).collect() == []
