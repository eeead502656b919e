"""SentencePiece against its library (ids, byte spans, decoding, every normalisation), token alignment and hard negatives against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epiframe.llm import alignment as A
from epiframe.llm import hard_negatives as H
from epiframe.llm import queries as Q
from epiframe.llm import spiece as S

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [*"ab  e▁\n\t.$#the in ﬁ１é́　あ한\x01\x00…℀ｶﾞ🙂", " the", " in ", "  ", "    ", "\r", "<|endoftext|>", "<s>", "</s>"]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["", " ", "a", "▁a", "  a  b\tc\n x ﬁ １ 　z ", "\x00a", "▁", "the ▁"] + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def spans(proto):
    """(id, begin, end) of the pieces in a serialised result, in bytes."""
    rows = [dict(S._fields(v)) for f, v in S._fields(proto) if f == 2]
    return [(r.get(2, 0), r.get(4, 0), r.get(5, 0)) for r in rows]


def field(number, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def agrees(mine, library, told):
    ids, at, begins, ends = mine.encode_batch(told)
    decoded = list(mine.decode_batch(ids, at))
    for k, x in enumerate(told):
        own = ids[at[k]:at[k + 1]].tolist()
        assert own == library.encode(x), repr(x)
        assert [*zip(own, begins[at[k]:at[k + 1]].tolist(), ends[at[k]:at[k + 1]].tolist())] == spans(library.encode(x, out_type="serialized_proto")), repr(x)
        assert str(decoded[k], "utf-8") == library.decode(own), repr(x)


def test_pieces_of_the_model():
    mine, library = S.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    agrees(mine, library, texts(600))
    agrees(mine, library, [f"a{chr(i)}b {chr(i)}{chr(i)} 1{chr(i)}" for i in range(1, 0x30000, 211) if not 0xD800 <= i < 0xE000])
    rng = random.Random(4)
    agrees(mine, library, ["".join(rng.choice("abc") for _ in range(50_000)), "  " * 20_000 + "a", "a" * 30_001, "word " * 20_000])
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, 3 + rng.randrange(256), 259 + rng.randrange(31_000), 28705]) for _ in range(rng.randrange(8))]
        assert mine.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
def test_pieces_after_any_character_map(rule, squeeze, prefix):
    with open(PIECES, "rb") as file:
        rest = b"".join(field(f, v) for f, v in S._fields(file.read()) if f != 3)
    told = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    rules = dict(S._fields(b"".join(v for f, v in S._fields(told) if f == 3))).get(2, b"")
    model = rest + field(3, field(1, b"x") + field(2, rules) + field(3, prefix) + field(4, squeeze) + field(5, 1))
    agrees(S.PieceCodec(model=model), sentencepiece.SentencePieceProcessor(model_proto=model), texts(120))


def test_longest_rule_wins():
    rules = S.CharacterMap(dict(S._fields(b"".join(v for f, v in S._fields(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto()) if f == 3)))[2])
    assert rules.longest("ﬁ".encode(), 0) == (b"fi", 3) and rules.longest("e\u0301".encode(), 0) == ("\u00e9".encode(), 3) and rules.longest(b"e", 0) == (None, 0)
    keys = set(rules.keys())
    assert len(keys) > 5000 and all(rules.longest(k, 0)[1] == len(k) for k in keys)


def test_other_models_are_refused():
    with open(PIECES, "rb") as file:
        parts = [*S._fields(file.read())]
    unigram = b"".join(field(f, b"".join(field(a, 1 if a == 3 else x) for a, x in S._fields(v) if isinstance(x, int) or a == 45) if f == 2 else v) for f, v in parts)
    with pytest.raises(ValueError):
        S.PieceCodec(model=unigram)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("ab cé\n▁") for _ in range(30_000))
    told = [None, *texts(40), long, long.replace("▁", ""), "same"] + ["same"] * 40
    rows = [(i, t, 1, 2, "k", [7]) for i, t in enumerate(told)] + [(3, "a", 1, 2, "k", [7]), (None, "same", 1, 2, "k", [7]), (None, None, 1, 2, "k", [7])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids int, links string, a_ids array<int>").repartition(3), rows


def test_sentencepiece_documents(odd):
    df, rows = odd
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(ids := library.encode(t or "")), digest(",".join(map(str, ids))), digest(library.decode(ids))) for i, t, *_ in rows]
    got = S.round_trip(df, PIECES).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == sorted(want, key=str)
    assert Counter(r.n_bytes for r in got) == Counter(len((t or "").encode()) for _, t, *_ in rows)
    whole = S.encode_documents(df, PIECES)
    for r in whole.join(df.filter("doc_id IS NOT NULL AND NOT (doc_id = 3 AND text = 'a')"), "doc_id").select("doc_id", whole.ids, "begins", "ends", "text").collect():
        if r.doc_id != 3:
            assert [*zip(r.ids, r.begins, r.ends)] == spans(library.encode(r.text or "", out_type="serialized_proto"))
    back = S.decode_documents(whole, PIECES).collect()
    assert Counter(r.text for r in back) == Counter(library.decode(library.encode(t or "")) for _, t, *_ in rows)
    assert S.round_trip(df.filter("false"), PIECES).collect() == []
    named = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert S.round_trip(named, PIECES).schema["doc_id"].dataType.simpleString() == "string" and S.round_trip(named, PIECES).count() == len(rows)


def brute_groups(first, second, alphabet, names, text):
    """Ids of both sides in groups, by walking over the byte ends that both have."""
    if not text:
        return []
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    told_a = [bytes(alphabet[c] for c in names[i]) for i in a]
    told_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(told_a) == b"".join(told_b) == (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum([len(t) for t in told_a]).tolist(), np.cumsum([len(t) for t in told_b]).tolist()
    out, i, j = [], 0, 0
    for stop in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(stop) + 1, ends_b.index(stop) + 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def brute_alignment(told):
    first, second = Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    names = {i: n for n, i in first.get_vocab().items()}
    alphabet = A.byte_alphabet()
    every = [brute_groups(first, second, alphabet, names, t) for t in told]
    counts = Counter((g[0][-1], g[1][-1]) for groups in every for g in groups)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for groups in every:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return every, out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_counts(odd):
    df, rows = odd
    every, want = brute_alignment([t for _, t, *_ in rows])
    got = A.alignment_counts(df, WORDS, public_tokenizers.PATTERN, PIECES)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == sorted([(r[0], *w) for r, w in zip(rows, want, strict=True)], key=str)
    assert A.alignment_counts(df.filter("false"), WORDS, public_tokenizers.PATTERN, PIECES).collect() == []
    assert {r.n_a for r in A.alignment_counts(df.filter("text IS NULL"), WORDS, public_tokenizers.PATTERN, PIECES).collect()} == {0}
    groups = {i: g for (i, *_), g in zip(rows, every, strict=True) if i is not None and i != 3}
    for r in A.align_documents(df, WORDS, public_tokenizers.PATTERN, PIECES).collect():
        if r.doc_id in groups:
            own = groups[r.doc_id]
            assert r.a_ids == [t for x, _ in own for t in x] and r.b_ids == [t for _, y in own for t in y]
            assert r.a_groups == [k for k, (x, _) in enumerate(own) for _ in x] and r.b_groups == [k for k, (_, y) in enumerate(own) for _ in y]


def test_alignment_of_the_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    _, want = brute_alignment([r.text for r in rows])
    got = Q.QUERIES["op12_token_alignment"](spark, folder).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *w) for r, w in zip(rows, want, strict=True))


def test_jumping_reaches_the_end_of_long_chains():
    a, b = np.arange(2, 20_001, 2), np.arange(1, 20_000, 2)     # ends interleave: one group only at the last byte
    b = np.append(b, 20_000)
    assert (A.jump(a, b) == len(a) + len(b) - 1).all()
    same = np.arange(1, 50)
    assert (A.jump(same, same) == np.concatenate([np.arange(49, 98)] * 2)).all()


def test_pairs_are_bounded_by_the_vocabularies():
    first, second, _ = A.codecs(WORDS, public_tokenizers.PATTERN, PIECES)
    tokens = [{bytes(c.bytes_of[c.bytes_at[i]:c.bytes_at[i + 1]]) for i in range(len(c.bytes_at) - 1)} for c in (first, second)]
    possible = sum(t[k:] in other for own, other in (tokens, tokens[::-1]) for t in own for k in range(len(t)))
    assert possible < sum(len(t) for side in tokens for t in side) < 700_000


def brute_negatives(rows, positives=5, negatives=3):
    kept = []
    for v, label, x in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((v, (label + 1) % 10 if v is not None and v % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for i, (v, label, x) in enumerate(kept):
        if v is None or v % 50:
            continue
        scored = [(min(max(sum(p * q for p, q in zip(x, y, strict=False)), -(1 << 63) + 1), (1 << 63) - 1), w, j, other) for j, (w, other, y) in enumerate(kept) if j != i]
        for s, w, _, _ in sorted([s for s in scored if s[3] == label], key=order)[:positives]:
            fit = sorted([t for t in scored if t[3] != label and 50 * s <= 100 * t[0] <= 95 * s], key=order)[:negatives]
            out += [(v, w, k + 1, t[1], s, t[0]) for k, t in enumerate(fit)]
    return sorted(out, key=str)


def vectors(n, seed, scale=0.3, width=6):
    rng = random.Random(seed)
    rows = [(i if rng.random() < 0.9 else rng.randrange(n), rng.randrange(3), [rng.gauss(0.2, scale) for _ in range(width)]) for i in range(n)]
    return rows + rows[:60] + [(None, 1, [0.5] * width), (None, 2, [0.4] * width), (50, None, [0.1] * width), (100, 1, None), (150, 1, [0.1, None] + [0.0] * (width - 2)), (200, 1, [float("nan")] + [0.1] * (width - 1)),
                               (250, 2, [float("inf")] + [0.1] * (width - 1)), (300, 1, []), (350, 1, [0.7]), (-50, 1, [0.4] * width), (-7, 8, [0.2] * width)]


def query_label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("scale", [0.3, 400.0, 1e8])
def test_hard_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(H, "SLICE_ROWS", (40, 40))
    monkeypatch.setattr(H, "SLICE_ANCHORS", (3, 3))
    monkeypatch.setattr(H, "SCORES", 90)
    rows = vectors(300, 5, scale)
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "vec_id long, label int, embedding array<double>, uid long, score double, down string").repartition(5)
    got = H.hard_negatives(df, label=query_label()).collect()
    assert sorted(map(tuple, got), key=str) == brute_negatives(rows) and len(got) > 20
    assert H.hard_negatives(df.filter("false"), label=query_label()).collect() == []


def test_hard_negatives_of_one_hot_vector(spark):
    rows = vectors(200, 6) + [(50 * i, 1, [0.3] * 6) for i in range(20)] + [(i, 2, [0.2] * 6) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    rows = [(v, label, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for v, label, x in rows]
    assert sorted(map(tuple, H.hard_negatives(df, label=query_label()).collect()), key=str) == brute_negatives(rows)


@pytest.mark.parametrize("low,high,width", [(-300, 300, 64), (-5, 9, 16), (0, 0, 4), (-70_000, 5, 8), (-(1 << 24), 1 << 24, 32), (-(1 << 29), 1 << 29, 8)])
def test_packed_products_are_exact(low, high, width):
    rng = np.random.default_rng(7)
    rows, anchors = (rng.integers(low, high + 1, (n, width)).astype(float) for n in (57, 9))
    packed = H.Packed(rows, int(anchors.max()), int(anchors.min()))
    want = [[sum(int(p) * int(q) for p, q in zip(a, r, strict=True)) for r in rows] for a in anchors]
    assert packed.scores(anchors).tolist() == want
    if high == 9:
        assert packed.fields >= 4
