"""Exact set-similarity search against all pairs."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from epiframe.operators import setjoin as S


def shingles(text, k):
    words = "".join(c.lower() if c.isalnum() else " " for c in text or "").split()
    if not words:
        return frozenset()
    return frozenset({" ".join(words[i:i + k]) for i in range(len(words) - k + 1)} or {" ".join(words)})


def brute(rows, k, t):
    sets = [shingles(x, k) for _, x in rows]
    smallest = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None and (s not in smallest or i < smallest[s]):
            smallest[s] = i
        smallest.setdefault(s, None)
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        close = [(Fraction(len(s & o), len(s | o)), smallest[o]) for o in sets if o != s and s and o and Fraction(len(s & o), len(s | o)) >= t]
        best = min(((-j, -1 if c is None else c) for j, c in close), default=None)
        out.append((i, len(s), smallest[s], sets.count(s), len(close), best[1] if best else None, round(float(-best[0]), 9) if best else None))
    return sorted(out, key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus(seed):
    """A third of all rows near one text, exact copies, pairs at the threshold, common openings, odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = [edited(rng, base, rng.randrange(4)) for _ in range(90)] + [" ".join(base)] * 20
    texts += [" ".join(["the", "same", "long", "opening", "of", "all"] + [rng.choice(vocabulary) for _ in range(rng.randrange(3, 40))]) for _ in range(60)]
    for n in (10, 18, 27):                                     # sizes where 0.8 is met exactly or just missed
        words = [f"x{n}y{i}" for i in range(n + 2)]
        texts += [" ".join(words), " ".join(words[:-2]), " ".join(words[1:]), " ".join([*words, "more"])]
    texts += [None, "", " .,; ", "one", "one", "one two", "One, TWO!", " ".join(f"z{i % 700}q{i % 11}" for i in range(4000)), " ".join(f"z{i % 700}q{i % 11}" for i in range(4100))]
    rng.shuffle(texts)
    return [(i, x) for i, x in enumerate(texts)] + [(3, "one"), (None, "one")]


@pytest.mark.parametrize("k,t", [(5, 0.8), (2, 0.8), (3, 0.5), (1, 1.0)])
@pytest.mark.parametrize("limit", [S.BLOCK_SHINGLES, 300])
def test_similar_documents(spark, k, t, limit):
    rows = corpus(7)
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, n int, cell double").repartition(5)
    got = S.similar_documents(df, "doc_id", "text", k, t, limit).collect()
    assert sorted([(*r[:6], None if r[6] is None else round(r[6], 9)) for r in got], key=str) == brute(rows, k, Fraction(t).limit_denominator(100))


def test_pairs_and_empty_tables(spark):
    rows = [r for r in corpus(8) if r[0] is not None]
    df = spark.createDataFrame([(f"d{i:04}", x) for i, x in rows], "name string, text string")
    members, classes = S.set_classes(df, "name", F.split("text", " "))
    got = {(r.a, r.b): r.similarity for r in S.similar_pairs(classes, 0.7, 500).collect()}
    sets = {r.class_id: frozenset(r["set"]) for r in classes.collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in got) and len(got) > 1000
    assert members.count() == len(rows)
    assert S.similar_documents(df.filter("false"), "name", "text").collect() == []
    assert {r.links for r in S.similar_documents(df.filter("text = ''"), "name", "text").collect()} == {0}


def test_a_hot_group_is_split_and_listed_nowhere(spark):
    """Blocks of a hot group are many and small, and links between blocks far fewer than pairs of sets."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    df = spark.createDataFrame([(i, edited(rng, base, 1)) for i in range(400)] + [(1000 + i, " ".join(f"q{rng.randrange(9000)}" for _ in range(50))) for i in range(800)], "id long, text string")
    _, classes = S.set_classes(df, "id", S.word_shingles(F.col("text"), 3))
    blocks = S.written(S._blocks(classes, 0.8, 1500))
    held = blocks.groupBy("block").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    assert blocks.count() == 400 and len(held) >= 15 and max(r.n for r in held) <= 4000
    linked = S._linked(blocks, 0.8)
    assert linked.count() <= len(held) * (len(held) + 1) // 2 < 400
    assert S.similar_pairs(classes, 0.8, 1500).count() > 10_000


def test_shingles_are_dealt_out_packed_and_once(spark, monkeypatch):
    """No row per shingle in the search for shared ones, and the same rows with many buckets."""
    plans, real = [], S.written
    monkeypatch.setattr(S, "written", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or real(d))
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, classes = S.set_classes(df, "doc_id", S.word_shingles(F.col("text"), 5))
    plans.clear()
    S._blocks(classes.filter("n > 0"), 0.8, 1500)
    assert len(plans) == 1 and "explode(set" not in plans[0]
    monkeypatch.setattr(S, "BUCKET_SHINGLES", 100)
    got = S.similar_documents(df, "doc_id", "text", 5, 0.8, 1500).collect()
    assert sorted([(*r[:6], None if r[6] is None else round(r[6], 9)) for r in got], key=str) == brute(rows, 5, Fraction(8, 10))
