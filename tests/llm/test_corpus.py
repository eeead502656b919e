"""Near-duplicates, line templates, packing and the pipeline."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from epiframe.llm import line_dedup, minhash, packing
from epiframe.llm.components import components


def shingles(text, width):
    w = [x for x in re.split(r"[ \x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return frozenset([tuple(w)]) if 0 < len(w) < width else frozenset(zip(*[w[i:] for i in range(width)], strict=False))


def brute(rows, width):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for _ in range(250):                      # one hot group, edits from none to many
        t = list(base)
        for _ in range(rng.randrange(0, 16)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(80)]
    texts += [None, "", " \n", "One", "one", "one two", "ONE  two", texts[0]] + ["same here again and again"] * 60
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in rows] + [(None, "one", "k", 3)], "doc_id long, text string, key string, n int").repartition(4)
    got = minhash.near_duplicates(df, width=width).collect()
    want = brute(rows, width)
    assert len(got) == len(rows) + 1
    for r in got:
        assert r.doc_id is None and r.kept or (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(df.filter("false")).collect() == []


def test_registered_near_duplicates_on_the_documents(spark):
    from epiframe.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_minhash_tensor"](spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows, 2)


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + [(None, 3)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_recurring_lines_go_but_for_the_first(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["sun", "moon", "tide", "leaf", "stone", "river", "cloud"]) + str(i % 3 and "") for i in range(n))
    notice = "All rights reserved by page {} of the house"
    wide = "the quick brown fox jumps over {} lazy dogs near the river bank today"
    docs = [f"{prose(12)} u{'abcdefghijklmnop'[i]}\n{notice.format(i)}\n{wide.format(['ten', 'six', 'two', 'nine', 'four', 'five'][i])}\n" for i in range(6)]
    copies = ["this copied line stands in many equal texts only\nand so does this one"] * 9
    odd = [None, "", "\n\n", "x" * 60_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs + copies + odd)] + [(None, docs[0], 1)], "doc_id long, text string, pos int").repartition(3)
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(df).collect()}
    assert len(got) == len(docs + copies + odd) + 1
    kept = Counter()
    for i, t in enumerate(docs):
        assert got[i].text.split("\n")[0] == t.split("\n")[0]
        kept["notice"] += "All rights" in got[i].text
        kept["wide"] += "quick brown" in got[i].text
    assert kept == {"notice": 1, "wide": 1}
    for i in range(len(docs), len(docs + copies + odd)):
        assert got[i].text == (copies + odd)[i - len(docs)] and got[i].lines_dropped == 0
    assert got[None].text == got[0].text
    assert line_dedup.drop_recurring_lines(df.filter("false")).collect() == []


def test_long_lines_recur_from_two_texts_on(spark):
    passage = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(60))
    short = "a short line of two texts"
    texts = [f"own first words\n{passage}\n{short}", f"{short}\nother words here\n{passage}", f"{passage} tail\n{passage} more tail"]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sorted(got[i].lines_dropped for i in (0, 1)) == [0, 1] and got[2].lines_dropped == 0
    assert sum(passage in got[i].text.split("\n") for i in (0, 1)) == 1
    assert all(short in got[i].text for i in (0, 1))


def test_every_template_of_a_leaf_is_found(spark):
    fields = ["amber", "birch", "cedar", "delta", "ebony", "fjord", "grape"]
    kinds = ["the server said that user {} came in by the front door", "the server said some old files of {} were moved away today", "the server said nothing more about the {} plan until the evening"]
    texts = [f"{kinds[k].format(f)}\nown words {f} {'xyz'[k]}" for k in range(3) for f in fields] + ["the server said one thing that is unlike all of these"]
    got = line_dedup.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    lines = [line for r in got for line in r.text.split("\n")]
    assert [sum(line.startswith(k.split("{")[0]) for line in lines) for k in kinds] == [1, 1, 1]
    assert sum("own words" in line for line in lines) == 21 and texts[-1] in lines


def test_rows_of_numbers_are_no_template(spark):
    tables = ["\n".join(f"{t}{r} {r * 7 + t} {100 * t + r}" for r in range(5)) + f"\n{1990 + t}\nB{t} 4\n" + " ".join(str(x * t) for x in range(24)) + "\n7 0 0 0 0 0 0 0 0 0 0 " + str(t) for t in range(1, 5)]
    notices = [f"page {t} of the annual report\n2001 2002 2003" for t in range(1, 5)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame(list(enumerate(tables + notices)), "doc_id long, text string")).collect()}
    assert [got[i].text for i in range(4)] == tables
    left = [line for i in range(4, 8) for line in got[i].text.split("\n")]
    assert sum(line.startswith("page") for line in left) == 1 and left.count("2001 2002 2003") == 1


def test_line_templates_run_without_python(spark):
    from epiframe.llm.queries import QUERIES
    plan = QUERIES["op4_line_templates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_have_the_least_padding(seed):
    rng = np.random.RandomState(seed)
    lengths = np.unique(rng.randint(0, 60, 11))
    counts = rng.randint(1, 50, len(lengths))
    cost = lambda bounds: sum(c * (min(b for b in bounds if b >= v) - v) for v, c in zip(lengths.tolist(), counts.tolist(), strict=True))
    for k in (1, 2, 3, 5):
        best = min(cost([*s, lengths[-1]]) for s in itertools.combinations(lengths.tolist()[:-1], min(k, len(lengths)) - 1))
        assert cost(packing.optimal_bounds(lengths, counts, k)) == best


def test_packing(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(packing, "SLICE", 50)
    rng = random.Random(3)
    n = [5] * 300 + [rng.randrange(0, 900) for _ in range(200)] + [5000, None]
    df = spark.createDataFrame([(i, x, 7) for i, x in enumerate(n)] + [(0, 5, 7), (None, 5, 7)], "doc_id long, size long, bucket int").repartition(5)
    got = packing.pack(df, F.col("size"), buckets=4, budget=2000).collect()
    assert len(got) == len(n) + 2 and len({(r.bucket, r.batch, r.position) for r in got}) == len(got)
    for (b, _), rows in itertools.groupby(sorted(got, key=lambda r: (r.bucket, r.batch, r.position)), key=lambda r: (r.bucket, r.batch)):
        rows = list(rows)
        assert [r.position for r in rows] == list(range(len(rows))) and (len(rows) == 1 or len(rows) * rows[0].bucket_length <= 2000)
        assert all(0 <= r.padding == r.bucket_length - r.n_tokens for r in rows)
    for b in {r.bucket for r in got}:
        each = max(1, 2000 // max(1, next(r.bucket_length for r in got if r.bucket == b)))
        assert max(r.batch for r in got if r.bucket == b) == (sum(r.bucket == b for r in got) - 1) // each
    assert packing.pack(df.filter("false"), F.col("size")).collect() == []
    text = spark.createDataFrame([("a b  c\n",), ("",), (None,), (" ",)], "text string")
    assert sorted(r[0] for r in text.select(packing.word_count(F.col("text"))).collect()) == [0, 0, 0, 3]


def test_one_very_long_text_leaves_the_bounds_of_the_others(spark):
    from pyspark.sql import functions as F
    n = [10] * 40 + [11] * 30 + [200] * 20 + [205] * 10 + [5_000_000]
    got = packing.pack(spark.createDataFrame(list(enumerate(n)), "doc_id long, size long"), F.col("size"), buckets=5).collect()
    assert {r.bucket_length for r in got} == set(n) and sum(r.padding for r in got) == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(100_001, None, None, None, 0), (100_002, "", "en", "src0", 0), (100_003, "123 456", "en", "src0", 7), (100_004, docs.first().text + " tail", None, None, None)], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [given]
    for name, stage in P.STAGES:
        out = stage(spark, seen[-1], str(tmp_path)).persist()
        if name != "packing":
            assert out.schema.simpleString() == given.schema.simpleString()
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] - ids[1] == {100_001, 100_002, 100_003}
    before = {r.doc_id: r.text for r in seen[2].collect()}
    want = brute(list(before.items()), 5)
    assert ids[3] == {i for i, (_, c) in want.items() if i == c}
    assert ids[4] == ids[3] and ids[5] == ids[4]
    masked = seen[4].collect()
    assert all(not re.search(r'(?i)token = "[0-9a-f]{40}"', r.text) and r.n_chars == len(r.text) for r in masked)
    packed = {r.doc_id: r.n_tokens for r in seen[5].collect()}
    assert all(packed[r.doc_id] == len(r.text.split()) for r in masked)
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == ids[5]
