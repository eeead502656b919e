"""Quality rules, language identification, secrets and transcripts: held-out accuracy, brute force, odd rows."""

import math
import random
import re
import zlib

import numpy as np

from epiframe.llm import chat, langid, quality, secrets
from epiframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    rows = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in rows.items())
    held = [(labels[i], r.predicted) for i, r in rows.items() if r.held_out and i in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_quality_of_odd_rows_and_labels(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "a b", 0.5), (4, "x" * 100_000, 0.5)], "doc_id long, text string, letters double")
    rows = quality.with_statistics(df)
    assert rows.count() == 5 and rows.filter("text IS NOT NULL").count() == 0 if "text" in rows.columns else True
    assert [r[0] for r in rows.select(quality.RuleEnsemble().score()).collect()] == [0.5] * 5
    one = quality.fit(rows.selectExpr("*", "1 AS label"), "label")
    assert all(r[0] > 0.99 for r in rows.select(one.score()).collect())
    assert quality.fit(rows.selectExpr("*", "CAST(NULL AS INT) AS label"), "label").intercept == 0.0
    assert quality.statistics_of([b""]).sum() == 0


def test_compiled_rules_equal_their_paths(spark):
    rule = frozenset({(0, True, 1.0), (1, False, 2.0)})
    model = quality.RuleEnsemble(0.3, [(rule, 2.0)], [(2, -1.0)])
    x = [tuple(float(v) for v in r) for r in np.random.RandomState(1).rand(20, len(quality.STATISTICS)) * 3]
    df = spark.createDataFrame(x, ", ".join(f"{s} double" for s in quality.STATISTICS))
    want = [1 / (1 + np.exp(-(0.3 + 2.0 * (r[0] > 1 and r[1] <= 2) - r[2]))) for r in x]
    assert np.allclose(sorted(r[0] for r in df.select(model.score()).collect()), sorted(want))


def test_language_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in QUERIES["op6_language_family"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows.values())
    held = [d.lang == rows[d.doc_id].lang_pred for d in docs if rows[d.doc_id].held_out]
    assert sum(held) / len(held) > 0.97


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, "text", "lang")
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "123 !!", 9), (None, "der die das und ist nicht eine", 9), (4, "der die das und ist nicht eine", 9), (4, "der die das und ist nicht eine", 9)], "doc_id long, text string, score int")
    got = [tuple(r) for r in langid.identify(df, model).select("doc_id", "lang_pred", "score").collect()]
    assert len(got) == 6 and sorted(x for _, x, _ in got) == ["de"] * 3 + ["und"] * 3 and all(s == 0 for _, x, s in got if x == "und")
    none = langid.fit(docs.filter("false"), "text", "lang")
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    alone = langid.fit(docs.filter("lang = 'fr'"), "text", "lang")
    assert {r.lang_pred for r in langid.identify(docs.limit(5), alone).collect()} == {"fr"}
    assert langid.identify(df.filter("false"), model).collect() == []


def test_secrets_are_found_and_plain_text_is_left(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_secret_forest"](spark, SF).collect()}
    wanted = found = other = 0
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        true = {m.span(1) for m in re.finditer(rb'(?i)token = "([0-9a-f]{40})"', d.text.encode())}
        got = {(s.begin, s.stop) for s in rows[d.doc_id].spans}
        wanted, found, other = wanted + len(true), found + len(true & got), other + len(got - true)
    assert wanted and found / wanted > 0.9 and other <= 0.2 * wanted


def test_secrets_in_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = secrets.fit(secrets.planted_findings(docs, path="source"))
    key = "27660c51feb63980dfaee7464f96210544c03fc3"
    df = spark.createDataFrame([(1, None, None, "s"), (2, "", "a", "s"), (None, f'é token = "{key}" é', "b.py", "s"), (3, "word " * 20_000, "b", "s"), (3, "word " * 20_000, "b", "s")], "doc_id long, text string, source string, spans string")
    got = secrets.scan(df, forest, path="source").collect()
    assert len(got) == 5 and {r.text for r in got if r.doc_id == 1} == {None}
    assert [r.text for r in got if r.doc_id is None] == ['é token = "[SECRET]" é']
    assert all(r.n_secrets == 0 for r in got if r.doc_id is not None)
    assert all(r.n_secrets == 0 for r in secrets.scan(df, secrets.fit(secrets.planted_findings(docs.filter("false")))).collect())
    assert secrets.scan(df.filter("false"), forest).collect() == []


def test_language_counts_all_texts_but_candidates(spark):
    key = "AbcdefAbcdef0123456789"
    texts = [None, "", "one two Two\u00e9 two", f"token {key} two", "rare word " + "word " * 5000, "x" * 30 + " three three three"] * 2 + [f"key {key}"] * 50
    df = spark.createDataFrame([(t, 0) for t in texts], "text string, word int").repartition(3)
    got = secrets.corpus_language(df, share=1e-3)
    plain = [re.sub(rb"[0-9a-zA-Z+/_=.-]{16,}", lambda m: b" " * len(m.group()), t.encode()).lower() for t in texts if t]
    words = [w for t in plain for w in re.findall(rb"[a-z\x80-\xff]+", t) if 3 <= len(w) <= 24]
    assert got.words == {w for w in words if words.count(w) >= max(3, len(words) / 1000)} == {b"word", b"key"}
    pairs = np.ones((27, 27))
    for t in plain:
        x = [c - 96 if 97 <= c <= 122 else 0 for c in t]
        for a, b in zip(x, x[1:]):
            pairs[a, b] += 1
    assert np.allclose(got.pairs, np.log(pairs / pairs.sum(1, keepdims=True)))
    none = secrets.corpus_language(df.filter("false"))
    assert none.words == frozenset() and np.allclose(none.pairs, math.log(1 / 27))


def test_forest_arrays_equal_the_library(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    rng = random.Random(5)
    rows = [([rng.random() for _ in range(4)], 0.0) for _ in range(300)]
    rows = [(x, float(x[0] > 0.5 and x[1] < 0.6)) for x, _ in rows]
    df = spark.createDataFrame(rows, "x array<double>, label double").select("label", "x", array_to_vector("x").alias("v"))
    model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=5, maxDepth=4, seed=1).fit(df)
    got = model.transform(df).select("x", F.col("probability").cast("string").alias("p")).collect()
    mine = secrets.Forest(trees=[secrets._arrays(t._java_obj.rootNode()) for t in model.trees]).score(np.array([r.x for r in got]))
    assert np.allclose(mine, [float(r.p.strip("[]").split(",")[1]) for r in got])


def _plain_viterbi(model, symbols):
    score, back = model.start + model.emit[:, symbols[0]], []
    for x in symbols[1:]:
        total = score[:, None] + model.move
        back.append(total.argmax(0))
        score = total.max(0) + model.emit[:, x]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_chunked_viterbi_is_viterbi(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_LINES", 7)
    rng = random.Random(6)
    lines = [(c, i, rng.choice(["User: hi", "yes", "Assistant: " + "word " * 60, "why?", "", "long " * 90])) for c in (1, 2, 3) for i in range(rng.randrange(30, 60))]
    labelled = spark.createDataFrame([(1, 0, "User: a", "user", True, None), (1, 1, "b", "user", False, None), (1, 2, "Assistant: c", "assistant", True, "user")], "c int, n long, line string, role string, begins boolean, previous string")
    model = chat.fit(chat.observed(labelled, "c", "n", "line"), "role", "begins", "previous")
    seen = chat.observed(spark.createDataFrame(lines, "c int, n long, line string"), "c", "n", "line")
    got = chat.recover_roles(seen, model).collect()
    assert len({r.chunk for r in got}) > 3
    for c in (1, 2, 3):
        own = sorted((r for r in got if r.conv == c), key=lambda r: r.line_no)
        path = _plain_viterbi(model, [r.o for r in own])
        assert [r.role_pred for r in own] == [model.roles[p // 2] for p in path]
        begins = [p % 2 == 0 or i == 0 for i, p in enumerate(path)]
        assert [r.turn_begin for r in own] == begins and [r.turn_no for r in own] == np.cumsum(begins).tolist()


def test_lines_of_one_number_are_cut_into_chunks_too(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_LINES", 5)
    rows = [("a", None, f"User: {i:03d}?") for i in range(33)] + [("b", 4, "same")] * 12 + [(None, i // 3, None) for i in range(9)]
    df = spark.createDataFrame(rows, "conv string, n long, line string")
    got = chat.numbered(chat.observed(df, "conv", "n", "line")).collect()
    for conv, n in (("a", 33), ("b", 12), (None, 9)):
        own = sorted((r.line_no, r.text, r.chunk) for r in got if r.conv == conv)
        assert sorted(r[2] for r in own) == [i // 5 for i in range(n)]
        assert [r[2] for r in own] == sorted(r[2] for r in own)


def test_every_line_of_a_long_turn_has_its_own_number(spark):
    df = spark.createDataFrame([("c", 0, "user", "\n".join(str(i % 7) for i in range((1 << 20) + 50))), ("c", 1, "assistant", "end")], "conv_id string, turn int, role string, text string")
    got = chat.transcript_lines(df, 0.0).selectExpr("count(*) n", "count(DISTINCT line_no) d", "max(CASE WHEN role = 'user' THEN line_no END) u", "max(line_no) t").first()
    assert (got.n, got.d, got.u, got.t) == ((1 << 20) + 51, (1 << 20) + 51, (1 << 20) + 49, chat.TURN_LINES)


def test_clashing_columns_of_lines(spark):
    df = spark.createDataFrame([(1, 0, "User: hi", "x", 5, "k", 7, True, "u"), (1, 1, "Bot: yes", "y", 6, "l", 8, False, "v")], "c int, n int, line string, text string, M int, conv string, chunk int, turn_begin boolean, text_in string")
    seen = chat.observed(df, "c", "n", "line")
    assert seen.columns == ["conv", "line_no", "text", "text_in_in", "M_in", "conv_in", "chunk_in", "turn_begin_in", "text_in", "m", "o"]
    labelled = seen.selectExpr("*", "CASE WHEN m = 2 THEN 'user' ELSE 'assistant' END role", "TRUE begins", "CAST(NULL AS STRING) previous")
    out = sorted(chat.rendered(chat.recover_roles(seen, chat.fit(labelled, "role", "begins", "previous"))).collect(), key=lambda r: r.line_no)
    assert [(r.text, r.text_in, r.text_in_in, r.M_in, r.chunk_in, r.turn_begin_in) for r in out] == [("User: hi", "u", "x", 5, 7, True), ("Bot: yes", "v", "y", 6, 8, False)]


def test_transcripts(spark):
    rows = QUERIES["op8_chat_roles"](spark, SF).collect()
    assert sum(r.role_pred == r.role_true for r in rows) / len(rows) > 0.8
    df = spark.createDataFrame([(1, 0, None, None, 1), (1, 0, "user", "", 1), (None, None, "user", "Hi?\nx", 1), (1, 1, "assistant", "y" * 50_000, 1), (1, 1, "assistant", "y" * 50_000, 1)], "conv_id long, turn long, role string, text string, key int")
    seen = chat.observed(chat.transcript_lines(df), "conv_id", "line_no", "line")
    out = chat.rendered(chat.recover_roles(seen, chat.fit(seen, "role", "begins", "previous"))).collect()
    assert len(out) == 6 and all(r.rendered.startswith("<|") for r in out if r.turn_begin)
    empty = chat.observed(chat.transcript_lines(df.filter("false")), "conv_id", "line_no", "line")
    assert chat.recover_roles(empty, chat.fit(empty, "role", "begins", "previous")).collect() == []


def test_copies_of_one_text_are_one_in_the_language_sample(spark):
    """A hot group of copies neither crowds out other languages nor other texts, and a rerun fits the same."""
    import random

    from epiframe.llm import langid
    rng = random.Random(11)
    words = {"de": ["und", "schön", "straße", "nicht"], "en": ["the", "with", "house", "away"], "fr": ["très", "où", "garçon", "voilà"], "es": ["año", "niño", "qué", "está"]}
    text = {k: lambda k=k: " ".join(rng.choice(words[k]) for _ in range(12)) for k in words}
    rows = [("de", "und nicht straße")] * 2000 + [(k, text[k]()) for k in words for _ in range(40)] + [("en", None), (None, "the house")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    model, again = (langid.fit(d, "text", "lang", 80) for d in (df, df.repartition(3)))
    assert sorted(x for f in model.families for x in f) == sorted(words)
    assert np.allclose(model.weights, again.weights, atol=1e-4)
    held = spark.createDataFrame([(k, text[k]()) for k in words for _ in range(20)], "lang string, text string")
    assert langid.identify(held, model).filter("lang <> lang_pred").count() <= 4


def test_null_identifiers_are_not_held_out_by_accident(spark):
    from epiframe.llm.common import crc_remainder
    df = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert all(r[0] in range(4) for r in df.select(crc_remainder("doc_id", 4)).collect())
