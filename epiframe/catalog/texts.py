"""TXT: text at corpus scale."""

from pyspark.sql import functions as F

from ..operators import setjoin as S
from ..operators import text as X
from ..plans.ordered import scan
from .registry import query, rounded


#: Patterns that look behind a match: regular expressions of SQL cannot say them.
LOOKING = [k for k, p in X.IDENTIFIERS.items() if "(?<!" in p]
TOLD = [k for k in X.IDENTIFIERS if k not in LOOKING]


def _sql(pattern):
    """The pattern for SQL: white space as six signs, quotes doubled."""
    return pattern.replace(r"\S", r"[^ \t\n\x0B\f\r]").replace("'", "''")


@query("txt01_document_hits", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{_sql(X.IDENTIFIERS[k])}'))::INT AS {k}" for k in TOLD) + " FROM documents")
def hits(t):
    return X.document_hits(t.documents, ["doc_id"], "text", {k: X.IDENTIFIERS[k] for k in TOLD})


@query("txt01_document_hits_looking")
def looking(t):
    return X.document_hits(t.documents, ["doc_id"], "text", {k: X.IDENTIFIERS[k] for k in LOOKING})


HEADER = r"(?:^|\n)([A-Z]\p{L}+)\."


@query("txt01_pii_counts")
def pii(t):
    s = X.pii_counts(t.documents, ["doc_id"], "text", HEADER).withColumn("part", F.when(F.col("section") == "other", "other").otherwise("headed"))
    return s.groupBy("category", "part").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


@query("txt02_split_sections")
def sections(t):
    d = X.split_sections(t.documents, ["doc_id"], "text", HEADER)
    return d.groupBy("section").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


@query("txt02_sentences", r"""
SELECT conv_id, turn, len([x FOR x IN string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1§', 'g'), '\n{2,}', '§', 'g'), '\n([A-Z])', '§\1', 'g'), '§') IF trim(x, ' ') <> ''])::INT AS n_sentences FROM conversations""")
def sentence_counts(t):
    return t.conversations.select("conv_id", "turn", F.size(X.sentences(F.col("text"))).alias("n_sentences"))


@query("txt03_plant_and_recall")
def recall(t):
    d = t.documents.select("doc_id", "text")
    return rounded(X.detector_recall(d, X.plant(d, "doc_id", "text", seed=5), "doc_id", "text", X.IDENTIFIERS))


@query("txt04_label_text", r"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1§', 'g'), '\n{2,}', '§', 'g'), '\n([A-Z])', '§\1', 'g'), '§')) AS x FROM documents),
l AS (SELECT doc_id, lower(trim(x, ' ')) AS x FROM s WHERE trim(x, ' ') <> ''), r AS (SELECT doc_id, CASE WHEN NOT regexp_matches(x, '\bthe\b') THEN 0 ELSE CASE WHEN regexp_matches(x, '\bof\b') AND NOT regexp_matches(regexp_extract(x, '^(?s:(.*?))\bthe\b', 1), '\band\b') THEN 2
  WHEN regexp_matches(regexp_extract(x, '^(?s:(.*?))\bthe\b', 1), '\band\b') OR (regexp_matches(x, '\band\b') AND length(regexp_extract(x, '^(?s:(.*?))\bthe\b', 1)) < 40) THEN 1 ELSE 3 END END AS r FROM l)
SELECT d.doc_id, CASE max(r) WHEN 3 THEN 1 WHEN 2 THEN -1 WHEN 1 THEN 0 END::INT AS article, count(*) FILTER (r > 0)::INT AS article_evidence FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY 1""")
def labels(t):
    return X.label_text(t.documents, ["doc_id"], "text", {"article": [r"\bthe\b"]}, [r"\band\b"], [r"\bof\b"])


def dictionary(t):
    """Two-word phrases of the benchmark passages as synonyms of their first word."""
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    d = t.benchmark.select(F.col("item_id"), w.alias("w"))
    two = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)).alias("synonym"), F.element_at("w", i).alias("term")))
    return d.filter(F.size("w") > 1).select(F.inline(two)).groupBy("synonym").agg(F.min("term").alias("term"))


@query("txt05_extract_terms")
def terms(t):
    m = X.extract_terms(t.documents, ["doc_id"], "text", dictionary(t), "synonym", "term", ["no", "not", "without", "and"])
    return m.groupBy("term", "negated").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("txt05_on_label")
def labelled(t):
    d = t.documents.withColumn("k", F.col("source"))
    m = X.extract_terms(d, ["k", "doc_id"], "text", dictionary(t), "synonym", "term", ["no", "not"]).select("k", "term").distinct()
    l = X.extract_terms(d.filter("doc_id % 3 = 0"), ["k", "doc_id"], "text", dictionary(t), "synonym", "term", ["no", "not"]).select("k", F.col("term").alias("lt"), F.lit("exact").alias("kind")).distinct()
    return X.on_label(m, ["k"], "term", l, "lt", "kind").groupBy("label_status").agg(F.count("*").alias("n"))


@query("txt06_diff_versions", r"""
WITH s AS (SELECT conv_id, turn, list_distinct([trim(x, ' ') FOR x IN string_split(regexp_replace(text, '([.;])\s+', '\1§', 'g'), '§') IF trim(x, ' ') <> '']) AS s FROM conversations), p AS (SELECT *, lag(s) OVER w AS ps, lag(turn) OVER w AS previous FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, previous, turn, len([x FOR x IN s IF NOT list_contains(ps, x)])::INT AS n_added, len([x FOR x IN ps IF NOT list_contains(s, x)])::INT AS n_removed FROM p WHERE previous IS NOT NULL""")
def versions(t):
    d = X.diff_versions(t.conversations, ["conv_id"], "turn", "text", 64)
    return d.select("conv_id", "previous", "turn", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"))


@query("txt07_shingle_similarity")
def similarity(t):
    d = t.documents.select("doc_id", "source", "text")
    p = scan(d.select("source", "doc_id"), ["source"], "doc_id", {"other": ("lead", "doc_id")}, 200.0).filter("other IS NOT NULL").select("doc_id", "other")
    return rounded(X.shingle_similarity(p, "doc_id", "other", d, "doc_id", "text", 3))


@query("txt07_similar_documents", r"""
WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s FROM w),
m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS class_rows FROM s), c AS (SELECT class_id, class_rows, s, len(s) AS n FROM m WHERE doc_id = class_id),
e AS (SELECT class_id, n, class_rows, unnest(s) AS h FROM c), o AS (SELECT a.class_id, b.class_id AS other, a.n, b.n AS m, b.class_rows AS rows, count(*) AS o FROM e a JOIN e b ON a.h = b.h AND a.class_id <> b.class_id GROUP BY ALL),
j AS (SELECT *, o / (n + m - o) AS jac FROM o WHERE 5 * o >= 4 * (n + m - o)), l AS (SELECT class_id, sum(rows)::BIGINT AS links, arg_min(other, (-jac, other)) AS best_id, max(jac) AS best_similarity FROM j GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, class_id, class_rows, coalesce(links, 0)::BIGINT AS links, best_id, round(best_similarity, 6) AS best_similarity FROM m LEFT JOIN l USING (class_id)""")
def similar_documents(t):
    return rounded(S.similar_documents(t.documents.select("doc_id", "text"), "doc_id", "text"))


GRAMS = r"""w AS (SELECT item_id, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF length(x) >= 3] AS w FROM benchmark), g AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(w) AS term FROM w UNION ALL SELECT item_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM g GROUP BY 1), k AS (SELECT item_id, g.term, (1 + ln(c)) * ln(((SELECT count(*) FROM benchmark) + 1) / (df + 0.5::DOUBLE)) AS x FROM g JOIN df USING (term) WHERE c >= 2 OR NOT contains(g.term, ' ')),
top AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(x, 9) DESC, term) <= 10)"""


@query("txt08_key_terms", f"WITH {GRAMS} SELECT item_id, term, round(x / sum(x) OVER (PARTITION BY item_id), 6) AS weight FROM top")
def keys(t):
    return rounded(X.key_terms(t.benchmark, "item_id", "text", 10))


@query("txt08_coverage_scores", f"""
WITH {GRAMS}, n AS (SELECT item_id, term, x / sum(x) OVER (PARTITION BY item_id) AS weight FROM top), dw AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') IF length(x) >= 3] AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(w) AS term FROM dw UNION ALL SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM dw)) SELECT item_id, doc_id, round(sum(weight), 5) AS score FROM n JOIN dg USING (term) GROUP BY 1, 2""")
def coverage(t):
    return rounded(X.coverage_scores(X.key_terms(t.benchmark, "item_id", "text", 10), "item_id", t.documents, "doc_id", "text"), 5)


@query("txt09_extract_mentions", r"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/[A-Za-z]+"')) AS v FROM pages) SELECT page_id, upper(v) AS value, count(*)::BIGINT AS n FROM h GROUP BY 1, 2""")
def mentions(t):
    return X.extract_mentions(t.pages, ["page_id"], "html", r'href="/[A-Za-z]+"', ["<nav", "footer"], 160).drop("cue")


@query("txt09_mention_cues")
def cues(t):
    own = F.regexp_extract("html", r'(href="/[A-Za-z]+")', 1)
    return X.extract_mentions(t.pages, ["page_id"], "html", r'href="/[A-Za-z]+"', ["<nav", "footer"], 60, own)


@query("txt10_text_features", r"""
SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INT AS n_words, regexp_matches(lower(text), '\bstable\b|\bagain\b|\bprior\b|\bprevious\b|\bunchanged\b|\binterval\b|\bpersist\w*|\bsimilar to\b|\bcompared? (?:to|with)\b|\bno (?:significant )?change\b|\bre-?demonstrat\w*') AS comparison,
 regexp_matches(lower(text), '\bportable\b|\blimited\b|\blow lung volumes?\b|\bsuboptimal\b|\brotat\w*|\bunderpenetrat\w*|\bmotion\b') AS limited FROM documents""")
def features(t):
    return X.text_features(t.documents, ["doc_id"], "text").select("doc_id", "n_words", "comparison", "limited")
