"""Line de-duplication by a log-template tree, with DataFrame functions only.

The tree has a fixed depth: token count, then the leading tokens, with tokens that hold a digit generalised to ``<*>`` where enough fixed
tokens remain (rows of numbers are only equal to themselves).  Below a
leaf a line has one key for each of five stretches of tokens, of all tokens but that stretch: lines that share a key are a
template, and the stretch left out is its variable field.  Short and long lines have a key of all tokens too.  A line belongs to
the template that stands in most texts.  Templates that recur across documents are dropped but for their first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Leading tokens of a leaf, stretches of a line, tokens that a line needs to be compared by stretches.
DEPTH, STRETCHES, LEAST_TOKENS = 3, 5, 10
#: What stands for a token with a digit, and the fixed tokens that a template needs, besides half of its line: other lines are compared as they are.
FIELD, LEAST_FIXED = "<*>", 3
#: Different texts over which a template has to recur; lines of LONG_TOKENS and more, equal but for digits, recur from LONG_DOCS texts on.
MIN_DOCS = 3
LONG_TOKENS, LONG_DOCS = 20, 2


def _enough(fixed: Column, n: Column) -> Column:
    return (fixed >= LEAST_FIXED) & (2 * fixed >= n)


def _fixed(words: Column) -> Column:
    return F.size(F.filter(words, lambda x: x != FIELD))


def line_table(docs: DataFrame, text: str) -> DataFrame:
    """One row for each line with a token of each text: digest of the text, position, tokens, leaf, keys: one for each stretch left out, then one of all tokens."""
    body = F.col(f"`{text}`")
    lines = docs.filter(body.isNotNull()).select(F.xxhash64(body).alias("d1"), F.hash(body).alias("d2"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    words = F.filter(F.split("line", r"[ \t\r]+"), lambda x: x != "")
    lines = lines.select("d1", "d2", "pos", words.alias("v"), F.col("line").rlike("[0-9]").alias("digits")).withColumn("n", F.size("v")).filter("n > 0")
    lines = lines.withColumn("g", F.when(F.col("digits"), F.transform("v", lambda x: F.when(x.rlike("[0-9]"), FIELD).otherwise(x))))
    lines = lines.withColumn("fixed", F.when(F.col("digits"), _fixed(F.col("g"))).otherwise(F.col("n")))
    lines = lines.withColumn("open", _enough(F.col("fixed"), F.col("n"))).withColumn("w", F.when(F.col("digits") & F.col("open"), F.col("g")).otherwise(F.col("v")))
    piece = lambda i: F.slice("w", F.floor(F.col("n") * i / STRETCHES).cast("int") + 1, F.floor(F.col("n") * (i + 1) / STRETCHES).cast("int") - F.floor(F.col("n") * i / STRETCHES).cast("int"))
    left = lambda i: ~F.col("digits") | _enough(F.col("fixed") - _fixed(piece(i)), F.col("n"))
    lines = lines.select("d1", "d2", "pos", "n", F.slice("w", 1, DEPTH).alias("lead"), F.xxhash64("n", "w").alias("whole"), F.when(F.col("open") & (F.col("n") >= LEAST_TOKENS), F.array(*[F.xxhash64(piece(i)) for i in range(STRETCHES)])).alias("parts"),
                         F.when(F.col("open") & (F.col("n") >= LEAST_TOKENS), F.array(*[left(i) for i in range(STRETCHES)])).alias("left"))
    but = lambda i: F.when(F.col("left")[i], F.xxhash64("n", "lead", F.lit(i), *[F.col("parts")[j] for j in range(STRETCHES) if j != i]))
    return lines.select("d1", "d2", "pos", "n", F.hash("lead").alias("leaf"), F.when(F.col("parts").isNotNull(), F.array_compact(F.array(*[but(i) for i in range(STRETCHES)]))).alias("keys"), "whole")


def recurring_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(d1, d2, drop): for each text, by digest, the positions of its lines that go."""
    lines = cut(line_table(docs, text))
    #: a line of medium length with other keys needs none of all tokens: three equal ones share all others
    whole = F.struct(F.col("whole").alias("key"), F.lit(True).alias("same"))
    field = F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(False).alias("same")))
    keys = F.when(F.coalesce(F.size("keys"), F.lit(0)) < 1, F.array(whole)).when(F.col("n") >= LONG_TOKENS, F.concat(field, F.array(whole))).otherwise(field)
    each = lines.select("d1", "d2", "pos", "n", "leaf", F.inline(keys))
    if min(min_docs, long_docs) > 1:
        #: keys of two different texts at least are few; only their lines are looked at further
        shared = each.groupBy("key").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).filter("a < b").select("key")
        each = each.join(cut(shared), "key")
    hits = cut(each.distinct())
    #: equal texts count once, so a copied document does not make its lines recur
    texts = hits.groupBy("key", "leaf", "n", "same", "d1", "d2").agg(F.min("pos").alias("first"))
    need = F.when(F.col("same") & (F.col("n") >= LONG_TOKENS), long_docs).otherwise(min_docs)
    common = texts.groupBy("key", "leaf", "n", "same").agg(F.count("*").alias("texts"), F.min(F.struct("d1", "d2", F.col("first").alias("pos"))).alias("owner")).filter(F.col("texts") >= need)
    placed = hits.join(cut(common), ["key", "leaf", "n", "same"]).groupBy("d1", "d2", "pos").agg(F.max(F.struct("texts", "key", "owner")).alias("best"))
    placed = cut(placed.select("d1", "d2", "pos", "best.owner"))
    #: the owner of a template stays, whatever other template it belongs to, so each line that goes has one that stands for it
    gone = placed.join(placed.select("owner.*").distinct(), ["d1", "d2", "pos"], "left_anti")
    return gone.groupBy("d1", "d2").agg(F.collect_set("pos").alias("drop"))        # as many as the text has lines, whatever its copies


def drop_recurring_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """``docs`` with a cleaned text and the columns lines_dropped and chars_dropped (columns of these names are replaced).

    A template recurs when it stands in at least ``min_docs`` different texts, and a line of ``LONG_TOKENS`` tokens and
    more, equal but for digits, when it stands in ``long_docs``.  All its lines go but one, the first in the text that owns it
    (smallest digest): what is lost are the values of a template's field.  Equal texts share their fate.  Lines are cut at
    ``\\n``; lines without a token stay.  A null text stays null with 0 dropped lines, an empty text stays empty; other columns,
    repeated rows and null identifiers pass through.
    """
    docs = docs.drop("lines_dropped", "chars_dropped")
    names, body = docs.columns, F.col(f"`{text}`")
    gone = recurring_lines(docs, text, min_docs, long_docs).withColumnsRenamed({"d1": "_d1", "d2": "_d2", "drop": "_drop"})
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(body).alias("_own1"), F.hash(body).alias("_own2"))
    joined = keyed.join(gone.hint("shuffle_hash"), (F.col("_own1") == F.col("_d1")) & (F.col("_own2") == F.col("_d2")) & body.isNotNull(), "left")
    kept = F.array_join(F.filter(F.split(body, "\n"), lambda x, i: ~F.array_contains("_drop", i)), "\n")
    clean = F.when(F.col("_drop").isNull(), body).otherwise(kept)
    return joined.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in names], F.coalesce(F.size("_drop"), F.lit(0)).alias("_n"), F.coalesce(F.length(body) - F.length(clean), F.lit(0)).alias("_c")) \
        .withColumnsRenamed({"_n": "lines_dropped", "_c": "chars_dropped"})
